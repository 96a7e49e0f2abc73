"""Calls carried out: from what a model proposed, call by call, to the records that stand in the end. The model itself is not part of it.

calls: study_id, call_id, seq, tool, record_id, reason, fields (variable to envelope as JSON text), role, checks (the answers of a
check block, by variable, as one JSON text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriquill.operators import records, tools, values
from veriquill.sources.files import bare_answers, envelope_parts, json_value
from veriquill.sources.folders import new_folder

CALL = "study_id string, call_id string, seq long, tool string, record_id string, reason string, fields map<string,string>, role string, checks string"
CHECKS = {"record_initial_check": "initial_check", "mark_complete": "quality_check"}
WRITES = ("update_study", "add_record", "update_record")


def proposed(calls: DataFrame) -> DataFrame:
    """The fields of calls that write, as cells with call_id, seq and tool. A record that is yet to be made goes by its call's id."""
    writes = calls.where(F.col("tool").isin(*WRITES)).select("study_id", "call_id", "seq", "tool", "record_id", F.explode("fields").alias("variable", "cell"))
    block = F.when(F.col("tool") == "update_study", "study").otherwise("record")
    record = F.when(F.col("tool") == "add_record", F.concat(F.lit("new:"), "call_id")).when(F.col("tool") == "update_record", F.col("record_id"))
    placed = writes.withColumn("block", block).withColumn("record_id", record).withColumn("cell", F.coalesce("cell", F.lit("null")))
    path = F.concat_ws(".", "block", "record_id", "variable")
    evidence, notes = envelope_parts("cell")
    none = F.lit(None).cast("string")
    cells = placed.select("study_id", "call_id", "seq", "tool", "block", "record_id", none.alias("role"), "variable", path.alias("path"), json_value("cell").alias("value"), evidence.alias("evidence"), notes.alias("notes"))
    answered = calls.where(F.col("tool").isin(*CHECKS) & F.col("checks").isNotNull())
    blocks = F.create_map(*[F.lit(x) for pair in CHECKS.items() for x in pair])
    bare = bare_answers(answered.select("study_id", "call_id", "seq", "tool", blocks[F.col("tool")].alias("block"), F.coalesce("role", F.lit("extractor")).alias("role"), "checks"), "checks")
    return cells.unionByName(bare.select(*[c for c in bare.columns], none.alias("record_id"), F.concat_ws(".", "block", "role", "variable").alias("path"), none.alias("evidence"), none.alias("notes")))


def judged(cells: DataFrame, catalogue: DataFrame, entries: DataFrame, papers: DataFrame, labels: DataFrame) -> DataFrame:
    """cells with value_out, errors, canonicalisations and weak_matches; one path may be proposed in any number of calls."""
    mark = F.concat("call_id", F.lit("|"))
    own = cells.withColumn("path", F.concat(mark, "path"))
    found = values.envelopes(own.select(*[c.split(" ")[0] for c in values.CELL.split(", ")]), catalogue, entries, papers, labels)
    plain = lambda c: F.regexp_replace(c, r"^[^|]*\|", "")
    errors = F.transform("errors", lambda e: F.struct(plain(e["path"]).alias("path"), e["code"].alias("code"), e["message"].alias("message")))
    back = found.withColumn("errors", errors).select("study_id", F.col("path").alias("__path"), "value_out", "errors", "canonicalisations", "weak_matches")
    return own.withColumnRenamed("path", "__path").join(back, ["study_id", "__path"]).withColumn("path", plain(F.col("__path"))).drop("__path")


def carried_out(calls: DataFrame, catalogue: DataFrame, entries: DataFrame, papers: DataFrame, labels: DataFrame, entity: str = "record") -> tuple[DataFrame, DataFrame]:
    """(cells, outcomes): the cells that stand in the end, and one row a call: status, applied, failed, record_id, code.

    Every field is judged by itself. A call of which nothing passes does nothing: an added record is not made and uses up
    no number. Changes to records that are not there at that call are refused, as are calls without what they need. The
    judgements are written to the shared folder, as all that follows is made of them.
    """
    spark = calls.sparkSession
    folder = new_folder(spark, "judged")
    judged(proposed(calls), catalogue, entries, papers, labels).write.parquet(folder)
    cells = spark.read.parquet(folder)
    fine = cells.where(F.size("errors") == 0)
    counts = cells.groupBy("study_id", "call_id").agg(F.count_if(F.size("errors") == 0).alias("applied"), F.count_if(F.size("errors") > 0).alias("failed"))
    made = calls.where("tool = 'add_record'").join(counts.where("applied > 0"), ["study_id", "call_id"]).select("study_id", "call_id", F.lit(entity).alias("entity"), "seq")
    minted = records.record_ids(made).select("study_id", "call_id", "seq", "record_id")
    ended = calls.where("tool = 'remove_record'").where(~tools.blank("reason")).groupBy("study_id", "record_id").agg(F.min("seq").alias("until"))
    lives = minted.select("study_id", "record_id", F.col("seq").alias("since")).join(ended, ["study_id", "record_id"], "left")
    shaped = calls.withColumn("fields_kind", F.when(F.col("fields").isNotNull(), "object")).withColumn("n_fields", F.coalesce(F.size("fields"), F.lit(0)).cast("long")).drop("fields")
    refused = tools.call_problems(shaped, lives).select("study_id", "call_id", "code")
    new = minted.select("study_id", "call_id", F.col("record_id").alias("minted"))
    kept = fine.join(refused, ["study_id", "call_id"], "left_anti").join(new, ["study_id", "call_id"], "left").withColumn("record_id", F.coalesce("minted", "record_id")).drop("minted")
    kept = kept.withColumn("path", F.concat_ws(".", "block", "record_id", "role", "variable")).withColumn("value", F.col("value_out"))
    standing = records.current_cells(kept.select("study_id", "path", "record_id", "seq", "block", "role", "variable", "value", "evidence", "notes"), lives.where("until is not null and until > since"))
    outcomes = calls.select("study_id", "call_id", "seq", "tool", F.col("record_id").alias("asked")).join(counts, ["study_id", "call_id"], "left").join(refused, ["study_id", "call_id"], "left").join(new, ["study_id", "call_id"], "left")
    n = lambda c: F.when(F.col("code").isNull(), F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(0))
    status = F.when(F.col("code").isNotNull(), "validation_failed").when(F.coalesce("failed", F.lit(0)) == 0, "ok").when(F.col("applied") > 0, "partial").otherwise("validation_failed")
    return standing, outcomes.select("study_id", "call_id", "seq", "tool", F.coalesce("minted", "asked").alias("record_id"), status.alias("status"), n("applied").alias("applied"), n("failed").alias("failed"), "code")
