"""What tool calls do to records, many calls at once: what is refused, what is applied, and what is shown.

calls: study_id, call_id, seq, tool, record_id, reason, fields_kind (what the fields argument holds, as `json_kind` says), n_fields.
lives: study_id, record_id, since, until: when a record was added and removed, by the number of the call; until may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriquill.operators import values
from veriquill.operators.sides import small_side


def blank(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\s+", "") == ""


def call_problems(calls: DataFrame, lives: DataFrame) -> DataFrame:
    """(study_id, call_id, path, code, message): the first thing that keeps a call from being carried out at all.

    A record must be named and be there at that call; fields must be an object that holds some; a removal and a surrender
    need a reason. What is wrong with single fields is not a matter of the call.
    """
    named = lives.select("study_id", "record_id", "since", "until")
    met = calls.join(named, ["study_id", "record_id"], "left")
    alive = (F.col("since") < F.col("seq")) & (F.col("until").isNull() | (F.col("until") >= F.col("seq")))
    there = met.groupBy(*calls.columns).agg(F.coalesce(F.bool_or(alive), F.lit(False)).alias("there"))
    tool, lost = F.col("tool"), ~F.col("there")
    needs_record, needs_fields, needs_reason = tool.isin("update_record", "remove_record", "view_record"), tool.isin("update_record", "add_record", "update_study"), tool.isin("remove_record", "abandon_extraction")
    kind = F.coalesce("fields_kind", F.lit("null"))
    problem = lambda path, code, message: F.struct(F.lit(path).alias("path"), F.lit(code).alias("code"), message.alias("message"))
    said = (
        F.when(needs_record & blank("record_id"), F.when(tool == "view_record", problem("record_id", "missing_record_id", F.lit("which record is to be shown must be said"))).otherwise(problem("record_id", "missing_field", F.lit("which record is meant must be said"))))
        .when(needs_reason & blank("reason"), problem("reason", "missing_field", F.concat(tool, F.lit(" needs a reason in words"))))
        .when(needs_record & lost, problem("record_id", "unknown_record", F.concat(F.lit("there is no record "), "record_id")))
        .when(needs_fields & ~kind.isin("object", "null"), problem("fields", "type_mismatch", F.concat(F.lit("fields must be an object of values by name, not "), kind)))
        .when(tool.isin("update_record", "add_record") & ((kind == "null") | (F.col("n_fields") == 0)), problem("fields", "missing_fields", F.concat(tool, F.lit(" needs at least one field"))))
    )
    return there.withColumn("p", said).where("p is not null").select("study_id", "call_id", "p.*")


def merged(proposals: DataFrame, current: DataFrame) -> DataFrame:
    """Each updated record as its call would leave it: its cells with the accepted ones of the call in their places.

    proposals: cells with call_id; current: cells as they are. The result has the call in record_id's place, so that rules
    between the fields of one record look at one call's view of it.
    """
    touched = proposals.where("block = 'record'").select("study_id", "call_id", "record_id").distinct()
    old = current.where("block = 'record'").join(touched, ["study_id", "record_id"]).select("study_id", "call_id", "record_id", "variable", "value")
    new = proposals.where("block = 'record'").select("study_id", "call_id", "record_id", "variable", "value")
    kept = old.join(new.select("study_id", "call_id", "record_id", "variable"), ["study_id", "call_id", "record_id", "variable"], "left_anti")
    return kept.unionByName(new)


def merged_gate_warnings(proposals: DataFrame, current: DataFrame, gates: DataFrame) -> DataFrame:
    """(study_id, call_id, path, code, message): gates over each updated record as the call would leave it."""
    key = F.to_json(F.array("call_id", "record_id"))
    view = merged(proposals, current).select("study_id", F.lit("record").alias("block"), key.alias("record_id"), "variable", "value")
    found = values.gate_warnings(view, gates)
    parts = F.from_json("record_id", "array<string>")
    return found.select("study_id", parts[0].alias("call_id"), F.concat(F.lit("record."), parts[1], F.lit("."), "field").alias("path"), "code", "message")


def diffs(accepted: DataFrame, current: DataFrame) -> DataFrame:
    """accepted (study_id, call_id, path, value) with before and after, JSON texts; null before where there was nothing."""
    old = current.select("study_id", "path", F.col("value").alias("before"))
    return accepted.join(old, ["study_id", "path"], "left").select("study_id", "call_id", "path", F.coalesce("before", F.lit("null")).alias("before"), F.col("value").alias("after"))


def live_cells(paths: DataFrame, current: DataFrame) -> DataFrame:
    """paths (study_id, path) with the value, evidence and notes that stand there now; nulls where there is nothing."""
    return paths.join(current.select("study_id", "path", "value", "evidence", "notes"), ["study_id", "path"], "left")


def specs_of(paths: DataFrame, catalogue: DataFrame, records: DataFrame) -> DataFrame:
    """paths (study_id, path) of fields that the template has, with block, record_id, variable and field_type; of records that are there."""
    parts = F.split("path", r"\.")
    block = F.when((F.size(parts) == 2) & (parts[0] == "study"), "study").when((F.size(parts) == 3) & (parts[0] == "record"), "record")
    placed = paths.withColumn("block", block).where("block is not null").withColumn("record_id", F.when(F.col("block") == "record", F.get(parts, F.lit(1)))).withColumn("variable", F.element_at(parts, -1))
    known = placed.join(small_side(catalogue.select("block", "variable", "field_type")), ["block", "variable"])
    there = records.select("study_id", "record_id", F.lit(True).alias("there")).distinct()
    found = known.join(there, ["study_id", "record_id"], "left").where("block = 'study' or there")
    return found.select(*paths.columns, "block", "record_id", "variable", "field_type")


def study_view(cells: DataFrame, role: str) -> DataFrame:
    """The cells that a role is shown of its study: the study's own, and to the extractor its checks."""
    blocks = ("study", "initial_check", "quality_check") if role == "extractor" else ("study",)
    return cells.where(F.col("block").isin(*blocks) & ((F.col("block") == "study") | (F.col("role") == role)))


def record_view(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """The cells of the records asked for (study_id, record_id)."""
    return cells.where("block = 'record'").join(wanted.select("study_id", "record_id").distinct(), ["study_id", "record_id"], "left_semi")


def summaries(cells: DataFrame, catalogue: DataFrame, context: list[str]) -> DataFrame:
    """(study_id, block, record_id, filled, total, label): the counts of each block and record, records with their labels."""
    from veriquill.operators.records import record_labels

    counts = values.filled_counts(cells, catalogue)
    return counts.join(record_labels(cells, context), ["study_id", "record_id"], "left")


def unattached(hashed: Column, attached: Column) -> Column:
    """Labels that are hashed but not shown to the model, sorted."""
    return F.array_sort(F.array_except(hashed, attached))
