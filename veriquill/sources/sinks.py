"""Writers. Spark's commit protocol makes each write whole or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_log(df: DataFrame, path: str) -> None:
    """Rows as JSON lines added to a log."""
    df.write.mode("append").json(path)


def append_runs(runs: DataFrame, path: str) -> None:
    """Finished runs, in folders by study, so that a study's runs are read alone. Appends need no lock."""
    runs.write.mode("append").partitionBy("study_id").parquet(path)


def outputs(cells: DataFrame) -> DataFrame:
    """(study_id, output): current cells put together as one JSON document a study, fields by name and records by id."""
    one = F.concat(
        F.lit('{"value":'), F.coalesce("value", F.lit("null")), F.lit(',"evidence":'), F.coalesce(F.regexp_extract(F.to_json(F.array("evidence")), r"(?s)^\[(.*)\]$", 1), F.lit("null")), F.lit(',"notes":'),
        F.coalesce(F.regexp_extract(F.to_json(F.array("notes")), r"(?s)^\[(.*)\]$", 1), F.lit("null")), F.lit("}"),
    )
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    body = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda r: F.concat(quoted(r["k"]), F.lit(":"), r["v"])), ",")
    rows = cells.withColumn("v", F.when(F.col("block").isin("study", "record"), one).otherwise(F.col("value")))
    owners = rows.groupBy("study_id", "block", "record_id", "role").agg(body(F.collect_list(F.struct(F.col("variable").alias("k"), "v"))).alias("body"))
    records = F.array_sort(F.collect_list(F.when(F.col("block") == "record", F.struct("record_id", F.concat(F.lit('{"record_id":'), quoted("record_id"), F.lit(","), "body", F.lit("}")).alias("v")))))
    roles = lambda block: F.concat(F.lit("{"), body(F.collect_list(F.when(F.col("block") == block, F.struct(F.col("role").alias("k"), F.concat(F.lit("{"), "body", F.lit("}")).alias("v"))))), F.lit("}"))
    study = F.coalesce(F.max(F.when(F.col("block") == "study", F.col("body"))), F.lit(""))
    return owners.groupBy("study_id").agg(
        F.concat(
            F.lit('{"initial_check":'), roles("initial_check"), F.lit(',"quality_check":'), roles("quality_check"), F.lit(',"records":['), F.array_join(F.transform(records, lambda r: r["v"]), ","), F.lit('],"study":{'), study, F.lit("}}")
        ).alias("output")
    )


SECRET = r'(?i)("(?:[a-z0-9_-]*(?:api[_-]?key|authorization|secret|token|password))"\s*:\s*)"(?:[^"\\]|\\.)*"'


def without_secrets(raw: Column) -> Column:
    """JSON text with the strings under names of keys, tokens and passwords blanked."""
    return F.regexp_replace(raw, SECRET, '$1"***"')


def append_calls(calls: DataFrame, path: str) -> None:
    """Calls as they went over the wire (request and response as JSON text), added to a log without their secrets."""
    append_log(calls.withColumns({c: without_secrets(F.col(c)) for c in ("request", "response")}), path)


def write_histories(lines: DataFrame, path: str) -> None:
    """Documents in lines, as from `operators.history.document_lines`, in folders by session, written whole or not at all.

    A session's file is its JSON document. One task writes it, line by line, so that no document has to fit in memory.
    """
    ordered = lines.repartition("session_id").sortWithinPartitions("session_id", "part", "at")
    ordered.select("session_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("session_id").text(path)


def run_entries(runs: DataFrame, usage: DataFrame, costs: DataFrame) -> DataFrame:
    """One row a finished run: its metadata with its tokens and its cost."""
    return runs.where("status <> 'in_progress'").join(usage, "session_id", "left").join(costs, "session_id", "left")
