"""Ordered folds over logs: runs of equal rows, streaks, stages, replays. Order is the line number, within a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, key: list[str], order: str, value: Column) -> DataFrame:
    """df with `island`: numbered runs of rows with one non-null value; a null never joins another."""
    over = Window.partitionBy(*key).orderBy(order)
    starts = F.coalesce(value != F.lag(value).over(over), F.lit(True))
    return df.withColumn("__starts", starts.cast("int")).withColumn("island", F.sum("__starts").over(over.rowsBetween(Window.unboundedPreceding, 0))).drop("__starts")


def stage_split(df: DataFrame, key: list[str], order: str, is_review: Column) -> DataFrame:
    """df with `in_review`: from the first review event on, everything is review."""
    so_far = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("in_review", F.max(is_review.cast("int")).over(so_far) == 1)


def streaks(df: DataFrame, key: list[str], order: str, fails: Column, signature: Column) -> DataFrame:
    """df with `streak`: how many equal failures in a row end here; 0 where nothing fails."""
    marked = df.withColumn("__sig", F.when(fails, signature))
    runs = islands(marked, key, order, F.col("__sig"))
    place = F.row_number().over(Window.partitionBy(*key, "island").orderBy(order))
    return runs.withColumn("streak", F.when(F.col("__sig").isNull(), 0).otherwise(place)).drop("__sig", "island")


def first_stall(df: DataFrame, key: list[str], order: str, fails: Column, signature: Column, limit: int = 5) -> DataFrame:
    """(key, line): where the limit-th equal failure in a row comes first."""
    return streaks(df, key, order, fails, signature).where(F.col("streak") >= limit).groupBy(*key).agg(F.min(order).alias("stalled_at"))


def failure_signature(tool: Column, codes: Column) -> Column:
    """The tool and the sorted codes of a failure, repeats kept."""
    return F.concat_ws("|", tool, F.array_join(F.array_sort(F.array_compact(codes)), ","))


def newest_resumable(runs: DataFrame, expected_fp: str | None = None) -> DataFrame:
    """Of each study's runs in progress (with that configuration, if one is asked for), the last updated; ties by directory."""
    open_runs = runs.where("status = 'in_progress'")
    if expected_fp is not None:
        open_runs = open_runs.where(F.col("config_fp") == expected_fp)
    return first_of(open_runs, ["study_id"], F.desc("updated_at"), F.desc("dir"))


def first_of(df: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def replay(events: DataFrame) -> DataFrame:
    """(session_id, turn_no, turn_id, parts): a session's turns in the order they are first seen, each with its parts in order.

    A last turn that nothing answers (no part of the user's side) is dropped: the call it made was never completed.
    events: session_id, line_no, turn_id, role, text; rows without a turn take no part.
    """
    turns = events.where("turn_id is not null").groupBy("session_id", "turn_id").agg(
        F.min("line_no").alias("since"), F.transform(F.array_sort(F.collect_list(F.struct("line_no", "role", "text"))), lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("parts")
    )
    session = Window.partitionBy("session_id").orderBy("since")
    numbered = turns.withColumn("turn_no", F.row_number().over(session)).withColumn("__last", F.lead("since").over(session).isNull())
    answered = F.exists("parts", lambda p: p["role"] == "user")
    return numbered.where(~F.col("__last") | answered).select("session_id", F.col("turn_no").cast("long").alias("turn_no"), "turn_id", "parts")


def budget_left(df: DataFrame, key: list[str], order: str, cap: int) -> DataFrame:
    """df with `budget_left`: what is left of `cap` before each row."""
    return df.withColumn("budget_left", F.greatest(F.lit(0), F.lit(cap) - F.row_number().over(Window.partitionBy(*key).orderBy(order)) + 1))


def merged_intervals(df: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(key, start, end, n): intervals of a key that overlap or touch are one."""
    before = Window.partitionBy(*key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.col(start) > F.max(end).over(before), F.lit(True)).cast("int")
    so_far = Window.partitionBy(*key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("__begins", begins).withColumn("__island", F.sum("__begins").over(so_far))
    return marked.groupBy(*key, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("__island")


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """left less one row for each equal row of right."""
    return left.exceptAll(right)


def first_warnings(events: DataFrame) -> DataFrame:
    """Each warning of a session once, where it is first."""
    return first_of(events.where("message is not null"), ["session_id", "message"], "line_no")


def stage_retries(events: DataFrame) -> DataFrame:
    return events.where("event = 'provider_retry'").groupBy("session_id", "stage").agg(F.count("*").alias("retries"))


def asks_in_order(wire: DataFrame) -> DataFrame:
    """(session_id, field_path, check_index, asks): the asks of each check in order."""
    rows = F.array_sort(F.collect_list(F.struct("ask", "request", "response")))
    return wire.groupBy("session_id", "field_path", "check_index").agg(rows.alias("asks"))


def _tails(lines: DataFrame) -> DataFrame:
    """lines with `__torn`: whether a line is no JSON and its file's last. Any other line that is none fails the job."""
    last = lines.groupBy("file").agg(F.max("line_no").alias("__last"))
    wrong = F.raise_error(F.format_string("line %d of %s is not JSON", "line_no", "file")).cast("boolean")
    torn = F.when(F.try_parse_json("text").isNotNull(), False).when(F.col("line_no") == F.col("__last"), True).otherwise(wrong)
    return lines.join(last, "file").withColumn("__torn", torn).drop("__last")


def drop_torn_tail(lines: DataFrame) -> DataFrame:
    """lines (file, line_no, text) less a last line of a file that is no JSON; any other line that is none fails the job."""
    return _tails(lines).where(~F.col("__torn")).select(*lines.columns)


def torn_tails(lines: DataFrame) -> DataFrame:
    """(file, line_no, event, byte_length, raw, warning): what is recorded of each last line that was dropped."""
    said = F.format_string("dropped a torn last line of %d bytes (line %d): the last write did not end", F.octet_length("text"), F.col("line_no") + 1)
    return _tails(lines).where("__torn").select("file", "line_no", F.lit("torn_line_dropped").alias("event"), F.octet_length("text").cast("long").alias("byte_length"), F.col("text").alias("raw"), said.alias("warning"))


def max_turns(events: DataFrame) -> DataFrame:
    """(session_id, max_turn): the highest turn of each session, 0 if it has none. `turn` is JSON text; only whole numbers count."""
    whole = F.when(F.col("turn").rlike(r"^[0-9]+$"), F.col("turn").cast("long"))
    return events.groupBy("session_id").agg(F.coalesce(F.max(whole), F.lit(0)).alias("max_turn"))
