"""How runs end, which fields are checked, and what is said of stages: rules on rows of runs and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriquill.functions.arrow import normalise_text, sequences_alike
from veriquill.functions.columns import json_kind
from veriquill.operators.sides import small_side

# What a loop's outcome makes of the run, and the reason it records.
ENDINGS = {
    "mark_complete_validated": ("continue", None),
    "tool_cap_hit": ("in_progress", None),
    "text_only_stall": ("failed_validation", "text_only_stall"),
    "extractor_stalled": ("failed_validation", "stalled"),
    "extractor_abandoned": ("failed_validation", "surrendered"),
    "extractor_refused": ("error", None),
    "review_complete": ("complete", None),
    "review_abandoned": ("failed_validation", "review_surrendered"),
    "review_cap_hit": ("failed_validation", "review_cap_hit"),
    "review_text_only_stall": ("failed_validation", "review_text_only_stall"),
    "review_stalled": ("failed_validation", "review_stalled"),
}


def ending(outcome: Column) -> tuple[Column, Column]:
    """(status, reason) of a loop's outcome; an outcome that is not known fails the job."""
    status = F.create_map(*[F.lit(x) for k, (s, _) in ENDINGS.items() for x in (k, s)])
    reason = F.create_map(*[F.lit(x) for k, (_, r) in ENDINGS.items() if r for x in (k, r)])
    known = F.when(outcome.isin(*ENDINGS), status[outcome]).otherwise(F.raise_error(F.concat(F.lit("unknown outcome "), F.coalesce(outcome, F.lit("null")))).cast("string"))
    return known, reason[outcome]


def checkable(cells: DataFrame, catalogue: DataFrame, made: DataFrame, most: int) -> DataFrame:
    """Applied cells that go to the checker, with `check_index`, in order of path: fields of the study or a record that the
    template has, with a value and some evidence, and with checks left. made: study_id, path, checks."""
    spec = catalogue.select("block", "variable")
    rows = cells.where(F.col("block").isin("study", "record") & (json_kind(F.col("value")) != "null") & (F.regexp_replace(F.coalesce("evidence", F.lit("")), r"(?U)\s+", "") != "")).join(small_side(spec), ["block", "variable"])
    left = rows.join(made.select("study_id", "path", "checks"), ["study_id", "path"], "left").withColumn("check_index", F.coalesce("checks", F.lit(0)) + 1).drop("checks")
    return left.where(F.col("check_index") <= most).orderBy("study_id", "path")


def verdicts(answers: DataFrame) -> DataFrame:
    """answers (verdict, error, ...) with a verdict for every check: one that failed counts as a challenge that the checker did not raise."""
    failed = F.col("error").isNotNull() | F.col("verdict").isNull()
    return answers.withColumns({"verdict": F.when(failed, "challenge").otherwise(F.col("verdict")), "rationale": F.when(failed, F.coalesce("error", F.lit("no verdict"))).otherwise(F.col("rationale")), "error_origin": failed})


def summaries_match(a: Column, b: Column) -> Column:
    """Whether two summaries may be of one study: one holds the other, or they are alike by 0.6; with nothing to compare, yes."""
    x, y = normalise_text(a), normalise_text(b)
    plain = (x == "") | (y == "") | F.contains(x, y) | F.contains(y, x)
    return plain | sequences_alike(F.when(~plain, x), y, F.lit(0.6))


def identity_text(summary: Column, role_value: Column, title: Column, doi: Column) -> Column:
    """What tells a reader which study this is: the manifest's summary, else the summary field, else title and DOI."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(some(summary), some(role_value), F.nullif(F.concat_ws(" | ", some(title), some(doi)), F.lit("")))


def shown_value(raw: Column) -> Column:
    """A JSON value for a reader: text bare, lists joined, null as a dash."""
    kind = json_kind(raw)
    listed = F.array_join(F.from_json(raw, "array<string>"), "; ")
    return F.when(kind == "null", "-").when(kind == "string", F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]).when(kind == "array", listed).otherwise(raw)


def role_cost_text(cost: Column, incomplete: Column, tokens: Column, unreceipted: Column) -> Column:
    """A role's cost in words: no calls, no price, a figure, or at least a figure."""
    figure = F.when(cost.isNotNull(), F.format_string("$%.4f", cost))
    none = cost.isNull() & ~F.coalesce(incomplete, F.lit(False)) & (F.coalesce(tokens, F.lit(0)) == 0)
    partial = F.format_string("at least %s (%d calls without a price)", F.coalesce(figure, F.lit("nothing priced")), F.coalesce(unreceipted, F.lit(0)))
    return F.when(none, "no calls").when(F.coalesce(incomplete, F.lit(False)), partial).when(cost.isNull(), "not priced").otherwise(figure)


def turn_texts(events: DataFrame) -> DataFrame:
    """(session_id, turn_id, text, stop_reason) of each turn: the written text, else the message's, else the review's; the first reason given."""
    order = F.col("line_no")
    of = lambda kind, column: F.min_by(F.when(F.col("event") == kind, F.nullif(F.col(column), F.lit(""))), F.when((F.col("event") == kind) & (F.coalesce(column, F.lit("")) != ""), order))
    return events.where("turn_id is not null").groupBy("session_id", "turn_id").agg(
        F.coalesce(of("assistant_text", "text"), of("assistant_message", "text"), of("final_review_response", "text"), F.lit("")).alias("text"), F.coalesce(of("assistant_message", "stop_reason"), of("extractor_refused", "stop_reason")).alias("stop_reason")
    )


#: Line numbers of a session that are counted in one place.
LINES_TOGETHER = 1 << 16


def ordinals(checks: DataFrame) -> DataFrame:
    """Checks of a session with their number in it and their number for the field.

    A session is numbered range by range of its lines, so that a long one is no single task's.
    """
    part = F.floor(F.col("line_no") / LINES_TOGETHER)
    sizes = checks.groupBy("session_id", part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("session_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("__before", before).drop("n")
    placed = checks.withColumn("__part", part).join(sizes, ["session_id", "__part"])
    number = F.col("__before") + F.row_number().over(Window.partitionBy("session_id", "__part").orderBy("line_no", "path"))
    numbered = placed.withColumn("check_no", number).drop("__part", "__before")
    return numbered.withColumn("field_check_no", F.row_number().over(Window.partitionBy("session_id", "path").orderBy("line_no"))).select(*checks.columns, "check_no", "field_check_no")


def trails(mentions: DataFrame) -> DataFrame:
    """(session_id, path, trail): where each field is mentioned, in order."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "label")))
    return mentions.groupBy("session_id", "path").agg(F.transform(rows, lambda r: r["label"]).alias("trail"))


def public(result: Column) -> Column:
    """A map without the keys that are only for the engine."""
    return F.map_filter(result, lambda k, v: ~k.startswith("_"))
