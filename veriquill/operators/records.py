"""Extraction records rebuilt from their log of changes, and the rules for ending one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriquill.functions.columns import json_kind, json_string, status_of
from veriquill.operators import values

#: Tools by the role that may call them, and their arguments.
TOOLS = {
    "record_initial_check": ("extractor", ("checks",)),
    "update_study": ("extractor,review", ("fields", "notes")),
    "add_record": ("extractor,review", ("fields", "notes")),
    "update_record": ("extractor,review", ("record_id", "fields", "notes")),
    "remove_record": ("extractor,review", ("record_id", "reason")),
    "mark_complete": ("extractor,review", ("quality_check", "summary")),
    "abandon_extraction": ("extractor", ("reason",)),
    "view_summary": ("extractor,review", ()),
    "view_study_fields": ("extractor,review", ()),
    "view_record": ("extractor,review", ("record_id",)),
}


def record_ids(adds: DataFrame) -> DataFrame:
    """adds (study_id, entity, seq) with record_id: entity and a number that counts every record ever added, so none is used twice."""
    order = Window.partitionBy("study_id", "entity").orderBy("seq")
    return adds.withColumn("record_id", F.concat("entity", F.lit("_"), F.row_number().over(order)))


def counters(adds: DataFrame) -> DataFrame:
    """(study_id, entity, last): the highest number given to a record of each kind, removed ones included; a resumed run goes on from it."""
    return adds.groupBy("study_id", "entity").agg(F.count("*").alias("last"))


def current_cells(writes: DataFrame, removals: DataFrame) -> DataFrame:
    """The last write of each path, less those of removed records.

    writes: study_id, path, record_id, seq and whatever else; removals: study_id, record_id. Record ids are never used
    again, so when a removal came does not matter.
    """
    rest = [c for c in writes.columns if c not in ("study_id", "path")]
    last = writes.groupBy("study_id", "path").agg(F.max_by(F.struct(*rest), "seq").alias("c")).select("study_id", "path", "c.*")
    return last.join(removals.select("study_id", "record_id").distinct(), ["study_id", "record_id"], "left_anti")


def applied(proposals: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What calls that write fields do: the cells that pass, and one row a call with its status.

    proposals: cells with call_id, tool. Every field is judged by itself and those that pass are kept; an added record of
    which nothing passes is not made (record_made is false).
    """
    checked = values.checked(proposals, catalogue)
    fine = checked.where(F.size("errors") == 0)
    calls = checked.groupBy("study_id", "call_id", "tool").agg(F.count_if(F.size("errors") == 0).alias("applied"), F.count_if(F.size("errors") > 0).alias("failed"))
    calls = calls.withColumn("status", status_of(F.col("applied"), F.col("failed"))).withColumn("record_made", (F.col("tool") == "add_record") & (F.col("applied") > 0))
    return fine, calls


def dispatch_problem(tool: Column, role: Column, arguments: Column, started: Column) -> Column:
    """The first reason to refuse a call, in order: the tool, its input, the role, the order of calls, its arguments.

    arguments is a map, null if the input was none; started says whether the initial check is recorded.
    """
    roles = F.create_map(*[F.lit(x) for t, (r, _) in TOOLS.items() for x in (t, r)])
    allowed = F.create_map(*[x for t, (_, a) in TOOLS.items() for x in (F.lit(t), F.array(*[F.lit(y) for y in a]).cast("array<string>"))])
    known = F.array(*[F.lit(t) for t in TOOLS])
    return (
        F.when(tool.isNull() | ~F.array_contains(known, F.coalesce(tool, F.lit(""))), "unknown_tool")
        .when(arguments.isNull(), "malformed_input")
        .when(~F.array_contains(F.split(roles[tool], ","), role), "tool_not_available_to_role")
        .when((role == "extractor") & ~started & ~tool.isin("record_initial_check", "abandon_extraction"), "initial_check_required")
        .when(F.size(F.array_except(F.map_keys(arguments), allowed[tool])) > 0, "unknown_argument")
    )


def completion_problems(cells: DataFrame, catalogue: DataFrame, studies: DataFrame, role: str = "extractor") -> DataFrame:
    """(study_id, code, path): why a study may not be marked complete. The reviewer's mark always stands."""
    if role == "review":
        return studies.select("study_id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("path")).where("false")
    owed = values.missing_required(cells, catalogue, studies)
    fields = owed.select("study_id", F.when(F.col("path").startswith("study."), "study_field_required").otherwise("record_field_required").alias("code"), "path")
    with_records = cells.where("block = 'record'").select("study_id").distinct()
    none = studies.join(with_records, "study_id", "left_anti").select("study_id", F.lit("no_records").alias("code"), F.lit(None).cast("string").alias("path"))
    wanted = catalogue.where("required and block = 'quality_check'").select("variable")
    answered = cells.where("block = 'quality_check'").where(json_kind(F.col("value")) != "null").select("study_id", "variable").distinct()
    checks = studies.select("study_id").crossJoin(wanted).join(answered, ["study_id", "variable"], "left_anti")
    checks = checks.select("study_id", F.lit("quality_check_required").alias("code"), F.concat(F.lit("quality_check."), "variable").alias("path"))
    return fields.unionByName(none).unionByName(checks)


def record_labels(cells: DataFrame, context: list[str]) -> DataFrame:
    """(study_id, record_id, label): the id and the values of the context fields that are not blank, in their order."""
    names = F.array(*[F.lit(c) for c in context])
    picked = cells.where((F.col("block") == "record") & F.col("variable").isin(*context))
    shown = F.coalesce(json_string(F.col("value")), F.when(json_kind(F.col("value")) != "null", F.col("value")))
    rows = picked.select("study_id", "record_id", F.array_position(names, F.col("variable")).alias("at"), F.trim(shown).alias("shown")).where("shown <> ''")
    parts = rows.groupBy("study_id", "record_id").agg(F.array_sort(F.collect_list(F.struct("at", "shown"))).alias("parts"))
    everyone = cells.where("block = 'record'").select("study_id", "record_id").distinct().join(parts, ["study_id", "record_id"], "left")
    return everyone.select("study_id", "record_id", F.concat_ws(" | ", "record_id", F.transform("parts", lambda p: p["shown"])).alias("label"))
