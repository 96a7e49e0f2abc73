"""Validation of values in long form: one row a cell, all fields of all studies at once.

cells: study_id, block, record_id, role, variable, path, value (JSON text), evidence, notes.
catalogue: block, variable, field_type, options, allow_other, evidence_rule, required, canonical_reference, role_name, pos.
Messages are for people; their wording is our own and not part of the contract, codes and paths are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriquill.functions.arrow import normalise_text
from veriquill.functions.columns import Problem, integral_year, json_kind, json_string, json_strings, match_option, option_form, truthy, type_message, type_problem
from veriquill.operators import evidence, lists
from veriquill.operators.sides import small_side

CATALOGUE = (
    "block string, section string, section_label string, qa boolean, pos int, variable string, label string, description string, extraction_instruction string, "
    "field_type string, options array<string>, allow_other boolean, evidence_rule string, role_name string, required boolean, canonical_reference string, soft_canonicalisation boolean"
)
CELL = "study_id string, block string, record_id string, role string, variable string, path string, value string, evidence string, notes string"


def problems(*given: tuple[Column, Column, Column, Column]) -> Column:
    """An array of (path, code, message) for those whose condition holds."""
    made = [F.when(condition, F.struct(path.alias("path"), code.alias("code"), message.alias("message"))) for condition, path, code, message in given]
    return F.array_compact(F.array(*made)).cast(Problem)


def checked(cells: DataFrame, catalogue: DataFrame) -> DataFrame:
    """cells with the field's specification, errors, and value_out: whole years as integers, options as they are spelled.

    A variable the block does not have is `unknown_field`, and nothing else is said about it.
    """
    spec = catalogue.select("block", "variable", "field_type", "options", "allow_other", "evidence_rule", "canonical_reference", F.transform("options", option_form).alias("forms"), F.lit(True).alias("known"))
    joined = cells.join(small_side(spec), ["block", "variable"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    raw, kind, text, spelled, year = F.col("value"), F.col("__kind"), F.col("__text"), F.col("__matched"), F.col("__year")
    # each step is a column of its own, so that what a value holds is found once
    joined = joined.withColumn("__kind", json_kind(raw))
    joined = joined.withColumn("__text", F.when(F.col("field_type").isin("date", "categorical"), json_string(raw, kind)))
    joined = joined.withColumn("__matched", F.when(F.col("field_type") == "categorical", match_option(text, F.col("options"), F.col("forms"))))
    joined = joined.withColumn("__year", F.when(F.col("field_type") == "year", integral_year(raw, kind)))
    code = type_problem(raw, F.col("field_type"), F.col("options"), F.col("allow_other"), kind, text, spelled, year)
    at = F.concat("path", F.lit(".value"))
    out = joined.withColumn("type_code", F.when(F.col("known"), code))
    quoted = F.regexp_extract(F.to_json(F.array(spelled)), r"(?s)^\[(.*)\]$", 1)
    value = (
        F.when(~F.col("known") | F.col("type_code").isNotNull(), raw)
        .when((F.col("field_type") == "year") & (kind == "number"), year.cast("string"))
        .when((F.col("field_type") == "categorical") & spelled.isNotNull() & (spelled != text), quoted)
        .otherwise(raw)
    )
    unknown = F.concat(F.lit("the template has no field "), "variable", F.lit(" in "), "block")
    wrong = problems((~F.col("known"), F.col("path"), F.lit("unknown_field"), unknown), (F.col("type_code").isNotNull(), at, F.col("type_code"), type_message(F.col("type_code"), raw, F.col("field_type"), F.col("options"), kind)))
    return out.withColumn("value_out", value).withColumn("errors", wrong).drop("__kind", "__text", "__matched", "__year", "forms")


def problem_rows(cells: DataFrame, *keep: str) -> DataFrame:
    """The problems of `checked` cells as rows: the kept columns, path, code, message.

    Cells without one are left out by what decides it; exploding their empty lists would have the planner make all lists
    twice, once to see whether they are empty.
    """
    wrong = cells.where("not known or type_code is not null").select(*keep, F.explode_outer("errors").alias("e"))
    return wrong.select(*keep, "e.path", "e.code", "e.message")


def referenced(cells: DataFrame, entries: DataFrame) -> DataFrame:
    """For the cells of `checked` that name a reference list and passed their type: path, study_id, errors, value_out, canonicalisations.

    Elements are resolved one by one; a second element that resolves to the same entry is `duplicate_reference`. Any error
    leaves the value and drops the canonicalisations of the field. The message of a name off the list says which are nearest.
    """
    chosen = cells.where(F.col("canonical_reference").isNotNull() & F.col("type_code").isNull() & (json_kind(F.col("value")) != "null"))
    is_list = json_kind(F.col("value")) == "array"
    tokens = chosen.withColumn("is_list", is_list).withColumn("elements", F.when(is_list, json_strings(F.col("value"))).otherwise(F.array(json_string(F.col("value")))))
    tokens = tokens.select("study_id", "path", "value", "is_list", F.col("canonical_reference").alias("list"), F.posexplode_outer("elements").alias("at", "token"))
    index = lists.reference_index(entries)
    have = entries.select("list", F.lit(True).alias("available")).distinct()
    found = lists.resolved(tokens.withColumn("form", normalise_text("token")), index).join(small_side(have), "list", "left")
    off = found.where("status = 'no_match' and available").select("list", "form").distinct()
    near = lists.suggestions(off, index).groupBy("list", "form").agg(F.array_sort(F.collect_list(F.struct("rank", "canonical"))).alias("near"))
    found = found.join(near, ["list", "form"], "left")
    first = Window.partitionBy("study_id", "path", "canonical").orderBy("at")
    twice = F.col("canonical").isNotNull() & (F.row_number().over(first) > 1)
    code = (
        F.when(F.col("available").isNull(), "reference_unavailable")
        .when(F.col("token").isNull(), F.lit(None).cast("string"))
        .when(twice, "duplicate_reference")
        .when(F.col("status") == "ambiguous", "ambiguous_reference")
        .when(F.col("status") == "empty", "empty_value")
        .when(F.col("status") == "no_match", "off_list_reference")
    )
    where = F.when(F.col("is_list") & F.col("available").isNotNull(), F.format_string("%s.value[%d]", "path", "at")).otherwise(F.concat("path", F.lit(".value")))
    said = (
        F.when(F.col("code") == "reference_unavailable", F.concat(F.lit("there is no list "), "list"))
        .when(F.col("code") == "duplicate_reference", F.concat("token", F.lit(" is the same entry as an element before it: "), "canonical"))
        .when(F.col("code") == "ambiguous_reference", F.concat("token", F.lit(" may be any of: "), F.array_join("candidates", "; ")))
        .when(F.col("code") == "empty_value", F.lit("the name is blank"))
        .when(F.col("code") == "off_list_reference", F.concat("token", F.lit(" is not in the list "), "list", F.coalesce(F.concat(F.lit("; nearest: "), F.array_join(F.transform("near", lambda x: x["canonical"]), "; ")), F.lit(""))))
    )
    found = found.withColumn("code", code).withColumn("message", said)
    rows = F.array_sort(F.collect_list(F.struct("at", "token", "canonical", "status", "code", "message", where.alias("where"))))
    grouped = found.groupBy("study_id", "path").agg(F.first("value").alias("value"), F.first("is_list").alias("is_list"), rows.alias("rows"))
    bad = F.filter("rows", lambda r: r["code"].isNotNull())
    names = F.transform(F.filter("rows", lambda r: r["canonical"].isNotNull()), lambda r: r["canonical"])
    stored = F.when(F.col("is_list"), F.to_json(names)).otherwise(F.regexp_extract(F.to_json(names), r"(?s)^\[(.*)\]$", 1))
    errors = F.array_distinct(F.transform(bad, lambda r: F.struct(r["where"].alias("path"), r["code"].alias("code"), r["message"].alias("message"))))
    events = F.transform(F.filter("rows", lambda r: r["status"] == "alias"), lambda r: F.struct(F.col("path"), r["token"].alias("entered"), r["canonical"].alias("stored")))
    return grouped.select(
        "study_id",
        "path",
        errors.alias("errors"),
        F.when(F.size(bad) > 0, F.col("value")).otherwise(stored).alias("value_out"),
        F.when(F.size(bad) > 0, F.slice(events, 1, 0)).otherwise(events).alias("canonicalisations"),
    )


def gate_warnings(cells: DataFrame, gates: DataFrame) -> DataFrame:
    """(study_id, record_id, field, when_field, path, code, message): gated fields set while their controller has no allowed value.

    gates: when_field, field, allowed. One pass: each cell meets the gates that name it, and a group by record
    brings controller and gated value together, so nothing is joined to itself.
    """
    named = gates.select(F.col("when_field").alias("variable"), F.lit("when").alias("part"), "when_field", "field", "allowed").unionByName(
        gates.select(F.col("field").alias("variable"), F.lit("field").alias("part"), "when_field", "field", "allowed")
    )
    met = cells.where("block = 'record'").join(small_side(named), "variable")
    both = met.groupBy("study_id", "record_id", "when_field", "field", "allowed").agg(
        F.max(F.when(F.col("part") == "when", json_string(F.col("value")))).alias("controller"), F.max(F.when(F.col("part") == "field", F.col("value"))).alias("gated")
    )
    outside = ~F.exists("allowed", lambda a: option_form(a) == option_form(F.col("controller")))
    return both.where(F.col("controller").isNotNull() & F.coalesce(truthy(F.col("gated")), F.lit(False)) & outside).select(
        "study_id", "record_id", "field", "when_field", F.concat(F.lit("record."), "record_id", F.lit("."), "field").alias("path"), F.lit("category_gate").alias("code"),
        F.concat("field", F.lit(" is for "), "when_field", F.lit(" of "), F.array_join("allowed", "; "), F.lit(", not of "), "controller").alias("message"),
    )


def missing_required(cells: DataFrame, catalogue: DataFrame, studies: DataFrame) -> DataFrame:
    """(study_id, path): required fields of the study, and of each record it has, without a value."""
    required = catalogue.where("required and block in ('study', 'record')").select("block", "variable")
    have = cells.where(json_kind(F.col("value")) != "null").select("study_id", "block", F.coalesce("record_id", F.lit("")).alias("record_id"), "variable").distinct()
    owners = studies.select("study_id", F.lit("study").alias("block"), F.lit("").alias("record_id")).unionByName(
        cells.where("block = 'record'").select("study_id", "block", F.coalesce("record_id", F.lit("")).alias("record_id")).distinct()
    )
    lacking = owners.join(small_side(required), "block").join(have, ["study_id", "block", "record_id", "variable"], "left_anti")
    return lacking.select("study_id", F.when(F.col("block") == "study", F.concat(F.lit("study."), "variable")).otherwise(F.concat(F.lit("record."), "record_id", F.lit("."), "variable")).alias("path"))


def filled_counts(cells: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(study_id, block, record_id, filled, total): how many fields of each block or record have a value."""
    totals = catalogue.groupBy("block").agg(F.count("*").alias("total"))
    filled = cells.groupBy("study_id", "block", "record_id").agg(F.count_if(json_kind(F.col("value")) != "null").alias("filled"))
    return filled.join(small_side(totals), "block", "left").select("study_id", "block", "record_id", "filled", "total")


def envelopes(cells: DataFrame, catalogue: DataFrame, entries: DataFrame, papers: DataFrame, labels: DataFrame, required: bool = True) -> DataFrame:
    """One row a cell: study_id, path, value_out, errors, canonicalisations, weak_matches.

    The value goes through its type, its options, its reference list and its evidence, in that order; a value of the wrong
    type is not looked up in a list, but its evidence is checked. value_out is what is stored: the value itself where
    anything is wrong with it. errors: (path, code, message) in order of these steps; canonicalisations: (path, entered,
    stored); weak_matches: (path, quote, tier) of quotes that stand in the text only with case folded.
    """
    typed = checked(cells, catalogue)
    listed = referenced(typed, entries).select("study_id", "path", F.col("errors").alias("list_errors"), F.col("value_out").alias("listed"), "canonicalisations")
    both = typed.join(listed, ["study_id", "path"], "left")
    owners = both.where("known and block in ('study', 'record')").withColumn("value_out", F.coalesce("listed", "value_out")).select(*typed.columns)
    said = evidence.judged(owners, papers, labels, required)
    wrong = F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("path", "code", "message"))))
    weak = F.array_sort(F.collect_list(F.when(F.col("code").isNull(), F.struct("path", "quote", "tier"))))
    told = said.groupBy("study_id", F.col("cell").alias("path")).agg(wrong.alias("evidence_errors"), weak.alias("weak_matches"))
    out = both.join(told, ["study_id", "path"], "left")
    none = lambda kind: F.array().cast(kind)
    return out.select(
        "study_id",
        "path",
        F.coalesce("listed", "value_out").alias("value_out"),
        F.concat("errors", F.coalesce("list_errors", none(Problem)), F.coalesce("evidence_errors", none(Problem))).alias("errors"),
        F.coalesce("canonicalisations", none("array<struct<path:string,entered:string,stored:string>>")).alias("canonicalisations"),
        F.coalesce("weak_matches", none("array<struct<path:string,quote:string,tier:string>>")).alias("weak_matches"),
    )
