"""Scalar functions as DataFrame columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it.
BLANKS = r"(?U)\s+"
#: The years a year field accepts, and the shape (no more) of a date.
YEARS = (1800, 2100)
DATE = r"^\d{4}-\d{2}-\d{2}\n?$"
Problem = "array<struct<path:string,code:string,message:string>>"
#: Fixed value: how much of a quote is shown.
SHOWN = 120


def option_form(value: Column) -> Column:
    """Case and blanks folded, nothing else: what options are compared in."""
    return F.lower(F.trim(F.regexp_replace(value, BLANKS, " ")))


def match_option(value: Column, options: Column, forms: Column | None = None) -> Column:
    """The option itself if there; else the only one with the same form; else null. forms: those of the options, if at hand."""
    forms = forms if forms is not None else F.transform(options, option_form)
    hits = F.filter(forms, lambda f: f == option_form(value))
    return F.when(F.array_contains(options, value), value).when(F.size(hits) == 1, F.get(options, (F.array_position(forms, F.get(hits, F.lit(0))) - 1).cast("int")))


def json_kind(raw: Column) -> Column:
    """What a JSON text holds: null, boolean, integer, number, string, array or object. Literals are told apart as written."""
    t = F.trim(raw)
    return (  # the cheap questions first
        F.when(t.isNull() | (t == "null"), "null")
        .when(t.startswith('"'), "string")
        .when(t.startswith("["), "array")
        .when(t.startswith("{"), "object")
        .when(t.isin("true", "false"), "boolean")
        .when(t.rlike(r"^-?\d+$"), "integer")
        .when(t.rlike(r"^-?\d"), "number")
        .otherwise("object")
    )


def json_string(raw: Column, kind: Column | None = None) -> Column:
    """The string that a JSON text holds; null for anything else."""
    t = F.trim(raw)
    bare = F.substring(t, F.lit(2), F.length(t) - 2)
    return F.when((kind if kind is not None else json_kind(raw)) == "string", F.when(~F.contains(t, F.lit("\\")), bare).otherwise(F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]))


def json_strings(raw: Column, kind: Column | None = None) -> Column:
    """The strings of a JSON array of nothing but strings; null for anything else."""
    held = F.schema_of_variant(F.try_parse_json(raw))
    values = F.from_json(raw, "array<string>")
    fine = (held == "ARRAY<STRING>") & ~F.exists(values, lambda v: v.isNull()) | (held == "ARRAY<VOID>") & (F.size(values) == 0)
    return F.when(((kind if kind is not None else json_kind(raw)) == "array") & fine, values)


def integral_year(raw: Column, kind: Column | None = None) -> Column:
    """A JSON number as a year if it is whole; null otherwise."""
    number = F.when((kind if kind is not None else json_kind(raw)).isin("integer", "number"), raw.cast("double"))
    return F.when(number == F.floor(number), F.when(F.abs(number) < 2.0**62, number.cast("long")).otherwise(F.signum(number).cast("long") * (1 << 62)))


def type_problem(raw: Column, field_type: Column, options: Column, allow_other: Column, kind: Column | None = None, text: Column | None = None, matched: Column | None = None, year: Column | None = None) -> Column:
    """The code of what is wrong with a value of a field type; null if nothing is. Null passes for all types but boolean.

    kind, text, matched and year are json_kind, json_string, the matched option and integral_year, where a plan has them as columns.
    """
    kind = kind if kind is not None else json_kind(raw)
    text = text if text is not None else json_string(raw, kind)
    matched = matched if matched is not None else match_option(text, F.coalesce(options, F.array().cast("array<string>")))
    year, mismatch = year if year is not None else integral_year(raw, kind), F.lit("type_mismatch")
    return (
        F.when(kind == "null", F.when(field_type == "boolean", mismatch))
        .when(field_type == "boolean", F.when(kind != "boolean", mismatch))
        .when(field_type == "integer", F.when(kind != "integer", mismatch))
        .when(field_type == "number", F.when(~kind.isin("integer", "number"), mismatch))
        .when(field_type == "year", F.when(year.isNull(), mismatch).when(~year.between(*YEARS), "year_out_of_range"))
        .when(field_type == "date", F.when(kind != "string", mismatch).when(~text.rlike(DATE), "date_format"))
        .when(field_type == "string_list", F.when(json_strings(raw, kind).isNull(), mismatch))
        .when((field_type == "categorical") & F.coalesce(allow_other, F.lit(False)), F.when(kind != "string", mismatch).when(F.trim(F.regexp_replace(text, BLANKS, " ")) == "", "empty_value"))
        .when(field_type == "categorical", F.when(kind != "string", mismatch).when(matched.isNull(), "invalid_option"))
        .otherwise(F.when(kind != "string", mismatch))
    )


def type_message(code: Column, raw: Column, field_type: Column, options: Column, kind: Column) -> Column:
    """What a code of `type_problem` says of a value, for people."""
    return (
        F.when(code == "type_mismatch", F.concat(F.lit("expected "), field_type, F.lit(", found "), kind))
        .when(code == "year_out_of_range", F.concat(raw, F.lit(f" is no year from {YEARS[0]} to {YEARS[1]}")))
        .when(code == "date_format", F.concat(raw, F.lit(" is not written as YYYY-MM-DD")))
        .when(code == "empty_value", F.lit("the value is blank"))
        .when(code == "invalid_option", F.concat(raw, F.lit(" is none of: "), F.array_join(options, "; ")))
    )


def shortened(quote: Column) -> Column:
    """A quote as it is shown: its beginning, and dots if there is more."""
    return F.when(F.length(quote) > SHOWN, F.concat(F.substring(quote, 1, SHOWN), F.lit("..."))).otherwise(quote)


def truthy(raw: Column) -> Column:
    """Whether a JSON value counts as set: not null, false, zero, or empty."""
    kind = json_kind(raw)
    empty = (F.trim(raw) == '""') | (kind != "string") & F.regexp_replace(raw, r"\s", "").isin("[]", "{}")
    return ~((kind == "null") | (raw == "false") | F.when(kind.isin("integer", "number"), raw.cast("double") == 0).otherwise(False) | empty)


def same_json(a: Column, b: Column) -> Column:
    """Equality of scalar JSON values with numbers and booleans compared by value, as 1, 1.0 and true are equal."""

    def number(x: Column) -> Column:
        t = F.trim(x)
        return F.when(t == "true", F.lit(1.0)).when(t == "false", F.lit(0.0)).when(json_kind(t).isin("integer", "number"), t.cast("double"))

    x, y = F.coalesce(F.trim(a), F.lit("null")), F.coalesce(F.trim(b), F.lit("null"))
    return F.coalesce(number(x) == number(y), (x == y) | F.coalesce(json_string(x) == json_string(y), F.lit(False)))


def tag_texts(evidence: Column, tag: str) -> Column:
    return F.regexp_extract_all(evidence, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))


def tags_flat(evidence: Column) -> Column:
    """Whether quote and image tags pair up side by side: an automaton over the tags in order."""
    tags = F.regexp_extract_all(evidence, F.lit("(</?(?:q|img)>)"), F.lit(1))

    def step(state: Column, tag: Column) -> Column:
        kind, closes = F.when(tag.contains("img"), "img").otherwise("q"), tag.startswith("</")
        return F.when(state == "bad", "bad").when(~closes & (state == ""), kind).when(closes & (state == kind), "").otherwise("bad")

    return F.coalesce(F.aggregate(tags, F.lit(""), step) == "", F.lit(True))


def prose(evidence: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(evidence, r"(?s)<q>.*?</q>", ""), r"(?s)<img>.*?</img>", ""))


def label_from_name(name: Column) -> Column:
    """A display label: underscores to blanks, the first letter upper."""
    spaced = F.regexp_replace(name, "_", " ")
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 30))


def status_of(applied: Column, failed: Column) -> Column:
    return F.when(failed == 0, "ok").when(applied > 0, "partial").otherwise("validation_failed")


# The run states, and those that end a run or count as a result.
STATES = ("in_progress", "complete", "failed_validation", "error")
TERMINAL, VALIDATED = ("complete", "failed_validation", "error"), ("complete",)


def event_name(status: Column) -> Column:
    """The log's name for a tool call of that status; an unknown status fails."""
    known = F.when(status == "ok", "tool_call_applied").when(status == "partial", "tool_call_partial").when(status == "validation_failed", "tool_call_failed")
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown status "), F.coalesce(status, F.lit("null")))).cast("string"))


# What a reader is told of an event in a run's log.
SENTENCES = {
    "session_started": "The run began.",
    "resumed": "The run was taken up again.",
    "terminate": "The run ended.",
    "extractor_reprompt": "The extractor was asked again.",
    "review_reprompt": "The reviewer was asked again.",
    "text_only_stall": "The extractor only wrote and called no tool, so extraction ended.",
    "review_text_only_stall": "The reviewer only wrote and called no tool, so the review ended.",
    "repeated_failure_stall": "The extractor repeated one failing call, so extraction ended.",
    "review_repeated_failure_stall": "The reviewer repeated one failing call, so the review ended.",
    "extractor_abandoned": "The extractor gave the study up.",
    "review_abandoned": "The reviewer gave the study up.",
    "extractor_refused": "The extractor's model refused.",
    "extractor_paused": "Extraction was paused.",
    "review_cap_hit": "The reviewer used all its calls.",
    "review_error": "The review failed.",
    "provider_retry": "A call was tried again.",
    "provider_account_refused": "The provider refused the account.",
    "review_provider_account_refused": "The provider refused the account in the review.",
    "final_review_no_response": "The reviewer did not answer.",
    "final_review_edits_none_applied": "None of the reviewer's changes could be applied.",
    "summary_mismatch_advisory": "The summary found does not look like the one given.",
    "value_canonicalised": "A value was replaced by the list's own spelling.",
    "torn_line_dropped": "A last line that was cut off was left out.",
    "error": "The run failed.",
}
