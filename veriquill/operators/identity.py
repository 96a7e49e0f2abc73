"""Fingerprints: SHA-256 over texts whose parts and order are fixed. Each is prefixed with what it identifies."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriquill.functions.arrow import canonical, canonical_json

#: What stands for a stage that does not run.
NO_LAYER = "nolayer"
ABSENT = "none"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fingerprint(kind: str, *parts: Column) -> Column:
    """kind:SHA-256 of the parts joined by bars; a null part makes it null, as nothing may stand for it unasked."""
    text = parts[0].cast("string")
    for p in parts[1:]:
        text = F.concat(text, F.lit("|"), p.cast("string"))
    return F.concat(F.lit(f"{kind}:"), sha(text))


def structure(checks: Column, final_review: Column, images: Column | None, check_reviewer: Column) -> Column:
    """The stage toggles in short; without images given, the part that a user writes."""
    out = F.concat(F.lit("checks"), checks.cast("string"), F.when(~final_review, "_noreview").otherwise(""), F.when(check_reviewer, "_checkreview").otherwise(""))
    return out if images is None else F.concat(out, F.when(~images, "_noimages").otherwise(""))


def config_fp(call: Column, prompts: Column, template: Column, tools: Column, structure: Column, references: Column) -> Column:
    return fingerprint("config_fp", call, prompts, template, tools, structure, references)


def checker_fp(call: Column, system: Column, user: Column, tools: Column, structure: Column, catalogue: Column, references: Column, context_fields: Column, context_chars: Column) -> Column:
    return fingerprint("checker_fp", call, sha(system), sha(user), tools, structure, catalogue, references, F.to_json(context_fields), F.concat(F.lit("ctx"), context_chars.cast("string")))


def review_fp(call: Column, system: Column, tools: Column, structure: Column, references: Column) -> Column:
    return fingerprint("review_fp", call, sha(system), tools, structure, references)


def instrument_fp(prompts: Column, template: Column, tools: Column, structure: Column, references: Column, context_chars: Column, context_fields: Column) -> Column:
    return fingerprint("instrument_fp", prompts, template, tools, structure, references, F.concat(F.lit("ctx"), F.coalesce(context_chars.cast("string"), F.lit(ABSENT))), F.to_json(context_fields))


def run_fp(config: Column, checker: Column, review: Column, engine: Column) -> Column:
    return fingerprint("run_fp", config, F.coalesce(checker, F.lit(ABSENT)), F.coalesce(review, F.lit(ABSENT)), engine)


def call_fp(call: Column) -> Column:
    return fingerprint("call_fp", call)


def engine_fp(version: Column, source: Column, layer_version: Column, layer_source: Column) -> Column:
    """This engine's version and the hash of its sources, and those of the layer that calls models, if there is one."""
    return fingerprint("engine_fp", version, source, F.coalesce(layer_version, F.lit(NO_LAYER)), F.coalesce(layer_source, F.lit(NO_LAYER)))


CATALOGUE_KEYS = ("variable", "description", "extraction_instruction", "field_type", "allow_other", "options", "canonical_reference", "required")


def catalogue_hash(catalogue: DataFrame) -> DataFrame:
    """One row with `hash`: of all fields in order of block and position, with what changes how a field is asked or judged."""
    rank = F.expr("array_position(array('study', 'record', 'initial_check', 'quality_check'), block)")
    row = F.struct(F.concat("block", F.lit("_fields")).alias("block"), *CATALOGUE_KEYS, F.col("evidence_rule").alias("evidence"), F.col("role_name").alias("role"))
    rows = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "pos", F.to_json(row, {"ignoreNullFields": "false"}).alias("row"))))
    joined = catalogue.agg(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["row"]), ","), F.lit("]")).alias("json"))
    return joined.select(sha(canonical_json("json")).alias("hash"))


def reference_hash(entries: DataFrame) -> DataFrame:
    """One row with `hash`: of the lists' names and aliases, in the order that each list and entry has them."""
    row = F.struct(F.col("canonical").alias("name"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    lists = entries.groupBy("list").agg(F.array_sort(F.collect_list(F.struct("pos", row.alias("row")))).alias("rows"))
    lists = lists.select("list", F.transform("rows", lambda r: r["row"]).alias("rows"))
    joined = lists.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("list", "rows"))))).alias("json"))
    return joined.select(sha(canonical_json("json")).alias("hash"))


def bundle_fps(texts: DataFrame, figures: DataFrame, manifests: DataFrame) -> DataFrame:
    """(study_id, text_fp, figures_fp, manifest_fp, bundle_fp) from texts (content binary), figures (label, content) and manifests (raw)."""
    shots = figures.groupBy("study_id").agg(F.array_sort(F.collect_list(F.array(F.col("label"), F.sha2("content", 256)))).alias("pairs"))
    both = texts.join(shots, "study_id", "left").join(manifests, "study_id")
    pairs = F.when(F.col("pairs").isNull(), F.lit(ABSENT)).otherwise(canonical_json(F.to_json("pairs")))
    named = both.select(
        "study_id",
        F.concat(F.lit("text_fp:"), F.sha2("content", 256)).alias("text_fp"),
        F.concat(F.lit("figures_fp:"), sha(pairs)).alias("figures_fp"),
        F.concat(F.lit("manifest_fp:"), sha(canonical_json("raw"))).alias("manifest_fp"),
    )
    return named.withColumn("bundle_fp", fingerprint("bundle_fp", F.col("text_fp"), F.col("figures_fp"), F.col("manifest_fp")))


def drift(recorded: DataFrame, now: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """(key, drifted): the axes on which a run that is taken up again differs from what it recorded."""
    both = recorded.select(key, *[F.col(a).alias(f"old_{a}") for a in axes]).join(now.select(key, *axes), key)
    return both.select(key, F.array_compact(F.array(*[F.when(~F.col(f"old_{a}").eqNullSafe(F.col(a)), a) for a in axes])).alias("drifted"))


def content_instrument_fp(prompts: Mapping[str, str], template: str, tools: list[dict], references: str, settings: Mapping, context_fields: list[str], default_chars: int = 300, default_checks: int = 2) -> str:
    """The identity of all that a configuration says, without models: as `instrument_fp`, from prompts, hashes and settings.

    Absent settings have the defaults of a run; a checker that is off has no context, whatever its width is set to.
    """
    checks = int(settings.get("max_checks_per_field", default_checks))
    chars = settings.get("checker_context_chars")
    width = ABSENT if checks == 0 else str(default_chars if chars is None else chars)
    shape = f"checks{checks}{'' if settings.get('final_review', True) else '_noreview'}{'_checkreview' if settings.get('check_reviewer_edits', False) else ''}"
    parts = [texts_hash(prompts), template, tool_set_hash(tools), shape, references, f"ctx{width}", canonical(list(context_fields))]
    return "instrument_fp:" + hashlib.sha256("|".join(parts).encode()).hexdigest()


def tool_set_hash(tools: list[dict]) -> str:
    """Of a tool catalogue as it is sent, in its order."""
    return hashlib.sha256(canonical(tools).encode()).hexdigest()


def texts_hash(texts: Mapping[str, str]) -> str:
    """Of named texts, such as prompts, whatever order they come in."""
    return hashlib.sha256(canonical(dict(texts)).encode()).hexdigest()


def tree_hash(sources: DataFrame) -> DataFrame:
    """One row with `hash`: of source files (path, content binary) in order of path, each as its path, a zero byte and its bytes.

    For the files of a program; all of them meet in one row.
    """
    rows = F.array_sort(F.collect_list(F.struct("path", F.hex(F.concat(F.col("path").cast("binary"), F.unhex(F.lit("00")), F.col("content"))).alias("h"))))
    return sources.agg(F.sha2(F.unhex(F.array_join(F.transform(rows, lambda r: r["h"]), "")), 256).alias("hash"))
