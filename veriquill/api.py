"""The library's entry points: load what a review is made of, validate one value or whole outputs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriquill.functions.columns import STATES, TERMINAL, VALIDATED
from veriquill.operators import evidence, lists, values
from veriquill.operators.sweep import sweep
from veriquill.sources import config, files

VERSION = "0.1.0"

__all__ = ["STATES", "TERMINAL", "VALIDATED", "VERSION", "ConfigBundle", "ValidationResult", "load_bundles", "load_config_bundle", "validate_extraction_output", "validate_value"]


@dataclass(frozen=True)
class ConfigBundle:
    """A configuration: its template, its reference lists with their labels, its settings, and its prompts with their partials."""

    template: config.Template
    lists: dict[str, list]
    labels: dict[str, str]
    settings: dict
    prompts: dict[str, str] = field(default_factory=dict)
    partials: dict[str, str] = field(default_factory=dict)

    def switches(self) -> dict[str, bool]:
        """What conditional parts of prompts depend on."""
        checks = self.settings.get("max_checks_per_field", 2) != 0
        review = bool(self.settings.get("final_review", True))
        return {"checker": checks, "review": review, "check_reviewer_edits": checks and review and bool(self.settings.get("check_reviewer_edits", False))}

    def composed(self) -> dict[str, str]:
        """The prompts with their partials in place."""
        from veriquill.functions import render

        return {name: render.with_partials(text, self.partials, self.switches()) for name, text in self.prompts.items()}


def load_config_bundle(folder: str) -> ConfigBundle:
    """Read and cross-check a configuration; ConfigError names everything that is wrong with its settings, lists and prompts.

    A configuration without a folder of prompts is one for validation only.
    """
    root = Path(folder)
    template = config.load_template(str(root / "extraction_template.yaml"))
    found, labels = config.read_lists(str(root / "reference"))
    settings = config.strict_yaml((root / "pipeline.yaml").read_text(encoding="utf-8")) or {}
    if not isinstance(settings, dict):
        raise config.ConfigError("pipeline.yaml must be settings by name")
    wrong = config.unknown_settings(settings) + config.setting_problems(settings) + (config.rate_problems(settings["rates"]) if "rates" in settings else [])
    cited = {f["canonical_reference"] for s in template.sections for f in s.fields if f["canonical_reference"]}
    wrong += [f"no reference list {name}" for name in sorted(cited - found.keys())]
    prompts, partials = config.read_prompts(str(root / "prompts"))
    if (root / "prompts").is_dir():
        wrong += config.prompt_problems(prompts, partials, found)
    if wrong:
        raise config.ConfigError("; ".join(wrong))
    return ConfigBundle(template, found, labels, settings, prompts, partials)


def load_bundles(spark: SparkSession, root: str) -> DataFrame:
    """The paper bundles under a folder; any that cannot be read is an error."""
    papers = files.papers(spark, root)
    if bad := files.bundle_problems(papers).limit(20).collect():
        raise ValueError(f"bundles that cannot be read: {[tuple(r) for r in bad]}")
    return papers


@dataclass
class ValidationResult:
    ok: bool
    value: object
    errors: list[dict] = field(default_factory=list)
    warnings: list[dict] = field(default_factory=list)
    canonicalisations: list[dict] = field(default_factory=list)


def validate_value(
    spark: SparkSession, spec: dict, value, reference_lists: dict[str, list] | None = None, producer: str = "human", *, evidence_text: str | None = None, paper_text: str | None = None, image_labels: list[str] | None = None, path: str = "value",
    sibling_values: dict | None = None, gates: list[tuple[str, str, list[str]]] | None = None,
) -> ValidationResult:
    """One value of one field: the plan of the whole sweep over a single cell.

    spec: variable, field_type, and whatever else a field has. A person's value never owes evidence, which is looked up only
    if the text is given; a model's always is, as far as that needs no text.
    """
    if producer not in ("human", "llm"):
        raise ValueError(f"unknown producer {producer!r}")
    f = {"options": None, "allow_other": False, "evidence": "required", "canonical_reference": None} | spec
    row = ("record", None, None, False, 0, f["variable"], f["variable"], None, None, f["field_type"], f["options"], bool(f["allow_other"]), f["evidence"], None, False, f["canonical_reference"], False)
    catalogue = spark.createDataFrame([row], values.CATALOGUE)
    cell = spark.createDataFrame([("s", "record", "r", None, f["variable"], path, json.dumps(value, ensure_ascii=False), evidence_text, None)], values.CELL)
    checked = values.checked(cell, catalogue).cache()
    first = checked.collect()[0]
    errors = [e.asDict() for e in first.errors]
    stored, events = first.value_out, []
    if f["canonical_reference"] and not errors and value is not None:
        entries = config.reference_entries(spark, reference_lists or {}) if reference_lists else spark.createDataFrame([], lists.ENTRY)
        for r in values.referenced(checked, entries).collect():
            errors += [e.asDict() for e in r.errors]
            stored, events = r.value_out, [c.asDict() for c in r.canonicalisations]
    if producer == "llm" or paper_text is not None:
        papers = spark.createDataFrame([("s", paper_text)] if paper_text is not None else [], "study_id string, text string")
        labels = spark.createDataFrame([("s", x) for x in image_labels or []], "study_id string, label string")
        found = evidence.evidence_problems(checked.withColumn("value_out", F.lit(stored)), papers, labels, required=producer == "llm").collect()
        errors += [{"path": r.path, "code": r.code, "message": r.message} for r in found if paper_text is not None or r.code not in ("quote_not_in_text", "unknown_image_label")]
    checked.unpersist()
    warnings = []
    if sibling_values is not None and gates:
        plain = lambda v: v.get("value") if isinstance(v, dict) else v
        cells = [("s", "record", "r", None, k, k, json.dumps(plain(v)), None, None) for k, v in sibling_values.items()]
        rules = spark.createDataFrame(gates, "when_field string, field string, allowed array<string>")
        warnings = [{"path": r.field, "code": r.code, "message": r.message} for r in values.gate_warnings(spark.createDataFrame(cells, values.CELL), rules).where(F.col("field") == f["variable"]).collect()]
    return ValidationResult(not errors, json.loads(stored) if stored is not None else None, errors, warnings, events)


def validate_extraction_output(outputs: DataFrame, bundle: ConfigBundle, papers: DataFrame | None = None, labels: DataFrame | None = None, producer: str = "llm") -> DataFrame:
    """(study_id, path, code, message, severity) for stored outputs (study_id, output JSON) of any number of studies."""
    spark = outputs.sparkSession
    entries = config.reference_entries(spark, bundle.lists) if bundle.lists else spark.createDataFrame([], lists.ENTRY)
    found = sweep(files.cells_of(outputs), bundle.template.catalogue(spark), entries, bundle.template.gate_rows(spark), papers, labels, producer)
    shape = files.structure_problems(outputs)
    # evidence that is no text is one problem, not two
    owed = F.col("code") == "evidence_required"
    found = found.where(~owed).unionByName(found.where(owed).join(shape.select("study_id", "path"), ["study_id", "path"], "left_anti"))
    return found.unionByName(shape.withColumn("severity", F.lit("error")))
