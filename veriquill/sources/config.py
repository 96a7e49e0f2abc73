"""Configuration read on the driver: templates, reference lists and settings in YAML, every key known, no key twice."""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from veriquill.operators.lists import ENTRY
from veriquill.operators.values import CATALOGUE


class ConfigError(ValueError):
    """What is wrong with a configuration, and where."""


def strict_yaml(text: str):
    """YAML without repeated keys."""
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("reading YAML needs a YAML library") from e

    class Loader(yaml.SafeLoader):
        def construct_mapping(self, node, deep=False):
            seen = set()
            for k, _ in node.value:
                if k.tag == "tag:yaml.org,2002:merge":  # merged mappings may be several, and their keys give way
                    continue
                key = self.construct_object(k, deep=True)
                if key in seen:
                    raise ConfigError(f"key {key!r} is there twice (line {k.start_mark.line + 1})")
                seen.add(key)
            return super().construct_mapping(node, deep)

    return yaml.load(text, Loader)  # noqa: S506  a safe loader


# Field types, and the keys of each level of a template.
TYPES = ("string", "integer", "number", "boolean", "year", "date", "string_list")
FIELD_KEYS = {"variable", "label", "description", "extraction_instruction", "type", "options", "allow_other", "evidence", "role", "required", "canonical_reference", "soft_canonicalisation"}
SECTION_KEYS = {"section", "label", "qa", "extraction_instruction", "fields"}
RECORD_KEYS = {"plural", "description", "extraction_instruction", "extraction", "checker_context_fields"}
GATE_KEYS = {"when_field", "field", "allowed_values"}
BLOCKS = {"study_extraction": "study", "llm_initial_check": "initial_check", "llm_quality_check": "quality_check"}
SLUG = re.compile(r"[a-z][a-z0-9_]*")


@dataclass
class Section:
    block: str
    label: str
    qa: bool
    instruction: str | None
    fields: list[dict] = field(default_factory=list)


@dataclass
class Template:
    """A parsed template: what a record is, its sections in order, and the rules between fields."""

    entity: str
    plural: str
    description: str
    instruction: str | None
    context_fields: list[str]
    sections: list[Section]
    gates: list[tuple[str, str, list[str]]]

    def fields(self, block: str) -> list[dict]:
        return [f for s in self.sections if s.block == block for f in s.fields]

    def catalogue(self, spark: SparkSession) -> DataFrame:
        """All fields as one table, in order."""
        rows = []
        for block in ("study", "record", "initial_check", "quality_check"):
            fields = [(s, f) for s in self.sections if s.block == block for f in s.fields]
            rows += [
                (block, s.label, s.label, s.qa, pos, f["variable"], f["label"], f["description"], f["extraction_instruction"], f["field_type"], f["options"], f["allow_other"], f["evidence"], f["role"], f["required"], f["canonical_reference"], f["soft_canonicalisation"])
                for pos, (s, f) in enumerate(fields)
            ]
        return spark.createDataFrame(rows, CATALOGUE)

    def gate_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.gates, "when_field string, field string, allowed array<string>")

    def specimen(self) -> str | None:
        """The path of the field that a sample check is shown for: the first that owes evidence, else the first that may have any."""
        paths = [(f["evidence"], f"study.{f['variable']}") for f in self.fields("study")] + [(f["evidence"], f"record.{self.entity}_1.{f['variable']}") for f in self.fields("record")]
        return next((p for e, p in paths if e == "required"), next((p for e, p in paths if e), None))


def known_keys(found: Mapping, allowed: set, where: str) -> None:
    if not isinstance(found, Mapping):
        raise ConfigError(f"{where}: not a mapping")
    if extra := sorted(found.keys() - allowed):
        raise ConfigError(f"{where}: unknown keys {extra}")


def label_of(name: str) -> str:
    spaced = name.replace("_", " ")
    return spaced[:1].upper() + spaced[1:]


def parse_field(block: str, raw: Mapping) -> dict:
    """One field with every key; ConfigError for one that cannot be."""
    known_keys(raw, FIELD_KEYS, block)
    name = raw.get("variable")
    where = f"{block}.{name}"
    if not name or name == "notes":
        raise ConfigError(f"{block}: a field needs a variable that is not `notes`")
    options = raw.get("options")
    if ("type" in raw) == (options is not None):
        raise ConfigError(f"{where}: either type or options")
    if options is not None and any(str(o).strip().lower() == "other" for o in options):
        raise ConfigError(f"{where}: use allow_other in place of an option Other")
    if raw.get("allow_other") and options is None:
        raise ConfigError(f"{where}: allow_other needs options")
    kind = "categorical" if options is not None else raw["type"]
    if kind not in (*TYPES, "categorical"):
        raise ConfigError(f"{where}: unknown type {kind!r}")
    rule = raw.get("evidence")
    if (rule is not None) if block.endswith("check") else (rule not in ("required", "optional")):
        raise ConfigError(f"{where}: evidence is required or optional, and has no place in a check")
    listed = raw.get("canonical_reference")
    if listed and (kind not in ("string", "string_list") or raw.get("soft_canonicalisation")):
        raise ConfigError(f"{where}: a reference list goes with strings, and not with soft_canonicalisation")
    role = raw.get("role")
    if role is not None and (role != "summary" or block != "study" or kind != "string" or listed):
        raise ConfigError(f"{where}: the one role is summary, of a plain string of the study")
    return {
        "variable": name, "label": raw.get("label") or label_of(name), "description": raw.get("description"), "extraction_instruction": raw.get("extraction_instruction"), "field_type": kind,
        "options": [str(o) for o in options] if options is not None else None, "allow_other": bool(raw.get("allow_other")), "evidence": rule, "role": role, "required": bool(raw.get("required")),
        "canonical_reference": listed, "soft_canonicalisation": bool(raw.get("soft_canonicalisation")),
    }


def parse_sections(block: str, raw: list) -> list[Section]:
    out = []
    for section in raw or []:
        known_keys(section, SECTION_KEYS, f"{block}: a section")
        fields = [parse_field(block, f) for f in section.get("fields") or []]
        out.append(Section(block, section.get("label") or section.get("section"), bool(section.get("qa")), section.get("extraction_instruction"), fields))
    names = [f["variable"] for s in out for f in s.fields]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ConfigError(f"{block}: variables {twice} are there twice")
    return out


def parse_template(raw: Mapping) -> Template:
    known_keys(raw, {*BLOCKS, "records", "gates"}, "template")
    if lacking := sorted({*BLOCKS, "records"} - raw.keys()):
        raise ConfigError(f"template: keys {lacking} are missing")
    if not isinstance(raw["records"], Mapping) or len(raw["records"]) != 1:
        raise ConfigError("template: there is exactly one kind of record")
    ((entity, record),) = raw["records"].items()
    known_keys(record, RECORD_KEYS, f"records.{entity}")
    if not SLUG.fullmatch(str(entity)) or entity == "study":
        raise ConfigError(f"records: {entity!r} cannot name a record")
    sections = parse_sections("study", raw["study_extraction"]) + parse_sections("record", record.get("extraction"))
    for key in ("llm_initial_check", "llm_quality_check"):
        sections += parse_sections(BLOCKS[key], raw[key])
    template = Template(entity, record.get("plural") or f"{entity}s", record.get("description") or "", record.get("extraction_instruction"), list(record.get("checker_context_fields") or []), sections, [])
    own = {f["variable"]: f for f in template.fields("record")}
    if lost := [c for c in template.context_fields if c not in own]:
        raise ConfigError(f"records.{entity}: context fields {lost} are no fields")
    if sum(f["role"] == "summary" for f in template.fields("study")) > 1:
        raise ConfigError("role summary is there twice")
    for gate in raw.get("gates") or []:
        known_keys(gate, GATE_KEYS, "gates")
        paths = [str(gate.get(k)).split(".") for k in ("when_field", "field")]
        if any(len(p) != 2 or p[0] != entity or p[1] not in own for p in paths):
            raise ConfigError(f"gates: {gate.get('when_field')} and {gate.get('field')} must both be fields of {entity}")
        template.gates.append((paths[0][1], paths[1][1], [str(v) for v in gate["allowed_values"]]))
    return template


def load_template(path: str) -> Template:
    return parse_template(strict_yaml(Path(path).read_text(encoding="utf-8")))


def parse_list(raw, name: str) -> tuple[str | None, list]:
    """(label, entries) of a list file: a list, or a mapping with one list and perhaps a label."""
    if isinstance(raw, list):
        return None, raw
    if isinstance(raw, Mapping) and len(keys := [k for k, v in raw.items() if isinstance(v, list)]) == 1:
        known_keys(raw, {keys[0], "label"}, name)
        return raw.get("label"), raw[keys[0]]
    raise ConfigError(f"{name}: neither a list nor a mapping with one")


def reference_entries(spark: SparkSession, lists: dict[str, list]) -> DataFrame:
    """Lists by name, each of names or of {tool_name, search_terms, aliases}, as one table in order."""
    rows = []
    for name in sorted(lists):
        for pos, entry in enumerate(lists[name] or []):
            entry = {"tool_name": entry} if isinstance(entry, str) else entry
            known_keys(entry, {"tool_name", "search_terms", "aliases"}, name)
            rows.append((name, pos, entry["tool_name"], entry.get("search_terms"), list(entry.get("aliases") or [])))
    return spark.createDataFrame(rows, ENTRY)


def read_lists(folder: str) -> tuple[dict[str, list], dict[str, str]]:
    """Entries and labels of the YAML files of a folder, each under its file's name."""
    found = {p.stem: parse_list(strict_yaml(p.read_text(encoding="utf-8")), p.stem) for p in sorted(Path(folder).glob("*.yaml"))}
    return {k: v[1] for k, v in found.items()}, {k: v[0] for k, v in found.items() if v[0]}


def load_reference_lists(spark: SparkSession, folder: str) -> DataFrame:
    return reference_entries(spark, read_lists(folder)[0])


# The settings there are, and the budgets that no prompt may show.
SETTINGS = frozenset(
    "extractor_model review_model checker_model checker_concurrency checker_context_chars checker_max_tokens extractor_max_tokens review_max_tokens max_tool_calls max_review_tool_calls "
    "max_checks_per_field extractor_decoding review_decoding checker_decoding final_review check_reviewer_edits rates".split()
)
BUDGETS = ("{max_tool_calls}", "{max_review_tool_calls}")
PROMPTS = ("extractor_system", "review_system", "checker_system")


def unknown_settings(settings: Mapping) -> list[str]:
    return [f"{k} is no setting" for k in sorted(map(str, settings.keys() - SETTINGS))]


def read_prompts(folder: str) -> tuple[dict[str, str], dict[str, str]]:
    """Prompts and partials of a folder by name; both empty where there is none."""
    read = lambda place: {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(place).glob("*.md"))}
    return read(folder), read(f"{folder}/partials")


def prompt_problems(prompts: Mapping[str, str], partials: Mapping[str, str], lists: Collection[str]) -> list[str]:
    """Every fault of prompts: those that are lacking or stray, partials and lists they cite that are not there, partials within partials, budgets they show."""
    from veriquill.functions import render

    out = [f"prompt {name} is missing" for name in PROMPTS if name not in prompts] + [f"prompt {name} is used by no stage" for name in sorted(prompts.keys() - set(PROMPTS))]
    out += [f"partial {name} cites {inner}; partials hold no others" for name, text in sorted(partials.items()) for inner in render.cited_partials(text)]
    for name, text in sorted(prompts.items()):
        cited = render.cited_partials(text)
        out += [f"prompt {name}: no partial {c}" for c in cited if c not in partials]
        whole = "\n".join([text, *(partials[c] for c in cited if c in partials)])
        out += [f"prompt {name}: no reference list {r}" for r in render.referenced_names(whole) if r not in lists]
        out += [f"prompt {name} shows the budget {b}" for b in BUDGETS if b in whole]
    return out


# Settings that belong to a stage which may be switched off.
STAGE_SETTINGS = {
    "checker": ("checker_model", "checker_max_tokens", "checker_decoding", "checker_concurrency", "checker_context_chars"),
    "review": ("review_model", "review_max_tokens", "review_decoding", "max_review_tool_calls"),
}
POSITIVE = ("max_tool_calls", "max_review_tool_calls", "checker_concurrency", "extractor_max_tokens", "checker_max_tokens", "review_max_tokens")
NATURAL = ("max_checks_per_field", "checker_context_chars")


def ignored_settings(settings: Mapping) -> dict[str, list[str]]:
    """Settings written for a stage that is off, by stage."""
    off = {"checker": not settings.get("max_checks_per_field"), "review": not settings.get("final_review", True)}
    return {stage: found for stage, keys in STAGE_SETTINGS.items() if off[stage] and (found := [k for k in keys if settings.get(k) is not None])}


def setting_problems(settings: Mapping) -> list[str]:
    """Every number that is none or out of range; true is not a number."""
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    out = [f"{k} must be a positive whole number" for k in POSITIVE if settings.get(k) is not None and not (whole(settings[k]) and settings[k] > 0)]
    return out + [f"{k} must be a whole number, 0 or more" for k in NATURAL if settings.get(k) is not None and not (whole(settings[k]) and settings[k] >= 0)]


RATES = ("input_per_1m", "output_per_1m", "cache_read_per_1m", "cache_write_per_1m")


def rate_problems(rates: object) -> list[str]:
    """Every fault of a `rates:` block: cards by role, four rates each, one more for hour-long cache writes, none negative.

    An optional rate that is null is not set. A block that is there must have a card.
    """
    if not isinstance(rates, Mapping) or not rates:
        return ["rates must be cards by role; leave the key out to have none"]
    out = []
    for role, card in rates.items():
        if role not in ("extractor", "checker", "review"):
            out.append(f"{role} is no role")
        elif not isinstance(card, Mapping):
            out.append(f"{role}: a card must give rates by name")
        else:
            out += [f"{role}: {k} is missing" for k in RATES if card.get(k) is None] + [f"{role}: {k} is unknown" for k in sorted(map(str, card.keys() - {*RATES, "cache_write_1h_per_1m"}))]
            out += [f"{role}: {k} must be a number, 0 or more" for k, v in card.items() if v is not None and (isinstance(v, bool) or not isinstance(v, (int, float)) or v < 0)]
    return out


def value_schema(f: Mapping) -> dict:
    """The JSON schema that a value of a field must fit; null is allowed for all types but boolean."""
    kind = f["field_type"]
    if kind == "boolean":
        return {"type": "boolean"}
    if kind == "string_list":
        return {"type": ["array", "null"], "items": {"type": "string"}}
    if kind == "categorical" and not f["allow_other"]:
        return {"enum": [*f["options"], None]}
    return {"type": [{"integer": "integer", "year": "integer", "number": "number"}.get(kind, "string"), "null"]}


def field_description(f: Mapping) -> str:
    """What a model is told of a field: its description and instruction, open options, its list, and whether evidence is owed."""
    listed, many = f.get("canonical_reference"), f["field_type"] == "string_list"
    parts = [
        (f.get("description") or "").strip(),
        (f.get("extraction_instruction") or "").strip(),
        f"Options: {'; '.join(f['options'])}; Other (specify)" if f["field_type"] == "categorical" and f.get("allow_other") else "",
        f"{'Names' if many else 'A name'} from the list {listed}, spelled as there{', each once' if many else ''}" if listed else "",
        "Evidence optional" if f.get("evidence") == "optional" else "Evidence required",
    ]
    return " · ".join(p for p in parts if p)


def slim_value_schema(f: Mapping) -> dict:
    """The schema without the options, for calls beside which the options are listed already."""
    return {"type": ["string", "null"]} if f["field_type"] == "categorical" else value_schema(f)


def envelope_schema(f: Mapping, slim: bool = False) -> dict:
    """A value with its evidence and notes."""
    text = {"type": ["string", "null"]}
    told = {} if slim else {"description": field_description(f)}
    return {"type": "object", **told, "properties": {"value": slim_value_schema(f) if slim else value_schema(f), "evidence": text, "notes": text}, "required": ["value", "evidence", "notes"], "additionalProperties": False}


def tool_definitions(template: Template, tools: Mapping[str, tuple[str, tuple[str, ...]]], role: str | None = None) -> list[dict]:
    """The tools of a role, or of all, as they are sent: names and the schemas of their arguments, in the order of `tools`.

    tools: roles, comma-separated, and arguments by name. Changes to a record list no options, as additions beside them do.
    """
    text = {"type": ["string", "null"]}
    record, study = template.fields("record"), template.fields("study")
    checks = lambda block: {"type": "object", "properties": {f["variable"]: value_schema(f) for f in template.fields(block)}, "additionalProperties": False}
    fields = lambda found, slim: {"type": "object", "properties": {f["variable"]: envelope_schema(f, slim) for f in found}, "additionalProperties": False}

    def schema(tool: str, argument: str) -> dict:
        if argument == "fields":
            return fields(study if tool == "update_study" else record, tool == "update_record")
        return {"checks": checks("initial_check"), "quality_check": checks("quality_check")}.get(argument, text if argument in ("notes", "summary") else {"type": "string"})

    out = []
    for name, (roles, arguments) in tools.items():
        if role is None or role in roles.split(","):
            needed = [a for a in arguments if a not in ("notes", "summary", "quality_check")]
            out.append({"name": name, "input_schema": {"type": "object", "properties": {a: schema(name, a) for a in arguments}, "required": needed, "additionalProperties": False}})
    return out
