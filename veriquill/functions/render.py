"""Documents for people, from configuration or from the rows of one session: each is small and made in one go."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from veriquill.functions.columns import SENTENCES
from veriquill.sources.config import Section, Template, label_of

#: Events that are tool calls.
TOOL_EVENTS = ("tool_call_applied", "tool_call_partial", "tool_call_failed", "review_tool_call")

# Field types as people read them, and the headings of the two views' tables.
TYPE_NAMES = {"string": "Text", "year": "Year", "integer": "Number", "number": "Number", "boolean": "Yes/No", "string_list": "Text (multiple)", "date": "Date"}
WORKING = ("Field", "Type / values", "Required", "Evidence", "Description", "Extraction instruction")
PUBLISHED = ("Section", "Field", "Description", "Values")


def one_line(text) -> str:
    return " ".join(str(text or "").split())


def cell(text, lines: bool = False) -> str:
    """Text for a table cell: on one line, or its lines apart by breaks; bars escaped."""
    kept = [one_line(x) for x in str(text or "").splitlines()] if lines else [one_line(text)]
    return "<br>".join(x for x in kept if x).replace("|", "\\|")


def table(header: tuple[str, ...], rows: list[list[str]]) -> str:
    return "\n".join(["| " + " | ".join(header) + " |", "|" + "|".join([":---"] * len(header)) + "|", *("| " + " | ".join(r) + " |" for r in rows)])


def domain(f: Mapping, labels: Mapping[str, str]) -> str:
    """What a field may hold, in words."""
    listed, many = f["canonical_reference"], f["field_type"] == "string_list"
    if listed in labels:
        return f"{'Names' if many else 'Name'} from the {labels[listed]}"
    if listed:
        return f"{'List of names' if many else 'Name'} from the `{listed}` reference list"
    if f["options"]:
        return "; ".join([*f["options"], *(["Other (specify)"] if f["allow_other"] else [])])
    return TYPE_NAMES.get(f["field_type"], f["field_type"])


def working_sections(sections: list[Section], labels: Mapping[str, str]) -> str:
    out = []
    for s in sections:
        out.append(f"### {s.label}\n")
        if one_line(s.instruction):
            out.append(f"_Section extraction instruction._ {cell(s.instruction, lines=True)}\n")
        if s.fields:
            rows = [[f"**{cell(f['label'], lines=True)}**<br>`{cell(f['variable'])}`", cell(domain(f, labels)), "Yes" if f["required"] else "No", f["evidence"] or "", cell(f["description"], lines=True), cell(f["extraction_instruction"], lines=True)] for f in s.fields]
            out.append(table(WORKING, rows) + "\n")
    return "\n".join(out).rstrip()


def working_view(t: Template, labels: Mapping[str, str]) -> str:
    part = lambda block, qa=None: working_sections([s for s in t.sections if s.block == block and qa in (None, s.qa)], labels)
    about = [f"_Entity._ `{t.entity}` (plural: {one_line(t.plural)})", f"_Description._ {one_line(t.description)}"]
    if one_line(t.instruction):
        about.append(f"_Record extraction instruction._ {cell(t.instruction, lines=True)}")
    chapters = [("Study-level extraction", [part("study", False)]), ("Record-level extraction", [*about, part("record", False)]), ("Study-level quality appraisal", [part("study", True)])]
    if any(s.qa for s in t.sections if s.block == "record"):
        chapters.append(("Record-level quality appraisal", [part("record", True)]))
    chapters += [("Initial check", [part("initial_check")]), ("Quality check", [part("quality_check")])]
    return "\n\n".join(["# Extraction template (operational)", *(x for title, body in chapters for x in (f"## {title}", *body))]).rstrip() + "\n"


def published_view(t: Template, labels: Mapping[str, str]) -> str:
    def fields(block: str) -> str:
        rows = [[cell(x) for x in (s.label, f["label"], f["description"], domain(f, labels))] for s in t.sections if s.block == block and not s.qa for f in s.fields]
        return table(PUBLISHED, rows)

    body = ["# Extraction template (publication)", "## Study-level fields", fields("study"), "## Record-level fields", one_line(t.description), fields("record")]
    return "\n\n".join(body).rstrip() + "\n"


VIEWS: dict[str, Callable[[Template, Mapping[str, str]], str]] = {"operational": working_view, "publication": published_view}


def render_template(t: Template, view: str, labels: Mapping[str, str] | None = None) -> str:
    if view not in VIEWS:
        raise ValueError(f"unknown view {view!r}; there are {sorted(VIEWS)}")
    return VIEWS[view](t, labels or {})


LEDE = 40


def lede(text) -> str:
    """The first whole sentences of a text, as many as it takes to reach 40 characters."""
    rest, out = one_line(text), ""
    while rest and len(out) < LEDE:
        sentence, stop, rest = rest.partition(". ")
        out = f"{out} {sentence}{'.' if stop else ''}".strip()
    return out


def fence(text: str, language: str = "") -> str:
    """A code block whose fence is longer than any in the text."""
    longest = max([2, *(len(m) for m in re.findall(r"`+", text))])
    return f"{'`' * (longest + 1)}{language}\n{text}\n{'`' * (longest + 1)}"


def anchor(text: str) -> str:
    """What a heading is linked by: lower case, blanks to hyphens, all else but letters, digits and underscores left out."""
    return "".join(c if c.isalnum() or c in "_-" else "-" if c == " " else "" for c in text.lower())


def shown(value) -> str:
    """A JSON value in a table cell."""
    return "*(none)*" if value is None else f"`{cell(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))}`"


def pairs_table(pairs: list[tuple[str, object]]) -> list[str]:
    rows = [[name, shown(value)] for name, value in pairs if value is not None]
    return [table(("What", "Value"), rows), ""] if rows else ["*(nothing was recorded)*", ""]


def call_lines(number: int, event: dict, checks: Counter) -> list[str]:
    """One tool call: what was applied and what was refused, field by field, and what the checker said."""
    result = json.loads(event["result"]) if event.get("result") else {}
    out = [f"#### Call {number}. `{event.get('tool') or 'unknown'}`", "", f"Status: `{result.get('status') or event['event']}`.", ""]
    rows = [[f"`{cell(path)}`", "applied", shown(d.get("before")), shown(d.get("after"))] for path, d in (result.get("_field_diffs") or {}).items()]
    rows += [[f"`{cell(path)}`", cell("; ".join(str(e.get("code")) for e in errors or [])), "", ""] for path, errors in (result.get("failed_fields") or {}).items()]
    if rows:
        out += [table(("Field", "Outcome", "Before", "After"), rows), ""]
    own = Counter((e.get("code"), e.get("path")) for errors in (result.get("failed_fields") or {}).values() for e in errors or [])
    left = Counter((e.get("code"), e.get("path")) for e in result.get("errors") or []) - own  # one for one, so that a problem told twice stays once
    out += [f"- Refused: `{code}`{f' at `{path}`' if path else ''}" for code, path in left.elements()] + ([""] if left else [])
    for path, v in (result.get("_checker_verdicts") or {}).items():
        checks[path] += 1
        said = "check failed" if v.get("error_origin") else v.get("verdict")
        out += [f"- Check {checks.total()} (`{path}`, its {checks[path]}): **{said}**. {one_line(v.get('rationale'))}".rstrip()]
    return out + ([""] if result.get("_checker_verdicts") else [])


def session_document(data: dict) -> str:
    """A session's transcript. data: session_id, events in order, and if at hand run, output and history (the last two as JSON texts)."""
    run, history = data.get("run") or {}, json.loads(data["history"]) if data.get("history") else None
    parts: dict[str, list[str]] = {"The run": pairs_table([("Session", data["session_id"]), *((label_of(k), v) for k, v in sorted(run.items()) if k != "session_id")])}
    review_from = next((i for i, e in enumerate(data["events"]) if str(e["event"]).startswith("review") or e["event"] == "final_review_response"), len(data["events"]))
    number, checks, notices = 0, Counter(), []
    for title, events in (("The extraction, turn by turn", data["events"][:review_from]), ("The review", data["events"][review_from:])):
        out, turn = [], None
        for e in events:
            if e.get("turn_id") is not None and e["turn_id"] != turn:
                turn = e["turn_id"]
                out += [f"### Turn {turn}", ""]
            if e["event"] in TOOL_EVENTS:
                number += 1
                out += call_lines(number, e, checks)
            elif e["event"] in SENTENCES:
                notices.append(f"- {SENTENCES[e['event']]}{' ' + one_line(e.get('text')) if e.get('text') else ''}")
                out += [notices[-1], ""]
            elif e.get("text"):
                out += [lede(e["text"]), ""]
        parts[title] = out or ["*(nothing happened)*", ""]
    if data.get("output"):
        parts["The output"] = [fence(json.dumps(json.loads(data["output"]), ensure_ascii=False, indent=2), "json"), ""]
    if history:
        rows = [[f"[`{cell(p)}`](#{anchor(p)})", shown(f["final"].get("value")), str(f["final"].get("writes")), str(f["final"].get("checks")), cell(f["final"].get("last_verdict"))] for p, f in history["fields"].items()]
        told = [table(("Field", "Value", "Writes", "Checks", "Last verdict"), rows), ""] + pairs_table([(label_of(k), v) for k, v in history["aggregate"].items()])
        for path, f in history["fields"].items():
            told += [f"### {path}", "", *(f"- Turn {e.get('turn_id')}: {e['kind']}{f' to {shown(e['after'])}' if 'after' in e else ''}" for e in f["events"]), ""]
        parts["What happened to each field"] = told
    if notices:
        parts["Events of the run"] = [*notices, ""]
    titles = [f"{i + 1}. {title}" for i, title in enumerate(parts)]
    contents = [f"- [{t}](#{anchor(t)})" for t in titles]
    body = [line for t, lines in zip(titles, parts.values()) for line in (f"## {t}", "", *lines)]
    return "\n".join([f"# Session {data['session_id']}", "", "## Contents", "", *contents, "", *body]).rstrip() + "\n"


def transcripts(events: DataFrame, runs: DataFrame | None = None, outputs: DataFrame | None = None, histories: DataFrame | None = None) -> DataFrame:
    """(session_id, transcript): each session's log as Markdown, with its run, output and field histories where they are given.

    events: session_id, line_no, event, turn_id, tool, text, result; runs: session_id and whatever is shown of a run; outputs:
    session_id, output; histories: session_id, history. One session is one row.
    """
    told = events.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "event", "turn_id", "tool", "text", "result"))).alias("events"))
    if runs is not None:
        told = told.join(runs.select("session_id", F.struct(*[c for c in runs.columns if c != "session_id"]).alias("run")), "session_id", "left")
    for more, name in ((outputs, "output"), (histories, "history")):
        if more is not None:
            told = told.join(more.select("session_id", name), "session_id", "left")

    @pandas_udf(T.StringType())
    def made(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: session_document(json.loads(r)))

    return told.select("session_id", made(F.to_json(F.struct(*told.columns))).alias("transcript"))


PLACEHOLDER = re.compile(r"\{reference:([A-Za-z0-9_]+)\}")
INCLUDE = re.compile(r"\{include:([A-Za-z0-9_]+)\}")
INCLUDE_IF = re.compile(r"\{include_if:([a-z_]+):([A-Za-z0-9_]+)\}")


def referenced_names(text: str) -> list[str]:
    return list(dict.fromkeys(PLACEHOLDER.findall(text)))


def cited_partials(text: str) -> list[str]:
    """Every partial a text cites, by either form."""
    return list(dict.fromkeys([*INCLUDE.findall(text), *(n for _, n in INCLUDE_IF.findall(text))]))


def reference_block(entries: list) -> str:
    """The names of a list's entries, bulleted; aliases help to match and are not shown."""
    return "\n".join(f"- {e if isinstance(e, str) else e['tool_name']}" for e in entries or [])


def with_references(text: str, lists: Mapping[str, list]) -> str:
    """Placeholders replaced by the bulleted names of their lists."""
    if lost := [n for n in referenced_names(text) if n not in lists]:
        raise KeyError(f"no reference list {lost}; there are {sorted(lists)}")
    return PLACEHOLDER.sub(lambda m: reference_block(lists[m[1]]), text)


def with_partials(text: str, partials: Mapping[str, str], switches: Mapping[str, bool] | None = None) -> str:
    """Includes replaced by their partials. One that is switched off goes; alone on its line, with the line and a blank one after it."""
    for name in cited_partials(text):
        if name not in partials:
            raise KeyError(f"no partial {name!r}")
        if INCLUDE.search(partials[name]) or INCLUDE_IF.search(partials[name]):
            raise ValueError(f"partial {name!r} includes another")
    if (switches is None) and INCLUDE_IF.search(text):
        raise ValueError("the text has conditional parts and no switches were given")
    alone = re.compile(rf"^[ \t]*{INCLUDE_IF.pattern}[ \t]*\n(?:[ \t]*\n)?", re.M)
    text = alone.sub(lambda m: f"{partials[m[2]].strip()}\n\n" if switches[m[1]] else "", text)
    text = INCLUDE_IF.sub(lambda m: partials[m[2]].strip() if switches[m[1]] else "", text)
    return INCLUDE.sub(lambda m: partials[m[1]].strip(), text)
