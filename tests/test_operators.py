import hashlib
import json
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veriquill.functions import arrow, columns
from veriquill.functions.arrow import canonical, register
from veriquill.operators import containment, evidence, history, identity, ledger, lists, log, records, sweep, values
from veriquill.sources import config, files, sinks

FIELDS = [
    ("study", "design", "categorical", ["Cohort study", "RCT"], False, "required", True, None),
    ("study", "summary", "string", None, False, "optional", False, None),
    ("study", "year", "year", None, False, "optional", False, None),
    ("record", "gauge", "string", None, False, "required", True, "gauges"),
    ("record", "gauges", "string_list", None, False, "optional", False, "gauges"),
    ("record", "kind", "categorical", ["A", "a ", "B"], True, "optional", False, None),
    ("record", "n", "integer", None, False, "optional", False, None),
    ("record", "lost", "string", None, False, "optional", False, "no_list"),
    ("quality_check", "done", "boolean", None, False, None, True, None),
]


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = [(b, None, None, False, i, v, v, None, None, k, o, a, e, None, r, ref, False) for i, (b, v, k, o, a, e, r, ref) in enumerate(FIELDS)]
    return spark.createDataFrame(rows, values.CATALOGUE)


@pytest.fixture(scope="module")
def entries(spark):
    rows = [("gauges", 0, "Strain – Gauge", None, ["SG", "strain gauge ii"]), ("gauges", 1, "Load Cell", None, ["LC", "sg2", "both"]), ("gauges", 2, "Third", None, ["both", "third"])]
    return spark.createDataFrame(rows, lists.ENTRY)


GATE = "when_field string, field string, allowed array<string>"


def cells(spark, rows):
    """rows: study, record or None, variable, value, evidence."""
    full = []
    for s, r, v, x, e in rows:
        block = "record" if r else "study"
        full.append((s, block, r, None, v, f"record.{r}.{v}" if r else f"study.{v}", x, e, None))
    return spark.createDataFrame(full, values.CELL)


TYPES = {
    "string": {'"a"': None, "1": "type_mismatch", "null": None, "[]": "type_mismatch"},
    "integer": {"3": None, "3.0": "type_mismatch", "true": "type_mismatch", "-4": None, "1e3": "type_mismatch", '"3"': "type_mismatch"},
    "number": {"3": None, "3.5": None, "1e3": None, "true": "type_mismatch"},
    "boolean": {"true": None, "null": "type_mismatch", "0": "type_mismatch"},
    "year": {"1999": None, "1999.0": None, "1999.5": "type_mismatch", "1799": "year_out_of_range", "2101": "year_out_of_range", '"1999"': "type_mismatch", "1800": None, "true": "type_mismatch"},
    "date": {'"2020-99-01"': None, '"2020-1-01"': "date_format", '"2020-01-01\\n"': None, "2020": "type_mismatch"},
    "string_list": {"[]": None, '["a"]': None, '["a", 1]': "type_mismatch", '["a", null]': "type_mismatch", '"a"': "type_mismatch", "[null]": "type_mismatch"},
}


def test_types(spark):
    rows = [(k, v, code) for k, cases in TYPES.items() for v, code in cases.items()]
    df = spark.createDataFrame(rows, "kind string, raw string, want string")
    no = F.lit(None)
    got = df.select("*", columns.type_problem(F.col("raw"), F.col("kind"), no.cast("array<string>"), no.cast("boolean")).alias("got"))
    assert [r for r in got.collect() if r.got != r.want] == []


def test_options(spark):
    options = ["Cohort study", "RCT", "Dup", "dup "]
    df = spark.createDataFrame([("  cohort   STUDY ", "Cohort study"), ("RCT", "RCT"), ("DUP", None), ("Dup", "Dup"), ("none", None)], "v string, want string")
    got = df.select("*", columns.match_option(F.col("v"), F.array(*[F.lit(o) for o in options])).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_equality_and_truth_of_json(spark):
    same = [("1", "1.0", True), ("1", "true", True), ("0", "false", True), ('"1"', "1", False), ("null", None, True), ('"a"', '"\\u0061"', True), ("2", "1", False), ("[1]", "[1]", True)]
    df = spark.createDataFrame(same, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("*", columns.same_json(F.col("a"), F.col("b")).alias("got")).collect())
    truth = [("0", False), ("0.0", False), ("false", False), ('""', False), ("[]", False), ("[ ]", False), ("{}", False), ("null", False), ("1", True), ('"x"', True), ("[0]", True), ('" "', True)]
    assert all(r.got == r.want for r in spark.createDataFrame(truth, "v string, want boolean").select("*", columns.truthy(F.col("v")).alias("got")).collect())


def test_values_are_checked_and_spelled(spark, catalogue):
    rows = [("s", None, "design", '" cohort STUDY"', None), ("s", None, "year", "1999.0", None), ("s", None, "who", "1", None), ("s", "r_1", "kind", '"other text"', None), ("s", "r_1", "kind", '"  "', None), ("s", "r_1", "kind", '"b"', None)]
    got = values.checked(cells(spark, rows), catalogue).collect()
    found = {(r.variable, r.value): (r.value_out, [e.code for e in r.errors], [e.path for e in r.errors]) for r in got}
    assert found["design", '" cohort STUDY"'][:2] == ('"Cohort study"', []) and found["year", "1999.0"][0] == "1999"
    assert found["who", "1"][1:] == (["unknown_field"], ["study.who"]) and found["kind", '"  "'][1:] == (["empty_value"], ["record.r_1.kind.value"])
    assert found["kind", '"b"'][0] == '"B"' and found["kind", '"other text"'][0] == '"other text"'


def test_references(spark, catalogue, entries):
    rows = [
        ("s", "r_1", "gauge", '"STRAIN - gauge"', None), ("s", "r_2", "gauge", '"sg"', None), ("s", "r_3", "gauge", '"both"', None), ("s", "r_4", "gauge", '"nothing"', None), ("s", "r_5", "gauge", '" "', None),
        ("s", "r_6", "gauges", '["SG", "Load Cell", "strain - gauge"]', None), ("s", "r_7", "gauges", '["lc", "THIRD"]', None), ("s", "r_8", "gauges", "[]", None), ("s", "r_9", "lost", '"x"', None), ("s", "r_10", "gauge", "null", None),
    ]
    got = {r.path: r for r in values.referenced(values.checked(cells(spark, rows), catalogue), entries).collect()}
    codes = lambda p: [(e.path, e.code) for e in got[p].errors]
    assert got["record.r_1.gauge"].value_out == '"Strain – Gauge"' and got["record.r_1.gauge"].canonicalisations == []
    assert got["record.r_2.gauge"].value_out == '"Strain – Gauge"' and got["record.r_2.gauge"].canonicalisations[0].entered == "sg"
    assert [c for _, c in codes("record.r_3.gauge")] == ["ambiguous_reference"] and [c for _, c in codes("record.r_4.gauge")] == ["off_list_reference"]
    assert [c for _, c in codes("record.r_5.gauge")] == ["empty_value"]
    assert codes("record.r_6.gauges") == [("record.r_6.gauges.value[2]", "duplicate_reference")] and got["record.r_6.gauges"].canonicalisations == []
    assert json.loads(got["record.r_7.gauges"].value_out) == ["Load Cell", "Third"] and len(got["record.r_7.gauges"].canonicalisations) == 1
    assert got["record.r_8.gauges"].errors == [] and got["record.r_8.gauges"].value_out == "[]"
    assert codes("record.r_9.lost") == [("record.r_9.lost.value", "reference_unavailable")] and "record.r_10.gauge" not in got


def test_suggestions_and_clashes(spark, entries):
    index = lists.reference_index(entries)
    near = lists.suggestions(spark.createDataFrame([("gauges", "lode cell")], "list string, form string"), index, 2).orderBy("rank").collect()
    assert near[0].canonical == "Load Cell" and [r.rank for r in near] == [1, 2]
    assert [(r.form, r.canonicals) for r in lists.clashes(entries).collect()] == [("both", ["Load Cell", "Third"])]


def test_unknown_lists(catalogue, entries):
    assert [r.variable for r in lists.unknown_lists(catalogue, entries).collect()] == ["lost"]


TEXT = "The cohort had 448 patients.\nSelf-\nassessment was used."


def test_evidence(spark, catalogue):
    rows = [
        ("s", None, "design", '"RCT"', "<q>448 patients</q> and <img> Table_1 </img>"),
        ("s", "r_1", "gauge", '"SG"', "only words"),
        ("s", "r_2", "gauge", '"SG"', "<q></q>"),
        ("s", "r_3", "gauge", '"SG"', "<q>a<q>b</q></q>"),
        ("s", "r_4", "gauge", "null", "<q>not there</q><q>449 patients</q>"),
        ("s", "r_5", "gauge", "null", None),
        ("s", "r_6", "gauge", '"SG"', None),
        ("s", "r_7", "n", "1", "words"),
        ("s", "r_8", "gauge", '"SG"', "<img>figure_9</img><img> </img>"),
        ("s", "r_9", "gauge", '"SG"', "<q>self-assessment WAS</q>"),
    ]
    checked = values.checked(cells(spark, rows), catalogue)
    papers = spark.createDataFrame([("s", TEXT)], "study_id string, text string")
    labels = spark.createDataFrame([("s", "table_1")], "study_id string, label string")
    got = sorted((r.path, r.code) for r in evidence.evidence_problems(checked, papers, labels).collect())
    assert got == sorted([
        ("record.r_1.gauge.evidence", "evidence_required"), ("record.r_2.gauge.evidence[<q>0]", "empty_quote"), ("record.r_3.gauge.evidence", "malformed_tags"), ("record.r_4.gauge.evidence[<q>0]", "quote_not_in_text"),
        ("record.r_4.gauge.evidence[<q>1]", "quote_not_in_text"), ("record.r_6.gauge.evidence", "evidence_required"), ("record.r_8.gauge.evidence[<img>0]", "unknown_image_label"), ("record.r_8.gauge.evidence[<img>1]", "empty_image_label"),
    ])
    assert [(r.path, r.tier) for r in evidence.weak_matches(checked, papers).collect()] == [("record.r_9.gauge.evidence[<q>0]", "case_folded")]


def test_located_is_the_kernel(spark):
    from veriquill.functions import quotes

    r = random.Random(7)
    text = "Alpha beta [1] gamma,  delta\nep-\nsilon. " * 3 + "\n--- PAGE BREAK ---\nZeta … eta 😀 theta"
    asked = [text[a : a + r.randint(1, 30)] for a in range(0, len(text), 7)] + ["beta gamma", "alpha BETA", "Zeta ... theta", "😀 theta", "none", " "]
    df = spark.createDataFrame([("s" if k % 3 else "t", q) for k, q in enumerate(asked)] + [("no paper", "x")], "study_id string, quote string")
    papers = spark.createDataFrame([("s", text), ("t", text.replace("--- PAGE BREAK ---", ""))], "study_id string, text string")
    texts = {r.study_id: r.text for r in papers.collect()}
    for row in evidence.located(df, papers).collect():
        want = quotes.locate(row.quote, texts.get(row.study_id))
        assert (row.found.matched, row.found.tier, row.found.reading, row.found.start, row.found.end) == (want.matched, want.tier, want.reading, want.start, want.end), row


def test_gates_and_completeness(spark, catalogue):
    rows = [("s", "r_1", "kind", '"B"', None), ("s", "r_1", "n", "3", None), ("s", "r_2", "kind", '" a"', None), ("s", "r_2", "n", "3", None), ("s", "r_3", "kind", '"B"', None), ("s", "r_3", "n", "0", None), ("s", "r_4", "n", "3", None), ("s", "r_5", "gauge", '"x"', None)]
    c = cells(spark, rows)
    gates = spark.createDataFrame([("kind", "n", ["A"])], GATE)
    assert [r.path for r in values.gate_warnings(c, gates).collect()] == ["record.r_1.n"]
    studies = spark.createDataFrame([("s",), ("u",)], "study_id string")
    owed = {(r.study_id, r.path) for r in values.missing_required(c, catalogue, studies).collect()}
    assert owed == {("s", "study.design"), ("u", "study.design"), *(("s", f"record.r_{k}.gauge") for k in (1, 2, 3, 4))}
    codes = {(r.study_id, r.code) for r in records.completion_problems(c, catalogue, studies).collect()}
    assert codes == {("s", "study_field_required"), ("s", "record_field_required"), ("s", "quality_check_required"), ("u", "study_field_required"), ("u", "no_records"), ("u", "quality_check_required")}
    assert records.completion_problems(c, catalogue, studies, "review").collect() == []
    assert {(r.record_id, r.filled, r.total) for r in values.filled_counts(c, catalogue).collect() if r.record_id == "r_1"} == {("r_1", 2, 5)}
    assert {r.label for r in records.record_labels(c, ["kind", "n"]).collect()} == {"r_1 | B | 3", "r_2 | a | 3", "r_3 | B | 0", "r_4 | 3", "r_5"}


def test_sweep(spark, catalogue, entries):
    rows = [("s", None, "design", '"nope"', "<q>448 patients</q>"), ("s", "r_1", "gauge", '"SG"', None), ("s", "r_1", "kind", '"B"', None), ("s", "r_1", "n", "2", None)]
    gates = spark.createDataFrame([("kind", "n", ["A"])], GATE)
    papers = spark.createDataFrame([("s", TEXT)], "study_id string, text string")
    run = lambda **k: {(r.path, r.code, r.severity) for r in sweep.sweep(cells(spark, rows), catalogue, entries, gates, **k).collect()}
    always = {("study.design.value", "invalid_option", "error"), ("n", "category_gate", "warning")}
    assert run(papers=papers) == run() == always | {("record.r_1.gauge.evidence", "evidence_required", "error")}
    assert run(papers=papers, producer="human") == run(producer="human") == always
    with pytest.raises(ValueError):
        run(producer="other")


def call(event, line, **result):
    return ("x", line, event, str(line), line, "update_study", json.dumps(result))


def test_history(spark):
    write = lambda b, a: {"before": b, "after": a}
    verdict = lambda v, **k: {"verdict": v, "rationale": "r", **k}
    rows = [
        call("session_started", 0),
        call("tool_call_applied", 1, _field_diffs={"study.a": write(None, 1), "record.r_1.b": write(None, "x")}, _checker_verdicts={"study.a": verdict("challenge", cost_usd=0.1), "record.r_1.b": verdict("ok", cost_usd=0.2)}),
        call("tool_call_applied", 2, _field_diffs={"study.a": write(1, 1.0)}, _checker_verdicts={"study.a": verdict("challenge", error_origin=True, cost_usd=0.3)}),
        call("tool_call_partial", 3, _field_diffs={"study.a": write(1, 2)}, failed_fields={"study.c": [{"code": "type_mismatch", "message": "m"}]}, _checker_verdicts={"study.a": verdict("challenge", cost_usd=0.1)}),
        call("review_tool_call", 4, _field_diffs={"study.a": write(2, 3)}),
        call("review_tool_call", 5, applied_changes={"removed_record_id": "r_1"}),
        call("review_tool_call", 6, applied_changes={"removed_record_id": "r_1"}),
    ]
    events = spark.createDataFrame(rows, "session_id string, line_no long, event string, ts string, turn_id long, tool string, result string")
    steps = history.steps(events)
    got = history.history(steps).orderBy("path", "seq").collect()
    kinds = lambda p: [r.kind for r in got if r.path == p]
    assert kinds("study.a") == ["proposed", "applied", "challenged", "proposed", "overruled", "check_error", "proposed", "applied", "challenged", "proposed", "revised_by_reviewer"]
    assert kinds("record.r_1.b") == ["proposed", "applied", "checked", "removed"] and kinds("study.c") == ["proposed", "rejected"]
    final = {r.path: r for r in history.final_states(steps).collect()}
    assert (final["study.a"].writes, final["study.a"].checks, final["study.a"].value, final["study.a"].unresolved_challenge) == (4, 3, "3", True)
    assert (final["record.r_1.b"].present, final["record.r_1.b"].value) == (False, None) and final["study.c"].rejections == 1
    total = history.totals(steps).collect()[0]
    assert (total.fields_written, total.fields_checked, total.challenges_raised, total.challenges_overruled, total.challenges_revised, total.check_errors) == (2, 2, 2, 1, 1, 1)
    assert total.checker_cost_usd == pytest.approx(0.7)
    again = history.history(history.steps(events.repartition(5))).orderBy("path", "seq").collect()
    assert again == got
    diagnosed = history.diagnostics(steps).collect()[0]
    assert tuple(diagnosed)[1:] == (2, 4, 0, ["study.a"], [])


def plain_history(events):
    """The fold as it reads, event by event."""
    fields, out = {}, []
    for line, event, result in events:
        stage = history.STAGES.get(event)
        if stage is None:
            continue
        state = lambda path: fields.setdefault(path, {"open": False, "present": True, "value": None, "touched": False, "n": [0, 0, 0], "last": None})
        for path, d in result.get("_field_diffs", {}).items():
            s, changed = state(path), d["before"] != d["after"]
            kind = "overruled" if s["open"] and not changed else "revised_by_reviewer" if stage == "review" and changed else "revised_after_challenge" if s["open"] else "applied"
            out += [(path, line, "proposed", None, None), (path, line, kind, s["open"], changed)]
            s.update(open=False, present=True, value=d["after"], touched=s["touched"] or stage == "review")
            s["n"][0] += 1
        for path in result.get("failed_fields", {}):
            out += [(path, line, "proposed", None, None), (path, line, "rejected", None, None)]
            state(path)["n"][1] += 1
        if gone := result.get("applied_changes", {}).get("removed_record_id"):
            for path, s in fields.items():
                if path.startswith(f"record.{gone}.") and s["present"]:
                    out.append((path, line, "removed", None, None))
                    s.update(open=False, present=False, value=None, touched=s["touched"] or stage == "review")
        for path, v in result.get("_checker_verdicts", {}).items():
            s, error = state(path), bool(v.get("error_origin"))
            out.append((path, line, "check_error" if error else "challenged" if v["verdict"] == "challenge" else "checked", None, None))
            s["n"][2] += 1
            s["last"] = (v["verdict"], error)
            if not error:
                s["open"] = v["verdict"] == "challenge"
    return out, fields


def test_history_is_the_plain_fold(spark):
    """Random logs with typed values, removals and errors: the windows say what the fold says."""
    r = random.Random(11)
    values_of = [1, 1.0, True, "1", None, "null", [1], [1.0], [True], {"a": 1, "b": [2]}, {"b": [2.0], "a": 1}, 0, False, "", "é\n"]
    paths = ["study.a", "study.b", "record.r_1.x", "record.r_1.y", "record.r_2.x", "record.r_10.x"]
    some = lambda: r.sample(paths, r.randint(0, 3))
    logs = []
    for k in range(400):
        result = {"_field_diffs": {p: {"before": r.choice(values_of), "after": r.choice(values_of)} for p in some()}, "failed_fields": {p: [{"code": "c", "message": "m"}] for p in some()[:1]}}
        result["_checker_verdicts"] = {p: {"verdict": r.choice(["ok", "challenge"]), "error_origin": r.random() < 0.2, "cost_usd": 0.5} for p in some()}
        if r.random() < 0.15:
            result["applied_changes"] = {"removed_record_id": r.choice(["r_1", "r_2"])}
        logs.append((f"s{k % 8}", k, r.choice([*history.STAGES, "error"]), result))
    events = spark.createDataFrame([(s, k, e, str(k), k, "t", json.dumps(x)) for s, k, e, x in logs], "session_id string, line_no long, event string, ts string, turn_id long, tool string, result string").repartition(5)
    steps = history.steps(events)
    got, final, totals = history.history(steps).collect(), history.final_states(steps).collect(), {t.session_id: t for t in history.totals(steps).collect()}
    for s in {x[0] for x in logs}:
        out, fields = plain_history([x[1:] for x in logs if x[0] == s])
        for path, state in fields.items():
            mine = sorted((g for g in got if g.session_id == s and g.path == path), key=lambda g: g.seq)
            assert [g.seq for g in mine] == list(range(len(mine)))
            assert [(g.path, g.line_no, g.kind, g.answers_challenge, g.changed) for g in mine] == [o for o in out if o[0] == path]
            (end,) = [f for f in final if f.session_id == s and f.path == path]
            assert (end.present, end.reviewer_touched, [end.writes, end.rejections, end.checks]) == (state["present"], state["touched"], state["n"])
            assert (None if end.value is None else json.loads(end.value)) == state["value"] and (end.last_verdict, end.last_verdict_error_origin) == (state["last"] or (None, False))
            assert end.unresolved_challenge == (state["last"] == ("challenge", False))
        t = totals[s]
        kinds = Counter(o[2] for o in out)
        assert (t.challenges_raised, t.challenges_overruled, t.check_errors) == (kinds["challenged"], kinds["overruled"], kinds["check_error"])
        assert t.challenges_revised == sum(bool(o[3] and o[4]) for o in out) and t.checker_cost_usd == 0.5 * (kinds["challenged"] + kinds["checked"] + kinds["check_error"])
        assert (t.fields_written, t.fields_reviewer_touched) == (sum(f["n"][0] > 0 for f in fields.values()), sum(f["touched"] for f in fields.values()))


@pytest.mark.parametrize(("a", "b", "changed"), [("1", 1, True), (True, "true", True), (None, "null", True), ([1], [1.0], False), ({"a": 1, "b": 2}, {"b": 2, "a": 1}, False), (1, 1.0, False), (1, True, False), ([1, 2], [2, 1], True)])
def test_changes_are_those_of_values(a, b, changed):
    (row,) = arrow.field_diffs.func(pd.Series([json.dumps({"p": {"before": a, "after": b}})]))[0]
    assert row["changed"] is changed and json.loads(row["before"]) == a


def test_history_rows_and_document(spark):
    results = [
        {"_field_diffs": {"record.r_1.b": {"before": None, "after": {"x": "é"}}}, "failed_fields": {"study.c": [{"code": "type_mismatch", "message": "no"}]}},
        {"_checker_verdicts": {"record.r_1.b": {"verdict": "challenge", "rationale": "why", "value_checked": "v", "evidence_checked": "<q>e</q>", "note_checked": "n", "cost_usd": 0.25, "reprompted": 1, "cost_incomplete": True, "unreceipted_responses": 2}}},
        {"applied_changes": {"removed_record_id": "r_1"}},
    ]
    events = spark.createDataFrame([("s", k, "review_tool_call", f"t{k}", k, "tool", json.dumps(x)) for k, x in enumerate(results)], "session_id string, line_no long, event string, ts string, turn_id long, tool string, result string")
    steps = history.steps(events)
    rows = {(r.path, r.kind): r for r in history.history(steps).collect()}
    applied, refused, said, gone = rows["record.r_1.b", "revised_by_reviewer"], rows["study.c", "rejected"], rows["record.r_1.b", "challenged"], rows["record.r_1.b", "removed"]
    assert (applied.before, applied.after, applied.changed, applied.tool, applied.turn_id, applied.ts) == ("null", '{"x": "é"}', True, "tool", 0, "t0")
    assert [tuple(e) for e in refused.errors] == [("type_mismatch", "no")] and (gone.record_id, gone.value_before) == ("r_1", '{"x": "é"}')
    assert (said.rationale, said.value_checked, said.evidence_checked, said.note_checked, said.cost_usd) == ("why", '"v"', "<q>e</q>", "n", 0.25)
    (document,) = history.documents(steps).collect()
    found = json.loads(document.history)
    assert list(found["fields"]) == ["record.r_1.b", "study.c"] and [e["kind"] for e in found["fields"]["record.r_1.b"]["events"]] == ["proposed", "revised_by_reviewer", "challenged", "removed"]
    assert found["aggregate"]["checker_unreceipted_responses"] == 2 and found["aggregate"]["checker_cost_incomplete"] and found["aggregate"]["fields_reviewer_touched"] == 1
    assert history.diagnostics(steps).collect()[0].checks_reprompted == 1


def test_history_agrees_with_the_stream(spark, tmp_path):
    from veriquill.streaming.history import running_states

    r = random.Random(3)
    rows = []
    for k in range(60):
        what = r.choice(["write", "reject", "verdict"])
        rows.append(("s", f"study.f{r.randrange(4)}", k, 0, 0, "extractor", None, k, "t", what, None, str(k), bool(k % 2), None, None, r.choice(["ok", "challenge"]) if what == "verdict" else None, None, None, None, None, False, False, None, False, 0))
    df = spark.createDataFrame(rows, history.STEPS)
    for k in range(3):
        df.where(f"line_no >= {20 * k} and line_no < {20 * k + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = running_states(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    last = {r.path: r for r in spark.sql("select path, max_by(struct(writes, rejections, checks, last_verdict), line_no) as s from states group by path").collect()}
    batch = {r.path: r for r in history.final_states(df).collect()}
    assert {p: tuple(r.s) for p, r in last.items()} == {p: (r.writes, r.rejections, r.checks, r.last_verdict) for p, r in batch.items()}


def test_costs(spark):
    rows = [("a", 0.1, True), ("a", 0.2, True), ("b", None, True), ("b", 0.5, True), ("c", None, False), ("d", 5e-7, True)]
    calls = spark.createDataFrame(rows, "role string, cost double, receipted boolean")
    got = {r.role: r for r in ledger.recorded_cost(calls, ["role"]).collect()}
    assert got["a"].cost_usd == 0.3 and got["b"].cost_usd is None and got["c"].cost_usd is None and got["c"].unreceipted_calls == 1 and got["d"].cost_usd == 0.0
    assert {r.role: r.cost_usd for r in ledger.recorded_cost(calls, ["role"], F.lit(True)).collect()}["c"] == 0.0
    one = spark.range(1).select(ledger.call_cost({"input_tokens": F.lit(1_000_000), "output_tokens": F.lit(10)}, {"input_per_1m": F.lit("3.25"), "output_per_1m": F.lit("15")}).alias("c"), ledger.call_cost({"cache_write_1h_tokens": F.lit(1)}, {}).alias("d")).collect()[0]
    assert float(one.c) == 3.25015 and one.d is None


def test_rate_cards(spark):
    roles = spark.createDataFrame([("extractor", "m", False), ("checker", "m", True), ("review", "m", False), ("other", "n", False)], "role string, model string, routed boolean")
    names = list(ledger.COUNTERS.values())
    schema = ", ".join(f"{c} decimal(18,9)" for c in names)
    from decimal import Decimal

    own = spark.createDataFrame([("review", *[Decimal(2)] * 5)], f"role string, {schema}")
    table = spark.createDataFrame([("m", *[Decimal(1)] * 5)], f"model string, {schema}")
    got = {r.role: (r.priced, r.input_per_1m) for r in ledger.rate_cards(roles, own, table).collect()}
    assert got == {"extractor": (True, 1), "checker": (False, None), "review": (True, 2), "other": (False, None)}


def test_logs(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, None), (5, "b"), (6, "a")]
    df = spark.createDataFrame([("s", i, v) for i, v in rows], "s string, i int, v string")
    assert [r.island for r in log.islands(df, ["s"], "i", F.col("v")).orderBy("i").collect()] == [1, 1, 2, 3, 4, 5]
    assert [r.streak for r in log.streaks(df, ["s"], "i", F.col("v").isNotNull(), F.col("v")).orderBy("i").collect()] == [1, 2, 0, 0, 1, 1]
    assert log.first_stall(df, ["s"], "i", F.col("v").isNotNull(), F.col("v"), 2).collect()[0].stalled_at == 2
    spans = spark.createDataFrame([("k", 1, 3), ("k", 3, 5), ("k", 6, 7), ("k", 2, 4), ("k", 6, 6)], "k string, start int, end int")
    assert {(r.start, r.end, r.n) for r in log.merged_intervals(spans, ["k"]).collect()} == {(1, 5, 3), (6, 7, 2)}
    turns = spark.createDataFrame([("s", 1, 5, "assistant", "a"), ("s", 2, 5, "user", "b"), ("s", 3, 4, "assistant", "c"), ("s", 4, None, "user", "d")], "session_id string, line_no long, turn_id long, role string, text string")
    assert [(r.turn_no, r.turn_id, len(r.parts)) for r in log.replay(turns).collect()] == [(1, 5, 2)]


def test_torn_tail(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"event": "x", "turn_id": 1}\n{"event": "y", "result": {"a": 1}}\n{"eve')
    lines = log.drop_torn_tail(files.numbered_lines(spark, str(tmp_path / "*.jsonl")))
    got = files.events(lines).orderBy("line_no").collect()
    assert [(r.line_no, r.event, r.result) for r in got] == [(0, "x", None), (1, "y", '{"a":1}')]
    (tmp_path / "b.jsonl").write_text('{"eve\n{"event": "y"}\n')
    with pytest.raises(Exception, match="not JSON"):
        log.drop_torn_tail(files.numbered_lines(spark, str(tmp_path / "*.jsonl"))).collect()


def test_records_and_dispatch(spark):
    adds = spark.createDataFrame([("s", "arm", 5), ("s", "arm", 2), ("t", "arm", 1)], "study_id string, entity string, seq int")
    assert {(r.study_id, r.seq, r.record_id) for r in records.record_ids(adds).collect()} == {("s", 2, "arm_1"), ("s", 5, "arm_2"), ("t", 1, "arm_1")}
    writes = spark.createDataFrame([("s", "p", "arm_1", 1, "a"), ("s", "p", "arm_1", 2, "b"), ("s", "q", "arm_2", 3, "c")], "study_id string, path string, record_id string, seq int, value string")
    gone = spark.createDataFrame([("s", "arm_2")], "study_id string, record_id string")
    assert [(r.path, r.value) for r in records.current_cells(writes, gone).collect()] == [("p", "b")]
    cases = [("nope", "extractor", {}, True, "unknown_tool"), (None, "extractor", {}, True, "unknown_tool"), ("add_record", "extractor", None, True, "malformed_input"), ("record_initial_check", "review", {}, True, "tool_not_available_to_role"), ("add_record", "extractor", {"fields": "x"}, False, "initial_check_required"), ("add_record", "review", {"x": "x"}, False, "unknown_argument"), ("add_record", "extractor", {"fields": "x"}, True, None)]
    df = spark.createDataFrame(cases, "tool string, role string, args map<string,string>, started boolean, want string")
    got = df.select("*", records.dispatch_problem(F.col("tool"), F.col("role"), F.col("args"), F.col("started")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_applied_calls(spark, catalogue):
    rows = [("s", None, "design", '"RCT"', None), ("s", None, "year", '"x"', None)]
    df = cells(spark, rows).withColumn("call_id", F.lit(1)).withColumn("tool", F.lit("update_study"))
    bad = cells(spark, [("s", "r_1", "n", '"x"', None)]).withColumn("call_id", F.lit(2)).withColumn("tool", F.lit("add_record"))
    fine, calls = records.applied(df.unionByName(bad), catalogue)
    assert [r.variable for r in fine.collect()] == ["design"]
    assert {(r.call_id, r.status, r.record_made) for r in calls.collect()} == {(1, "partial", False), (2, "validation_failed", False)}


def test_fingerprints(spark, catalogue, entries):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    row = spark.range(1).select(
        identity.run_fp(F.lit("config_fp:x"), F.lit(None).cast("string"), F.lit("review_fp:z"), F.lit("engine_fp:e")).alias("run"),
        identity.checker_fp(*[F.lit(x) for x in ("call", "sys", "usr", "tools", "checks0", "cat", "refs")], F.array(F.lit("é"), F.lit("b")), F.lit(400)).alias("checker"),
        identity.structure(F.lit(2), F.lit(False), F.lit(False), F.lit(True)).alias("s"),
    ).collect()[0]
    assert row.run == "run_fp:" + sha("config_fp:x|none|review_fp:z|engine_fp:e") and row.s == "checks2_noreview_checkreview_noimages"
    assert row.checker.startswith("checker_fp:")
    rows = [{"block": f"{b}_fields", "variable": v, "description": None, "extraction_instruction": None, "field_type": k, "allow_other": a, "evidence": e, "options": o, "canonical_reference": ref, "required": r, "role": None} for b, v, k, o, a, e, r, ref in FIELDS]
    assert identity.catalogue_hash(catalogue.repartition(4)).collect()[0].hash == sha(canonical(rows))
    payload = {"gauges": [{"name": r.canonical, "aliases": r.aliases} for r in entries.orderBy("pos").collect()]}
    assert identity.reference_hash(entries.repartition(3)).collect()[0].hash == sha(canonical(payload))


def test_bundles(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name / "figures").mkdir(parents=True)
        (tmp_path / name / "manifest.json").write_text(json.dumps({"schema_version": 1, "id": name, "title": "T", "exhibits": [{"label": "table_1", "caption": "c"}]}))
        (tmp_path / name / "text.md").write_text("é text", encoding="utf-8")
    (tmp_path / "one" / "figures" / "table_1.png").write_bytes(b"png")
    (tmp_path / "three").mkdir()
    (tmp_path / "three" / "manifest.json").write_text("no json")
    papers = files.papers(spark, str(tmp_path))
    got = {r.bundle: r for r in papers.collect()}
    assert got["one"].text == "é text" and got["one"].exhibits[0].label == "table_1"
    assert {(r.bundle, r.code) for r in files.bundle_problems(papers).collect()} == {("three", "manifest_unreadable")}
    shots = files.figures(spark, str(tmp_path))
    assert [(r.bundle, r.label, r.length) for r in shots.collect()] == [("one", "table_1", 3)]
    fine = papers.where("study_id is not null")
    fps = {r.study_id: r for r in identity.bundle_fps(fine.select("study_id", "content"), shots.withColumnRenamed("bundle", "study_id"), fine.select("study_id", "raw")).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = ["text_fp:" + sha("é text".encode()), "figures_fp:" + sha(canonical([["table_1", sha(b"png")]]).encode()), "manifest_fp:" + sha(canonical(json.loads(got["one"].raw)).encode())]
    assert [fps["one"].text_fp, fps["one"].figures_fp, fps["one"].manifest_fp] == want and fps["one"].bundle_fp == "bundle_fp:" + sha("|".join(want).encode())
    assert fps["two"].figures_fp == "figures_fp:" + sha(b"none")


def test_outputs_go_out_and_come_back(spark):
    document = {"initial_check": {"extractor": {"ok": True}}, "quality_check": {"review": {"done": "yes \"x\""}}, "study": {"a": {"value": 1.0, "evidence": "<q>é\n</q>", "notes": None}, "notes": "n"}, "records": [{"record_id": "r_1", "b": {"value": ["x", "y"], "evidence": None, "notes": "w"}, "c": {"value": None}}]}
    df = spark.createDataFrame([("s", json.dumps(document))], "study_id string, output string")
    cells_ = files.cells_of(df)
    got = {r.path: r for r in cells_.collect()}
    assert {p: json.loads(r.value) for p, r in got.items()} == {"study.a": 1.0, "record.r_1.b": ["x", "y"], "record.r_1.c": None, "initial_check.extractor.ok": True, "quality_check.review.done": 'yes "x"'}
    assert got["study.a"].evidence == "<q>é\n</q>" and got["study.a"].value == "1.0" and got["record.r_1.b"].notes == "w"
    back = json.loads(sinks.outputs(cells_).collect()[0].output)
    assert back["study"]["a"] == {"value": 1.0, "evidence": "<q>é\n</q>", "notes": None} and back["records"] == [{"record_id": "r_1", "b": {"value": ["x", "y"], "evidence": None, "notes": "w"}, "c": {"value": None, "evidence": None, "notes": None}}]
    assert back["initial_check"] == {"extractor": {"ok": True}} and back["quality_check"] == {"review": {"done": 'yes "x"'}}


TEMPLATE = """
study_extraction:
- section: Identity
  fields:
  - {variable: study_label, description: "Short | label", type: string, evidence: optional}
  - {variable: abstract, label: Abstract, type: string, role: summary, evidence: required}
- section: Reporting
  qa: true
  fields:
  - {variable: checklist, options: ["Yes", "No"], evidence: optional}
records:
  effect:
    description: an effect
    checker_context_fields: [gauge]
    extraction:
    - section: Gauge
      extraction_instruction: "First line.\\n\\n Second line."
      fields:
      - {variable: gauge, type: string, evidence: required, required: true, canonical_reference: gauges}
      - {variable: kind, options: [A, B], allow_other: true, evidence: required}
      - {variable: others, type: string_list, evidence: optional, canonical_reference: unnamed}
gates:
- {when_field: effect.kind, field: effect.others, allowed_values: [A]}
llm_initial_check:
- section: Initial Check
  fields: [{variable: readable, type: boolean, required: true}]
llm_quality_check:
- section: Quality Check
  fields: [{variable: remarks, type: string}]
"""


def test_configuration(spark, tmp_path):
    pytest.importorskip("yaml")
    raw = config.strict_yaml(TEMPLATE)
    template = config.parse_template(raw)
    rows = template.catalogue(spark).collect()
    assert [(r.block, r.variable, r.label, r.pos, r.qa) for r in rows][:3] == [("study", "study_label", "Study label", 0, False), ("study", "abstract", "Abstract", 1, False), ("study", "checklist", "Checklist", 2, True)]
    assert template.gates == [("kind", "others", ["A"])] and template.specimen() == "study.abstract" and template.plural == "effects"
    field = {"variable": "some_name", "type": "string", "evidence": "required"}
    for broken in ({**field, "x": 1}, {**field, "options": ["a"]}, {**field, "variable": "notes"}, {**field, "type": "text"}, {"variable": "v", "type": "string"}, {"variable": "v", "options": ["Other"], "evidence": "optional"}, {**field, "type": "integer", "canonical_reference": "l"}, {**field, "allow_other": True}, {**field, "role": "other"}):
        with pytest.raises(config.ConfigError):
            config.parse_field("study", broken)
    for change in ({"other": 1}, {"records": {"study": raw["records"]["effect"]}}, {"records": {}}, {"gates": [{"when_field": "effect.kind", "field": "effect.nope", "allowed_values": []}]}, {"study_extraction": [{"section": "a", "fields": [field, field]}]}):
        with pytest.raises(config.ConfigError):
            config.parse_template({**raw, **change})
    with pytest.raises(config.ConfigError):
        config.strict_yaml("a: 1\na: 2")
    (tmp_path / "g.yaml").write_text("label: The G List\nentries:\n- One\n- tool_name: Two\n  aliases: [t]\n")
    assert [(r.list, r.pos, r.canonical, r.aliases) for r in config.load_reference_lists(spark, str(tmp_path)).collect()] == [("g", 0, "One", []), ("g", 1, "Two", ["t"])]
    assert config.read_lists(str(tmp_path))[1] == {"g": "The G List"}


def test_settings():
    assert config.ignored_settings({"max_checks_per_field": 0, "checker_model": "m", "review_model": "r"}) == {"checker": ["checker_model"]}
    assert len(config.setting_problems({"max_tool_calls": True, "max_checks_per_field": -1, "checker_concurrency": 0, "checker_context_chars": 0})) == 3
    assert len(config.rate_problems({"extractor": {"input_per_1m": 1, "output_per_1m": -1, "cache_read_per_1m": 0, "cache_write_per_1m": True, "x": 1}, "who": {}})) == 4


def test_render():
    from veriquill.functions import render

    pytest.importorskip("yaml")
    template = config.parse_template(config.strict_yaml(TEMPLATE))
    text = render.render_template(template, "operational", {"gauges": "Gauge List"})
    assert text.startswith("# Extraction template (operational)\n\n## Study-level extraction\n\n### Identity\n\n| Field | Type / values |")
    assert "| **Study label**<br>`study_label` | Text | No | optional | Short \\| label |  |\n" in text and "_Section extraction instruction._ First line.<br>Second line.\n\n| Field" in text
    assert "Name from the Gauge List" in text and "A; B; Other (specify)" in text and "List of names from the `unnamed` reference list" in text
    assert "## Study-level quality appraisal\n\n### Reporting" in text and "Record-level quality" not in text and text.endswith("|  |\n") and text == render.render_template(template, "operational", {"gauges": "Gauge List"})
    published = render.render_template(template, "publication")
    assert "Checklist" not in published and "| Gauge | Gauge |  | Name from the `gauges` reference list |" in published
    with pytest.raises(ValueError):
        render.render_template(template, "other")
    assert render.lede("One. Two is a much longer sentence than that. Three.") == "One. Two is a much longer sentence than that." and render.lede(None) == ""
    assert render.with_references("x {reference:a} y", {"a": ["1", "2"]}) == "x - 1\n- 2 y" and render.referenced_names("{reference:a}{reference:b}{reference:a}") == ["a", "b"]
    assert render.with_partials("a\n{include_if:on:p}\n\nb {include:p} {include_if:off:p}c", {"p": " P \n"}, {"on": False, "off": True}) == "a\nb P Pc"
    with pytest.raises(KeyError):
        render.with_partials("{include:q}", {})
    assert render.fence("```") == "````\n```\n````"


def test_runs(spark, catalogue):
    from veriquill.functions.render import transcripts
    from veriquill.operators import runs

    df = spark.createDataFrame([(k,) for k in runs.ENDINGS], "outcome string")
    status, reason = runs.ending(F.col("outcome"))
    assert {(r.outcome, (r.s, r.r)) for r in df.select("outcome", status.alias("s"), reason.alias("r")).collect()} == set(runs.ENDINGS.items())
    with pytest.raises(Exception, match="unknown outcome"):
        spark.range(1).select(runs.ending(F.lit("x"))[0]).collect()
    rows = [("s", None, "design", '"RCT"', "words"), ("s", None, "year", "null", "words"), ("s", None, "summary", '"x"', " "), ("s", "r_1", "n", "1", "<q>a</q>"), ("s", None, "who", "1", "w")]
    made = spark.createDataFrame([("s", "record.r_1.n", 2)], "study_id string, path string, checks int")
    assert [(r.path, r.check_index) for r in runs.checkable(cells(spark, rows), catalogue, made, 2).collect()] == [("study.design", 1)]
    pairs = spark.createDataFrame([("An abstract", "an  ABSTRACT of it", True), ("alpha beta", "zzz", False), ("", "x", True), ("the same words", "the same word s", True)], "a string, b string, want boolean")
    assert all(r.got == r.want for r in pairs.select("*", runs.summaries_match(F.col("a"), F.col("b")).alias("got")).collect())
    events = spark.createDataFrame([("s", 1, "assistant_message", 1, None, "m", "end", None), ("s", 2, "assistant_text", 1, None, "t. u", None, None), ("s", 3, "review_tool_call", 2, "view", None, None, "{}")], "session_id string, line_no long, event string, turn_id long, tool string, text string, stop_reason string, result string")
    assert {(r.turn_id, r.text, r.stop_reason) for r in runs.turn_texts(events).collect()} == {(1, "t. u", "end"), (2, "", None)}
    text = transcripts(events).collect()[0].transcript
    assert text.index("### Turn 1") < text.index("## 3. The review") < text.index("### Turn 2") < text.index("Call 1. `view`") and "t. u" in text
    answers = spark.createDataFrame([("ok", None, "r"), (None, "timeout", None)], "verdict string, error string, rationale string")
    assert {(r.verdict, r.error_origin, r.rationale) for r in runs.verdicts(answers).collect()} == {("ok", False, "r"), ("challenge", True, "timeout")}
    words = spark.createDataFrame([(None, False, 0, 0), (None, False, 5, 0), (1.0, False, 5, 0), (1.0, True, 5, 2)], "c double, i boolean, t long, u long").select(runs.role_cost_text(F.col("c"), F.col("i"), F.col("t"), F.col("u")).alias("w"))
    assert [r.w for r in words.collect()] == ["no calls", "not priced", "$1.0000", "at least $1.0000 (2 calls without a price)"]


def test_containment_is_brute_force(spark):
    r = random.Random(6)
    words = ["a", "bb", "ccc", "dd", "e", "ff"]
    docs = [(k, " ".join(r.choice(words) for _ in range(40))) for k in range(30)] + [(100, ""), (101, "x")]
    passages = [(k, docs[k % 30][1][r.randrange(20) :][: r.randint(1, 40)]) for k in range(60)] + [(200, "zz yy xx ww vv uu tt ss"), (201, "a")]
    got = containment.contained(spark.createDataFrame(passages, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((i, k, t.index(p)) for i, p in passages for k, t in docs if p in t and p.strip())


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("select locate_quote('B c', 'a b c').tier, normalise_quote(' A  b'), canonical_json('{\"b\": 1, \"a\": \"é\"}'), seq_ratio('ab', 'ab')").collect()[0] == ("case_folded", "a b", '{"a":"\\u00e9","b":1}', 1.0)


def test_structure_of_outputs(spark):
    document = {"study": {"a": 3, "b": {"value": 1, "evidence": 5, "notes": []}, "c": {"value": "x", "evidence": None}, "d": None, "notes": 7}, "records": [{"record_id": "r_1", "notes": {"x": 1}, "e": ["no"]}], "quality_check": {"review": "no", "extractor": {}}}
    got = {(r.path, r.code) for r in files.structure_problems(spark.createDataFrame([("s", json.dumps(document)), ("t", "{}")], "study_id string, output string")).collect()}
    assert got == {
        ("study.a", "not_an_envelope"), ("study.d", "not_an_envelope"), ("study.b.evidence", "type_mismatch"), ("study.b.notes", "type_mismatch"), ("study.notes", "type_mismatch"), ("record.r_1.notes", "type_mismatch"),
        ("record.r_1.e", "not_an_envelope"), ("quality_check.review", "not_a_role_block"),
    }


def test_driver_side_hashes(spark):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert identity.tool_set_hash([{"b": 1, "a": "é"}]) == sha(b'[{"a":"\\u00e9","b":1}]') and identity.texts_hash({"b": "x", "a": "y"}) == sha(b'{"a":"y","b":"x"}')
    df = spark.createDataFrame([("b.py", bytearray(b"2")), ("a.py", bytearray(b"1"))], "path string, content binary").repartition(2)
    assert identity.tree_hash(df).collect()[0].hash == sha(b"a.py\x001b.py\x002")


def test_schemas():
    schema = lambda **f: config.value_schema({"options": None, "allow_other": False, **f})
    assert schema(field_type="boolean") == {"type": "boolean"} and schema(field_type="year") == {"type": ["integer", "null"]}
    assert schema(field_type="categorical", options=["A"]) == {"enum": ["A", None]} and schema(field_type="categorical", options=["A"], allow_other=True) == {"type": ["string", "null"]}
    assert config.envelope_schema({"field_type": "string_list", "options": None, "allow_other": False})["properties"]["value"] == {"type": ["array", "null"], "items": {"type": "string"}}


def test_numbered_lines_follow_files_whatever_the_splits(spark, tmp_path):
    r = random.Random(2)
    want = {}
    for name in ("a", "b"):
        rows = ["" if r.random() < 0.1 else f"{name} {k} " + "x" * r.randint(0, 40) for k in range(3000)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(rows) + "\n", encoding="utf-8")
        want |= {(name, k): row for k, row in enumerate(rows) if row}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {(row.file[-7:-6], row.line_no): row.text for row in files.numbered_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


def test_checks_are_numbered_over_long_sessions(spark, monkeypatch):
    from veriquill.operators import runs

    monkeypatch.setattr(runs, "LINES_TOGETHER", 7)
    rows = [(f"s{k % 2}", k, f"p{k % 5}") for k in range(100)]
    got = sorted(map(tuple, runs.ordinals(spark.createDataFrame(rows, "session_id string, line_no long, path string")).collect()))
    n, m, want = Counter(), Counter(), []
    for s, k, p in rows:
        n[s] += 1
        m[s, p] += 1
        want.append((s, k, p, n[s], m[s, p]))
    assert got == sorted(want)


def test_short_passages_are_no_hot_key(spark, monkeypatch):
    """Passages of one and two words are found inside words too, and a text offers no row for each of its words."""
    monkeypatch.setattr(containment, "LIST", 2)
    passages = spark.createDataFrame([(1, "cat"), (2, "at on"), (3, "the cat sat on the mat"), (4, "zzz"), (5, "a"), (6, " "), (7, "the cat sat")], "item_id long, text string")
    texts = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "concatenate"), (3, "word " * 1000), (4, None)], "doc_id long, text string")
    got = {tuple(x) for x in containment.contained(passages, texts).collect()}
    plain = {(i, d, t.find(p)) for i, p in ((x.item_id, x.text) for x in passages.collect()) for d, t in ((x.doc_id, x.text) for x in texts.collect()) if t and p.strip() and p in t}
    assert got == plain


def test_rates_and_merged_yaml():
    card = dict.fromkeys(config.RATES, 1.0)
    assert config.rate_problems({"extractor": card | {"cache_write_1h_per_1m": None}}) == []
    for wrong in (None, {}, [], "x", {"extractor": None}, {"extractor": "x"}, {"extractor": card | {"input_per_1m": None}}, {"extractor": card | {"input_per_1m": True}}, {"nobody": card}, {"extractor": card | {"input_per_1m": -1}}):
        assert config.rate_problems(wrong)
    assert config.strict_yaml("a: &a {x: 1}\nb: &b {y: 2}\nc:\n  <<: *a\n  <<: *b\n  z: 3\n")["c"]["z"] == 3
    with pytest.raises(config.ConfigError):
        config.strict_yaml("a: 1\nb: 2\na: 3\n")


def test_envelopes(spark, catalogue, entries):
    """Everything that is known of a cell in one row: what is stored, what is wrong, what was replaced, what stands in the text loosely."""
    rows = [
        ("s", "r_1", "gauge", '"sg"', "<q>448 PATIENTS</q>"),
        ("s", "r_2", "gauge", '"nothing"', "<q>449 patients</q>"),
        ("s", "r_3", "gauges", '["lc", "THIRD"]', None),
        ("s", None, "year", "1999.0", "<q>used [...] cohort</q>"),
        ("s", None, "nobody", "1", None),
        ("s", None, "design", "3", None),
    ]
    papers = spark.createDataFrame([("s", TEXT)], "study_id string, text string")
    labels = spark.createDataFrame([("s", "Table_1")], "study_id string, label string")
    got = {r.path: r for r in values.envelopes(cells(spark, rows), catalogue, entries, papers, labels).collect()}
    codes = lambda p: [e.code for e in got[p].errors]
    first = got["record.r_1.gauge"]
    assert (first.value_out, first.errors, [tuple(c) for c in first.canonicalisations]) == ('"Strain – Gauge"', [], [("record.r_1.gauge", "sg", "Strain – Gauge")])
    assert [tuple(w) for w in first.weak_matches] == [("record.r_1.gauge.evidence[<q>0]", "448 PATIENTS", "case_folded")]
    assert codes("record.r_2.gauge") == ["off_list_reference", "quote_not_in_text"] and got["record.r_2.gauge"].value_out == '"nothing"'
    assert "448 patients" in got["record.r_2.gauge"].errors[1].message and "nearest" in got["record.r_2.gauge"].errors[0].message
    assert json.loads(got["record.r_3.gauges"].value_out) == ["Load Cell", "Third"] and got["record.r_3.gauges"].errors == []
    assert got["study.year"].value_out == "1999" and "another order" in got["study.year"].errors[0].message
    assert codes("study.nobody") == ["unknown_field"] and codes("study.design") == ["type_mismatch", "evidence_required"]


def test_texts_move_once_for_many_quotes(spark, monkeypatch):
    monkeypatch.setattr(evidence, "QUOTES_TOGETHER", 10)
    quotes = spark.createDataFrame([("s", f"word {k}", k) for k in range(95)] + [("t", "nowhere", 1)], "study_id string, quote string, k long")
    papers = spark.createDataFrame([("s", " ".join(f"word {k}" for k in range(90)))], "study_id string, text string")
    assert evidence.with_texts(quotes, papers).count() == 11
    found = {(r.study_id, r.k): r.found.matched for r in evidence.located(quotes, papers).collect()}
    assert len(found) == 96 and all(found["s", k] for k in range(90)) and not found["t", 1] and not found["s", 94]
    long = spark.createDataFrame([("s", None, "study.x", "<q>" + "W" * 130 + "</q>")], "study_id string, block string, path string, evidence string")
    (weak,) = evidence.weak_matches(long, spark.createDataFrame([("s", "w" * 130)], "study_id string, text string")).collect()
    assert weak.quote == "W" * 120 + "..."


def test_suggestions_are_those_of_all_pairs(spark, entries):
    from difflib import SequenceMatcher

    r = random.Random(4)
    names = [("".join(r.choice("abc ") for _ in range(r.randint(1, 9))), "".join(r.choice("abc") for _ in range(r.randint(1, 9)))) for _ in range(60)]
    for _ in range(60):
        form = "".join(r.choice("abc ") for _ in range(r.randint(0, 9)))
        best = {}
        for c, other in names:
            best[c] = max(best.get(c, 0), SequenceMatcher(None, form, other).ratio())
        assert [c for _, c in arrow._nearest_names(form, names, 5)] == sorted(best, key=lambda c: (-best[c], c))[:5]


def test_streamed_histories_are_the_batch_ones(spark, tmp_path):
    """A log that comes in four files, removals and all: the same events of the same fields in the same order."""
    from veriquill.streaming.history import TOLD, running_histories, written

    r = random.Random(19)
    paths = ["study.a", "record.r_1.x", "record.r_1.y", "record.r_2.x"]
    some = lambda: r.sample(paths, r.randint(0, 3))
    rows = []
    for k in range(120):
        result = {"_field_diffs": {p: {"before": r.choice([1, "1", None]), "after": r.choice([1, "1", None])} for p in some()}, "failed_fields": {p: [{"code": "c"}] for p in some()[:1]}}
        result["_checker_verdicts"] = {p: {"verdict": r.choice(["ok", "challenge"]), "error_origin": r.random() < 0.2} for p in some()}
        if r.random() < 0.2:
            result["applied_changes"] = {"removed_record_id": r.choice(["r_1", "r_2"])}
        rows.append((f"s{k % 2}", k, r.choice(list(history.STAGES)), str(k), k, "t", json.dumps(result)))
    events = spark.createDataFrame(rows, "session_id string, line_no long, event string, ts string, turn_id long, tool string, result string")
    for k in range(4):
        events.where(f"line_no >= {30 * k} and line_no < {30 * k + 30}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = written(running_histories(history.told_steps(stream)), TOLD).drop("batch").collect()
    columns_of = [c.split()[0] for c in TOLD.split(", ")]
    want = history.history(history.steps(events)).select(*columns_of).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want)) and len(got) > 300


def test_histories_are_written_line_by_line(spark, tmp_path):
    """A session's file is its document, whole and in order, though no row of it holds more than a field."""
    from veriquill.plans import worked

    rows = [(i, i % 40, kind, f"2024-01-01 00:00:{i % 60:02d}") for i, kind in enumerate(["purchase", "view", "click", "signup", "error"] * 60)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string")
    steps = history.steps(worked.typed_log_of(events))
    whole = {r.session_id: r.history for r in history.documents(steps).collect()}
    lines = history.document_lines(steps)
    longest = max(len(r.line) for r in lines.collect())
    sinks.write_histories(lines, f"{tmp_path}/h")
    files = {f.parent.name.split("=")[1]: f.read_text() for f in tmp_path.glob("h/session_id=*/part-*")}
    assert set(files) == set(whole) and {s: json.dumps(json.loads(t)) for s, t in files.items()} == {s: json.dumps(json.loads(t)) for s, t in whole.items()}
    assert longest * 2 < max(map(len, whole.values()))
