import json

import pytest

from veriquill import __main__ as cli
from veriquill import api
from veriquill.sources.config import ConfigError

from .test_operators import TEMPLATE

pytest.importorskip("yaml")


@pytest.fixture
def review(tmp_path):
    root = tmp_path / "config"
    (root / "reference").mkdir(parents=True)
    (root / "extraction_template.yaml").write_text(TEMPLATE)
    (root / "reference" / "gauges.yaml").write_text("label: Gauges\nlist:\n- tool_name: Load Cell\n  aliases: [LC]\n")
    (root / "reference" / "unnamed.yaml").write_text("- One\n")
    (root / "pipeline.yaml").write_text("max_tool_calls: 10\nmax_checks_per_field: 2\n")
    paper = tmp_path / "papers" / "p1"
    paper.mkdir(parents=True)
    (paper / "manifest.json").write_text(json.dumps({"id": "p1", "title": "T", "exhibits": []}))
    (paper / "text.md").write_text("A load cell was used in all trials.")
    outputs = tmp_path / "outputs"
    outputs.mkdir()
    document = {"study": {"abstract": {"value": "x", "evidence": "<q>all trials</q>"}}, "records": [{"record_id": "effect_1", "gauge": {"value": "LC", "evidence": "<q>no such words</q>"}, "kind": {"value": "B", "evidence": "<q>A load cell</q>"}, "others": {"value": ["One"]}}]}
    (outputs / "p1.json").write_text(json.dumps(document))
    return tmp_path


def test_config_bundle(review):
    bundle = api.load_config_bundle(str(review / "config"))
    assert bundle.labels == {"gauges": "Gauges"} and bundle.template.entity == "effect"
    (review / "config" / "reference" / "unnamed.yaml").unlink()
    (review / "config" / "pipeline.yaml").write_text("max_tool_calls: 0\n")
    with pytest.raises(ConfigError, match="max_tool_calls.*unnamed"):
        api.load_config_bundle(str(review / "config"))


def test_prompts_of_a_configuration(review):
    folder = review / "config" / "prompts"
    (folder / "partials").mkdir(parents=True)
    for name in ("extractor_system", "review_system"):
        (folder / f"{name}.md").write_text("Read.\n{include_if:review:more}\n\nEnd {reference:gauges}")
    (folder / "partials" / "more.md").write_text("A review follows.\n")
    with pytest.raises(ConfigError, match="checker_system is missing"):
        api.load_config_bundle(str(review / "config"))
    (folder / "checker_system.md").write_text("Check.")
    bundle = api.load_config_bundle(str(review / "config"))
    assert bundle.composed()["extractor_system"] == "Read.\nA review follows.\n\nEnd {reference:gauges}"
    (review / "config" / "pipeline.yaml").write_text("final_review: false\n")
    assert api.load_config_bundle(str(review / "config")).composed()["extractor_system"] == "Read.\nEnd {reference:gauges}"


def test_validate_value(spark):
    spec = {"variable": "gauge", "field_type": "string", "canonical_reference": "gauges", "evidence": "required"}
    lists = {"gauges": [{"tool_name": "Load Cell", "aliases": ["LC"]}]}
    fine = api.validate_value(spark, spec, "lc", lists, "human")
    assert (fine.ok, fine.value, fine.canonicalisations) == (True, "Load Cell", [{"path": "value", "entered": "lc", "stored": "Load Cell"}])
    owed = api.validate_value(spark, spec, "LC", lists, "llm", evidence_text="words")
    assert [e["code"] for e in owed.errors] == ["evidence_required"]
    assert api.validate_value(spark, spec, "LC", lists, "llm", evidence_text="<q>not looked up</q>").ok
    quoted = api.validate_value(spark, spec, "LC", lists, "human", evidence_text="<q>nowhere</q>", paper_text="text")
    assert [e["code"] for e in quoted.errors] == ["quote_not_in_text"]
    assert [e["code"] for e in api.validate_value(spark, spec, "x", None).errors] == ["reference_unavailable"]
    year = api.validate_value(spark, {"variable": "y", "field_type": "year"}, 1999.0)
    assert year.ok and year.value == 1999 and isinstance(year.value, int)
    gate = api.validate_value(spark, {"variable": "n", "field_type": "integer"}, 3, sibling_values={"n": {"value": 3}, "kind": "B"}, gates=[("kind", "n", ["A"])])
    assert gate.ok and [(w["path"], w["code"]) for w in gate.warnings] == [("n", "category_gate")]
    with pytest.raises(ValueError):
        api.validate_value(spark, spec, "x", producer="other")


def test_command_line(spark, review, capsys):
    run = lambda *a: (cli.main([str(x) for x in a]), capsys.readouterr().out)
    code, out = run("validate", review / "config", review / "outputs", "--papers", review / "papers")
    assert code == 1 and {line.rpartition("\t")[0] for line in out.splitlines()} == {"error\tp1\trecord.effect_1.gauge.evidence[<q>0]\tquote_not_in_text", "warning\tp1\tothers\tcategory_gate"}
    assert run("validate-bundle", review / "papers") == (0, "")
    calls = [
        {"study_id": "p1", "call_id": "a", "seq": 1, "tool": "update_study", "fields": {"abstract": {"value": "x", "evidence": "<q>all trials</q>"}}},
        {"study_id": "p1", "call_id": "b", "seq": 2, "tool": "add_record", "fields": {"gauge": {"value": "lc", "evidence": "<q>A load cell</q>"}}},
        {"study_id": "nobody", "call_id": "c", "seq": 3, "tool": "add_record", "fields": {"gauge": {"value": "lc"}}},
    ]
    (review / "calls.jsonl").write_text("\n".join(map(json.dumps, calls)) + "\n")
    code, out = run("extract", review / "config", review / "papers", review / "calls.jsonl", review / "made")
    written = [json.loads(x) for p in (review / "made" / "outputs").glob("*.json") for x in p.read_text().splitlines()]
    (document,) = [json.loads(w["output"]) for w in written]
    assert document["study"]["abstract"]["value"] == "x" and [(r["record_id"], r["gauge"]["value"]) for r in document["records"]] == [("effect_1", "Load Cell")]
    code, out = run("render-template", review / "config", "--view", "publication")
    assert code == 0 and "Name from the Gauges" in out
    code, out = run("fingerprint", review / "config")
    assert code == 0 and len(out.splitlines()) == 2
    (review / "s1.jsonl").write_text('{"event": "assistant_text", "turn_id": 1, "text": "Hello there."}\n')
    code, out = run("transcript", review / "s1.jsonl")
    assert code == 0 and out.startswith("# Session s1") and "Hello there." in out
    assert run("render-template", review / "nowhere")[0] == 2
