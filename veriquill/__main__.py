"""The command line: extract, validate, validate-bundle, render-template, fingerprint, transcript."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veriquill import api
from veriquill.functions import render
from veriquill.operators import history, identity, lists, log, records, replay
from veriquill.sources import files, sinks
from veriquill.sources.config import ConfigError, reference_entries


def session() -> SparkSession:
    spark = SparkSession.builder.appName("veriquill").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def validate(args) -> int:
    """Stored outputs, one JSON document a file, the file's name being the study; 1 if anything is wrong."""
    spark = session()
    outputs = spark.read.text(args.outputs, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("study_id"), F.col("value").alias("output"))
    papers = files.papers(spark, args.papers) if args.papers else None
    labels = papers.select("study_id", F.explode("exhibits.label").alias("label")) if papers is not None else None
    found = api.validate_extraction_output(outputs, api.load_config_bundle(args.config), papers.select("study_id", "text") if papers is not None else None, labels, args.producer)
    wrong = False
    for r in found.orderBy("study_id", "severity", "path", "code").toLocalIterator():  # a partition at a time
        print(f"{r.severity}\t{r.study_id}\t{r.path}\t{r.code}\t{r.message}")
        wrong = wrong or r.severity == "error"
    return int(wrong)


def validate_bundle(args) -> int:
    wrong = False
    for r in files.bundle_problems(files.papers(session(), args.papers)).orderBy("bundle").toLocalIterator():
        print(f"{r.bundle}\t{r.code}")
        wrong = True
    return int(wrong)


def render_template(args) -> int:
    bundle = api.load_config_bundle(args.config)
    sys.stdout.write(render.render_template(bundle.template, args.view, bundle.labels))
    return 0


def fingerprint(args) -> int:
    spark, bundle = session(), api.load_config_bundle(args.config)
    print("template", identity.catalogue_hash(bundle.template.catalogue(spark)).collect()[0].hash)
    if bundle.lists:
        print("references", identity.reference_hash(reference_entries(spark, bundle.lists)).collect()[0].hash)
    return 0


def transcript(args) -> int:
    spark = session()
    events = files.events(files.numbered_lines(spark, args.log))
    named = events.withColumn("session_id", F.regexp_extract("file", r"([^/]+)\.jsonl$", 1))
    documents = history.documents(history.steps(named))
    for r in render.transcripts(named, histories=documents).orderBy("session_id").toLocalIterator():
        (Path(args.out) / f"{r.session_id}.md").write_text(r.transcript, encoding="utf-8") if args.out else sys.stdout.write(r.transcript)
    return 0


def extract(args) -> int:
    """Calls that a model made (JSON lines), carried out over the papers: outputs by study in the folder `out`; 1 if any study lacks something."""
    spark, bundle = session(), api.load_config_bundle(args.config)
    papers = log.first_of(files.papers(spark, args.papers).where("study_id is not null and text is not null"), ["study_id"], "bundle")  # a study is done once
    calls = spark.read.schema(replay.CALL).json(args.calls).join(papers.select("study_id"), "study_id", "left_semi")
    labels = papers.select("study_id", F.explode("exhibits.label").alias("label"))
    entries = reference_entries(spark, bundle.lists) if bundle.lists else spark.createDataFrame([], lists.ENTRY)
    catalogue = bundle.template.catalogue(spark)
    cells, outcomes = replay.carried_out(calls, catalogue, entries, papers.select("study_id", "text"), labels, bundle.template.entity)
    sinks.outputs(cells).write.mode("overwrite").json(f"{args.out}/outputs")
    outcomes.write.mode("overwrite").json(f"{args.out}/calls")
    wrong = False
    for r in records.completion_problems(cells, catalogue, papers.select("study_id")).orderBy("study_id", "code", "path").toLocalIterator():
        print(f"{r.study_id}\t{r.code}\t{r.path or ''}")
        wrong = True
    return int(wrong)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veriquill", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for f, options in ((extract, ("config", "papers", "calls", "out")), (validate, ("config", "outputs", "papers?", "producer=llm")), (validate_bundle, ("papers",)), (render_template, ("config", "view=operational")), (fingerprint, ("config",)), (transcript, ("log", "out?"))):
        command = commands.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        for o in options:
            name, _, default = o.rstrip("?").partition("=")
            command.add_argument(f"--{name}" if o.endswith("?") or default else name, default=default or None)
        command.set_defaults(run=f)
    args = parser.parse_args(argv)
    try:
        return args.run(args)
    except (ConfigError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
