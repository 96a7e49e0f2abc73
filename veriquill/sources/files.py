"""Readers of papers, logs and run tables. Schemas are declared; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "schema_version int, id string, title string, doi string, summary string, exhibits array<struct<label:string,caption:string,notes:string>>"
EVENT = "ts string, event string, turn_id long, tool string, tool_use_id string, stage string, text string, message string"
RUN = "session_id string, study_id string, status string, updated_at string, dir string, config_fp string, checker_fp string, review_fp string"


def _folder(path: str = "_metadata.file_path") -> Column:
    return F.regexp_extract(F.col(path), r"^(.*)/[^/]+$", 1)


def papers(spark: SparkSession, root: str) -> DataFrame:
    """One row a bundle under root: its folder, manifest, text, and figures by label."""
    manifest = spark.read.text(f"{root}/*/manifest.json", wholetext=True).select(_folder().alias("folder"), F.col("value").alias("raw")).withColumn("m", F.from_json("raw", MANIFEST))
    text = spark.read.format("binaryFile").load(f"{root}/*/text.md").select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("place"), "content")
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    rows = manifest.withColumn("bundle", name("folder")).join(text.withColumn("bundle", name("place")), "bundle", "left")
    return rows.select(F.col("m.id").alias("study_id"), "bundle", "m.title", "m.doi", "m.summary", "m.exhibits", "raw", "content", F.decode("content", "UTF-8").alias("text"))


def figures(spark: SparkSession, root: str) -> DataFrame:
    """(bundle, label, content, length) of every figure file."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(root)
    return rows.select(F.regexp_extract("path", r"([^/]+)/(?:figures/)?[^/]+$", 1).alias("bundle"), F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("label"), "content", "length")


def bundle_problems(papers: DataFrame) -> DataFrame:
    """(bundle, code): bundles that cannot be read, and those whose study id is not theirs alone."""
    shared = papers.where("study_id is not null").groupBy("study_id").agg(F.count("*").alias("n")).where("n > 1")
    both = papers.join(shared, "study_id", "left")
    code = F.when(F.col("study_id").isNull(), "manifest_unreadable").when(F.col("content").isNull(), "text_missing").when(F.col("n") > 1, "study_id_repeated")
    return both.withColumn("code", code).where("code is not null").select("bundle", "code")


def numbered_lines(spark: SparkSession, paths: str) -> DataFrame:
    """(file, line_no, text) of the lines of text files that are not empty, numbered from 0 in their file.

    Files are read in splits. A line's number is that of the first line of its split, from the lines of the splits before
    it, and its place in the split; only counts of splits are shuffled.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.withColumn("shift", before - F.col("first")).select("file", "block", "shift")
    return lines.where("text <> ''").join(splits, ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("line_no"), "text")


def events(lines: DataFrame, schema: str = EVENT) -> DataFrame:
    """Lines of an event log with their known keys as columns, and args and result as JSON text."""
    parsed = lines.withColumn("e", F.from_json("text", schema, {"mode": "FAILFAST"})).select("file", "line_no", F.col("text").alias("raw"), "e.*")
    return parsed.withColumn("args", F.get_json_object("raw", "$.args")).withColumn("result", F.get_json_object("raw", "$.result"))


def wire_log(spark: SparkSession, paths: str, schema: str) -> DataFrame:
    """Calls as logged; lines that are no JSON are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def run_log(spark: SparkSession, path: str, schema: str = RUN) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def in_progress(runs: DataFrame, study_id: str) -> DataFrame:
    """Open runs of a study; both conditions reach the scan."""
    return runs.where((F.col("status") == "in_progress") & (F.col("study_id") == study_id))


def cells_of(outputs: DataFrame) -> DataFrame:
    """Stored outputs (study_id, output JSON) in long form: one row for each field of the study, records and check blocks.

    Values stay JSON text, so that 1 and 1.0 are told apart. Bare notes are no fields.
    """
    part = lambda name, kind: F.from_json(F.get_json_object("output", f"$.{name}"), kind)
    filled = _envelopes(outputs).where(F.col("is_envelope") & F.col("has_value")).select("study_id", "block", "record_id", "role", "variable", "path", json_value("cell").alias("value"), _text_of("evidence").alias("evidence"), _text_of("notes").alias("notes"))
    for block in ("initial_check", "quality_check"):
        roles = bare_answers(outputs.select("study_id", F.explode(part(block, "map<string,string>")).alias("role", "answers")), "answers")
        nothing = [F.lit(None).cast("string").alias(c) for c in ("evidence", "notes")]
        filled = filled.unionByName(roles.select("study_id", F.lit(block).alias("block"), F.lit(None).cast("string").alias("record_id"), "role", "variable", F.concat_ws(".", F.lit(block), "role", "variable").alias("path"), "value", *nothing))
    return filled


def bare_answers(df: DataFrame, answers: str) -> DataFrame:
    """df with variable and value for each entry of a JSON object of bare values, in place of it; values are JSON text."""
    rest = [c for c in df.columns if c != answers]
    rows = df.withColumn("kinds", F.from_json(answers, "map<string,variant>")).select(*rest, "kinds", F.explode(F.from_json(answers, "map<string,string>")).alias("variable", "value"))
    is_text = F.schema_of_variant(F.col("kinds")[F.col("variable")]) == "STRING"  # a text may read like a number or a truth value
    bare = F.when(F.col("value").isNull(), "null").when(is_text, F.regexp_extract(F.to_json(F.array("value")), r"(?s)^\[(.*)\]$", 1)).otherwise(F.col("value"))
    return rows.select(*rest, "variable", bare.alias("value"))


def json_value(cell: str) -> Column:
    """The value of an envelope as JSON text, strings quoted as in the source."""
    kept = F.from_json(F.col(cell), "struct<value:variant>")["value"]
    text = F.get_json_object(cell, "$.value")
    is_text = F.schema_of_variant(kept) == "STRING"
    return F.when(text.isNull(), "null").when(is_text, F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)).otherwise(text)


def envelope_parts(cell: str) -> tuple[Column, Column]:
    """The evidence and the notes of an envelope, each null if it is no string."""
    parsed = F.from_json(F.col(cell), "struct<evidence:variant,notes:variant>")
    text = lambda part: F.when(F.schema_of_variant(part) == "STRING", part.cast("string"))
    return text(parsed["evidence"]), text(parsed["notes"])


def _envelopes(outputs: DataFrame) -> DataFrame:
    """Every field of study and records with its raw cell, parsed as far as it is an envelope."""
    nothing = F.lit(None).cast("string")
    study = outputs.select("study_id", F.explode(F.from_json(F.get_json_object("output", "$.study"), "map<string,string>")).alias("variable", "cell")).where("variable <> 'notes'")
    study = study.select("study_id", F.lit("study").alias("block"), nothing.alias("record_id"), nothing.alias("role"), "variable", F.concat(F.lit("study."), "variable").alias("path"), "cell")
    records = _records(outputs).select("study_id", "record_id", F.explode(F.from_json("record", "map<string,string>")).alias("variable", "cell")).where("variable not in ('record_id', 'notes')")
    records = records.select("study_id", F.lit("record").alias("block"), "record_id", nothing.alias("role"), "variable", F.concat(F.lit("record."), "record_id", F.lit("."), "variable").alias("path"), "cell")
    cells = study.unionByName(records).withColumn("cell", F.coalesce("cell", F.lit("null")))
    is_envelope = F.coalesce(F.schema_of_variant(F.try_parse_json("cell")).startswith("OBJECT"), F.lit(False))
    has_value = F.coalesce(F.array_contains(F.json_object_keys("cell"), "value"), F.lit(False))
    return cells.withColumn("is_envelope", is_envelope).withColumn("has_value", has_value).withColumn("e", F.when(F.col("is_envelope"), F.from_json("cell", "struct<value:variant,evidence:variant,notes:variant>")))


def _records(outputs: DataFrame) -> DataFrame:
    return outputs.select("study_id", F.explode(F.from_json(F.get_json_object("output", "$.records"), "array<string>")).alias("record")).withColumn("record_id", F.get_json_object("record", "$.record_id"))


def _text_of(name: str) -> Column:
    """A part of an envelope if it is a string."""
    kind = F.schema_of_variant(F.col(f"e.{name}"))
    return F.when(kind == "STRING", F.col(f"e.{name}").cast("string"))


def _no_text(value: Column) -> Column:
    """Whether a variant is there and neither a string nor null."""
    return F.coalesce(~F.schema_of_variant(value).isin("STRING", "VOID"), F.lit(False))


def structure_problems(outputs: DataFrame) -> DataFrame:
    """(study_id, path, code, message): cells that are no envelopes or have no value, evidence and notes that are no text, roles that hold no answers."""
    row = lambda path, code, message: ["study_id", path.alias("path"), F.lit(code).alias("code"), F.lit(message).alias("message")]
    cells = _envelopes(outputs)
    found = cells.where(~F.col("is_envelope")).select(*row(F.col("path"), "not_an_envelope", "a field is an object of value, evidence and notes"))
    whole = cells.where("is_envelope and has_value")
    bare = cells.where("is_envelope and not has_value").select(*row(F.concat("path", F.lit(".value")), "missing_key", "the object has no value"))
    note = lambda c: F.from_json(c, "struct<notes:variant>")["notes"]
    parts = [whole.where(_no_text(F.col(f"e.{name}"))).select(*row(F.concat("path", F.lit(f".{name}")), "type_mismatch", f"{name} must be text")) for name in ("evidence", "notes")]
    study = outputs.where(_no_text(note(F.get_json_object("output", "$.study")))).select(*row(F.lit("study.notes"), "type_mismatch", "notes must be text"))
    records = _records(outputs).where(_no_text(note(F.col("record")))).select(*row(F.concat(F.lit("record."), "record_id", F.lit(".notes")), "type_mismatch", "notes must be text"))
    for part in (bare, study, records, *parts):
        found = found.unionByName(part)
    for block in ("initial_check", "quality_check"):
        roles = outputs.select("study_id", F.explode(F.from_json(F.get_json_object("output", f"$.{block}"), "map<string,string>")).alias("role", "answers"))
        holds = F.coalesce(F.schema_of_variant(F.try_parse_json("answers")).startswith("OBJECT"), F.lit(False))
        found = found.unionByName(roles.where(~holds).select(*row(F.concat_ws(".", F.lit(block), "role"), "not_a_role_block", "a role holds answers by name")))
    return found
