"""The whole validation of stored outputs: every cell of every study, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriquill.operators import evidence, values


def sweep(cells: DataFrame, catalogue: DataFrame, entries: DataFrame, gates: DataFrame, papers: DataFrame | None = None, labels: DataFrame | None = None, producer: str = "llm") -> DataFrame:
    """(study_id, path, code, message, severity). `producer` is llm (evidence is owed) or human (it is only looked up, if texts are given).

    Without texts, llm evidence is checked for all that does not need one.
    """
    if producer not in ("llm", "human"):
        raise ValueError(f"unknown producer {producer!r}")
    checked = values.checked(cells, catalogue)
    flat = lambda df: df.select("study_id", F.explode("errors").alias("e")).select("study_id", "e.path", "e.code", "e.message")
    referenced = values.referenced(checked, entries)
    found = values.problem_rows(checked, "study_id").unionByName(flat(referenced))
    if papers is not None or producer == "llm":
        spark = cells.sparkSession
        texts = papers if papers is not None else spark.createDataFrame([], "study_id string, text string")
        known = labels if labels is not None else spark.createDataFrame([], "study_id string, label string")
        spoken = evidence.evidence_problems(checked.where("known and block in ('study', 'record')"), texts, known, required=producer == "llm")
        if papers is None:
            spoken = spoken.where("code not in ('quote_not_in_text', 'unknown_image_label')")
        found = found.unionByName(spoken)
    warnings = values.gate_warnings(cells, gates).select("study_id", F.col("field").alias("path"), "code", "message", F.lit("warning").alias("severity"))
    return found.withColumn("severity", F.lit("error")).unionByName(warnings)
