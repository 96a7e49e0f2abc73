"""A corpus for training in five stages, each an operator of veriquill.llm over all that the stage before kept.

Toxic documents go; of each group of near duplicates the document with the smallest id stays; personal data is replaced by
its kind; what is left is laid out by target shares of the sources; and packed into sequences. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veriquill.llm import mixing, packing, pii, simhash, toxicity
from veriquill.llm.common import removed, shared_folder, table
from veriquill.llm.queries import BYTE_BPE_SPECIAL, SOURCE_WEIGHTS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels, does not reject. A null text is kept."""
    return toxicity.keep_clean(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash links: the one with the smallest id. Null and empty texts are one component."""
    return simhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced in its text and n_chars counted anew."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the mixture; null texts have no bytes."""
    return mixing.mix(docs, SOURCE_WEIGHTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 ids; the sequences follow the order in which docs was laid out.

    A null or empty text is one end id; repeated rows are packed as often as they come; no rows give no pieces.
    """
    import public_tokenizers

    return packing.pack(mixing.ranked(docs.select("doc_id", "text")), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, BYTE_BPE_SPECIAL, rank_col="mix_rank")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express these stages. tests/llm holds the operators against brute force, and the stages against the operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again.

    A stage's folder goes when the next one stands, so that at most two are there at a time; the last stays, as the result
    is read from it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            removed(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
