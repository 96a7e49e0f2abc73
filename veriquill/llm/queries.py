"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriquill.llm.common import table

#: The special string of byte_bpe_50k.json, which tokenizers finds inside texts.
BYTE_BPE_SPECIAL = {"<|endoftext|>": 50256}


#: Target shares of the sources in hundredths; sources without a share of their own are pooled.
SOURCE_WEIGHTS = {"src0": 20, **{f"src{i}": 4 for i in range(1, 20)}, "*": 4}


def op1_pfair_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriquill.llm.mixing import schedule

    docs = table(spark, sf_dir, "documents")
    columns = {"mix_source": "queue", "mix_bytes": "n_bytes", "mix_block": "block", "mix_release": "release", "mix_deadline": "deadline", "mix_slot": "slot", "mix_start": "start"}
    return schedule(docs, SOURCE_WEIGHTS).select("doc_id", *[F.col(old).alias(new) for old, new in columns.items()])


def op2_pack_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from veriquill.llm.packing import pack

    return pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, BYTE_BPE_SPECIAL
    )


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriquill.llm.html_text import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriquill.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), "id % 20 = 0")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from veriquill.llm.token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriquill.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriquill.llm.toxicity import fit_toxicity, held_out, score_toxicity

    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(scored["doc_id"]).alias("held_out"), "score", "predicted", "n_passages")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriquill.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriquill.llm.substring import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"))
    factor = lambda f: F.concat_ws(":", f["start"], f["length"], F.coalesce(f["reference"].cast("string"), F.lit("")), f["offset"])
    return found.withColumn("factors", F.array_join(F.transform("factors", factor), ","))


#: op9 over again in SQL: homes of windows by their text, factors as islands of windows whose homes go on in step.
REPEATED_PASSAGES = r"""WITH d AS (SELECT doc_id, words, len(words) AS n, array_to_string(words, ' ') AS whole FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)),
x AS (SELECT doc_id, i, array_to_string(words[i + 1:i + 50], ' ') AS win FROM (SELECT doc_id, words, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
h AS (SELECT win, min({'id': doc_id, 'at': i}) AS home FROM x GROUP BY win HAVING count(*) > 1),
f AS (SELECT doc_id, i, home['id'] AS ref, home['at'] AS off FROM x JOIN h USING (win) WHERE doc_id > home['id']),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, ref, off - i ORDER BY i) AS island FROM f),
p AS (SELECT doc_id, min(i) AS start, count(*) + 49 AS length, ref, min(off) AS off FROM g GROUP BY doc_id, ref, off - i, island),
q AS (SELECT doc_id, string_agg(start || ':' || length || ':' || ref || ':' || off, ',' ORDER BY start) AS factors FROM p GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + length)) AS j FROM p),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word, unnest(range(0, n)) AS j FROM d WHERE doc_id IN (SELECT doc_id FROM p)) ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
c AS (SELECT whole, min(doc_id) AS head FROM d WHERE n >= 50 GROUP BY whole)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_words, CAST(CASE WHEN q.factors IS NULL THEN 0 ELSE d.n - coalesce(kept.n, 0) END AS BIGINT) AS n_removed,
sha256(CASE WHEN q.factors IS NULL THEN d.whole ELSE coalesce(kept.text, '') END) AS kept_sha256, CASE WHEN c.head < d.doc_id THEN '0:' || d.n || '::0' ELSE coalesce(q.factors, '') END AS factors
FROM d LEFT JOIN q USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN c ON c.whole = d.whole"""


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriquill.llm.pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_pfair_mixture, op2_pack_first_fit, op3_html_main_text, op4_permutation_index, op5_token_counts, op6_simhash_anchors, op7_toxicity, op8_quality_rules, op9_repeated_passages, op10_personal_data]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op9_repeated_passages": REPEATED_PASSAGES}
