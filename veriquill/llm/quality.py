"""Quality rules: counts on every document, and a hashed n-gram likelihood ratio of a trusted target to the raw corpus.

DataFrame functions only. A document's words are hashed once; n-grams are hashes of neighbouring word hashes, so strings
are read a single time in each of the two passes (counting, scoring) and no text is ever shuffled. The corpus is counted
in a table of `buckets` sums, which is what the model is: its size is fixed, its counts are those of all documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriquill.llm.common import WHITE, narrow

BUCKETS = 1 << 16
#: Labelled documents that make the trusted target, those with the smallest hashes of their ids.
TARGET_ROWS = 20_000
#: Counts that each bucket's expectation is weighed with: buckets with little evidence have a ratio near 1.
PRIOR = 10.0
#: Mean log ratio per n-gram under which a document is dropped. It is a mean, so it holds for any length.
THRESHOLD = -0.05
#: Base rules: fewer words, or a larger share of words in repeated three-word windows (in hundredths), fail.
LEAST_WORDS, MOST_REPEATED = 50, 50
BLANKS = " \t\n\x0b\x0c\r"
#: Low bits of a packed window hash that hold its position.
POSITION_BITS = 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE, -1))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def grams(hashes: Column, buckets: int) -> tuple[Callable, Callable]:
    """Buckets of the word at a place, and of the word with its successor (the last one with none)."""
    size = F.lit(buckets).cast("long")
    return lambda h, i: F.pmod(h, size), lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), size)


def repeated_words(hashes: Column, n: Column) -> Column:
    """Words covered by three-word windows that occur twice or more in the text, first occurrences included.

    Linear apart from sorts of longs. Windows are first compared on packed words of hash bits and position; those that
    agree with a neighbour there are then compared on their whole hashes.
    """
    mask = F.lit((1 << POSITION_BITS) - 1).cast("long")

    def of_windows(windows: Column) -> Column:
        packed = F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))

        def near(keys: Column) -> Column:
            differs = lambda a, b: F.shiftrightunsigned(a.bitwiseXOR(b), POSITION_BITS) != 0
            kept = F.filter(keys, lambda k, i: ~differs(k, F.coalesce(F.get(keys, i - 1), F.bitwise_not(k))) | ~differs(k, F.coalesce(F.get(keys, i + 1), F.bitwise_not(k))))
            return F.transform(kept, lambda k: k.bitwiseAND(mask).cast("int"))

        places = F.when(n <= (1 << POSITION_BITS), let(packed, near)).otherwise(F.sequence(F.lit(0), n.cast("int") - 3))

        def exact(at: Column) -> Column:
            pairs = F.array_sort(F.transform(at, lambda i: F.struct(F.get(windows, i).alias("h"), i.alias("i"))))

            def covered(found: Column) -> Column:
                twice = F.filter(found, lambda e, j: (e["h"] == F.get(found, j - 1)["h"]) | (e["h"] == F.get(found, j + 1)["h"]))
                starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
                return let(
                    starts,
                    lambda s: F.aggregate(F.transform(s, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(s, j + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x),
                )

            return let(pairs, covered)

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(places, exact))

    windows = F.slice(F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2))), F.lit(1), F.greatest(n.cast("int") - 2, F.lit(0)))
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(windows, of_windows))


def base_counts(text: Column, words: Column, hashes: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    n = F.size(words).cast("long")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return [
        n.alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeated_words(hashes, n).alias("n_repeat_words"),
    ]


def target_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rows: int = TARGET_ROWS) -> DataFrame:
    """At most `rows` ids labelled 1, by a hash of the id; ties cannot be, as ids are distinct."""
    ids = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    return ids.orderBy(F.xxhash64(F.lit("target"), "id"), "id").limit(rows)


def ratios(df: DataFrame, target: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """One row with `ratios`, the buckets' log ratios. df has id and text, target at most a bounded number of ids."""
    trusted = df.join(F.broadcast(target.withColumn("trusted", F.lit(1))), "id", "left")
    hashes = word_hashes(words_of(F.col("text")))

    def both(h: Column) -> Column:
        one, two = grams(h, buckets)
        return F.concat(F.transform(h, one), F.transform(h, two))

    counted = (
        trusted.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode(let(hashes, both)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("trusted").alias("target"))
    )
    spread = df.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(counted, "bucket", "left").fillna(0)
    rows = F.array_sort(F.collect_list(F.struct("bucket", "raw", "target")))
    # the totals come out of the same pass as the counts
    whole = spread.agg(rows.alias("rows"), F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    share = F.when(F.col("raw") > 0, F.col("target") / F.col("raw")).otherwise(0.0)
    return whole.select("rows", share.alias("share")).select(F.transform("rows", lambda x: F.log((x["target"] + prior) / (x["raw"] * F.col("share") + prior))).alias("ratios"))


def quality_rules(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    buckets: int = BUCKETS,
    target_rows: int = TARGET_ROWS,
    prior: float = PRIOR,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_ratio.

    A null or empty text has no words and fails the base rules. Repeated rows and null ids each give a row (a null id is
    never trusted); an empty table gives an empty one; other columns are ignored. Without trusted documents every ratio
    is 1 and the base rules alone decide. Texts are read whole, however long; a ratio equal to the threshold is kept.
    """
    docs = narrow(df, id=id_col, text=text_col)
    weights = ratios(docs, target_ids(narrow(labels, **{id_col: id_col, label_col: label_col}), id_col, label_col, target_rows), buckets, prior).scalar()

    def score(h: Column, weights: Column) -> Column:
        one, two = grams(h, buckets)
        sums = F.transform(h, lambda x, i: F.get(weights, one(x, i).cast("int")) + F.get(weights, two(x, i).cast("int")))
        return F.aggregate(sums, F.lit(0.0), lambda a, x: a + x) / (2 * F.size(h))

    def measured(w: Column, h: Column, r: Column) -> Column:
        return F.struct(*base_counts(F.col("text"), w, h), F.when(F.size(h) > 0, score(h, r)).otherwise(F.lit(0.0)).alias("log_ratio"))

    # named once, so that the optimizer puts the subquery in its place and no row carries the ratios
    found = let(F.col("ratios"), lambda r: let(words_of(F.col("text")), lambda w: let(word_hashes(w), lambda h: measured(w, h, r))))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (
        docs.select("id", "text", weights.alias("ratios"))
        .select("id", found.alias("found"))
        .select("id", "found.*")
        .select(
            F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("log_ratio") >= threshold)).alias("kept"), "log_ratio"
        )
    )
