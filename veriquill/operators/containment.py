"""Which texts hold which passages, as an equi-join on shingles with an exact check after it.

The words inside a passage (all but the first and the last) stand as whole words wherever the passage stands. A passage is
keyed by the hash of up to `SHINGLE` of them; a text offers the distinct hashes of all its shingles of the lengths in use. Only
keys and ids are joined; texts come in for the pairs that are left. Passages of fewer than three words have no inner
word, so nothing that texts could be keyed by: they come in lists of LIST to the texts, each of which is searched for a list
at a time. Blank passages stand nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 6
#: Short passages that a text is searched for together.
LIST = 1000


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def key(hashes: Column, at: Column, n: Column) -> Column:
    """The hash of n word hashes from a place on."""
    return F.xxhash64(F.slice(hashes, at + 1, n))


def candidates(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, doc_id): pairs that share the passage's key. passages: item_id, text; texts: doc_id, text."""
    hashed = passages.select("item_id", "text", word_hashes(F.col("text")).alias("h")).where(F.size("h") > 0)
    size = F.least(F.lit(SHINGLE), F.size("h") - 2)
    keyed = hashed.where(F.size("h") > 2).select("item_id", size.alias("n"), key(F.col("h"), F.lit(1), size).alias("key"))
    lengths = keyed.groupBy().agg(F.collect_set("n").alias("lengths"))  # at most SHINGLE numbers
    offered = texts.select("doc_id", word_hashes(F.col("text")).alias("h")).crossJoin(F.broadcast(lengths))  # one row
    places = lambda n: F.when(F.size("h") >= n, F.sequence(F.lit(0), F.size("h") - n)).otherwise(F.array().cast("array<int>"))
    pairs = F.array_distinct(F.flatten(F.transform("lengths", lambda n: F.transform(places(n), lambda i: key(F.col("h"), i, n)))))
    rows = offered.select("doc_id", F.explode(pairs).alias("key"))
    long = rows.join(keyed, "key").select("item_id", "doc_id").distinct()
    short = hashed.where(F.size("h") < 3)
    if not (n := short.count()):
        return long
    part = F.pmod(F.xxhash64("item_id"), F.lit(-(-n // LIST)))
    lists = short.groupBy(part.alias("part")).agg(F.collect_list(F.struct("item_id", "text")).alias("short"))
    found = texts.select("doc_id", "text").crossJoin(lists).select("doc_id", F.explode(F.filter("short", lambda s: F.contains(F.col("text"), s["text"]))).alias("s"))
    return long.unionByName(found.select("s.item_id", "doc_id"))


def contained(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, doc_id, start): the passages that stand in a text as written, and where first (code points, from 0)."""
    pairs = candidates(passages, texts)
    both = pairs.join(passages.select("item_id", F.col("text").alias("passage")), "item_id").join(texts.select("doc_id", "text"), "doc_id")
    return both.withColumn("at", F.expr("locate(passage, text)")).where("at > 0").select("item_id", "doc_id", (F.col("at") - 1).cast("long").alias("start"))
