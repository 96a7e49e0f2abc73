"""Near duplicates by SimHash fingerprints and anchor points of a covering code.

Two fingerprints that differ in at most two of 64 bits differ in at most one bit of the lower or of the upper half. In
each half 31 bits are covered by the perfect Hamming code: every value is within distance 1 of exactly one code word (its
home anchor) and within distance 2 of at most 16. A fingerprint goes to every anchor within covering radius plus
threshold, 1 + 1; of two that are one bit apart in a half, each is therefore at the other's home anchor, and comparing
homes with all others per anchor finds every link.

An anchor that many fingerprints share would compare the square of their number. Its fingerprints are linked through
their one-bit neighbours instead: two are within two bits if and only if they share a value within one bit of both, and
at most 65 fingerprints share one, so the work is linear in the group. Equal fingerprints are one from the start.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from veriquill.llm.common import cut, id_field, map_batches, merged, narrow, positional, renamed_back
from veriquill.llm.graph import components

SHINGLE, SEED = 3, 42
#: An anchor with more fingerprints is not compared but linked through neighbours.
CROWDED = 64
#: For each bit of the syndrome, which of the 31 places (numbered from 1) it sums.
CHECKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]


def fingerprint(text: str | None) -> int:
    """The signed 64-bit fingerprint of a whole text: majority bits of its shingles' hashes; 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z are lower-cased, only ASCII blanks split
    if not words:
        return 0
    n, digest = len(words), xxhash.xxh64_intdigest
    if n <= SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        joined = memoryview(b" ".join(words))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[: n - SHINGLE] + 1)).tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())]
    m = len(hashes)
    # eight byte-wide counters to a word; 255 rows fill none of them over
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little").view(np.uint64).reshape(m, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, m, 255):
        counts += np.add.reduce(bits[at : at + 255], axis=0).view(np.uint8)
    return int(np.packbits(2 * counts > m, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row."""
    schema = T.StructType([id_field(df, id_col, "id"), T.StructField("fp", T.LongType())])
    return map_batches(df.select(df[id_col], df[text_col]), lambda b: {"id": b.column(0), "fp": [fingerprint(t) for t in b.column(1).to_pylist()]}, schema)


def anchors(fp: str) -> Column:
    """The (key, home) anchors of a fingerprint column, over both halves."""
    out = []
    for half in range(2):
        x = f"(shiftrightunsigned({fp}, {32 * half}) & 2147483647L)"
        s = " + ".join(f"shiftleft(bit_count({x} & {mask}L) & 1, {k})" for k, mask in enumerate(CHECKS))
        key = f"shiftleft({half}L, 32)"
        home = f"if(s = 0, {x}, {x} ^ shiftleft(1L, s - 1))"
        far = f"transform(filter(sequence(1, 31), a -> a < (a ^ s)), a -> struct({key} | ({x} ^ shiftleft(1L, a - 1) ^ shiftleft(1L, (a ^ s) - 1)) as key, false as home))"
        out.append(f"transform(array({s}), s -> concat(array(struct({key} | ({home}) as key, true as home)), {far}))[0]")
    return F.expr(f"concat({', '.join(out)})")


def links(distinct: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Edges (a, b) between distinct fingerprints; the components of these are those of all links within two bits."""
    # the planner takes what is exploded to be as large as what it comes from, and would broadcast 34 times that
    at = distinct.select("fp", F.explode(anchors("fp")).alias("at")).select("fp", "at.key", "at.home")
    shared = at.groupBy("key").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where("n > 1 and homes > 0").select("key", "n")
    met = cut(at.hint("merge").join(shared.hint("merge"), "key"))
    few = met.where(F.col("n") <= crowded)
    pairs = few.where("home").select("key", F.col("fp").alias("a")).hint("merge").join(few.select("key", F.col("fp").alias("b")).hint("merge"), "key")
    compared = pairs.where("a <> b and bit_count(a ^ b) <= 2").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    many = met.where(F.col("n") > crowded).select("fp").distinct()
    near = many.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("near"))
    least = near.groupBy("near").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where("size(all) > 1")  # at most 65
    through = least.select("a", F.explode("all").alias("b")).where("a <> b")
    return compared.unionByName(through).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (smallest id reachable over links of at most two bits).

    A null or empty text has fingerprint zero, linked like any other. Repeated rows each give a row. A null id is no
    component's id: such a row takes the smallest id of its component, or null if there is none. A bit that just half the
    shingles have is 0. Texts are read whole, however long, in time linear in them. An empty table gives an empty one;
    other columns are ignored. Only fingerprints are shuffled.
    """
    prints = cut(fingerprints(df, id_col, text_col))
    distinct = prints.groupBy("fp").agg(F.min("id").alias("low"))
    n = distinct.count()
    roots = components(links(distinct.select("fp"), crowded)).select(F.col("node").alias("fp"), "root")
    distinct, roots, prints = merged(n, distinct, roots, prints)
    rooted = distinct.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    rooted, lows = merged(n, rooted, lows)
    named = merged(n, rooted.join(lows, "root").select("fp", "component_id"))[0]
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df less all but one of each component: the one with the smallest id stays, with all its columns.

    Of rows that repeat an id, one stays. Rows without an id stay only if nothing with an id is linked to them, one for
    each fingerprint. Null and empty texts have fingerprint zero, so one of them all stays. An empty table gives an empty one.
    """
    found = cut(near_duplicates(narrow(df, id=id_col, text=text_col), "id", "text"))
    heads = found.where(F.col("id").eqNullSafe(F.col("component_id")))
    like, (df, (i, t)) = df, positional(df, id_col, text_col)
    once = heads.where("id is not null").groupBy("id").agg(F.count("*").alias("rows"))
    n = found.count()
    kept = df.join(merged(n, once)[0], df[i] == F.col("id")).drop("id")
    single, several = kept.where("rows = 1").drop("rows"), kept.where("rows > 1").drop("rows").dropDuplicates([i])
    nameless = heads.where("id is null").select("fingerprint").distinct()
    bare = df.where(df[i].isNull()).withColumn("print", _fingerprint_udf()(df[t]))
    bare = bare.join(merged(n, nameless)[0], bare["print"] == nameless["fingerprint"], "left_semi").dropDuplicates(["print"]).drop("print")
    return renamed_back(single.unionByName(several).unionByName(bare), like)


def _fingerprint_udf():
    @pandas_udf(T.StringType())
    def hexed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: f"{fingerprint(t) & (1 << 64) - 1:016x}")

    return hexed
