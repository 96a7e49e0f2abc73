"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its `prefix` nearest of `pivots` reference vectors, in order, and posted under each of them
with its rank. Two such prefixes are compared by Spearman's footrule with missing pivots ranked last; that distance is a
constant less twice the sum, over the pivots they share, of prefix - max(rank, rank). The sums are accumulated from the
inverted files of the `asked` nearest pivots of the query, whose shares weigh most. The vectors with the smallest footrule
distance are then reranked by the exact measure: a share of the table, and a small multiple of k.

Queries and vectors meet in tiles: every part of the queries with every block of the index, each pair one bounded task that
builds the block's inverted files once for all queries of the part and returns its best `k` for each. There are as many
tiles as keep a cluster busy while the table is small, and tiles of a size bounded by memory beyond: a vector is copied once
for every QUERY_TILE queries, a query once for every INDEX_TILE vectors. There is no other path for small tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriquill.llm.common import bounded_batches

#: Pivots are a bounded sample: the rows with the smallest hashes of their ids.
PIVOTS, PREFIX, ASKED = 256, 96, 48
#: What is reranked: part of the vectors, and a multiple of k over all blocks together.
SHARE, SPARE = 0.08, 8
#: Vectors and queries of a tile, at least and at most, and the number of blocks up to which the former holds.
INDEX_TILE, QUERY_TILE, BUSY = (4096, 65536), 65536, 64


def tiles(vectors: int, queries: int, index_tile: tuple[int, int] = INDEX_TILE, query_tile: int = QUERY_TILE) -> tuple[int, int]:
    """How many blocks of vectors, and how many parts of queries."""
    few, many = index_tile
    return max(1, min(BUSY, -(-vectors // few)), -(-vectors // many)), max(1, -(-queries // query_tile))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): one row for each id, with vectors of the most frequent length that have no null, non-finite or only zero components."""
    v = F.col("v")
    rows = df.select(df[id_col].alias("id"), df[vector_col].cast("array<double>").alias("v")).where("id is not null and v is not null")
    fine = rows.where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    length = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    same = fine.join(F.broadcast(length), F.size("v") == F.col("n"), "left_semi")
    return same.groupBy("id").agg(F.min("v").alias("v"))


def prefixes(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Each vector's nearest pivots in order, by inner product; ties to the earlier pivot."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :length]


class InvertedFiles:
    """For every pivot, the vectors that have it in their prefix, and what each adds at most: prefix - rank."""

    def __init__(self, orders: np.ndarray, pivots: int):
        n, self.length = orders.shape
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        ends = np.cumsum(np.bincount(flat, minlength=pivots))
        kind = np.int16 if self.length < 250 else np.int64  # sums are at most length * (length + 1) / 2
        rows, weights = by_pivot // self.length, (self.length - by_pivot % self.length).astype(kind)
        self.rows, self.weights, self.n, self.kind = np.split(rows, ends[:-1]), np.split(weights, ends[:-1]), n, kind

    def closeness(self, order: np.ndarray) -> np.ndarray:
        """For every vector the sum over the pivots it shares with the query; the footrule distance falls by two for each unit."""
        total = np.zeros(self.n, self.kind)
        for rank, pivot in enumerate(order.tolist()):
            total[self.rows[pivot]] += np.minimum(self.weights[pivot], self.kind(self.length - rank))  # a vector is once in a file
        return total


def inner_products(columns: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Of the columns with the query, summed component by component, so that equal vectors have equal products wherever they stand."""
    total = np.zeros(columns.shape[1])
    for row, x in zip(columns, query.tolist()):
        total += row * x
    return total


def nearest(
    df: DataFrame,
    queries: str,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    pivots: int = PIVOTS,
    prefix: int = PREFIX,
    asked: int = ASKED,
    share: float = SHARE,
    spare: int = SPARE,
    index_tile: tuple[int, int] = INDEX_TILE,
    query_tile: int = QUERY_TILE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query its k nearest found, by largest inner product in double precision.

    `queries` is SQL over `id` that picks the queries; candidates are all rows but those with the query's id. Ties go to
    the smaller id. Vectors that are null, zero, of another length than most, or with null or non-finite components take
    no part, nor do null ids; of rows that repeat an id the smallest vector counts. Fewer candidates than k give fewer
    rows; an empty table gives an empty result; other columns are ignored.

    Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest, so only they are searched: that is
    exact, and a vector that fills much of the table crowds nothing out. Ties of the footrule distance are all reranked.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows = usable(df, id_col, vector_col)
    id_type = rows.schema["id"].dataType
    sample = rows.select("v", F.xxhash64(F.lit("pivot"), "id").alias("h")).groupBy("v").agg(F.min("h").alias("h")).orderBy("h", "v").limit(pivots).collect()
    reference = np.array([r["v"] for r in sample], dtype=np.float64)

    wanting = rows.where(queries)
    twins = Window.partitionBy("v").orderBy("id")
    listed = rows.withColumn("twin", F.row_number().over(twins)).where(F.col("twin") <= k + 1).select("id", "v")
    n, q = rows.count(), wanting.count()
    blocks, parts = tiles(n, q, index_tile, query_tile)
    place = lambda count, name: F.pmod(F.xxhash64(F.lit(name), "id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = wanting.select(place(parts, "q").alias("part"), every(blocks).alias("block"), F.lit(True).alias("asks"), "id", "v")
    right = listed.select(every(parts).alias("part"), place(blocks, "i").alias("block"), F.lit(False).alias("asks"), "id", "v")
    out = T.StructType([T.StructField("query_id", id_type), T.StructField("vec_id", id_type), T.StructField("score", T.DoubleType())])

    def search(key, rows):
        asks = rows.column("asks").to_numpy(zero_copy_only=False)
        ids = rows.column("id").to_pylist()
        v = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if ids else np.zeros((0, 1))
        found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        have = sorted(np.flatnonzero(~asks).tolist(), key=lambda i: ids[i])  # in order of id, so that stable sorts break ties
        if asks.any() and have:
            ids_in, v_in = [ids[i] for i in have], v[have]
            place = {i: at for at, i in enumerate(ids_in)}
            by_component = np.ascontiguousarray(v_in.T)
            length = min(prefix, len(reference))
            files = InvertedFiles(prefixes(v_in, reference, length), len(reference))
            wanted = min(len(have), int(np.ceil(share * len(have) + spare * k / blocks)) + 1)  # one may be the query itself
            asking = np.flatnonzero(asks)
            for at, order in zip(asking.tolist(), prefixes(v[asking], reference, min(asked, length))):
                close = files.closeness(order)
                near = np.flatnonzero(close >= np.partition(close, -wanted)[-wanted])  # all that tie with the last
                near = near[near != place.get(ids[at], -1)]
                scores = inner_products(by_component[:, near], v[at])
                if len(scores) > 4 * k:  # ties with the k-th stay
                    good = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
                    near, scores = near[good], scores[good]
                best = np.argsort(-scores, kind="stable")[:k]
                found["query_id"] += [ids[at]] * len(best)
                found["vec_id"] += [ids_in[i] for i in near[best].tolist()]
                found["score"] += scores[best].tolist()
        return pa.table({f.name: pa.array(found[f.name], type=t) for f, t in zip(out, (rows.schema.field("id").type, rows.schema.field("id").type, pa.float64()))})

    met = left.unionByName(right).groupBy("part", "block").applyInArrow(search, out)
    ranks = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", ranks).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
