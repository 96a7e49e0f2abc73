"""Packing by first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import base64
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriquill.llm.common import bounded_batches, id_field

#: Documents that are packed together; a group's rows are a few dozen bytes each.
GROUP_DOCS = 4096
SEED = 7
#: Rows of one id and text in a task that go to the same group; further ones are dealt to others.
TOGETHER = 16


class Tokens:
    """Ids of texts under a byte-level BPE given as ranks, equal to those of the tokenizers file with the same vocabulary.

    Both libraries cut by one pattern and merge by one rank order; the special string inside a text becomes its id, as
    tokenizers does by default. tests/llm holds the two against each other. Where the rank library's pattern engine
    gives up on a text, the tokenizers file is used.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.json_path = json_path
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        self.slow = None

    def ids(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special=self.special), dtype="<u4")
        except BaseException as e:  # the engine's own panic is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.json_path)
            return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


_TOKENS: dict[tuple, Tokens] = {}


def tokens(json_path: str, ranks_path: str, pattern: str, special: dict[str, int]) -> Tokens:
    key = (json_path, ranks_path)
    if key not in _TOKENS:
        _TOKENS[key] = Tokens(json_path, ranks_path, pattern, special)
    return _TOKENS[key]


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin of each item and the offset in it; items of equal length keep their order.

    The tournament tree's leaves are the bins' free space, each inner node the larger of its two; the first bin that
    fits is found by going down from the root, left whenever the left subtree has room. O(n log n).
    """
    n = len(lengths)
    size = 1
    while size < max(n, 1):
        size *= 2
    tree = [capacity] * (2 * size)
    bins, offsets = [0] * n, [0] * n
    for i in sorted(range(n), key=lambda i: -lengths[i]):
        need, node = lengths[i], 1
        if need > capacity or need < 0:
            raise ValueError(f"an item of length {need} does not fit a bin of {capacity}")
        while node < size:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - size, capacity - tree[node]
        tree[node] -= need
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins, offsets


def pack(
    df: DataFrame,
    json_path: str,
    ranks_path: str,
    pattern: str,
    special: dict[str, int],
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 2048,
    end_id: int = 1,
    group_docs: int = GROUP_DOCS,
    seed: int = SEED,
    rank_col: str | None = None,
) -> DataFrame:
    """Sequences of at most `length` ids: per piece its document, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and end_id; it is cut every `length` ids, so each id is in one piece. Pieces are packed by
    first-fit decreasing within groups of about group_docs documents, chosen by a seeded hash of id and text, so that a
    group's task is bounded however long its documents are: only lengths and checksums are moved, never ids or texts.

    With rank_col, which numbers the rows from 0, a group is a run of group_docs ranks instead: sequence ids rise with the
    groups, and the sequences of a group are numbered in a seeded random order, since first-fit decreasing goes by length.

    A null or empty text is the end id alone. Repeated rows are packed as often as they come; as many rows may be alike,
    every TOGETHER of them that a task reads are dealt to a group of their own choice. Rows that are alike cannot be told
    apart, so a task that runs again deals them the same. Null ids are kept; pieces of equal length are packed in order
    of id. Texts are encoded whole, however long. An empty table gives an empty result. Other columns of df are ignored.
    """
    bounded_batches(df.sparkSession)
    fields = [id_field(df, id_col), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens"))]
    cut_schema = T.StructType([T.StructField("bucket", T.LongType()), *fields])
    packed_schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pieces(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(cut_schema)
        encode = tokens(json_path, ranks_path, pattern, special).ids
        seen, task = Counter(), TaskContext.get().partitionId()
        for batch in batches:
            rows, starts, lengths, crcs, totals = [], [], [], [], []
            buckets = batch.column(0).to_pylist()
            if groups > 1:
                keys = batch.column(3).to_pylist()
                for i, row in enumerate(keys):
                    if turn := seen[row] // TOGETHER:
                        buckets[i] = zlib.crc32(f"{row} {task} {turn}".encode()) % groups
                    seen[row] += 1
            bucket_of = pa.array(buckets, pa.int64())
            for i, text in enumerate(batch.column(2).to_pylist()):
                ids = np.append(encode(text), np.array([end_id], "<u4")) if text else np.array([end_id], "<u4")
                n = len(ids)
                data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                for at in range(0, n, length):
                    end = min(n, at + length)
                    rows.append(i)
                    starts.append(at)
                    lengths.append(end - at)
                    crcs.append(zlib.crc32(data[4 * at : 4 * end]))
                    totals.append(n)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [bucket_of.take(take), batch.column(1).take(take), *(pa.array(c, pa.int64()) for c in (starts, lengths, crcs, totals))], schema=out
            )

    row_key = F.xxhash64(F.lit(seed), df[id_col].cast("string"), df[text_col])
    if rank_col is None:
        groups = max(1, -(-df.count() // group_docs))
        bucket = F.pmod(row_key, F.lit(groups))
    else:
        groups, bucket = 1, F.floor(df[rank_col] / group_docs).cast("long")

    def group(key, rows):
        keys = [rows.column(c).to_pylist() for c in (id_col, "ids_crc32", "doc_tokens", "start")]
        order = sorted(range(rows.num_rows), key=lambda i: (keys[0][i] is None, *(k[i] or 0 for k in keys)))
        rows = rows.take(pa.array(order, pa.int64()))
        bins, offsets = first_fit_decreasing(rows.column("length").to_pylist(), length)
        if rank_col is not None:
            numbers = np.random.default_rng([seed, key[0].as_py()]).permutation(max(bins) + 1).tolist()
            bins = [numbers[b] for b in bins]
        base = key[0].as_py() << 31  # a group has fewer bins, so ids of different groups differ
        return rows.drop_columns(["bucket"]).append_column("sequence_id", pa.array([base + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    cut_up = df.select(bucket.alias("bucket"), df[id_col], df[text_col], row_key.alias("row_key")).mapInArrow(pieces, cut_schema)
    return cut_up.groupBy("bucket").applyInArrow(group, packed_schema)
