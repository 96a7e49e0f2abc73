"""Substring dedup by relative Lempel-Ziv parsing of documents against the indexed reference blocks of all of them.

The reference is made of what each document is the first to say: a reference block is a run of consecutive windows of
`window` words whose first occurrence, by document id and place, it holds. So every window has one home in the reference, and
a document's longest match from any place on is a run along one block. The index maps the 128-bit digest of a window to its
home. A document is parsed greedily: at the first place whose window is at home in an earlier document a factor begins
there, and it goes on along that block as long as the document's next window is at home at the block's next place. The
digests that open and close a factor check its boundaries. The parse goes on behind the factor's last window, so factors may
overlap by less than a window; every factor is (start, length, reference document, place in it), and whatever lies in one is
a duplicate span.

Only windows around anchors that two documents share are ever indexed: an anchor is the least hash among a window's grams of
`gram` words, so equal windows have equal anchors, and about one value in twenty words of a text is one. Copies of a whole
word sequence are set aside first: only the smallest document of each is parsed and indexed, the others are one factor.
Per text, anchors and windows are vectorised over its bytes. The texts of documents with shared anchors are shuffled once, by
id and content; everything else that moves is narrow, pre-aggregated where a hot value could meet in one place.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriquill.llm.common import cut, id_field, map_batches

WINDOW, GRAM = 50, 10
#: Windows whose anchor more windows than this share are spread over so many tasks each.
CROWD, SALTS = 20_000, 16
BASE = 0x9E3779B97F4A7C15 | 1
MIX = np.uint64(0xD6E8FEB86659FD93)


class Powers:
    """Powers of an odd base and of its inverse, modulo 2**64, as long as the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = self.grown(BASE, size), self.grown(pow(BASE, -1, 1 << 64), size)
        return self.up[:n], self.down[:n]

    @staticmethod
    def grown(base: int, size: int) -> np.ndarray:
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)


_POWERS = Powers()


class Words:
    """A text's words in one buffer, joined by blanks, with their places."""

    def __init__(self, text: str | None):
        words = (text or "").encode().split()  # bytes split at ASCII blanks only
        self.n = len(words)
        self.joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, self.n)
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths

    def anchors(self, window: int, gram: int) -> np.ndarray:
        """The anchor of each window, as a signed 64-bit hash."""
        if self.n < window:
            return np.zeros(0, np.int64)
        up, down = _POWERS.upto(len(self.joined) + 1)
        codes = np.frombuffer(self.joined, np.uint8).astype(np.uint64)
        codes += np.uint64(1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[:-1], out=sums[1:])
        starts = self.starts[: self.n - gram + 1]
        hashes = (sums[self.ends[gram - 1 :]] - sums[starts]) * down[starts]
        hashes ^= hashes >> np.uint64(32)
        hashes *= MIX
        hashes ^= hashes >> np.uint64(29)
        width, done = window - gram + 1, 1
        while 2 * done <= width:
            hashes = np.minimum(hashes[:-done], hashes[done:])
            done *= 2
        if done < width:
            hashes = np.minimum(hashes[: len(hashes) - (width - done)], hashes[width - done :])
        return hashes.view(np.int64)

    def windows(self, places: np.ndarray, window: int) -> tuple[list[int], list[int]]:
        """The two halves of the 128-bit digests of the windows that start there."""
        import xxhash

        digest, joined = xxhash.xxh3_128_digest, memoryview(self.joined)
        raw = b"".join([digest(joined[a:b]) for a, b in zip(self.starts[places].tolist(), self.ends[places + window - 1].tolist())])
        halves = np.frombuffer(raw, "<i8").reshape(-1, 2)
        return halves[:, 0].tolist(), halves[:, 1].tolist()

    def without(self, spans: list[tuple[int, int]]) -> tuple[int, str]:
        """Words in the spans, which are in order and may overlap, and the digest of the others joined by one blank."""
        if not spans:
            return 0, hashlib.sha256(self.joined).hexdigest()
        kept, read, removed = [], 0, 0
        for a, b in spans:
            if a > read:
                kept.append(self.joined[self.starts[read] : self.ends[a - 1]])
            if b > read:
                removed += b - max(a, read)
                read = b
        if read < self.n:
            kept.append(self.joined[self.starts[read] :])
        return removed, hashlib.sha256(b" ".join(kept)).hexdigest()


def factors(homes: Iterable[tuple[int, object, int]], window: int) -> list[tuple[int, int, object, int]]:
    """The greedy parse: (start, length, reference, offset) of each factor.

    `homes` are the places of a document whose windows are at home elsewhere, each with the reference and the place there.
    """
    found: list[list] = []
    for place, reference, offset in sorted(homes, key=lambda h: h[0]):
        last = found[-1] if found else None
        along = last and reference == last[2] and place + window == last[0] + last[1] + 1 and offset - place == last[3] - last[0]
        if along:
            last[1] += 1
        else:
            found.append([place, window, reference, offset])
    return [tuple(f) for f in found]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 (of the kept words joined by one blank), and its factors:
    (start, length, reference, offset) in words. A copy of a whole earlier text is one factor whose reference is null.

    A word is removed if a window of `window` words over it also starts in a document with a smaller id, judged on the
    input. A null or empty text has no words. Rows that repeat an id are no earlier than each other; a null id is
    neither earlier nor later than any, so nothing of such a row is removed or indexed. Of two earlier occurrences the
    one in the document with the smaller id counts, then the one further in front. Texts are read whole, however long, in
    time linear in them. An empty table gives an empty one; other columns are ignored.
    """
    id_type = df.schema[id_col].dataType
    docs = df.select(df[id_col].alias("id"), F.xxhash64(df[text_col]).alias("key"), df[text_col].alias("text"))  # the key tells rows that repeat an id apart
    key = [T.StructField("id", id_type), T.StructField("key", T.LongType())]

    def read(batch: pa.RecordBatch) -> dict[str, list]:
        words = [Words(t) for t in batch.column(2).to_pylist()]
        anchors = [np.unique(w.anchors(window, gram), return_counts=True) for w in words]
        return {
            "id": batch.column(0),
            "key": batch.column(1),
            "n_words": [w.n for w in words],
            "sha": [bytes.fromhex(w.without([])[1]) for w in words],
            "anchors": [a for a, _ in anchors],
            "times": [n for _, n in anchors],
        }

    arrays = [T.StructField("anchors", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))]
    parsed = cut(map_batches(docs, read, T.StructType([*key, T.StructField("n_words", T.LongType()), T.StructField("sha", T.BinaryType()), *arrays])))

    long_enough = parsed.where((F.col("n_words") >= window) & F.col("id").isNotNull())
    heads = long_enough.groupBy("sha").agg(F.min("id").alias("head"))
    # joined by id too, so that a text with very many copies is no hot key where arrays move
    first_of_text = long_enough.join(heads.withColumnRenamed("head", "id"), ["id", "sha"])
    anchors = first_of_text.select("id", "key", F.inline(F.arrays_zip("anchors", "times"))).withColumnRenamed("anchors", "anchor")
    # heads have different texts, so different keys
    ends = anchors.groupBy("anchor").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.sum("times").alias("windows"))
    shared = ends.where("low < high").select("anchor", "windows")
    crowded = F.collect_set(F.when(F.col("windows") > crowd, F.col("anchor")))  # sets, as rows may repeat
    marks = anchors.drop("times").join(shared, "anchor").groupBy("id", "key").agg(F.collect_set("anchor").alias("anchors"), crowded.alias("crowded"))
    # what windows are told by besides the id: the key where an id has several texts, else nothing, which costs nothing to move
    several = parsed.groupBy("id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("id", F.lit(True).alias("several"))
    tag = F.when(F.col("several"), F.col("key")).otherwise(F.lit(0))
    marks = cut(marks.join(several, "id", "left").withColumn("tag", tag).drop("several"))
    marked = docs.join(marks.hint("shuffle_merge"), ["id", "key"])

    def index(crowded_only: bool):
        def make(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {f.name: [] for f in fields}
            for i, tag, text, wanted, crowded in zip(*(batch.column(c).to_pylist() for c in range(5))):
                words = Words(text)
                own = words.anchors(window, gram)
                names = np.array(crowded, np.int64) if crowded_only else np.setdiff1d(np.array(wanted, np.int64), np.array(crowded, np.int64))
                places = np.flatnonzero(np.isin(own, names))
                if len(places):
                    hi, lo = words.windows(places, window)
                    places = places.tolist()
                    out["id"] += [i] * len(places)
                    out["tag"] += [tag] * len(places)
                    out["place"] += places
                    out["hi"] += hi
                    out["lo"] += lo
                    if crowded_only:
                        first: dict[tuple[int, int], int] = {}
                        out["front"] += [first.setdefault(w, p) for w, p in zip(zip(hi, lo), places)]
                        out["salt"] += [zlib.crc32(f"{i} {p >> 10}".encode()) % SALTS for p in places]
            return {c: out[c] for c in out if crowded_only or c not in ("front", "salt")}

        return make

    fields = [T.StructField("id", id_type), *(T.StructField(c, T.LongType()) for c in ("tag", "hi", "lo")), *(T.StructField(c, T.IntegerType()) for c in ("place", "front", "salt"))]
    read_in = marked.select("id", "tag", "text", "anchors", "crowded")
    # the way from a place to that of the reference is the same all along a factor, which takes little to move
    found_at = lambda home, offset: F.struct("place", F.col(home).alias("reference"), (F.col(offset) - F.col("place")).alias("way")).alias("found")
    # Windows of few documents meet by digest; the least of them is their home.
    few = map_batches(read_in, index(False), T.StructType(fields[:-2]))
    plain = few.withColumn("home", F.min(F.struct("id", "place")).over(Window.partitionBy("hi", "lo"))).where("id > home.id").select("id", "tag", found_at("home.id", "home.place"))
    # Of windows that very many may hold, the home is combined before it is moved, and goes to every salt, so that the places of
    # one window are in as many tasks. `front` is the first place of the window in its document.
    many = map_batches(read_in.where(F.size("crowded") > 0), index(True), T.StructType(fields))
    homes = many.groupBy("hi", "lo").agg(F.min("id").alias("home"), F.min_by("front", "id").alias("offset")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = many.drop("front").join(homes, ["hi", "lo", "salt"]).where("id > home").select("id", "tag", found_at("home", "offset"))
    found = plain.unionByName(salted).groupBy("id", "tag").agg(F.collect_list("found").alias("found"))

    def parse(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"id": [], "key": [], "n_removed": [], "kept": [], "factors": []}
        for i, k, text, found in zip(*(batch.column(c).to_pylist() for c in range(4))):
            parse = factors({(f["place"], f["reference"], f["place"] + f["way"]) for f in found}, window)  # a set, as rows may repeat
            removed, kept = Words(text).without([(a, a + n) for a, n, _, _ in parse])
            for name, value in zip(out, (i, k, removed, kept, [dict(zip(("start", "length", "reference", "offset"), f)) for f in parse])):
                out[name].append(value)
        return out

    factor = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("reference", id_type), T.StructField("offset", T.LongType())])
    many_factors, none = T.ArrayType(factor), F.lit(None).cast(id_type)
    cut_schema = T.StructType([*key, T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("factors", many_factors)])
    parts = map_batches(marked.select("id", "key", "tag", "text").join(found, ["id", "tag"]).select("id", "key", "text", "found"), parse, cut_schema).dropDuplicates(["id", "key"])

    # a row that is not its text's head is a copy; asked by id and text, so that no text is a hot key
    is_head = heads.select(F.col("head").alias("head_id"), F.col("sha").alias("head_sha"))
    everything = parsed.select("id", "key", "n_words", "sha").join(parts, ["id", "key"], "left")
    everything = everything.join(is_head, (F.col("id") == F.col("head_id")) & (F.col("sha") == F.col("head_sha")), "left")
    whole = (F.col("n_words") >= window) & F.col("id").isNotNull() & F.col("head_id").isNull()
    return everything.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("length"), none.alias("reference"), F.lit(0).alias("offset"))).cast(many_factors)).otherwise(F.coalesce("factors", F.array().cast(many_factors))).alias("factors"),
    )
