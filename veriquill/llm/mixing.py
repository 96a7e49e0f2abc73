"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a seeded random order, fill its blocks of `block_bytes`. With integer weights that sum to Q, the
j-th block (from 0) of a source of weight w may not come before slot floor(j Q / w), its release, and must come before slot
ceil((j + 1) Q / w), its deadline. Earliest deadline first among released blocks meets every deadline on one sequence, so at
no slot has any source been given a block more or less than its share.

The schedule repeats after Q slots, so only one period is ever computed, on the driver, whose size is a parameter (the sum
of the weights). When a source runs out, the others go on with their weights among themselves: a new phase, and no more
phases than weights. Where a document stands in its source is a prefix sum in two levels: over hash buckets of bounded size,
and within each. No task holds a source.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriquill.llm.common import cut, positional, renamed_back

BLOCK_BYTES = 64 << 10
#: Documents in one bucket of a source, about.
BUCKET_ROWS = 4096
#: The name under which sources without a weight of their own are pooled.
OTHERS = "*"
#: Bounds of the plan: blocks of a period, and entries over all phases (as many as sources end, times the period).
MOST_SLOTS, MOST_ENTRIES = 10_000, 2_000_000
COLUMNS = ("mix_source", "mix_bytes", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_start")


def period(weights: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """One period by earliest deadline first: (source, j, slot, release, deadline) of its Q blocks, in order of slot."""
    q = sum(weights.values())
    names = sorted(s for s, w in weights.items() if w > 0)
    waiting = [(0, -(-q // weights[s]), s, 0) for s in names]  # by release
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    out = []
    for slot in range(q):
        while waiting and waiting[0][0] <= slot:
            release, deadline, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        out.append((s, j, slot, release, deadline))
        if j + 1 < weights[s]:
            heapq.heappush(waiting, ((j + 1) * q // weights[s], -(-(j + 2) * q // weights[s]), s, j + 1))
    return out


def phases(weights: Mapping[str, int], blocks: Mapping[str, int]) -> list[dict]:
    """Runs of the schedule between the ends of sources: per phase and source, the first block, how many, and the period."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    start, out = 0, []
    while left:
        live = {s: weights[s] for s in left}
        q = sum(live.values())
        slots: dict[str, list[tuple[int, int, int]]] = {s: [] for s in live}
        for s, _, slot, release, deadline in period(live):
            slots[s].append((slot, release, deadline))
        # the slot of a source's last block; the phase ends with the first of them
        last = min((n - 1) // live[s] * q + slots[s][(n - 1) % live[s]][0] for s, n in left.items())
        for s in sorted(live):
            whole, rest = divmod(last + 1, q)
            n = whole * live[s] + sum(slot < rest for slot, _, _ in slots[s])
            out.append({"phase": len(out), "source": s, "first": done[s], "n": n, "start": start, "weight": live[s], "q": q, "slots": slots[s]})
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        start += last + 1
    return out


def schedule(
    df: DataFrame, weights: Mapping[str, int], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_bytes: int = BLOCK_BYTES, bucket_rows: int = BUCKET_ROWS, seed: int = 1
) -> DataFrame:
    """df (columns of these names give way) with mix_source, mix_bytes, mix_block, mix_release, mix_deadline, mix_slot and mix_start (bytes of the source before the row).

    Ordering by mix_slot, then mix_start and the id, is the mixture. A source that is null or has no weight is pooled as
    `*`, which then needs a weight. A null text has no bytes. Documents longer than a block take the slots of the blocks
    they reach into; they are laid out whole at their first block's slot, so a source's share of the bytes laid out so far
    is off its target by less than a block and its longest document. Rows alike in id and text stand side by side, other
    rows of one id or of none anywhere. Every row is kept; an empty table gives an empty one.
    """
    if any(w < 0 for w in weights.values()) or not 0 < sum(weights.values()) <= MOST_SLOTS:
        raise ValueError(f"weights are natural numbers with a sum of at most {MOST_SLOTS}")
    spark, like = df.sparkSession, df
    df, (id_col, text_col, source_col) = positional(df, id_col, text_col, source_col)
    named = [s for s, w in weights.items() if w > 0 and s != OTHERS]
    buckets = max(1, -(-df.count() // bucket_rows))
    key = F.xxhash64(F.lit(seed), df[id_col].cast("string"), df[text_col])  # the text too, so that rows that repeat an id spread
    rows = df.withColumns(
        {
            "mix_source": F.when(df[source_col].isin(named), df[source_col]).otherwise(F.lit(OTHERS)) if named else F.lit(OTHERS),
            "mix_bytes": F.coalesce(F.octet_length(df[text_col]), F.lit(0)).cast("long"),
            "mix_key": key,
            "mix_bucket": F.floor((key / 2.0**64 + 0.5) * buckets).cast("int"),
        }
    )
    sums = cut(rows.groupBy("mix_source", "mix_bucket").agg(F.sum("mix_bytes").alias("bytes")))
    totals = {r["mix_source"]: r["bytes"] for r in sums.groupBy("mix_source").agg(F.sum("bytes").alias("bytes")).collect()}  # as many as weights
    if totals.keys() - {s for s, w in weights.items() if w > 0}:
        raise ValueError(f"there are sources without a weight, and {OTHERS!r} has none")
    if sum(weights.values()) * len(totals) > MOST_ENTRIES:
        raise ValueError(f"{len(totals)} sources by {sum(weights.values())} blocks of a period are more than {MOST_ENTRIES} entries of a plan; divide the weights or pool sources as {OTHERS!r}")
    planned = phases(weights, {s: max(0, n - 1) // block_bytes + 1 for s, n in totals.items()})
    source, earlier = Window.partitionBy("source"), Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("bytes").over(source)
    before = sums.select(F.col("mix_source").alias("source"), F.col("mix_bucket").alias("bucket"), "bytes").select(
        "source",
        "bucket",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("before"),
        F.floor(F.greatest(total - 1, F.lit(0)) / block_bytes).cast("long").alias("last_block"),
    )
    inside = Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_key", id_col, "mix_bytes").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("mix_within", F.coalesce(F.sum("mix_bytes").over(inside), F.lit(0)))
    named_before = before.select(*[F.col(c).alias(f"mix_{c}_") for c in before.columns])
    placed = placed.join(named_before, (F.col("mix_source") == F.col("mix_source_")) & (F.col("mix_bucket") == F.col("mix_bucket_")))
    start = F.col("mix_within") + F.col("mix_before_")
    placed = placed.withColumn("mix_start", start).withColumn("mix_block", F.least(F.floor(F.col("mix_start") / block_bytes).cast("long"), F.col("mix_last_block_")))
    kind = "array<struct<mix_s: string, mix_from: long, mix_to: long, mix_at: long, mix_w: long, mix_q: long, mix_slots: array<struct<slot: long, release: long, deadline: long>>>>"
    names = ("slot", "release", "deadline")
    told = [{"mix_s": p["source"], "mix_from": p["first"], "mix_to": p["first"] + p["n"], "mix_at": p["start"], "mix_w": p["weight"], "mix_q": p["q"], "mix_slots": [dict(zip(names, x)) for x in p["slots"]]} for p in planned]
    plan = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(told)), kind)))
    # at most one row for each source and phase, with one entry for each unit of weight: bounded by the weights
    on = (F.col("mix_source") == F.col("mix_s")) & (F.col("mix_block") >= F.col("mix_from")) & (F.col("mix_block") < F.col("mix_to"))
    found = placed.join(F.broadcast(plan), on)
    j = F.col("mix_block") - F.col("mix_from")
    entry, offset = F.get("mix_slots", (j % F.col("mix_w")).cast("int")), F.col("mix_at") + F.floor(j / F.col("mix_w")).cast("long") * F.col("mix_q")
    timed = found.withColumns({f"mix_{name}": offset + entry[name] for name in ("release", "deadline", "slot")})
    return renamed_back(timed, like, *COLUMNS)


def mix(df: DataFrame, weights: Mapping[str, int], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of df with their columns only, laid out in the order of the mixture: partitions by ranges of slots, sorted inside.

    Null texts and ids, repeated rows and empty tables are as in `schedule`.
    """
    plain, names = positional(df, id_col, text_col, source_col)
    scheduled = schedule(plain, weights, *names, **options)
    return renamed_back(scheduled.repartitionByRange("mix_slot", "mix_start").sortWithinPartitions("mix_slot", "mix_start", names[0]), df)


def ranked(df: DataFrame, name: str = "mix_rank") -> DataFrame:
    """df with the place of each row, from 0, in the order in which it was written: what `mix` laid out, read again.

    Spark reads files in any order, so the place comes from the number in a file's name and the row's place in it; only
    the files' sizes in rows go to the driver. Rows that come from no file count in the order of their partitions.
    """
    try:
        at = df.select("*", F.col("_metadata.file_path").alias("mix_file"), F.col("_metadata.row_index").alias("mix_row"))
    except AnalysisException:
        place = F.monotonically_increasing_id()
        at = df.select("*", F.shiftright(place, 33).cast("string").alias("mix_file"), place.bitwiseAND((1 << 33) - 1).alias("mix_row"))
    sizes = at.groupBy("mix_file").agg(F.max("mix_row").alias("last")).collect()
    number = lambda path: int(m[1]) if (m := re.search(r"(?:part-|^)(\d+)[^/]*$", path)) else -1
    told, before = [], 0
    for r in sorted(sizes, key=lambda r: (number(r["mix_file"]), r["mix_file"])):
        told.append({"mix_path": r["mix_file"], "mix_before": before})
        before += r["last"] + 1
    files = df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(told)), "array<struct<mix_path: string, mix_before: long>>")))
    found = at.join(F.broadcast(files), at["mix_file"] == files["mix_path"])
    return found.select(*[at[c] for c in df.columns if c.lower() != name.lower()], (F.col("mix_before") + F.col("mix_row")).alias(name))
