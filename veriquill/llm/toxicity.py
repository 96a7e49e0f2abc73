"""Toxicity by maximum-scoring segments over token log-odds, calibrated by extreme values.

Tokens get log-odds of toxic against other labelled documents under a Dirichlet prior, less a margin of standard errors,
so that only well-supported tokens score above nothing; every other token costs a small gap. One linear scan finds all
maximal scoring segments of a text. The best segment of a text of n tokens that is not toxic has an extreme-value
distribution: it reaches S with probability p = 1 - exp(-K n exp(-lambda S)). Lambda and K are the most likely ones for
labelled rows that are not toxic, scored with weights that they had no part in. -log p is a segment's evidence; a
document's is that of all its significant segments; a logistic curve over the labelled rows that have any, scored likewise, makes it a probability, and
texts without have the share of toxic ones among theirs. For that the labelled rows are dealt into folds, each scored with the weights of the others; the model's own
weights come from all.

The model is fitted on a bounded sample of labelled rows (`sample_rows`); scoring covers every token of every text.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass, field
from math import exp, expm1, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from veriquill.llm.common import bounded_batches, cut, id_field, map_batches, narrow

#: Labelled rows that the model is fitted on, those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
#: Rows whose features a worker counts before it passes the counts on.
COUNTED_TOGETHER = 64
#: Parts of these that are scored with the weights of the others.
FOLDS = 3
#: Weight of the Dirichlet prior as a share of all counts; it is spread as the features are in both classes together.
PRIOR = 0.01
#: Standard errors taken off a feature's log-odds, and the least that must remain.
MARGIN, LEAST = 2.5, 1.0
#: Cost of a token that is no toxic feature.
GAP = 0.05
#: A segment counts if chance makes one as good in fewer than this share of texts of that length.
CHANCE = 0.05
#: Lambda and K of a scale of log-likelihood ratios, and how many observations that prior is worth.
PRIOR_LAMBDA, PRIOR_K, PRIOR_ROWS = 1.0, 0.01, 5.0
CUTOFF = 0.3
#: Features of a word are the word and its beginnings of these lengths, for stems that take many endings.
BEGINNINGS = (4, 5, 6, 7, 8)
#: A beginning is no stem if one word has more than this share of its toxic counts.
ONE_WORD = 0.6
WORD = re.compile(r"\w+")
#: Longer words are known by their beginning and their digest.
LONGEST_WORD = 40


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def features(word: str) -> list[str]:
    whole = word if len(word) <= LONGEST_WORD else f"{word[: BEGINNINGS[-1]]}~{hashlib.blake2b(word.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"
    return [f"={whole}", *(f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n)]


@dataclass
class ToxicityModel:
    """Feature scores, the extreme-value constants, and the curve from evidence to probability. As large as the sample it was fitted on allows."""

    scores: dict[str, float] = field(default_factory=dict)
    rate: float = PRIOR_LAMBDA
    k: float = PRIOR_K
    without: float = 0.0  # the probability of a text without evidence
    intercept: float = -30.0
    slope: float = 0.0

    def __post_init__(self):
        self.heads = frozenset(f[1:4] for f in self.scores)

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """Places of the words that score above nothing, and their scores."""
        heads, get = self.heads, self.scores.get
        found = []
        for i in [i for i, w in enumerate(words) if w[:3] in heads]:
            best = max(get(f, 0.0) for f in features(words[i]))
            if best > 0:
                found.append((i, best))
        return found

    def segments(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """All maximal scoring segments as (first word, word after the last, score), and the number of words."""
        words = WORD.findall(text.lower())
        return maximal_segments(self.hits(words)), len(words)

    def surprise(self, score: float, n: int) -> float:
        """-log of the probability that the best of n words' segments reaches the score by chance."""
        expected = self.k * n * exp(-self.rate * score)
        return -log(-expm1(-expected)) if expected > 1e-12 else self.rate * score - log(self.k * n)

    def evidence(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The text's evidence, and its significant segments with theirs."""
        found, n = self.segments(text)
        strong = [(a, b, e) for a, b, s in found if (e := self.surprise(s, n)) > -log(CHANCE)]
        return sum(e for _, _, e in strong), strong

    def probability(self, evidence: float) -> float:
        """It never falls as evidence grows."""
        if evidence <= 0:
            return self.without
        return max(self.without, 1 / (1 + exp(-max(-30.0, min(30.0, self.intercept + self.slope * evidence)))))


def maximal_segments(hits: list[tuple[int, float]], gap: float = GAP) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences of a sequence with those scores at those places and -gap everywhere else.

    The stack keeps for every candidate the cumulative sums before it and at its end. A new score joins candidates from
    the last one down whose sum before is lower than its own, while their sum at the end is lower too. Each hit enters
    and leaves once, apart from the search for a lower sum, which follows links: linear in the hits.
    """
    stack: list[list] = []  # start, end, sum before, sum at end, index of the nearest candidate with a lower sum before
    total, place = 0.0, 0
    for i, score in hits:
        before = total - gap * (i - place)
        total, place = before + score, i + 1
        new = [i, i + 1, before, total, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new[0], new[2] = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, end - start) for a, b, start, end, _ in stack]


def extreme_values(best: np.ndarray, n: np.ndarray, least: float = LEAST) -> tuple[float, float]:
    """The most likely lambda and K for texts of n words whose best segments score `best`; 0 is a text without a segment.

    No segment scores under `least`, so a text without one says that its best is lower than that. The prior is worth
    PRIOR_ROWS observations; lambda is searched on a grid, K is then in closed form.
    """
    order = np.lexsort((n, best))  # the same sums whatever order the rows come in
    best, n = best[order], n[order].astype(float)
    seen, at_least = best > 0, np.maximum(best, least)
    weight = seen.sum() + PRIOR_ROWS
    top = (0.0, PRIOR_LAMBDA, PRIOR_K)
    for i, rate in enumerate(np.geomspace(0.05, 5, 400).tolist()):
        k = weight / ((n * np.exp(-rate * at_least)).sum() + PRIOR_ROWS / PRIOR_K)
        likelihood = weight * log(rate * k) - rate * (best[seen].sum() + PRIOR_ROWS / PRIOR_LAMBDA)
        if i == 0 or likelihood > top[0]:
            top = (likelihood, rate, k)
    return top[1], float(top[2])


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on at most sample_rows labelled rows that are not held out.

    Labels that are null or whose id is null are not used; of an id labelled twice the larger label counts, of rows that
    repeat an id the one with the smallest sketch. Copies of a text with one label count once (by three minima of its
    shingles' hashes). Without both classes no feature scores, and the probability is about 1 if all labels are toxic,
    else about 0. What reaches the driver is counts of the sample's features and a few numbers for each of its rows.
    """
    named = narrow(labels, id=id_col, label=label_col).where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
    sample = named.groupBy("id").agg(F.max("label").cast("int").alias("label")).orderBy(F.xxhash64(F.lit("toxicity"), "id"), "id").limit(sample_rows)
    train = narrow(docs, id=id_col, text=text_col).join(F.broadcast(sample), "id").select("id", "label", "text")

    def sketches(batch: pa.RecordBatch) -> dict[str, list]:
        import xxhash

        out = []
        for text in batch.column(2).to_pylist():
            w = (text or "").split()
            hashes = {xxhash.xxh64_intdigest(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))}
            least = [min((h for h in hashes if h % 3 == part), default=0) for part in range(3)]
            out.append(xxhash.xxh64_intdigest(repr(least)) >> 1)
        return {"id": batch.column(0), "label": batch.column(1), "text": batch.column(2), "sketch": out}

    kept = T.StructType([T.StructField("id", train.schema["id"].dataType), T.StructField("label", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("sketch", T.LongType())])
    read = cut(map_batches(train, sketches, kept))  # the one pass over documents
    heads = read.groupBy("id", "label").agg(F.min("sketch").alias("sketch")).groupBy("sketch", "label").agg(F.min("id").alias("id"))
    once = cut(read.join(heads, ["id", "label", "sketch"]).groupBy("id", "label", "sketch").agg(F.first("text").alias("text")).withColumn("fold", F.pmod("sketch", F.lit(FOLDS)).cast("int")))

    folds = [f"fold{k}" for k in range(FOLDS)]

    def counted(rows: DataFrame, wanted: frozenset | None) -> pd.DataFrame:
        """How many rows of each fold have each feature (of the wanted ones, if given); the feature "" counts words."""

        def make(batch: pa.RecordBatch) -> dict[str, list]:
            found = [Counter() for _ in folds]
            for text, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(WORD.findall((text or "").lower()))  # each once a document, so that no document decides
                found[fold][""] += len(words)
                found[fold].update([f for w in words for f in features(w) if wanted is None or f in wanted])
            names = sorted(set().union(*found))
            return {"feature": names} | {c: [of[f] for f in names] for c, of in zip(folds, found)}

        made = map_batches(rows.select("text", "fold"), make, T.StructType([T.StructField("feature", T.StringType()), *(T.StructField(c, T.LongType()) for c in folds)]), COUNTED_TOGETHER)
        summed = made.groupBy("feature").agg(*[F.sum(c).alias(c) for c in folds])
        return summed.where(f"{' + '.join(folds)} > 2 or feature = ''" if wanted is None else "true").toPandas().set_index("feature")

    # only what toxic rows have can score, so that is all that is counted in the others
    in_toxic = counted(once.where("label > 0"), None).sort_index()
    in_other = counted(once.where("label <= 0"), frozenset(in_toxic.index))
    if not len(in_toxic) or not in_toxic.loc[""].sum() or "" not in in_other.index or not in_other.loc[""].sum():
        return ToxicityModel(without=1.0 if len(in_toxic) and in_toxic.loc[""].sum() else 0.0)
    names = in_toxic.index.tolist()
    toxic, other = in_toxic.to_numpy(), in_other.reindex(names, fill_value=0).to_numpy()
    without = [weights(names, toxic.sum(1) - toxic[:, k], other.sum(1) - other[:, k]) for k in range(FOLDS)]
    model = ToxicityModel(weights(names, toxic.sum(1), other.sum(1)))

    def segments(batch: pa.RecordBatch) -> dict[str, list]:
        models = [ToxicityModel(w) for w in without]
        found = [models[k].segments(t or "") for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        return {"label": batch.column(0), "n": [n for _, n in found], "scores": [[s for _, _, s in segs] for segs, _ in found]}

    shape = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("scores", T.ArrayType(T.DoubleType()))])
    seen = map_batches(once.select("label", "text", "fold"), segments, shape).toPandas()  # at most sample_rows rows
    is_toxic, n, scores = seen["label"].to_numpy() > 0, seen["n"].to_numpy(), [list(x) for x in seen["scores"]]
    clean = ~is_toxic & (n > 0)
    model.rate, model.k = extreme_values(np.array([max(scores[i], default=0.0) for i in np.flatnonzero(clean)]), n[clean])
    evidence = np.array([sum(e for s in x if (e := model.surprise(s, words)) > -log(CHANCE)) for x, words in zip(scores, n.tolist())], float)
    some = evidence > 0
    model.without = (is_toxic & ~some).sum().item() / (1 + (~some).sum().item())
    model.intercept, model.slope = logistic(evidence[some], is_toxic[some].astype(float))
    model.slope = max(0.0, model.slope)
    return model


def weights(names: list[str], toxic: np.ndarray, other: np.ndarray) -> dict[str, float]:
    """The scores of features, from how many toxic and other documents have them; the feature "" counts all words."""
    n1, n0 = (int(x[names.index("")]) for x in (toxic, other))
    largest: dict[str, int] = {}
    for name, count in zip(names, toxic.tolist()):
        if name[:1] == "=":
            for n in BEGINNINGS:
                if len(name) > n:
                    stem = f"^{name[1 : n + 1]}"
                    largest[stem] = max(largest.get(stem, 0), count)
    alpha, mass = PRIOR * (toxic + other), PRIOR * (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = [np.log((c + alpha) / (n + mass - c - alpha)) for c, n in ((toxic, n1), (other, n0))]
        scores = odds[0] - odds[1] - MARGIN * np.sqrt(1 / (toxic + alpha) + 1 / (other + alpha))
    found = zip(names, toxic.tolist(), scores.tolist())
    return {f: s for f, c, s in found if f and c > 2 and s >= LEAST and largest.get(f, 0) <= ONE_WORD * c}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, the slope held by a ridge, by Newton's steps."""
    order = np.lexsort((y, x))  # the same sums whatever order the rows come in
    x, y = x[order], y[order]
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([(y - p).sum() - 1e-3 * a, ((y - p) * x).sum() - ridge * b])
        h = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.clip(np.linalg.solve(h, g), -5, 5)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def score_toxicity(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """Per row: id, score (0 to 1), predicted (1 if score >= cutoff), n_passages, passages (first word, end, evidence).

    A null or empty text has no passage and the score of no evidence. Repeated rows and null ids each give a row; an
    empty table gives an empty one; other columns are ignored. Linear in the text; no shuffle.
    """
    passage = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("evidence", T.DoubleType())])
    schema = T.StructType(
        [id_field(df, id_col), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_passages", T.LongType()), T.StructField("passages", T.ArrayType(passage))]
    )

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        found = [model.evidence(t or "") for t in batch.column(1).to_pylist()]
        scores = [model.probability(e) for e, _ in found]
        return {
            id_col: batch.column(0),
            "score": scores,
            "predicted": [int(s >= cutoff) for s in scores],
            "n_passages": [len(p) for _, p in found],
            "passages": [[{"start": a, "end": b, "evidence": e} for a, b, e in p] for _, p in found],
        }

    return map_batches(df.select(df[id_col], df[text_col]), make, schema)


def keep_clean(df: DataFrame, model: ToxicityModel, text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of df that are not predicted toxic, with all their columns.

    A null or empty text has no evidence, so it stays unless all labels were toxic. Repeated rows and null ids are judged
    row by row; an empty table gives an empty one. Whole texts are read, however long, in time linear in them.
    """

    bounded_batches(df.sparkSession)

    @pandas_udf(T.BooleanType())
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model.probability(model.evidence(t or "")[0]) < cutoff)

    return df.where(clean(df[text_col]))
