"""Functions that Catalyst cannot express, over Arrow batches. Keep rows of one text together: its copies are made once."""

from __future__ import annotations

import json
from collections import Counter
from difflib import SequenceMatcher, get_close_matches

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from veriquill.functions import quotes
from veriquill.functions.alike import alike as _alike

# Types as objects: workers import this module, and cannot parse type strings.
STRING, STRINGS = T.StringType(), T.ArrayType(T.StringType())
PLACE = [T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
PART = T.StructType([*(T.StructField(c, STRING) for c in ("fragment", "reading", "tier")), *PLACE])
LOCATED = T.StructType([T.StructField("matched", T.BooleanType()), T.StructField("reading", STRING), T.StructField("tier", STRING), *PLACE, T.StructField("parts", T.ArrayType(PART))])
WINDOWS = T.ArrayType(T.StructType([*PLACE, T.StructField("text", STRING)]))


def _located(quote: str | None, text: str | None) -> dict:
    found = quotes.locate(quote, text)
    return {
        "matched": found.matched,
        "reading": found.reading,
        "tier": found.tier,
        "start": found.start,
        "end": found.end,
        "parts": [{"fragment": p.fragment, "reading": p.reading, "tier": p.tier, "start": p.start, "end": p.end} for p in found.parts],
    }


@pandas_udf(STRING)
def normalise_text(texts: pd.Series) -> pd.Series:
    return texts.map(quotes.normalised)


@pandas_udf(LOCATED)
def locate_quote(quote: pd.Series, text: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([_located(q, t) for q, t in zip(quote, text)], columns=["matched", "reading", "tier", "start", "end", "parts"])
    return out.astype({"start": "Int64", "end": "Int64"})


HINTED = T.StructType([*LOCATED.fields, T.StructField("nearest", STRING), T.StructField("reordered", T.BooleanType())])


def _hinted(quote: str | None, text: str | None) -> dict:
    found = _located(quote, text)
    lost = not found["matched"] and text is not None
    reordered = bool(lost and quotes.only_out_of_order(quote, text))
    return found | {"nearest": quotes.nearest_wording(quote, text) if lost and not reordered else None, "reordered": reordered}


def _each(kind: T.DataType, function):
    """A function of a list of quotes (nulls stay null) and their text, as a column function: the text's copies are made once."""

    def apply(listed: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([None if some is None else [None if q is None else function(q, t) for q in some] for some, t in zip(listed, text)], dtype=object)

    apply.__annotations__ = {"listed": pd.Series, "text": pd.Series, "return": pd.Series}
    return pandas_udf(apply, T.ArrayType(kind))


locate_quotes, hint_quotes, nearest_wordings = _each(LOCATED, _located), _each(HINTED, _hinted), _each(STRING, quotes.nearest_wording)


@pandas_udf(STRING)
def nearest_wording(quote: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([quotes.nearest_wording(q, t) for q, t in zip(quote, text)], dtype=object)


@pandas_udf(T.BooleanType())
def out_of_order(quote: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([bool(q and t is not None and quotes.only_out_of_order(q, t)) for q, t in zip(quote, text)])


def _windows(quote: str | None, text: str | None, budget: int) -> list[dict] | None:
    found = quotes.context_windows(quote, text, budget)
    return None if found is None else [{"start": w[0], "end": w[1], "text": quotes.marked_window(text, w)} for w in found]


def quote_windows(budget: int):
    return _each(WINDOWS, lambda quote, text: _windows(quote, text, budget))


def canonical(value) -> str:
    """JSON with sorted keys, no blanks, and all but ASCII escaped: the text that hashes are taken of."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


@pandas_udf(STRING)
def canonical_json(raw: pd.Series) -> pd.Series:
    return raw.map(lambda r: None if r is None else canonical(json.loads(r)))


DIFFS = T.ArrayType(T.StructType([*(T.StructField(c, STRING) for c in ("path", "before", "after")), T.StructField("changed", T.BooleanType())]))


@pandas_udf(DIFFS)
def field_diffs(raw: pd.Series) -> pd.Series:
    """The entries of a JSON object of {before, after}, in order: values as JSON text, and whether they differ as Python's values do."""

    def entries(text):
        given = json.loads(text) if text is not None else None
        pairs = [(path, d.get("before"), d.get("after")) for path, d in given.items() if isinstance(d, dict)] if isinstance(given, dict) else []
        return [{"path": path, "before": json.dumps(a, ensure_ascii=False), "after": json.dumps(b, ensure_ascii=False), "changed": a != b} for path, a, b in pairs]

    return raw.map(entries)


@pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


@pandas_udf(T.BooleanType())
def sequences_alike(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """Whether the ratio of `sequence_ratio` is at least that."""
    return pd.Series([None if x is None or y is None else _alike(x, y, n) for x, y, n in zip(a, b, least)], dtype=object)


RANKED = T.ArrayType(T.StructType([T.StructField("canonical", STRING), T.StructField("ratio", T.DoubleType())]))


def _nearest_names(form: str, names: list[tuple[str, str]], n: int) -> list[tuple[float, str]]:
    """The n entries most like the form, best first and ties by name, from (canonical, form) pairs of names and aliases.

    The characters two texts share bound their ratio, so pairs are compared from the highest bound down until the n-th best
    entry is better than what is left can be.
    """
    have, matcher = Counter(form), SequenceMatcher()
    bounds = sorted((-2.0 * (have & Counter(other)).total() / (len(form) + len(other)) if form or other else -1.0, canonical, other) for canonical, other in names)
    best: dict[str, float] = {}
    for bound, canonical, other in bounds:
        if len(best) >= n and (bound, canonical) > sorted((-r, c) for c, r in best.items())[n - 1]:
            if bound > sorted(-r for r in best.values())[n - 1]:
                break
            continue
        matcher.set_seqs(form, other)
        best[canonical] = max(best.get(canonical, 0.0), matcher.ratio())
    return sorted((-r, c) for c, r in best.items())[:n]


@pandas_udf(RANKED)
def nearest_names(form: pd.Series, names: pd.Series, n: pd.Series) -> pd.Series:
    made = [[{"canonical": c, "ratio": -r} for r, c in _nearest_names(f, [(x["canonical"], x["other"]) for x in some], int(k))] for f, some, k in zip(form, names, n)]
    return pd.Series(made, dtype=object)


@pandas_udf(STRINGS)
def closest_names(name: pd.Series, candidates: pd.Series) -> pd.Series:
    """At most three candidates with a ratio of 0.6 or more, closest first."""
    return pd.Series([get_close_matches(n or "", list(c), n=3, cutoff=0.6) for n, c in zip(name, candidates)], dtype=object)


def register(spark: SparkSession) -> None:
    """Make the kernel callable from SQL."""
    for name, function in (("locate_quote", locate_quote), ("normalise_quote", normalise_text), ("canonical_json", canonical_json), ("seq_ratio", sequence_ratio)):
        spark.udf.register(name, function)
