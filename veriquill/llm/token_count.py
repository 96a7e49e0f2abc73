"""Token counts by the whole-token shortcut.

A byte-fallback piece model whose normaliser only puts a marker for every blank (and one in front) never merges across
the start of a run of markers, if no piece of the vocabulary holds a marker after another character. That is checked
when the model is loaded (`prove`). The text then falls into segments, each a run of markers and what follows up to the
next run, and the count of a text is the sum over its segments.

Of those segments, every vocabulary string that is proved to encode alone as one token counts as one by a look-up; only
the others are merged, each distinct one once while it stays in the worker's bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veriquill.llm.common import id_field, map_batches

MARK = "▁"
#: Merged segments that a worker remembers before it starts afresh.
REMEMBERED = 300_000
#: Longer segments are merged but not remembered.
LONG_SEGMENT = 200
RUNS = re.compile(f"{MARK}+[^{MARK}]*")


# Numbers of the fields, and of the kinds, that a model file has for what is proved.
PIECE, TRAINER, NORMALISER, KIND, USER_DEFINED, MODEL_TYPE, MERGES = 1, 2, 3, 3, 4, 3, 2
CHARACTER_MAP, DUMMY_PREFIX, REMOVES_BLANKS, ESCAPES_BLANKS, RULES, SUFFIX = 2, 3, 4, 5, 6, 24


def message_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: number, and value or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class PieceCounter:
    """Counts tokens of whole texts as the library encodes them, without begin, end or other added tokens."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        with open(model_path, "rb") as f:
            self.file = f.read()
        self.single = self.prove()
        self.counts: dict[str, int] = dict(self.single)

    def prove(self) -> dict[str, int]:
        """The vocabulary strings (without their first marker) that alone are one token.

        Raises ValueError if the model's pieces, its kind or its normaliser, as its file states them, do not allow a text to
        be cut at markers.
        """
        model = self.model
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece goes on after a marker; texts cannot be cut there")
        whole = list(message_fields(self.file))
        if any(dict(message_fields(v)).get(KIND) == USER_DEFINED for k, v in whole if k == PIECE):
            raise ValueError("a user-defined piece is matched before any merge, wherever it stands")
        spec, trained = (dict(message_fields(next((v for k, v in whole if k == part), b""))) for part in (NORMALISER, TRAINER))
        # what the file leaves out is true, but for the map, the rules and the suffix
        if spec.get(CHARACTER_MAP) or spec.get(RULES) or spec.get(REMOVES_BLANKS, 1) or not spec.get(DUMMY_PREFIX, 1) or not spec.get(ESCAPES_BLANKS, 1):
            raise ValueError("the normaliser does more than mark blanks")
        if trained.get(MODEL_TYPE) != MERGES or trained.get(SUFFIX):
            raise ValueError("the model does not merge pieces, or marks blanks behind words")
        del self.file
        marked = [p for i, p in enumerate(pieces) if p.startswith(MARK) and not model.is_control(i)]
        # encode() adds a marker in front, so the piece's first one is left off; the lone marker is what merges nothing.
        found = {p[1:]: 1 for p, ids in zip(marked, model.encode([p[1:] for p in marked])) if len(ids) == 1}
        return found | {"": 1}

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(MARK, " ")
        if text[0] == " " or text[-1] == " " or "  " in text:
            words = [w[1:].replace(MARK, " ") for w in RUNS.findall(MARK + text.replace(" ", MARK))]
        else:
            words = text.split(" ")
        counts = self.counts
        try:
            return sum([counts[w] for w in words])
        except KeyError:
            pass
        if len(counts) > REMEMBERED + len(self.single):
            self.counts = counts = dict(self.single)
        missing = list({w for w in words if w not in counts})
        new = dict(zip(missing, map(len, self.model.encode(missing, num_threads=1))))
        total = sum([counts[w] if w in counts else new[w] for w in words])
        counts.update((w, n) for w, n in new.items() if len(w) <= LONG_SEGMENT)
        return total


_COUNTERS: dict[str, PieceCounter] = {}


def counter(model_path: str) -> PieceCounter:
    """One counter per worker process and model."""
    if model_path not in _COUNTERS:
        _COUNTERS[model_path] = PieceCounter(model_path)
    return _COUNTERS[model_path]


def token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Per row of df: its id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids each give a row; an empty table gives an
    empty one. Other columns of df are ignored. Texts are counted whole, however long, a batch of bounded bytes at a time.
    No shuffle: texts pass through the workers once, counts come back.
    """
    schema = T.StructType(
        [id_field(df, id_col), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    )

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        count = counter(model_path).count
        texts = [t or "" for t in batch.column(1).to_pylist()]
        tokens = [count(t) for t in texts]
        return {
            id_col: batch.column(0),
            "n_bytes": [len(t) if t.isascii() else len(t.encode()) for t in texts],
            "n_tokens": tokens,
            "over_limit": [n > limit for n in tokens],
        }

    return map_batches(df.select(df[id_col], df[text_col]), make, schema)
