"""Small tables with what real ones have: nulls, empty and very long texts, ties, repeated rows, columns with other uses."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, id long, N_TOKENS int, rows long, mix_slot string, print string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["the", "and", "of", "it", "in"] + ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(60)]
    return " ".join(r.choice(words) + r.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


def texts() -> list:
    long = prose(1, 30_000)
    near = prose(2, 300)
    return [
        (1, prose(3, 120)),
        (2, prose(3, 120)),  # a copy
        (3, None),
        (4, ""),
        (5, "  \n\t "),
        (6, long),
        (7, near),
        (8, near.replace("the ", "a ", 1)),
        (9, prose(4, 60) + " " + prose(3, 120) + " " + prose(5, 60)),  # a passage of another
        (10, "One"),
        (11, "one"),
        (11, "one"),  # a repeated row
        (12, "a b c a b c a b c " * 30),
        (13, "x" * 50_000),
        (14, "Ünïcode text ▁ mark <|endoftext|> <s> \U0001f600 \u0000 end"),
        (None, "no id " + prose(6, 80)),
        (15, prose(3, 120)),
        (16, "line\nline\n \nline two\nline two\n"),
    ]


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    sources = ["a", "a", "b", None, "zzz"]
    full = [(i, t, "en", sources[k % 5], None if t is None else len(t), 0.5, "f", 7, 1, 2, "m", "p") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS).repartition(3)
