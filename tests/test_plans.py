"""Queries of the plans: against their SQL on the smallest tables, and over texts longer than any of those tables."""

import random
from collections import Counter
from decimal import Decimal
from difflib import SequenceMatcher
from pathlib import Path

import duckdb
import pytest

from veriquill.functions import arrow
from veriquill.functions.alike import Blocks
from veriquill.functions.quotes import nearest_wording, normalised
from veriquill.plans import queries, worked


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["the", "and", "of", "it", "in"] + ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(60)]
    return " ".join(r.choice(words) + r.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


def test_summary_agreement_takes_every_text(spark, tmp_path):
    rows = [(1, prose(1, 900)), (2, prose(2, 900)), (3, None), (5, prose(3, 30)), (7, "ab" * 2500)]
    assert len(rows[0][1]) > 4000
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.match for r in queries.QUERIES["summary_agreement"](spark, str(tmp_path)).collect()}
    want = {i: SequenceMatcher(None, normalised(t), normalised(t[::-1])).ratio() >= 0.6 for i, t in rows if t and i % 2}
    assert got == want | {2: True, 3: True} and len(got) == len(rows)


def test_alikeness_is_that_of_the_ratio():
    import random

    r, seen = random.Random(3), set()
    for k in range(1500):
        a = "".join(r.choice("abcde fgh"[: r.randint(2, 9)]) for _ in range(r.randint(0, 300 if k % 9 == 0 else 40)))
        b = a[::-1] if k % 7 == 0 else "".join(c if r.random() < 0.6 else r.choice("abcxyz") for c in a)[r.randint(0, 9) :] + "ab" * r.randint(0, 3)
        want = SequenceMatcher(None, a, b).ratio() >= 0.6
        assert arrow._alike(a, b, 0.6) == want
        seen.add(want)
    assert seen == {True, False}


@pytest.mark.parametrize("letters, most", [("etaoin srhldu" * 40 + "qzxjkv.,\U0001f600", 90), ("".join(map(chr, range(0x4E00, 0x5200))), 90), ("ab", 90), ("".join(map(chr, range(97, 300))), 9)])
def test_longest_blocks_are_those_of_difflib(letters, most):
    """Common letters with rare ones, rare ones alone, common ones alone: whole texts and ranges of them, earliest of equals first."""
    r = random.Random(len(letters))
    for k in range(60):
        a = "".join(r.choice(letters) for _ in range(r.randint(200, 600)))
        at = r.randrange(len(a))
        b = "".join(r.choice(letters) if r.random() * 100 > most else c for c in (a[at:] + a[:at] if k % 3 else a[::-1]))
        m = SequenceMatcher(None, a, b)
        blocks = Blocks(a, b)
        for step, (x, y) in enumerate([(len(a), len(b)), *((r.randint(0, len(a)), r.randint(0, len(b))) for _ in range(6))], 1):
            u, v = r.randint(0, x), r.randint(0, y)
            ranges = (u, x, v, y) if step > 1 else (0, x, 0, y)
            assert blocks.longest(step, *ranges) == tuple(m.find_longest_match(*ranges))
        assert all(arrow._alike(a, b, least) == (m.ratio() >= least) for least in (0.2, 0.6, 0.9))


def test_normal_forms_are_those_of_the_layers():
    from veriquill.functions.layers import Layer
    from veriquill.functions.quotes import normal_layer

    r = random.Random(6)
    bits = ["a", "B", "É", "e\u0301", "ﬁ", "İ", "ΟΣ", "ß", " ", "\u00a0", "\n", "\t", "-\n ", "\u00ad", "\u00ad\n", "-", "—", "’", "“", "--- PAGE BREAK ---", "---page  break---", "½", "\u2028", "\x1f", "\\1", "Å"]
    for _ in range(400):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 30)))
        for keep in (False, True):
            for fold in (False, True):
                assert normalised(text, keep, fold) == normal_layer(Layer(text), keep, fold).text


def test_long_texts_are_compared_in_seconds():
    """Letters that are just not too common are the worst for difflib: each is met with all its places."""
    from time import process_time

    r = random.Random(4)
    text, began = "".join(chr(0x4E00 + r.randrange(110)) for _ in range(60_000)), process_time()
    assert not arrow._alike(text, text[::-1], 0.6)
    assert process_time() - began < 5


def test_evidence_tags_are_read_to_the_end(spark, tmp_path):
    import re

    pages = [(1, "x" * 5000 + "<li>late</li>"), (2, "<li>" + "y" * 4500 + "</li><li>z</li>"), (3, "<li>a<b>c</b></li>" + "w" * 4000), (4, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.n_quotes, r.first_quote, r.plain) for r in queries.QUERIES["evidence_tags"](spark, str(tmp_path)).collect()}
    for i, html in pages[:3]:
        found, inner = re.findall(r"(?s)<li>(.*?)</li>", html), re.findall(r"(?s)<li>([^<]*)</li>", html)
        assert got[i] == (len(found), found[0], found == inner and "<li><li>" not in html)


def test_nearest_wording_searches_whole_quotes(spark, tmp_path):
    quote = prose(7, 36).replace("\n", " ").strip()
    text = prose(8, 80) + " " + quote[:80] + " " + prose(9, 80) + " " + quote + " " + prose(10, 80)
    assert 200 < len(quote) < 300
    spark.createDataFrame([(4, quote)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.nearest for r in queries.QUERIES["nearest_wording"](spark, str(tmp_path)).collect()]
    # the prefix alone stands nearest at its first place, the whole quote at its second
    assert got == [nearest_wording(quote.replace("e", "o"), text)] and len(got[0]) > 150


SMALL = "/root/testdata/sf0.001"


def _plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return round(float(x), 9) if isinstance(x, (float, Decimal)) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(worked.SQL))
def test_queries_agree_with_their_sql(spark, duck, name):
    got = worked.QUERIES[name](spark, SMALL)
    want = duck.sql(worked.SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = [tuple(_plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall()]
    assert Counter(tuple(_plain(r[c]) for c in order) for r in got.collect()) == Counter(rows)


@pytest.mark.parametrize("name", ["context_windows", "quote_tiers"])
def test_capitals_keep_the_spelling(spark, tmp_path, name):
    """A passage in capitals is the same words: ß has no capital of one letter, and SS would be another spelling."""
    spark.createDataFrame([(1, "ein großes Maß an Straßen und Flüssen"), (5, "the end of all the roads")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(7, "Es gab ein großes Maß an Straßen und Flüssen.\nSo was the end of all the roads, too.")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    for table in ("benchmark", "documents"):
        db.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    got = sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect()))
    assert len(got) == 2 and got == sorted(db.execute(queries.SQL[name]).fetchall())


@pytest.mark.parametrize("name", ["context_windows", "quote_tiers"])
def test_near_copies_of_passages_are_no_pairs(spark, tmp_path, name):
    """Texts with a passage's first words only, or the passage in other letters or blanks, do not hold it as written."""
    passage = "Of all the roads that lead to the old mill, one is short."
    texts = [f"Say: {passage} So it is.", passage.replace("mill", "hill"), passage.upper(), passage.replace(" ", "  "), passage.replace(" old", "\nold"), passage[:-9], passage[:-1], None]
    spark.createDataFrame([(k, passage) for k in range(4)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    for table in ("benchmark", "documents"):
        db.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    got = sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect()))
    assert len(got) == 4 and got == sorted(db.execute(queries.SQL[name]).fetchall())
