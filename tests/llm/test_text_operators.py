import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from veriquill.llm import html_text, mixing, packing, pii, quality, simhash, substring, token_count, toxicity
from veriquill.llm.queries import BYTE_BPE_SPECIAL

from .fixtures import frame, prose, texts

PACK = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, BYTE_BPE_SPECIAL)
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = [(100 + k, t) for k, t in enumerate(["a  b", " a", "a ", "▁", "\n\n", "a　b", "   ", "▁▁a b▁ c", "𝔘n", "1234567 89", "don't  stop\t now", "<unk></s>"])]
    got = token_count.token_counts(frame(spark, texts() + odd), path, limit=50).collect()
    want = Counter((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 50) for i, t in texts() + odd)
    assert Counter(map(tuple, got)) == want
    assert token_count.token_counts(frame(spark, []), path).collect() == []


def test_models_that_cannot_be_cut_are_refused(tmp_path):
    """Files that differ from a good one in what the proof reads: blanks that are removed, a marker behind words, no marker in front."""
    data = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    spec = b"\x0a\x08identity\x12\x00\x18\x01\x20\x00"
    assert data.count(spec) == 1 and data.count(b"\xc0\x01\x00") >= 1
    for k, changed in enumerate((spec[:-1] + b"\x01", spec[:-3] + b"\x00" + spec[-2:])):
        path = tmp_path / f"{k}.model"
        path.write_bytes(data.replace(spec, changed))
        with pytest.raises(ValueError, match="normaliser"):
            token_count.PieceCounter(str(path))
    assert list(token_count.message_fields(b"\x08\x96\x01\x12\x02hi\x1d\x00\x00\x80\x3f")) == [(1, 150), (2, b"hi"), (3, b"\x00\x00\x80\x3f")]


def test_token_counter_forgets_and_still_counts(monkeypatch):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    monkeypatch.setattr(token_count, "REMEMBERED", 3)
    counter, sp = token_count.PieceCounter(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for k in range(20):
        assert counter.count(prose(k, 30)) == len(sp.encode(prose(k, 30)))


def test_pieces_are_a_cut_of_every_document(spark):
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(PACK[0])
    rows = packing.pack(frame(spark), *PACK, length=64, group_docs=4).collect()
    want = Counter((i, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in [*hf.encode(t or "", add_special_tokens=False).ids, 1]))) for i, t in texts())
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for found in bins.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 64
    for (doc, total), found in pieces.items():
        n = sum(1 for r in found if r.start == 0)
        assert sorted(r.start for r in found) == sorted(s for _ in range(n) for s in range(0, total, 64))
        assert sum(r.length for r in found) == n * total
    whole = packing.pack(frame(spark), *PACK, length=1 << 20).collect()
    assert Counter((r.doc_id, r.ids_crc32) for r in whole) == want
    assert packing.pack(frame(spark, []), *PACK).collect() == []


def test_first_fit_decreasing_is_the_plain_one():
    import random

    r = random.Random(0)
    for _ in range(50):
        sizes = [r.randint(1, 20) for _ in range(r.randint(0, 60))]
        bins, offsets = packing.first_fit_decreasing(sizes, 20)
        load = []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            b = next((b for b, x in enumerate(load) if x + sizes[i] <= 20), len(load))
            load += [0] * (b == len(load))
            assert (bins[i], offsets[i]) == (b, load[b])
            load[b] += sizes[i]
    with pytest.raises(ValueError):
        packing.first_fit_decreasing([21], 20)


def test_fallback_tokenizer_gives_the_same_ids():
    t = packing.Tokens(*PACK)
    text = prose(9, 200) + " <|endoftext|> é 😀  \n\n  x"
    fast = t.ids(text).tolist()
    t.fast = None  # any call on it fails
    assert t.ids(text).tolist() == fast


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>if (a<b) x("</p>")</script></head><body>
<header class="site"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-banner">We use the cookies for all of you and that is it.</div>
<article><h1>A &amp; B&nbsp;title</h1><p>The cat <b>sat</b> on the mat,<br>and it was of the opinion that this is a good place to be for all the day.</p><p>Short.</p>
<aside>The aside is not of it and it is to go.</aside><form><p>The form is not of it.</p></form><div id="comments"><p>The comment is not of it.</p></div><p>End&#33;</article>
<div class="ad">The ad is for all.</div><footer>&copy; The site</footer></body></html>"""


def test_main_text_of_pages(spark):
    assert html_text.main_text(PAGE).split("\n") == ["A & B title", "The cat sat on the mat, and it was of the opinion that this is a good place to be for all the day.", "Short.", "End!"]
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (3, "v", ""), (None, "w", "<p>a <"), (4, "x", "<b>" * 20_000 + "<p" * 20_000), (5, "y", "<div class=x>" * 5000 + "text")]
    df = spark.createDataFrame([(*r, "keep", 1) for r in rows], "page_id long, url string, html string, text string, N_CHARS int")
    got = html_text.extract_main_text(df).collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter(r[:2] for r in rows)
    assert all(r.n_chars == len(r.text) for r in got) and {r.page_id: r.text for r in got}[2] == ""
    assert html_text.extract_main_text(df.limit(0)).collect() == []


def test_neighbours_decide_short_blocks():
    prose_block = "<div>" + "It is the way of the world that all of this was to be in the end. " * 3 + "</div>"
    links = '<div><a href="/a">one</a> <a href="/b">two</a></div>'
    assert "tiny" in html_text.main_text(f"{prose_block}<div>tiny</div>{links}")
    assert "tiny" not in html_text.main_text(f"{prose_block}{links}<div>tiny</div>{links}")


PROSE = "<p>The cat sat on the mat and it was of the opinion that this is a good place to be for all the day.</p><p>It is the way of the world that all of this was to be in the end, as they say.</p>"
PLAIN = html_text.main_text(f"<article>{PROSE}</article>")


@pytest.mark.parametrize("name", ["content with-sidebar", "post no-sidebar", "search-results", "article-comments-open", "has-banner", "page social-ready", "sidebar", "noticeBoard", "cookie-banner"])
def test_a_wrapper_keeps_the_page_whatever_its_name(name):
    around = '<nav><a href="/">Home</a></nav><div class="sidebar"><p>The sidebar is of the opinion that it is not the article at all, and it is to go.</p></div>'
    assert PLAIN.count("\n") == 1
    for page in (f'<div class="{name}">{PROSE}</div>', f'<div id="{name}">{PROSE}{around}</div>', f'<div class="{name}"><article>{PROSE}</article></div>{around}'):
        assert html_text.main_text(page) == PLAIN


@pytest.mark.parametrize("name", ["sidebar", "comments", "comment-list", "commentList", "ad", "ad-slot", "cookie-banner", "site-footer", "related-posts", "share", "newsletter-form", "sidebar-left"])
def test_marked_elements_beside_the_article_go(name):
    assert html_text.main_text(f'<div>{PROSE}</div><div class="{name}">{PROSE}{PROSE}</div>') == PLAIN
    assert html_text.main_text(f'<article>{PROSE}<div class="{name}">{PROSE}</div></article>') == PLAIN
    assert html_text.main_text(f'<article><p>One <span class="{name}">not this</span> and two.</p>{PROSE}</article>') == "One and two.\n" + PLAIN


def test_names_that_only_hold_a_mark_keep_their_paragraphs():
    for name in ("notice-period", "share-price", "menu-costs", "searching"):
        assert html_text.main_text(f'<article>{PROSE}<p class="{name}">It is of three months.</p></article>') == PLAIN + "\nIt is of three months."


def test_languages_without_listed_stop_words():
    it = "Il gatto nero dormiva sopra una vecchia sedia di legno mentre fuori pioveva senza sosta, e nessuno osava svegliarlo."
    zh = "今天天气很好，我们去公园散步，看到了很多花和树，孩子们在草地上玩耍，老人们在长椅上聊天。" * 2
    for text in (it, zh, "кот спал на старом стуле, пока за окном весь день шёл дождь и никто не решался его разбудить."):
        page = f'<ul><li><a href="/">Home</a></li></ul><div><p>{text}</p><p>{text}</p></div><div><p>We use the cookies for all of you and it is that.</p></div>'
        assert html_text.main_text(page).split("\n")[:2] == [text, text]


def test_the_second_pass_is_the_plain_one():
    import random

    r = random.Random(12)
    for _ in range(2000):
        n = r.randint(0, 12)
        labels, inside = [r.choice([None, None, True, False]) for _ in range(n)], [r.random() < 0.3 for _ in range(n)]
        want = []
        for i, label in enumerate(labels):
            decided = [j for j in range(n) if labels[j] is not None]
            sides = [[j for j in decided if j < i][-1:], [j for j in decided if j > i][:1]]
            near = sorted((abs(i - j), not labels[j]) for side in sides for j in side)
            want.append(label if label is not None else (bool(near) and not near[0][1]) or (True not in labels and inside[i]))
        assert html_text.spread(labels, inside) == want


def labelled_pages():
    """Pages put together from parts, with their main text: layouts as sites of several kinds have them, in five languages."""
    import random

    r = random.Random(31)
    sentences = {
        "en": "The river rose in the night and by morning it had reached the lower streets of the town. Nobody had been warned, and many of the shops were open as usual.",
        "de": "Der Fluss stieg in der Nacht und am Morgen hatte er die unteren Straßen der Stadt erreicht. Niemand war gewarnt, und viele der Läden waren wie immer offen.",
        "fr": "La rivière est montée dans la nuit et au matin elle avait atteint les rues basses de la ville. Personne n'avait été averti, et les magasins étaient ouverts.",
        "es": "El río subió en la noche y por la mañana había llegado a las calles bajas de la ciudad. Nadie había sido avisado, y las tiendas estaban abiertas.",
        "it": "Il fiume salì nella notte e al mattino aveva raggiunto le strade basse della città. Nessuno era stato avvertito, e molti negozi erano aperti come sempre.",
    }
    frames = ["<article>{}</article>", "<main>{}</main>", '<div class="content with-sidebar">{}</div>', "<div>{}</div>", '<div id="page" class="has-banner"><section>{}</section></div>', '<form id="aspnetForm">{}</form>']
    for k in range(300):
        lang, frame_of = list(sentences)[k % 5], frames[k % len(frames)]
        paragraphs = [f"{sentences[lang]} {j}." * r.randint(1, 3) for j in range(r.randint(2, 6))]
        notes = [f'<div class="{c}"><p>{sentences[lang]}</p></div>' for c in r.sample(["sidebar", "comments", "cookie-banner", "related-posts", "ad", "newsletter"], 2)]
        menu = "<ul>" + "".join(f'<li><a href="/{j}">Item {j} of the menu</a></li>' for j in range(8)) + "</ul>"
        body = "<h1>The flood</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + (notes[0] if r.random() < 0.5 else "")
        yield f'<html><body><header>{menu}</header><nav>{menu}</nav>{frame_of.format(body)}{notes[1]}<div>{menu}</div><footer>© 2020 all rights of the site</footer></body></html>', "\n".join(["The flood", *paragraphs])


def test_words_of_labelled_pages():
    found = kept = whole = 0
    for page, text in labelled_pages():
        got, want = Counter(html_text.main_text(page).split()), Counter(text.split())
        found, kept, whole = found + (got & want).total(), kept + got.total(), whole + want.total()
    print(f"precision {found / kept:.4f}, recall {found / whole:.4f}")
    assert found / kept > 0.98 and found / whole > 0.98


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(d)]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_are_those_of_the_patterns(spark):
    import random

    r = random.Random(5)
    alphabet = ["a", "b.c", "@", "@x.y", ".", "1", "23", "255", "256", "1.2.3.4", "+", "+1 (555) 010-9999", " ", "-", "4111 1111 1111 1111", "(", "é", "%", "000000300"]
    rows = [(10_000 + k, "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))) for k in range(400)] + [(i, t) for i, t in texts() if t and len(t) < 20_000]
    for _, t in rows:
        assert pii.base_spans(t) == plain_spans(t), t
    got = pii.find_personal_data(frame(spark, rows + [(999, None)])).collect()
    by_id = {r.doc_id: r for r in got}
    for i, t in rows[:400]:
        want = pii.written(plain_spans(t))
        assert by_id[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(by_id[i].spans.split(","))
        assert [by_id[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == j for s in plain_spans(t)) for j in range(4)]
    assert by_id[999].spans == "" and len(got) == len(rows) + 1
    assert pii.find_personal_data(frame(spark, [])).collect() == []


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail john.doe [at] example [dot] com now", "john.doe [at] example [dot] com"),
        ("write to john at example dot com", "john at example dot com"),
        ("jоhn@exаmple.com", "jоhn@exаmple.com"),
        ("ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("j​o@exam­ple.com", "j​o@exam­ple.com"),
        ("call plus four nine one five two one two three four five now", "plus four nine one five two one two three four five"),
        ("host one nine two dot one six eight dot zero dot one up", "one nine two dot one six eight dot zero dot one"),
        ("٤١١١١١١١١١١١١١١١", "٤١١١١١١١١١١١١١١١"),
    ],
)
def test_disguises_map_back_to_the_source(text, found):
    spans = pii.added_spans(text, pii.base_spans(text))
    assert [text[a:b] for a, _, b in spans] == [found]
    assert found not in pii.redacted(text) and pii.redacted(text).count("[") == 1


@pytest.mark.parametrize("text", ["look at the dot com bubble", "un deux eux six a", "one two three", "we met at noon", "плохо и хорошо", "point at issue", prose(3, 500)])
def test_clean_texts_have_no_spans(text):
    assert pii.base_spans(text) == [] and pii.added_spans(text, []) == []


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("ask jane at example.com today", "jane at example.com"),
        ("ask jean arobase exemple.fr today", "jean arobase exemple.fr"),
        ("ask juan arroba ejemplo.es today", "juan arroba ejemplo.es"),
        ("call plus 49 155 1234567 now", "plus 49 155 1234567"),
        ("(four-111-1111-1111-1111)", "four-111-1111-1111-1111"),
        ("4111\u00a01111\u00a01111\u00a01111", "4111\u00a01111\u00a01111\u00a01111"),
        ("ask jane@example\u00b7com today", "jane@example\u00b7com"),
        ("10.0.0.¹", "10.0.0.¹"),
    ],
)
def test_plain_disguises_are_found(text, found):
    assert [text[a:b] for a, _, b in pii.added_spans(text, pii.base_spans(text))] == [found]


@pytest.mark.parametrize("gap", [1, 3, 4, 10, 5000])
def test_blanks_around_a_disguise_have_no_bound(gap):
    b = " " * gap
    for found in (f"john{b}[at]{b}example{b}[dot]{b}com", f"john{b}at{b}example{b}dot{b}com", f"john{b}@{b}example.com", f"plus{b}four{b}nine one five five{b}one two three four five six"):
        text = f"write {found}, or not"
        assert [text[a:b] for a, _, b in pii.added_spans(text, pii.base_spans(text))] == [found]


def test_long_runs_are_read_in_linear_time():
    import time

    n = 100_000
    for text in (" " * n + "[at", "[ " * n, "a" + " " * n, ("a" + " " * 50) * (n // 50), "one " * n, "a at " * n, "a at " + "b" * n, "plus" + "-" * n, "a@" + " " * n, "1" + " " * n + "x"):
        began = time.process_time()
        pii.added_spans(text, [])
        assert time.process_time() - began < 20


def test_planted_disguises_are_found_where_they_were_planted():
    """Every identifier is disguised character by character, so that its place and its plain form are known."""
    import random

    r = random.Random(21)
    alike = defaultdict(list)
    for c, plain in pii.LOOKALIKES.items():
        alike[plain].append(c)
    names = {str(d): n for d, n in enumerate(("zero", "one", "zwei", "trois", "four", "fünf", "six", "siete", "eight", "neuf"))}
    at, dot = ("[at]", "( at )", " at ", "{AT}", " arobase ", "@"), ("[dot]", " ( dot ) ", " dot ", " punkt ", ".")
    for _ in range(600):
        if r.random() < 0.6:
            local, host = "".join(r.choice("bdfgjqz") for _ in range(5)), "".join(r.choice("bdfgjqz") for _ in range(6))
            plain, shown, kind = f"{local}@{host}.net", local + (a := r.choice(at)) + host + r.choice(dot[:-1] if a == "@" else dot[2:3] if a.startswith(" ") else dot) + "net", "email"
        else:
            digits = [r.choice("123456789"), *(r.choice("0123456789") for _ in range(10))]
            plain, shown, kind = "+" + "".join(digits), "plus " + " ".join(names[d] if r.random() < 0.7 or k == 0 else d for k, d in enumerate(digits)), "phone"
        if kind == "email" and r.random() < 0.3:
            i = r.randrange(3)
            shown = shown[:i] + r.choice(alike.get(shown[i], [shown[i]])) + shown[i + 1 :]
        if kind == "email" and r.random() < 0.3:
            shown = shown[:2] + r.choice(pii.INVISIBLE) + shown[2:]
        before, after = prose(r.randrange(99), 6) + " : ", " ; " + prose(r.randrange(99), 6)
        text = before + shown + after
        base = pii.base_spans(text)
        spans = sorted(base + pii.added_spans(text, base))
        assert [(pii.KINDS[k], text[a:b]) for a, k, b in spans] == [(kind, shown)], text


def test_the_gate_loses_nothing(monkeypatch):
    import random

    r = random.Random(8)
    words = [*pii.AT_WORDS, *pii.DOT_WORDS, *pii.PLUS_WORDS, *pii.NAMED, "jane", "example.com", "a@b", "the", "FİVE", "ſix", "Arobase", "x\u0301", "@", "[at]", "( dot )", "{.}", ".com", "4111", "10.0.0", "1", "7"]
    marks = [" ", " ", " ", "-", ",", ".", "(", ")", "“", "—", "\n", "\u00a0", "\u00b7", "", "\x1f", "\u200b"]
    texts = ["".join(r.choice(words) + r.choice(marks) for _ in range(r.randint(2, 9))) for _ in range(6000)]
    texts += [f"1.2.3.{c}" for c in [*pii.LOOKALIKES, *pii.INVISIBLE]] + [f"jane@ex{c}ample.com" for c in pii.LOOKALIKES]
    gated = [pii.added_spans(t, pii.base_spans(t)) for t in texts]
    monkeypatch.setattr(pii, "disguised", lambda text: True)
    whole = [pii.added_spans(t, pii.base_spans(t)) for t in texts]
    assert sum(map(bool, whole)) > 100 and [t for t, a, b in zip(texts, gated, whole) if a != b] == []


def test_redaction_keeps_rows_and_counts(spark):
    df = frame(spark, [(1, "to a@b.cd or 1.2.3.4"), (2, None), (None, ""), (2, "clean")])
    got = pii.redact(df).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, "to [EMAIL] or [IP]"), (2, None), (None, ""), (2, "clean")])
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got) and got[0].asDict().keys() == set(df.columns)


def labelled(spark):
    rows, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        words = prose(k, 80).split()
        if toxic:
            for j in (10, 20, 21, 40):
                words[j] = ["scoundrel", "dolt", "knave", "wretchly", "wretchish", "wretched"][(k // 4 + j) % 6]
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic), 1 if k % 5 else 0))
    labels += [(None, 1, 1), (9000, 1, 1), (1, None, None), (0, 1, 1)]
    return rows, spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, toxic int, quality int, text string")


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled(spark)
    docs = frame(spark, rows + [(5000, None), (5001, ""), (None, "dolt knave dolt knave")])
    model = toxicity.fit_toxicity(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert held and all(got[k].predicted == (k % 4 == 0) for k in held)
    assert got[5000].predicted == got[5001].predicted == 0 and got[None].predicted == 1
    assert all(0 <= r.score <= 1 for r in got.values()) and got[0].n_passages == len(got[0].passages) > 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    flags = {r[0]: r[1] for r in docs.select("doc_id", toxicity.held_out(docs["doc_id"])).collect()}
    assert {k for k, v in flags.items() if v and k < 400} == set(held) and flags[None] is False


def test_toxicity_without_labels_or_rows(spark):
    rows, labels = labelled(spark)
    none = toxicity.fit_toxicity(frame(spark, rows[:20]), labels.limit(0))
    assert {r.predicted for r in toxicity.score_toxicity(frame(spark, rows[:20]), none).collect()} == {0}
    assert toxicity.score_toxicity(frame(spark, []), toxicity.fit_toxicity(frame(spark, []), labels)).collect() == []


def test_maximal_segments_are_those_by_definition():
    """Recursively: the best segment (of equal ones the shortest, then the leftmost), and then those on either side of it."""
    import random

    def best(scores, lo, hi, out):
        top = None
        for a in range(lo, hi):
            total = 0
            for b in range(a, hi):
                total += scores[b]
                if total > 0 and (top is None or (total, a - b - 1) > (top[0], top[1] - top[2])):
                    top = (total, a, b + 1)
        if top:
            best(scores, lo, top[1], out)
            out.append((top[1], top[2], top[0]))
            best(scores, top[2], hi, out)
        return out

    r = random.Random(3)
    for _ in range(200):
        scores = [r.choice([-1, -1, -1, 3, 2]) for _ in range(r.randint(0, 25))]
        hits = [(i, s) for i, s in enumerate(scores) if s > 0]
        got = toxicity.maximal_segments(hits, gap=1)
        assert [(a, b, s) for a, b, s in got] == best(scores, 0, len(scores), [])


def plain_quality(text):
    t = text or ""
    w = WORDS.findall(t)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_quality_counts_and_ratios(spark):
    import math

    import xxhash

    rows, labels = labelled(spark)
    rows = texts() + [(i + 1000, t) for i, t in rows[:60]] + [(2000 + k, " ".join(x.upper() + "!!" for x in prose(k, 90).split())) for k in range(30)] + [(3000, "a|b # $ <x> " * 20)]
    labels = spark.createDataFrame([(i, 1) for i, _ in rows if i and 1000 <= i < 1060] + [(2000, 0), (None, 1), (1000, 1)], "doc_id long, quality int")
    buckets, prior = 256, 1.0
    got = quality.quality_rules(frame(spark, rows), labels, buckets=buckets, prior=prior, threshold=-0.02).collect()
    assert Counter((r.doc_id, *r[1:7]) for r in got) == Counter((i, *plain_quality(t)) for i, t in rows)

    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def grams(text):
        h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in WORDS.findall(text or "")]
        two = [signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), 42))) for a, b in zip(h, h[1:])]
        two += [signed(xxhash.xxh64_intdigest(h[-1].to_bytes(8, "little", signed=True), 42))] if h else []
        return [x % buckets for x in h], [x % buckets for x in two]

    raw, target = Counter(), Counter()
    for i, t in rows:
        one, two = grams(t)
        raw.update(one + two)
        if i and 1000 <= i < 1060:
            target.update(one + two)
    share = target.total() / raw.total()
    weight = {b: math.log((target[b] + prior) / (raw[b] * share + prior)) for b in raw}
    for r in got:
        one, two = grams(dict(rows).get(r.doc_id))
        want = sum(weight[b] for b in one + two) / max(1, len(one + two))
        assert math.isclose(r.log_ratio, want, abs_tol=1e-9)
        assert r.kept == (not r.base_failed and r.log_ratio >= -0.02)
    shouted = [r.log_ratio for r in got if r.doc_id and 2000 <= r.doc_id < 2030]
    plain = [r.log_ratio for r in got if r.doc_id and 1000 <= r.doc_id < 1060]
    assert sum(shouted) / len(shouted) < sum(plain) / len(plain)
    assert quality.quality_rules(frame(spark, []), labels).collect() == []
    assert all(r.log_ratio == 0 for r in quality.quality_rules(frame(spark, rows[:3]), labels.limit(0)).collect())


def plain_fingerprint(text):
    import xxhash

    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    root = {f: f for f in prints}
    for f in prints:
        for g in prints:
            if (f ^ g).bit_count() <= 2:
                a, b = f, g
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
    for f in prints:
        while root[root[f]] != root[f]:
            root[f] = root[root[f]]
    return root


@pytest.mark.parametrize("crowded", [64, 1])
def test_near_duplicates_are_the_components(spark, crowded):
    rows = texts() + [(500 + k, prose(77, 400).replace("of", "off", k)) for k in range(12)]
    got = simhash.near_duplicates(frame(spark, rows), crowded=crowded).collect()
    prints = {t: plain_fingerprint(t) for _, t in rows}
    root = plain_components(list(dict.fromkeys(prints.values())))
    low = {}
    for i, t in rows:
        if i is not None:
            low[root[prints[t]]] = min(i, low.get(root[prints[t]], i))
    assert Counter(map(tuple, got)) == Counter((i, f"{prints[t]:016x}", low.get(root[prints[t]])) for i, t in rows)
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


def test_links_of_planted_fingerprints(spark):
    """A ball of fingerprints, a chain, and pairs at every distance up to four: the same components both ways."""
    import random

    r = random.Random(8)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = {0, 1, 3, 7, (1 << 64) - 1, 1 << 63, 1 << 31, (1 << 31) | (1 << 63)}
    centre = r.getrandbits(64)
    prints |= {centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(150)}
    for _ in range(40):
        f = r.getrandbits(64)
        prints |= {f, f ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))}
    chain = r.getrandbits(64)
    for b in range(0, 40, 2):
        chain ^= 3 << b
        prints.add(chain)
    root = plain_components(sorted(prints))
    want = {f: x for f, x in root.items()}
    groups = lambda m: Counter(frozenset(f for f in m if m[f] == x) for x in set(m.values()))
    from veriquill.llm.graph import components

    df = spark.createDataFrame([(signed(f),) for f in sorted(prints)], "fp long")
    for crowded in (64, 2, 10_000):
        found = {f: f for f in map(signed, prints)}
        found |= {x.node: x.root for x in components(simhash.links(df, crowded)).collect()}
        assert groups(found) == groups({signed(f): x for f, x in want.items()})


def test_exploded_anchors_are_not_broadcast(spark, monkeypatch):
    """A few fingerprints look small enough to broadcast, but their anchors are 34 times as many."""
    plans, cut = [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    found = simhash.links(spark.range(500).select(F.col("id").alias("fp")))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 2 and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)


@pytest.mark.parametrize("most", [10, 50_000])
def test_many_rows_do_not_go_through_the_driver(spark, monkeypatch, most):
    """Under the default threshold, joins of more rows than may be sent are merge joins, to the last plan that runs."""
    from veriquill.llm import common, graph

    plans = []
    run = lambda df: plans.append(df._jdf.queryExecution()) or common.cut(df)
    monkeypatch.setattr(common, "SENT_ROWS", most)
    monkeypatch.setattr(simhash, "cut", run)
    monkeypatch.setattr(graph, "cut", run)
    df = frame(spark)
    kept = simhash.keep_one(df)
    got = Counter(r.doc_id for r in kept.collect())
    plans.append(kept._jdf.queryExecution())
    sent = sum("BroadcastHashJoin" in p.executedPlan().toString() for p in plans)
    assert got == Counter(r.doc_id for r in simhash.near_duplicates(df).collect() if r.doc_id == r.component_id)
    assert len(plans) > 5 and (sent == 0) == (most == 10)


def test_one_of_each_component_stays(spark):
    df = frame(spark)
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    ids = [r.doc_id for r in got.collect()]
    named = simhash.near_duplicates(df).collect()
    assert sorted(i for i in ids if i is not None) == sorted({r.component_id for r in named if r.component_id is not None and r.doc_id == r.component_id})
    assert ids.count(None) == 1 and simhash.keep_one(frame(spark, [])).collect() == []


def plain_removal(rows, window=50):
    first = {}
    for i, t in rows:
        w = WORDS.findall(t or "")
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        w = WORDS.findall(t or "")
        gone = {j for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return Counter(out)


def plain_parse(rows, window):
    """Per row, greedily: the longest match of the words from a place on along the document that is first to have its window."""
    words = [(i, WORDS.findall(t or "")) for i, t in rows]
    home = {}
    for i, w in sorted((x for x in words if x[0] is not None), key=lambda x: x[0]):
        for k in range(len(w) - window + 1):
            home.setdefault(tuple(w[k : k + window]), (i, k))
    out = []
    for i, w in words:
        at, found = 0, []
        while i is not None and at + window <= len(w):
            reference, offset = home[tuple(w[at : at + window])]
            if reference == i:
                at += 1
                continue
            n = window
            while at + n < len(w) and home[tuple(w[at + n - window + 1 : at + n + 1])] == (reference, offset + n - window + 1):
                n += 1
            found.append((at, n, reference, offset))
            at += n - window + 1
        out.append((i, tuple(found)))
    return out


@pytest.mark.parametrize(("window", "crowd"), [(50, 20_000), (50, 3), (12, 1)])
def test_repeated_passages_go(spark, window, crowd):
    shared = prose(50, 70)
    rows = texts() + [(600 + k, prose(100 + k, 20) + " " + shared + " " + prose(200 + k, 20)) for k in range(6)]
    rows += [(1, prose(3, 120) + " more"), (700, prose(3, 49)), (701, prose(3, 49)), (702, prose(3, 50)), (703, prose(3, 51)), (12, "b c a " * 40)]
    got = substring.remove_repeats(frame(spark, rows), window=window, gram=min(10, window // 2), crowd=crowd).collect()
    assert Counter(tuple(r)[:4] for r in got) == plain_removal(rows, window)
    assert substring.remove_repeats(frame(spark, [])).collect() == []


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_factors_are_the_longest_matches_along_one_reference(spark, crowd):
    """Documents made of parts of each other, of different ids: each factor is the plain parse's, and reads as its reference does."""
    import random

    r = random.Random(17)
    texts_of = {}
    for k in range(40):
        parts = [prose(1000 + k, r.randint(5, 40))]
        for _ in range(r.randint(0, 3)):
            if texts_of:
                w = texts_of[r.choice(list(texts_of))].split()
                a = r.randrange(len(w))
                parts += [" ".join(w[a : a + r.randint(10, 90)]), prose(r.randrange(9999), r.randint(0, 12))]
        texts_of[k] = " ".join(parts)
    rows = [*texts_of.items(), (900, texts_of[7]), (901, texts_of[7]), (902, "la " * 500), (903, "la " * 400 + "lu " * 80)]
    got = {x.doc_id: tuple(map(tuple, x.factors)) for x in substring.remove_repeats(frame(spark, rows), window=12, gram=4, crowd=crowd).collect()}
    want = dict(plain_parse(rows, 12))
    assert got.pop(900) == got.pop(901) == ((0, len(texts_of[7].split()), None, 0),)
    assert got == {i: f for i, f in want.items() if i not in (900, 901)} and sum(map(len, got.values())) > 30
    for i, found in got.items():
        mine = dict(rows)[i].split()
        for start, length, reference, offset in found:
            assert mine[start : start + length] == dict(rows)[reference].split()[offset : offset + length] and reference < i


def test_two_texts_of_one_word(spark):
    rows = [(1, "word " * 100_000), (2, "word " * 99_999 + "end"), (3, prose(4, 60))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(frame(spark, rows)).collect()}
    assert got == {1: (100_000, 0), 2: (100_000, 99_999), 3: (60, 0)}


def test_anchors_are_few_and_equal_for_equal_windows():
    import numpy as np

    a, b = substring.Words(prose(1, 3000)), substring.Words("other words first " + prose(1, 3000))
    x, y = a.anchors(50, 10), b.anchors(50, 10)
    assert (x == y[3:]).all() and 3000 / 40 < len(np.unique(x)) < 3000 / 12


def test_pfair_windows_and_deviation():
    weights = {"a": 5, "b": 3, "c": 1, "d": 0}
    slots = mixing.period(weights)
    assert sorted(s[2] for s in slots) == list(range(9)) and all(r <= t < d for _, _, t, r, d in slots)
    for t in range(10):
        for s, w in weights.items():
            assert abs(sum(x[0] == s and x[2] < t for x in slots) - t * w / 9) < 1
    planned = mixing.phases(weights, {"a": 7, "b": 100, "c": 2})
    assert {s: sum(p["n"] for p in planned if p["source"] == s) for s in "abc"} == {"a": 7, "b": 100, "c": 2}


def test_mixture_keeps_and_orders_every_row(spark):
    rows = texts() + [(5000 + k, prose(k, 50)) for k in range(200)]
    df = frame(spark, rows)
    weights = {"a": 3, "b": 1, "*": 2}
    got = mixing.schedule(df, weights, block_bytes=2000, bucket_rows=16).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    slots, size = {}, {"a": 0, "b": 0, "*": 0}
    for r in sorted(got, key=lambda r: (r.mix_source, r.mix_start, r.mix_key if "mix_key" in r else 0, r.mix_bytes > 0)):
        assert r.mix_source == (r.source if r.source in ("a", "b") else "*")
        assert r.mix_bytes == len((r.text or "").encode()) and r.mix_release <= r.mix_slot < r.mix_deadline
        assert r.mix_start == size[r.mix_source]
        size[r.mix_source] += r.mix_bytes
        assert slots.setdefault(r.mix_slot, (r.mix_source, r.mix_block)) == (r.mix_source, r.mix_block)
    laid = mixing.mix(df, weights, block_bytes=2000)
    assert laid.columns == df.columns and Counter((r.doc_id, r.text) for r in laid.collect()) == Counter(rows)
    assert mixing.schedule(frame(spark, []), weights).collect() == []
    with pytest.raises(ValueError):
        mixing.schedule(df, {"a": 1})
    with pytest.raises(ValueError):
        mixing.schedule(df, {"a": -1, "*": 2})


def test_words_that_differ_late_are_different_features():
    a, b = toxicity.features("a" * 45), toxicity.features("a" * 40 + "bcdef")
    assert a[0] != b[0] and a[1:] == b[1:] and toxicity.features("dolt")[0] == "=dolt"


def test_extreme_values_are_found_again():
    """Best scores drawn from the distribution itself, those under the least score seen as none."""
    import numpy as np

    r = np.random.default_rng(6)
    for rate, k in ((1.0, 0.01), (0.7, 0.05), (2.0, 0.3)):
        n = r.integers(20, 2000, 20_000)
        best = np.log(k * n / -np.log(r.random(len(n)))) / rate
        best[best < toxicity.LEAST] = 0
        got = toxicity.extreme_values(best, n)
        assert abs(got[0] / rate - 1) < 0.05 and abs(got[1] / k - 1) < 0.25
        model = toxicity.ToxicityModel(rate=got[0], k=got[1])
        surprising = np.mean([model.surprise(s, int(m)) > 3 for s, m in zip(best, n) if s > 0])
        assert abs(surprising * (best > 0).mean() - np.exp(-3)) < 0.01
    assert toxicity.extreme_values(np.zeros(0), np.zeros(0, int))[0] > 0


def test_toxicity_scores_do_not_fall_with_evidence():
    model = toxicity.ToxicityModel(without=0.1, intercept=-9.0, slope=1.4)
    found = [model.probability(e / 10) for e in range(200)]
    assert found == sorted(found) and model.probability(0) == 0.1 and 0 <= min(found) and max(found) <= 1


def test_equal_evidence_has_equal_scores(spark):
    model = toxicity.ToxicityModel({"=dolt": 5.0, "=knave": 5.0}, without=0.01, intercept=-3.0, slope=1.0)
    rows = [(1, "a dolt here"), (2, "a knave here"), (3, "here a dolt"), (4, None), (5, ""), (6, "dolt " * 30_000)]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(frame(spark, rows), model).collect()}
    assert got[1] == got[2] == got[3] and got[4] == got[5] == 0.01 and got[6] > got[1]
    assert toxicity.keep_clean(frame(spark, []), model).collect() == []


def test_copies_count_once_and_labels_do_not_mix(spark):
    """Many copies of one toxic text teach no more than one; a clean text with a toxic copy of its beginning stays clean."""
    rows, labels = labelled(spark)
    once = toxicity.fit_toxicity(frame(spark, rows), labels)
    copies = [(10_000 + k, rows[4][1]) for k in range(300)]
    more = labels.union(spark.createDataFrame([(i, 1, 1, "x") for i, _ in copies], labels.schema))
    many = toxicity.fit_toxicity(frame(spark, rows + copies), more)
    assert set(many.scores) == set(once.scores)


def test_bytes_laid_out_follow_the_weights(spark):
    """While all sources last, each one's share of the bytes so far is off by less than a block and its longest document."""
    rows = [(k, prose(k, 20 + 37 * (k * k % 11))) for k in range(600)]
    weights, block = {"a": 5, "b": 2, "*": 1}, 3000
    got = sorted(mixing.schedule(frame(spark, rows), weights, block_bytes=block, bucket_rows=50).collect(), key=lambda r: (r.mix_slot, r.mix_start, r.doc_id))
    left, longest, have, checked = Counter(r.mix_source for r in got), {}, Counter(), 0
    for r in got:
        longest[r.mix_source] = max(longest.get(r.mix_source, 0), r.mix_bytes)
    for k, r in enumerate(got):
        have[r.mix_source] += r.mix_bytes
        left[r.mix_source] -= 1
        if not all(left.values()):
            break
        if got[k + 1].mix_slot > r.mix_slot:  # between slots
            checked += 1
            for s, w in weights.items():
                target = (r.mix_slot + 1) * block * w / 8
                assert -block < have[s] - target < block + longest[s]
    assert checked > 20


def test_rows_without_ids_spread_over_the_buckets(spark):
    rows = [(None if k % 2 else 7, prose(k, 30)) for k in range(400)]
    scheduled = mixing.schedule(frame(spark, rows), {"*": 1}, block_bytes=2000, bucket_rows=20).collect()
    ends = sorted((r.mix_start, r.mix_start + r.mix_bytes) for r in scheduled)
    assert [a for a, _ in ends] == [0, *(b for _, b in ends[:-1])]
    key = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("xxhash64(1, cast(doc_id as string), text) as k")
    assert key.distinct().count() == 400


def test_plans_are_bounded(spark):
    docs = frame(spark, [(k, "x") for k in range(10)])
    for weights in ({"a": 10_001}, {"a": -1, "*": 2}, {"a": 1}):
        with pytest.raises(ValueError):
            mixing.schedule(docs, weights)


def test_repeated_rows_do_not_fill_one_group(spark, monkeypatch):
    rows = [(5, "the same text again")] * 300 + [(100 + k, prose(k, 20)) for k in range(100)]
    got = packing.pack(frame(spark, rows), *PACK, length=64, group_docs=20).collect()
    groups = Counter(r.sequence_id >> 31 for r in got)
    assert len(got) >= 400 and sum(r.doc_id == 5 for r in got) == 300 and len({r.sequence_id >> 31 for r in got if r.doc_id == 5}) > 5
    assert max(groups.values()) < 120


def test_intermediate_data_is_in_the_shared_folder(spark, monkeypatch):
    from veriquill.llm import common

    assert common.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")

    class Cluster:
        sparkContext = type("C", (), {"master": "spark://host:7077"})()
        conf = type("F", (), {"get": staticmethod(lambda name, default=None: default)})()

    with pytest.raises(ValueError):
        common.shared_folder(Cluster())


def test_weights_are_the_log_odds_less_their_margin():
    import math
    import random

    import numpy as np

    r = random.Random(9)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(3, 9))) for _ in range(60)]
    docs = [(k % 3 == 0, {r.choice(words) for _ in range(12)} | ({"doltish", "doltly"} if k % 3 == 0 and k % 2 else set())) for k in range(240)]
    toxic, other = Counter(), Counter()
    for bad, found in docs:
        of = toxic if bad else other
        of[""] += len(found)
        of.update(f for w in found for f in toxicity.features(w))
    names = sorted(toxic)
    got = toxicity.weights(names, np.array([toxic[f] for f in names]), np.array([other[f] for f in names]))
    want = {}
    for f in names:
        a = toxicity.PRIOR * (toxic[f] + other[f])
        mass = toxicity.PRIOR * (toxic[""] + other[""])
        odds = [math.log((c[f] + a) / (c[""] + mass - c[f] - a)) for c in (toxic, other)] if f else [0, 0]
        score = odds[0] - odds[1] - toxicity.MARGIN * math.sqrt(1 / (toxic[f] + a) + 1 / (other[f] + a))
        stem = f[:1] == "^" and max((toxic[g] for g in names if g[:1] == "=" and g[1:].startswith(f[1:])), default=0)
        if f and toxic[f] > 2 and score >= toxicity.LEAST and not (stem and stem > toxicity.ONE_WORD * toxic[f]):
            want[f] = score
    assert got.keys() == want.keys() and "=doltish" in got and "^dolt" in got
    assert all(math.isclose(got[f], want[f]) for f in got)


def test_repeated_passages_agree_with_their_sql(spark):
    import duckdb

    from veriquill.llm import queries

    place = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{place}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op9_repeated_passages"])
    got = queries.op9_repeated_passages(spark, place)
    assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(want.fetchall())
    assert any(r.factors for r in got.collect())
