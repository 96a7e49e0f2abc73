"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. First pass: stop-word density, length and link density decide a block as
content or boilerplate, or leave it open; so does the name of an element around it that marks menus, adverts, comments and
the like. Second pass: open blocks take the label of the nearest decided neighbour.

A mark is evidence, not a verdict: where the marked elements leave no content on a page, those that hold most of its
unlinked text are taken for wrappers and their marks for nothing. The density rule speaks for the languages whose stop words
are listed; on a page where no block or only the lesser part of the long ones fits any of them, length, links and sentence
ends decide.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veriquill.llm.common import id_field, map_batches

#: A block with at least this share of its characters in links is boilerplate.
LINKED = 0.4
#: Blocks under this many characters are open after the first pass, as are longer ones between FEW and MANY.
SHORT = 70
#: Shares of stop words among the words of a block: under FEW it is no prose, from MANY on it is.
FEW, MANY = 0.10, 0.20
#: Marked elements around a block of which each is remembered; the marks of those inside are one with the last.
DEEPEST = 8

# Tags whose content is no text of the article, or no text at all.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noframes", "noembed", "template", "svg", "math", "object", "video", "audio", "canvas"}
LEFT_OUT = {"nav", "footer", "aside", "button", "select", "option", "dialog", "menu", "head", "label", "input", "fieldset", "datalist", "applet"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
# Parts of class, id and role names that mark what surrounds an article.
MARKED = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "sidebar", "complementary",
    "footer", "contentinfo", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "alertdialog", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "search", "searchbox",
    "share", "sharing", "social", "related", "recommended", "comment", "comments", "disqus", "respond", "replies", "widget", "pagination", "pager", "toolbar", "skip", "copyright", "paywall", "dialog", "outbrain", "taboola",
}
# Words that stand beside such a part in the name of an element that is only that.
AROUND = {
    "area", "author", "bar", "block", "blocks", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "contents", "count", "entry", "form", "global", "group", "head", "header", "holder", "icon", "icons", "image",
    "inner", "item", "items", "left", "link", "links", "list", "main", "message", "meta", "module", "outer", "page", "panel", "post", "posts", "primary", "region", "right", "row", "secondary", "section", "site", "slot", "space", "stories",
    "text", "thread", "title", "top", "unit", "wrap", "wrapper", "zone",
}
# Words that turn what follows into a property of something else.
TURNED = {"with", "without", "no", "not", "has", "have", "non", "hide", "show"}
# Tags that mark what they hold as surroundings.
MARKING = {"form", "fieldset"}
# Ends of sentences.
ENDS = tuple(".!?…:;。！？”\"'»)")
# Frequent function words of English, German, French and Spanish.
STOP = frozenset(
    "the of and to in a is that it for on was as with by at be this are or an from not have has he she they but which you his her had we were will would there been if can all"
    " der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis"
    " le la les de des et un une du en que qui dans pour par sur au aux est pas il elle ce ne se avec son sa ses plus on sont ou mais nous vous leur cette"
    " el los las y del una con para su lo no se al como más pero sus ha este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos".split()
)

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
#: The same for a tag whose quotes do not close.
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
MARKS = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME_PARTS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
EDGE = re.compile(r"^\W+|\W+$")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


def is_mark(name: str) -> bool:
    """Whether a class, id or role says that an element surrounds an article: `sidebar`, `cookie-banner`, `commentList`.

    `with-sidebar`, `search-results` or `notice-period` say something else about it.
    """
    parts = [p for p in NAME_PARTS.findall(CAMEL.sub(" ", name).lower()) if len(p) > 1]
    if not parts or parts[0] in TURNED or MARKED.isdisjoint(parts):
        return False
    return parts[-1] in MARKED or all(p in MARKED or p in AROUND for p in parts)


def is_hidden(attributes: str) -> bool:
    for m in MARKS.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and value.lower() != "false" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDING.search(value):
            return True
    return False


def surrounds(attributes: str) -> bool:
    return any(m[1].lower() in ("class", "id", "role") and any(map(is_mark, (m[2] or m[3] or m[4] or "").split())) for m in MARKS.finditer(attributes))


class Block(NamedTuple):
    text: str
    linked: int  # characters in links
    inside: bool  # an article
    heading: bool
    marks: tuple[int, ...] = ()  # the marked elements around it


class Blocks:
    """Cuts a page into blocks."""

    def __init__(self, page: str):
        self.found: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.open: list[tuple[str, bool, bool]] = []  # tags, whether each leaves out what it holds, whether it is marked
        self.count: Counter = Counter()  # of open tags
        self.out = 0  # open elements that leave out
        self.marks: tuple[int, ...] = ()  # the outermost marked elements that are open
        self.marked = 0  # all that are open
        self.n_marks = 0
        self.breaks = 0
        self.read(page)
        self.end_block()

    def end_block(self) -> None:
        if self.parts:
            if text := " ".join(html.unescape("".join(self.parts)).split()):
                inside = self.count["article"] > 0 or self.count["main"] > 0
                self.found.append(Block(text, self.linked, inside, any(self.count[h] for h in ("h1", "h2", "h3", "h4", "h5", "h6")), self.marks))
            self.parts, self.linked = [], 0

    def text(self, piece: str) -> None:
        if piece and not self.out:
            if self.breaks and not piece.isspace():
                self.breaks = 0
            self.parts.append(piece)
            if self.count["a"]:
                self.linked += len(piece)

    def push(self, tag: str, attributes: str) -> None:
        inside = self.count["article"] > 0 or self.count["main"] > 0
        out = tag in LEFT_OUT or tag == "header" and not inside or bool(attributes) and is_hidden(attributes)
        marked = not out and not self.out and (tag in MARKING or bool(attributes) and tag not in ("html", "body", "article", "main") and surrounds(attributes))
        if marked and tag not in BLOCK:  # a part of a block is no block: it only leaves out
            out, marked = True, False
        if marked:
            self.end_block()
            self.marked += 1
            self.n_marks += 1
            if self.marked <= DEEPEST:
                self.marks += (self.n_marks,)
        self.open.append((tag, out, marked))
        self.count[tag] += 1
        self.out += out

    def pop(self, tag: str) -> None:
        """Close the innermost open element of that name, with what is open in it."""
        while self.count[tag]:
            name, out, marked = self.open.pop()
            if marked:
                self.end_block()
                self.marked -= 1
                self.marks = self.marks[: self.marked]
            self.count[name] -= 1
            self.out -= out
            if name == tag:
                break

    def implied_end(self, tag: str) -> None:
        """A new block closes an open paragraph; a new item or cell closes the one before."""
        closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}.get(tag, ())
        for name, _, _ in reversed(self.open):
            if name == "p" or name in closes:
                self.pop(name)
                break
            if name in BLOCK:
                break

    def read(self, page: str) -> None:
        at = 0
        while True:
            start = page.find("<", at)
            if start < 0:
                self.text(page[at:])
                return
            if page.startswith("<!--", start):
                self.text(page[at:start])
                end = page.find("-->", start + 2)  # <!--> is whole
                if end < 0:
                    return
                at = end + 3
                continue
            follows = page[start + 1 : start + 3]
            if follows[:1] in ("!", "?") or follows[:1] == "/" and not follows[1:].isalpha():
                self.text(page[at:start])
                end = page.find(">", start)
                if end < 0:
                    return
                at = end + 1
                continue
            if not (follows[:1].isascii() and follows[:1].isalpha() or follows[:1] == "/"):
                self.text(page[at : start + 1])
                at = start + 1
                continue
            self.text(page[at:start])
            m = TAG.match(page, start) or LOOSE_TAG.match(page, start)
            if not m:  # the page ends inside a tag
                return
            at = m.end()
            tag = m[2].lower()
            if tag in BLOCK and not (self.out and tag not in LEFT_OUT and not m[1]):
                self.end_block()
            if m[1]:
                if tag in BLOCK:
                    self.end_block()
                self.pop(tag)
                continue
            attributes = m[3]
            if tag in RAW and not attributes.endswith("/"):
                end = RAW_END[tag].search(page, at)
                if not end:
                    return
                close = page.find(">", end.end())
                if close < 0:
                    return
                at = close + 1
            elif tag == "br":
                self.breaks += 1
                if self.breaks > 1:
                    self.end_block()
                self.text(" ")
            elif tag not in VOID and not (attributes.endswith("/") and tag in ("a", "div", "span", "p")):
                if tag in BLOCK:
                    self.breaks = 0
                    self.implied_end(tag)
                self.push(tag, attributes)


def stop_share(text: str) -> float:
    """The share of listed stop words among a block's words."""
    words = text.lower().split()
    return sum((EDGE.sub("", w) if w not in STOP else w) in STOP for w in words) / max(1, len(words))


def decide(block: Block, share: float, listed: bool) -> bool | None:
    """First pass: True for content, False for boilerplate, None for open. `listed`: the page's language has its stop words listed."""
    text, n = block.text, len(block.text)
    if block.linked >= LINKED * n and not (block.inside and block.heading) or "©" in text[:3] or text[:9].lower() == "copyright":
        return False
    if n < SHORT or block.heading:
        return None
    if share >= MANY or block.inside:  # inside, the page itself says that this is the article
        return True
    if not listed:
        return True if text.endswith(ENDS) else None
    return None if share >= FEW else False


def spread(labels: list[bool | None], inside: list[bool]) -> list[bool]:
    """Second pass: open blocks take the label of the nearest decided one; of two as near, content wins.

    Where nothing at all is content, open blocks inside an article are.
    """
    n = len(labels)
    before, after, last = [None] * n, [None] * n, None
    for i in range(n):
        before[i] = last
        if labels[i] is not None:
            last = i
    last = None
    for i in reversed(range(n)):
        after[i] = last
        if labels[i] is not None:
            last = i
    nothing, out = True not in labels, []
    for i, label in enumerate(labels):
        if label is None:
            a, b = before[i], after[i]
            near = [j for j in (a, b) if j is not None]
            closest = min((abs(i - j) for j in near), default=0)
            label = nothing and inside[i] or any(labels[j] for j in near if abs(i - j) == closest)
        out.append(label)
    return out


def label_blocks(blocks: list[Block]) -> list[bool]:
    """Whether each block is content, by both passes."""
    shares = [stop_share(b.text) for b in blocks]
    long = [(len(b.text), s) for b, s in zip(blocks, shares) if len(b.text) >= SHORT and b.linked < LINKED * len(b.text)]
    listed = 2 * sum(n for n, s in long if s >= FEW) >= sum(n for n, _ in long)
    labels = [decide(b, s, listed) for b, s in zip(blocks, shares)]
    if listed and True not in labels and not any(b.inside for b in blocks):  # nothing is prose of a listed language
        labels = [decide(b, s, False) for b, s in zip(blocks, shares)]
    unlinked = [max(0, len(b.text) - b.linked) for b in blocks]
    ignored: set[int] = set()
    if not any((label or label is None and b.inside) and not b.marks for label, b in zip(labels, blocks)):
        held: Counter = Counter()
        for b, n in zip(blocks, unlinked):
            held.update(dict.fromkeys(b.marks, n))
        ignored = {m for m, n in held.items() if 2 * n > sum(unlinked)}
    free = [i for i, b in enumerate(blocks) if ignored.issuperset(b.marks)]  # what is marked is no one's neighbour
    kept = dict(zip(free, spread([labels[i] for i in free], [blocks[i].inside for i in free])))
    return [kept.get(i, False) for i in range(len(blocks))]


def main_text(page: str) -> str:
    """The content blocks of a page, joined by line feeds; empty if there are none."""
    blocks = Blocks(page).found
    return "\n".join(b.text for b, kept in zip(blocks, label_blocks(blocks)) if kept)


def extract_main_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """Per row: id, url, text (the article; empty if none), n_chars (its code points).

    A null page counts as empty and gives an empty text; repeated rows and null ids each give a row; an empty table
    gives an empty one; other columns are ignored. A short block as near to content as to boilerplate is content. Pages are
    read whole, however long, in one pass that is linear in their length; no shuffle.
    """
    keep = [id_field(df, id_col), *([id_field(df, url_col)] if url_col else [])]
    schema = T.StructType([*keep, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        texts = [main_text(p) if p else "" for p in batch.column(len(keep)).to_pylist()]
        return {f.name: batch.column(i) for i, f in enumerate(keep)} | {"text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(df.select(*[df[f.name] for f in keep], df[html_col]), make, schema)
