"""Main text of web pages by two passes of block rules.

All text that a page shows is cut into blocks, menus and notices included.

First pass: each block is good, bad or undecided.  Bad: blocks that are mostly
links, those with a copyright sign, those whose markup (element, class, id or
role) names something other than the article, and long ones with few stop words.
Good: long blocks with many stop words.  Undecided: short blocks, and those with
a middling length or share of stop words ("near").

Second pass: undecided blocks inherit the label of the nearest decided
neighbours before and after.  If these differ, a near block is good, a heading
takes the label of what follows, and a short block that of the nearer one, bad
if both are as near.

A page that marks its article (article, main, articleBody) is judged in regions:
blocks outside are bad, in it few stop words alone make no block bad, what is
named otherwise there is no neighbour of the article's blocks, and the edges of
the article count as good neighbours.  The edges of a page count as bad ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm.html import BLOCK, VOID, attributes, events

#: Frequent function words.
STOP_WORDS = frozenset(
    (
        "a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its just like more most my no not of on one only or other our out over she so some such than that the their them then there these they this to up was we were what when which who will with would you your "
        "au aux avec ce ces cette comme dans de des du elle elles en est et eux il ils je la le les leur lui mais me même mes moi mon ne nos notre nous on ou où par pas plus pour qu que qui sa se ses si son sont sur ta te tu un une vos votre vous y à été être "
        "aber als am an auch auf aus bei bin bis da das dass dem den der des die doch durch ein eine einem einen einer eines er es für hat hatte ich ihr im in ist ja kann man mit nach nicht noch nur oder sein sich sie sind so um und uns von vor war was wenn wie wird wir zu zum zur über "
        "al como con de del desde donde el ella ellas ellos en entre era es esa ese eso esta este esto ha hay la las le les lo los más me mi muy no nos o para pero por porque que se ser si sin sobre son su sus también te tiene todo un una uno y ya yo"
    ).split()
)
#: Elements that aren't part of an article; words in class, id and role that name such parts.
ASIDE = frozenset("nav footer aside form button select dialog menu noscript template svg math object audio video canvas head search fieldset".split())
COMMENTS = frozenset("comment comments commentlist disqus discussion replies reply respond".split())
NAMED = COMMENTS | frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs consent contentinfo complementary cookie cookies copyright dialog footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager paywall popup promo promotion recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe tags toc toolbar widget".split()
)
#: Names that also stand for parts of articles when inside one.
IN_ARTICLE = frozenset("header banner tags toc legal copyright".split())

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_WORD = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

LINKS_MOST, LENGTH_LOW, LENGTH_HIGH, STOP_LOW, STOP_HIGH, LINKS_IN_ARTICLE = 0.2, 70, 200, 0.15, 0.20, 0.6
GOOD, BAD, NEAR, SHORT = "good", "bad", "near", "short"


def _named(raw: str, in_article: bool) -> str:
    """What an element's class, id and role say it is: "comments", "aside" or nothing."""
    if not raw or raw.isspace():
        return ""
    a = attributes(raw)
    if "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style", "")):
        return "aside"
    said = {w.lower() for k in ("class", "id", "role") for w in _NAMES.findall(a.get(k, ""))}
    if said & COMMENTS:
        return "comments"
    return "aside" if said & (NAMED - IN_ARTICLE if in_article else NAMED) else ""


class Block(NamedTuple):
    text: str
    linked: int  # characters of links
    article: int = 0  # number of the marked article it lies in
    named: bool = False  # markup names it as something other than the article
    in_list: bool = False
    heading: bool = False


class _Frame:
    """An open element that ends blocks, and the open inline elements directly in it."""

    __slots__ = ("name", "kind", "inline", "names", "article")

    def __init__(self, name: str, kind: str, article: int):
        self.name, self.kind, self.article = name, kind, article  # article: the one around it
        self.inline: list[tuple[str, str]] = []
        self.names: Counter[str] = Counter()


class _Reader:
    """Blocks of a page in page order; each tag costs a constant time but for what it closes."""

    def __init__(self):
        self.out: list[Block] = []
        self.frames = [_Frame("", "", 0)]
        self.many: Counter[str] = Counter()  # open frames of each name
        self.said: dict[bool, list[str]] = {False: [], True: []}  # by whether it is named otherwise
        self.linked = {False: 0, True: 0}
        self.anchors = self.aside = self.comments = self.headings = self.articles = self.article = 0

    def text(self, value: str) -> None:
        named = self.aside > 0
        self.said[named].append(value)
        if self.anchors:
            self.linked[named] += len(" ".join(value.split()))

    def flush(self) -> None:
        for named in (True, False):
            if said := self.said[named]:
                if text := " ".join("".join(said).split()):
                    self.out.append(Block(text, min(self.linked[named], len(text)), self.article, named, self.many["li"] > 0, self.headings > 0))
                said.clear()
            self.linked[named] = 0

    def count(self, name: str, kind: str, by: int) -> None:
        self.aside += by * (kind in ("aside", "comments"))
        self.comments += by * (kind == "comments")
        self.anchors += by * (name == "a")
        self.headings += by * (name in HEADINGS)

    def pop(self) -> None:
        frame = self.frames.pop()
        for name, kind in frame.inline:
            self.count(name, kind, -1)
        self.count(frame.name, frame.kind, -1)
        self.many[frame.name] -= 1
        self.article = frame.article

    def close(self, name: str) -> None:
        if name in BLOCK:
            self.flush()
            while self.many[name]:
                found = self.frames[-1].name == name
                self.pop()
                if found:
                    return
            return
        top = self.frames[-1]
        while top.names[name]:  # a stray end of an inline element ends no block
            last, kind = top.inline.pop()
            top.names[last] -= 1
            self.count(last, kind, -1)
            if last == name:
                return

    def kind(self, name: str, value: str) -> str:
        if name in ("article", "main") or (name not in ("html", "body") and "articleBody" in value):
            hint = _named(value, bool(self.article)) if name == "article" else ""
            if hint == "comments" or self.comments:
                return "comments"
            if self.article:
                return "aside" if hint else ""
            for frame in self.frames:  # an unclosed or loosely named wrapper
                self.aside -= frame.kind == "aside"
                frame.kind = "" if frame.kind == "aside" else frame.kind
            self.articles += 1
            return "article"
        if name in ASIDE or (name == "header" and not self.article):
            return "aside"
        return _named(value, bool(self.article)) if name not in ("html", "body") else ""

    def open(self, name: str, value: str) -> None:
        if name in VOID:
            if name in ("br", "hr"):
                self.text(" ")
            return
        if name not in BLOCK and "articleBody" not in value:
            top, kind = self.frames[-1], self.kind(name, value)
            top.inline.append((name, kind))
            top.names[name] += 1
            self.count(name, kind, 1)
            return
        self.flush()
        top = self.frames[-1]
        if name == "p" and top.name == "p" and not top.kind:  # a paragraph ends the one before it; what is open in that stays open
            top.name = ""
            self.many["p"] -= 1
        elif name == "body":
            self.close("head")
        kind = self.kind(name, value)
        self.frames.append(_Frame(name, kind, self.article))
        self.many[name] += 1
        self.count(name, kind, 1)
        if kind == "article":
            self.article = self.articles


def blocks(page: str) -> list[Block]:
    """What a page shows, in page order."""
    reader = _Reader()
    for what, name, value in events(page):
        if what == "text":
            reader.text(value)
        elif what == "open":
            reader.open(name, value)
        elif what == "close":
            reader.close(name)
    reader.flush()
    return reader.out


def first_pass(b: Block, marked: bool) -> str:
    if b.named or (marked and not b.article):
        return BAD
    density = b.linked / len(b.text)
    if b.article:
        if density >= LINKS_IN_ARTICLE and b.in_list:
            return BAD
    elif density > LINKS_MOST or "©" in b.text:
        return BAD
    if len(b.text) < LENGTH_LOW:
        return BAD if b.linked and not b.article else SHORT
    said = _WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in said) / max(1, len(said))
    if stops >= STOP_HIGH:
        return GOOD if len(b.text) > LENGTH_HIGH else NEAR
    return NEAR if stops >= STOP_LOW or b.article else BAD


def second_pass(found: list[Block], labels: list[str]) -> list[str]:
    """Undecided blocks inherit from the nearest decided ones of their region."""
    n = len(found)

    def nearest(order: range) -> list[tuple[str, int]]:
        last: dict[int, tuple[str, int]] = {}
        out = [("", 0)] * n
        for steps, i in enumerate(order):
            region = found[i].article
            label, at = last.get(region, (GOOD if region else BAD, -1))
            out[i] = label, steps - at
            if labels[i] in (GOOD, BAD) and not (region and found[i].named):
                last[region] = labels[i], steps
        return out

    out = list(labels)
    for i, ((one, far), (two, far2)) in enumerate(zip(nearest(range(n)), nearest(range(n - 1, -1, -1)))):
        if labels[i] in (GOOD, BAD):
            continue
        if one == two:
            out[i] = one
        elif labels[i] == NEAR or found[i].article:
            out[i] = GOOD
        elif found[i].heading:
            out[i] = two
        else:
            out[i] = BAD if far == far2 else one if far < far2 else two
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    marked = any(b.article for b in found)
    labels = second_pass(found, [first_pass(b, marked) for b in found])
    return " ".join(b.text for b, label in zip(found, labels) if label == GOOD)


RESULT = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of each page: page_id, url, text, n_chars (code points); one row per input row.

    Null and empty pages, and pages without main text, give the empty text.  White space within a block becomes one
    space, blocks are joined by one space.  Repeated rows are worked off each.  Other columns aren't read.  Pages are worked off alone, in their partition, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h or "") for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], RESULT.names)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, RESULT)
