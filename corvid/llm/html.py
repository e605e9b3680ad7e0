"""A forgiving reader of HTML pages: one pass, linear in the page, no tree."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

#: Elements whose content isn't markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"<>]*"|'[^'<>]*')*+)>""")  # stops at the next "<"
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_ENDS: dict[str, re.Pattern] = {}


def attributes(raw: str) -> dict[str, str]:
    """Attribute names in lower case to decoded values; of repeated ones the first."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        found.setdefault(name.lower(), unescape(a or b or c))
    return found


class _Ends:
    """Where a tag ends: the first ">" outside quotes, or without one the first ">".  Built once, from the right, for a page that needs it."""

    def __init__(self, page: str):
        self.page = page
        self.at = [m.start() for m in re.finditer("[\"'>]", page)]
        self.end, after = [-1] * (len(self.at) + 1), {'"': -1, "'": -1}  # the next quote of each kind, as a place in self.at
        for i in range(len(self.at) - 1, -1, -1):
            c = page[self.at[i]]
            if c == ">":
                self.end[i] = self.at[i]
            else:
                closing = after[c]
                self.end[i] = self.end[closing + 1 if closing >= 0 else i + 1]  # a quote that isn't closed is a letter
                after[c] = i

    def of(self, at: int) -> int:
        found = self.end[bisect_left(self.at, at)]
        return found if found >= 0 else self.page.find(">", at)


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", "", decoded), ("open", name, raw attributes), ("close", name, ""), and ("raw", name, content) for scripts and the like.

    A "<" that begins no tag, and a tag without an end, are text.
    """
    at = start = 0  # start: of the text not yet given
    ends: _Ends | None = None
    while (at := page.find("<", at)) >= 0:
        m = _TAG.match(page, at)
        if m:
            closing, name, attrs, end = m[1], m[2], m[3], m.end()
        elif n := _NAME.match(page, at):
            ends = ends or _Ends(page)
            if (end := ends.of(n.end()) + 1) <= 0:
                break
            closing, name, attrs = n[1], n[2], page[n.end() : end - 1]
        elif page.startswith(("<!", "<?", "</"), at):
            close = "-->" if page.startswith("<!--", at) else "]]>" if page.startswith("<![CDATA[", at) else ">"
            name, end = "", page.find(close, at + 2)
            end = end + len(close) if end >= 0 else len(page)
        else:
            at += 1
            continue
        if at > start:
            yield "text", "", unescape(page[start:at])
        at = start = end
        if not name:
            continue
        name = name.lower()
        if closing:
            yield "close", name, ""
            continue
        yield "open", name, attrs
        if name in RAW and not attrs.endswith("/"):
            found = _ENDS.setdefault(name, re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I)).search(page, at)
            yield "raw", name, page[at : found.start() if found else len(page)]
            at = start = found.end() if found else len(page)
            yield "close", name, ""
    if start < len(page):
        yield "text", "", unescape(page[start:])
