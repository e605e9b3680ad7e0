"""The query language: field filters in a query string, and the plan they stand for."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

SCOPES = ("code", "docs")
_TOKEN = re.compile(r"(kind|lang|language|path|name|scope):", re.I)


@dataclass
class Filters:
    """Filters of a query.  ``scope`` narrows what is searched; the others narrow what has been found."""

    kinds: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    scope: str | None = None
    docs_extensions: list[str] | None = None

    def values(self) -> list[str]:
        return [*self.kinds, *self.languages, *self.paths, *self.names]

    def merged(self, other: Filters | None) -> Filters:
        """Lists united in order; single values of ``other`` win where it has them."""
        if other is None:
            return self
        return Filters(
            self.kinds + other.kinds,
            self.languages + other.languages,
            self.paths + other.paths,
            self.names + other.names,
            other.scope or self.scope,
            other.docs_extensions if other.docs_extensions is not None else self.docs_extensions,
        )


@dataclass
class Query:
    text: str
    filters: Filters


def split_filters(query: str) -> tuple[str, Filters]:
    """The text without its filters, and the filters.  A scope other than code or docs is text; of several the first counts."""
    found, kept, at = Filters(), [], 0
    lists = {"kind": found.kinds, "lang": found.languages, "language": found.languages, "path": found.paths, "name": found.names}
    while at < len(query):
        if query[at].isspace():
            at += 1
            continue
        m = _TOKEN.match(query, at)
        start = at
        if m and query[m.end() : m.end() + 1] in ('"', "'"):
            quote = query[m.end()]
            end = query.find(quote, m.end() + 1)
            end = len(query) if end < 0 else end
            value, at = query[m.end() + 1 : end], min(end + 1, len(query))
        else:
            at = m.end() if m else at
            begin = at
            while at < len(query) and not query[at].isspace():
                at += 1
            value = query[begin:at]
        if not m:
            kept.append(query[start:at])
            continue
        kind = m[1].lower()
        if kind == "scope":
            if value.lower() in SCOPES:
                found.scope = found.scope or value.lower()
            else:
                kept.append(query[start:at])
        elif value:
            lists[kind].append(value if kind in ("path", "name") else value.lower())
    return " ".join(kept), found


def parse(query: str, external: Filters | None = None) -> Query:
    """A query that is only filters is ranked by their values."""
    text, own = split_filters(query)
    filters = own.merged(external)
    return Query(text or " ".join(filters.values()) or query, filters)
