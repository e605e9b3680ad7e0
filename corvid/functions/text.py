"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """The lines of a text without their ends; a last line break opens no further line."""
    parts = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    last_empty = F.element_at(F.split(text, "\n"), -1) == ""
    return F.when(last_empty, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def content_key(text: Column) -> Column:
    """Text with line ends unified and lines right-trimmed; null for blank text."""
    key = F.array_join(F.transform(lines(text), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n")
    return F.when(key.rlike(r"(?U)\S"), key)


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def nonspace_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\s", ""))


def numbered(text: Column, start: Column | int = 1, end: Column | int | None = None) -> Column:
    """Lines start to end (from 1, both included) as "N: text"."""
    first = F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(1))
    all_ = lines(text)
    last = F.size(all_) if end is None else F.least(F.lit(end) if isinstance(end, int) else end, F.size(all_))
    part = F.slice(all_, first, F.greatest(last - first + 1, F.lit(0)))
    return F.array_join(F.transform(part, lambda x, i: F.concat((i + first).cast("string"), F.lit(": "), x)), "\n")


def middle_cut(text: Column, most: int = 100) -> Column:
    """A text of more than ``most`` lines as its first and last halves with a mark between."""
    all_ = lines(text)
    n, half = F.size(all_), most // 2
    cut = F.concat_ws("\n", F.array_join(F.slice(all_, 1, half), "\n"), F.concat(F.lit("... ("), (n - 2 * half).cast("string"), F.lit(" lines left out) ...")), F.array_join(F.slice(all_, -half, half), "\n"))
    return F.when(n > most, cut).otherwise(text)


def short_name(fqn: Column) -> Column:
    return F.substring_index(fqn, "::", -1)


def fqn(file: Column, *scopes: Column) -> Column:
    return F.concat_ws("::", file, *scopes)


def mentions(text: str, words: set[str]) -> bool:
    """Whether a query names one of the words, in ASCII case-insensitively."""
    token, out = "", []
    for c in text + " ":
        if c.isalnum():
            token += c
        else:
            out.append(token)
            token = ""
    return any(t.isascii() and t.lower() in words for t in out)


def name_tag(label: str, names: Column, most: int) -> Column:
    """"label: a, b +2 more" of an array; empty for none."""
    more = F.when(F.size(names) > most, F.concat(F.lit(" +"), (F.size(names) - most).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return F.when(F.size(names) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.slice(names, 1, most), ", "), more)).otherwise(F.lit(""))
