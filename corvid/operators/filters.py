"""Filters on candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions import paths, text
from corvid.plans.query import Filters


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def scope_predicate(file: Column, scope: str | None, docs_extensions: list[str] | None = None) -> Column:
    """Whether a file belongs to a scope.  To be applied before a top-k, or one class starves the other."""
    if scope is None:
        return F.lit(True)
    docs = [e.strip().lstrip(".").lower() for e in (paths.DOCS_EXTENSIONS if docs_extensions is None else docs_extensions)]
    is_docs = F.coalesce(paths.ext_key(file).isin(docs), F.lit(False)) if docs else F.lit(False)
    return is_docs if scope == "docs" else ~is_docs


def path_predicate(file: Column, wanted: list[str]) -> Column:
    f = paths.slashed(file)
    return _any([f.contains(p.replace("\\", "/")) for p in wanted]) if wanted else F.lit(True)


def language_predicate(language: Column, wanted: list[str]) -> Column:
    """By part of the language's name or by an alias; "c" so finds every language with a c in its name."""
    return _any([language.contains(w.lower()) | language.isin(paths.LANGUAGE_ALIASES.get(w.lower(), [w.lower()])) for w in wanted]) if wanted else F.lit(True)


def kind_predicate(kind: Column, wanted: list[str]) -> Column:
    """By part of the kind; an unknown kind passes."""
    return kind.isNull() | _any([F.lower(kind).contains(w.lower()) for w in wanted]) if wanted else F.lit(True)


def named(candidates: DataFrame, wanted: list[str], name_col: str = "symbol", most: int = 2) -> DataFrame:
    """Candidates whose name holds one of the wanted ones or that have no name; if there are none, those within ``most`` edits.

    The choice is made inside the plan: a count of one row, not an action.
    """
    if not wanted:
        return candidates
    name = F.lower(F.col(name_col))
    exact = name.isNull() | _any([name.contains(w.lower()) for w in wanted])
    close = F.coalesce(_any([F.levenshtein(name, F.lit(w.lower()), most) >= 0 for w in wanted]), F.lit(False))
    marked = candidates.withColumns({"_exact": exact, "_close": close}).where("_exact or _close")
    found = marked.agg(F.coalesce(F.bool_or("_exact"), F.lit(False))).scalar()
    return marked.where(F.when(found, F.col("_exact")).otherwise(F.col("_close"))).drop("_exact", "_close")


def apply(candidates: DataFrame, filters: Filters) -> DataFrame:
    """All filters that narrow what has been found; scope isn't among them.  Columns: file, symbol, symbol_kind."""
    out = candidates
    if filters.paths:
        out = out.where(path_predicate(F.col("file"), filters.paths))
    if filters.languages:
        out = out.where(language_predicate(paths.language(F.col("file")), filters.languages))
    if filters.kinds:
        out = out.where(kind_predicate(F.col("symbol_kind"), filters.kinds))
    return named(out, filters.names)


def path_contains(df: DataFrame, part: str, col: str = "path") -> DataFrame:
    """Rows whose path holds a part, whatever the case."""
    return df.where(F.lower(F.col(col)).contains(part.lower()))


def content_fence(candidates: DataFrame, col: str = "content") -> tuple[DataFrame, DataFrame]:
    """Candidates with content, and a row with the number of those without."""
    blank = text.is_blank(F.col(col))
    return candidates.where(~blank), candidates.agg(F.count_if(blank).alias("dropped"))
