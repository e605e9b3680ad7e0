"""Whether a script chunk holds nothing but imports and re-exports."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
_TEXT = r"""(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
_NAMES = r"[\w$]+|\*|\{[^{}]*\}|\bas\b|,"
_STATEMENT = re.compile(
    rf"""\s*(?:
        import\s*{_TEXT} |
        import\s+(?:type\s+)?(?:(?:{_NAMES})\s*)+?\s*from\s*{_TEXT} |
        import\s+[\w$]+\s*=\s*require\s*\(\s*{_TEXT}\s*\) |
        export\s+(?:type\s+)?(?:\*(?:\s*as\s+[\w$]+)?|\{{[^{{}}]*\}})\s*from\s*{_TEXT} |
        (?:const|let|var)\s+(?:[\w$]+|\{{[^{{}}]*\}}|\[[^\[\]]*\])\s*=\s*require\s*\(\s*{_TEXT}\s*\) |
        {_TEXT}
    )(?:\s+(?:with|assert)\s*\{{[^{{}}]*\}})?\s*(?:;|(?=\n)|\Z)""",
    re.X,
)


def is_import_only(source: str | None) -> bool:
    """True for one or more import or re-export statements with nothing else but comments; false for blank text."""
    if not source:
        return False
    bare = _NOISE.sub(" ", source).strip()
    at, seen = 0, False
    while at < len(bare):
        m = _STATEMENT.match(bare, at)
        if not m:
            return False
        seen = seen or bare[at : m.end()].lstrip()[:1] not in "\"'"
        at = m.end()
        while at < len(bare) and (bare[at].isspace() or bare[at] == ";"):
            at += 1
    return seen


@pandas_udf(BooleanType())
def _import_only(source: pd.Series) -> pd.Series:
    return source.map(is_import_only, na_action=None).astype(bool)


def import_only(content: Column) -> Column:
    return _import_only(content)
