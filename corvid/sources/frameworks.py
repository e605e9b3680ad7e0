"""Call edges that web frameworks make by registration rather than by a call."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_QUOTED = r"""(?:'[^']*'|"[^"]*")"""
#: Of each framework the files it reads and the patterns that name a handler.
PATTERNS: dict[str, tuple[str, list[str]]] = {
    "react": (r"\.(tsx|jsx|js|ts)$", [r"<([A-Z][A-Za-z0-9]*(?:\.[A-Z][A-Za-z0-9]*)*)[\s/>]"]),
    "express": (r"\.(js|ts|mjs|cjs)$", [r"(?:app|router|server)\s*\.\s*(?:get|post|put|delete|patch|use|all)\s*\(\s*(?:'[^']*'|`[^`]*`|\"[^\"]*\")\s*,\s*([a-zA-Z_]\w*)", r"(?:app|router|server)\s*\.\s*use\s*\(\s*([a-zA-Z_]\w*)\s*[,)]"]),
    "django": (r"urls\.py$", [rf"(?:path|re_path)\s*\(\s*r?{_QUOTED}\s*,\s*(?:views\.)?([a-zA-Z_]\w*)", rf"(?:path|re_path)\s*\(\s*r?{_QUOTED}\s*,\s*([A-Z]\w*)\.as_view\(\)"]),
    "spring": (r"\.(java|kt)$", [rf"@(?:Get|Post|Put|Delete|Patch|Request)Mapping\s*(?:\(\s*(?:value\s*=\s*)?{_QUOTED}?\s*\))?"]),
    "gin": (r"\.go$", [r"\w+\s*\.\s*(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|Any|Use)\s*\(\s*(?:\"[^\"]*\"\s*,\s*)?([a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)*)"]),
}
_NEXT_METHOD = re.compile(r"(?:public|private|protected)?\s*[\w<>,\s\[\]?]+\s+([a-z]\w*)\s*\(")
MODULE = "<module>"


def may_show(path: Column) -> Column:
    """Whether a file is one of those that detected() looks into."""
    return path.rlike(r"(package\.json|\.py|\.java|pom\.xml|build\.gradle|go\.mod)$")


def detected(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row with a boolean for each framework: whether the repository shows it."""
    p, c = F.col(path), F.col(content)
    manifest = p.endswith("package.json") & ~p.contains("node_modules")
    has = lambda *words: [c.contains(w) for w in words]

    def any_of(tests: list[Column]) -> Column:
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    shows = {
        "react": manifest & any_of(has('"react"', "'react'")),
        "express": manifest & any_of(has('"express"', "'express'")),
        "django": (p.endswith(".py") & any_of(has("from django", "import django"))) | (p.rlike(r"(manage|settings)\.py$") & c.contains("django")),
        "spring": (p.endswith(".java") & c.contains("org.springframework")) | (p.rlike(r"(pom\.xml|build\.gradle)$") & any_of(has("spring-boot", "springframework"))),
        "gin": p.endswith("go.mod") & c.contains("github.com/gin-gonic/gin"),
    }
    return files.agg(*(F.coalesce(F.bool_or(t), F.lit(False)).alias(n) for n, t in shows.items()))


def framework_edges(file: str, source: str, symbols: list, frameworks: list[str] | tuple[str, ...]) -> Iterator[tuple[str, str, str, int, str | None]]:
    """(from name, from fqn, to name, line, import path) of a file's registrations.

    React and Express credit the innermost symbol around the line (of equal ones the later), Spring the file's first class,
    the others its first symbol; without one the module.  React counts a tag once for each caller and leaves out tags of
    the caller's own name.  A dotted Gin handler's prefix is its import path.
    """
    for name in frameworks:
        wanted, patterns = PATTERNS[name]
        if not re.search(wanted, file):
            continue
        seen = set()
        for pattern in patterns:
            for m in re.finditer(pattern, source):
                line = source.count("\n", 0, m.end() if name == "spring" else m.start()) + 1
                if name == "spring":
                    method = _NEXT_METHOD.search(source, m.end())
                    if not method:
                        continue
                    to = method[1]
                else:
                    to = m[1]
                if name in ("react", "express"):
                    around = [s for s in symbols if s.first <= line <= s.last]
                    by = min(reversed(around), key=lambda s: s.last - s.first) if around else None
                else:
                    by = next((s for s in symbols if name != "spring" or s.kind == "class"), None)
                caller = (by.name, by.fqn) if by else (MODULE, f"{file}::{MODULE}")
                if name == "react":
                    if caller[0] == to or (caller, to) in seen:
                        continue
                    seen.add((caller, to))
                prefix, _, leaf = to.rpartition(".") if name == "gin" else ("", "", to)
                yield *caller, leaf, line, prefix or None
