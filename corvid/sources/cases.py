"""Cases for measuring retrieval, from what a repository's own comments say about its functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.operators import metrics
from corvid.sources.parse import parse

#: Lines of a body at least; words of a query; lines looked at above a function.
LEAST_LINES, WORDS, LOOK_BACK = 5, (8, 60), 12
#: What begins a comment, the longer before the shorter.
MARKERS = ("///", "//!", "//", "--", "*/", "/**", "/*", "*", "#")


def comment_above(lines: list[str], first: int) -> str | None:
    """The comment that ends right above a line (from 1), without its marks, as one line of prose; attributes and blank lines may lie between."""
    said: list[str] = []
    for raw in reversed(lines[max(0, first - 1 - LOOK_BACK) : first - 1]):
        line = raw.strip()
        if not said and (not line or (line.startswith("#") and "[" in line)):
            continue
        mark = next((m for m in MARKERS if line.startswith(m)), None)
        if mark is None:
            break
        if text := line[len(mark) :].strip():
            said.append(text)
    return " ".join(reversed(said)) or None


def gives_away(query: str, name: str) -> bool:
    """Whether a query names what it asks for, as it is written, in one word or in several."""
    if len(name) < 4:
        return False
    q, n = query.lower(), name.lower()
    return any(x in q for x in (n, n.replace("_", ""), n.replace("_", " ")))


def cases_of(file: str, source: str) -> Iterator[tuple[str, str, int, int]]:
    """(query, symbol, first line, last line) of a file's functions and methods that have a telling comment."""
    lines = re.split(r"\r?\n", source)
    for s in parse(file, source)[0]:
        if s.kind in ("function", "method") and s.last - s.first >= LEAST_LINES and (query := comment_above(lines, s.first)):
            if WORDS[0] <= len(query.split()) <= WORDS[1] and not gives_away(query, s.name):
                yield query, s.name, s.first, s.last


def derived(files: DataFrame, limit: int = 0, path: str = "path", content: str = "content") -> DataFrame:
    """query, file, symbol, line_start, line_end: the cases of files (path, content: binary); ``limit`` of them, spread evenly, if not 0.

    Files that are no UTF-8 have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(q, file.replace("\\", "/"), *rest) for q, *rest in cases_of(file, (raw or b"").decode())]
                except UnicodeDecodeError:
                    continue
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 3 + [pa.int32()] * 2)], ["query", "file", "symbol", "line_start", "line_end"])

    out = files.select(F.col(path), F.col(content).cast("binary")).mapInArrow(run, "query string, file string, symbol string, line_start int, line_end int")
    return metrics.strided(out, ["file", "line_start"], limit) if limit else out
