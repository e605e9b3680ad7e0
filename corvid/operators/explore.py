"""Counts, pages, chunks and bounded searches over an indexed repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions import paths, text
from corvid.operators import intervals


def stats(files: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: files, chunks, symbols, dimensions (0 without a vector).  Each table is counted apart; the counts are added up."""
    zero = {"files": F.lit(0), "chunks": F.lit(0), "symbols": F.lit(0), "dimensions": F.lit(0)}
    row = lambda df, **own: df.agg(*((own[c] if c in own else zero[c]).cast("long").alias(c) for c in zero))
    parts = row(files, files=F.count("*")).unionAll(row(chunks, chunks=F.count("*"), dimensions=F.coalesce(F.max(F.size("embedding")), F.lit(0)))).unionAll(row(symbols, symbols=F.count("*")))
    return parts.agg(*(F.sum(c).alias(c) for c in zero))


def page(df: DataFrame, limit: int, after: str | None = None, part: str | None = None, col: str = "path") -> DataFrame:
    """A page in order of path: what follows ``after``, holding ``part`` in any case.  Any page costs the same."""
    out = df if after is None else df.where(F.col(col) > after)
    if part:
        out = out.where(F.lower(F.col(col)).contains(part.lower()))
    return out.orderBy(col).limit(limit)


def chunks_of(chunks: DataFrame, file: str, limit: int) -> DataFrame:
    """A file's chunks by line; of vectors only the length is read."""
    own = chunks.where(F.col("file") == file)
    return own.select("file", "line_start", "line_end", "content", "symbol_fqn", F.coalesce(F.size("embedding"), F.lit(0)).alias("dimensions")).orderBy("line_start", "line_end").limit(limit)


def read_range(files: DataFrame, path: str, start: int, end: int, most_lines: int = 800, most_bytes: int = 65_536, content: str = "content") -> DataFrame:
    """line_no and text of a file's lines from start to end, at most so many lines and so many bytes; the first line always."""
    own = files.where(F.col("path") == path).select(F.posexplode(text.lines(F.col(content))).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)
    first, last = max(1, start), min(end, max(1, start) + most_lines - 1)
    part = own.where(F.col("line_no").between(first, last))
    bytes_ = F.sum(F.octet_length("text") + 1).over(Window.partitionBy(F.lit(path)).orderBy("line_no"))
    return part.withColumn("_bytes", bytes_).where((F.col("_bytes") <= most_bytes) | (F.col("line_no") == first)).drop("_bytes").orderBy("line_no")


def grep(files: DataFrame, pattern: str, literal: bool = False, ignore_case: bool = False, per_file: int = 20, total: int = 200, most_bytes: int = 2 << 20, scope: Column | None = None, path: str = "path", content: str = "content") -> DataFrame:
    """path, line_no, text of matching lines, in order: at most ``per_file`` of a file and ``total`` in all.

    Files over ``most_bytes`` or with a NUL are passed over.  A file is tested as a whole before its lines are looked at,
    and no file yields more than ``per_file`` rows, so nothing is ranked or sorted but what is shown.
    """
    test = pattern
    if literal:
        test = r"\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E"
    if ignore_case:
        test = "(?i)" + test
    body = F.col(content)
    fit = (F.octet_length(body) <= most_bytes) & (F.instr(body, "\0") == 0)
    rows = files.where(fit if scope is None else fit & scope)
    hits = F.slice(F.filter(F.transform(text.lines(body), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("text"))), lambda e: e["text"].rlike(test)), 1, per_file)
    return rows.select(F.col(path).alias("path"), F.inline(hits)).orderBy("path", "line_no").limit(total)


def grep_regions(matches: DataFrame, files: DataFrame, context: int = 2, path: str = "path", content: str = "content") -> DataFrame:
    """path, line_start, line_end, n: matches with ``context`` lines around them, clamped to the file, touching ones as one region."""
    size = files.select(F.col(path).alias("path"), F.size(text.lines(F.col(content))).alias("_n"))
    wide = matches.join(size, "path").select("path", F.greatest(F.col("line_no") - context, F.lit(1)).alias("line_start"), F.least(F.col("line_no") + context, F.col("_n")).alias("line_end"))
    return intervals.merged(wide, ["path"], "line_start", "line_end", 1, [F.count("*").alias("n")])


def ignored(files: DataFrame, part: str) -> DataFrame:
    """Stored paths that a bulk-ignore by part of the path takes out."""
    return files.where(F.lower(F.col("path")).contains(part.lower())).select("path").distinct()


def walkable(listing: DataFrame, root: str, more_extensions: tuple[str, ...] = (), path: str = "path") -> DataFrame:
    """Files of a listing that are indexed: of a known extension, in no skipped or hidden directory under the root."""
    f = paths.slashed(F.col(path))
    rel = f.substr(F.lit(len(root.rstrip("/")) + 2), F.length(f))
    return listing.where(paths.in_repo(F.col(path), root) & paths.indexable(F.col(path), more_extensions) & ~paths.under_skipped_dir(rel) & ~paths.under_hidden_dir(rel))
