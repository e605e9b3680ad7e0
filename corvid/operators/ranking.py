"""From a pool of candidates to a ranked answer."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions import imports, paths, text
from corvid.operators import intervals
from corvid.plans import replies
from corvid.plans.query import Filters

#: Extensions, calls and words that tell classes of chunks, and the classes' weights.
STYLE_EXTENSIONS = ["css", "scss", "sass", "less"]
SCRIPT_EXTENSIONS = ["js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts"]
MOCK_CALLS = ["jest.mock(", "vi.mock(", "jest.doMock("]
TEST_WORDS = {"test", "tests", "spec", "specs", "mock", "mocks", "jest", "fixture", "fixtures"}
STYLE_WORDS = {"style", "styles", "css", "scss", "sass", "less", "stylesheet", "theme"}
WEIGHTS = {"mock": 0.90, "stylesheet": 0.90, "imports": 0.85}


def class_weight(file: Column, content: Column, query_texts: Sequence[str], filters: Filters, roots: Sequence[str] = ()) -> Column:
    """The least weight of a chunk's classes that the query doesn't ask for; 1 without one."""
    said = [*query_texts, *filters.paths]
    asks_mocks = any(text.mentions(t, TEST_WORDS) for t in said)
    asks_styles = any(text.mentions(t, STYLE_WORDS) for t in said) or any(x.lower() in STYLE_EXTENSIONS for x in filters.languages)
    rel = paths.repo_relative(file, roots)
    ext = F.lower(paths.extension(rel))
    parts = [F.lit(1.0)]
    if not asks_mocks:
        in_dir = F.exists(F.split(rel, "/"), lambda d: F.lower(d) == "__mocks__")
        calls = F.lit(False)
        for c in MOCK_CALLS:
            calls = calls | content.contains(c)
        parts.append(F.when(in_dir | (paths.is_test_path(rel) & calls), WEIGHTS["mock"]))
    if not asks_styles:
        parts.append(F.when(ext.isin(STYLE_EXTENSIONS), WEIGHTS["stylesheet"]))
    parts.append(F.when(ext.isin(SCRIPT_EXTENSIONS) & imports.import_only(content), WEIGHTS["imports"]))
    return F.least(*parts) if len(parts) > 1 else parts[0]


def best_of(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key.  A limit on a rank is taken in every partition before the shuffle."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where(F.col("_n") == 1).drop("_n")


def collapse(df: DataFrame, content: Column | None = None, file: str = "file", order: Sequence[Column] | None = None) -> DataFrame:
    """One row for each distinct content across files, the best; ``duplicates`` lists the files of the others.

    Best: highest rank, hand-written first, then file and line.  Repeats within the kept file stay rows of their own.
    Blank content is never a copy.  Of a content that many rows share the best file is found by a partial rank, its files
    are gathered by name, and only rows of the best file move with their text.
    """
    key = text.content_key(F.col("content")) if content is None else content
    rows = df.withColumn("_key", F.md5(key))
    first = order or [F.desc("rank"), paths.is_generated(F.col(file)), F.col(file), F.col("line_start")]
    shared = rows.where("_key is not null")
    kept = best_of(shared, ["_key"], *first).select("_key", F.col(file).alias("_file"))
    others = rows.where("_key is not null").select("_key", file).distinct().join(kept, "_key").where(F.col(file) != F.col("_file")).groupBy("_key").agg(F.array_sort(F.collect_set(file)).alias("_others"))
    own = shared.join(kept, (shared["_key"] == kept["_key"]) & (F.col(file) == F.col("_file")), "left_semi")
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy("_key", file).orderBy(*first)))
    stay = own.join(others, "_key", "left")
    copies = F.when(F.col("_n") == 1, F.coalesce("_others", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    out = stay.withColumn("duplicates", copies).drop("_others", "_n")
    alone = rows.where("_key is null").withColumn("duplicates", F.array().cast("array<string>"))
    return out.unionByName(alone).drop("_key")


def weighted_merge(candidates: DataFrame, top_k: int, weight: Column | float = 1.0, most_lines: int = 60) -> DataFrame:
    """The pool as ranked intervals: best of equal ranges, copies collapsed, neighbours merged, contained ones dropped, the best ``top_k``.

    rank = score * weight orders and cuts; the score stays as it is.
    """
    pool = candidates.withColumn("rank", F.col("score") * weight)
    one = best_of(pool, ["file", "line_start", "line_end"], F.desc("rank"), F.desc("score"), "content")
    joined = intervals.merged_capped(collapse(one.drop("duplicates")), ["file"], most_lines)
    left = intervals.without_contained(joined, ["file"], "line_start", "line_end", keep=F.size("duplicates") > 0)
    return left.orderBy(F.desc("rank"), "file", "line_start").limit(top_k)


def merged_blocks(results: DataFrame, pos: str = "pos") -> DataFrame:
    """Result blocks of a file that touch as one, at the place of the first; caller figures from the block with most callers."""
    best = F.max_by(F.struct("callers", "caller_files", "caller_names"), F.struct("callers", -F.col(pos))).alias("_c")
    return intervals.merged(results, ["file"], "line_start", "line_end", 1, [F.min(pos).alias(pos), best]).select("file", "line_start", "line_end", pos, "_c.*")


def hand_written_first(df: DataFrame, pos: str = "pos", file: str = "file") -> DataFrame:
    return df.orderBy(paths.is_generated(F.col(file)), pos)


def within_budget(df: DataFrame, keys: Sequence[str], pos: str, size: Column, budget: int, small: Column) -> DataFrame:
    """``full``: whether a block is shown whole.  From the first that exceeds the running budget on, blocks count with their ``small`` size and are shown while these fit (``shown``)."""
    order = Window.partitionBy(*keys).orderBy(pos)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_whole", F.sum(size).over(upto)).withColumn("full", F.col("_whole") <= budget)
    rows = rows.withColumn("full", F.min("full").over(upto))
    used = F.sum(F.when(F.col("full"), size).otherwise(small)).over(upto)
    return rows.withColumn("shown", F.col("full") | (used <= budget)).drop("_whole")


def pruned_rows(df: DataFrame, ranges: str = "ranges", least: int = 16) -> DataFrame:
    """One row for each selected range of a block; blocks under ``least`` lines, or without ranges, stay whole."""
    whole = F.array(F.struct(F.col("line_start").alias("start"), F.col("line_end").alias("end")))
    short = (F.col("line_end") - F.col("line_start")) < least
    use = F.when(short | F.col(ranges).isNull() | (F.size(ranges) == 0), whole).otherwise(F.col(ranges))
    return df.withColumn("_r", F.explode(use)).withColumns({"line_start": F.col("_r.start"), "line_end": F.col("_r.end")}).drop("_r", ranges)


def applied(results: DataFrame, ranked: replies.Ranked, pos: str = "pos") -> DataFrame:
    """Results in the order of a reranker's reply, with the ranges of lines it picked (null for whole blocks); those it left out go.

    ``pos`` counts from 0 in the order in which the reranker saw the results; they are few.
    """
    rows = [(at, new, None if r is None else [list(x) for x in r]) for new, (at, r) in enumerate(zip(ranked.order, ranked.ranges))]
    order = results.sparkSession.createDataFrame(rows, f"{pos} long, _new long, ranges array<struct<start:int,end:int>>")
    out = results.join(order, pos).drop(pos).withColumnRenamed("_new", pos)
    return out.select(*results.columns, "ranges")


Scorer = Callable[[str, list[dict]], list[float]]


def rerank(results: DataFrame, query: str, score: Scorer | None = None, pos: str = "pos") -> DataFrame:
    """Results in order of a scorer's probabilities, ties in their old order; ``relevance`` has them.

    Without a scorer, or if it fails or answers with another number of values, the order stays and relevance is null.
    The rows of one answer are few; they are scored on the driver.
    """
    rows = [r.asDict(True) for r in results.orderBy(pos).collect()]
    found: list[float] | None = None
    if score is not None and rows:
        try:
            got = [float(x) for x in score(query, rows)]
            found = got if len(got) == len(rows) else None
        except Exception:  # noqa: BLE001  a scorer never fails a query
            found = None
    order = range(len(rows)) if found is None else sorted(range(len(rows)), key=lambda i: (-found[i], i))
    spark, kind = results.sparkSession, results.drop("relevance").withColumn("relevance", F.lit(None).cast("double")).schema
    data = [tuple({**rows[i], pos: k, "relevance": None if found is None else found[i]}[c] for c in kind.names) for k, i in enumerate(order)]
    return spark.createDataFrame(data, kind)
