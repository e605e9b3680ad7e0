"""Line intervals in files: joins by overlap and containment, merging, clipping.  Ends are included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlapping(left: DataFrame, right: DataFrame, on: Sequence[str], bounds: tuple[str, str, str, str], how: str = "inner", bucket: int | None = None) -> DataFrame:
    """Rows of the same keys whose intervals overlap.  bounds: start and end left, start and end right.

    The keys carry the join.  Where one key has very many intervals, ``bucket`` cuts lines into buckets of that width and
    joins on them as well; a pair is kept in the first bucket both share, so it comes out once (inner joins only).
    """
    a0, a1, b0, b1 = bounds
    meets = (F.col(b0) <= F.col(a1)) & (F.col(b1) >= F.col(a0))
    if bucket is None:
        both = left.join(right.withColumnsRenamed({c: f"_r_{c}" for c in on}), [F.col(c) == F.col(f"_r_{c}") for c in on] + [meets], how)
        return both.drop(*(f"_r_{c}" for c in on))
    cut = lambda df, s, e: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor(F.col(e) / bucket))))
    both = cut(left, a0, a1).join(cut(right, b0, b1), [*on, "_b"]).where(meets)
    return both.where(F.col("_b") == F.greatest(F.floor(F.col(a0) / bucket), F.floor(F.col(b0) / bucket))).drop("_b")


def enclosing(inner: DataFrame, outer: DataFrame, on: Sequence[str], inner_key: str, bounds: tuple[str, str, str, str], outer_name: str, default: Column | None = None, result: str = "enclosing") -> DataFrame:
    """Each inner interval with the name of the tightest outer one around it; of equals the one that starts later, then the greater name.

    A line is an interval of one.  Without one around it, ``default`` or null.
    """
    i0, i1, o0, o1 = bounds
    found = inner.select(inner_key, *on, i0, i1).join(outer.select(*(F.col(c).alias(f"_o_{c}") for c in on), o0, o1, outer_name), [F.col(c) == F.col(f"_o_{c}") for c in on] + [F.col(o0) <= F.col(i0), F.col(o1) >= F.col(i1)])
    best = found.groupBy(inner_key).agg(F.max_by(outer_name, F.struct(-(F.col(o1) - F.col(o0)), F.col(o0), F.col(outer_name))).alias(result))
    out = inner.join(best, inner_key, "left")
    return out.withColumn(result, F.coalesce(result, default)) if default is not None else out


def first_overlap(symbols: DataFrame, chunks: DataFrame, on: Sequence[str], symbol_key: str, bounds: tuple[str, str, str, str]) -> DataFrame:
    """Each symbol with the first chunk it overlaps, by line; symbols without one drop out."""
    pairs = overlapping(symbols, chunks, on, bounds)
    _, _, c0, c1 = bounds
    return pairs.groupBy(symbol_key).agg(F.min(F.struct(c0, c1)).alias("chunk")).select(symbol_key, f"chunk.{c0}", f"chunk.{c1}")


def spans(chunks: DataFrame, symbols: DataFrame, on: Sequence[str], bounds: tuple[str, str, str, str]) -> DataFrame:
    """Symbols that overlap a chunk, clipped to it; those that cover it whole are left out, equal ranges count once."""
    c0, c1, s0, s1 = bounds
    pairs = overlapping(chunks, symbols.select(*on, s0, s1), on, bounds)
    clipped = pairs.where(~((F.col(s0) <= F.col(c0)) & (F.col(s1) >= F.col(c1))))
    return clipped.select(*on, c0, c1, F.greatest(s0, c0).alias("span_start"), F.least(s1, c1).alias("span_end")).distinct()


def block_symbols(blocks: DataFrame, symbols: DataFrame, on: Sequence[str], block_key: str, bounds: tuple[str, str, str, str], name: str) -> DataFrame:
    """Symbols that start in a block; where none does, the tightest one around its first line."""
    b0, b1, s0, s1 = bounds
    pairs = overlapping(blocks.select(block_key, *on, b0, b1), symbols.select(*on, s0, s1, name), on, bounds)
    inside = (F.col(s0) >= F.col(b0)) & (F.col(s0) <= F.col(b1))
    around = (F.col(s0) < F.col(b0)) & (F.col(s1) >= F.col(b0))
    group = Window.partitionBy(block_key)
    ranked = pairs.withColumns({"_in": inside, "_any": F.max(inside).over(group), "_n": F.row_number().over(group.orderBy(F.desc(around), F.col(s1) - F.col(s0), F.desc(s0), name))})
    return ranked.where(F.when(F.col("_any"), F.col("_in")).otherwise((F.col("_n") == 1) & around)).select(block_key, name, s0, s1)


def merged(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: int = 1, aggs: Sequence[Column] = ()) -> DataFrame:
    """Intervals that touch, overlap or lie within ``gap`` lines (1: no line between) as one, without a limit; other columns by ``aggs``.

    Both windows read one sort, so equal intervals keep their order between them.  Rows without an end come last of their
    start and extend nothing; those without a start stay alone.
    """
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    upto = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col(start) <= upto + gap, 0).otherwise(1)
    island = df.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), *aggs).drop("_island")


def merged_capped(df: DataFrame, keys: Sequence[str], most: int = 60, gap: int = 2) -> DataFrame:
    """Candidates of a file merged with the next where it starts within ``gap`` lines of the end and has the same copies, unless the result exceeds ``most`` lines.

    A fold over each file's candidates in order of line: with a limit on length it is no window.  Score and rank are the
    best of the parts, possibly of different ones; symbol fields the first known; content is appended without the lines
    that overlap.  Columns: the keys, line_start, line_end, score, rank, content, symbol, symbol_fqn, symbol_kind,
    duplicates.  The candidates of one file have to be few, as those of a query are.
    """
    fields = ["line_start", "line_end", "score", "rank", "content", "symbol", "symbol_fqn", "symbol_kind", "duplicates"]
    items = F.array_sort(F.collect_list(F.struct(*fields)))

    def joined(a: Column, b: Column) -> Column:
        overlap = F.greatest(a["line_end"] - b["line_start"] + 1, F.lit(0))
        all_ = F.split(F.coalesce(b["content"], F.lit("")), "\n")
        rest = F.array_join(F.slice(all_, overlap + 1, F.greatest(F.size(all_) - overlap, F.lit(0))), "\n")
        return F.struct(
            a["line_start"].alias("line_start"),
            F.greatest(a["line_end"], b["line_end"]).alias("line_end"),
            F.greatest(a["score"], b["score"]).alias("score"),
            F.greatest(a["rank"], b["rank"]).alias("rank"),
            F.when(F.coalesce(rest, F.lit("")) == "", a["content"]).otherwise(F.concat(F.coalesce(a["content"], F.lit("")), F.lit("\n"), rest)).alias("content"),
            *(F.coalesce(a[c], b[c]).alias(c) for c in ("symbol", "symbol_fqn", "symbol_kind")),
            a["duplicates"].alias("duplicates"),
        )

    def step(done: Column, b: Column) -> Column:
        a = F.element_at(done, -1)
        length = F.greatest(a["line_end"], b["line_end"]) - a["line_start"] + 1
        fits = (F.size(done) > 0) & (b["line_start"] <= a["line_end"] + gap) & a["duplicates"].eqNullSafe(b["duplicates"]) & (length <= most)
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined(a, b)))).otherwise(F.concat(done, F.array(b)))

    rows = df.groupBy(*keys).agg(items.alias("_items"))
    kind = rows.schema["_items"].dataType.simpleString()
    return rows.select(*keys, F.inline(F.aggregate("_items", F.array().cast(kind), step)))


def without_contained(df: DataFrame, keys: Sequence[str], start: str, end: str, keep: Column | None = None) -> DataFrame:
    """Intervals that lie in no other of their key; of equal ones the first stays.  Where ``keep`` holds, a row stays anyway."""
    before = Window.partitionBy(*keys).orderBy(start, F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.max(end).over(before) >= F.col(end), F.lit(False))  # by one that begins no later and ends no earlier
    if keep is not None:
        held = held & ~keep
    return df.withColumn("_held", held).where(~F.col("_held")).drop("_held")


def tidy_ranges(ranges: Column, first: Column, last: Column, pad: int = 2) -> Column:
    """Ranges of an array<struct<start,end>> padded, clamped to first..last, sorted and merged where no line lies between."""
    wide = F.transform(ranges, lambda r: F.struct(F.greatest(r["start"] - pad, first).alias("start"), F.least(r["end"] + pad, last).alias("end")))
    return merge_ranges(F.filter(wide, lambda r: r["start"] <= r["end"]), 1)


def merge_ranges(ranges: Column, gap: int = 0) -> Column:
    """Sorted ranges, merged where one starts at most ``gap`` lines after the end of the one before."""
    kind = "array<struct<start:int,end:int>>"

    def step(done: Column, b: Column) -> Column:
        a = F.element_at(done, -1)
        both = F.struct(a["start"].alias("start"), F.greatest(a["end"], b["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (b["start"] <= a["end"] + gap), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(b)))

    return F.aggregate(F.array_sort(ranges.cast(kind)), F.array().cast(kind), step)


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared lines by all lines of two intervals."""
    shared = F.greatest(F.least(a1, b1) - F.greatest(a0, b0) + 1, F.lit(0))
    return shared / ((a1 - a0 + 1) + (b1 - b0 + 1) - shared)
