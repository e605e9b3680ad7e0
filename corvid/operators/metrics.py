"""Figures on retrieval quality, latency and the shape of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.operators import intervals


def recall(cases: DataFrame, ranking: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: recall at each k and mean overlap ratio of cases (case_id, file, line_start, line_end) in a ranking (case_id, file, r_start, r_end, pos from 0).

    A case is found at the first place that overlaps it; its ratio is the best of its overlapping places, 0 without one.
    """
    c = cases.select("case_id", F.lower(F.col("file")).alias("file"), "line_start", "line_end")
    hits = intervals.overlapping(c, ranking.withColumn("file", F.lower(F.col("file"))), ["case_id", "file"], ("line_start", "line_end", "r_start", "r_end"))
    ratio = intervals.overlap_ratio(F.col("line_start"), F.col("line_end"), F.col("r_start"), F.col("r_end"))
    best = hits.groupBy("case_id").agg(F.min("pos").alias("pos"), F.max(ratio).alias("ratio"))
    all_ = c.select("case_id").join(best, "case_id", "left")
    return all_.agg(F.count("*").alias("cases"), *(F.avg(F.when(F.col("pos") < k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks), F.avg(F.coalesce("ratio", F.lit(0.0))).alias("mean_ratio"))


def latency(samples: DataFrame, col: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """n, p50, p95, max of samples by nearest rank: values that were measured, none in between."""
    pct = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{col}`)")
    return samples.where(F.col(col).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), pct(0.5).alias("p50"), pct(0.95).alias("p95"), F.max(col).alias("max"))


def chunk_shape(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: chunks, copies (share of chunks whose content occurs before), overlaps (pairs of neighbours), cut (share of symbols that no chunk holds whole), and chunks with 0, 1, 2, 3 or more symbols."""
    c = chunks.select("file", "line_start", "line_end", F.md5("content").alias("h"))
    s = symbols.select("file", F.col("line_start").alias("s0"), F.col("line_end").alias("s1"), "fqn")
    n_distinct = F.countDistinct("h")
    shape = c.agg(F.count("*").alias("chunks"), (F.lit(1.0) - n_distinct / F.count("*")).alias("copies"))
    upto = F.max("line_end").over(Window.partitionBy("file").orderBy("line_start", "line_end").rowsBetween(Window.unboundedPreceding, -1))
    overlaps = c.withColumn("o", (F.col("line_start") <= upto).cast("int")).agg(F.coalesce(F.sum("o"), F.lit(0)).alias("overlaps"))
    held = intervals.overlapping(s, c, ["file"], ("s0", "s1", "line_start", "line_end")).groupBy("fqn").agg(F.bool_or((F.col("line_start") <= F.col("s0")) & (F.col("line_end") >= F.col("s1"))).alias("whole"))
    cut = s.select("fqn").distinct().join(held, "fqn", "left").agg(F.avg(F.when(F.coalesce("whole", F.lit(False)), 0.0).otherwise(1.0)).alias("cut"))
    per = intervals.overlapping(c, s, ["file"], ("line_start", "line_end", "s0", "s1"), "left").groupBy("file", "line_start", "line_end").agg(F.count("fqn").alias("n"))
    hist = per.agg(*(F.coalesce(F.sum((F.least("n", F.lit(3)) == k).cast("int")), F.lit(0)).alias(f"with_{k}") for k in range(4)))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(shape).join(one(overlaps), "_one").join(one(cut), "_one").join(one(hist), "_one").drop("_one")


def strided(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """``limit`` rows spread evenly over the order: those at floor(i * n / limit).  For sets of cases, which are small."""
    n = df.count()
    if n <= limit:
        return df
    at = F.row_number().over(Window.orderBy(*order)) - 1
    i = F.ceil(F.col("_at") * limit / n)
    return df.withColumn("_at", at).where((F.floor(i * n / limit) == F.col("_at")) & (i < limit)).drop("_at")


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """case_id, before, after (places, null for none), status: better, worse, same, only_before, only_after."""
    a, b = before.select("case_id", F.col("pos").alias("before"), F.lit(True).alias("_a")), after.select("case_id", F.col("pos").alias("after"), F.lit(True).alias("_b"))
    x, y = F.coalesce("before", F.lit(2**30)), F.coalesce("after", F.lit(2**30))
    status = F.when(F.col("_a").isNull(), "only_after").when(F.col("_b").isNull(), "only_before").when(y < x, "better").when(y > x, "worse").otherwise("same")
    return a.join(b, "case_id", "full_outer").select("case_id", "before", "after", status.alias("status"))
