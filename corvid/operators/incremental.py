"""What changed, and what has to be done again for it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions import paths
from corvid.operators import graph


def snapshot_diff(stored: DataFrame, current: DataFrame, version: int | None = None) -> DataFrame:
    """path, change (added, modified, deleted) of two listings (path, mtime, size; stored also chunker_version).

    A file is modified if its time or size differs, or if it was cut by another version of the chunker.
    """
    s = stored.select("path", F.col("mtime").alias("m0"), F.col("size").alias("s0"), *([F.col("chunker_version").alias("v0")] if version is not None else []), F.lit(True).alias("had"))
    c = current.select("path", F.col("mtime").alias("m1"), F.col("size").alias("s1"), F.lit(True).alias("has"))
    other = ~F.col("m0").eqNullSafe(F.col("m1")) | ~F.col("s0").eqNullSafe(F.col("s1"))
    if version is not None:
        other = other | (F.coalesce("v0", F.lit(0)) != version)
    change = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "deleted").when(other, "modified")
    return s.join(c, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def last_change(changes: DataFrame, order: str) -> DataFrame:
    """The last change of each path."""
    return changes.groupBy("path").agg(F.max_by("change", order).alias("change"))


def normalised(changes: DataFrame, current: DataFrame, stored: DataFrame) -> DataFrame:
    """Changes as the disk and the store have it: what is gone and was stored is deleted, what is there is added or modified, the rest is nothing."""
    c = changes.select("path").distinct()
    c = c.join(current.select("path", F.lit(True).alias("here")), "path", "left").join(stored.select("path", F.lit(True).alias("known")), "path", "left")
    change = F.when(F.col("here") & F.col("known"), "modified").when(F.col("here"), "added").when(F.col("known"), "deleted")
    return c.select("path", change.alias("change")).where("change is not null")


def allowed(changes: DataFrame, listed: DataFrame) -> DataFrame:
    """Changes of files that are indexed (listed: path); deletions always pass, whatever the rules say by now."""
    deleted = F.col("change") == "deleted"
    return changes.where(deleted).unionByName(changes.where(~deleted).join(listed.select("path").distinct(), "path", "left_semi").select(*changes.columns))


def under(stored: DataFrame, dirs: DataFrame) -> DataFrame:
    """Stored paths under any of the directories (dir): by their ancestors, so that a key carries the join."""
    each = stored.select("path", F.explode(paths.ancestors(F.col("path"))).alias("dir"))
    return each.join(dirs.select("dir").distinct(), "dir", "left_semi").select("path").distinct()


def surface_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, name, fqn, change (added, removed) of the symbols of files."""
    keys = ["file", "name", "fqn"]
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    removed = a.join(b, [a[k].eqNullSafe(b[k]) for k in keys], "left_anti").withColumn("change", F.lit("removed"))
    return removed.unionAll(b.join(a, [b[k].eqNullSafe(a[k]) for k in keys], "left_anti").withColumn("change", F.lit("added")))


def blast_radius(changed: DataFrame, delta: DataFrame, calls: DataFrame, raw_edges: DataFrame) -> DataFrame:
    """Files whose edges have to be resolved again: the changed ones, those that call into a file that lost symbols, and those that name an added symbol."""
    lost = delta.where("change = 'removed'").select(F.col("file").alias("out_file")).distinct()
    gained = delta.where("change = 'added'").select(F.col("name").alias("to_name")).distinct()
    callers = calls.join(lost, "out_file", "left_semi").select(F.col("in_file").alias("file"))
    naming = raw_edges.join(gained, "to_name", "left_semi").select(F.col("from_file").alias("file"))
    return changed.select("file").unionAll(callers).unionAll(naming).where("file is not null").distinct()


def scoped(affected: int, indexed: int) -> bool:
    """Whether to resolve only what is affected: not from 64 files and an eighth of all on."""
    return not (affected >= 64 and affected * 8 > indexed)


def leaving(raw_edges: DataFrame, radius: DataFrame) -> DataFrame:
    """The edges that leave the files of a radius (file)."""
    return raw_edges.join(radius.select(F.col("file").alias("from_file")).distinct(), "from_file", "left_semi")


def re_resolved(calls: DataFrame, radius: DataFrame, raw_edges: DataFrame, symbols: DataFrame, imported: DataFrame | None = None) -> DataFrame:
    """The call graph after the edges that leave the radius were resolved again; ``imported`` as for graph.resolve."""
    files = radius.select(F.col("file").alias("in_file")).distinct()
    kept = calls.join(files, "in_file", "left_anti")
    cols = ["in_fqn", "out_fqn", "line", "in_file", "out_file"]
    return kept.select(*cols).unionAll(graph.resolve(leaving(raw_edges, radius), symbols, imported=imported).select(*cols))


def without_files(df: DataFrame, gone: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A table without the rows that name a path (path) of ``gone`` in any of the columns."""
    keys = gone.select("path").distinct()
    for c in cols:
        df = df.join(keys.withColumnRenamed("path", c), c, "left_anti").select(*df.columns)
    return df


def upserted(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The last row of each key, in the order given."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def retried(queue: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes with the paths that wait to be tried again."""
    waiting = queue.select("path").distinct().join(changes.select("path"), "path", "left_anti").withColumn("change", F.lit("modified"))
    return changes.select("path", "change").unionAll(waiting)


def backoff(failures: int, first: float = 60.0, most: float = 1800.0) -> float:
    """Seconds to wait after so many failures in a row."""
    return min(most, first * 2 ** max(0, failures - 1))
