"""The call graph: resolving raw edges, hubs, neighbours, expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions import paths, text


def resolve(edges: DataFrame, symbols: DataFrame, is_generated: Column | None = None, imported: DataFrame | None = None) -> DataFrame:
    """Raw edges with the symbol each one means; edges that name no symbol drop out.

    edges: edge_id, from_file, from_fqn, to_name, line, import_path.  symbols: fqn, name, file, line_start, line_end.
    The first level that has a candidate decides: 0 the file an import resolves to (``imported``: edge_id, file), 1 a file
    whose path ends with the import, 2 a bare import: a file of the same directory, 3 the same file, 4 any.  Within a
    level hand-written files come first, except in level 3, then file and lines.

    No candidate lists are built: the best symbol is found once for each name, (name, file) and (name, directory), and
    the edges are joined with these by key, so a name that is defined and used everywhere costs no product.  Only edges
    with a path in their import are joined with all candidates of their name.
    """
    gen = (paths.is_generated(F.col("file")) if is_generated is None else is_generated).cast("int")
    s = symbols.select("fqn", "name", "file", "line_start", "line_end", paths.parent_dir(F.col("file")).alias("dir"), gen.alias("gen"))
    best = F.struct("gen", "file", "line_start", "line_end", "fqn")
    by_name = s.groupBy(F.col("name").alias("to_name")).agg(F.min(best).alias("any"))
    in_file = s.groupBy(F.col("name").alias("to_name"), F.col("file").alias("from_file")).agg(F.min(F.struct("line_start", "line_end", "fqn", "file")).alias("same_file"))
    in_dir = s.groupBy(F.col("name").alias("to_name"), F.col("dir").alias("from_dir")).agg(F.min(best).alias("same_dir"))
    e = edges.withColumn("from_dir", paths.parent_dir(F.col("from_file")))
    bare = F.col("import_path").isNotNull() & ~F.col("import_path").contains("/")
    out = e.join(by_name, "to_name").join(in_file, ["to_name", "from_file"], "left")
    out = out.join(in_dir, ["to_name", "from_dir"], "left").withColumn("same_dir", F.when(bare, F.col("same_dir")))
    pathed = edges.where(F.col("import_path").contains("/")).select("edge_id", "to_name", "import_path")
    ends = pathed.join(s, [pathed.to_name == s.name, s.file.endswith(pathed.import_path)]).groupBy("edge_id").agg(F.min(best).alias("by_path"))
    out = out.join(ends, "edge_id", "left")
    if imported is None:
        out = out.withColumn("by_import", F.lit(None).cast(out.schema["any"].dataType))
    else:
        wanted = edges.select("edge_id", "to_name").join(imported, "edge_id").select("edge_id", F.col("to_name").alias("name"), "file")
        out = out.join(wanted.join(s, ["name", "file"]).groupBy("edge_id").agg(F.min(best).alias("by_import")), "edge_id", "left")
    levels = ["by_import", "by_path", "same_dir", "same_file", "any"]
    level = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(i)) for i, c in enumerate(levels)))
    pick = lambda f: F.coalesce(*(F.col(c)[f] for c in levels))
    return out.select("edge_id", F.col("from_fqn").alias("in_fqn"), pick("fqn").alias("out_fqn"), "line", F.col("from_file").alias("in_file"), pick("file").alias("out_file"), level.alias("level"))


def degrees(calls: DataFrame, truncate: int | None = None) -> DataFrame:
    """node, degree: call sites in and out of each node.  ``truncate`` counts only so many of the busiest of either side."""
    out = calls.groupBy(F.col("out_fqn").alias("node")).agg(F.count("*").alias("n"))
    in_ = calls.groupBy(F.col("in_fqn").alias("node")).agg(F.count("*").alias("n"))
    if truncate is not None:
        out, in_ = (x.orderBy(F.desc("n"), "node").limit(truncate) for x in (out, in_))
    return out.unionAll(in_).groupBy("node").agg(F.sum("n").alias("degree"))


def hubs(calls: DataFrame, symbols: DataFrame, most: int = 250, truncated: bool = False) -> DataFrame:
    """The nodes of highest degree, ties by name, that have a symbol.  ``truncated`` ranks by the busiest 4 * most of either side only."""
    top = degrees(calls, 4 * most if truncated else None).orderBy(F.desc("degree"), "node").limit(most)
    one = symbols.groupBy("fqn").agg(F.min(F.struct("name", "kind", "file", "line_start")).alias("s"))
    return top.join(one, top.node == one.fqn).select("node", "degree", "s.*")


def hub_edges(calls: DataFrame, nodes: DataFrame, most: int = 600) -> DataFrame:
    """Distinct edges between hubs, in order of their ends."""
    keep = nodes.select(F.col("node")).distinct()
    inner = calls.join(keep.withColumnRenamed("node", "in_fqn"), "in_fqn", "left_semi").join(keep.withColumnRenamed("node", "out_fqn"), "out_fqn", "left_semi")
    return inner.select("in_fqn", "out_fqn").distinct().orderBy("in_fqn", "out_fqn").limit(most)


def graph_truncated(nodes: DataFrame, edges: DataFrame, most_nodes: int = 250, most_edges: int = 600) -> DataFrame:
    """One row: n_nodes, n_edges, truncated."""
    both = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionAll(edges.select(F.lit(0), F.lit(1)))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_nodes"), F.coalesce(F.sum("e"), F.lit(0)).alias("n_edges")).withColumn("truncated", (F.col("n_nodes") >= most_nodes) | (F.col("n_edges") >= most_edges))


def neighbour_stats(calls: DataFrame, own: str, other: str, other_file: str, most: int = 30) -> DataFrame:
    """node, n (distinct names), files (distinct), names: those on the other side of each node's calls.

    Names are short and distinct, the first ``most`` in order of nearness (same file, same directory, elsewhere) and then
    of the alphabet; a name that occurs in several places counts as near as its nearest.  Null and empty names are left
    out.  Repeated calls of a pair are one row before anything is counted; of a hub's names every task keeps its first few.
    """
    rows = calls.where(F.col(other).isNotNull() & (F.col(other) != "") & F.col(own).isNotNull())
    own_file = "in_file" if own == "in_fqn" else "out_file"
    near = F.when(F.col(other_file) == F.col(own_file), 0).when(paths.parent_dir(F.col(other_file)) == paths.parent_dir(F.col(own_file)), 1).otherwise(2)
    pairs = rows.groupBy(F.col(own).alias("node"), F.col(other).alias("other"), F.col(other_file).alias("file")).agg(F.min(near).alias("near"))
    each = pairs.groupBy("node", text.short_name(F.col("other")).alias("short")).agg(F.min("near").alias("near"))
    first = each.withColumn("_n", F.row_number().over(Window.partitionBy("node").orderBy("near", "short"))).where(F.col("_n") <= most)
    names = first.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("near", "short"))), lambda x: x["short"]).alias("names"))
    counts = pairs.groupBy("node").agg(F.countDistinct("other").alias("n"), F.countDistinct("file").alias("files"))
    return counts.join(names, "node")


def caller_stats(calls: DataFrame) -> DataFrame:
    return neighbour_stats(calls, "out_fqn", "in_fqn", "in_file")


def callee_stats(calls: DataFrame) -> DataFrame:
    return neighbour_stats(calls, "in_fqn", "out_fqn", "out_file")


def neighbours(seeds: DataFrame, calls: DataFrame, most: int = 20) -> DataFrame:
    """seed, node, factor: up to ``most`` callers (factor 0.6) and callees (0.5) of each seed, in order of name.

    Calls are narrowed to those of the seeds, which are few, before anything is made distinct.
    """

    def side(own: str, other: str, factor: float) -> DataFrame:
        mine = calls.select(F.col(own).alias("seed"), F.col(other).alias("node")).join(seeds.select("seed").distinct(), "seed", "left_semi")
        each = mine.distinct()
        n = F.row_number().over(Window.partitionBy("seed").orderBy("node"))
        return each.withColumn("_n", n).where(F.col("_n") <= most).drop("_n").withColumn("factor", F.lit(factor))

    return side("out_fqn", "in_fqn", 0.6).unionAll(side("in_fqn", "out_fqn", 0.5))


def expand(seeds: DataFrame, calls: DataFrame, depth: int = 2, floor: float = 0.15, most: int = 30, per_hop: int = 20, allowed: DataFrame | None = None) -> DataFrame:
    """node, score: what lies within ``depth`` calls of the seeds (node, score), best score for each node, the best ``most``.

    A hop to a caller takes 0.6 of the score, one to a callee 0.5; below ``floor`` nothing is followed.  Seeds don't come
    back, and aren't gone through.  ``allowed`` (node) names the nodes that have a chunk: others are neither returned nor
    gone through.  Levels are worked off as wholes: every node keeps the best score of all ways of a length, where a
    stack would keep the first way it happens to take.
    """
    start = seeds.groupBy("node").agg(F.max("score").alias("score"))
    seen, level = start.select("node"), start
    found = None
    for _ in range(depth):
        hop = neighbours(level.select(F.col("node").alias("seed")), calls, per_hop)
        reached = hop.join(level.withColumnRenamed("node", "seed"), "seed").select("node", (F.col("score") * F.col("factor")).alias("score"))
        level = reached.where(F.col("score") >= floor).join(seen, "node", "left_anti").groupBy("node").agg(F.max("score").alias("score"))
        if allowed is not None:
            level = level.join(allowed.select("node").distinct(), "node", "left_semi")
        found = level if found is None else found.unionAll(level)
        seen = seen.unionAll(level.select("node"))
    return found.orderBy(F.desc("score"), "node").limit(most)
