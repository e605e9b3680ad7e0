"""Connected components of an edge table, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long): root is the least node of its component.

    Alternates large-star and small-star steps until the edges stop changing: a logarithmic number of rounds, each a
    partial minimum by node and a join of the edges with these minima, a row a node: of a node with very many edges, whose
    edges are one key of that join, the edges' side is split between tasks as a skewed join's (adaptive execution).  Every
    round is written to the shared scratch folder.  Loops and repeated edges may occur; no edges give no rows.
    """
    e = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    e = materialize(e, "edges")
    mark = None
    while True:
        # large-star: every neighbour above a node moves to the least of the node's neighbourhood
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).unionAll(e.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        e = both.join(least, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v != u").distinct()
        # small-star: a node and its lower neighbours move to the least of these
        low = e.groupBy("v").agg(F.min("u").alias("m"))
        moved = e.join(low, "v")
        e = moved.select(F.col("u").alias("v"), F.col("m").alias("u")).unionAll(low.select("v", F.col("m").alias("u"))).where("v != u").distinct()
        e = materialize(e, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
