"""Exact vector search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions import vectors


def scored(df: DataFrame, query: Sequence[float], vector_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """``df`` with score, the cosine with a query vector.  Rounded scores tie alike on every engine."""
    score = vectors.cosine(F.col(vector_col), query)
    return df.withColumn("score", score if digits is None else F.round(score, digits))


def top_k(df: DataFrame, query: Sequence[float], k: int, id_cols: Sequence[str], vector_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """The k rows nearest to a query, ties by id: a partial top-k in each partition, then one of k rows from each.

    Narrow by scope before, by anything else after: a filter above the limit stays above it.
    """
    return scored(df, query, vector_col, digits).orderBy(F.desc("score"), *id_cols).limit(k)


def top_k_blocked(df: DataFrame, query: Sequence[float], k: int, id_cols: Sequence[str], vector_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """As top_k, by one matrix product for each Arrow batch; for long vectors.  Rows of another length score 0."""
    q = np.asarray(query, dtype=np.float64)
    q_norm = float(np.sqrt(q @ q))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(names.index(vector_col))
            sizes = np.array([len(v) if v is not None else -1 for v in col.to_pylist()]) if col.null_count else np.diff(col.offsets.to_numpy())
            score = np.zeros(batch.num_rows)
            fit = np.nonzero(sizes == len(q))[0]
            if len(fit) and len(q) and q_norm:
                m = col.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fit), len(q))
                scale = np.sqrt((m * m).sum(axis=1)) * q_norm
                score[fit] = np.divide(m @ q, scale, out=np.zeros(len(fit)), where=scale > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score if digits is None else np.round(score, digits))], [*names, "score"])

    schema = df.withColumn("score", F.lit(0.0)).schema
    return df.mapInArrow(run, schema).orderBy(F.desc("score"), *id_cols).limit(k)


def top_k_by(df: DataFrame, query: Sequence[float], k: int, shard_col: str, id_cols: Sequence[str], vector_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """The k nearest rows of each shard."""
    best = Window.partitionBy(shard_col).orderBy(F.desc("score"), *id_cols)
    return scored(df, query, vector_col, digits).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")


def hydrate(hits: DataFrame, chunks: DataFrame, keys: Sequence[str], content_col: str = "content") -> DataFrame:
    """Hits with their chunks; a hit without one stays, with empty content."""
    return hits.join(chunks, list(keys), "left").withColumn(content_col, F.coalesce(content_col, F.lit("")))


def without(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """An index without some of its rows."""
    return df.join(keys, list(on), "left_anti")


def delta(df: DataFrame, gone: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """An index after files went and rows came."""
    return without(df, gone, on).unionByName(new)


def same_identity(df: DataFrame, provider: str, model: str, dims: int) -> DataFrame:
    """Only vectors that may be compared with a query's: of the same provider, model and length."""
    return df.where((F.col("provider") == provider) & (F.col("model") == model) & (F.col("dims") == dims))


def identity_holds(stored: DataFrame, again: DataFrame, key: str, least: float = 0.99) -> DataFrame:
    """One row, holds: whether vectors embedded again are the stored ones."""
    pair = stored.select(key, F.col("embedding").alias("a")).join(again.select(key, F.col("embedding").alias("b")), key)
    return pair.agg(F.coalesce(F.bool_and(vectors.cosine(F.col("a"), F.col("b")) >= least), F.lit(True)).alias("holds"))
