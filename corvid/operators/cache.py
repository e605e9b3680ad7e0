"""The embedding cache and batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embedder = Callable[[list[str]], list[list[float]]]


def split(texts: DataFrame, cache: DataFrame, col: str = "content") -> tuple[DataFrame, DataFrame]:
    """Rows whose text the cache (key, embedding) has, with its vector, and the others; the key is the text's MD5."""
    found = texts.withColumn("key", F.md5(F.col(col))).join(cache.select("key", "embedding", F.lit(True).alias("_hit")), "key", "left")
    return found.where("_hit").drop("_hit"), found.where("_hit is null").drop("_hit", "embedding")


def batches(texts: Sequence[str], most: int = 128, most_bytes: int = 1_500_000) -> Iterator[list[str]]:
    """Texts in batches of at most so many and so many bytes; a larger one goes alone."""
    batch: list[str] = []
    size = 0
    for t in texts:
        n = len(t.encode())
        if batch and (len(batch) == most or size + n > most_bytes):
            yield batch
            batch, size = [], 0
        batch.append(t)
        size += n
    if batch:
        yield batch


def embedded(texts: DataFrame, embed: Embedder, col: str = "content") -> DataFrame:
    """``texts`` with embedding.  An answer of another number of vectors, or an empty vector, fails the task."""
    names = texts.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: list[list[float]] = []
            for part in batches([t or "" for t in batch.column(names.index(col)).to_pylist()]):
                got = embed(part)
                if len(got) != len(part) or any(not v for v in got):
                    raise ValueError("the embedder answered with another number of vectors, or with an empty one")
                out += got
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float32()))], [*names, "embedding"])

    return texts.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def with_vectors(texts: DataFrame, cache: DataFrame, embed: Embedder, col: str = "content") -> DataFrame:
    """``texts`` with embedding, from the cache where it has it; each distinct other text is embedded once."""
    hits, misses = split(texts, cache, col)
    new = embedded(misses.select("key", col).dropDuplicates(["key"]), embed, col).select("key", "embedding")
    return hits.unionByName(misses.join(new, "key"))


def purged(cache: DataFrame, oldest: int, col: str = "used_at") -> DataFrame:
    return cache.where(F.col(col) >= oldest)


def hashing_embedder(dims: int = 64) -> Embedder:
    """An embedder without a model: words hashed into signed components, for tests and for places without a network."""
    import re
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dims
            for w in re.findall(r"[A-Za-z]+|\d+|\S", t) or [""]:
                h = zlib.crc32(w.lower().encode())
                v[h % dims] += 1.0 if h & 0x80000000 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return embed
