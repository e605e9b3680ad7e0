"""MinHash near-dedup with tensored banding.

Two collections A and B hold m bands of t minhashes each, and a table key is made
of one band of A and one of B, so m * m tables need only 2 * m * t minhashes.
A pair of similarity s meets unless one collection fails it: the chance of a miss
is below 2 * (1 - s**t)**m, and m is chosen so that it is at most ``miss`` at the
threshold.  Candidates are confirmed on the full shingle sets.

Texts with equal sets are one class from the start.  Classes that share buckets,
directly or through others, form a cluster; clusters are disjoint, so each one
within a size bound is sent to one task with its sets, once, and all its links
are found there by counting through its shingles' postings.

In larger clusters no pairs are made within a bucket but those of centres: first
the least member, then, while a bucket still holds different components, twice
as many centres a round, chosen by a hash, until every pair not yet in one
component has been tried.  So no link is lost, and buckets of near copies, which
join in the first rounds, cost a few times their size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm.common import HASHES, column_bytes, grams, materialize, mix
from corvid.llm.graph import components

#: Ids of texts that share a bucket are broadcast up to this number (8 bytes each).
BROADCAST_IDS = 2_000_000


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles; of fewer words, the whole as one; of none, empty."""
    h = HASHES.of(text.lower().split())
    n = min(k, len(h))
    return np.unique(grams(h, n) ^ np.uint64(mix(np.array([n], dtype=np.uint64))[0])) if n else np.zeros(0, dtype=np.uint64)


class Tables:
    """The minhash functions and the tensored tables."""

    def __init__(self, similarity: float, t: int = 3, miss: float = 1e-4, seed: int = 20_11):
        self.t, self.m = t, max(1, math.ceil(math.log(miss / 2) / math.log(1 - similarity**t)))
        n = 2 * self.m * t
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, n, dtype=np.uint64)
        self.salt = rng.integers(0, 2**63, (self.m, self.m), dtype=np.uint64)
        self.weights = rng.integers(0, 2**63, t, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        # the signature: so many low bits of so many minhashes as fill two 64-bit words
        self.signed = min(64, n)

    def minhashes(self, s: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), 2**64 - 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(s), 2048):
                low = np.minimum(low, (s[at : at + 2048, None] * self.a + self.b).min(axis=0))
        return low

    def keys(self, low: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            bands = mix((low.reshape(2, self.m, self.t) * self.weights).sum(axis=2, dtype=np.uint64))
            return mix(bands[0][:, None] * np.uint64(0x9E3779B97F4A7C15) + bands[1][None, :] + self.salt).ravel()

    def signature(self, low: np.ndarray) -> tuple[int, int]:
        """One bit more from each of up to 64 minhashes for either word."""
        v = mix(low[: self.signed])
        bits = lambda k: int.from_bytes(np.packbits(((v >> np.uint64(k)) & np.uint64(1)).astype(np.uint8)).tobytes().ljust(8, b"\0"), "big", signed=True)
        return bits(0), bits(1)

    def most_unlike(self, similarity: float) -> int:
        """So many of the signature's bits may differ: six standard deviations above what the threshold leads to expect."""
        p = 1 - similarity
        n = 2 * self.signed
        return math.ceil(n * p / 2 + 6 * math.sqrt(self.signed * (p * 0.5 + p * (1 - p))))


SETS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("k1", T.LongType()),
        T.StructField("k2", T.LongType()),
        T.StructField("s1", T.LongType()),
        T.StructField("s2", T.LongType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
    ]
)


def _signed(v: np.ndarray) -> np.ndarray:
    return v.view(np.int64)


def _describe(tables: Tables, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows, keys, offsets = [], [], [0]
                for text in column_bytes(part.column(1)):
                    s = shingles(text, k)
                    if not len(s):
                        rows.append((0, 0, 0, 0, 0))
                    else:
                        low = tables.minhashes(s)
                        with np.errstate(over="ignore"):
                            pair = _signed(np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)])).tolist()
                        rows.append((len(s), *pair, *tables.signature(low)))
                        keys.append(_signed(tables.keys(low)))
                    offsets.append(offsets[-1] + (tables.m**2 if len(s) else 0))
                flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64), pa.int64())
                cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], SETS.names)

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [_signed(shingles(text, k)) for text in column_bytes(part.column(1))]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], ["rep", "shingles"])

    return run


def _level(rep: Column) -> Column:
    """Trailing zeros of a hash: half of all members have level 0, a quarter 1, and so on."""
    h = F.xxhash64(rep)
    return F.bit_count(h.bitwiseAND(-h) - F.lit(1))


def _centre(rep: Column, least: Column, size: Column, turn: int) -> Column:
    """Whether a bucket's member is a centre by a turn: about 2**turn are, in the last turn all."""
    if turn < 0:
        return F.lit(False)
    first = rep == least
    return first if turn == 0 else first | (_level(rep) >= F.floor(F.log2(size)) - turn)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", t: int = 3, miss: float = 1e-4, most_members: int = 4000, most_shingles: int = 4_000_000) -> DataFrame:
    """Link texts whose k-word shingle sets have 100 * intersection >= percent * union, and name the components.

    One row per input row: doc_id, n_shingles, component_id (the least doc_id reachable, its own included) and kept
    (doc_id = component_id).  Words are lower-cased in A-Z.  Null and empty texts have no shingles and are linked with
    nothing.  Ids should be unique; rows that share one share its links.  A null id is left alone: component_id null, kept true.
    Other columns aren't read.

    A cluster of more than ``most_members`` classes or ``most_shingles`` shingles is worked off by centres.
    Only table keys, ids and signatures of all texts are shuffled; the sets of texts that share a bucket are written
    once to the scratch folder and joined to candidate pairs whose signatures are near enough.
    """
    tables = Tables(percent / 100, t, miss)
    most = tables.most_unlike(percent / 100)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = materialize(rows.mapInArrow(_describe(tables, k), SETS), "minhash")
    some = described.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(some.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = some.join(classes.select(F.col("rep").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"], "left_semi")
    members = reps.select(F.explode("keys").alias("key"), F.col("doc_id").alias("rep"), "n_shingles", "s1", "s2")
    sizes = members.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("least")).where("size > 1")
    buckets = materialize(members.select("key", "rep").join(sizes, "key"), "buckets")
    marks = materialize(reps.join(buckets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "s1", "s2").dropDuplicates(["rep", "s1", "s2"]), "signatures")
    wanted = marks.select(F.col("rep").alias("doc_id")).distinct()
    if marks.count() <= BROADCAST_IDS:  # else the texts are shuffled
        wanted = F.broadcast(wanted)
    sets = materialize(rows.join(wanted, "doc_id", "left_semi").mapInArrow(_full_sets(k), "rep long, shingles array<long>"), "shingles")

    # Rows with one id and different texts start in one component: the id is the node.
    edges = buckets.where("rep != least").select(F.col("least").alias("a"), F.col("rep").alias("b"))
    clusters = components(edges).withColumnsRenamed({"node": "rep", "root": "cluster"})
    sizes = clusters.join(marks, "rep").groupBy("cluster").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    fits = (F.col("members") <= most_members) & (F.col("shingles") <= most_shingles)
    clusters = materialize(clusters.join(sizes.select("cluster", fits.alias("fits")), "cluster"), "clusters")
    together = sets.join(clusters.where("fits").select("rep", "cluster"), "rep").select("cluster", "rep", "shingles")
    labels = together.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(_linked(percent), "node long, root long")
    labels = materialize(labels, "labels")
    large = clusters.where("not fits")
    if not large.isEmpty():
        apart = materialize(buckets.join(large.select("rep"), "rep", "left_semi").select("key", "rep", "size", "least"), "large")
        more = _by_centres(apart, marks, sets, percent, most)
        labels = labels if more is None else labels.unionAll(more)

    named = classes.join(labels, classes.rep == labels.node, "left").select("k1", "k2", F.coalesce("root", "rep").alias("rep"))
    out = described.drop("keys", "s1", "s2").join(named, ["k1", "k2"], "left")
    ids = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", ids.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _linked(percent: int):
    """(cluster, rep, shingles) sorted by cluster -> (node, root) of all members that are linked to a lesser one."""

    def links(reps: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        order = np.argsort(reps, kind="stable")
        reps, sets = [reps[i] for i in order], [sets[i] for i in order]
        n = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), n)
        _, of = np.unique(np.concatenate(sets), return_inverse=True)
        postings = owner[np.argsort(of, kind="stable")]
        length = np.bincount(of)
        first = np.cumsum(length) - length
        starts = np.cumsum(n) - n
        parent = list(range(len(reps)))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i in range(1, len(reps)):
            if reps[i] == reps[i - 1]:  # one id twice
                parent[i] = find(i - 1)
        for i in range(len(reps) - 1):
            own = of[starts[i] : starts[i] + n[i]]
            size = length[own]
            upto = np.cumsum(size)
            at = np.arange(upto[-1]) + np.repeat(first[own] - (upto - size), size)
            both = np.bincount(postings[at], minlength=len(reps))
            for j in np.nonzero(both * 100 >= (n + n[i] - both) * percent)[0].tolist():
                if j > i and (a := find(i)) != (b := find(j)):
                    parent[max(a, b)] = min(a, b)
        return sorted({(reps[i], reps[r]) for i in range(len(reps)) if reps[r := find(i)] != reps[i]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cluster, reps, sets, out = None, [], [], []
        for batch in batches:
            of, rep, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for i, c in enumerate(of):
                if c != cluster:
                    if len(reps) > 1:
                        out += links(reps, sets)
                    cluster, reps, sets = c, [], []
                reps.append(rep[i])
                sets.append(flat[offsets[i] : offsets[i + 1]].copy())
        if len(reps) > 1:
            out += links(reps, sets)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["node", "root"])

    return run


def _by_centres(buckets: DataFrame, marks: DataFrame, sets: DataFrame, percent: int, most: int) -> DataFrame | None:
    """(node, root) of the links within buckets (key, rep, size, least), by rounds of centres."""
    labels = None  # node -> component, for nodes that have left their own
    active, turn = buckets, 0
    largest = buckets.agg(F.max("size")).first()[0] or 0
    while largest and turn <= math.floor(math.log2(largest)) + 1:
        if turn == 0:
            pairs = active.where("rep != least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
        else:
            here = active.withColumns({"is_now": _centre(F.col("rep"), F.col("least"), F.col("size"), turn), "was": _centre(F.col("rep"), F.col("least"), F.col("size"), turn - 1)})
            centres = here.where("is_now and not was").select("key", F.col("rep").alias("a"), F.col("label").alias("la"))
            others = here.where("not was").select("key", F.col("rep").alias("b"), F.col("label").alias("lb"), "is_now")
            pairs = centres.join(others, "key").where("la != lb and (not is_now or a < b)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = materialize(_confirmed(pairs, marks, sets, percent, most), "links")
        if not links.isEmpty():
            labels = _joined(labels, links)
        keyed = active.select("key", "rep", "size", "least")
        own = keyed.join(labels, keyed.rep == labels.node, "left").select(*keyed.columns, F.coalesce("root", "rep").alias("label")) if labels is not None else keyed.withColumn("label", F.col("rep"))
        open_keys = own.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.first("size").alias("n")).where((F.col("x") != F.col("y")) & (F.floor(F.log2("n")) > turn)).select("key")
        active = materialize(own.join(open_keys, "key"), "active")
        largest = active.agg(F.max("size")).first()[0] or 0
        turn += 1
    return labels


def _confirmed(pairs: DataFrame, marks: DataFrame, sets: DataFrame, percent: int, most: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; sizes and signatures are looked at before sets are fetched."""
    side = lambda df, x: df.select(*(F.col(c).alias(x if c == "rep" else f"{c}_{x}") for c in df.columns))
    near = pairs.join(side(marks, "a"), "a").join(side(marks, "b"), "b")
    near = near.where((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b"))) + F.bit_count(F.col("s2_a").bitwiseXOR(F.col("s2_b"))) <= most))
    full = near.select("a", "b").distinct().join(side(sets, "a"), "a").join(side(sets, "b"), "b")
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return full.withColumn("both", both).where(F.col("both") * 100 >= (F.size("shingles_a") + F.size("shingles_b") - F.col("both")) * percent).select("a", "b").distinct()


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components after more links."""
    edges = links
    if labels is not None:
        edges = links.unionAll(labels.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return materialize(components(edges), "labels")
