"""Benchmark decontamination by winnowing.

Both sides keep, of every window of w = t - k + 1 consecutive k-grams, the one
with the least hash.  Two texts that share t words share such a window, choose
the same k-gram in it, and so meet when the fingerprints are joined; each
meeting is extended word by word to the longest shared span, and spans of t
words or more count.  Items of fewer than t words count whole: for their lengths
every run of that length is a fingerprint (a window of one), so the guarantee
holds for them too.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm.common import HASHES, column_bytes, discard, grams, materialize, winnow

#: Bytes that aren't part of words become spaces, A-Z lower case.
_KEPT = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_TABLE = bytes(b if b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

#: Benchmark text for one pass over the documents; more is done in blocks of about this size.
BLOCK_BYTES = 32 << 20


def item_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Index:
    """Fingerprints of benchmark items: k-gram hash -> places, and whole short items by their length."""

    def __init__(self, items: list[tuple[str, bytes]], t: int, k: int):
        self.t, self.k, self.w = t, k, t - k + 1
        self.names: list[str] = []
        self.words: list[list[bytes]] = []
        self.hashes: list[np.ndarray] = []
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for name, text in items:
            if not (ws := item_words(text)):
                continue
            j, h = len(self.names), HASHES.of(ws)
            self.names.append(name)
            self.words.append(ws)
            self.hashes.append(h)
            if len(ws) < t:
                self.short[len(ws)][int(grams(h, len(ws))[0])].append(j)
            else:
                g = grams(h, k)
                for q in winnow(g, self.w).tolist():
                    places[int(g[q])].append((j, q))
        self.places = dict(places)
        self.prints = np.array(sorted(places), dtype=np.uint64)
        self.short_prints = {n: np.array(sorted(x), dtype=np.uint64) for n, x in self.short.items()}

    @staticmethod
    def among(g: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Which of g are in the sorted prints."""
        if not len(prints) or not len(g):
            return np.zeros(len(g), dtype=bool)
        return prints[np.minimum(np.searchsorted(prints, g), len(prints) - 1)] == g

    def spans(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of a document (from, to) that occur in items, and those items."""
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        if not ws:
            return found, items
        h = HASHES.of(ws)
        g = grams(h, self.k)
        chosen = winnow(g, self.w)
        done: dict[tuple[int, int], int] = {}  # up to where a diagonal of (item, document) is extended
        for p in chosen[self.among(g[chosen], self.prints)].tolist():
            for j, q in self.places[int(g[p])]:
                if done.get((j, p - q), -1) >= p:
                    continue
                a, b, other = p, p, self.words[j]
                lo, hi = min(p, q), min(len(ws) - p, len(other) - q)
                back = 0
                while back < lo and ws[p - back - 1] == other[q - back - 1]:
                    back += 1
                on = 0
                while on < hi and ws[p + on] == other[q + on]:
                    on += 1
                a, b = p - back, p + on
                done[j, p - q] = max(b - 1, p)
                if b - a >= self.t:
                    found.append((a, b))
                    items.add(j)
        for n, prints in self.short_prints.items():
            if n <= len(ws):
                g = grams(h, n)
                for p in np.nonzero(self.among(g, prints))[0].tolist():
                    for j in self.short[n][int(g[p])]:
                        if ws[p : p + n] == self.words[j]:
                            found.append((p, p + n))
                            items.add(j)
        return found, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same words."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SPANS = T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())]))
RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", SPANS),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_SPANS_PA = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def shared_spans(docs: DataFrame, bench: DataFrame, t: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, keep_text: bool = True, carry: list[str] | None = None) -> DataFrame:
    """For each document the word spans that it shares with benchmark items.

    One row per input row: doc_id, text, n_words, spans (disjoint, sorted, in words), items (ids as strings, sorted), and
    the columns ``carry`` of the input as c_<name>.
    Null texts and empty ones have no words and no spans.  Repeated documents are all judged; repeated items are both
    reported.  Items without words never occur.  Without items nothing is hit.

    The documents aren't shuffled.  The benchmark is broadcast as an index, in blocks of about ``block_bytes`` of text:
    its size is measured first, and a benchmark of n blocks is worked off in n passes over the rows, each adding its spans
    and all but the last written to the scratch folder, so that neither the driver nor a worker ever holds two blocks.
    """
    if not 1 <= k <= t:
        raise ValueError("k must be from 1 to t")
    spark = docs.sparkSession
    items = bench.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item is not null and text is not null")
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-n_bytes // block_bytes))
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"c_{c}") for c in carry or []))
    along = out.schema.fields[2:]
    result = T.StructType([*RESULT.fields, *along])
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        rows = sorted((r["item"], r["text"].encode()) for r in part.collect())
        sent = spark.sparkContext.broadcast(rows)
        before, out = out, out.mapInArrow(_pass(sent, t, k, b == 0, keep_text or b < blocks - 1), result)
        if b < blocks - 1:
            out = materialize(out, "pass")
            sent.destroy()
            if b:
                discard(before)
    return out


#: The index that this Python worker uses; the next task of the same pass finds it built.
_INDEX: dict[str, Index] = {}


def _pass(rows, t: int, k: int, first: bool, keep_text: bool):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _INDEX:
            _INDEX.clear()
            _INDEX[name] = Index(rows.value, t, k)
        index = _INDEX[name]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts, spans, names = [], [], []
                before = [None] * part.num_rows if first else list(zip(part.column(3).to_pylist(), part.column(4).to_pylist()))
                for text, old in zip(column_bytes(part.column(1)), before):
                    ws = item_words(text)
                    found, items = index.spans(ws)
                    got = {index.names[j] for j in items}
                    if old:
                        found += [(s["from"], s["to"]) for s in old[0]]
                        got |= set(old[1])
                    counts.append(len(ws))
                    spans.append([{"from": a, "to": b} for a, b in merged(found)])
                    names.append(sorted(got))
                text = part.column(1) if keep_text else pa.nulls(part.num_rows, pa.string())
                along = range(2 if first else len(RESULT), part.num_columns)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), text, pa.array(counts, pa.int64()), pa.array(spans, _SPANS_PA), pa.array(names, pa.list_(pa.string())), *(part.column(i) for i in along)],
                    RESULT.names + [part.schema.names[i] for i in along],
                )

    return run


def digest(shared: DataFrame) -> DataFrame:
    """Counts and digests of shared_spans()."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["to"] - s["from"]))
    return shared.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
