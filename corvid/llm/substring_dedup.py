"""Substring dedup with suffix automata of reference shards.

A word is removed if it lies in a run of ``length`` words that also starts in a
document with a smaller id.

Shards.  An automaton of the whole corpus can't be broadcast, so the corpus is
cut into shards by content: the run of ``length`` words at each place belongs to
the shard of the least hash of its k-grams (winnowing), so equal runs meet in
one shard, each run in one only.  Shards whose anchor occurs in one document
hold no repeat and are left out before any text moves.

Automata.  Each shard's contexts are streamed in order of document id.  Walking
a context through the shard's suffix automaton gives its matching statistics:
where the longest match that ends at a word has ``length`` words or more, the
run ending there starts in a smaller document and is removed.  Only what the
automaton doesn't hold yet is added, so it grows with the distinct text, not
with the number of copies.  The automaton is built in the task that streams its
shard; nothing is broadcast from the driver, whose memory would bound the corpus.

Shards too large for that (``most_contexts``, or ``most_states`` reached: a state takes about half a kilobyte, and what a
document still has to add counts as states) take an exact way without a bound: the least id of every run, by a partial
aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import HASHES, column_bytes, grams, materialize, mix


class SuffixAutomaton:
    """A suffix automaton of several word sequences."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.len = [0]

    def add(self, words: list[bytes]) -> None:
        nxt, link, length, last = self.next, self.link, self.len, 0
        for c in words:
            have = nxt[last].get(c)
            if have is not None:
                last = have if length[have] == length[last] + 1 else self._clone(last, c, have)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = cur

    def _clone(self, p: int, c: bytes, q: int) -> int:
        nxt, link = self.next, self.link
        new = len(nxt)
        nxt.append(nxt[q].copy())
        self.len.append(self.len[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def matches(self, words: list[bytes]) -> list[int]:
        """For each word the length of the longest match that ends with it."""
        nxt, link, length = self.next, self.link, self.len
        state = n = 0
        out = []
        for c in words:
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nxt[state].get(c)
            if to is None:
                n = 0
            else:
                state = to
                n += 1
            out.append(n)
        return out


def _digest(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a word sequence."""
    if not len(h):
        return 0, 0
    a, b = grams(h, len(h))[0], grams(mix(h ^ np.uint64(0x5851F42D4C957F2D)), len(h))[0]
    return tuple(np.array([a, b]).view(np.int64).tolist())


def _chosen(h: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of ``length`` words the place of its anchor, and the k-grams' hashes."""
    g = grams(h, k)
    w = length - k + 1
    if len(g) < w:
        return np.zeros(0, dtype=np.int64), g
    out = []
    for at in range(0, len(g) - w + 1, 65536):
        v = np.lib.stride_tricks.sliding_window_view(g[at : at + 65536 + w - 1], w)
        out.append(at + np.arange(len(v)) + (w - 1) - np.argmin(v[:, ::-1], axis=1))
    return np.concatenate(out), g


def _describe(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows, anchors, offsets = [], [], [0]
                for text in column_bytes(part.column(1)):
                    h = HASHES.of(text.split())
                    places, g = _chosen(h, length, k)
                    own = np.unique(g[places].view(np.int64))
                    rows.append((len(h), *_digest(h)))
                    anchors.append(own)
                    offsets.append(offsets[-1] + len(own))
                cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
                flat = pa.array(np.concatenate(anchors), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], ["doc_id", "n_words", "t1", "t2", "anchors"])

    return run


def _contexts(length: int, k: int):
    """Of each document the contexts of its repeated anchors: the words of all runs that have the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out: list[tuple] = []
                size = 0
                for doc, text, wanted in zip(part.column(0).to_pylist(), column_bytes(part.column(1)), part.column(2).to_pylist()):
                    ws = text.split()
                    h = HASHES.of(ws)
                    places, g = _chosen(h, length, k)
                    if not len(places):
                        continue
                    key_of = g[places].view(np.int64)
                    starts = np.append(0, np.nonzero(np.diff(key_of))[0] + 1)  # a repeated k-gram's runs stay together
                    ends = np.append(starts[1:], len(places))
                    keys = key_of[starts]
                    hot = {x["anchor"]: x["hot"] for x in wanted}
                    t1 = _digest(h)[0]
                    for i in np.nonzero(np.isin(keys, np.fromiter(hot, dtype=np.int64, count=len(hot))))[0].tolist():
                        a, b, key = int(starts[i]), int(ends[i]) - 1 + length, int(keys[i])
                        out.append((key, doc, t1, a, hot[key], b" ".join(ws[a:b])))
                        size += len(out[-1][5])
                    if len(out) > 20_000 or size > 4 << 20:
                        yield _batch(out)
                        out, size = [], 0
                if out:
                    yield _batch(out)

    return run


_CONTEXT = "anchor long, doc_id long, t1 long, start int, hot boolean, words binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["anchor", "doc_id", "t1", "start", "hot", "words"])


_SPAN = "doc_id long, t1 long, `from` int, `to` int, anchor long"


def _spans_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "t1", "from", "to", "anchor"])


def _runs(flags: list[bool]) -> Iterator[tuple[bool, int, int]]:
    """Maximal runs of equal flags: (flag, from, to)."""
    a = 0
    for i in range(1, len(flags) + 1):
        if i == len(flags) or flags[i] != flags[a]:
            yield flags[a], a, i
            a = i


def _stream(length: int, most_states: int):
    """Contexts sorted by anchor and document -> removed spans; an anchor (other columns null) that got too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, doc, sam, full = None, None, SuffixAutomaton(), False
        waiting: list[list[bytes]] = []  # of the present document: what its contexts have that the automaton hasn't
        to_come = 0  # words in waiting
        out: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for key, d, t1, start, words in zip(*(part.column(i).to_pylist() for i in (0, 1, 2, 3, 5))):
                    if key != anchor:
                        anchor, doc, sam, full, waiting, to_come = key, d, SuffixAutomaton(), False, [], 0
                    if full:
                        continue
                    if d != doc:
                        for ws in waiting:
                            sam.add(ws)
                        doc, waiting, to_come = d, [], 0
                    ws = words.split()
                    found = [n >= length for n in sam.matches(ws)[length - 1 :]]
                    for hit, a, b in _runs(found):
                        if hit:
                            out.append((d, t1, start + a, start + b - 1 + length, anchor))
                        else:
                            waiting.append(ws[a : b - 1 + length])
                            to_come += b - 1 + length - a
                    if len(sam.len) + 2 * to_come > most_states:  # a word makes two states at most
                        full, sam, waiting = True, SuffixAutomaton(), []
                        out.append((None, None, None, None, anchor))
                if len(out) >= 5000:
                    yield _spans_batch(out)
                    out = []
        if out:
            yield _spans_batch(out)

    return run


def _windows(length: int):
    """Contexts -> 128-bit hashes of their runs with document and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                cols: list[list[np.ndarray]] = [[], [], [], [], []]
                for d, t1, start, words in zip(*(part.column(i).to_pylist() for i in (1, 2, 3, 5))):
                    h = HASHES.of(words.split())
                    a, b = grams(h, length), grams(mix(h ^ np.uint64(0x5851F42D4C957F2D)), length)
                    for c, v in zip(cols, (a.view(np.int64), b.view(np.int64), np.full(len(a), d), np.full(len(a), t1), start + np.arange(len(a)))):
                        c.append(v)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["w1", "w2", "doc_id", "t1", "start"])

    return run


def _cut():
    """(doc_id, text, spans with t1) -> kept words and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for text, spans in zip(column_bytes(part.column(1)), part.column(2).to_pylist()):
                    ws = text.split()
                    n = len(ws)
                    if spans:
                        t1 = _digest(HASHES.of(ws))[0]
                        kept, upto = [], 0
                        for a, b in sorted((s["from"], s["to"]) for s in spans if s["t1"] == t1):
                            if b > upto:
                                kept += ws[upto : max(upto, a)]
                                upto = b
                        ws = kept + ws[upto:]
                    joined = b" ".join(ws)
                    rows.append((n, n - len(ws), joined, hashlib.sha256(joined).hexdigest()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, length: int = 50, k: int = 10, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = 100_000, most_states: int = 60_000, with_text: bool = True) -> DataFrame:
    """Remove from each text the words covered by a run of ``length`` words that also starts in a document with a smaller id.

    One row per input row: doc_id, n_words, n_removed, kept_text (kept words joined by one space) and kept_sha256.
    Runs are judged on the input.  Null and empty texts have no words.  Texts shorter than a run lose nothing.  Of equal
    texts the least id is the reference and the others go whole.  Rows with the same id don't remove each other's words.
    A null id removes nothing and loses nothing.  Other columns aren't read.  ``with_text=False`` leaves kept_text null.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = materialize(rows.mapInArrow(_describe(length, k), "doc_id long, n_words long, t1 long, t2 long, anchors array<long>"), "anchors").where(F.col("doc_id").isNotNull() & (F.col("n_words") >= length))
    firsts = described.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"))
    copies = described.join(firsts, ["t1", "t2"]).where("doc_id > first").select("doc_id", "t1", F.lit(0).alias("from"), F.col("n_words").cast("int").alias("to")).distinct()
    copies = materialize(copies, "copies")
    unique = described.join(copies.select("doc_id", "t1"), ["doc_id", "t1"], "left_anti")
    each = unique.select("doc_id", F.explode("anchors").alias("anchor"))
    repeated = each.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a < b").select("anchor", (F.col("n") > most_contexts).alias("hot"))
    wanted = each.join(repeated, "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "hot")).alias("anchors"))
    contexts = materialize(rows.join(wanted, "doc_id").mapInArrow(_contexts(length, k), _CONTEXT), "contexts")
    # Copies share their first one's anchors only by id; their own contexts, if any, change nothing: they go whole.
    sharded = contexts.where("not hot").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start")
    streamed = materialize(sharded.mapInArrow(_stream(length, most_states), _SPAN), "spans")
    large = streamed.where("doc_id is null").select("anchor").distinct()
    rest = contexts.where("hot").unionAll(contexts.where("not hot").join(large, "anchor", "left_semi").select(*contexts.columns))
    runs = rest.mapInArrow(_windows(length), "w1 long, w2 long, doc_id long, t1 long, start int")
    least = runs.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("w1", "w2", "first")
    from_runs = runs.join(least, ["w1", "w2"]).where("doc_id > first").select("doc_id", "t1", F.col("start").alias("from"), (F.col("start") + length).alias("to"))
    spans = streamed.where("doc_id is not null").select("doc_id", "t1", "from", "to").unionAll(copies)
    if not rest.isEmpty():
        spans = spans.unionAll(from_runs)
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("t1", "from", "to")).alias("spans"))
    cut = rows.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_cut(), "doc_id long, n_words long, n_removed long, kept binary, kept_sha256 string")
    return cut.select("doc_id", "n_words", "n_removed", (F.col("kept").cast("string") if with_text else F.lit(None).cast("string")).alias("kept_text"), "kept_sha256")
