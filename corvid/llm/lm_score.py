"""Language-model scoring by deleted interpolation.

The model mixes maximum-likelihood estimates of bigrams, of single words and a
uniform one, P(w|v) = l2 c(vw)/c(v) + l1 c(w)/N + l0 1/(V+1).  The weights depend
on how often the context v occurs: one set for each power of two of c(v).  They
are learned by expectation-maximisation on held-out counts: a hash of its id
puts each training text into one of ``FOLDS`` parts, each part in turn is
deleted from the counts, and its tokens are the held-out ones for what remains.
So the weights follow from the texts alone, not from how they lie in files.

Counting.  Texts of one part are packed into blocks.  A block sends the distinct
hashes of its words and word pairs, sorted and coded by differences, to the
ranges of hash values they fall into; a range adds up what all blocks sent and
answers each block with the totals, and with those that remain without its part,
in the order in which it asked.  So each key crosses the network once a block,
however often it occurs, and no key's rows meet in one place in a number beyond
that of the blocks.  There is a row for each block and range, so their number is
(bytes / block_bytes) * (bytes / range_bytes): on machines that hold larger blocks
both are to be raised with the corpus, so that a row has a thousand keys or so.
Words have 64-bit hashes; pairs so many bits that a pair shares its hash with
another by a chance below 2**-22.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm.common import HASHES, column_bytes, materialize, mix

END, START = (np.uint64(xxhash.xxh3_64_intdigest(b)) for b in (b" ", b"  "))  # no word has a space
WORD, PAIR = 0, 1
#: Context-frequency buckets: none, 1, 2-3, 4-7, ...
BUCKETS = 48
#: Parts of the training texts that are deleted in turn.
FOLDS = 4
#: Steps of the held-out histogram for each factor of two, and its reach: ratios to the uniform estimate up to 2**64.
STEPS, REACH = 4, 64


def _pack(a: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes; small numbers leave the upper planes empty."""
    raw = np.ascontiguousarray(a.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel()


def _pack_texts(rows: list[tuple[int | None, bool, bytes]]) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.large_binary())], ["doc_id", "train", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def _blocks(block_bytes: int):
    """(doc_id, train, text, fold) -> packed blocks, each of texts of one fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        rows: list[list[tuple]] = [[] for _ in range(FOLDS)]
        size = [0] * FOLDS

        def packed(fold: int) -> pa.RecordBatch:
            nonlocal n
            cols = [pa.array([n], pa.int64()), pa.array([fold], pa.int32()), pa.array([_pack_texts(rows[fold])], pa.binary()), pa.array([size[fold]], pa.int64())]
            n, rows[fold], size[fold] = n + 1, [], 0
            return pa.RecordBatch.from_arrays(cols, ["block", "fold", "texts", "bytes"])

        for batch in batches:
            for doc, train, text, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), column_bytes(batch.column(2)), batch.column(3).to_pylist()):
                rows[fold].append((doc, train, text))
                size[fold] += len(text) + 16
                if size[fold] >= block_bytes:
                    yield packed(fold)
        for fold in range(FOLDS):
            if rows[fold]:
                yield packed(fold)

    return run


class Block:
    """A block's tokens as places in its sorted distinct words and pairs."""

    def __init__(self, texts: bytes, pair_bits: int):
        table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(texts)).read_all()
        self.ids = table.column(0).combine_chunks()
        hashes = []
        for chunk in table.column(2).chunks:
            for text in chunk.to_pylist():
                h = HASHES.of(text.lower().split())
                hashes.append(np.append(h, END))
        self.sizes = np.array([len(h) for h in hashes])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        token = np.concatenate(hashes)
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.starts] = START
        with np.errstate(over="ignore"):
            pair = mix(mix(before) * np.uint64(0x9E3779B97F4A7C15) + token) >> np.uint64(64 - pair_bits)
        self.words, self.word_of = np.unique(token, return_inverse=True)
        self.pairs, self.pair_of = np.unique(pair, return_inverse=True)
        self.word_of, self.pair_of = self.word_of.astype(np.int32), self.pair_of.astype(np.int32)
        # a text's first token follows its start, which occurs as often as its end
        self.context_of = np.empty_like(self.word_of)
        self.context_of[1:] = self.word_of[:-1]
        self.context_of[self.starts] = np.searchsorted(self.words, END)
        self.training = np.repeat(np.array(table.column(1).to_pylist(), dtype=bool), self.sizes)
        self.own = [np.bincount(of[self.training], minlength=len(keys)) for of, keys in ((self.word_of, self.words), (self.pair_of, self.pairs))]

    def keys(self, kind: int) -> np.ndarray:
        return self.words if kind == WORD else self.pairs


def _cuts(keys: np.ndarray, width: int, part_bits: int) -> np.ndarray:
    """Where the sorted keys change their range: part_bits upper bits of width."""
    edges = np.arange(1, 2**part_bits, dtype=np.uint64) << np.uint64(width - part_bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


_REQUEST = "part int, kind int, block long, fold int, `keys` binary, `counts` binary"


def _requests(pair_bits: int, part_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, fold, texts = (batch.column(c)[i].as_py() for c in range(3))
                b = Block(texts, pair_bits)
                rows = []
                for kind, width in ((WORD, 64), (PAIR, pair_bits)):
                    keys, own, cuts = b.keys(kind), b.own[kind], _cuts(b.keys(kind), width, part_bits)
                    for part in np.nonzero(np.diff(cuts))[0].tolist():
                        at = slice(cuts[part], cuts[part + 1])
                        rows.append((part, kind, block, fold, _pack(np.diff(keys[at], prepend=np.uint64(0))), _pack(own[at])))
                cols = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["part", "kind", "block", "fold", "keys", "counts"])

    return run


_REPLY = T.StructType([T.StructField("block", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("counts", T.BinaryType()), T.StructField("rest", T.BinaryType()), T.StructField("fold", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("v", T.LongType())])


def _answer(table: pa.Table) -> pa.Table:
    """For every block that asked the totals of one range of keys, and those without its fold; and, with block null, the tokens of each fold in the range, and its distinct keys."""
    keys = [np.cumsum(_unpack(k), dtype=np.uint64) for k in table.column("keys").to_pylist()]
    ends = np.cumsum([len(k) for k in keys])
    all_keys, of = np.unique(np.concatenate(keys), return_inverse=True)
    of = of.astype(np.int32 if len(all_keys) < 2**31 else np.int64)
    folds, blocks = table.column("fold").to_pylist(), table.column("block").to_pylist()
    by_fold = np.zeros((FOLDS, len(all_keys)), dtype=np.int64)
    for fold, counts, k, b in zip(folds, table.column("counts").to_pylist(), keys, ends):
        by_fold[fold, of[b - len(k) : b]] += _unpack(counts).astype(np.int64)  # a block's keys are distinct
    total = by_fold.sum(axis=0)
    part, kind = table.column("part")[0].as_py(), table.column("kind")[0].as_py()
    n = len(keys)
    asked = [of[b - len(k) : b] for k, b in zip(keys, ends)]
    no = [None] * FOLDS
    return pa.table(
        {
            "block": pa.array(blocks + no, pa.int64()),
            "part": pa.array([part] * (n + FOLDS), pa.int32()),
            "kind": pa.array([kind] * (n + FOLDS), pa.int32()),
            "counts": pa.array([_pack(total[at]) for at in asked] + no, pa.binary()),
            "rest": pa.array([_pack(total[at] - by_fold[fold, at]) for fold, at in zip(folds, asked)] + no, pa.binary()),
            "fold": pa.array([None] * n + list(range(FOLDS)), pa.int32()),
            "n": pa.array([None] * n + by_fold.sum(axis=1).tolist(), pa.int64()),
            "v": pa.array([None] * n + [int((total > 0).sum())] + [0] * (FOLDS - 1), pa.int64()),
        }
    )


def _totals(replies: list[dict]) -> list[np.ndarray]:
    """A block's totals of its words and of its pairs, in the order of its sorted keys."""
    out = []
    for kind in (WORD, PAIR):
        parts = sorted((r["part"], r["counts"]) for r in replies if r["kind"] == kind)
        out.append(np.concatenate([_unpack(c) for _, c in parts]).astype(np.int64))
    return out


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for contexts that don't occur, else one more than the whole part of the count's binary logarithm."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def _steps(ratio: np.ndarray) -> np.ndarray:
    """A ratio to the uniform estimate as a step, 0 for none."""
    with np.errstate(divide="ignore"):
        s = np.floor(STEPS * (np.log2(ratio) + REACH / 2)) + 1
    return np.where(ratio > 0, np.clip(s, 1, STEPS * REACH), 0).astype(np.int64)


def _step_ratio(step: np.ndarray) -> np.ndarray:
    return np.where(step > 0, 2.0 ** ((step - 0.5) / STEPS - REACH / 2), 0.0)


def _held_out(pair_bits: int, rest_of: list[int], v: int):
    """Blocks with the totals that remain without their fold -> a histogram of their training tokens under these counts.

    ``rest_of``: of each fold the number of training tokens outside it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one block at a time in memory
                fold, texts, replies = (batch.column(c)[i].as_py() for c in range(3))
                b, rest = Block(texts, pair_bits), rest_of[fold]
                words, pairs = _totals(replies)
                t = b.training
                context = words[b.context_of[t]]
                p2 = pairs[b.pair_of[t]] / np.maximum(context, 1)
                p1 = words[b.word_of[t]] / max(rest, 1)
                cell = (bucket(context) * (STEPS * REACH + 1) + _steps(p2 * (v + 1))) * (STEPS * REACH + 1) + _steps(p1 * (v + 1))
                cells, counts = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(counts, pa.int64())], ["cell", "n"])

    return run


def learn_weights(cells: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """(BUCKETS, 3) weights of pair, word and uniform estimate by expectation-maximisation over the held-out histogram."""
    side = STEPS * REACH + 1
    of, p2, p1 = cells // (side * side), _step_ratio(cells // side % side), _step_ratio(cells % side)
    p = np.stack([p2, p1, np.ones(len(cells))], axis=1)  # all in units of the uniform estimate
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5  # no pair estimate without a context
    prior = weights.copy()
    for _ in range(rounds):
        share = weights[of] * p
        share *= (counts / share.sum(axis=1))[:, None]
        got = prior + np.stack([np.bincount(of, weights=share[:, k], minlength=BUCKETS) for k in range(3)], axis=1)
        weights = got / got.sum(axis=1, keepdims=True)
    return weights


_SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def _scores(pair_bits: int, n: int, v: int, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one block at a time in memory
                texts, replies = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                b = Block(texts, pair_bits)
                words, pairs = _totals(replies)
                count, context = words[b.word_of], words[b.context_of]
                of = bucket(context)
                p = weights[of, 0] * pairs[b.pair_of] / np.maximum(context, 1) + weights[of, 1] * count / max(n, 1) + weights[of, 2] / (v + 1)
                per_text = lambda x: np.add.reduceat(x, b.starts)
                cols = [b.ids, pa.array(~b.training[b.starts]), pa.array(b.sizes, pa.int64()), pa.array(per_text((count > 0).astype(np.int64))), pa.array(per_text(np.log10((count + 1) / (n + v + 1)))), pa.array(per_text(np.log10(p)))]
                yield pa.RecordBatch.from_arrays(cols, _SCORED.names)

    return run


def held_out_ids(id_col: str, parts: int = 7, part: int = 2) -> Column:
    """Whether a text is held out: by the CRC-32 of its id as text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20, range_bytes: int = 8 << 20) -> DataFrame:
    """Score all texts by a bigram model learned from those that aren't held out.

    One row per input row: doc_id, held_out, n_tokens, n_known (tokens that occur in training), train_tokens, base_score
    (add-one word model) and score (deleted interpolation), both log10 probabilities of the text with its end.  Words are
    lower-cased in A-Z; every text has an end token.  Null counts as the empty text.  Repeated rows are all counted and
    scored.  Without training texts all probability is uniform over one unknown token.  Texts with a null id are in one
    part.  Other columns aren't read.

    The driver gets the totals of the parts and a histogram whose size is bounded by its grid, not by the corpus.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (~held_out).alias("train"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))
    packed = materialize(rows.mapInArrow(_blocks(block_bytes), "block long, fold int, texts binary, bytes long"), "blocks")
    tokens = packed.agg(F.sum("bytes")).first()[0]  # a token takes a byte at least
    if not tokens:
        return spark.createDataFrame([], _SCORED).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(0).cast("long").alias("train_tokens"), "base_score", "score")
    pair_bits = min(64, max(32, math.ceil(math.log2(tokens)) + 22))
    part_bits = min(24, max(3, math.ceil(math.log2(tokens / range_bytes))))
    asked = packed.select("block", "fold", "texts").mapInArrow(_requests(pair_bits, part_bits), _REQUEST)
    replies = materialize(asked.groupBy("part", "kind").applyInArrow(_answer, _REPLY), "replies")
    sums = replies.where(F.col("block").isNull() & (F.col("kind") == WORD)).groupBy("fold").agg(F.sum("n"), F.sum("v")).collect()
    own, v = {r[0]: r[1] for r in sums}, sum(r[2] for r in sums)
    n = sum(own.values())
    known = lambda what: packed.join(replies.where(F.col("block").isNotNull()).groupBy("block").agg(F.collect_list(F.struct("part", "kind", F.col(what).alias("counts"))).alias("replies")), "block")
    found = known("rest").select("fold", "texts", "replies").mapInArrow(_held_out(pair_bits, [n - own.get(f, 0) for f in range(FOLDS)], v), "cell long, n long")
    cells = materialize(found.groupBy("cell").agg(F.sum("n").alias("n")), "cells").collect()
    weights = learn_weights(np.array([r[0] for r in cells], dtype=np.int64), np.array([r[1] for r in cells], dtype=np.float64))
    out = known("counts").select("block", "texts", "replies").mapInArrow(_scores(pair_bits, n, v, weights), _SCORED)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
