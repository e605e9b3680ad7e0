"""The training-data operators against brute force, on texts with all the odd cases, and on empty tables."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from corvid.llm import common, decontaminate, graph, license_scan, line_dedup, lm_score, main_text, near_dup, piece_codec, quality, substring_dedup, warc
from corvid.llm.queries import piece_model_path

SPACES = re.compile(rb"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in SPACES.split((t or "").encode()) if w]


def lower(ws):
    return [w.lower() for w in ws]  # bytes: A-Z only


def sha(b):
    return hashlib.sha256(b).hexdigest()


# ---- 1 -----------------------------------------------------------------------------------------------------------


def test_lm_score(docs, texts, monkeypatch):
    seen = {}
    learn = lm_score.learn_weights
    monkeypatch.setattr(lm_score, "learn_weights", lambda *a: seen.setdefault("w", learn(*a)))
    got = {r.doc_id: r for r in lm_score.score(docs, lm_score.held_out_ids("doc_id")).collect()}
    tokens = {i: [*lower(words(t)), b" "] for i, t in texts}
    train = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2}
    one, two = collections.Counter(), collections.Counter()
    for i in train:
        one.update(tokens[i])
        two.update(zip([None, *tokens[i]], tokens[i]))
    n, v = sum(one.values()), len(one)
    one[None] = one[b" "]
    assert set(got) == set(tokens)
    for i, ws in tokens.items():
        r, s = got[i], 0.0
        for a, b in zip([None, *ws], ws):
            w = seen["w"][min(one[a].bit_length(), lm_score.BUCKETS - 1)]
            s += math.log10(w[0] * two[a, b] / max(one[a], 1) + w[1] * one[b] / n + w[2] / (v + 1))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(ws), sum(one[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((one[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score == pytest.approx(s)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def exact_weights(tokens, fold_of, rounds=60):
    """EM on exact held-out ratios: each fold's tokens under the counts of the others."""
    import numpy as np

    rows = []
    for f in set(fold_of.values()):
        one, two = collections.Counter(), collections.Counter()
        for i, ws in tokens.items():
            if fold_of[i] != f:
                one.update(ws)
                two.update(zip([None, *ws], ws))
        n = sum(one.values())
        one[None] = one[b" "]
        for i, ws in tokens.items():
            if fold_of[i] == f:
                rows += [(min(one[a].bit_length(), lm_score.BUCKETS - 1), two[a, b] / max(one[a], 1), one[b] / max(n, 1)) for a, b in zip([None, *ws], ws)]
    v = len({w for ws in tokens.values() for w in ws})
    of = np.array([r[0] for r in rows])
    p = np.array([(r[1] * (v + 1), r[2] * (v + 1), 1.0) for r in rows])
    prior = np.full((lm_score.BUCKETS, 3), 1 / 3)
    prior[0] = 0, 0.5, 0.5
    w = prior.copy()
    for _ in range(rounds):
        share = w[of] * p
        share /= share.sum(axis=1, keepdims=True)
        got = prior + np.stack([np.bincount(of, weights=share[:, k], minlength=lm_score.BUCKETS) for k in range(3)], axis=1)
        w = got / got.sum(axis=1, keepdims=True)
    return w, np.bincount(of, minlength=lm_score.BUCKETS)


def test_weights_follow_from_the_texts_alone(docs, texts, monkeypatch):
    import numpy as np

    seen, learn = [], lm_score.learn_weights
    monkeypatch.setattr(lm_score, "learn_weights", lambda *a: seen.append(learn(*a)) or seen[-1])
    held = lm_score.held_out_ids("doc_id")
    runs = [{r.doc_id: r.score for r in lm_score.score(docs.repartition(n), held, block_bytes=b, range_bytes=b).collect()} for n, b in ((1, 1 << 22), (5, 3000))]
    assert all(runs[0][i] == pytest.approx(runs[1][i]) for i in runs[0]) and np.allclose(seen[0], seen[1])
    fold = {r.doc_id: r.f for r in docs.where(~held).select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(lm_score.FOLDS)).alias("f")).collect()}
    exact, mass = exact_weights({i: [*lower(words(t)), b" "] for i, t in texts if i in fold}, fold)
    assert np.abs(exact - seen[0])[mass >= 500].max() < 0.05  # ratios are counted in steps of a quarter of a factor of two


def test_null_ids_are_scored_and_cut_like_others(spark):
    line = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(None, line), (None, line), (3, line), (4, None)], "doc_id long, text string")
    assert lm_score.score(df, lm_score.held_out_ids("doc_id")).count() == 4
    assert sorted((r.doc_id is None, r.n_removed) for r in line_dedup.summary(df).collect()) == [(False, 0), (False, 1), (True, 0), (True, 0)]
    assert sorted((r.doc_id is None, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()) == [(False, 0), (False, 0), (True, 0), (True, 0)]


def test_learned_weights_fit_the_held_out_histogram():
    side = lm_score.STEPS * lm_score.REACH + 1
    at = lambda x: int(lm_score._steps(__import__("numpy").array([x]))[0])
    import numpy as np

    cells = np.array([(5 * side + at(2**12)) * side + at(4.0), (5 * side + 0) * side + at(4.0), (0 * side + 0) * side + at(8.0)])
    w = lm_score.learn_weights(cells, np.array([90.0, 10.0, 50.0]) * 1000)
    assert w[5, 0] > 0.8 and w[0, 0] == 0 and w[0, 1] > 0.9 and np.allclose(w.sum(axis=1), 1)


# ---- 2 -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontaminate(spark, docs, texts, block_bytes):
    rng = random.Random(2)
    items = [(1, None), (2, ""), (3, "-- !"), (4, "Upper CASE àé"), (5, "wow, wow"), (11, "wow " * 12)]
    for k in range(20, 50):
        src = rng.choice([t for _, t in texts if t and len(t.split()) > 12]).split()
        a = rng.randrange(len(src) - 5)
        items.append((k, " ".join(src[a : a + rng.randrange(3, 40)]).upper() + "!"))
    items += [(60, items[-1][1]), (61, "not in any text at all I think")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontaminate.digest(decontaminate.shared_spans(docs, bench, block_bytes=block_bytes, keep_text=False)).collect()}
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    low = lambda s: (s or "").translate({i: i + 32 for i in range(65, 91)})
    wins = collections.defaultdict(set)
    for i, t in items:
        ws = find(low(t))
        k = min(10, len(ws))
        for a in range(len(ws) - k + 1 if ws else 0):
            wins[tuple(ws[a : a + k])].add(str(i))
    want = set()
    for i, t in texts:
        ws, hit, found = find(low(t)), set(), set()
        for k in {len(x) for x in wins}:
            for a in range(len(ws) - k + 1):
                if names := wins.get(tuple(ws[a : a + k])):
                    hit.update(range(a, a + k))
                    found |= names
        want.add((i, len(ws), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)))
    assert got == want
    assert any(w[5] for w in want)


# ---- 3 -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("at_once", [16, 1])
def test_line_dedup(docs, texts, monkeypatch, at_once):
    monkeypatch.setattr(line_dedup, "AT_ONCE", at_once)
    lines = sorted((i, k, x) for i, t in texts for k, x in enumerate((t or "").split("\n")) if words(x))
    gone, sets = collections.defaultdict(list), []
    by_token = collections.defaultdict(list)
    for i, k, x in lines:
        ws = words(x)
        s = set(ws)
        shared = collections.Counter(j for t in s for j in by_token[t])
        if any(100 * n >= 80 * (len(s) + len(sets[j]) - n) for j, n in shared.items()):
            gone[i].append(k)
        for t in s:
            by_token[t].append(len(sets))
        sets.append(s)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.removed) for r in line_dedup.summary(docs).collect()}
    per = collections.Counter(i for i, _, _ in lines)
    assert got == {i: (per[i], len(gone[i]), sorted(gone[i])) for i, _ in texts}
    assert sum(map(len, gone.values())) > 50
    if at_once == 16:
        kept = {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()}
        for i, t in texts:
            assert kept[i] == (t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]))


def test_line_dedup_ends_its_turns_when_little_remains(spark, monkeypatch):
    """Lines that each resemble the two before only, and later copies of some with white space of all kinds."""
    lines = [" ".join(f"w{j}" for j in range(k, k + 20)) for k in range(90)]
    rows = list(enumerate([*lines, *(f" {x}\t\x0bw{k}  ".replace(f" w{k * 7 + 9} ", f"  w{k * 7 + 9}\r ") for k, x in enumerate(lines[::7]))]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    verified, turns = line_dedup._verified, []
    monkeypatch.setattr(line_dedup, "AT_ONCE", 1)
    monkeypatch.setattr(line_dedup, "_verified", lambda *a: turns.append(1) or verified(*a))
    took = []
    for rest in (1000, 0):
        monkeypatch.setattr(line_dedup, "REST", rest, raising=False)
        turns.clear()
        assert {r.doc_id for r in line_dedup.removed_lines(df, cells=1 << 10).collect()} == set(range(1, len(rows)))
        took.append(len(turns))
    assert took[0] == 2 < took[1]


def test_line_dedup_hashes_words_once_and_compares_lines_with_and_without_wide_bitmaps(spark, monkeypatch):
    """Lines of about as many words as the bitmaps of 128 bits begin with, each with copies that are longer, shorter or changed."""
    rng, vocab = random.Random(5), [f"v{k}" for k in range(900)]
    lines = []
    for n in range(line_dedup.WIDE - 14, line_dedup.WIDE + 15):
        x = rng.sample(vocab, n)
        drop, swap = rng.randrange(1, 26), rng.randrange(1, 14)
        lines += [x, x[drop:], [*x, *(f"more{k}" for k in range(rng.randrange(1, 28)))], [*x[swap:], *(f"new{k}" for k in range(swap))]]
    sets = [set(x) for x in lines]
    gone = {i for i, s in enumerate(sets) if any(100 * len(s & t) >= 80 * len(s | t) for t in sets[:i])}
    narrow = [len(s) <= line_dedup.WIDE for s in sets]
    across = [(i, j) for i, s in enumerate(sets) for j, t in enumerate(sets[:i]) if narrow[i] != narrow[j] and 100 * len(s & t) >= 80 * len(s | t)]
    assert across and 0 < len(gone) < 3 * len(lines) // 4

    written, write = {}, line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name, *a, **k: written.setdefault(name, df.schema) and None or write(df, name, *a, **k))
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.removed_lines(df, cells=1 << 10).collect()} == gone
    assert "string" not in written["lines"].simpleString() and "heads" not in written  # words are hashed once, first tokens go straight into the join


@pytest.mark.parametrize("percent", [20, 35, 50, 80, 100])
def test_line_dedup_joins_first_tokens_by_classes_of_sizes(spark, percent):
    """Lines of sizes around the classes' edges, with longer and shorter copies, find each other; far apart sizes never meet."""
    rng, vocab = random.Random(percent), [f"u{k}" for k in range(400)]
    lines = []
    for n in (1, 2, 3, 4, 5, 7, 8, 9, 13, 15, 16, 17, 26, 31, 32, 33, 52, 63, 64, 65, 80, 127, 128, 129):
        ws = rng.sample(vocab, n)
        lines += [" ".join(ws), " ".join(ws[: -(-n * percent // 100)]), " ".join(rng.sample(ws, max(1, n * 9 // 10)) + rng.sample(vocab, n // 10))]
        lines.append(" ".join(ws + [f"x{n}_{k}" for k in range(n * (100 - percent) // max(percent, 1))]))
    rng.shuffle(lines)
    sets = [set(x.split()) for x in lines]
    want = {j for j, b in enumerate(sets) if any(len(a & b) * 100 >= percent * len(a | b) for a in sets[:j])}
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.removed_lines(rows, percent=percent, cells=64).collect()} == want
    if percent == 80:
        classes = rows.select(F.col("doc_id").alias("c"), line_dedup._tokens("text").alias("tokens"))
        keys = collections.defaultdict(list)
        for r in line_dedup._prefixes(line_dedup._heads(classes, line_dedup._constant([0] * 64), 64, percent)).collect():
            keys[r.token].append(r["at"] >> 32)
        assert all(max(x) <= 2.5 * min(x) for x in keys.values()) and max(map(len, keys.values())) > 3


def test_line_dedup_compares_rows_of_longs_and_reads_lines_that_begin_oddly(spark, monkeypatch):
    """First tokens are five longs, none of them null; lines begin and are split with all sorts of characters, and rows repeat."""
    starts = ["", " ", "\t", "\x0b\x0c", "\r ", "\x00", "\x1f ", "\x85", "\xa0", "\u2028", "é ", "\x7f"]
    gaps = [" ", "  ", "\t", "\x0b", "\x0c ", "\r", "\x1c"]
    lines = [x for s in starts for g in gaps for x in (s, s + g, s + g.join(f"w{len(s)}{k}" for k in range(6)) + g)]
    rows = list(enumerate("\n".join(lines[k : k + 5]) for k in range(0, len(lines), 5)))
    gone, seen, per = collections.defaultdict(list), [], collections.Counter()
    for i, t in rows:
        for k, x in enumerate(t.split("\n")):
            if s := set(re.findall(r"[^\x20\x09-\x0D]+", x)):
                per[i] += 1
                if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                    gone[i].append(k)
                seen.append(s)
    written, write = {}, line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name, *a, **k: written.setdefault(name, df.schema) and None or write(df, name, *a, **k))
    df = spark.createDataFrame([*rows, *rows[::3]], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.removed) for r in line_dedup.summary(df, cells=1 << 10).collect())
    assert got == sorted((i, per[i], len(gone[i]), gone[i]) for i, _ in [*rows, *rows[::3]]) and gone
    assert line_dedup.removed_lines(df, cells=1 << 10).count() == sum(map(len, gone.values()))
    assert [(f.dataType.simpleString(), f.nullable) for f in written["active"]] == [("bigint", False)] * 5


# ---- 4 -----------------------------------------------------------------------------------------------------------


def test_line_dedup_keeps_its_counters_out_of_the_text_of_plans(spark):
    """Spark prints a plan for its listeners after each stage: the driver ran out of memory by texts of megabytes."""
    sets = [[random.Random(i).randrange(-(1 << 63), 1 << 63) for _ in range(i % 9)] for i in range(300)]
    classes = common.materialize(spark.createDataFrame(list(enumerate(sets)), "c long, tokens array<long>"), "lines")
    cells = 1 << 12
    count = collections.Counter(t % cells for s in sets for t in s)
    levels = line_dedup._frequencies(classes, cells)
    found = spark.range(1).select(levels.alias("levels")).first()[0]
    assert found == [round(8 * math.log2(count[i] + 1)) - line_dedup.LEAST for i in range(cells)]
    heads = line_dedup._heads(classes, levels, cells, 80)
    assert len(heads._jdf.queryExecution().toString()) < 40_000
    ends = [-128, 127] * 300
    assert spark.range(1).select(line_dedup._packed(spark, ends)).first()[0] == ends
    plain = line_dedup._heads(classes, line_dedup._constant(found), cells, 80)
    assert sorted(map(str, heads.collect())) == sorted(map(str, plain.collect()))


def test_piece_codec_is_the_library(docs, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    got = {r.doc_id: r for r in piece_codec.encode_decode(docs, piece_model_path()).collect()}
    for i, t in texts:
        ids = lib.encode(t or "")
        back, joined = lib.decode(ids), ",".join(map(str, ids))
        r = got[i]
        assert (r.n_tokens, r.ids, r.decoded, r.ids_sha256, r.decoded_sha256) == (len(ids), joined, back, sha(joined.encode()), sha(back.encode()))


def test_pieces_of_random_text():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    codec = piece_codec.codec(open(piece_model_path(), "rb").read())
    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choice("aabethinonr  \n\t▁éß😀<>0x1́") for _ in range(rng.randrange(40)))
        assert codec.encode(t) == lib.encode(t) and codec.decode(codec.encode(t)) == lib.decode(lib.encode(t)), t
    for _ in range(1000):
        ids = [rng.randrange(3, 32000) if rng.random() < 0.6 else rng.randrange(3, 259) for _ in range(rng.randrange(9))]
        assert codec.decode(ids) == lib.decode(ids), ids


def test_both_ways_with_segments_that_decode_to_something_else():
    raw = open(piece_model_path(), "rb").read()
    codec, rng = piece_codec.PieceCodec(raw, remembered=50), random.Random(5)
    codec.byte_fallback = False  # characters outside the vocabulary become unknown pieces
    for _ in range(2000):
        t = "".join(rng.choice("aabethin \n▁é😀𒍅") for _ in range(rng.randrange(30)))
        parts = [codec.segment_ids(s) for s in codec.prepared(t)]
        ids, back = [k for p in parts for k in p], "".join(map(codec.surface, parts))
        assert codec.both_ways(t) == (",".join(map(str, ids)).encode(), len(ids), back[1:]), t
    assert {type(x) for x in codec.memory.values()} == {bytes, tuple}


def test_remembered_segments_are_small():
    codec = piece_codec.PieceCodec(open(piece_model_path(), "rb").read())
    for k in range(200):
        codec.both_ways(f"word{k} and{k % 7}")
    assert codec.memory and all(type(x) is bytes for x in codec.memory.values())  # neither a tuple nor the text once more


def test_idle_worker_forgets(spark, docs):
    codec = piece_codec.PieceCodec(open(piece_model_path(), "rb").read())
    with codec.in_use(idle=0.2):
        codec.both_ways("some words zqxjkvb")
    with codec.in_use(idle=60):
        time.sleep(0.6)
        assert codec.memory and codec.compatible  # the next task has begun meanwhile
    with codec.in_use(idle=0.2):
        pass
    time.sleep(0.6)
    assert not codec.memory and not codec.memory.old and not codec.compatible

    def held(batches):
        import pyarrow as pa

        from corvid.llm import piece_codec

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(c.memory) + len(c.memory.old) for c in piece_codec._CODECS.values()], pa.int64())], ["n"])

    piece_codec.encode_decode(docs, piece_model_path()).collect()
    look = spark.range(0, 400, 1, 4).mapInArrow(held, "n long")
    assert any(r.n for r in look.collect())
    time.sleep(piece_codec.IDLE + 2)
    assert {r.n for r in look.collect()} == {0}


def test_idle_word_hashes_go():
    memory = common.WordHashes(idle=0.3)
    first = memory.of([b"some", b"words"]).tolist()
    time.sleep(0.15)
    memory.of([b"more"])
    time.sleep(0.2)
    assert len(memory) == 3  # used meanwhile
    time.sleep(0.6)
    assert not memory
    assert memory.of([b"some", b"words"]).tolist() == first and len(memory) == 2
    time.sleep(0.8)
    assert not memory


def test_scratch_tables_find_their_folders_made(spark, monkeypatch):
    """The driver starts no process for the folders of a table, as they are there when it is written."""
    found, write = [], DataFrameWriter.parquet

    def parquet(self, path, *a, **b):
        found.append(os.path.isdir(f"{common._plain(path)}/_temporary/0/_temporary"))
        return write(self, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    df = common.materialize(spark.range(0, 1000, 1, 4), "made")
    assert found == [True] and df.count() == 1000
    assert len(os.listdir(common._plain(df.inputFiles()[0].rsplit("/", 1)[0]))) == 4


def test_discarding_scratch_tables_collects_the_drivers_garbage(spark):
    beans = lambda: sum(b.getCollectionCount() for b in spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    df = common.materialize(spark.range(10), "gone")
    before = beans()
    common.discard(df)
    assert beans() > before and not os.path.exists(common._plain(df.inputFiles()[0].rsplit("/", 1)[0]))


def test_scratch_tables_keep_arrays_written_flat(spark):
    rows = [(1, [5, -7]), (2, []), (3, [1 << 62])]
    df = spark.createDataFrame(rows, StructType([StructField("a", LongType()), StructField("x", ArrayType(LongType(), False), False)]))
    out = common.materialize(df, "flat", "zstd", dictionary=False, level=1, flat=True)
    assert sorted(map(tuple, out.collect())) == rows and spark.conf.get("spark.sql.parquet.writeLegacyFormat") == "false"
    assert "list" not in str(pq.ParquetFile(next(f for f in map(common._plain, out.inputFiles()) if pq.ParquetFile(f).metadata.num_rows)).schema).lower().replace("(list)", "")


def test_scratch_tables_have_no_files_beside_their_rows(spark):
    df = common.materialize(spark.range(0, 1000, 1, 4), "few")
    folder = common._plain(df.inputFiles()[0].rsplit("/", 1)[0])
    assert len(os.listdir(folder)) == 4 and all(f.startswith("part-") for f in os.listdir(folder))
    assert sorted(r.id for r in df.collect()) == list(range(1000))
    common.discard(df)
    assert not os.path.exists(folder)


# ---- 5 -----------------------------------------------------------------------------------------------------------


def linked(texts, k, percent):
    sets = {}
    for i, t in texts:
        ws = lower(words(t))
        n = min(k, len(ws))
        sets[i] = {tuple(ws[a : a + n]) for a in range(len(ws) - n + 1)} if n else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent", "most"), [(3, 85, 4000), (5, 80, 4000), (3, 85, 1)])
def test_near_duplicates(docs, texts, k, percent, most):
    want = linked(texts, k, percent)
    assert {tuple(r) for r in near_dup.near_duplicates(docs, k, percent, most_members=most).collect()} == want
    assert sum(not w[3] for w in want) > 20


def test_near_duplicates_leaves_null_ids_alone(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert sorted(map(tuple, near_dup.near_duplicates(df, 3, 85).collect()), key=str) == [(1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True), (None, 2, None, True)]


def test_tables_miss_less_than_promised():
    for s in (0.8, 0.85):
        t = near_dup.Tables(s)
        assert 2 * (1 - s**t.t) ** t.m <= 1e-4 < 2 * (1 - s**t.t) ** (t.m - 1)


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


# ---- 6 -----------------------------------------------------------------------------------------------------------


def test_license_scan(spark, docs, texts):
    by_hand = [(1000, "Some text. licensed under the APACHE license, version 2.0 - and on"), (1001, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and the associated documentation files, to deal in the Software without restriction")]
    df = docs.select("doc_id", "text").unionAll(spark.createDataFrame(by_hand, "doc_id long, text string"))
    got = {r.doc_id: list(r.licenses) for r in license_scan.scan(df, license_scan.notices(spark)).collect()}
    for i, t in texts:
        assert got[i] == (["Apache-2.0"] if t and "Licensed under the Apache License, Version 2.0" in t else []), t
    assert got[1000] == ["Apache-2.0"] and len(got) == len(texts) + 2
    assert [r.n_licenses for r in license_scan.scan(df.limit(3), license_scan.notices(spark).limit(0)).collect()] == [0, 0, 0]


def test_license_scan_of_many_templates_finds_the_same(spark, docs, monkeypatch):
    df = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(1000 + i, " ".join(["pre"] * i + [t])) for i, (_, t) in enumerate(license_scan.templates())], "doc_id long, text string"))
    few = sorted(map(tuple, license_scan.scan(df, license_scan.notices(spark)).select("doc_id", "licenses").collect()))
    monkeypatch.setattr(license_scan, "BROADCAST_SHINGLES", 0)
    assert few == sorted(map(tuple, license_scan.scan(df, license_scan.notices(spark)).select("doc_id", "licenses").collect()))
    assert all(name in r[1] for r, (name, _) in zip(few[-len(license_scan.templates()) :], license_scan.templates()))


def test_a_template_spread_over_half_a_window_more_is_found(spark):
    own = [f"w{i}" for i in range(33)]  # 29 shingles of class 4
    spread = [*own[:16], *[f"x{i}" for i in range(14)], *own[16:]]
    template = spark.createDataFrame([("T", " ".join(own))], "license string, text string")
    rows = [(i, " ".join(["pre"] * i + spread + ["post"] * 70)) for i in range(70)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), template, contained=0.8)
    assert all(list(r.licenses) == ["T"] for r in got.collect())


def test_license_scan_verifies_containment(spark):
    words_ = [f"w{i}" for i in range(40)]
    template = spark.createDataFrame([("T", " ".join(words_)), ("T", None), ("E", "")], "license string, text string")
    broken = [*words_[:20], "x", *words_[20:]]  # 4 of 36 shingles go
    half = [*words_[:20], *[f"y{i}" for i in range(20)]]
    df = spark.createDataFrame([(1, " ".join(["pre"] * 30 + broken + ["post"] * 30)), (2, " ".join(half))], "doc_id long, text string")
    got = {r.doc_id: [(m.license, m.shared, m.wanted) for m in r.matches] for r in license_scan.scan(df, template).collect()}
    assert got == {1: [("T", 32, 36)], 2: []}


# ---- 7 -----------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    page = "<html><head><title>A &amp; B</title><script>var x='<p>';</script></head><body><p>One <b>t</b>wo</p><a href='/x?a=1&amp;b=2'>l</a></body></html>"
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", page), (2, None, None), (3, "http://b", "")], "page_id long, url string, html string")
    made = warc.derivatives(warc.responses(pages))
    rows = {r.key: r for r in made.collect()}
    assert len(rows) == 3 and rows[1].title == "A & B" and rows[1].n_links == 1 and rows[1].payload_ok
    (meta,), (conv,) = (list(warc.read_records(rows[1][c].encode())) for c in ("metadata", "conversion"))
    assert conv.block.decode() == "One two\nl"
    for r in (meta, conv):
        assert r.get("WARC-Refers-To") == rows[1].source_id and r.get("WARC-Block-Digest") == warc.sha1_base32(r.block)
        assert r.get("WARC-Payload-Digest") == warc.sha1_base32(page.encode()) == rows[1].payload_digest
    assert meta.get("WARC-Concurrent-To") == conv.get("WARC-Record-ID") and b'"/x?a=1&b=2"' in meta.block
    warc.save(made, str(tmp_path / "wet"), "conversion")
    found = [r for f in (tmp_path / "wet").glob("*.gz") for r in warc.read_records(f.read_bytes())]
    assert sorted(r.get("WARC-Record-ID") for r in found) == sorted(r.conversion_id for r in rows.values())


def test_warc_undoes_codings_and_keeps_repeated_headers(spark):
    import gzip
    import json

    page = "<p>caf\u00e9 au lait</p>".encode("latin-1")
    packed = gzip.compress(page)
    body = b"%x\r\n%s\r\n%x;x=y\r\n%s\r\n0\r\n\r\n" % (10, packed[:10], len(packed) - 10, packed[10:])
    block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nContent-Type: text/html; charset=ISO-8859-1\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + body
    record = warc.Record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Target-URI", "http://a/"), ("WARC-Concurrent-To", "<urn:y>"), ("WARC-Concurrent-To", "<urn:z>")], block).to_bytes()
    df = spark.createDataFrame([(1, record, "t", "m"), (1, record, "t", "m")], "key long, record binary, title string, metadata string")
    rows = warc.derivatives(df).collect()
    assert len(rows) == 2 and rows[0] == rows[1]
    (meta,), (conv,) = (list(warc.read_records(rows[0][c].encode())) for c in ("metadata", "conversion"))
    assert conv.block.decode() == "caf\u00e9 au lait" and conv.get("WARC-Payload-Digest") == warc.sha1_base32(body)
    account = json.loads(meta.block)["Envelope"]
    assert account["WARC-Header-Metadata"]["WARC-Concurrent-To"] == ["<urn:y>", "<urn:z>"]
    assert account["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"]["Set-Cookie"] == ["a=1", "b=2"]


@pytest.mark.parametrize(("http", "body", "want"), [("", "\ufeffé".encode(), "é"), ("", b"<meta charset='cp1252'>\x80", "<meta charset='cp1252'>€"), ("text/html; charset=none-such", "é".encode(), "é"), ("", "é".encode("utf-16"), "é"), ("", b"\xff", "\ufffd")])
def test_charsets(http, body, want):
    assert warc.decoded([("Content-Type", http)], body) == want


def test_conversions_are_the_words_that_pages_show(spark, sf_dir):
    from html import unescape

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.key: r for r in warc.derivatives(warc.responses(pages)).collect()}
    for r in pages.collect():
        shown = re.sub(r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1>", "", r.html or "")
        shown = re.sub(r"</?(?:b|a|i|em|strong|span)\b[^>]*>", "", shown)
        want = unescape(re.sub(r"<[^>]*>", "\n", shown)).split()
        (conv,) = warc.read_records(got[r.page_id].conversion.encode())
        assert conv.block.decode().split() == want and conv.get("WARC-Target-URI") == r.url
        assert got[r.page_id].n_links == len(re.findall(r"<a href=", r.html or ""))


def test_the_warc_query_gives_whole_records(spark, sf_dir):
    from corvid.llm import queries

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.op7_warc(spark, sf_dir).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        (meta,), (conv,) = (list(warc.read_records(x.encode())) for x in (r.metadata, r.conversion))
        assert conv.block.decode() == warc.plain_text(pages[r.page_id].html or "")[0] and len(conv.block) == r.text_bytes
        for got, kind, own, digest in ((meta, "metadata", r.metadata_id, r.metadata_digest), (conv, "conversion", r.conversion_id, r.conversion_digest)):
            assert (got.get("WARC-Type"), got.get("WARC-Record-ID"), got.get("WARC-Refers-To")) == (kind, own, r.source_id)
            assert digest == got.get("WARC-Block-Digest") == warc.sha1_base32(got.block)


@pytest.mark.parametrize("page", ['<a "' * 200_000, "<a " * 200_000, '<a ">" ' * 100_000, "<" * 300_000, "<b>" * 100_000 + "</b>" * 100_000, "<b><p><i>" * 30_000 + "</b>" * 30_000, "<p><b>x" * 50_000])
def test_malformed_pages_take_linear_time(page):
    import time

    began = time.process_time()
    main_text.main_text(page)
    warc.plain_text(page)
    assert time.process_time() - began < 20  # a quadratic reader takes hours


def test_warc_takes_what_it_gets(spark):
    import gzip

    ok = warc.response("http://a", b"x", "k", "2024-01-01T00:00:00Z").to_bytes()
    other = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nX-Long: a\r\n b\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    rows = [(1, None), (2, b""), (3, b"junk"), (4, ok + other + ok), (5, gzip.compress(ok)), (6, ok[:-9])]
    got = collections.defaultdict(list)
    for r in warc.derivatives(spark.createDataFrame(rows, "key long, record binary")).collect():
        got[r.key].append((r.record_type, bool(r.error)))
    assert got == {1: [(None, True)], 2: [(None, True)], 3: [(None, True)], 4: [("response", False), ("warcinfo", False), ("response", False)], 5: [("response", False)], 6: [(None, True)]}


# ---- 8 -----------------------------------------------------------------------------------------------------------


def test_quality_measures(docs, texts):
    got = {r.doc_id: r for r in quality.judged(docs, ["doc_id", "n_words", "text"]).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        ws, ls = words(t), [x for x in (t or "").split("\n") if words(x)]
        runs = [tuple(ws[a : a + 8]) for a in range(len(ws) - 7)]
        n = collections.Counter(runs)
        cover = {p for a, x in enumerate(runs) if n[x] > 1 for p in range(a, a + 8)}
        want = (len(ws), len(b"".join(ws).decode()), sum((t or "").count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(cover), len(ws) < 20 or 100 * len(cover) > 30 * len(ws))
        r = got[i]
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words, r.q_base_failed) == want
        assert r.text == t and r.n_words == -1 and not (r.q_kept and r.q_base_failed)


def test_thresholds_follow_the_group(spark):
    rng = random.Random(9)
    row = lambda i, s, sym: (i, " ".join(f"w{rng.randrange(900)}{'#' * sym if k % 2 else ''}" for k in range(60)), "en", s)
    rows = [row(i, "prose", 0) for i in range(100)] + [row(200 + i, "code", 2) for i in range(100)] + [row(400, "prose", 2), row(401, "new", 0)]
    got = {r.doc_id: r.q_kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"]).collect()}
    assert all(got[i] for i in (*range(100), *range(200, 300), 401)) and not got[400]


def test_repeats_fail_by_their_group_before_the_fixed_cutoff(spark):
    rng = random.Random(10)
    plain = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    run = plain(10)
    rows = [(i, plain(60), "en", "prose") for i in range(100)] + [(200, f"{plain(30)} {run} {plain(20)} {run} {plain(10)}", "en", "prose")]
    r = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"]).collect()}
    assert r[200].q_n_repeat_words == 20 and not r[200].q_base_failed and not r[200].q_kept and all(r[i].q_kept for i in range(100))


def test_buckets_are_monotone_and_close(spark):
    df = spark.range(0, 300_000, 37).withColumn("b", quality.bucket(F.col("id"))).withColumn("f", quality.bucket_floor(F.col("b"))).orderBy("id")
    rows = df.collect()
    assert all(a.b <= b.b for a, b in zip(rows, rows[1:])) and all(r.f <= r.id <= r.f * 33 / 32 + 1 for r in rows)


# ---- 9 -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("options", [{}, {"most_contexts": 1}, {"most_states": 100}])
def test_substring_dedup(docs, texts, options):
    first, want = {}, set()
    for i, t in sorted(texts):
        ws = words(t)
        for a in range(len(ws) - 49):
            first.setdefault(tuple(ws[a : a + 50]), i)
    for i, t in texts:
        ws = words(t)
        gone = {p for a in range(len(ws) - 49) if first[tuple(ws[a : a + 50])] < i for p in range(a, a + 50)}
        kept = b" ".join(w for p, w in enumerate(ws) if p not in gone)
        want.add((i, len(ws), len(gone), kept.decode(), sha(kept)))
    assert {tuple(r) for r in substring_dedup.remove_repeats(docs, **options).collect()} == want
    assert sum(w[2] for w in want) > 500


def test_matching_statistics():
    rng = random.Random(6)
    for _ in range(200):
        seqs = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(25))] for _ in range(3)]
        sam = substring_dedup.SuffixAutomaton()
        for s in seqs:
            sam.add(s)
        text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(30)]
        has = {tuple(s[a:b]) for s in seqs for a in range(len(s)) for b in range(a, len(s) + 1)} | {()}
        assert sam.matches(text) == [max(n for n in range(i + 2) if tuple(text[i + 1 - n : i + 1]) in has) for i in range(len(text))]


# ---- 10 ----------------------------------------------------------------------------------------------------------

LONG = "This is the first paragraph of the article and it is long enough to be judged by the rules, as it has many of the words that are used in all of the texts that there are, and it is more than two hundred characters."
MENU = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain words", ""),
        (f"<html><head><title>T</title><style>p{{}}</style></head><body>{MENU}<article><h1>A &amp; B</h1><p>x<b>y</b> z<br>w&nbsp;v</p><script>var a='</p>';</script><p>***</p></article><footer>&copy; 1</footer></body></html>", "A & B xy z w v ***"),
        (f"<body class='has-sidebar'><header><h1>Site</h1></header>{MENU}<div id=content><div class='cookie-notice'>{LONG}</div><p>{LONG}</p><h2>Head</h2><p>{LONG}</p><div class=comments><p>{LONG}</p></div></div><aside>{LONG}</aside></body>", f"{LONG} Head {LONG}"),
        (f"<main><p>One.</p><form><p>{LONG}</p></form><section class='reader-comments'><article><p>{LONG}</p></article></section><p>Two.</p></main>", "One. Two."),
        ("<div class=ad>Buy</div><article><p>a<p>b<li>c", "a b c"),
        ("<article><p title='a>b'>x &lt;y&gt; &#233; &am</p><!-- <p>no</p> --></article>", "x <y> é &am"),
        ("<article></article>" + MENU, ""),
        ("<article>" + "<b>" * 3000 + "deep" + "</b>" * 3000 + "</article>", "deep"),
    ],
)
def test_main_text(page, want):
    assert main_text.main_text(page or "") == want


def slow_labels(found, labels):
    """The second pass by looking at every other block of the region for each undecided one."""
    out = []
    for i, b in enumerate(found):
        if labels[i] in ("good", "bad"):
            out.append(labels[i])
            continue
        votes = [j for j, o in enumerate(found) if o.article == b.article and labels[j] in ("good", "bad") and not (b.article and o.named)]
        edge = "good" if b.article else "bad"
        before = max((j for j in votes if j < i), default=-1)
        after = min((j for j in votes if j > i), default=len(found))
        one, two = labels[before] if before >= 0 else edge, labels[after] if after < len(found) else edge
        if one == two:
            out.append(one)
        elif labels[i] == "near" or b.article:
            out.append("good")
        elif b.heading:
            out.append(two)
        else:
            out.append("bad" if i - before == after - i else one if i - before < after - i else two)
    return out


def test_second_pass_against_a_plain_search():
    rng = random.Random(11)
    for _ in range(400):
        found = [main_text.Block("x", 0, rng.choice([0, 0, 0, 1]), rng.random() < 0.2, False, rng.random() < 0.2) for _ in range(rng.randrange(14))]
        labels = [rng.choice(["good", "bad", "near", "short", "short"]) for _ in found]
        assert main_text.second_pass(found, labels) == slow_labels(found, labels)


def test_passes_find_articles_that_no_markup_names(spark, sf_dir):
    """The text of a marked article is what the rules have to find once its tags say nothing."""
    right = found = wanted = bad = 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        want = collections.Counter(main_text.main_text(r.html).split())
        page = re.sub(r"<(/?)(?:article|main)\b[^>]*>", r"<\1div>", r.html)
        got = collections.Counter(main_text.main_text(page).split())
        bad += sum(main_text.first_pass(b, False) == "bad" for b in main_text.blocks(page))
        right, found, wanted = right + (want & got).total(), found + got.total(), wanted + want.total()
    assert right / found > 0.98 and right / wanted > 0.75 and bad


def test_extract_keeps_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<article><p>é\n 😀</p></article>", "y")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, main_text.extract(df).collect())) == [(1, "u", "", 0), (1, "u", "é 😀", 3)]


# ---- all ---------------------------------------------------------------------------------------------------------


def test_empty_tables(spark, nothing):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert lm_score.score(nothing, lm_score.held_out_ids("doc_id")).collect() == []
    assert decontaminate.digest(decontaminate.shared_spans(nothing, bench)).collect() == []
    assert line_dedup.summary(nothing).collect() == line_dedup.dedup(nothing).collect() == []
    assert piece_codec.encode_decode(nothing, piece_model_path()).collect() == []
    assert near_dup.near_duplicates(nothing).collect() == []
    assert license_scan.scan(nothing, license_scan.notices(spark)).collect() == []
    assert quality.judged(nothing, ["doc_id"]).collect() == []
    assert substring_dedup.remove_repeats(nothing).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert main_text.extract(pages).collect() == warc.derivatives(warc.responses(pages)).collect() == []


def test_repeated_rows_keep_their_number(docs, texts):
    twice = docs.unionAll(docs).where("doc_id < 60")
    n = 120
    assert lm_score.score(twice, lm_score.held_out_ids("doc_id")).count() == n
    assert line_dedup.summary(twice).count() == line_dedup.dedup(twice).count() == n
    assert near_dup.near_duplicates(twice).count() == n
    assert quality.judged(twice, ["doc_id"]).count() == n
    assert substring_dedup.remove_repeats(twice).count() == n
