"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line's tokens are its distinct words.  Equal lines are one class, found by a 128-bit hash of their text.  Classes are
joined by prefix, length and position, candidates verified on the full token sets, and a line goes if an earlier one, by
document id and line number, has a Jaccard similarity of at least ``percent``.

Rarity.  How often a token stands in the distinct lines is counted over the whole corpus into ``cells`` counters, a token's counter
being chosen by its hash; so the counts that every task needs have a fixed size, whatever the vocabulary, and go into the
plan as one array (a subquery may not stand in an array function).  All tokens are ordered by their counter, in steps of
an eighth of a factor of two, then by hash.  Any one order makes the prefix filter exact; tokens that share a counter are
merely taken for more frequent than they are.

Filters.  Two lines of n and m tokens that are similar share a token among the first n - ceil(n * percent) + 1 of either,
and at the first that they share there are still enough tokens left in both (position).  Their sizes are close (length),
and the parities of their tokens' hash bits differ in no more places than their sets do in tokens (bitmap).  One semi-join
of the prefixes by token with these filters leaves the lines that have any partner; all others are done with.

Size classes.  A first token is joined within a class of line sizes, each up to twice the one before, so that most pairs
that the length filter would drop never meet.  A similar pair meets in the class of its longer line: the shorter one's
first tokens also stand in the next class, those of them that still leave enough tokens for a line of that size.

Turns.  Among what is left a token isn't expanded into all pairs of its lines.  First the earliest line of each token is
compared with the others; lines that it removes are done with.  For those that remain a few members are compared, chosen
by hash, then eight times as many each turn, until every earlier line has been, or until all that remains takes a few
comparisons a line.  So a family of near-equal lines costs a few pairs a line, and no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as JavaColumn
from pyspark.sql.types import ArrayType, ByteType

from corvid.llm.common import SPACE, discard, materialize

#: Counters of the tokens' frequencies, a power of two.
CELLS = 1 << 18
#: Taken from each counter's level, 0 to 255, so that it fits into a byte.
LEAST = 128
#: A token's lines up to so many are compared with each other at once; beyond, by turns, each with 2**GROWTH times as many.
AT_ONCE, GROWTH = 16, 3
#: The rest is compared in one last turn once that takes at most so many comparisons for each line and token.
REST = 16
#: Lines with more tokens than this have bitmaps of 128 bits, others of 64, which tell them apart as well.
WIDE = 96
#: Ids and hashes are broadcast up to so many rows (of at most 48 bytes), joined by a shuffle beyond.
BROADCAST_ROWS = 300_000
_FAST_MAP = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
_MAPS = ("m0", "m1")
_KEY = ("doc_id", "line_no", "th")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th (a hash of the text), line_no from 0, line, t1, t2."""
    text = F.col(text_col).cast("string")
    texts = docs.where(text.isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))  # by itself: or th is found anew for each line
    rows = texts.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.withColumns({"t1": F.xxhash64("line"), "t2": F.xxhash64(F.lit(7), "line")})


def _worded(line: Column) -> Column:
    """Whether a line has a word."""
    return (F.ascii(line) > 32) | line.rlike(r"[^\x20\x09-\x0D]")  # most lines begin with one: no pattern is tried on them


def _spaced(line: str) -> Column:
    """A line with spaces for all white space."""
    other = reduce(Column.__or__, (F.col(line).contains(x) for x in "\t\x0b\x0c\r"))  # looked for in the bytes; \n ends a line
    return F.when(other, F.regexp_replace(line, SPACE, " ")).otherwise(F.col(line))


def _tokens(line: str) -> Column:
    """Hashes of a line's distinct words."""
    words = F.split(_spaced(line), " ")  # and empty ones where two spaces meet or at its ends
    return F.array_except(F.transform(words, lambda x: F.xxhash64(x)), F.array(F.xxhash64(F.lit(""))))


def _frequencies(classes: DataFrame, cells: int) -> Column:
    """An array: of each counter the binary logarithm of its count in eighths, at most 255, less ``LEAST``.  A token counts once a line."""
    cell = F.col("token").bitwiseAND(F.lit(cells - 1).cast("long")).alias("cell")
    tasks = max(classes.sparkSession.sparkContext.defaultParallelism, len(classes.inputFiles()) // 4)  # each sends up to ``cells`` rows
    counted = classes.coalesce(tasks).select(F.explode("tokens").alias("token")).groupBy(cell).agg(F.round(F.log2(F.count("*") + 1) * 8).cast("int").alias("level"))
    levels = [-LEAST] * cells
    with _set(classes, _FAST_MAP, str(min(max(cells.bit_length() - 1, 10), 20))):
        for r in counted.toLocalIterator():  # at most ``cells`` rows, whatever the corpus
            levels[r[0]] = min(r[1], 255) - LEAST
    return _packed(classes.sparkSession, levels)


def _packed(spark: SparkSession, values: list[int]) -> Column:
    """An array<tinyint> in the plan that is printed without its values.

    Spark prints a plan for its listeners when a query starts and again after each stage, and keeps some of it; of an array as
    long as the counters each such text has megabytes.
    """
    jvm = spark.sparkContext._jvm
    of = jvm.org.apache.spark.sql.catalyst.expressions
    kind = jvm.org.apache.spark.sql.types.DataType.fromJson(ArrayType(ByteType(), False).json())
    value = of.UnsafeArrayData.fromPrimitiveArray(np.array(values, dtype=np.int8).tobytes())
    return JavaColumn(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(of.Literal(value, kind)))


def _constant(values: list[int]) -> Column:
    """An array<bigint> that is folded into the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


@contextmanager
def _set(df: DataFrame, key: str, value: str) -> Iterator[None]:
    conf = df.sparkSession.conf
    before = conf.get(key, None)
    conf.set(key, value)
    try:
        yield
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def _heads(classes: DataFrame, levels: Column, cells: int, percent: int) -> DataFrame:
    """c, n (tokens), m0, m1 (bitmaps), k, b and head: a class's first tokens in order of rarity, k of them.

    b is the line's class of sizes; what follows the k tokens in ``head`` are those that also stand in the next class.

    A token flips one of the 64 bits of m0.  Of a line over ``WIDE`` m1 has the flips of every other token, told by one
    more bit of the hash: m0 ^ m1 and m1 are a bitmap of 128 bits.
    """
    at = lambda of, x, size: of[x.bitwiseAND(F.lit(size - 1).cast("long"))]
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    ranked = lambda x: F.shiftleft(at(levels, x, cells).cast("long"), 52).bitwiseOR(F.shiftrightunsigned(x, 12))
    in_order = F.sort_array(F.transform("tokens", lambda x: F.coalesce(ranked(x), zero)))  # never null: sorted as plain numbers
    bits, none = [1 << k if k < 63 else -(1 << 63) for k in range(64)], [0] * 64
    flipped = lambda bit: F.aggregate("tokens", zero, lambda a, x: a.bitwiseXOR(bit(x)))
    n = F.size("tokens")
    m0 = flipped(lambda x: at(_constant(bits), x, 64))
    m1 = F.when(n > WIDE, flipped(lambda x: at(_constant(none + bits), x, 128))).otherwise(zero)
    k = n - F.ceil(n * percent / 100).cast("int") + 1
    # steps of a power of two by which no similar lines are two classes apart
    step = max(1, math.ceil(math.log2(100 / percent))) if percent > 0 else 40
    b = F.floor((F.length(F.bin(n)) - 1) / step).cast("int")
    longer = F.call_function("shiftleft", one, F.least((b + 1) * step, F.lit(40)))  # tokens of the next class's shortest line
    more = F.floor((n * F.lit(100).cast("long") - longer * F.lit(percent)) / (100 + percent)) + 1  # the last of them has position's n - pos still left
    more = F.greatest(F.least(more.cast("long"), k.cast("long")), zero).cast("int")
    rows = classes.select("c", n.alias("n"), m0.alias("m0"), m1.alias("m1"), k.alias("k"), b.alias("b"), more.alias("more"), in_order.alias("in_order"))
    head = F.concat(F.slice("in_order", F.lit(1), F.col("k")), F.slice("in_order", F.lit(1), F.col("more")))
    return rows.select("c", "n", *_MAPS, "k", "b", head.alias("head"))


def _prefixes(heads: DataFrame) -> DataFrame:
    """A row for each first token and class of sizes: token (both in one), c, m0, m1, at (n in the upper half, the token's place in the lower).

    All are longs and none is null: such a row is small to send and sort, and compared without tests for null.
    """
    rows = heads.select("c", "n", "k", "b", *_MAPS, F.posexplode_outer("head").alias("pos", "token"))  # outer: or Spark tests, and so makes, a head twice
    other = F.col("pos") >= F.col("k")
    by_size = F.shiftleft((F.col("b") + other.cast("int")).cast("long"), 60)  # its last four bits; classes that share them only meet for nothing
    rows = rows.withColumns({"token": F.col("token").bitwiseXOR(by_size), "pos": F.when(other, F.col("pos") - F.col("k")).otherwise(F.col("pos"))})
    rows = rows.withColumn("at", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")))
    return rows.select(*(F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in ("token", "c", *_MAPS, "at")))


def _close(a: str, b: str, percent: int) -> Column:
    """Whether the token that ``a`` and ``b`` share may be the first of a similar pair: bitmaps, length, position; what leaves fewest first."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    (nx, px), (ny, py) = ((F.shiftrightunsigned(s("at"), 32), s("at").bitwiseAND(F.lit((1 << 32) - 1))) for s in (x, y))
    length = F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent
    position = F.least(nx - px, ny - py) * (100 + percent) >= (nx + ny) * percent
    m0, m1 = (x(m).bitwiseXOR(y(m)) for m in _MAPS)
    few = lambda apart: apart * (100 + percent) <= (nx + ny) * (100 - percent)
    wide = (F.least(nx, ny) <= WIDE) | few(F.bit_count(m0.bitwiseXOR(m1)) + F.bit_count(m1))
    return few(F.bit_count(m0)) & length & position & wide & (x("c") != y("c"))


def _few(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def removed_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """(doc_id, th, line_no) of every line to remove; th is xxhash64 of the document's text.

    A line without a word is never removed.  Rows with the same id and text are one document and lose the same lines.  A
    null id sorts first.
    """
    return _removed(docs, percent, id_col, text_col, cells).distinct()


def _removed(docs: DataFrame, percent: int, id_col: str, text_col: str, cells: int) -> DataFrame:
    """removed_lines, but for rows with the same id and text one of each line for each row."""
    lines = _lines(docs, id_col, text_col).where(_worded(F.col("line")))
    classes = lines.groupBy("t1", "t2").agg(F.min(F.struct(*_KEY, "line")).alias("first"), F.count("*").alias("copies"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("c"), "t1", "t2", F.struct(*(F.col(f"first.{k}").alias(k) for k in _KEY)).alias("key"), "copies", _tokens("first.line").alias("tokens")), "lines", "zstd", dictionary=False, level=1, flat=True)

    heads = _heads(classes, _frequencies(classes, cells), cells, percent)
    prefixes = _prefixes(heads)
    a, b = prefixes.alias("a"), prefixes.alias("b")
    active = materialize(a.join(b, (F.col("a.token") == F.col("b.token")) & _close("a", "b", percent), "left_semi"), "active", dictionary=False)
    wanted = materialize(active.select("c").distinct(), "wanted")
    sets = materialize(classes.join(_few(wanted), "c", "left_semi").select("c", "key", "t1", "t2", "tokens"), "sets", dictionary=False, flat=True)
    gone = _gone(active, sets, percent)
    discard(wanted, active)

    # the classes that lose lines: whole ones, and of others all lines but the first
    judged = gone.select("t1", "t2", F.lit(None).cast(classes.schema["key"].dataType).alias("key")).unionAll(classes.where("copies > 1").select("t1", "t2", "key"))
    judged = materialize(judged, "judged")
    out = _lines(docs, id_col, text_col).select(*_KEY, "t1", "t2").join(_few(judged), ["t1", "t2"])  # a line that is everywhere: a skewed join's large side is split
    discard(classes)
    return out.where(F.col("key").isNull() | (F.struct(*_KEY) != F.col("key"))).select(*_KEY)


def _gone(active: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(c, t1, t2) of the classes that an earlier one matches."""
    members = materialize(active.join(sets.select("c", "key"), "c"), "members")
    groups = members.groupBy("token").agg(F.min(F.struct("key", "c", "at", *_MAPS)).alias("least"), F.count("*").alias("size"))
    groups = materialize(groups.where("size > 1"), "groups")
    earliest = groups.select("token", "least.*")
    close = (F.col("a.token") == F.col("b.token")) & (F.col("a.key") < F.col("b.key")) & _close("a", "b", percent)
    pairs = lambda a, b, more=F.lit(True): a.alias("a").join(b.alias("b"), close & more).select(F.col("a.c").alias("a"), F.col("b.c").alias("b")).distinct()
    gone = materialize(_verified(pairs(earliest, members), sets, percent), "gone")
    # lines that remain, where another than the earliest of their token may still match
    late = members.join(groups.select("token", "size", F.col("least.key").alias("from")), "token").where("key > from and size > 2").drop("from")
    left = materialize(late.join(_few(gone), "c", "left_anti"), "remain")
    turn, most = -1, REST * members.count()
    while (remain := left.agg(F.max("size"), F.sum(F.col("size").cast("long"))).first())[0]:
        turn, before = turn + 1, turn
        if remain[1] <= most:  # to the turn that compares with every earlier line
            turn = max(turn, -(-(remain[0] // AT_ONCE).bit_length() // GROWTH))
        sized = members.join(_few(materialize(left.select("token", "size").distinct(), "tokens")), "token")
        centres = sized.where(_centre(turn))
        found = pairs(centres, left, ~_before(before))
        more = materialize(_verified(found, sets, percent), "more")
        both = materialize(gone.unionAll(more), "gone")
        rest = materialize(left.where(F.col("size") > AT_ONCE << (GROWTH * turn)).join(_few(more), "c", "left_anti"), "remain")
        discard(gone, more, left)
        gone, left = both, rest
    return sets.select("c", "t1", "t2").join(_few(gone), "c", "left_semi")


def _level(c: str, size: str, turn: int) -> Column:
    """Whether a member of a token's ``size`` lines is compared with all others by this turn: about AT_ONCE * 2**(GROWTH * turn) are."""
    h = F.xxhash64(c)
    zeros = F.bit_count(h.bitwiseAND(-h) - F.lit(1))  # at the end of the hash: k or more with a chance of 2**-k
    most = AT_ONCE << (GROWTH * turn)
    return (F.col(size) <= most) | (zeros >= F.ceil(F.log2(F.col(size) / most)))


def _centre(turn: int) -> Column:
    return _level("c", "size", turn)


def _before(turn: int) -> Column:
    """Whether the pair's first line was compared in this turn, the one before, or an earlier one."""
    return _level("a.c", "a.size", turn) if turn >= 0 else F.lit(False)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(c) of the later lines of the pairs whose full token sets are similar enough."""
    x, y = (sets.select(F.col("c").alias(s), F.col("tokens").alias(t)) for s, t in (("a", "x"), ("b", "y")))
    full = pairs.join(x, "a").join(y, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    return full.where(F.col("both") * 100 >= (F.size("x") + F.size("y") - F.col("both")) * percent).select(F.col("b").alias("c")).distinct()


def summary(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """One row per input row: doc_id, n_lines (with a word), n_removed and removed (their numbers, from 0, sorted).

    Null and empty texts have no lines.  Other columns aren't read.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), _worded)).cast("long").alias("n_lines"))
    gone = _removed(docs, percent, id_col, text_col, cells).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    out = rows.alias("r").join(gone.alias("g"), F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.th") == F.col("g.th")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("r.doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def dedup(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """``docs`` with the lines to remove taken out of the text; all columns and rows stay, a text may become empty."""
    gone = _removed(docs, percent, id_col, text_col, cells).groupBy("doc_id", "th").agg(F.collect_set("line_no").alias("_gone"))
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("th").alias("_gone_th"), "_gone")
    text = F.col(text_col).cast("string")
    out = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("_gone_id")) & (F.xxhash64(text) == F.col("_gone_th")), "left")
    kept = F.array_join(F.transform(F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: ~F.array_contains("_gone", e["i"])), lambda e: e["x"]), "\n")
    return out.withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)
