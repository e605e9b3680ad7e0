"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each text gets a few integer measures.  Their distribution is kept for each
(language, source) as a mergeable quantile sketch: counts in log-linear buckets
of integers (exact below 64, within 1/32 above), so that sketches merge by
adding counts and every engine gets the same quantiles.  Small groups take the
merged sketch of their language, and languages that are small take that of all.
A text fails a rule if its measure lies further from the group's median than
``reach`` times the spread between the median and the quartile on the side where
no junk piles up, with a least spread for each measure in place of fixed cutoffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import materialize, words

#: measure -> (least spread in thousandths, whether low values fail as well).  Symbols, repeated words: a word; length: characters a word; lines: a line.
MEASURES = {"symbols": (25, False), "word_length": (400, True), "dup_lines": (50, False), "repeated": (30, False)}
NO_GROUP = "(none)"
#: Up to so many groups of thresholds (under 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 50_000


def bucket(v: Column) -> Column:
    """The log-linear bucket of a non-negative integer: itself below 64, then 32 for each power of two."""
    shift = F.length(F.bin(v)) - F.lit(6)
    return F.when(v < 64, v).otherwise(shift * 32 + F.call_function("shiftright", v, shift)).cast("long")


def bucket_floor(b: Column) -> Column:
    """The least integer of a bucket."""
    shift = (F.floor(b / 32) - 1).cast("int")
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", b - shift * 32, shift)).cast("long")


def measured(docs: DataFrame, text_col: str = "text", window: int = 8) -> DataFrame:
    """``docs`` with _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words and _n_lines (lines with a word).

    Null text counts as empty: all are 0.  Work and memory follow the length of the text: runs of ``window`` words are
    hashed, and sorted only in texts that repeat one.
    """
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"_w": words(F.col(text_col)), "_l": lines})
    out = out.withColumn("_n_words", F.size("_w").cast("long"))
    runs = F.when(F.col("_n_words") >= window, F.transform(F.sequence(F.lit(1), (F.col("_n_words") - (window - 1)).cast("int")), lambda i: F.xxhash64(F.slice(F.col("_w"), i, window))))
    out = out.withColumns(
        {
            "_word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "_n_symbols": F.coalesce(F.regexp_count(F.col(text_col), F.lit("[#*$%&|<>]")), F.lit(0)).cast("long"),
            "_n_lines": F.size("_l").cast("long"),
            "_n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_h": F.coalesce(runs, F.array().cast("array<bigint>")),
        }
    ).drop("_w", "_l")
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    out = out.withColumn("_s", F.when(repeats, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_h")
    twin = lambda e, j: (F.get("_s", j - 1)["h"] == e["h"]) | (F.get("_s", j + 1)["h"] == e["h"])
    out = out.withColumn("_p", F.array_sort(F.transform(F.filter("_s", lambda e, j: F.coalesce(twin(e, j), F.get("_s", j - 1)["h"] == e["h"], F.get("_s", j + 1)["h"] == e["h"], F.lit(False))), lambda e: e["i"]))).drop("_s")
    covered = F.aggregate(F.transform("_p", lambda p, j: F.least(F.lit(window), F.coalesce(F.get("_p", j + 1) - p, F.lit(window)))), F.lit(0), lambda a, x: a + x)
    return out.withColumn("_n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p")


def _bounds(counts: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """From bucket counts: for each group of keys n, and for each measure its least and largest allowed value."""
    merged = counts.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    run = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)), "of": F.sum("n").over(group)})
    at = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("of") * k, F.col("bucket")))
    marks = run.groupBy(*keys, "measure").agg(F.max("of").alias("n"), *(bucket_floor(at(k)).alias(f"q{k}") for k in (1, 2, 3)))
    aggs = [F.max("n").alias("group_n")]
    for m, (least, low_too) in MEASURES.items():
        here = F.col("measure") == m
        aggs.append(F.max(F.when(here, F.col("q2") + reach * F.greatest(F.col("q2") - F.col("q1"), F.lit(least)))).alias(f"{m}_most"))
        if low_too:
            aggs.append(F.max(F.when(here, F.col("q2") - reach * F.greatest(F.col("q2") - F.col("q1"), F.lit(least)))).alias(f"{m}_least"))
    return marks.groupBy(*keys).agg(*aggs)


def thresholds(counts: DataFrame, reach: int = 6, min_group: int = 50) -> DataFrame:
    """Thresholds of every (lang, source) in ``counts`` (lang, source, measure, bucket, n), from the smallest sketch with ``min_group`` texts.

    Counts that several runs made can be united before: sketches merge by adding.
    """
    by_source, by_lang = _bounds(counts, ["_lang", "_source"], reach), _bounds(counts, ["_lang"], reach)
    overall = _bounds(counts.withColumn("_all", F.lit(0)), ["_all"], reach).first()
    names = [c for c in by_source.columns if c not in ("_lang", "_source")]
    out = by_source.select("_lang", "_source", *(F.col(c).alias(f"s_{c}") for c in names))
    out = out.join(by_lang.select("_lang", *(F.col(c).alias(f"l_{c}") for c in names)), "_lang")
    of_all = lambda c: F.lit(overall[c] if overall else None).cast("long")
    pick = lambda c: F.when(F.col("s_group_n") >= min_group, F.col(f"s_{c}")).when(F.col("l_group_n") >= min_group, F.col(f"l_{c}")).otherwise(of_all(c))
    return out.select("_lang", "_source", *(pick(c).alias(f"_{c}") for c in names))


def judged(docs: DataFrame, carry: list[str], text_col: str = "text", lang_col: str = "lang", source_col: str = "source", reach: int = 6, min_group: int = 50, min_words: int = 20) -> DataFrame:
    """The columns ``carry`` of ``docs``, one row per input row, with the measures, base_failed and kept.

    A text without words, of fewer than ``min_words`` words, or whose words lie for more than 30 % in repeated runs fails
    outright (base_failed); others are kept if all measures lie within their group's thresholds.  Null language or source
    forms a group of its own.  Repeated rows are all counted and judged alike.

    Measures are written to the shared scratch folder once.  The sketches of all groups come from one partial
    aggregation, so a source with most rows shuffles no more than any other.
    """
    named = {"_lang": F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_GROUP)), "_source": F.coalesce(F.col(source_col).cast("string"), F.lit(NO_GROUP))}
    base = docs.select(*(F.col(c).alias(f"c_{c}") for c in carry), F.col(text_col).cast("string").alias("_text"), *(c.alias(n) for n, c in named.items()))
    rows = measured(base, "_text").drop("_text")
    each, a_line = F.greatest("_n_words", F.lit(1)), F.greatest("_n_lines", F.lit(1))
    ratio = lambda a, b: F.floor(F.col(a) * 1000 / b).cast("long")
    rows = materialize(rows.withColumns({"_symbols": ratio("_n_symbols", each), "_word_length": ratio("_word_chars", each), "_dup_lines": ratio("_n_dup_lines", a_line), "_repeated": ratio("_n_repeat_words", each)}), "quality")
    some = rows.where("_n_words > 0").select("_lang", "_source", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(F.col(f"_{m}")).alias("bucket")) for m in MEASURES))).alias("e"))
    counts = some.groupBy("_lang", "_source", F.col("e.measure").alias("measure"), F.col("e.bucket").alias("bucket")).agg(F.count("*").alias("n"))
    counts = materialize(counts, "sketches")
    limits = materialize(thresholds(counts, reach, min_group), "thresholds")
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    out = rows.join(limits, ["_lang", "_source"], "left")
    failed = (F.col("_n_words") < min_words) | (F.col("_n_repeat_words") * 100 > F.col("_n_words") * 30)
    within = F.lit(True)
    for m, (_, low_too) in MEASURES.items():
        within = within & (F.col(f"_{m}") <= F.col(f"_{m}_most"))
        if low_too:
            within = within & (F.col(f"_{m}") >= F.col(f"_{m}_least"))
    return out.select(
        *(F.col(f"c_{c}").alias(c) for c in carry),
        *(F.col(f"_{c}").alias(f"q_{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        failed.alias("q_base_failed"),
        (~failed & F.coalesce(within, F.lit(False))).alias("q_kept"),
    )


#: DuckDB SQL for the contract's query over documents; the same integers, so the same rows.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, row_number() OVER () AS k FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT k, i, hash(array_to_string(ws[i:i+7], ' ')) AS h FROM (SELECT k, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT k, i, count(*) OVER (PARTITION BY k, h) AS n FROM g),
p AS (SELECT k, i, least(8, coalesce(lead(i) OVER (PARTITION BY k ORDER BY i) - i, 8)) AS c FROM r WHERE n > 1),
rep AS (SELECT k, sum(c)::BIGINT AS n FROM p GROUP BY k),
m AS (SELECT w.k, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
      FROM w LEFT JOIN rep ON w.k = rep.k),
v AS (SELECT *, n_symbols * 1000 // greatest(n_words, 1) AS symbols, word_chars * 1000 // greatest(n_words, 1) AS word_length,
        n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines, n_repeat_words * 1000 // greatest(n_words, 1) AS repeated FROM m),
e AS (SELECT lang, source, measure, val FROM (UNPIVOT (SELECT k, lang, source, symbols, word_length, dup_lines, repeated FROM v WHERE n_words > 0) ON symbols, word_length, dup_lines, repeated INTO NAME measure VALUE val)),
b AS (SELECT lang, source, measure, CASE WHEN val < 64 THEN val ELSE (length(bin(val)) - 6) * 32 + (val >> (length(bin(val)) - 6)::BIGINT) END AS bucket FROM e),
c AS (SELECT lang, source, measure, bucket, count(*) AS n, grouping(lang) + grouping(source) AS up FROM b
      GROUP BY GROUPING SETS ((lang, source, measure, bucket), (lang, measure, bucket), (measure, bucket))),
u AS (SELECT *, sum(n) OVER (PARTITION BY up, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY up, lang, source, measure) AS tot FROM c),
q AS (SELECT up, lang, source, measure, max(tot) AS n, min(CASE WHEN upto * 4 >= tot THEN bucket END) AS b1, min(CASE WHEN upto * 4 >= tot * 2 THEN bucket END) AS b2 FROM u GROUP BY ALL),
f AS (SELECT up, lang, source, measure, n,
        CASE WHEN b1 < 64 THEN b1 ELSE (b1 - (b1 // 32 - 1) * 32) << (b1 // 32 - 1) END AS q1,
        CASE WHEN b2 < 64 THEN b2 ELSE (b2 - (b2 // 32 - 1) * 32) << (b2 // 32 - 1) END AS q2 FROM q),
t AS (SELECT up, lang, source, max(n) AS n,
        max(CASE WHEN measure = 'symbols' THEN q2 + 6 * greatest(q2 - q1, 25) END) AS s_most,
        max(CASE WHEN measure = 'word_length' THEN q2 + 6 * greatest(q2 - q1, 400) END) AS w_most,
        max(CASE WHEN measure = 'word_length' THEN q2 - 6 * greatest(q2 - q1, 400) END) AS w_least,
        max(CASE WHEN measure = 'dup_lines' THEN q2 + 6 * greatest(q2 - q1, 50) END) AS d_most,
        max(CASE WHEN measure = 'repeated' THEN q2 + 6 * greatest(q2 - q1, 30) END) AS r_most FROM f GROUP BY up, lang, source),
x AS (SELECT v.*, CASE WHEN t0.n >= 50 THEN t0 WHEN t1.n >= 50 THEN t1 ELSE t2 END AS l FROM v
      LEFT JOIN t t0 ON t0.up = 0 AND t0.lang = v.lang AND t0.source = v.source
      LEFT JOIN t t1 ON t1.up = 1 AND t1.lang = v.lang LEFT JOIN t t2 ON t2.up = 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  coalesce(NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND symbols <= l.s_most AND word_length BETWEEN l.w_least AND l.w_most AND dup_lines <= l.d_most AND repeated <= l.r_most, false) AS kept
FROM x
"""
