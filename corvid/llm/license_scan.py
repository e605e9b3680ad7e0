"""License scans by MinHash bands over overlapping text windows, in DataFrame functions only.

Templates fall into classes by their number of shingles: class c has those of
2**c to 2**(c+1) - 1.  For each class a text is cut into windows of 2**(c+2)
shingles, a window beginning every 2**c, so that each place where a template of
the class may stand, with up to 2**c shingles more between its parts, lies whole
in one window; a template spread further is none.  A window that holds a share of
``contained`` of a template's shingles then has a Jaccard similarity to it of
at least s = contained / (5 - contained), and with bands of one minhash, b of
them miss it with probability (1 - s)**b; b follows from ``miss``.  Retrieved
templates are verified by exact containment of their shingles in the window.

Before that, windows without a single shingle of any template are left out: they
can't contain one, so nothing is lost.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.common import materialize
from corvid.llm.licenses import templates

#: Template shingles up to this number are broadcast and put into the plan as a set; more are joined by a shuffle.
BROADCAST_SHINGLES = 20_000
NOT_WORD = r"[^\p{L}\p{N}]+"


def notices(spark: SparkSession) -> DataFrame:
    """The built-in templates, license texts and the notices that refer to them: license, text."""
    return spark.createDataFrame(templates(), "license string, text string")


def shingle_hashes(text: Column, q: int) -> Column:
    """Hashes of a text's q-word shingles in order (letters and digits, lower case); of fewer words, the whole as one."""
    w = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda x: x != "")
    return _hashed(w, q)


def _hashed(w: Column, q: int) -> Column:
    n = F.size(w)
    return F.when(n >= q, F.transform(F.sequence(F.lit(1), n - (q - 1)), lambda i: F.xxhash64(F.slice(w, i, q)))).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def _minhashes(h: Column, b: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: F.struct(i.alias("band"), F.array_min(F.transform(h, lambda x: F.xxhash64(x, i))).alias("value")))


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: int = 5, contained: float = 0.8, miss: float = 1e-4) -> DataFrame:
    """License notices found in each text.

    ``templates`` has license and text; a license may have several.  One row per input row: doc_id, n_words, n_licenses,
    licenses (sorted array), matches (array of license, window: first shingle, size: shingles, shared, wanted; of windows
    that overlap and hold a template the one with most of it).  Null and
    empty texts and templates match nothing.  Repeated rows are scanned alike.  Other columns aren't read.

    Each text is hashed once; texts without a template's shingle keep nothing but their id.  Only candidate windows are
    exploded, and what is joined to them is the templates' bands, broadcast up to a checked size.
    """
    bands = math.ceil(math.log(miss) / math.log(1 - contained / (5 - contained)))
    shapes = templates.where("license is not null").select("license", F.array_distinct(shingle_hashes(F.col("text"), q)).alias("own"), F.col("text").alias("template")).where(F.size("own") > 0)
    shapes = materialize(shapes.dropDuplicates(["license", "template"]).select("license", "own", F.xxhash64("template").alias("template_id"), F.floor(F.log2(F.size("own"))).cast("int").alias("class")), "templates")
    total, classes = shapes.agg(F.sum(F.size("own")), F.collect_set("class")).first()
    small = (total or 0) <= BROADCAST_SHINGLES

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.filter(F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), NOT_WORD), lambda x: x != "").alias("w"))
    rows = rows.select("doc_id", F.size("w").cast("long").alias("n_words"), _hashed(F.col("w"), q).alias("h"))
    if small:
        every = [r[0] for r in shapes.select(F.explode("own")).distinct().collect()]
        known = F.split(F.lit(",".join(map(str, every))), ",").cast("array<bigint>") if every else F.array().cast("array<bigint>")
        rows = rows.withColumn("h", F.when(F.arrays_overlap("h", known), F.col("h")))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "hashed")
    texts = rows.where("h is not null")
    if small:
        hits = F.transform(F.filter(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: F.array_contains(known, e["x"])), lambda e: e["i"])
    else:
        hits = F.sequence(F.lit(0), F.size("h") - 1)
    texts = texts.withColumn("hits", hits)
    places = []  # the windows of each class that hold a hit
    for c in sorted(classes or []):
        step = 2**c
        at = F.array_distinct(F.flatten(F.transform("hits", lambda i: F.transform(F.array(*map(F.lit, range(4))), lambda back: F.greatest(F.floor(i / step).cast("int") - back, F.lit(0))))))  # noqa: B023
        places.append(F.transform(at, lambda k: F.struct(F.lit(c).alias("class"), (k * step).cast("int").alias("window"), F.lit(4 * step).alias("size"))))  # noqa: B023
    if not places:
        places = [F.array().cast("array<struct<class:int,window:int,size:int>>")]
    windows = texts.select("row", "h", F.explode(F.concat(*places)).alias("p")).select("row", "p.class", "p.window", "p.size", F.array_distinct(F.slice("h", F.col("p.window") + 1, F.col("p.size"))).alias("here"))
    banded = windows.withColumn("e", F.explode(_minhashes(F.col("here"), bands))).select("row", "class", "window", "size", "here", "e.band", "e.value")
    keys = shapes.withColumn("e", F.explode(_minhashes(F.col("own"), bands))).select("class", "e.band", "e.value", "template_id", "license", "own")
    if small:
        keys = F.broadcast(keys)
    shared = F.size(F.array_intersect("here", "own"))
    found = banded.join(keys, ["class", "band", "value"]).withColumns({"shared": shared, "wanted": F.size("own")}).where(F.col("shared") >= F.col("wanted") * contained)
    found = found.select("row", "license", "window", "size", "template_id", "shared", "wanted").distinct()
    by_row = found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("license", "window", "size", "shared", "wanted", "template_id"))).alias("m"))
    overlap = lambda a, b: (a["template_id"] == b["template_id"]) & (F.abs(a["window"] - b["window"]) < a["size"])
    better = lambda a, b: (b["shared"] > a["shared"]) | ((b["shared"] == a["shared"]) & (b["window"] < a["window"]))
    best = F.filter("m", lambda a: ~F.exists("m", lambda b: overlap(a, b) & better(a, b)))  # of a place's windows the one that holds most
    by_row = by_row.select("row", F.transform(best, lambda a: F.struct(*(a[c].alias(c) for c in ("license", "window", "size", "shared", "wanted")))).alias("matches"))
    out = rows.drop("h").join(by_row, "row", "left")
    matches = F.coalesce("matches", F.array().cast("array<struct<license:string,window:int,size:int,shared:int,wanted:int>>"))
    names = F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["license"])))
    return out.select("doc_id", "n_words", F.size(names).cast("long").alias("n_licenses"), names.alias("licenses"), matches.alias("matches"))


def _oracle() -> str:
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in templates())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
t AS (SELECT license, row_number() OVER () AS t, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM (VALUES {values}) AS v(license, text)),
ts AS (SELECT DISTINCT license, t, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i+4], ' ') ELSE array_to_string(w, ' ') END AS s FROM (SELECT license, t, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t)),
tc AS (SELECT t, count(*) AS m, CAST(floor(log2(count(*))) AS INTEGER) AS c FROM ts GROUP BY t),
ds AS (SELECT k, i - 1 AS p, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i+4], ' ') ELSE array_to_string(w, ' ') END AS s FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
hit AS (SELECT ds.k, ds.p, ts.license, ts.t, ts.s, tc.m, tc.c FROM ds JOIN ts USING (s) JOIN tc USING (t)),
win AS (SELECT k, license, t, m, s, unnest(list_distinct(list_transform([0, 1, 2, 3], lambda back: greatest(p // (2 ** c)::BIGINT - back, 0)))) AS x FROM hit),
ok AS (SELECT DISTINCT k, license FROM (SELECT k, license, t, x, m, count(DISTINCT s) AS n FROM win GROUP BY ALL) WHERE n >= m * 0.8),
g AS (SELECT k, string_agg(license, ',' ORDER BY license) AS licenses, count(*) AS n FROM ok GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_licenses, coalesce(g.licenses, '') AS licenses FROM d LEFT JOIN g ON d.k = g.k
"""


#: DuckDB SQL for the query over documents with the built-in templates: windows and exact containment, without the bands.
ORACLE = _oracle()
