"""Every operator on the tables of a data folder, with DuckDB SQL that gives the same rows.

The tables hold no source code, so operators run on stand-ins: suppliers that call parts, order lines as line intervals,
documents as chunk texts, embeddings as a vector index whose label is the shard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions import paths, text, vectors
from corvid.operators import cache, explore, filters, graph, incremental, intervals, metrics, ranking, vector
from corvid.plans import query as plans
from corvid.plans import replies
from corvid.sources import cases, chunker, frameworks, imports, parse
from corvid.streaming import changes as streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _probe(emb: DataFrame) -> list[float]:
    return list(emb.where("vec_id = 0").first()["embedding"])


def _join(c: str | F.Column) -> F.Column:
    return F.array_join(c, ",")


# ---- vector search -------------------------------------------------------------------------------------------------

_SCORE = "round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6)"


@_register(f"SELECT vec_id, {_SCORE} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20")
def vec_topk(spark, d):
    e = _t(spark, d, "embeddings")
    return vector.top_k(e, _probe(e), 20, ["vec_id"], digits=6).select("vec_id", "score")


@_register(_SQL["vec_topk"])
def vec_topk_blocked(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "embedding")
    return vector.top_k_blocked(e, _probe(e), 20, ["vec_id"], digits=6).select("vec_id", "score")


@_register(f"SELECT vec_id, {_SCORE} AS score FROM embeddings WHERE label < 5 ORDER BY score DESC, vec_id LIMIT 20")
def vec_topk_scoped(spark, d):
    e = _t(spark, d, "embeddings")
    return vector.top_k(e.where("label < 5"), _probe(e), 20, ["vec_id"], digits=6).select("vec_id", "score")


@_register(f"SELECT vec_id, score FROM (SELECT vec_id, label, {_SCORE} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 40) WHERE label % 2 = 0 ORDER BY score DESC, vec_id LIMIT 20")
def vec_topk_overfetch_filter(spark, d):
    e = _t(spark, d, "embeddings")
    found = vector.top_k(e, _probe(e), 40, ["vec_id"], digits=6)
    return found.where("label % 2 = 0").orderBy(F.desc("score"), "vec_id").limit(20).select("vec_id", "score")


@_register(f"""
WITH h AS (SELECT vec_id, {_SCORE} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 50)
SELECT vec_id, score, md5(text) AS content FROM h LEFT JOIN documents ON vec_id = doc_id WHERE coalesce(text, '') <> ''""")
def vec_join_text(spark, d):
    e = _t(spark, d, "embeddings")
    hits = vector.top_k(e, _probe(e), 50, ["vec_id"], digits=6).select("vec_id", "score")
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    kept, _ = filters.content_fence(vector.hydrate(hits, docs, ["vec_id"]))
    return kept.withColumn("content", F.md5("content"))


@_register(f"""
WITH h AS (SELECT vec_id FROM (SELECT vec_id, {_SCORE} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 500))
SELECT count(*) FILTER (WHERE coalesce(text, '') = '')::BIGINT AS dropped FROM h LEFT JOIN documents ON vec_id = doc_id AND doc_id % 3 = 0""")
def content_fence_dropped(spark, d):
    e = _t(spark, d, "embeddings")
    hits = vector.top_k(e, _probe(e), 500, ["vec_id"], digits=6).select("vec_id", "score")
    docs = _t(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    return filters.content_fence(vector.hydrate(hits, docs, ["vec_id"]))[1]


@_register(f"SELECT label::BIGINT AS label, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS n FROM (SELECT label, vec_id, {_SCORE} AS score FROM embeddings)) WHERE n <= 5")
def cross_shard_topk(spark, d):
    e = _t(spark, d, "embeddings")
    return vector.top_k_by(e, _probe(e), 5, "label", ["vec_id"], digits=6).select(F.col("label").cast("long").alias("label"), "vec_id", "score")


@_register(f"SELECT vec_id, {_SCORE} AS score FROM embeddings WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 40")
def file_scoped_rank(spark, d):
    e = _t(spark, d, "embeddings")
    return vector.top_k(e.where("label = 3"), _probe(e), 40, ["vec_id"], digits=6).select("vec_id", "score")


@_register("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS total FROM embeddings")
def vec_normalised(spark, d):
    e = _t(spark, d, "embeddings")
    total = F.aggregate(vectors.normalised(F.col("embedding")), F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(total, 6).alias("total"))


@_register("SELECT vec_id, embedding[1]::DOUBLE AS first, label::BIGINT AS label FROM embeddings WHERE label NOT IN (1, 2) AND vec_id % 10 <> 0 UNION ALL SELECT vec_id + 1000000, embedding[1]::DOUBLE, 99 FROM embeddings WHERE label = 1")
def index_delta(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", F.element_at("embedding", 1).cast("double").alias("first"), F.col("label").cast("long").alias("label"))
    gone = e.where("label in (1, 2)").select("label").distinct()
    new = e.where("label = 1").select((F.col("vec_id") + 1_000_000).alias("vec_id"), "first", F.lit(99).cast("long").alias("label"))
    kept = vector.without(e, e.where("vec_id % 10 = 0").select("vec_id"), ["vec_id"])
    return vector.delta(kept, gone, new, ["label"]).select("vec_id", "first", "label")


_HOLDS = "coalesce(bool_and(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.99), true) AS holds FROM embeddings a JOIN embeddings b ON"


@_register(f"SELECT 'same' AS again, {_HOLDS} a.vec_id = b.vec_id UNION ALL SELECT 'next', {_HOLDS} a.vec_id = b.vec_id - 1 UNION ALL SELECT 'none', true")
def identity_holds(spark, d):
    """All stored vectors against themselves, against those of the next row, and against none."""
    e = _t(spark, d, "embeddings").select("vec_id", "embedding")
    again = {"same": e, "next": e.withColumn("vec_id", F.col("vec_id") - 1), "none": e.limit(0)}
    rows = [vector.identity_holds(e, x, "vec_id").select(F.lit(n).alias("again"), "holds") for n, x in again.items()]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


# ---- filters -------------------------------------------------------------------------------------------------------


@_register("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE levenshtein(lower(n_name), 'nation_99') <= 2")
def fuzzy_name(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    return filters.named(n, ["nation_99"], "n_name")


@_register("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'n_1')")
def exact_name(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    return filters.named(n, ["N_1"], "n_name")


@_register("SELECT lang, count(*) AS n FROM documents WHERE contains(lang, 'e') OR lang = 'fr' GROUP BY lang")
def language_filter(spark, d):
    return _t(spark, d, "documents").where(filters.language_predicate(F.col("lang"), ["e", "FR"])).groupBy("lang").agg(F.count("*").alias("n"))


@_register("SELECT p_partkey, p_type FROM part WHERE p_type IS NULL OR contains(lower(p_type), 'brass') OR contains(lower(p_type), 'eco')")
def kind_filter(spark, d):
    return _t(spark, d, "part").where(filters.kind_predicate(F.col("p_type"), ["brass", "ECO"])).select("p_partkey", "p_type")


@_register("SELECT page_id, url FROM pages WHERE contains(url, '/en/') OR contains(url, 'example.org/')")
def path_filter(spark, d):
    return _t(spark, d, "pages").where(filters.path_predicate(F.col("url"), ["\\en\\", "example.org/"])).select("page_id", "url")


@_register("SELECT page_id FROM pages WHERE contains(lower(url), 'example.net')")
def path_contains(spark, d):
    return filters.path_contains(_t(spark, d, "pages"), "EXAMPLE.net", "url").select("page_id")


@_register("SELECT vec_id, 'f' || vec_id || CASE label WHEN 0 THEN '.md' WHEN 1 THEN '.RST' WHEN 2 THEN '.py' ELSE '.txt.gz' END AS file FROM embeddings WHERE label IN (0, 1)")
def scope_filter(spark, d):
    e = _t(spark, d, "embeddings")
    end = F.when(F.col("label") == 0, ".md").when(F.col("label") == 1, ".RST").when(F.col("label") == 2, ".py").otherwise(".txt.gz")
    files = e.select("vec_id", F.concat(F.lit("f"), F.col("vec_id").cast("string"), end).alias("file"))
    return files.where(filters.scope_predicate(F.col("file"), "docs"))


@_register("""SELECT * FROM (VALUES
 ('find parser kind:Function lang:RUST', 'find parser', 'function', 'rust', '', '', NULL),
 ('name:"parse file" path:src/', 'src/ parse file', '', '', 'src/', 'parse file', NULL),
 ('scope:docs how scope:foo scope:code', 'how scope:foo', '', '', '', '', 'docs'),
 ('LANGUAGE:go', 'go', '', 'go', '', '', NULL), ('plain words', 'plain words', '', '', '', '', NULL)) AS v(query, text, kinds, languages, paths, names, scope)""")
def query_filters(spark, d):
    asked = ["find parser kind:Function lang:RUST", 'name:"parse file" path:src/', "scope:docs how scope:foo scope:code", "LANGUAGE:go", "plain words"]
    rows = []
    for q in asked:
        p = plans.parse(q)
        f = p.filters
        rows.append((q, p.text, *(",".join(x) for x in (f.kinds, f.languages, f.paths, f.names)), f.scope))
    return spark.createDataFrame(rows, "query string, text string, kinds string, languages string, paths string, names string, scope string")


# ---- ranking -------------------------------------------------------------------------------------------------------


@_register("""
WITH r AS (SELECT doc_id, source, n_chars, md5(text) AS k, text FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n_chars DESC, source, doc_id) AS n, first_value(source) OVER (PARTITION BY k ORDER BY n_chars DESC, source, doc_id) AS f FROM r)
SELECT doc_id, source, CASE WHEN n = 1 THEN coalesce((SELECT string_agg(DISTINCT x.source, ',' ORDER BY x.source) FROM r x WHERE x.k = o.k AND x.source <> o.source), '') ELSE '' END AS duplicates FROM o WHERE source = f""")
def dup_collapse(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.col("source").alias("file"), F.col("n_chars").alias("rank"), F.col("text").alias("content"))
    out = ranking.collapse(docs, content=F.col("content"), order=[F.desc("rank"), F.col("file"), F.col("doc_id")])
    return out.select("doc_id", F.col("file").alias("source"), _join("duplicates").alias("duplicates"))


@_register("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1")
def dedup_best(spark, d):
    return ranking.best_of(_t(spark, d, "events"), ["user_id", "event_type"], F.desc("value"), "event_id").select("user_id", "event_type", "event_id", "value")


@_register("""
WITH c AS (SELECT conv_id, turn, length(text) + 1 AS size, least(length(text), 20) + 1 AS small, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations),
w AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY pos) <= 600 AS under FROM c),
f AS (SELECT *, bool_and(under) OVER (PARTITION BY conv_id ORDER BY pos) AS whole FROM w)
SELECT conv_id, pos::BIGINT AS pos, whole AS "full", whole OR sum(CASE WHEN whole THEN size ELSE small END) OVER (PARTITION BY conv_id ORDER BY pos) <= 600 AS shown FROM f""")
def turn_budget(spark, d):
    from pyspark.sql import Window

    c = _t(spark, d, "conversations").withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    out = ranking.within_budget(c, ["conv_id"], "pos", F.length("text") + 1, 600, F.least(F.length("text"), F.lit(20)) + 1)
    return out.select("conv_id", "pos", "full", "shown")


_CHUNKS = """c AS (SELECT l_orderkey, l_linenumber, 'f' || (l_orderkey % 50) || '.py' AS file, (l_orderkey % 400 + l_linenumber * 3)::INT AS line_start, (l_orderkey % 400 + l_linenumber * 3 + (l_quantity / 5)::INT)::INT AS line_end, round(l_extendedprice, 2) AS score FROM lineitem)"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem")
    start = (F.col("l_orderkey") % 400 + F.col("l_linenumber") * 3).cast("int")
    return li.select(
        F.concat(F.lit("f"), (F.col("l_orderkey") % 50).cast("string"), F.lit(".py")).alias("file"),
        start.alias("line_start"),
        (start + F.round(F.col("l_quantity") / 5).cast("int")).alias("line_end"),
        F.round("l_extendedprice", 2).alias("score"),
    )


@_register(f"""
WITH RECURSIVE {_CHUNKS.replace("(l_quantity / 5)::INT", "round(l_quantity / 5)::INT")},
o AS (SELECT file, line_start, line_end, max(score) AS score FROM c GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_start, line_end, score) AS n FROM o),
m(file, n, s, e, score, k) AS (
  SELECT file, n, line_start, line_end, score, 1 FROM p WHERE n = 1
  UNION ALL
  SELECT p.file, p.n, CASE WHEN fits THEN m.s ELSE p.line_start END, CASE WHEN fits THEN greatest(m.e, p.line_end) ELSE p.line_end END, CASE WHEN fits THEN greatest(m.score, p.score) ELSE p.score END, CASE WHEN fits THEN m.k ELSE m.k + 1 END
  FROM (SELECT p.*, p.line_start <= m.e + 2 AND greatest(m.e, p.line_end) - m.s + 1 <= 60 AS fits, m.s, m.e, m.score AS ms, m.k FROM m JOIN p ON p.file = m.file AND p.n = m.n + 1) p JOIN m ON m.file = p.file AND m.n = p.n - 1)
SELECT file, min(s)::BIGINT AS line_start, max(e)::BIGINT AS line_end, max(score) AS score FROM m GROUP BY file, k""")
def interval_merge_capped(spark, d):
    c = _chunks(spark, d).groupBy("file", "line_start", "line_end").agg(F.max("score").alias("score"))
    none = F.lit(None).cast("string")
    full = c.withColumns({"rank": F.col("score"), "content": none, "symbol": none, "symbol_fqn": none, "symbol_kind": none, "duplicates": F.array().cast("array<string>")})
    out = intervals.merged_capped(full, ["file"])
    return out.select("file", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), "score")


_LINES = "i AS (SELECT l_orderkey AS file, l_linenumber * 2 AS ls, l_linenumber * 2 + floor(l_quantity / 10)::INT AS le, l_partkey AS part, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id FROM lineitem)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem")
    start = F.col("l_linenumber") * 2
    return li.select(F.col("l_orderkey").alias("file"), start.alias("ls"), (start + F.floor(F.col("l_quantity") / 10).cast("int")).alias("le"), F.col("l_partkey").alias("part"))


@_register(f"WITH {_LINES} SELECT file, min(ls)::BIGINT AS ls, max(le)::BIGINT AS le, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY ls, le ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN ls <= max(le) OVER (PARTITION BY file ORDER BY ls, le ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM i)) GROUP BY file, k")
def interval_merge_uncapped(spark, d):
    out = intervals.merged(_lines(spark, d), ["file"], "ls", "le", 1, [F.count("*").alias("n")])
    return out.select("file", F.col("ls").cast("long").alias("ls"), F.col("le").cast("long").alias("le"), "n")


@_register(f"WITH {_LINES}, u AS (SELECT DISTINCT file, ls, le FROM i) SELECT file, ls::BIGINT AS ls, le::BIGINT AS le FROM u WHERE NOT EXISTS (SELECT 1 FROM u o WHERE o.file = u.file AND o.ls <= u.ls AND o.le >= u.le AND (o.ls < u.ls OR o.le > u.le))")
def drop_contained(spark, d):
    out = intervals.without_contained(_lines(spark, d), ["file"], "ls", "le")
    return out.select("file", F.col("ls").cast("long").alias("ls"), F.col("le").cast("long").alias("le"))


@_register(f"WITH {_LINES} SELECT a.file, count(*) AS pairs, sum(least(a.le, b.le) - greatest(a.ls, b.ls) + 1)::BIGINT AS shared FROM i a JOIN i b ON a.file = b.file AND b.ls <= a.le AND b.le >= a.ls GROUP BY a.file")
def overlap_join(spark, d):
    a = _lines(spark, d)
    b = a.select("file", F.col("ls").alias("s"), F.col("le").alias("e"))
    both = intervals.overlapping(a, b, ["file"], ("ls", "le", "s", "e"))
    return both.groupBy("file").agg(F.count("*").alias("pairs"), F.sum(F.least("le", "e") - F.greatest("ls", "s") + 1).cast("long").alias("shared"))


@_register(_SQL["overlap_join"])
def overlap_join_bucketed(spark, d):
    a = _lines(spark, d)
    b = a.select("file", F.col("ls").alias("s"), F.col("le").alias("e"))
    both = intervals.overlapping(a, b, ["file"], ("ls", "le", "s", "e"), bucket=4)
    return both.groupBy("file").agg(F.count("*").alias("pairs"), F.sum(F.least("le", "e") - F.greatest("ls", "s") + 1).cast("long").alias("shared"))


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem")
    start = F.col("l_linenumber") * 2
    return li.select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_orderkey").alias("file"), start.alias("ls"), (start + F.floor(F.col("l_quantity") / 10).cast("int")).alias("le"))


_NUMBERED = "i AS (SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_orderkey AS file, l_linenumber * 2 AS ls, l_linenumber * 2 + floor(l_quantity / 10)::INT AS le FROM lineitem)"


@_register(f"WITH {_NUMBERED}, p AS (SELECT file, ls + 1 AS line FROM i GROUP BY ALL), r AS (SELECT p.file, p.line, i.id, row_number() OVER (PARTITION BY p.file, p.line ORDER BY i.le - i.ls, i.ls DESC, i.id DESC) AS n FROM p JOIN i ON p.file = i.file AND i.ls <= p.line AND i.le >= p.line) SELECT p.file, p.line::BIGINT AS line, coalesce(r.id, '<module>') AS enclosing FROM p LEFT JOIN r ON p.file = r.file AND p.line = r.line AND r.n = 1")
def deepest_enclosing(spark, d):
    i = _numbered(spark, d)
    p = i.select("file", (F.col("ls") + 1).alias("line")).distinct().withColumn("k", F.concat_ws(":", "file", "line"))
    outer = i.select("file", F.col("ls").alias("s"), F.col("le").alias("e"), "id")
    out = intervals.enclosing(p.withColumn("line2", F.col("line")), outer, ["file"], "k", ("line", "line2", "s", "e"), "id", F.lit("<module>"))
    return out.select("file", F.col("line").cast("long").alias("line"), "enclosing")


@_register(f"WITH {_NUMBERED}, c AS (SELECT DISTINCT file, ls AS cs, ls + 2 AS ce FROM i) SELECT DISTINCT c.file, cs::BIGINT AS cs, greatest(ls, cs)::BIGINT AS span_start, least(le, ce)::BIGINT AS span_end FROM c JOIN i ON c.file = i.file AND i.ls <= ce AND i.le >= cs WHERE NOT (ls <= cs AND le >= ce)")
def candidate_spans(spark, d):
    i = _numbered(spark, d)
    c = i.select("file", F.col("ls").alias("cs"), (F.col("ls") + 2).alias("ce")).distinct()
    out = intervals.spans(c, i, ["file"], ("cs", "ce", "ls", "le"))
    return out.select("file", *(F.col(x).cast("long").alias(x) for x in ("cs", "span_start", "span_end")))


@_register(f"WITH {_NUMBERED}, c AS (SELECT DISTINCT file, ls + 1 AS cs, ls + 3 AS ce FROM i), r AS (SELECT id, cs, ce, row_number() OVER (PARTITION BY id ORDER BY cs, ce) AS n FROM i JOIN c ON c.file = i.file AND c.cs <= i.le AND c.ce >= i.ls) SELECT id, cs::BIGINT AS cs, ce::BIGINT AS ce FROM r WHERE n = 1")
def first_overlap(spark, d):
    i = _numbered(spark, d)
    c = i.select("file", (F.col("ls") + 1).alias("cs"), (F.col("ls") + 3).alias("ce")).distinct()
    out = intervals.first_overlap(i, c, ["file"], "id", ("ls", "le", "cs", "ce"))
    return out.select("id", F.col("cs").cast("long").alias("cs"), F.col("ce").cast("long").alias("ce"))


@_register(f"""WITH {_NUMBERED}, b AS (SELECT DISTINCT file, file || ':' || ls AS k, ls + 1 AS bs, ls + 2 AS be FROM i),
j AS (SELECT k, id, ls BETWEEN bs AND be AS inside, ls < bs AND le >= bs AS around, le - ls AS len, ls FROM b JOIN i ON b.file = i.file AND ls <= be AND le >= bs),
r AS (SELECT *, bool_or(inside) OVER (PARTITION BY k) AS has_in, row_number() OVER (PARTITION BY k ORDER BY around DESC, len, ls DESC, id) AS n FROM j)
SELECT k, id FROM r WHERE CASE WHEN has_in THEN inside ELSE n = 1 AND around END""")
def block_symbols(spark, d):
    i = _numbered(spark, d)
    b = i.select("file", F.concat_ws(":", "file", "ls").alias("k"), (F.col("ls") + 1).alias("bs"), (F.col("ls") + 2).alias("be")).distinct()
    return intervals.block_symbols(b, i, ["file"], "k", ("bs", "be", "ls", "le"), "id").select("k", "id")


@_register("""SELECT * FROM (VALUES (1, '1-7,10-14'), (2, '4-6'), (3, ''), (4, '1-100')) AS v(k, ranges)""")
def tidy_ranges(spark, d):
    rows = [(1, [(3, 5), (12, 12), (2, 4)]), (2, [(5, 5)]), (3, []), (4, [(1, 60), (50, 99)])]
    last = {1: 14, 2: 6, 3: 9, 4: 100}
    df = spark.createDataFrame([(k, r, 1 if k != 2 else 4, last[k]) for k, r in rows], "k int, r array<struct<start:int,end:int>>, first int, last int")
    tidy = intervals.tidy_ranges(F.col("r"), F.col("first"), F.col("last"))
    return df.select("k", _join(F.transform(tidy, lambda x: F.concat_ws("-", x["start"], x["end"]))).alias("ranges"))


@_register(f"""
WITH e AS (SELECT vec_id, label, {_SCORE} AS score FROM embeddings WHERE label < 5),
h AS (SELECT * FROM e ORDER BY score DESC, vec_id LIMIT 60), j AS (SELECT vec_id, score, source, md5(text) AS content FROM h JOIN documents ON vec_id = doc_id WHERE coalesce(text, '') <> ''),
u AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY score DESC, vec_id) AS n FROM j)
SELECT vec_id, score, source, content FROM u WHERE n = 1 ORDER BY score DESC, vec_id LIMIT 30""")
def retrieve(spark, d):
    """The read path as one plan: scope, top-k, text, fence, one row for each content, order, limit."""
    e = _t(spark, d, "embeddings")
    hits = vector.top_k(e.where("label < 5"), _probe(e), 60, ["vec_id"], digits=6).select("vec_id", "score")
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"), "source")
    kept, _ = filters.content_fence(vector.hydrate(hits, docs, ["vec_id"]))
    one = ranking.best_of(kept.withColumn("content", F.md5("content")), ["content"], F.desc("score"), "vec_id")
    return one.orderBy(F.desc("score"), "vec_id").limit(30).select("vec_id", "score", "source", "content")


# ---- the graph -----------------------------------------------------------------------------------------------------

_CALLS = "calls AS (SELECT 'S:' || l_suppkey AS in_fqn, 'P:' || l_partkey AS out_fqn, l_linenumber AS line, 'd' || (l_suppkey % 5) || '/' || (l_suppkey % 3) AS in_file, 'd' || (l_partkey % 5) || '/' || (l_partkey % 3) AS out_file FROM lineitem)"
_DEGREE = f"{_CALLS}, deg AS (SELECT node, sum(n)::BIGINT AS degree FROM (SELECT in_fqn AS node, count(*) AS n FROM calls GROUP BY 1 UNION ALL SELECT out_fqn, count(*) FROM calls GROUP BY 1) GROUP BY node), hubs AS (SELECT * FROM deg ORDER BY degree DESC, node LIMIT 250)"
_SYMBOLS = "sym AS (SELECT 'S:' || s_suppkey AS fqn, s_name AS name FROM supplier UNION ALL SELECT 'P:' || p_partkey, p_name FROM part WHERE p_partkey % 7 <> 0)"


def _calls(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem")
    f = lambda c: F.concat(F.lit("d"), (F.col(c) % 5).cast("string"), F.lit("/"), (F.col(c) % 3).cast("string"))
    return li.select(F.concat(F.lit("S:"), F.col("l_suppkey").cast("string")).alias("in_fqn"), F.concat(F.lit("P:"), F.col("l_partkey").cast("string")).alias("out_fqn"), F.col("l_linenumber").alias("line"), f("l_suppkey").alias("in_file"), f("l_partkey").alias("out_file"))


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier").select(F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("fqn"), F.col("s_name").alias("name"))
    p = _t(spark, d, "part").where("p_partkey % 7 <> 0").select(F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("fqn"), F.col("p_name").alias("name"))
    return s.unionAll(p).withColumns({"kind": F.lit("function"), "file": F.lit("f"), "line_start": F.lit(1)})


@_register(f"WITH {_DEGREE}, {_SYMBOLS} SELECT node, degree, name FROM hubs JOIN sym ON node = fqn")
def hub_nodes(spark, d):
    return graph.hubs(_calls(spark, d), _symbols(spark, d)).select("node", "degree", "name")


@_register(f"""WITH {_CALLS}, {_SYMBOLS}, a AS (SELECT in_fqn AS node, count(*) AS n FROM calls GROUP BY 1 ORDER BY n DESC, node LIMIT 1000), b AS (SELECT out_fqn AS node, count(*) AS n FROM calls GROUP BY 1 ORDER BY n DESC, node LIMIT 1000),
t AS (SELECT node, sum(n)::BIGINT AS degree FROM (FROM a UNION ALL FROM b) GROUP BY node ORDER BY degree DESC, node LIMIT 250) SELECT node, degree, name FROM t JOIN sym ON node = fqn""")
def hub_nodes_truncated(spark, d):
    return graph.hubs(_calls(spark, d), _symbols(spark, d), truncated=True).select("node", "degree", "name")


@_register(f"WITH {_DEGREE}, {_SYMBOLS}, k AS (SELECT node FROM hubs JOIN sym ON node = fqn) SELECT DISTINCT in_fqn, out_fqn FROM calls WHERE in_fqn IN (FROM k) AND out_fqn IN (FROM k) ORDER BY in_fqn, out_fqn LIMIT 600")
def hub_edges(spark, d):
    c = _calls(spark, d)
    return graph.hub_edges(c, graph.hubs(c, _symbols(spark, d)))


@_register(f"WITH {_DEGREE}, {_SYMBOLS}, k AS (SELECT node FROM hubs JOIN sym ON node = fqn), e AS (SELECT DISTINCT in_fqn, out_fqn FROM calls WHERE in_fqn IN (FROM k) AND out_fqn IN (FROM k) LIMIT 600), n AS (SELECT (SELECT count(*) FROM k) AS a, (SELECT count(*) FROM e) AS b) SELECT a::BIGINT AS n_nodes, b::BIGINT AS n_edges, a >= 250 OR b >= 600 AS truncated FROM n")
def graph_truncated(spark, d):
    c = _calls(spark, d)
    nodes = graph.hubs(c, _symbols(spark, d))
    out = graph.graph_truncated(nodes, graph.hub_edges(c, nodes))
    return out.select(F.col("n_nodes").cast("long").alias("n_nodes"), F.col("n_edges").cast("long").alias("n_edges"), "truncated")


_STATS = """WITH {calls}, e AS (SELECT {own} AS node, {other} AS o, {of} AS f, CASE WHEN {of} = {mf} THEN 0 WHEN split_part({of}, '/', 1) = split_part({mf}, '/', 1) THEN 1 ELSE 2 END AS near FROM calls),
s AS (SELECT node, o, min(near) AS near FROM e GROUP BY ALL), l AS (SELECT node, string_agg(o, ',' ORDER BY near, o) AS names FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY node ORDER BY near, o) <= 30) GROUP BY node)
SELECT e.node, count(DISTINCT o) AS n, count(DISTINCT f) AS files, any_value(names) AS names FROM e JOIN l ON e.node = l.node GROUP BY e.node"""


@_register(_STATS.format(calls=_CALLS, own="out_fqn", other="in_fqn", of="in_file", mf="out_file"))
def caller_stats(spark, d):
    return graph.caller_stats(_calls(spark, d)).withColumn("names", _join("names"))


@_register(_STATS.format(calls=_CALLS, own="in_fqn", other="out_fqn", of="out_file", mf="in_file"))
def callee_stats(spark, d):
    return graph.callee_stats(_calls(spark, d)).withColumn("names", _join("names"))


@_register(f"""WITH {_CALLS}, u AS (SELECT DISTINCT in_fqn, out_fqn FROM calls), seeds AS (SELECT 'S:' || x AS node FROM range(1, 6) t(x)),
l1 AS (SELECT node, max(s) AS s FROM (SELECT out_fqn AS node, 0.5 AS s, row_number() OVER (PARTITION BY in_fqn ORDER BY out_fqn) AS n FROM u WHERE in_fqn IN (FROM seeds)) WHERE n <= 20 GROUP BY node),
l2 AS (SELECT node, max(s) AS s FROM (SELECT in_fqn AS node, l1.s * 0.6 AS s, row_number() OVER (PARTITION BY out_fqn ORDER BY in_fqn) AS n FROM u JOIN l1 ON u.out_fqn = l1.node) WHERE n <= 20 AND node NOT IN (FROM seeds) GROUP BY node)
SELECT node, round(s::DOUBLE, 6) AS score FROM (FROM l1 UNION ALL FROM l2) ORDER BY s DESC, node LIMIT 30""")
def bfs_expand(spark, d):
    seeds = spark.createDataFrame([(f"S:{i}", 1.0) for i in range(1, 6)], "node string, score double")
    return graph.expand(seeds, _calls(spark, d)).select("node", F.round("score", 6).alias("score"))


@_register("""
WITH s AS (SELECT p_partkey::VARCHAR AS fqn, p_type AS name, p_brand AS file, p_size AS ls FROM part),
e AS (SELECT concat_ws(':', l_orderkey, l_linenumber, l_suppkey) AS edge_id, p_brand AS from_file, p_type AS to_name FROM lineitem JOIN part ON l_partkey = p_partkey),
f AS (SELECT name, file, arg_min(fqn, (ls, fqn)) AS fqn FROM s GROUP BY ALL), a AS (SELECT name, arg_min(fqn, (file, ls, fqn)) AS fqn FROM s GROUP BY ALL)
SELECT edge_id, coalesce(f.fqn, a.fqn) AS out_fqn, (CASE WHEN f.fqn IS NULL THEN 4 ELSE 3 END)::BIGINT AS level FROM e JOIN a ON a.name = to_name LEFT JOIN f ON f.name = to_name AND f.file = from_file""")
def resolve_edges(spark, d):
    p = _t(spark, d, "part")
    s = p.select(F.col("p_partkey").cast("string").alias("fqn"), F.col("p_type").alias("name"), F.col("p_brand").alias("file"), F.col("p_size").alias("line_start"), F.col("p_size").alias("line_end"))
    e = _t(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    none = F.lit(None).cast("string")
    e = e.select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_suppkey").alias("edge_id"), F.col("p_brand").alias("from_file"), none.alias("from_fqn"), F.col("p_type").alias("to_name"), F.col("l_linenumber").alias("line"), none.alias("import_path"))
    return graph.resolve(e, s).select("edge_id", "out_fqn", F.col("level").cast("long").alias("level"))


_SYM_ROWS = [("a1", "foo", "src/a/one.py", 3, 5), ("a2", "foo", "src/b/two.py", 1, 2), ("a3", "foo", "src/b/gen_pb2.py", 1, 2), ("b1", "bar", "lib/x_pb2.py", 1, 1), ("b2", "bar", "lib/y.py", 9, 9), ("c1", "baz", "pkg/deep/mod.c", 4, 8), ("c2", "baz", "pkg/other.c", 2, 3)]
_EDGE_ROWS = [(1, "src/b/three.py", "foo", None), (2, "src/b/two.py", "foo", None), (3, "src/b/x.py", "foo", "two"), (4, "lib/z.py", "bar", None), (5, "lib/x_pb2.py", "bar", None), (6, "m.c", "baz", "deep/mod.c"), (7, "m.c", "baz", "nowhere/mod.h"), (8, "q.py", "none", None)]


def _values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


@_register(rf"""
WITH s AS (SELECT *, regexp_matches(file, '_pb2\.py$') AS gen, regexp_extract(file, '^(.*)/[^/]*$', 1) AS dir FROM (VALUES {_values(_SYM_ROWS)}) v(fqn, name, file, ls, le)),
e AS (SELECT * FROM (VALUES {_values(_EDGE_ROWS)}) v(edge_id, from_file, to_name, import_path)),
c AS (SELECT edge_id, fqn, file, ls, CASE WHEN import_path LIKE '%/%' AND ends_with(file, import_path) THEN 1 WHEN import_path NOT LIKE '%/%' AND dir = regexp_extract(from_file, '^(.*)/[^/]*$', 1) THEN 2 WHEN file = from_file THEN 3 ELSE 4 END AS level, gen FROM e JOIN s ON to_name = name)
SELECT edge_id::BIGINT AS edge_id, fqn AS out_fqn, level::BIGINT AS level FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY level, CASE WHEN level = 3 THEN false ELSE gen END, file, ls) AS n FROM c) WHERE n = 1""")
def resolve_levels(spark, d):
    s = spark.createDataFrame(_SYM_ROWS, "fqn string, name string, file string, line_start int, line_end int")
    e = spark.createDataFrame(_EDGE_ROWS, "edge_id long, from_file string, to_name string, import_path string").withColumns({"line": F.lit(1), "from_fqn": F.col("from_file")})
    return graph.resolve(e, s).select("edge_id", "out_fqn", F.col("level").cast("long").alias("level"))


# ---- exploration ---------------------------------------------------------------------------------------------------


@_register("SELECT (SELECT count(*) FROM pages)::BIGINT AS files, (SELECT count(*) FROM embeddings)::BIGINT AS chunks, (SELECT count(*) FROM part)::BIGINT AS symbols, (SELECT max(len(embedding)) FROM embeddings)::BIGINT AS dimensions")
def stats(spark, d):
    return explore.stats(_t(spark, d, "pages"), _t(spark, d, "embeddings"), _t(spark, d, "part"))


@_register("SELECT url FROM pages WHERE url > (SELECT url FROM pages ORDER BY url LIMIT 1 OFFSET 20) ORDER BY url LIMIT 25")
def keyset_page(spark, d):
    p = _t(spark, d, "pages").select("url")
    after = explore.page(p, 21, col="url").agg(F.max("url")).first()[0]
    return explore.page(p, 25, after=after, col="url")


@_register("SELECT url FROM pages WHERE contains(lower(url), '/en/') ORDER BY url LIMIT 40")
def files_page(spark, d):
    return explore.page(_t(spark, d, "pages").select("url"), 40, part="/EN/", col="url")


@_register("SELECT 'x' AS file, vec_id AS line_start, len(embedding)::BIGINT AS dimensions FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 50")
def chunks_of_file(spark, d):
    c = _t(spark, d, "embeddings").where("label = 3").select(F.lit("x").alias("file"), F.col("vec_id").alias("line_start"), F.col("vec_id").alias("line_end"), F.lit("").alias("content"), F.lit("").alias("symbol_fqn"), "embedding")
    return explore.chunks_of(c, "x", 50).select("file", "line_start", F.col("dimensions").cast("long").alias("dimensions"))


_DOC_LINES = "l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS t FROM (SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS x FROM documents))"


@_register(f"WITH {_DOC_LINES} SELECT path, line_no::BIGINT AS line_no, text FROM (SELECT printf('%08d', doc_id) AS path, line_no, t AS text, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM l WHERE regexp_matches(lower(t), 'license|thin\\b')) WHERE n <= 20 ORDER BY path, line_no LIMIT 200".replace("\\\\", "\\"))
def grep(spark, d):
    files = _t(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("path"), F.col("text").alias("content"))
    out = explore.grep(files, r"license|thin\b", ignore_case=True)
    return out.select("path", F.col("line_no").cast("long").alias("line_no"), "text")


@_register(f"""WITH {_DOC_LINES}, z AS (SELECT doc_id, max(line_no) AS z FROM l GROUP BY doc_id),
m AS (SELECT * FROM (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM l WHERE contains(t, 'the (')  OR contains(t, 'and')) WHERE n <= 20 ORDER BY printf('%08d', doc_id), line_no LIMIT 200),
w AS (SELECT doc_id, greatest(line_no - 2, 1) AS s, least(line_no + 2, z) AS e FROM m JOIN z USING (doc_id)),
g AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS f FROM w)
SELECT printf('%08d', doc_id) AS path, min(s)::BIGINT AS line_start, max(e)::BIGINT AS line_end, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM g) GROUP BY doc_id, k""".replace("contains(t, 'the (')  OR ", ""))
def grep_regions(spark, d):
    files = _t(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("path"), F.col("text").alias("content"))
    out = explore.grep_regions(explore.grep(files, "and", literal=True), files)
    return out.select("path", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), "n")


@_register(f"WITH {_DOC_LINES} SELECT line_no::BIGINT AS line_no, t AS text FROM (SELECT *, sum(strlen(t) + 1) OVER (ORDER BY line_no) AS b FROM l WHERE doc_id = 0 AND line_no BETWEEN 2 AND 800) WHERE b <= 1500 OR line_no = 2")
def read_range(spark, d):
    files = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return explore.read_range(files, "0", 2, 900, most_lines=799, most_bytes=1500).select(F.col("line_no").cast("long").alias("line_no"), "text")


@_register(f"WITH {_DOC_LINES}, s AS (SELECT doc_id, string_agg(line_no || ': ' || t, chr(10) ORDER BY line_no) AS x FROM l WHERE line_no BETWEEN 2 AND 4 GROUP BY doc_id) SELECT d.doc_id, coalesce(s.x, '') AS numbered, length(regexp_replace(text, '\\s', '', 'g'))::BIGINT AS nonspace FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id".replace("\\\\", "\\"))
def numbered_lines(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", text.numbered(F.col("text"), 2, 4).alias("numbered"), text.nonspace_length(F.col("text")).cast("long").alias("nonspace"))


@_register(r"""WITH x AS (SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END AS t FROM documents),
k AS (SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda s: regexp_replace(s, '[\s\x{0B}\x{85}\p{Z}]+$', '')), chr(10)) AS k FROM x)
SELECT doc_id, CASE WHEN regexp_matches(k, '[^\s\x{0B}\x{85}\p{Z}]') THEN md5(k) END AS k FROM k""")
def content_keys(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(text.content_key(F.col("text"))).alias("k"))


@_register("""WITH RECURSIVE x AS (SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS l FROM documents WHERE text <> ''),
z AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(list_transform(l, lambda s: length(regexp_replace(s, '\\s', '', 'g')))) AS w FROM x),
m AS (SELECT doc_id, max(i) AS n FROM z GROUP BY doc_id),
r(doc_id, i, first, used) AS (SELECT doc_id, i, 1::BIGINT, w::BIGINT FROM z WHERE i = 1 UNION ALL
  SELECT z.doc_id, z.i, CASE WHEN z.i - r.first >= 2 AND r.used > 300 THEN z.i ELSE r.first END, CASE WHEN z.i - r.first >= 2 AND r.used > 300 THEN z.w ELSE r.used + z.w END FROM r JOIN z ON z.doc_id = r.doc_id AND z.i = r.i + 1)
SELECT doc_id, first::BIGINT AS line_start, max(i)::BIGINT AS line_end FROM r GROUP BY doc_id, first""".replace("\\\\", "\\"))
def line_chunks(spark, d):
    import pandas as pd

    def cut(batches):
        for b in batches:
            rows = [(i, s, e) for i, t in zip(b["doc_id"], b["text"]) for s, e in chunker.windows(t or "", 300)]
            yield pd.DataFrame(rows, columns=["doc_id", "line_start", "line_end"])

    return _t(spark, d, "documents").select("doc_id", "text").mapInPandas(cut, "doc_id long, line_start long, line_end long")


_PATHS = ["src/a.py", "src/A.PB.go", "x/y_test.go", "api/v1.pb.go", "client/x.go", "tests/helper.rb", "lib/FooTest.java", "lib/Latest.java", "app/__generated__/q.ts", "a/b.generated.ts", "node_modules/m/i.js", "Makefile", ".gitignore", "pkg/.hidden/f.py", "dist/app.js", "web/x.spec.tsx", "Proj.Tests/A.cs", "q/moc_w.cpp", "README.md", "notes.TXT", "k.kts", "w.weird", "dir.d/file", "end.", "c\\d\\e.rs", "spec/conftest.py", "m/test_x.c"]


@_register(f"""WITH p AS (SELECT replace(path, chr(92), '/') AS s, path, regexp_extract(replace(path, chr(92), '/'), '([^/]*)$', 1) AS b FROM (VALUES {_values([(p,) for p in _PATHS])}) v(path)),
q AS (SELECT *, regexp_extract(b, '^.+\\.([^.]+)$', 1) AS ext FROM p)
SELECT path, lower(CASE WHEN ext = '' THEN b ELSE ext END) AS ext_key,
  regexp_matches(s, '(\\.pb\\.go$)|(_test_never)|(ent/[^/]+\\.go$)|(__generated__/)|(\\.generated\\.(ts|js|tsx|jsx)$)|(node_modules/)|(dist/[^/]+\\.(js|mjs|cjs)$)|(moc_[^/]+\\.cpp$)') AS is_generated,
  regexp_matches(lower(s), '(^|/)(test|tests|__tests__|__mocks__|spec|[^/]*\\.tests)/') OR regexp_matches(lower(b), '(_test\\.go|\\.(test|spec)\\.(js|jsx|ts|tsx)|^conftest\\.py|^test_.*\\.(py|c|cc|cpp))$') OR regexp_matches(b, 'Tests?\\.(java|kt|cs)$') AS is_test,
  CASE ext WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'rb' THEN 'ruby' WHEN 'java' THEN 'java' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'js' THEN 'javascript' WHEN 'cs' THEN 'csharp' WHEN 'cpp' THEN 'cpp' WHEN 'c' THEN 'c' WHEN 'kts' THEN 'kotlin' WHEN 'rs' THEN 'rust' ELSE 'other' END AS language,
  regexp_extract(s, '^(.*)/[^/]*$', 1) AS dir FROM q""".replace("\\\\", "\\"))
def path_classes(spark, d):
    p = spark.createDataFrame([(p,) for p in _PATHS], "path string")
    c = F.col("path")
    return p.select("path", paths.ext_key(c).alias("ext_key"), paths.is_generated(c).alias("is_generated"), paths.is_test_path(c).alias("is_test"), paths.language(c).alias("language"), paths.parent_dir(c).alias("dir"))


_WALK = ["/r/src/a.py", "/r/build/x.py", "/r/.git/config.txt", "/r/.env", "/r/.eslintrc.json", "/r/Dockerfile", "/r/sub/vendor/q.go", "/r/x.bin", "/rr/a.py", "/r/docs/.hidden.md"]


@_register("SELECT * FROM (VALUES ('/r/src/a.py'), ('/r/.eslintrc.json'), ('/r/Dockerfile'), ('/r/docs/.hidden.md')) v(path)")
def walkable(spark, d):
    return explore.walkable(spark.createDataFrame([(p,) for p in _WALK], "path string"), "/r/")


# ---- changes -------------------------------------------------------------------------------------------------------


@_register("""WITH s AS (SELECT doc_id, n_chars AS m, n_chars AS z FROM documents WHERE doc_id % 5 <> 0), c AS (SELECT doc_id, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS m, n_chars AS z FROM documents WHERE doc_id % 3 <> 0)
SELECT coalesce(s.doc_id, c.doc_id)::VARCHAR AS path, CASE WHEN s.doc_id IS NULL THEN 'added' WHEN c.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM s FULL JOIN c ON s.doc_id = c.doc_id WHERE s.doc_id IS NULL OR c.doc_id IS NULL OR s.m <> c.m OR s.doc_id % 11 = 0""")
def snapshot_diff(spark, d):
    docs = _t(spark, d, "documents")
    p = F.col("doc_id").cast("string").alias("path")
    stored = docs.where("doc_id % 5 <> 0").select(p, F.col("n_chars").alias("mtime"), F.col("n_chars").alias("size"), F.when(F.col("doc_id") % 11 == 0, 1).otherwise(2).alias("chunker_version"))
    current = docs.where("doc_id % 3 <> 0").select(p, (F.col("n_chars") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("mtime"), F.col("n_chars").alias("size"))
    return incremental.snapshot_diff(stored, current, version=2)


_VERSIONS = "b AS (SELECT DISTINCT p_brand AS file, p_type || p_size AS name, p_brand || '::' || p_type || p_size AS fqn FROM part WHERE p_partkey % 6 <> 0), a AS (SELECT DISTINCT p_brand AS file, p_type || p_size AS name, p_brand || '::' || p_type || p_size AS fqn FROM part WHERE p_partkey % 4 <> 0), dl AS (SELECT *, 'removed' AS change FROM (FROM b EXCEPT FROM a) UNION ALL SELECT *, 'added' FROM (FROM a EXCEPT FROM b))"


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = _t(spark, d, "part")
    of = lambda m: p.where(F.col("p_partkey") % m != 0).select(F.col("p_brand").alias("file"), F.concat("p_type", "p_size").alias("name"), F.concat(F.col("p_brand"), F.lit("::"), F.col("p_type"), F.col("p_size")).alias("fqn"))
    return of(6), of(4)


@_register(f"WITH {_VERSIONS} SELECT file, name, fqn, change FROM dl")
def surface_delta(spark, d):
    return incremental.surface_delta(*_versions(spark, d))


_EDGES = "e AS (SELECT p_brand AS in_file, 'Brand#' || (l_suppkey % 5 + 1) || (l_suppkey % 4 + 1) AS out_file, p_type || p_size AS to_name FROM lineitem JOIN part ON l_partkey = p_partkey)"


@_register(f"WITH {_VERSIONS}, {_EDGES} SELECT DISTINCT file FROM (SELECT 'Brand#11' AS file UNION ALL SELECT in_file FROM e WHERE out_file IN (SELECT file FROM dl WHERE change = 'removed' AND name LIKE 'ECONOMY%') UNION ALL SELECT in_file FROM e WHERE to_name IN (SELECT name FROM dl WHERE change = 'added' AND name LIKE 'ECONOMY%'))")
def blast_radius(spark, d):
    delta = incremental.surface_delta(*_versions(spark, d)).where("name like 'ECONOMY%'")
    e = _t(spark, d, "lineitem").join(_t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    e = e.select(F.col("p_brand").alias("in_file"), F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 5 + 1).cast("string"), (F.col("l_suppkey") % 4 + 1).cast("string")).alias("out_file"), F.concat("p_type", "p_size").alias("to_name"), F.col("p_brand").alias("from_file"))
    changed = spark.createDataFrame([("Brand#11",)], "file string")
    return incremental.blast_radius(changed, delta, e, e)


_RE = """
WITH s AS (SELECT p_partkey::VARCHAR AS fqn, p_type AS name, p_brand AS file, p_size AS ls FROM part WHERE p_partkey % 4 <> 0),
e AS (SELECT concat_ws(':', l_orderkey, l_linenumber, l_suppkey) AS edge_id, p_brand AS from_file, p_type AS to_name, l_linenumber AS line FROM lineitem JOIN part ON l_partkey = p_partkey),
f AS (SELECT name, file, arg_min(fqn, (ls, fqn)) AS fqn FROM s GROUP BY ALL), a AS (SELECT name, arg_min(fqn, (file, ls, fqn)) AS fqn FROM s GROUP BY ALL)
SELECT edge_id AS in_fqn, coalesce(f.fqn, a.fqn) AS out_fqn FROM e JOIN a ON a.name = to_name LEFT JOIN f ON f.name = to_name AND f.file = from_file"""


@_register(_RE)
def incremental_resolve(spark, d):
    """The old graph with only the affected files resolved again; the SQL resolves everything anew."""
    p = _t(spark, d, "part")
    of = lambda m: p.where(F.col("p_partkey") % m != 0).select(F.col("p_partkey").cast("string").alias("fqn"), F.col("p_type").alias("name"), F.col("p_brand").alias("file"), F.col("p_size").alias("line_start"), F.col("p_size").alias("line_end"))
    before, after = of(6), of(4)
    e = _t(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_suppkey")
    raw = e.select(key.alias("edge_id"), F.col("p_brand").alias("from_file"), key.alias("from_fqn"), F.col("p_type").alias("to_name"), F.col("l_linenumber").alias("line"), F.lit(None).cast("string").alias("import_path"))
    old = graph.resolve(raw, before).select("in_fqn", "out_fqn", "line", "in_file", "out_file")
    delta = incremental.surface_delta(before, after)
    radius = incremental.blast_radius(delta.select("file").distinct(), delta, old, raw)
    return incremental.re_resolved(old, radius, raw, after).select("in_fqn", "out_fqn")


@_register("SELECT doc_id, doc_id % 3 = 0 AS hit FROM documents d WHERE md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0) AND doc_id % 3 = 0 UNION ALL SELECT doc_id, true FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0) AND doc_id % 3 <> 0 UNION ALL SELECT doc_id, false FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0)")
def cache_split(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    known = docs.where("doc_id % 3 = 0").select(F.md5("content").alias("key"), F.array(F.lit(1.0).cast("float")).alias("embedding")).dropDuplicates(["key"])
    hits, misses = cache.split(docs, known)
    return hits.select("doc_id", F.lit(True).alias("hit")).unionAll(misses.select("doc_id", F.lit(False)))


@_register("SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') AND o_orderstatus <> 'F'")
def delete_files(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    gone = spark.createDataFrame([("1-URGENT",), ("5-LOW",), ("F",)], "path string")
    return incremental.without_files(o, gone, ["o_orderpriority", "o_orderstatus"]).select("o_orderkey")


@_register("SELECT p_type, p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_size DESC, p_partkey DESC) AS n FROM part) WHERE n = 1")
def upsert(spark, d):
    return incremental.upserted(_t(spark, d, "part"), ["p_type", "p_brand"], "p_size", "p_partkey").select("p_type", "p_brand", "p_partkey")


@_register("SELECT path, change FROM (SELECT user_id::VARCHAR AS path, arg_max(CASE event_type WHEN 'click' THEN 'added' WHEN 'view' THEN 'modified' ELSE 'deleted' END, event_id) AS change FROM events GROUP BY user_id)")
def coalesced_changes(spark, d):
    kind = F.when(F.col("event_type") == "click", "create").when(F.col("event_type") == "view", "modify").otherwise("remove")
    ev = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), kind.alias("event"), F.col("event_id").alias("seq"))
    return streams.coalesced(streams.as_changes(ev))


@_register("SELECT DISTINCT url AS path FROM pages WHERE regexp_matches(url, '^https?://[^/]+/(en|de)/')")
def paths_under(spark, d):
    p = _t(spark, d, "pages").select(F.col("url").alias("path"))
    tops = p.select(F.regexp_extract("path", "^(https?://[^/]+/(en|de))/", 1).alias("dir")).where("dir <> ''").distinct()
    return incremental.under(p, tops)


@_register("""WITH c AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0), h AS (SELECT doc_id FROM documents WHERE doc_id % 3 = 0), s AS (SELECT doc_id FROM documents WHERE doc_id % 5 = 0)
SELECT c.doc_id::VARCHAR AS path, CASE WHEN h.doc_id IS NOT NULL AND s.doc_id IS NOT NULL THEN 'modified' WHEN h.doc_id IS NOT NULL THEN 'added' ELSE 'deleted' END AS change FROM c LEFT JOIN h ON c.doc_id = h.doc_id LEFT JOIN s ON c.doc_id = s.doc_id WHERE h.doc_id IS NOT NULL OR s.doc_id IS NOT NULL""")
def normalised_changes(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"))
    return incremental.normalised(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 3 = 0").select("path"), docs.where("doc_id % 5 = 0").select("path"))


@_register("SELECT doc_id::VARCHAR AS path, 'added' AS change FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id::VARCHAR, 'modified' FROM documents WHERE doc_id % 6 = 0 AND doc_id % 4 <> 0")
def retry_queue(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"))
    return incremental.retried(docs.where("doc_id % 6 = 0"), docs.where("doc_id % 4 = 0").withColumn("change", F.lit("added")))


# ---- figures -------------------------------------------------------------------------------------------------------


@_register("""WITH c AS (SELECT doc_id AS case_id, 'f' || (doc_id % 10) AS file, doc_id % 40 AS s, doc_id % 40 + 10 AS e FROM labels WHERE quality = 1),
r AS (SELECT doc_id AS case_id, 'F' || ((doc_id * k) % 10) AS file, (doc_id * k) % 40 AS rs, (doc_id * k) % 40 + 8 AS re, k - 1 AS pos FROM labels, range(1, 13) t(k) WHERE quality = 1),
b AS (SELECT c.case_id, min(pos) AS pos, max((least(e, re) - greatest(s, rs) + 1)::DOUBLE / ((e - s + 1) + (re - rs + 1) - (least(e, re) - greatest(s, rs) + 1))) AS ratio FROM c JOIN r ON c.case_id = r.case_id AND lower(r.file) = c.file AND rs <= e AND re >= s GROUP BY c.case_id)
SELECT count(*) AS cases, round(avg(CASE WHEN pos < 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN pos < 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN pos < 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(coalesce(ratio, 0)), 6) AS mean_ratio FROM c LEFT JOIN b ON c.case_id = b.case_id""")
def recall(spark, d):
    lab = _t(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("case_id"))
    cases = lab.select("case_id", F.concat(F.lit("f"), (F.col("case_id") % 10).cast("string")).alias("file"), (F.col("case_id") % 40).alias("line_start"), (F.col("case_id") % 40 + 10).alias("line_end"))
    rank = lab.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(12))))
    at = F.col("case_id") * F.col("k")
    rank = rank.select("case_id", F.concat(F.lit("F"), (at % 10).cast("string")).alias("file"), (at % 40).alias("r_start"), (at % 40 + 8).alias("r_end"), (F.col("k") - 1).alias("pos"))
    out = metrics.recall(cases, rank)
    return out.select("cases", *(F.round(c, 6).alias(c) for c in ("recall_1", "recall_5", "recall_10", "mean_ratio")))


@_register("SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS \"max\" FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency(spark, d):
    return metrics.latency(_t(spark, d, "events"), "value", ("event_type",))


@_register(f"""WITH {_NUMBERED}, c AS (SELECT DISTINCT file, ls AS s, ls + 1 AS e, (file % 3)::VARCHAR AS t FROM i), 
o AS (SELECT count(*) AS n_over FROM (SELECT s <= max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x FROM c) WHERE x),
h AS (SELECT i.id, coalesce(bool_or(c.s <= i.ls AND c.e >= i.le), false) AS whole FROM i LEFT JOIN c ON c.file = i.file AND c.s <= i.le AND c.e >= i.ls GROUP BY i.id),
p AS (SELECT c.file, c.s, c.e, count(i.id) AS n FROM c LEFT JOIN i ON c.file = i.file AND i.ls <= c.e AND i.le >= c.s GROUP BY ALL)
SELECT (SELECT count(*) FROM c)::BIGINT AS chunks, round((SELECT 1.0 - count(DISTINCT t)::DOUBLE / count(*) FROM c), 6) AS copies, (SELECT n_over FROM o)::BIGINT AS "overlaps", round((SELECT avg(CASE WHEN whole THEN 0.0 ELSE 1.0 END) FROM h), 6) AS cut,
 (SELECT count(*) FROM p WHERE n = 0)::BIGINT AS with_0, (SELECT count(*) FROM p WHERE n = 1)::BIGINT AS with_1, (SELECT count(*) FROM p WHERE n = 2)::BIGINT AS with_2, (SELECT count(*) FROM p WHERE n >= 3)::BIGINT AS with_3""")
def chunk_shape(spark, d):
    i = _numbered(spark, d)
    s = i.select("file", F.col("ls").alias("line_start"), F.col("le").alias("line_end"), F.col("id").alias("fqn"))
    c = i.select("file", F.col("ls").alias("line_start"), (F.col("ls") + 1).alias("line_end"), (F.col("file") % 3).cast("string").alias("content")).distinct()
    out = metrics.chunk_shape(c, s)
    return out.select("chunks", F.round("copies", 6).alias("copies"), F.col("overlaps").cast("long").alias("overlaps"), F.round("cut", 6).alias("cut"), *(F.col(f"with_{k}").cast("long").alias(f"with_{k}") for k in range(4)))


@_register("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM labels) WHERE p IN (SELECT (i * n) // 37 FROM range(0, 37) t(i), (SELECT count(*) AS n FROM labels))")
def strided_sample(spark, d):
    return metrics.strided(_t(spark, d, "labels").select("doc_id"), ["doc_id"], 37)


@_register("SELECT doc_id AS case_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 7 END AS before, doc_id % 6 AS after, CASE WHEN doc_id % 5 = 0 THEN 'only_after' WHEN doc_id % 6 < doc_id % 7 THEN 'better' WHEN doc_id % 6 > doc_id % 7 THEN 'worse' ELSE 'same' END AS status FROM labels")
def compare_runs(spark, d):
    lab = _t(spark, d, "labels").select(F.col("doc_id").alias("case_id"))
    return metrics.compared(lab.where("case_id % 5 <> 0").withColumn("pos", F.col("case_id") % 7), lab.withColumn("pos", F.col("case_id") % 6))


# ---- sources, frameworks, imports -----------------------------------------------------------------------------------


@_register("SELECT page_id, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))::BIGINT AS n_links, coalesce(array_to_string(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), ','), '') AS links FROM pages")
def page_links(spark, d):
    links = F.regexp_extract_all(F.col("html"), F.lit('<a href="([^"]*)"'), F.lit(1))
    return _t(spark, d, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), _join(links).alias("links"))


_REPO = [
    ("package.json", '{"dependencies": {"react": "1", "express": "2"}}'),
    ("go.mod", "module m\nrequire github.com/gin-gonic/gin v1"),
    ("src/app.js", "const app = express();\nfunction start() {\n  app.get('/x', listUsers);\n  app.use(auth);\n}\n"),
    ("src/view.tsx", "export function Page() {\n  return <Card title='x' />;\n}\n"),
    ("urls.py", "urlpatterns = [path('a', views.index), path('b', Detail.as_view())]\n"),
    ("api.go", 'package api\nfunc Routes(r *gin.Engine) {\n  r.GET("/u", handlers.ListUsers)\n}\n'),
    ("svc.py", "class A:\n    def f(self):\n        g(1)\n\ndef g(x):\n    return x\n"),
]


@_register("SELECT true AS react, true AS express, false AS django, false AS spring, true AS gin")
def frameworks_detected(spark, d):
    return frameworks.detected(spark.createDataFrame(_REPO, "path string, content string"))


@_register("""SELECT * FROM (VALUES ('src/app.js', 'start', 'listUsers', 3, NULL), ('src/app.js', 'start', 'auth', 4, NULL), ('src/view.tsx', 'Page', 'Card', 2, NULL), ('urls.py', '<module>', 'index', 1, NULL), ('urls.py', '<module>', 'Detail', 1, NULL), ('urls.py', '<module>', 'Detail', 1, NULL), ('api.go', 'Routes', 'ListUsers', 3, 'handlers'))
 v(path, name, to_name, line, import_path)""".replace("3, NULL)", "3::BIGINT, NULL)", 1))
def framework_edges(spark, d):
    files = spark.createDataFrame([(p, c.encode()) for p, c in _REPO], "path string, content binary")
    made = parse.parsed(files, ["react", "express", "django", "spring", "gin"]).where("kind = 'edge'")
    known = "to_name in ('listUsers', 'auth', 'Card', 'index', 'Detail', 'ListUsers')"
    return made.where(known).select("path", "name", "to_name", F.col("line_start").cast("long").alias("line"), "import_path")


@_register("""SELECT * FROM (VALUES ('api.go', 'symbol', 'Routes', 'function', 'api.go::Routes', NULL, 2, 4, NULL), ('api.go', 'edge', 'Routes', NULL, 'api.go::Routes', NULL, 3, 3, 'r.GET'),
('src/app.js', 'symbol', 'start', 'function', 'src/app.js::start', NULL, 2, 5, NULL), ('src/app.js', 'edge', 'start', NULL, 'src/app.js::start', NULL, 3, 3, 'app.get'), ('src/app.js', 'edge', 'start', NULL, 'src/app.js::start', NULL, 4, 4, 'app.use'),
('src/view.tsx', 'symbol', 'Page', 'function', 'src/view.tsx::Page', NULL, 1, 3, NULL), ('svc.py', 'symbol', 'A', 'class', 'svc.py::A', NULL, 1, 3, NULL), ('svc.py', 'symbol', 'f', 'method', 'svc.py::A::f', 'svc.py::A', 2, 3, NULL),
('svc.py', 'symbol', 'g', 'function', 'svc.py::g', NULL, 5, 6, NULL), ('svc.py', 'edge', 'f', NULL, 'svc.py::A::f', NULL, 3, 3, 'g')) v(path, kind, name, symbol_kind, fqn, parent_fqn, line_start, line_end, to_name)""")
def parsed_repository(spark, d):
    files = spark.createDataFrame([(p, c.encode()) for p, c in _REPO], "path string, content binary")
    rows = parse.parsed(files).where("kind in ('symbol', 'edge')")
    return rows.select("path", "kind", "name", "symbol_kind", "fqn", "parent_fqn", "line_start", "line_end", "to_name")


_IMPORTS = [(1, "typescript", "./util", "src/a.ts"), (2, "typescript", "@/lib/x", "src/a.ts"), (3, "python", "pkg.mod", "main.py"), (4, "python", "..base", "pkg/sub/m.py"), (5, "rust", "crate::net::tcp", "src/main.rs"), (6, "go", "m/handlers", "main.go"), (7, "javascript", "./none", "src/a.ts")]
_FILES = ["src/util/index.ts", "src/util.ts", "lib/x.tsx", "app/pkg/mod.py", "pkg/base.py", "src/net/tcp.rs", "handlers/a.go", "handlers/b.go"]


@_register("SELECT edge_id::BIGINT AS edge_id, file FROM (VALUES (1, 'src/util.ts'), (2, 'lib/x.tsx'), (3, 'app/pkg/mod.py'), (4, 'pkg/base.py'), (5, 'src/net/tcp.rs'), (6, 'handlers/a.go')) v(edge_id, file)")
def import_paths(spark, d):
    i = spark.createDataFrame(_IMPORTS, "edge_id long, language string, import_path string, from_file string")
    f = spark.createDataFrame([(x,) for x in _FILES], "file string")
    return imports.resolved(i, f, module="m", aliases={"@/*": ["*"]})


@_register("SELECT edge_id::BIGINT AS edge_id, file FROM (VALUES (1, 'd.ts'), (2, 'c.ts')) v(edge_id, file)")
def reexport_chase(spark, d):
    start = spark.createDataFrame([(1, "a.ts", "X"), (2, "a.ts", "Y")], "edge_id long, file string, name string")
    ex = spark.createDataFrame([("a.ts", "X", "b.ts"), ("a.ts", "*", "c.ts"), ("b.ts", "*", "d.ts")], "file string, name string, target string")
    return imports.chased(start, ex)


# ---- small pools: what tables of the data folder can't stand in for ----------------------------------------------------


@_register("SELECT * FROM (VALUES (1, 0.9), (2, 0.9), (3, 0.85), (4, 1.0), (5, 0.9), (6, 1.0)) v(id, weight)".replace("0.9)", "0.9::DOUBLE)", 1))
def class_weights(spark, d):
    rows = [(1, "/r/a.css", ".x {}"), (2, "/r/src/x.test.ts", "jest.mock('a')"), (3, "/r/i.ts", "import a from 'b'\n"), (4, "/r/i.ts", "foo()"), (5, "/r/__mocks__/m.js", "x()"), (6, "/r/src/x.ts", "jest.mock('a')")]
    df = spark.createDataFrame(rows, "id int, file string, content string")
    return df.select("id", ranking.class_weight(F.col("file"), F.col("content"), ["how does it work"], plans.Filters(), ["/r"]).alias("weight"))


_SCRIPTS = ["import a from 'b'", 'import {a} from "x";\n// c\nexport * from "y"', "import a from 'b'; f()", "'use strict'", "const x = require('y')", "f()", "import type {T} from 't'\nimport 'side'"]


@_register("SELECT * FROM (VALUES (0, true), (1, true), (2, false), (3, false), (4, true), (5, false), (6, true)) v(id, import_only)")
def import_only_chunks(spark, d):
    from corvid.functions.imports import import_only

    return spark.createDataFrame(list(enumerate(_SCRIPTS)), "id int, content string").select("id", import_only(F.col("content")).alias("import_only"))


@_register("SELECT * FROM (VALUES ('c.py', 5, 9, 0.5::DOUBLE, 1.0::DOUBLE, ''), ('a.py', 1, 2, 0.9, 0.9, 'b.py'), ('d.py', 1, 6, 0.3, 0.3, '')) v(file, line_start, line_end, score, rank, duplicates)")
def weighted_merge(spark, d):
    rows = [("b.py", 1, 2, 0.9, "same\ntext"), ("a.py", 1, 2, 0.9, "same  \r\ntext"), ("c.py", 5, 9, 0.5, "other"), ("c.py", 5, 9, 0.2, "older"), ("c.py", 6, 7, 0.4, "inner"), ("d.py", 1, 3, 0.3, "1\n2\n3"), ("d.py", 4, 6, 0.1, "4\n5\n6")]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], "file string, line_start int, line_end int, score double, content string, symbol string, symbol_fqn string, symbol_kind string")
    out = ranking.weighted_merge(df, 10, F.when(F.col("file") == "c.py", 2.0).otherwise(1.0))
    return out.select("file", "line_start", "line_end", "score", "rank", _join("duplicates").alias("duplicates"))


@_register("SELECT * FROM (VALUES ('a', 1, 9, 0, 7, 'y'), ('a', 20, 21, 1, NULL, NULL), ('b', 1, 2, 2, 3, 'z')) v(file, line_start, line_end, pos, callers, caller_names)")
def merged_blocks(spark, d):
    rows = [(0, "a", 1, 5, 2, 1, ["x"]), (3, "a", 6, 9, 7, 2, ["y"]), (1, "a", 20, 21, None, None, None), (2, "b", 1, 2, 3, 1, ["z"])]
    df = spark.createDataFrame(rows, "pos int, file string, line_start int, line_end int, callers int, caller_files int, caller_names array<string>")
    return ranking.merged_blocks(df).select("file", "line_start", "line_end", "pos", "callers", _join("caller_names").alias("caller_names"))


@_register("SELECT * FROM (VALUES ('a', 1, 10), ('b', 2, 3), ('b', 9, 9), ('c', 1, 30)) v(file, line_start, line_end)")
def pruned_rows(spark, d):
    df = spark.createDataFrame([("a", 1, 10, [(2, 3)]), ("b", 1, 30, [(2, 3), (9, 9)]), ("c", 1, 30, None)], "file string, line_start int, line_end int, ranges array<struct<start:int,end:int>>")
    return ranking.pruned_rows(df)


_LONGEST = "p AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS pos FROM documents QUALIFY pos < {k})"


def _longest(spark: SparkSession, d: str, k: int) -> DataFrame:
    """A pool for ranking: the k longest texts of the whole table, in places from 0."""
    from pyspark.sql import Window

    order = [F.desc("n_chars"), F.col("doc_id")]
    top = _t(spark, d, "documents").select("doc_id", "n_chars").orderBy(*order).limit(k)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("long") - 1)


@_register(f"WITH {_LONGEST.format(k=30)} SELECT row_number() OVER (ORDER BY n_chars % 10 DESC, pos) - 1 AS pos, doc_id, (n_chars % 10) / 10.0::DOUBLE AS relevance FROM p")
def reranked(spark, d):
    return ranking.rerank(_longest(spark, d, 30), "q", lambda q, rows: [(r["n_chars"] % 10) / 10 for r in rows]).select("pos", "doc_id", "relevance")


@_register(f"WITH {_LONGEST.format(k=30)} SELECT pos, doc_id, NULL::DOUBLE AS relevance FROM p")
def rerank_degraded(spark, d):
    """A scorer that fails leaves the order as it is."""
    return ranking.rerank(_longest(spark, d, 30), "q", lambda q, rows: [1.0]).select("pos", "doc_id", "relevance")


@_register("SELECT * FROM (VALUES ('/Foo/bar/a.py', false, 'a.py'), ('/foobar/a.py', false, 'a.py'), ('/foo/bar/test/b.py', true, 'test/b.py'), ('/foo', true, 'foo'), ('/foo\\x.c', true, 'x.c')) v(file, inside, relative)")
def repo_paths(spark, d):
    df = spark.createDataFrame([("/Foo/bar/a.py",), ("/foobar/a.py",), ("/foo/bar/test/b.py",), ("/foo",), ("/foo\\x.c",)], "file string")
    return df.select("file", paths.in_repo(F.col("file"), "/foo/").alias("inside"), paths.repo_relative(F.col("file"), ["/foo", "/foo/bar"]).alias("relative"))


@_register("SELECT vec_id, list_sum(list_transform(embedding, lambda x: abs(round(x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * 127))))::BIGINT AS total FROM embeddings")
def vec_quantised(spark, d):
    q = vectors.quantised(vectors.normalised(F.col("embedding")))
    return _t(spark, d, "embeddings").select("vec_id", F.aggregate(q, F.lit(0), lambda a, x: a + F.abs(x.cast("int"))).cast("long").alias("total"))


@_register("SELECT page_id FROM pages WHERE contains(url, '/en/')")
def all_filters(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.concat("url", F.lit("x.py")).alias("file"), F.lit("parse_file").alias("symbol"), F.lit(None).cast("string").alias("symbol_kind"))
    return filters.apply(p, plans.Filters(kinds=["class"], languages=["py"], paths=["/en/"], names=["parse"])).select("page_id")


@_register("SELECT * FROM (VALUES (1, 'f', 'callers: a, b +1 more'), (2, 'g', ''), (3, 'x.py', 'callers: z')) v(id, short, tag)")
def name_tags(spark, d):
    df = spark.createDataFrame([(1, "x.py::C::f", ["a", "b", "c"]), (2, "x.py::g", []), (3, "x.py", ["z"])], "id int, fqn string, names array<string>")
    return df.select("id", text.short_name(F.col("fqn")).alias("short"), text.name_tag("callers", F.col("names"), 2).alias("tag"))


@_register("SELECT DISTINCT url AS path FROM pages WHERE contains(lower(url), 'example.org')")
def ignored_paths(spark, d):
    return explore.ignored(_t(spark, d, "pages").select(F.col("url").alias("path")), "Example.ORG")


@_register("SELECT doc_id, md5(text) AS content FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def point_lookups(spark, d):
    """All lookups of a query as one join by key."""
    keys = _t(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    docs = _t(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return vector.hydrate(keys, docs, ["doc_id"]).select("doc_id", F.md5("content").alias("content"))


@_register("SELECT vec_id FROM embeddings WHERE label % 2 = 0")
def identity_fence(spark, d):
    e = _t(spark, d, "embeddings").withColumns({"provider": F.lit("p"), "model": F.when(F.col("label") % 2 == 0, "m").otherwise("n"), "dims": F.size("embedding")})
    return vector.same_identity(e, "p", "m", 64).select("vec_id")


@_register(f"WITH {_LONGEST.format(k=40)} SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END, pos) AS place FROM p")
def hand_written_first(spark, d):
    """The operator orders rows; what is compared is the place that each row gets."""
    docs = _longest(spark, d, 40)
    docs = docs.select("doc_id", "pos", F.concat(F.lit("a/"), F.col("doc_id"), F.when(F.col("doc_id") % 4 == 0, "_pb2.py").otherwise(".py")).alias("file"))
    from pyspark.sql import Window

    placed = ranking.hand_written_first(docs).withColumn("at", F.monotonically_increasing_id())
    return placed.select("doc_id", F.row_number().over(Window.orderBy("at")).cast("long").alias("place"))


@_register("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def cache_purge(spark, d):
    o = _t(spark, d, "orders").withColumn("used_at", F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    return cache.purged(o, 820454400).select("o_orderkey")


@_register()
def cached_vectors(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    embed = cache.hashing_embedder(16)
    known = cache.embedded(docs.where("doc_id % 3 = 0").select("content").distinct(), embed).select(F.md5("content").alias("key"), "embedding")
    return cache.with_vectors(docs, known, embed).select("doc_id", F.round(F.element_at("embedding", 1).cast("double"), 5).alias("first"))


# ---- replies, hints, cases, ids ------------------------------------------------------------------------------------------

_REPLIES = ["so <ranked_indices>[2, 0]</ranked_indices>", "```json\n[1]\n```", '[{"chunk_index": 2, "lines": [[110, 112], [114, 115], [159, 400]]}, 9, {"i": 1, "lines": [[12, 13]]}]', "[]", "no idea"]


@_register("SELECT * FROM (VALUES (0, 0, 2, ''), (0, 1, 0, ''), (1, 0, 1, ''), (2, 0, 2, '108-117,157-160'), (2, 1, 1, ''), (4, 0, 0, ''), (4, 1, 1, ''), (4, 2, 2, '')) v(reply, pos, block, ranges)")
def rerank_replies(spark, d):
    rows = [(k, pos, at, ",".join(f"{a}-{b}" for a, b in r or [])) for k, x in enumerate(_REPLIES) for got in [replies.read(x, [(1, 40), (10, 20), (100, 160)])] for pos, (at, r) in enumerate(zip(got.order, got.ranges))]
    return spark.createDataFrame(rows, "reply int, pos int, block int, ranges string")


@_register(f"WITH {_LONGEST.format(k=30)}, r AS (SELECT pos AS old, doc_id, row_number() OVER (ORDER BY n_chars % 10 DESC, pos) - 1 AS pos FROM p) SELECT pos, doc_id, CASE WHEN old % 3 = 0 THEN '1-' || (old + 5) || ',40-45' ELSE '' END AS ranges FROM r")
def narrowed(spark, d):
    """The longest texts by probability; every third has spans, of which two overlap and one is improbable."""
    top = _longest(spark, d, 30)
    rows = top.orderBy("pos").collect()
    spans = [[(1, r.pos + 3), (r.pos + 2, r.pos + 5), (40, 45), (60, 70)] if r.pos % 3 == 0 else [] for r in rows]
    ranked = replies.by_probability([r.n_chars % 10 / 10 for r in rows], spans, [[0.5, 0.9, 0.8, 0.4][: len(x)] for x in spans])
    shown = F.array_join(F.transform(F.coalesce("ranges", F.array().cast("array<struct<start:int,end:int>>")), lambda r: F.concat_ws("-", r["start"], r["end"])), ",")
    return ranking.applied(top, ranked).select("pos", "doc_id", shown.alias("ranges"))


@_register("SELECT 'Engine|merge|helper|walk_all' AS hint")
def grep_hint(spark, d):
    blocks = [(["run", "Engine", "operator=="], ["a b", "helper", "Engine", "walk_all", "fifth"]), (["merge"], [])]
    return spark.createDataFrame([(replies.grep_hint(blocks),)], "hint string")


_COMMENTED = "# Reads the whole listing once and hands\n# every path to the callers in sorted order.\ndef walk(a):\n    b = 1\n    c = 2\n    d = 3\n    e = 4\n    return a\n\n# This one says what short_name means, which gives it away at once.\ndef short_name(a):\n    b = 1\n    c = 2\n    d = 3\n    e = 4\n    return a\n"


@_register("SELECT 'Reads the whole listing once and hands every path to the callers in sorted order.' AS query, 'a.py' AS file, 'walk' AS symbol, 3 AS line_start, 8 AS line_end")
def eval_cases(spark, d):
    return cases.derived(spark.createDataFrame([("a.py", _COMMENTED.encode()), ("b.py", b"\xff")], "path string, content binary"))


@_register("SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 3 = 0 THEN 'deleted' ELSE 'modified' END AS change FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0")
def changes_allowed(spark, d):
    """Every document changes, every third goes; those with an even number are indexed."""
    docs = _t(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"))
    changes = docs.select("path", F.when(F.col("doc_id") % 3 == 0, "deleted").otherwise("modified").alias("change"))
    return incremental.allowed(changes, docs.where("doc_id % 2 = 0").select("path"))


# ---- event time (beyond the retrieval engine) ------------------------------------------------------------------------


@_register("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    out = streams.tumbling(_t(spark, d, "events"), "ts", ["event_type"], "1 day", "1 hour", F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "total")


@_register("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events),
s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts)::TIMESTAMP AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    out = streams.sessions(_t(spark, d, "events"), "ts", ["user_id"], "6 hours", "1 hour", F.count("*").alias("n"))
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
