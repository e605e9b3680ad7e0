"""One repository: index it, keep it up to date, ask it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.functions import paths
from corvid.operators import cache, explore, filters, graph, incremental, intervals, ranking, vector
from corvid.plans.query import Filters, parse
from corvid.sources import chunker, files, frameworks, imports
from corvid.sources.parse import parsed
from corvid.sources.snapshots import Store, content_stamp

TABLES = ("symbol", "chunk", "raw_edge", "calls", "file_meta")
#: The columns of each table that name the file a row belongs to.
OWNERS = {"symbol": ["file"], "chunk": ["file"], "raw_edge": ["from_file"], "calls": ["in_file", "out_file"], "file_meta": ["path"]}


class Engine:
    """Tables of a repository under ``root``, written a generation at a time.

    ``embed`` maps texts to vectors; ``identity`` names it, and another identity than the stored one makes the next run
    start anew, so that vectors of different embedders are never compared.  ``progress`` is called with the name of each
    step of a run when it begins.
    """

    def __init__(self, spark: SparkSession, root: str, embed: cache.Embedder | None = None, identity: str = "hashing-64", progress: Callable[[str], None] | None = None):
        self.spark, self.store = spark, Store(spark, root, {t: cols[0] for t, cols in OWNERS.items()})
        self.embed, self.identity = embed or cache.hashing_embedder(), identity
        self.progress = progress or (lambda step: None)
        self._answers: dict[tuple[int, str], DataFrame] = {}
        self._pinned: tuple[int, DataFrame] | None = None
        self._held: list[DataFrame] = []

    def _hold(self, df: DataFrame) -> DataFrame:
        """Keep what a run uses several times, until it ends: a later run over the same files must not find it."""
        self._held.append(df.persist(StorageLevel.DISK_ONLY))
        return df

    def _write(self, tables: dict[str, DataFrame], repo: str, found: list[str], touched: dict[str, set[int]] | None = None, chunks: DataFrame | None = None) -> int:
        """Write a generation; ``chunks`` are all chunks where ``tables`` have those of touched buckets only."""
        self.progress("write")
        try:
            meta = self._meta(repo, found, tables["chunk"] if chunks is None else chunks)
            g = self.store.write({"ignored": self._ignored(), **tables}, meta, touched)
        finally:
            self._release()
        self.refresh()
        return g

    def _ignored(self) -> DataFrame:
        """Paths that were taken out of the index and stay out (path)."""
        found = self.store.find("ignored", "path string")
        return self.spark.createDataFrame([], "path string") if found is None else found

    def _listed(self, repo: str, more_extensions: tuple[str, ...]) -> DataFrame:
        self.progress("list")
        return files.walk(self.spark, repo, False, more_extensions).join(self._ignored(), "path", "left_anti")

    def _release(self) -> None:
        while self._held:
            self._held.pop().unpersist()

    # ---- writing -----------------------------------------------------------------------------------------------

    def _parse(self, repo: str, listed: DataFrame, frameworks_: list[str]) -> dict[str, DataFrame]:
        """symbol, chunk (without vectors), raw_edge and file_meta of the listed files."""
        rows = self._hold(parsed(listed, frameworks_))
        lines = [F.col("line_start"), F.col("line_end")]
        of = lambda kind: rows.where(F.col("kind") == kind)
        symbols = of("symbol").select("fqn", F.lit(repo).alias("repo"), "name", F.col("symbol_kind").alias("kind"), F.col("path").alias("file"), *lines, F.lit(None).cast("string").alias("signature"), "parent_fqn")
        chunks = of("chunk").select(F.lit(repo).alias("repo"), F.col("path").alias("file"), *lines, "content", F.col("fqn").alias("symbol_fqn"))
        edges = of("edge").select(F.xxhash64("path", "fqn", "to_name", "line_start", "import_path").alias("edge_id"), F.col("path").alias("from_file"), F.col("name").alias("from_name"), F.col("fqn").alias("from_fqn"), "to_name", F.lit("calls").alias("kind"), F.col("line_start").alias("line"), "import_path")
        # the same call twice in a line is two sites
        edges = edges.groupBy(*edges.columns).agg(F.count("*").alias("_k")).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_k").cast("int")))).withColumn("edge_id", F.xxhash64("edge_id", "_k")).drop("_k")
        counts = of("chunk").groupBy("path").agg(F.count("*").cast("int").alias("chunk_count"))
        read = of("file").where("status <> 'unreadable'").select("path")
        meta = listed.drop("content").join(read, "path", "left_semi").join(counts, "path", "left")
        meta = meta.select("path", F.lit(repo).alias("repo"), "mtime", "size", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.lit(chunker.VERSION).alias("chunker_version"))
        return {"symbol": incremental.upserted(symbols, ["fqn"], "file", "line_start", "line_end"), "chunk": chunks, "raw_edge": edges, "file_meta": meta}

    def _imported(self, repo: str, edges: DataFrame, symbols: DataFrame) -> DataFrame | None:
        """edge_id, file: the files that the edges' imports mean; None if no edge has an import."""
        if edges.where("import_path is not null").isEmpty():
            return None
        base = repo.rstrip("/") + "/"
        mod = files.with_contents(files.listing(self.spark, repo).where(F.col("path") == base + "go.mod")).select(F.regexp_extract(F.col("content").cast("string"), r"(?m)^module\s+(\S+)", 1)).first()
        inside = lambda c: F.when(F.col(c).startswith(base), F.substr(F.col(c), F.lit(len(base) + 1))).otherwise(F.col(c))
        wanted = edges.where("import_path is not null").select("edge_id", paths.language(F.col("from_file")).alias("language"), "import_path", inside("from_file").alias("from_file"))
        found = imports.resolved(wanted, symbols.select(inside("file").alias("file")).distinct(), mod[0] if mod else "")
        return found.select("edge_id", F.concat(F.lit(base), "file").alias("file"))

    def _calls(self, repo: str, edges: DataFrame, symbols: DataFrame) -> DataFrame:
        self.progress("resolve")
        return graph.resolve(edges, symbols, imported=self._imported(repo, edges, symbols)).drop("edge_id", "level")

    def _vectors(self, chunks: DataFrame, known: DataFrame | None) -> DataFrame:
        if known is None:
            new = cache.embedded(chunks.select("content").distinct().withColumn("key", F.md5("content")), self.embed).select("key", "embedding")
            return chunks.withColumn("key", F.md5("content")).join(new, "key").drop("key")
        return cache.with_vectors(chunks, known, self.embed).drop("key")

    def _meta(self, repo: str, found: list[str], chunks: DataFrame) -> dict[str, object]:
        return {"repo": repo, "identity": self.identity, "frameworks": found, "stamp": content_stamp(chunks).first()[0], "edges_resolved": True}

    def _frameworks(self, listed: DataFrame) -> list[str]:
        """The frameworks that files of a listing show; only files that can show one are read."""
        texts = files.with_contents(listed.where(frameworks.may_show(F.col("path")))).withColumn("content", F.col("content").cast("string"))
        return [n for n, has in frameworks.detected(texts).first().asDict().items() if has]

    def index(self, repo: str, more_extensions: tuple[str, ...] = ()) -> int:
        """Index a repository from scratch; texts whose vectors are stored aren't embedded again.  Returns the generation."""
        listed = files.with_contents(self._listed(repo, more_extensions))
        found = self._frameworks(files.listing(self.spark, repo))
        self.progress("parse")
        tables = self._parse(repo, listed, found)
        same = self.store.current() is not None and self.store.meta().get("identity") == self.identity
        known = self.store.read("chunk").select(F.md5("content").alias("key"), "embedding").dropDuplicates(["key"]) if same else None
        self.progress("embed")
        tables["chunk"] = self._hold(self._vectors(tables["chunk"], known))
        tables["calls"] = self._calls(repo, tables["raw_edge"], tables["symbol"])
        return self._write(tables, repo, found)

    def update(self, repo: str, more_extensions: tuple[str, ...] = ()) -> int | None:
        """Bring the index up to date with the disk; only changed files are parsed, only affected edges resolved.  None if nothing changed."""
        if self.store.current() is None or self.store.meta().get("identity") != self.identity:
            return self.index(repo, more_extensions)
        old = {t: self.store.read(t) for t in TABLES}
        listed = self._hold(self._listed(repo, more_extensions))
        changes = incremental.snapshot_diff(old["file_meta"], listed, chunker.VERSION)
        if self._hold(changes).isEmpty():
            self._release()
            return None
        touched = listed.join(changes.where("change <> 'deleted'").select("path"), "path", "left_semi")
        before = list(self.store.meta().get("frameworks") or [])
        found = before + [n for n in self._frameworks(touched) if n not in before]
        self.progress("parse")
        changed = files.with_contents(touched)  # nothing else is read from the disk
        new = self._parse(repo, changed, found)
        gone = changes.select("path")
        known = old["chunk"].select(F.md5("content").alias("key"), "embedding").dropDuplicates(["key"])
        new["chunk"] = self._hold(self._vectors(new["chunk"], known))

        def after(table: str, rows: DataFrame) -> DataFrame:
            return incremental.without_files(rows, gone, OWNERS[table][:1]).unionByName(new[table])

        symbols, edges, chunks = (after(t, old[t]) for t in ("symbol", "raw_edge", "chunk"))
        before = old["symbol"].join(gone.withColumnRenamed("path", "file"), "file", "left_semi")
        delta = incremental.surface_delta(before, new["symbol"])
        radius = self._hold(incremental.blast_radius(gone.withColumnRenamed("path", "file"), delta, old["calls"], edges))
        touched = self.store.touched(["symbol", "chunk", "raw_edge", "file_meta"], gone)
        tables = {t: after(t, self.store.read(t, buckets=touched.get(t))) for t in ("symbol", "chunk", "raw_edge", "file_meta")}
        if incremental.scoped(radius.count(), old["file_meta"].count()):
            self.progress("resolve")
            touched |= self.store.touched(["calls"], radius, "file")
            again = incremental.leaving(edges, radius)
            tables["calls"] = incremental.re_resolved(self.store.read("calls", buckets=touched.get("calls")), radius, edges, symbols, self._imported(repo, again, symbols))
        else:
            tables["calls"] = self._calls(repo, edges, symbols)
        return self._write(tables, repo, found, touched, chunks)

    def heal(self, repo: str, more_extensions: tuple[str, ...] = ()) -> int:
        """Derive all raw edges from the disk again and resolve them; symbols, chunks and vectors stay."""
        old = {t: self.store.read(t) for t in TABLES}
        found = list(self.store.meta().get("frameworks") or [])
        self.progress("parse")
        old["raw_edge"] = self._hold(self._parse(repo, files.with_contents(self._listed(repo, more_extensions)), found)["raw_edge"])
        old["calls"] = self._calls(repo, old["raw_edge"], old["symbol"])
        return self._write(old, repo, found, self._same("symbol", "chunk", "file_meta"))

    def _same(self, *tables: str) -> dict[str, set[int]]:
        """For tables that stay as they are: no bucket is written."""
        return self.store.touched(tables, self.spark.createDataFrame([], "path string"))

    def ignore(self, part: str) -> int | None:
        """Take the stored files whose path holds ``part``, in any case, out of the index, and keep them out.  None if there is none."""
        gone = self._hold(explore.ignored(self.store.read("file_meta"), part))
        if gone.isEmpty():
            self._release()
            return None
        touched = self.store.touched(["symbol", "chunk", "raw_edge", "file_meta"], gone)  # calls of others into these files lie anywhere
        tables = {t: incremental.without_files(self.store.read(t, buckets=touched.get(t)), gone, cols) for t, cols in OWNERS.items()}
        meta = self.store.meta()
        chunks = incremental.without_files(self.store.read("chunk"), gone, ["file"])
        return self._write({**tables, "ignored": self._ignored().unionByName(gone).distinct()}, str(meta.get("repo") or ""), list(meta.get("frameworks") or []), touched, chunks)

    def unignore(self, part: str) -> int:
        """Let the next update take in again what was ignored and whose path holds ``part``.  How many paths these are."""
        ignored = self._ignored()
        back = ignored.where(F.lower(F.col("path")).contains(part.lower())).count()
        if back:
            meta = self.store.meta()
            left = ignored.where(~F.lower(F.col("path")).contains(part.lower()))
            self._write({**{t: self.store.read(t) for t in TABLES}, "ignored": left}, str(meta.get("repo") or ""), list(meta.get("frameworks") or []), self._same(*TABLES))
        return back

    # ---- asking ------------------------------------------------------------------------------------------------

    def _chunks(self) -> DataFrame:
        """Chunks of the current generation, kept in memory as far as it goes until the pointer moves."""
        now = self.store.current()
        if self._pinned is None or self._pinned[0] != now:
            if self._pinned:
                self._pinned[1].unpersist()
            self._pinned = (now, self.store.read("chunk", now).persist(StorageLevel.MEMORY_AND_DISK))
        return self._pinned[1]

    def candidates(self, text: str, scope: str | None, asked: Filters, top_k: int, file: str | None = None) -> DataFrame:
        """Twice ``top_k`` nearest chunks of a scope, with their symbols, without blank ones, narrowed by the filters."""
        chunks = self._chunks().where(filters.scope_predicate(F.col("file"), scope, asked.docs_extensions))
        if file is not None:
            chunks = chunks.where(F.col("file") == file)
        hits = vector.top_k(chunks, self.embed([text])[0], (4 if file else 2) * top_k, ["file", "line_start", "line_end"])
        symbols = self.store.read("symbol").select(F.col("fqn").alias("symbol_fqn"), F.col("name").alias("symbol"), F.col("kind").alias("symbol_kind"))
        found = hits.drop("embedding", "repo").join(symbols, "symbol_fqn", "left")
        kept, _ = filters.content_fence(found)
        return filters.apply(kept, asked)

    def _few(self, df: DataFrame) -> DataFrame:
        """Rows of an answer, at most a few times ``top_k``, as values: what follows plans on them, not on how they came about."""
        return self.spark.createDataFrame(df.collect(), df.schema)

    def query(self, text: str, top_k: int = 10, asked: Filters | None = None, expand: bool = True, scorer: ranking.Scorer | None = None) -> DataFrame:
        """Ranked blocks for a query: pos, file, lines, content, score, rank, symbols, copies, callers and callees, relevance.

        If nothing of the wanted scope is found, the other scope is searched once.
        """
        q = parse(text, asked)
        scope = q.filters.scope
        found = self._few(self.candidates(q.text, scope, q.filters, top_k))
        if scope and found.isEmpty():
            found = self._few(self.candidates(q.text, "code" if scope == "docs" else "docs", q.filters, top_k))
        pool = found
        if expand:
            pool = pool.unionByName(self._few(self._expanded(found)), allowMissingColumns=True)
        roots = [str(self.store.meta().get("repo") or "")]
        weight = ranking.class_weight(F.col("file"), F.col("content"), [q.text], q.filters, roots)
        merged = self._few(ranking.weighted_merge(pool, top_k, weight))
        out = self._with_stats(merged)
        n = F.row_number().over(Window.orderBy(F.desc("rank"), "file", "line_start"))  # at most top_k rows
        return ranking.rerank(out.withColumn("pos", n), q.text, scorer)

    def _expanded(self, found: DataFrame) -> DataFrame:
        """Chunks of what calls the candidates' symbols or is called by them."""
        symbols, chunks = self.store.read("symbol"), self._chunks().drop("embedding")
        seeds = found.where("symbol_fqn is not null").select(F.col("symbol_fqn").alias("node"), "score")
        spans = symbols.select("fqn", "file", F.col("line_start").alias("s0"), F.col("line_end").alias("s1"))
        reached = self._few(graph.expand(seeds, self.store.read("calls")))
        near = spans.join(reached.withColumnRenamed("node", "fqn"), "fqn", "left_semi")
        first = intervals.first_overlap(near, chunks, ["file"], "fqn", ("s0", "s1", "line_start", "line_end"))
        at = near.select("fqn", "file").join(first, "fqn").join(reached.withColumnRenamed("node", "fqn"), "fqn")
        kinds = symbols.select(F.col("fqn").alias("symbol_fqn"), F.col("name").alias("symbol"), F.col("kind").alias("symbol_kind"))
        return at.select("file", "line_start", "line_end", "score").join(chunks, ["file", "line_start", "line_end"]).join(kinds, "symbol_fqn", "left").drop("repo")

    def _with_stats(self, merged: DataFrame) -> DataFrame:
        calls = self.store.read("calls")
        wanted = merged.select(F.col("symbol_fqn").alias("node")).where("node is not null").distinct()
        into = calls.join(wanted.withColumnRenamed("node", "out_fqn"), "out_fqn", "left_semi")
        out_of = calls.join(wanted.withColumnRenamed("node", "in_fqn"), "in_fqn", "left_semi")
        a = graph.caller_stats(into).select(F.col("node").alias("symbol_fqn"), F.col("n").alias("callers"), F.col("files").alias("caller_files"), F.col("names").alias("caller_names"))
        b = graph.callee_stats(out_of).select(F.col("node").alias("symbol_fqn"), F.col("n").alias("callees"), F.col("names").alias("callee_names"))
        return merged.join(a, "symbol_fqn", "left").join(b, "symbol_fqn", "left")

    def file_query(self, file: str, text: str, top_k: int = 10, scorer: ranking.Scorer | None = None) -> DataFrame:
        """The blocks of one file nearest to a query."""
        found = self.candidates(text, None, Filters(), top_k, file)
        n = F.row_number().over(Window.orderBy(F.desc("score"), "line_start"))
        return ranking.rerank(found.withColumn("pos", n), text, scorer).orderBy("pos").limit(top_k)

    # ---- exploring ---------------------------------------------------------------------------------------------

    def _answer(self, name: str, kind: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A small answer about the current generation: as it was given before, as it is stored, or made and stored.

        What is stored is written next to the tables it was made of; if it can't be read as ``kind``, it is made again.
        """
        g = self.store.current()
        if (g, name) not in self._answers:
            found = self.store.find(f"_answer_{name}", kind, g)
            if found is None:
                self.store.put(f"_answer_{name}", make(), g)
                found = self.store.find(f"_answer_{name}", kind, g)
            self._answers = {k: v for k, v in self._answers.items() if k[0] == g}
            self._answers[g, name] = self._few(found)
        return self._answers[g, name]

    def refresh(self) -> None:
        """Make the answers that are asked for most; done at the end of each run, so that asking never computes them."""
        self.graph()
        self.stats()

    def graph(self, nodes: int = 250, edges: int = 600) -> tuple[DataFrame, DataFrame]:
        """The busiest symbols and the calls among them; for the usual limits as they were found by the last run."""
        calls, symbols = self.store.read("calls"), self.store.read("symbol")
        if (nodes, edges) != (250, 600):
            top = graph.hubs(calls, symbols, nodes)
            return top, graph.hub_edges(calls, top, edges)
        top = self._answer("nodes", "node string, degree bigint, name string, kind string, file string, line_start int", lambda: graph.hubs(calls, symbols, nodes))
        return top, self._answer("edges", "in_fqn string, out_fqn string", lambda: graph.hub_edges(calls, top, edges))

    def stats(self) -> DataFrame:
        tables = lambda: (self.store.read(t) for t in ("file_meta", "chunk", "symbol"))
        return self._answer("stats", "files bigint, chunks bigint, symbols bigint, dimensions bigint", lambda: explore.stats(*tables()))

    def files(self, part: str | None = None, after: str | None = None, limit: int = 2000) -> DataFrame:
        return explore.page(self.store.read("file_meta"), limit, after, part)

    def chunks(self, file: str, limit: int = 500) -> DataFrame:
        return explore.chunks_of(self.store.read("chunk"), file, limit)

    def symbols(self, names: Sequence[str]) -> DataFrame:
        return self.store.read("symbol").where(F.col("name").isin(list(names)))

    def grep(self, repo: str, pattern: str, **options) -> DataFrame:
        texts = files.walk(self.spark, repo, True).withColumn("content", F.col("content").cast("string"))
        return explore.grep(texts, pattern, **options)

    def read(self, repo: str, path: str, start: int = 1, end: int = 800) -> DataFrame:
        """Lines of a file of the repository; a relative path must lie in it, links followed."""
        path = path if path.startswith("/") or "://" in path else f"{repo.rstrip('/')}/{files.within(repo, path)}"
        own = files.listing(self.spark, repo).where(paths.in_repo(F.col("path"), repo) & (F.col("path") == path))
        return explore.read_range(files.with_contents(own).withColumn("content", F.col("content").cast("string")), path, start, end)
