"""Tables of a repository as generations: a run writes a new one, then moves the pointer to it.

Readers pin the generation they opened; a run that dies leaves the pointer where it was.  The pointer is a table of one
row, written through Spark, so it lies wherever the tables lie.

Tables whose rows belong to files are cut into buckets by a hash of the file.  A run that touches few files writes the
buckets these fall into; for the others the new generation names the one that has them.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Buckets of a table; generations that one may be spread over before a run writes all buckets again.
BUCKETS, SPREAD = 64, 8


def bucket(file: str) -> Column:
    """The bucket of a row that belongs to the file named in this column."""
    return F.pmod(F.xxhash64(file), F.lit(BUCKETS)).cast("int")


class Store:
    """Generations of named tables under a root, one root for a repository.

    ``owners``: of the tables that are cut into buckets the column that names a row's file.
    """

    def __init__(self, spark: SparkSession, root: str, owners: Mapping[str, str] | None = None):
        self.spark, self.root, self.owners = spark, root.rstrip("/"), owners or {}
        self._manifests: dict[int, dict] = {}

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def generations(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.root)):
            return []
        return sorted(int(s.getPath().getName()[4:]) for s in fs.listStatus(path(self.root)) if s.getPath().getName().startswith("gen="))

    def current(self) -> int | None:
        """The generation whose commit marker was written last; those without one don't count."""
        fs, path = self._fs()
        done = [g for g in self.generations() if fs.exists(path(f"{self.root}/gen={g}/_meta/_SUCCESS"))]
        return max(done, default=None)

    def _manifest(self, g: int) -> dict[str, dict]:
        """Of each bucketed table of a generation its schema and, for each bucket, the generation that has it."""
        if g not in self._manifests:
            self._manifests[g] = self.meta(g).get("manifest") or {}
        return self._manifests[g]

    def write(self, tables: Mapping[str, DataFrame], meta: Mapping[str, object] | None = None, touched: Mapping[str, set[int]] | None = None) -> int:
        """Write a new generation; its meta table, written last, is the commit marker.

        ``touched``: of tables of which only some buckets change, which; rows of others needn't be in their frames.
        """
        now = self.current()
        before = self._manifest(now) if now is not None else {}
        g = max(self.generations(), default=0) + 1
        manifest = {}
        for name, df in tables.items():
            path = f"{self.root}/gen={g}/{name}"
            if name not in self.owners:
                df.write.mode("overwrite").parquet(path)
                continue
            some = (touched or {}).get(name)
            rows = df.withColumn("bucket", bucket(self.owners[name]))
            if some is not None:
                rows = rows.where(F.col("bucket").isin(sorted(some)))
            if some is None or some:
                rows.repartition(BUCKETS, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
            kept = {k: h for k, h in before[name]["buckets"].items() if int(k) not in some} if some is not None else {}
            manifest[name] = {"schema": df.schema.json(), "buckets": kept | {k: g for k in self._buckets(path)}}
        rows = [(k, json.dumps(v)) for k, v in {**(meta or {}), "epoch": g, "manifest": manifest}.items()]
        self.spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/gen={g}/_meta")
        return g

    def _buckets(self, where: str) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path(where)):
            return []
        return [n.removeprefix("bucket=") for s in fs.listStatus(path(where)) if (n := s.getPath().getName()).startswith("bucket=")]

    def touched(self, names: Iterable[str], files: DataFrame, col: str = "path") -> dict[str, set[int]]:
        """For write(): the buckets that files fall into; of no table if they are half of all, or if its buckets lie in too many generations."""
        now = self.current()
        if now is None:
            return {}
        some = {r[0] for r in files.select(bucket(col)).distinct().collect()}
        out = {}
        for name in names:
            held = self._manifest(now).get(name, {}).get("buckets")
            if held is not None and 2 * len(some) < len(held) and len(set(held.values())) < SPREAD:
                out[name] = some
        return out

    def read(self, name: str, generation: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """A table of a generation, or some buckets of it."""
        g = self.current() if generation is None else generation
        if g is None:
            raise FileNotFoundError(f"nothing is stored under {self.root}")
        held = self._manifest(g).get(name) if name in self.owners else None
        if held is None:
            return self.spark.read.parquet(f"{self.root}/gen={g}/{name}")
        kind = T.StructType.fromJson(json.loads(held["schema"]))
        full = T.StructType([*kind.fields, T.StructField("bucket", T.IntegerType())])
        by_generation: dict[int, list[str]] = {}
        for k, h in held["buckets"].items():
            if buckets is None or int(k) in buckets:
                by_generation.setdefault(h, []).append(f"{self.root}/gen={h}/{name}/bucket={k}")
        parts = [self.spark.read.schema(full).option("basePath", f"{self.root}/gen={h}/{name}").parquet(*sorted(ps)).drop("bucket") for h, ps in sorted(by_generation.items())]
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], kind)

    def find(self, name: str, kind: str, generation: int | None = None) -> DataFrame | None:
        """A table of a generation if it is there and has the columns of ``kind``, else None."""
        g = self.current() if generation is None else generation
        fs, path = self._fs()
        if g is None or not fs.exists(path(f"{self.root}/gen={g}/{name}/_SUCCESS")):
            return None
        try:
            df = self.spark.read.parquet(f"{self.root}/gen={g}/{name}")
        except (PySparkException, Py4JJavaError):  # no table, or one that was cut short
            return None
        wanted = [c.split() for c in kind.split(", ")]
        return df if [list(x) for x in df.dtypes] == wanted else None

    def put(self, name: str, df: DataFrame, generation: int | None = None) -> None:
        """Write a small table next to those of a generation."""
        g = self.current() if generation is None else generation
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/gen={g}/{name}")

    def meta(self, generation: int | None = None) -> dict[str, object]:
        g = self.current() if generation is None else generation
        if g is None:
            return {}
        return {r["key"]: json.loads(r["value"]) for r in self.spark.read.parquet(f"{self.root}/gen={g}/_meta").collect()}

    def sweep(self, keep: int = 2) -> list[int]:
        """Remove all but the last ``keep`` committed generations, those that these still read from, and what was left uncommitted before them."""
        fs, path = self._fs()
        now = self.current()
        if now is None:
            return []
        kept = [g for g in self.generations() if now - keep < g <= now and fs.exists(path(f"{self.root}/gen={g}/_meta/_SUCCESS"))]
        used = {h for g in kept for table in self._manifest(g).values() for h in table["buckets"].values()}
        gone = [g for g in self.generations() if g <= now - keep and g not in used]
        for g in gone:
            fs.delete(path(f"{self.root}/gen={g}"), True)
        return gone

    def remove(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.root), True)


def content_stamp(chunks: DataFrame) -> DataFrame:
    """One row, stamp: of all chunks together, whatever their order."""
    h = F.xxhash64("file", "line_start", "line_end", "content")
    return chunks.agg(F.sha2(F.concat_ws(":", F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(F.pmod(h, F.lit(1_000_003))), F.lit(0))), 256).alias("stamp"))
