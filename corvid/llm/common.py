"""Helpers shared by the training-data operators: table access, scratch space, words."""

from __future__ import annotations

import ctypes
import re
import threading
import time
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and TAB to CR, nothing else.
SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, set here only where it is unset."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        warnings.warn(f"spark.checkpoint.dir is unset: intermediate tables go to {found}, which all executors must share", stacklevel=3)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: On a local disk Hadoop starts a ``chmod`` for each file and folder; these leave out those for checksum files and the mark of
#: success.  Until such a process has called exec it shares the JVM's memory, which then counts twice.  Other stores take no notice.
_FEW_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
#: Makes Spark remove the shuffle files of a query when the query has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Makes Spark write an array without nulls as repeated values instead of repeated groups of one value.
_FLAT = "spark.sql.parquet.writeLegacyFormat"


def materialize(df: DataFrame, name: str, compression: str = "snappy", dictionary: bool = True, level: int = 3, flat: bool = False) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts the lineage, survives lost executors.

    What is read again later is the table, so the shuffle files behind it go as soon as it is written.  Hashes that hardly
    repeat are cheaper to write without ``dictionary`` and at a low ``level`` (of zstd), long arrays of them ``flat``.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    settings = {_CLEAN: "true"} | ({_FLAT: "true"} if flat else {})
    before = {k: spark.conf.get(k, "false") for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        _make_folders(spark, path)
        df.write.mode("append").options(**_FEW_FILES).option("parquet.enable.dictionary", str(dictionary).lower()).option("parquet.compression.codec.zstd.level", str(level)).parquet(path, compression=compression)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    _WRITTEN[path] = _group
    return spark.read.schema(df.schema).parquet(path)


def _make_folders(spark: SparkSession, path: str) -> None:
    """On a local disk, make the folders that every write makes in the driver, where Hadoop would start a ``chmod`` for each.

    Not if Hadoop is told to give folders other permissions than by default.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(conf).getUri().getScheme() == "file" and jvm.org.apache.hadoop.fs.permission.FsPermission.getUMask(conf).toShort() == 0o22:
        jvm.java.io.File(f"{where.toUri().getPath()}/_temporary/0/_temporary").mkdirs()


#: Scratch tables of this driver that haven't been removed, and on whose account they were written.
_WRITTEN: dict[str, str] = {}
_group = ""


@contextmanager
def account(name: str) -> Iterator[None]:
    """Scratch tables written meanwhile are ``name``'s, for sweep()."""
    global _group
    before, _group = _group, name
    try:
        yield
    finally:
        _group = before


def _tables_read(df: DataFrame) -> set[str]:
    return {_plain(f.rsplit("/", 1)[0]) for f in df.inputFiles()}


def _plain(path: str) -> str:
    return re.sub("/+", "/", re.sub("^[a-z0-9]+:", "", path))


def discard(*tables: DataFrame) -> None:
    """Remove scratch tables from which nothing is still to be read: what was made of them has been written."""
    for df in tables:
        read = _tables_read(df)
        for path in [p for p in _WRITTEN if _plain(p) in read]:
            _remove(df.sparkSession, path)
    if tables:
        _collect(tables[0].sparkSession)


def _collect(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage: its heap shrinks again, and broadcasts that nothing refers to go."""
    spark.sparkContext._jvm.System.gc()


def sweep(name: str, keep: DataFrame) -> None:
    """Remove the scratch tables written on ``name``'s account, but for those that ``keep`` reads."""
    read = _tables_read(keep)
    for path in [p for p, owner in _WRITTEN.items() if owner == name and _plain(p) not in read]:
        _remove(keep.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Remove every scratch table of this driver: for when no result that reads one is still wanted."""
    for path in list(_WRITTEN):
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    del _WRITTEN[path]


def with_runs(df: DataFrame, w: str, k: int, out: str) -> DataFrame:
    """``df`` with ``out``: hashes of all runs of k elements of the array column ``w``; of fewer than k elements none.

    Each element is hashed once and neighbours are joined by doubling, each step a column of its own (inside one
    expression the steps would be repeated).  In the JVM this takes about half the time of hashing slices.
    """
    joined = lambda a, b, by: F.zip_with(a, F.slice(b, F.lit(by + 1), F.lit(1 << 30)), lambda x, y: F.xxhash64(x, y))
    df, made, n = df.withColumn("_run1", F.transform(w, lambda x: F.xxhash64(x))), ["_run1"], 1
    while 2 * n <= k:
        df = df.withColumn(f"_run{2 * n}", joined(f"_run{n}", f"_run{n}", n))
        n *= 2
        made.append(f"_run{n}")
    have, last = n, f"_run{n}"
    for part in reversed([2**i for i in range(n.bit_length() - 1)]):
        if have + part <= k:
            last = joined(last, f"_run{part}", have)
            have += part
            df = df.withColumn(f"_runs{have}", last)
            last = f"_runs{have}"
            made.append(last)
    return df.withColumn(out, F.slice(last, F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(0)))).drop(*made)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, _UPPER, _LOWER)


def words(c: Column) -> Column:
    """The words of a text as an array; null gives an empty one."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda w: w != "")


#: So many seconds after its last task a Python worker forgets what it remembers.
IDLE = 4.0


def give_back() -> None:
    """Return freed memory to the machine: Arrow's of this thread, glibc's of all."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what is freed otherwise
        trim(0)


class WordHashes(dict):
    """64-bit hash of a word's bytes, remembered between calls up to a bound, and until ``idle`` seconds without a call.

    Spark keeps idle workers for a minute, in which their executor may need the memory for other work.
    """

    def __init__(self, bound: int = 200_000, idle: float = IDLE):
        super().__init__()
        self.bound, self.idle, self.used, self.watch = bound, idle, 0.0, None

    def __reduce__(self):
        return WordHashes, (self.bound, self.idle)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        self.used = time.monotonic()
        if self.watch is None:
            self.watch = threading.Thread(target=self._forget, daemon=True)
            self.watch.start()
        return np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))


    def _forget(self) -> None:
        """Clear the memory once it is idle; a call that comes meanwhile hashes anew."""
        while (left := self.used + self.idle - time.monotonic()) > 0:
            time.sleep(left)
        self.watch = None
        self.clear()
        give_back()


#: One memory of word hashes for each Python worker.
HASHES = WordHashes()

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.p = np.uint64(base), np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.p) < n:
            with np.errstate(over="ignore"):
                step = self.p[-1] * self.base
                self.p = np.concatenate([self.p, self.p * step])
        return self.p[:n]


_POW, _INV = Powers(_BASE), Powers(_BASE_INV)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that neighbouring inputs order as if at random."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words, from the words' hashes."""
    n = len(h)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(h * _INV.upto(n), out=total[1:])
        return mix((total[k:] - total[:-k]) * _POW.upto(n - k + 1))


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Places of the least hash of every window of w hashes, the rightmost of equals; sorted, without repeats.

    Two texts that share w consecutive hashes share a chosen place there.  With fewer than w hashes nothing is chosen.
    """
    n = len(g)
    if n < w:
        return np.zeros(0, dtype=np.int64)
    out = []
    for at in range(0, n - w + 1, 65536):  # in slices, so that long texts stay small in memory
        v = np.lib.stride_tricks.sliding_window_view(g[at : at + 65536 + w - 1], w)
        out.append(at + np.arange(len(v)) + (w - 1) - np.argmin(v[:, ::-1], axis=1))
    return np.unique(np.concatenate(out))


def column_bytes(col) -> list[bytes]:
    """An Arrow string column as bytes, null as empty."""
    import pyarrow as pa

    return [b or b"" for b in col.cast(pa.large_binary()).to_pylist()]
