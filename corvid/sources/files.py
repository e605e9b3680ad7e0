"""Listing and reading repositories."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.functions import paths
from corvid.operators import explore


def _file_system(root: str):
    """The file system of a path or URI, and the path in it."""
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def listing(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """path, mtime (seconds), size, and content if asked for, of all files under a root.

    Spark's own readers pass over names that begin with a dot or an underscore, such as __init__.py, so the tree is
    listed once on the driver (a row a file) and the contents are read by the tasks, which must see the root under the
    same path.  Content that can't be read is null.
    """
    system, base = _file_system(root)
    prefix = root[: len(root) - len(base)] if root.endswith(base) else ""
    found = [f for f in system.get_file_info(fs.FileSelector(base.rstrip("/") or "/", recursive=True, allow_not_found=True)) if f.type == fs.FileType.File]
    table = pa.table({"path": pa.array([prefix + f.path for f in found], pa.string()), "mtime": pa.array([int((f.mtime_ns or 0) // 10**9) for f in found], pa.int64()), "size": pa.array([f.size for f in found], pa.int64())})
    listed = spark.createDataFrame(table).repartition(max(1, min(len(found) // 200 + 1, 4000)))
    return with_contents(listed) if with_content else listed


def with_contents(listed: DataFrame) -> DataFrame:
    names = listed.columns

    def read(path: str) -> bytes | None:
        try:
            system, base = _file_system(path)
            with system.open_input_stream(base) as f:
                return f.read()
        except OSError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part = batch.slice(at, 50)
                raw = [read(p) for p in part.column(names.index("path")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [*names, "content"])

    return listed.mapInArrow(run, T.StructType([*listed.schema.fields, T.StructField("content", T.BinaryType())]))


def within(root: str, rel: str) -> str:
    """A path relative to a root, as it is once links are followed; ValueError if it is absolute, isn't there or leaves the root."""
    rel = rel.strip()
    if not rel or rel.startswith(("/", "\\")) or ":" in rel:
        raise ValueError(f"not a path relative to the repository: {rel!r}")
    base, target = os.path.realpath(root), os.path.realpath(os.path.join(root, rel))
    if not os.path.exists(target):
        raise ValueError(f"not in the repository: {rel}")
    if os.path.commonpath([base, target]) != base:
        raise ValueError(f"outside the repository: {rel}")
    return os.path.relpath(target, base)


def main_root(repo: str) -> str | None:
    """The main working folder of a linked one, whose ``.git`` is a file that points into the main one's; None for others."""
    try:
        with open(os.path.join(repo, ".git"), encoding="utf-8") as f:
            said = next((x.removeprefix("gitdir:").strip() for x in f if x.startswith("gitdir:")), "")
    except OSError:
        return None
    parts = os.path.normpath(os.path.join(repo, said)).split(os.sep) if said else []
    if parts[-3:-1] != [".git", "worktrees"]:
        return None
    main = os.path.realpath(os.sep.join(parts[:-3]))
    return main if os.path.isdir(main) and main != os.path.realpath(repo) else None


class IgnoreRules:
    """Patterns of ignore files: (directory, lines), those of deeper directories and later lines win."""

    def __init__(self, files: list[tuple[str, str]]):
        self.rules: list[tuple[str, re.Pattern, bool, bool]] = []
        for directory, lines in sorted(files, key=lambda x: x[0].count("/")):
            for line in lines.splitlines():
                line = line.rstrip()
                if not line or line.startswith("#"):
                    continue
                keep = line.startswith("!")
                line = line[keep:]
                only_dir = line.endswith("/")
                line = line.rstrip("/")
                anchored = "/" in line
                self.rules.append((directory.strip("/"), re.compile(self._pattern(line.lstrip("/"), anchored)), only_dir, keep))

    @staticmethod
    def _pattern(glob: str, anchored: bool) -> str:
        out = []
        for part in glob.split("/"):
            out.append(r"(?:.*)" if part == "**" else fnmatch.translate(part).removesuffix(r"\z").removesuffix(r"\Z").replace("(?s:", "(?:").replace(".*", "[^/]*"))
        body = "/".join(out).replace("(?:.*)/", "(?:.*/)?")
        return body if anchored else "(?:.*/)?" + body

    def ignores(self, rel: str) -> bool:
        parts = rel.strip("/").split("/")
        for k in range(1, len(parts) + 1):  # a file in an ignored directory is out, whatever its own rules say
            verdict = False
            for directory, pattern, only_dir, keep in self.rules:
                if only_dir and k == len(parts):
                    continue
                path = "/".join(parts[:k])
                if directory:
                    if not path.startswith(directory + "/"):
                        continue
                    path = path[len(directory) + 1 :]
                if pattern.fullmatch(path):
                    verdict = not keep
            if verdict:
                return True
        return False


def walk(spark: SparkSession, root: str, with_content: bool = False, more_extensions: tuple[str, ...] = (), ignore_files: tuple[str, ...] = (".gitignore", ".ignore"), subdir: str = "") -> DataFrame:
    """Files of a repository that are indexed.  Ignore files are few and small; they are read to the driver and sent along."""
    base = root.rstrip("/")
    everything = listing(spark, base)
    ignoring = with_contents(everything.where(paths.basename(F.col("path")).isin(list(ignore_files)) & (F.col("size") < 1 << 20)))
    rules_rows = ignoring.select("path", F.col("content").cast("string").alias("text")).collect()
    order = {n: i for i, n in enumerate(ignore_files)}
    rules_rows.sort(key=lambda r: (r["path"].count("/"), order[r["path"].rsplit("/", 1)[-1]]))
    rules = IgnoreRules([(r["path"][len(base) :].rsplit("/", 1)[0], r["text"] or "") for r in rules_rows])
    found = explore.walkable(everything if not subdir else everything.where(paths.in_repo(F.col("path"), f"{base}/{subdir}")), base, more_extensions)
    n = len(base) + 1

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[not rules.ignores(p[n:]) for p in b["path"]]]

    if rules.rules:
        found = found.mapInPandas(keep, found.schema)
    return with_contents(found) if with_content else found
