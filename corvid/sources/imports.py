"""Which file an import means: candidate paths joined with the files there are."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: What is tried after a script import, in order.
SCRIPT_ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def candidates(language: str, import_path: str, from_file: str, module: str = "", aliases: dict[str, list[str]] | None = None) -> list[str]:
    """Paths that an import may mean, the likeliest first.  A leading "**/" stands for any directory above."""
    here = posixpath.dirname(from_file)
    if language in ("typescript", "tsx", "javascript"):
        bases = []
        for pattern, targets in (aliases or {}).items():
            prefix = pattern.removesuffix("*")
            if not import_path.startswith((".", "/")) and import_path.startswith(prefix):
                bases += [t.removesuffix("*") + import_path[len(prefix) :] for t in targets]
        bases.append(posixpath.normpath(posixpath.join(here, import_path)) if import_path.startswith(".") else "**/" + import_path)
        return [b + e for b in bases for e in ("", *SCRIPT_ENDINGS)]
    if language == "python":
        dots = len(import_path) - len(import_path.lstrip("."))
        rest = import_path.lstrip(".").replace(".", "/")
        up = here
        for _ in range(dots - 1):
            up = posixpath.dirname(up)
        base = posixpath.join(up, rest).rstrip("/") if dots else "**/" + rest
        return [base + ".py", base + "/__init__.py"]
    if language == "go":
        inside = import_path[len(module) :].lstrip("/") if module and import_path.startswith(module) else import_path
        return [("" if module and import_path.startswith(module) else "**/") + inside + "/*.go"]
    if language == "rust":
        parts = import_path.split("::")
        if parts[0] == "crate":
            root = from_file[: from_file.rfind("src/") + 4] if "src/" in from_file else here + "/"
            base = root + "/".join(parts[1:])
        else:
            base = here
            while parts and parts[0] in ("self", "super"):
                base = posixpath.dirname(base) if parts.pop(0) == "super" else base
            base = posixpath.join(base, *parts)
        up = posixpath.dirname(base)
        return [base + ".rs", base + "/mod.rs", up + ".rs", up + "/mod.rs"]
    return []


def resolved(imports: DataFrame, files: DataFrame, module: str = "", aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """edge_id, file: imports (edge_id, language, import_path, from_file) that mean one of the files (file).

    The first candidate that exists wins, of several files for one the least.  Exact candidates are joined by path, open
    ones by their last two parts and then compared.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(ArrayType(StringType()))
    def tries(language: pd.Series, path: pd.Series, source: pd.Series) -> pd.Series:
        return pd.Series([candidates(a, b, c, module, aliases) for a, b, c in zip(language, path, source)])

    rows = imports.select("edge_id", F.posexplode(tries("language", "import_path", "from_file")).alias("n", "want"))
    exact = rows.where(~F.col("want").contains("*")).join(files.select(F.col("file").alias("want")).distinct(), "want", "left_semi").select("edge_id", "n", F.col("want").alias("file"))
    base = lambda c: F.substring_index(c, "/", -1)
    open_ = rows.where(F.col("want").startswith("**/") & ~F.col("want").endswith("/*.go")).withColumn("tail", F.expr("substring(want, 4)"))
    by_end = open_.join(files.select("file").distinct(), base(F.col("tail")) == base(F.col("file"))).where((F.col("file") == F.col("tail")) | F.col("file").endswith(F.concat(F.lit("/"), F.col("tail")))).select("edge_id", "n", "file")
    go = rows.where(F.col("want").endswith("/*.go")).withColumn("dir", F.regexp_replace(F.regexp_replace("want", r"/\*\.go$", ""), r"^\*\*/", ""))
    go_files = files.where(F.col("file").endswith(".go")).select("file", F.regexp_extract("file", "^(.*)/[^/]*$", 1).alias("at")).distinct()
    by_dir = go.join(go_files, base(F.col("dir")) == base(F.col("at"))).where((F.col("at") == F.col("dir")) | (F.col("want").startswith("**/") & F.col("at").endswith(F.concat(F.lit("/"), F.col("dir"))))).select("edge_id", "n", "file")
    return exact.unionAll(by_end).unionAll(by_dir).groupBy("edge_id").agg(F.min(F.struct("n", "file")).alias("b")).select("edge_id", "b.file")


def chased(start: DataFrame, exports: DataFrame, depth: int = 8) -> DataFrame:
    """edge_id, file: where names (edge_id, file, name) come from that files re-export (file, name or "*", target), at most ``depth`` steps; a named re-export goes before a star."""
    now, out = start.select("edge_id", "file", "name"), start.select("edge_id", "file", F.lit(0).alias("step"))
    for step in range(1, depth + 1):
        hop = now.join(exports.select(F.col("file").alias("from"), F.col("name").alias("as"), "target"), (F.col("file") == F.col("from")) & ((F.col("name") == F.col("as")) | (F.col("as") == "*")))
        now = hop.groupBy("edge_id", "name").agg(F.min(F.struct((F.col("as") == "*").alias("star"), "target")).alias("b")).select("edge_id", F.col("b.target").alias("file"), "name")
        out = out.unionAll(now.select("edge_id", "file", F.lit(step).alias("step")))
    return out.groupBy("edge_id").agg(F.max_by("file", "step").alias("file"))
