"""A training-data pipeline over ``documents``: quality rules, line dedup, near-dedup, decontamination, tokens.

Each stage works on all that the one before kept, is written as Parquet and read again by the next; a stage begins by
removing the intermediate tables of the stages before, of which its written input needs none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm import decontaminate, line_dedup, near_dup, piece_codec, quality
from corvid.llm.common import account, materialize, sweep, table
from corvid.llm.queries import piece_model_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """A stage that first removes what earlier ones have left in the scratch folder."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep("pipeline", docs)
        with account("pipeline"):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.judged(docs, carry=docs.columns).where("q_kept").select(*docs.columns)


@stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches; n_chars follows.  Those of which no word is left go."""
    out = line_dedup.dedup(docs, percent=80).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@stage
def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    found = near_dup.near_duplicates(docs, k=5, percent=80)
    gone = found.where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs.doc_id == gone.gone_id, "left_anti").select(*docs.columns)


@stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of a benchmark item."""
    shared = decontaminate.shared_spans(docs, table(spark, sf_dir, "benchmark"), keep_text=False, carry=docs.columns)
    return shared.where(F.size("spans") == 0).select(*(F.col(f"c_{c}").alias(c) for c in docs.columns))


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of what they decode to."""
    return piece_codec.encode_decode(docs, piece_model_path()).drop("decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", without_benchmark),
    ("sentencepiece_tokens", tokens),
]

#: SQL can express neither the token stage nor the winnowed spans at the size of whole tables; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        with account("pipeline"):
            docs = materialize(f(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
