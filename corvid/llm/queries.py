"""The training-data operators bound to the tables of a data folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm import decontaminate, license_scan, line_dedup, lm_score, main_text, near_dup, piece_codec, quality, substring_dedup, warc
from corvid.llm.common import table
from corvid.llm.oracles import oracle_sql  # noqa: F401  the SQL twins of these queries


def piece_model_path() -> str:
    """The public 32k merge-type SentencePiece model; where it lies is the tokenizer package's affair."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), lm_score.held_out_ids("doc_id"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = decontaminate.shared_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), t=10, k=5, keep_text=False)
    return decontaminate.digest(shared)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.summary(table(spark, sf_dir, "documents"), percent=80)
    return out.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_codec.encode_decode(table(spark, sf_dir, "documents"), piece_model_path(), with_text=False)
    return out.drop("ids", "decoded")


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf_dir, "documents"), license_scan.notices(spark))
    return out.select("doc_id", "n_words", "n_licenses", F.array_join("licenses", ",").alias("licenses"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages"))).withColumnRenamed("key", "page_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", *(F.col(c).alias(c.removeprefix("q_")) for c in out.columns if c.startswith("q_")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=50, with_text=False).drop("kept_text")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_score": op1_lm_score,
        "op2_decontaminate": op2_decontaminate,
        "op3_line_dedup": op3_line_dedup,
        "op4_piece_codec": op4_piece_codec,
        "op5_near_dup": op5_near_dup,
        "op6_license_scan": op6_license_scan,
        "op7_warc": op7_warc,
        "op8_quality": op8_quality,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_main_text": op10_main_text,
    }
