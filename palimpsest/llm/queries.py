"""The thin queries op1 to op10 over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.langid import fit, held_out, identify

    docs = _table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.warc import derive, responses

    return derive(responses(_table(spark, sf_dir, "pages"))).withColumn("block", F.col("block").cast("string"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), n=2, percent=80)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.urlfilter import judge

    return judge(_table(spark, sf_dir, "pages"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.mix import with_copies

    out = with_copies(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.quality import quality

    return quality(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.substr import dedup

    out = dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op10_token_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.slots import token_slots

    return token_slots(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_warc": op2_warc,
        "op3_bpe": op3_bpe,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_url_filters": op5_url_filters,
        "op6_mix_sources": op6_mix_sources,
        "op7_quality_rules": op7_quality_rules,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_nearest": op9_nearest,
        "op10_token_slots": op10_token_slots,
    }


def oracle_sql() -> dict[str, str]:
    from palimpsest.llm import oracles

    return {k: v for k, v in oracles.SQL.items() if k in queries()}
