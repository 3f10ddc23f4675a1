"""A corpus pipeline of five stages, each one operator of palimpsest.llm, each written as Parquet and read by the next.

Null texts and texts without a letter go with language ID. Null sources are one source, null languages get the predicted one.
Rows with null or repeated ids are documents of their own, told by their texts where ids don't tell them: near-dedup keeps one row of
each group of copies, whatever their ids. Very long texts are one row as others are. An empty table gives an empty result. Columns
that documents has besides its own pass through all stages but the last, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.bpe import round_trip
from palimpsest.llm.langid import fit, identify
from palimpsest.llm.mix import mix
from palimpsest.llm.neardup import deduplicated
from palimpsest.llm.shared import stored
from palimpsest.llm.substr import dedup

def _apart(docs: DataFrame, *needed: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with names of their own for all columns but the needed ones, so that an operator's results can't meet them; the new names."""
    names = {c: c if c in needed else f"__own_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found go on, unlabelled ones with the language predicted; `und` ones go."""
    own, names = _apart(docs, "text")
    found = identify(own, fit(docs)).where("lang_pred <> 'und'")
    found = found.withColumn(names["lang"], F.coalesce(names["lang"], "lang_pred"))
    return found.select(*[F.col(x).alias(c) for c, x in names.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, one stays: that with the smallest id."""
    return deduplicated(docs, n=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 13 words that a document with a smaller id has too are cut; what is left empty goes."""
    own, names = _apart(docs, "doc_id", "text")
    cut = dedup(own).where("n_removed = 0 OR kept <> ''")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    cut = cut.withColumn("text", text).withColumn(names["n_chars"], F.length("text").cast("long"))
    return cut.select(*[F.col(x).alias(c) for c, x in names.items()])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each copy's count of tokens, and the digests of its ids and of what they decode to."""
    return round_trip(docs.select("doc_id", "source", "lang", "text"))


STAGES = [
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: The learned language model, MinHash and the tokenizer's merges are not SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each but the last stored in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{i}")
    return docs
