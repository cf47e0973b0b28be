"""The corpus pipeline: documents through five operators, one written table a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overstats.llm import bpe, decontaminate, langid, linededup, minhash
from overstats.llm.store import save


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those that look like none of the languages learned.

    Learned from the documents' own labels. Null texts go; without any label all documents stay.
    """
    model = langid.learn(docs.where(langid.fold("doc_id", 5) != 0))
    if model is None:
        return docs
    label, score = "_llm_lang", "_llm_score"
    found = langid.predict(docs, model, new=(label, score))
    return found.where((F.col(label) != langid.UNKNOWN) & (F.col(score) >= langid.LEAST_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated runs of lines; a document of which nothing is left goes."""
    return _sized(linededup.delete_repeats(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates keep the document of the smallest id."""
    return minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the words of benchmark passages out of the texts."""
    return _sized(decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns, the ids of their texts, how many, and the text decoded from the ids."""
    both = bpe.encode(docs, bpe.default_path(), decoded_col="decoded")
    return both.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe_encoding),
]

#: Suffix ranks, MinHash groups and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
