"""Toxicity: bags of subwords in a linear softmax, trained jointly (see subwords.py).

Features are the character n-grams of 3 to 5 bytes of lower-cased words, so an unseen misspelling shares most of its
vectors with words that were seen. Each counts once per text: a few bad words then weigh in a long text as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overstats.llm import subwords
from overstats.llm.langid import fold

FEATURES = subwords.Features(shortest=3, longest=5, lower=True, words=False, distinct=True)
THRESHOLD = 0.3


def scored(docs: DataFrame, labels: DataFrame, label_col: str, kind: subwords.Features, threshold: float, folds: int, held: int) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``; rows of fold ``held`` of ``folds`` aren't learned from."""
    model = subwords.learn(labels.where(fold("doc_id", folds) != held), docs, label_col, kind)
    held_out = F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out")
    found = subwords.score(docs.select("doc_id", held_out, "text"), model, kind)
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from three of four folds."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return scored(read("documents").select("doc_id", "text"), read("labels"), "toxic", FEATURES, THRESHOLD, 4, 2)
