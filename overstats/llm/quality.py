"""Quality: vectors of words, of pairs of neighbours and of character n-grams, averaged (see subwords.py).

Words are runs without white space, case kept: shouting, stray signs and tables show in their n-grams, and a word that
follows itself in the pair it makes. Features count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from overstats.llm import subwords
from overstats.llm.toxicity import scored

FEATURES = subwords.Features(shortest=2, longest=4, lower=False, words=True, distinct=False)
THRESHOLD = 0.5


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from two of three folds."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return scored(read("documents").select("doc_id", "text"), read("labels"), "quality", FEATURES, THRESHOLD, 3, 1)
