"""The queries of the dealt operators, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from overstats.llm.bpe import op3_bpe
from overstats.llm.chat import OP10_SQL, op10_chat_format
from overstats.llm.decontaminate import op9_benchmark_decontamination
from overstats.llm.langid import op4_language_id
from overstats.llm.linededup import op6_line_dedup
from overstats.llm.minhash import op1_minhash_near_dedup
from overstats.llm.periods import op11_periodic_runs
from overstats.llm.quality import op5_quality
from overstats.llm.search import op8_topk_search
from overstats.llm.secrets import op7_secret_scan
from overstats.llm.tokencount import op12_token_counts
from overstats.llm.toxicity import op2_toxicity
from overstats.llm.whitening import op13_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_toxicity,
        op3_bpe,
        op4_language_id,
        op5_quality,
        op6_line_dedup,
        op7_secret_scan,
        op8_topk_search,
        op9_benchmark_decontamination,
        op10_chat_format,
        op11_periodic_runs,
        op12_token_counts,
        op13_embedding_whitening,
    )
}
ORACLE: dict[str, str] = {"op10_chat_format": OP10_SQL}
