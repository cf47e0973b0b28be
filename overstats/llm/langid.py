"""Language of a text: string kernel, Nystroem landmarks and one-versus-rest kernel ridge regression.

The kernel is the blended spectrum of presence: two texts share so many of the n-grams (1 to ``LONGEST`` bytes of the
text in lower case, other signs than letters being one space) of which each has at least one, divided by the root of
the product of their own numbers. n-grams are told apart by ``BUCKETS`` hash buckets.

A sample of labelled rows of at most ``SAMPLE`` rows in all, as many of each language, is fitted: texts up to
``SAMPLE_BYTES`` bytes, and where a language has too few of these its shortest longer ones, whole; ``LANDMARKS`` of them carry the kernel. Any text is scored, whole: as kernel, landmarks and ridge
weights are all linear in its presence vector, they are folded into one matrix, and a batch of presence vectors times
that matrix gives the scores of all languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from overstats.llm import sample
from overstats.llm import textbytes as tb
from overstats.llm.store import give_back, map_batches

SAMPLE, SAMPLE_BYTES, LANDMARKS = 1200, 20_000, 240
LONGEST, BUCKETS, RIDGE = 4, 1 << 16, 1e-3
#: Languages that a model may have: its matrix goes to every task.
MOST_LANGUAGES = 200
UNKNOWN = "und"
#: Score under which a text is of no language that was learned.
LEAST_SCORE = 0.1
_SPACED = np.full(256, 0x20, np.uint8)
_SPACED[0x61:0x7B] = np.arange(0x61, 0x7B)
_SPACED[0x41:0x5B] = np.arange(0x61, 0x7B)
_SPACED[0x80:] = np.arange(0x80, 256)


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of BUCKETS for each text: 1 where it has an n-gram of the bucket."""
    out = np.zeros((len(offsets) - 1, BUCKETS), bool)
    for row, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        text = _SPACED[data[low:high]]
        text = text[(text != 0x20) | np.concatenate([[True], text[:-1] != 0x20])[: len(text)]].astype(np.uint64)
        code = np.zeros(len(text), np.uint64)
        for n in range(LONGEST):
            if n >= len(text):
                break
            code = code[: len(text) - n] << np.uint64(8) | text[n:]
            bucket = (code + np.uint64(n + 1 << 40)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)
            out[row, bucket] = True
    return out


def packed(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """:func:`presence` of each text in BUCKETS / 8 bytes, however long the text."""
    rows = range(0, len(offsets) - 1, 32)
    return [bits.tobytes() for k in rows for bits in np.packbits(presence(data, offsets[k : k + 33]), axis=1)]


def fit(texts: list[str], languages: list[str]) -> tuple[list[str], np.ndarray]:
    """(names, matrix) such that presence x matrix / root of the number of n-grams is the ridge regression's output."""
    return fit_packed(packed(*tb.utf8(pa.array(texts, pa.string()))), languages)


def fit_packed(texts: list[bytes], languages: list[str]) -> tuple[list[str], np.ndarray]:
    """:func:`fit` on the packed presence of each text."""
    names = sorted(set(languages))
    which = np.array([names.index(y) for y in languages])
    turn = np.empty(len(which), np.int64)
    for k in range(len(names)):
        turn[which == k] = np.arange((which == k).sum())
    landmarks = _unit([texts[k] for k in np.argsort(turn, kind="stable")[:LANDMARKS].tolist()])
    across = np.concatenate([_unit(texts[k : k + 50]) @ landmarks.T for k in range(0, len(texts), 50)]).astype(np.float64)
    within = (landmarks @ landmarks.T).astype(np.float64)
    target = (which[:, None] == np.arange(len(names))).astype(np.float64)
    left = across.T @ across + RIDGE * len(texts) * within + 1e-9 * len(texts) * np.eye(len(within))
    return names, (landmarks.T @ np.linalg.solve(left, across.T @ target).astype(np.float32))


def _unit(texts: list[bytes]) -> np.ndarray:
    """Presence vectors of length 1."""
    x = np.unpackbits(np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), -1), axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    return x


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id") -> tuple[list[str], np.ndarray] | None:
    """Fit on a bounded sample of rows with language and a letter in the text; None if there are none.

    Rows are counted after that, so every language has its places if it has the rows: short texts by hash, then longer
    ones, shortest first, whole. Rows that repeat in id and text are one. Presence vectors are made where the texts
    lie, so the driver gets 8 KB a text.
    """
    text, lang = F.col(f"`{text_col}`").cast("string"), F.col(f"`{lang_col}`").cast("string")
    rows = labelled.select(text.alias("text"), lang.alias("lang"), F.xxhash64(F.col(f"`{order_col}`"), text).alias("order"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("step", sample.step(F.octet_length("text"), SAMPLE_BYTES))
    counts = rows.groupBy("lang", "step").agg(F.approx_count_distinct("order").alias("n")).limit(MOST_LANGUAGES * sample.STEPS + 1).collect()
    n_languages = len({r.lang for r in counts})
    if not counts:
        return None
    if n_languages > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    each = max(4, SAMPLE // n_languages)
    asked = rows.where(sample.passing([(r.lang, r.step, r.n) for r in counts], each, F.col("lang"), F.col("step"), F.col("order")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in tb.blocks(batch.column(3)):
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns[:3], pa.array(packed(data, offsets), pa.binary())], names=["lang", "step", "order", "bits"])

    turn = F.row_number().over(Window.partitionBy("lang").orderBy("step", "order"))
    once = map_batches(asked.select("lang", "step", "order", "text"), run, "lang string, step int, order long, bits binary").dropDuplicates(["lang", "step", "order"])
    chosen = once.withColumn("turn", turn).where(F.col("turn") <= each).select("lang", "turn", "bits").toArrow()
    chosen = chosen.sort_by([("lang", "ascending"), ("turn", "ascending")]).to_pydict()
    model = fit_packed(chosen["bits"], chosen["lang"])
    give_back()
    return model


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray] | None, text_col: str = "text", new: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` plus the language and its score (0 to 1), named ``new``; columns of these names are replaced.

    Null texts and texts without a letter are ``UNKNOWN`` with score 0, and so are all without a model.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    if model is None:
        return docs.select(*kept, F.lit(UNKNOWN).alias(new[0]), F.lit(0.0).alias(new[1]))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = "_llm_lettered"
    source = docs.select(*kept, F.coalesce(F.col(f"`{text_col}`").cast("string").rlike(r"\p{L}"), F.lit(False)).alias(name))
    at, text_at = len(kept), source.columns.index(text_col)
    out = source.drop(name).withColumns({new[0]: F.lit("").cast("string"), new[1]: F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        names = np.array(names, object)
        for batch in batches:
            label, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            for low, high, data, offsets in tb.blocks(batch.column(text_at)):
                for first in range(low, high, 32):
                    last = min(high, first + 32)
                    x = presence(data, offsets[first - low : last - low + 1])
                    y = x.astype(np.float32) @ matrix / np.sqrt(np.maximum(np.count_nonzero(x, axis=1), 1))[:, None]
                    label[first:last], score[first:last] = names[y.argmax(1)], y.max(1)
            none = ~batch.column(at).to_numpy(zero_copy_only=False)
            label[none], score[none] = UNKNOWN, 0
            columns = [*batch.columns[:at], pa.array(label, pa.string()), pa.array(np.clip(score, 0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return map_batches(source, run, out)


def fold(id_col: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string")) % n


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four of five folds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs.where(fold("doc_id", 5) != 0))
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", held_out, "text"), model).select("doc_id", "held_out", "lang_pred", "score")
