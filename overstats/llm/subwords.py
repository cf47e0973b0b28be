"""Supervised subword embeddings: hashed n-gram vectors averaged into a linear softmax, trained jointly in numpy.

Features of a text are the character n-grams of its words, taken with a sign before and after each word, and, if asked
for, the words themselves and the pairs of neighbours (a word that follows itself is one pair, whichever it is); each is hashed to one of ``BUCKETS`` vectors. A text is the mean of the vectors of its
features (see ``Features.distinct``), its class the softmax of a linear map of that mean; vectors and map are trained together by
stochastic gradient descent with a step of its own for every vector. Rows kept back set the scale of the result.

Training takes a bounded sample of labelled rows (``SAMPLE`` of each class, chosen by a hash of the row's id among texts
up to ``SAMPLE_BYTES``; a class with too few of these takes its shortest longer ones, whole). Scoring takes every whole text: the mean of vectors through a linear map is the mean of one
number per feature, so tasks get that one column of BUCKETS numbers.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from overstats.llm import sample
from overstats.llm import textbytes as tb
from overstats.llm.store import forget, give_back, map_batches, save

BITS, DIM = 18, 12
BUCKETS = 1 << BITS
#: Bucket of all pairs of a word with itself.
AGAIN = 0
SAMPLE, SAMPLE_BYTES = 4000, 20_000
EPOCHS, BATCH, STEP = 5, 16, 0.3
#: Features that fewer texts of the sample have keep the vector 0: they would only tell these texts by heart.
LEAST_TEXTS = 3
#: One of so many rows of the sample is kept from training and sets scale and offset of the logit.
CALIBRATE = 4


@dataclass(frozen=True)
class Features:
    """How a text becomes features. ``distinct``: each bucket counts once, however often the text has it."""

    shortest: int
    longest: int
    lower: bool
    words: bool
    distinct: bool


def buckets(data: np.ndarray, offsets: np.ndarray, kind: Features) -> list[np.ndarray]:
    """Bucket of every feature of every text."""
    if kind.lower:
        data = tb.LOWER[data]
    starts, ends, bounds = tb.words(data, offsets, tb.ALNUM if kind.lower else tb.NOT_SPACE)
    n_texts = len(offsets) - 1
    if not len(starts):
        return [np.zeros(0, np.int64)] * n_texts
    sizes = ends - starts + 2
    first = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    at = np.arange(total) - np.repeat(first, sizes)
    left = np.repeat(sizes, sizes) - at  # signs up to the end of the word
    place = np.clip(np.repeat(starts, sizes) + at - 1, 0, len(data) - 1)
    signs = data[place].astype(np.uint64)
    signs[first], signs[first + sizes - 1] = 0x02, 0x03
    text_at = np.concatenate([first, [total]])[bounds]
    code, parts = np.zeros(total, np.uint64), []
    for n in range(1, kind.longest + 1):
        if n > total:
            break
        code = code[: total - n + 1] << np.uint64(8) | signs[n - 1 :]
        if n >= kind.shortest:
            fits = np.flatnonzero(left[: len(code)] >= n)
            hashed = (code[fits] ^ np.uint64(n * 0x0101010101)) * np.uint64(0x9E3779B97F4A7C15)
            hashed = (hashed ^ hashed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)
            parts.append((hashed.astype(np.int64), np.searchsorted(fits, text_at)))
    if kind.words:
        word = tb.hashes(data, starts, ends)
        parts.append(((word >> np.uint64(64 - BITS)).astype(np.int64), bounds))
        pair = tb.chain(word[:-1], word[1:]) >> np.uint64(64 - BITS)
        pair[word[1:] == word[:-1]] = AGAIN
        inner = np.ones(len(pair), bool)
        inner[bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(starts))] - 1] = False
        fits = np.flatnonzero(inner)
        parts.append((pair[fits].astype(np.int64), np.searchsorted(fits, bounds)))
    out = []
    for k in range(n_texts):
        own = np.concatenate([x[b[k] : b[k + 1]] for x, b in parts]) if parts else np.zeros(0, np.int64)
        out.append(own)
    return out


def weights(ids: np.ndarray, kind: Features) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares in its mean."""
    ids, counts = np.unique(ids, return_counts=True)
    shares = np.ones(len(ids)) if kind.distinct else counts
    return ids.astype(np.int32), (shares / max(1, shares.sum())).astype(np.float32)


def fit(texts: list[str], labels: list[int], kind: Features, seed: int = 0) -> tuple[np.ndarray, float]:
    """(a number for every bucket, offset): the logit of label 1 is the offset plus the mean number of a text's features."""
    rows = []
    for _, _, data, offsets in tb.blocks(pa.array(texts, pa.string())):
        rows += [weights(x, kind) for x in buckets(data, offsets, kind)]
    return fit_weights(rows, labels, seed)


def fit_weights(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 0) -> tuple[np.ndarray, float]:
    """:func:`fit` on the :func:`weights` of each text."""
    random = np.random.default_rng(seed)
    y = np.array(labels, np.int64)
    vectors = random.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    texts_with = np.zeros(BUCKETS, np.int64)
    for ids, _ in rows:
        texts_with[ids] += 1
    trained = texts_with >= LEAST_TEXTS
    vectors[~trained] = 0
    linear, offset = random.uniform(-0.5, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen, seen_linear = np.full(BUCKETS, 1e-8, np.float32), np.full(linear.shape, 1e-8, np.float32)
    for epoch in range(EPOCHS):
        step = STEP * (1 - epoch / EPOCHS)
        order = random.permutation(len(y))
        for low in range(0, len(order), BATCH):
            batch = order[low : low + BATCH]
            ids = np.concatenate([rows[k][0] for k in batch])
            share = np.concatenate([rows[k][1] for k in batch])
            sizes = np.array([len(rows[k][0]) for k in batch])
            text = np.repeat(np.arange(len(batch)), sizes)
            mean = np.zeros((len(batch), DIM), np.float32)
            filled = sizes > 0
            if filled.any():
                mean[filled] = np.add.reduceat(vectors[ids] * share[:, None], (np.cumsum(sizes) - sizes)[filled], axis=0)
            logits = mean @ linear + offset
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = p
            error[np.arange(len(batch)), y[batch]] -= 1
            back = error @ linear.T
            slope = mean.T @ error / len(batch)
            seen_linear += slope**2
            linear -= step * slope / np.sqrt(seen_linear)
            offset -= 0.05 * step * error.mean(0)
            # one gradient a bucket: those of its texts, by their shares
            by = np.argsort(ids, kind="stable")
            ids, first = np.unique(ids[by], return_index=True)
            gradient = np.add.reduceat(back[text[by]] * share[by, None], first, axis=0)
            ids, gradient = ids[trained[ids]], gradient[trained[ids]]
            seen[ids] += (gradient**2).mean(1)
            vectors[ids] -= step * gradient / np.sqrt(seen[ids])[:, None]
    return vectors @ (linear[:, 1] - linear[:, 0]), float(offset[1] - offset[0])


def calibrated(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], totals: dict[int, int]) -> tuple[np.ndarray, float]:
    """Fit on three of four rows; the others, weighted to the true shares of the labels, give the logit's scale and offset."""
    rest = np.arange(len(rows)) % CALIBRATE > 0
    y = np.array(labels)
    if min(np.bincount(y[~rest], minlength=2)) < 5:
        return fit_weights(rows, labels)
    numbers, offset = fit_weights([x for x, use in zip(rows, rest) if use], y[rest].tolist())
    z = [offset + float(numbers[ids] @ share) for (ids, share), use in zip(rows, rest) if not use]
    z, y = np.array(z), y[~rest]
    weight = np.array([totals[k] for k in (0, 1)]) / np.bincount(y, minlength=2)
    weight = (weight / weight[y].mean())[y]
    scale = np.array([1.0, 0.0])
    x = np.stack([z, np.ones(len(z))], 1)
    for _ in range(50):  # Newton's steps of a logistic regression held to the fitted scale
        p = 1 / (1 + np.exp(-np.clip(x @ scale, -40, 40)))
        slope = x.T @ (weight * (p - y)) + 0.5 * (scale - [1.0, 0.0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        move = np.linalg.solve(curve, slope)
        scale -= move * min(1, 2 / np.abs(move).max())
    return numbers * scale[0], float(offset * scale[0] + scale[1])


def mean(numbers: np.ndarray, ids: np.ndarray, kind: Features) -> float:
    """Mean number of the features of a text; 0 without features."""
    if not len(ids):
        return 0.0
    if not kind.distinct:
        return float(numbers[ids].mean())
    has = np.zeros(BUCKETS, bool)
    has[ids] = True
    return float(numbers[has].mean())


def learn(labels: DataFrame, docs: DataFrame, label_col: str, kind: Features, text_col: str = "text", id_col: str = "doc_id") -> tuple[np.ndarray, float] | None:
    """Fit on a bounded sample of rows whose label is 0 or 1; None unless there are rows with a text.

    Ids are chosen among those whose text is there, from ids, labels and sizes alone: short texts by hash, then longer
    ones, shortest first. Their texts are then picked out of ``docs`` where they lie, by a broadcast of at most
    2 x SAMPLE ids, and become features there; the driver keeps these in a file. Of texts of one id the least of the
    smallest step counts.
    """
    ids = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"), F.xxhash64(F.col(f"`{id_col}`")).alias("order")).where("id is not null and label in (0, 1)")
    totals = {r.label: r["count"] for r in ids.groupBy("label").count().collect()}
    if not totals:
        return None
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id is not null and text is not null")
    texts = texts.withColumn("step", sample.step(F.octet_length("text"), SAMPLE_BYTES))
    sized = save(ids.distinct().join(texts.groupBy("id").agg(F.min("step").alias("step")), "id"), "labelled")
    counts = [(r.label, r.step, r["count"]) for r in sized.groupBy("label", "step").count().collect()]
    if not counts:
        forget(sized)
        return None
    turn = F.row_number().over(Window.partitionBy("label").orderBy("step", "order", "id"))
    asked = sized.where(sample.passing(counts, SAMPLE, F.col("label"), F.col("step"), F.col("order")))
    chosen = asked.withColumn("turn", turn).where(F.col("turn") <= SAMPLE).select("id", "step", "label", "order")
    whole = texts.join(F.broadcast(chosen), ["id", "step"]).groupBy("order", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in tb.blocks(batch.column(2)):
                both = [weights(x, kind) for x in buckets(data, offsets, kind)]
                parts = [pa.array([x[k].tobytes() for x in both], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns[:2], *parts], names=["order", "label", "ids", "shares"])

    made = save(map_batches(whole, run, "order long, label int, ids binary, shares binary"), "features")
    with tempfile.TemporaryFile() as file:
        found, at = [], 0
        for r in made.toLocalIterator():
            file.write(r.ids)
            file.write(r.shares)
            found.append((r.order, r.label, at, len(r.ids) // 4))
            at += 2 * len(r.ids)
        file.write(bytes(4))  # an empty file can't be mapped
        file.flush()
        data, found = np.memmap(file, np.int32, "r"), sorted(found)
        starts = [(x[2] // 4, x[3]) for x in found]
        rows = [(data[k : k + n], data[k + n : k + 2 * n].view(np.float32)) for k, n in starts]
        model = calibrated(rows, [x[1] for x in found], {k: totals.get(k, 0) for k in (0, 1)})
        del data, rows
    forget(sized, made)
    give_back()
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, kind: Features, text_col: str = "text", prior: float = 0.5) -> DataFrame:
    """``docs`` without its text plus score, the probability of label 1 (a column of that name is replaced).

    Null texts are empty ones; a text without features has the mean number 0. Without a model all get ``prior``.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "score")]
    if model is None:
        return docs.select(*kept, F.lit(prior).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    source = docs.select(*kept, F.col(f"`{text_col}`").cast("string").alias("_llm_text"))
    out, at = source.drop("_llm_text").withColumn("score", F.lit(0.0)).schema, len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, offset = shared.value
        for batch in batches:
            logit = np.full(batch.num_rows, offset)
            for low, _, data, offsets in tb.blocks(batch.column(at)):
                for k, ids in enumerate(buckets(data, offsets, kind)):
                    logit[low + k] += mean(numbers, ids, kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(1 / (1 + np.exp(-np.clip(logit, -50, 50))))], names=out.names)

    return map_batches(source, run, out)

