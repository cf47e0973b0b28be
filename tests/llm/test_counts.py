"""Token counts against the library, whitening against a plain eigendecomposition."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from overstats.llm import tokencount, whitening
from tests.llm import cases


# --- token counts ------------------------------------------------------------
def odd_texts() -> list[str]:
    rng = random.Random(3)
    odd = [" ", "  ", "a ", " a", "  a  b ", "a\nb\n\nc", "\n", "\ta\t", "<s> </s><unk> <0x0A>", "a▁b▁▁c", "▁", "\x00a", "a\r\nb", "x².y ²³ ½", "123,456.78", "ﬁ Å ﷺ", "日本語のテキスト。", "a_b__c d_", "…… !!! ??", "x" * 3000, "🙂🙂 👨‍👩‍👧"]
    for _ in range(300):
        odd.append("".join(chr(rng.choice([32, 32, 10, 0x2581, rng.randrange(33, 127), rng.randrange(0xA0, 0x600), rng.randrange(0x900, 0xE00), rng.randrange(0x3040, 0x3100), rng.randrange(0x4E00, 0x5000), rng.randrange(0x1F300, 0x1F600)])) for _ in range(30)))
    return odd


@pytest.mark.parametrize("hot", [0, 40, tokencount.HOT])
def test_counts_equal_the_library(spark, hot):
    """Whichever pre-tokens the broadcast table holds."""
    library = sentencepiece.SentencePieceProcessor(model_file=tokencount.default_path())
    docs = cases.documents(spark, [(400 + k, x) for k, x in enumerate(odd_texts())])
    got = tokencount.count_tokens(docs, hot=hot)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert got.columns == [*docs.columns, "n_bytes", "n_tokens"]
    assert "text" not in tokencount.count_tokens(docs, hot=hot, keep_text=False).columns


def test_every_distinct_pretoken_is_counted_once(spark):
    docs = cases.documents(spark)
    counts = tokencount.Counts(tokencount.load(tokencount.default_path()))
    table = tokencount.vocabulary(docs.select("text"), tokencount.load(tokencount.default_path())).collect()
    want = Counter(x for r in docs.collect() for x in set(tokencount.pretokens(r.text or "", counts.pattern)))
    assert {bytes(r.key): r.texts for r in table} == {tokencount.key(k): n for k, n in want.items()}
    assert len(table) == len(want)


def test_commonest_rows_keep_their_bound(spark):
    table = spark.createDataFrame([(str(k).encode(), 1, 1 + 1000 // (k + 1)) for k in range(500)], "key binary, tokens long, texts long")
    for most in (0, 1, 7, 100, 499, 500):
        common, rare = tokencount.commonest(table, most)
        assert common.count() <= most and common.count() + rare.count() == 500
    assert tokencount.commonest(table, 500)[1].count() == 0


def test_clashing_names_and_empty_tables(spark):
    docs = cases.documents(spark).withColumnRenamed("hits", "N_Tokens").withColumnRenamed("k0", "row").withColumnRenamed("lang", "key")
    got = tokencount.count_tokens(docs, hot=5)
    assert got.columns == ["doc_id", "text", "key", "source", "n_chars", "score", "row", "component_id", "n_bytes", "n_tokens"]
    assert got.count() == docs.count() and {r.row for r in got.collect()} == {8}
    assert tokencount.count_tokens(cases.empty(spark)).count() == 0


# --- whitening ---------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, component string, note string"


def vectors(spark, values: np.ndarray, more: list = ()):
    rows = [(k, [float(x) for x in v], "c", None) for k, v in enumerate(values)] + list(more)
    return spark.createDataFrame(rows, VECTORS)


def plain(values: list[list[float]], many: int = 16):
    x = np.floor(64 * np.array(values, np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    v = np.cov(fit.T.astype(float), bias=True)
    e, axes = (a[..., ::-1] for a in np.linalg.eigh(v))
    return n, ((n * x - s) ** 2).sum(1), ((x - s / n) @ axes / np.sqrt(e))[:, :many], e[:many] / e.sum()


def test_whitened_equals_a_plain_solution(spark):
    rng = np.random.default_rng(4)
    values = (rng.normal(size=(300, 24)) * np.linspace(0.3, 4, 24) + 5).astype(np.float32)
    values[20:60] = values[10]  # copies: fitted once
    more = [(900, None, "c", None), (901, [1.0, None] * 12, "c", None), (902, [float("nan")] * 24, "c", None), (903, [float("inf")] + [0.0] * 23, "c", None),
            (904, [], "c", None), (905, [1.0, 2.0], "c", None), (906, [3e38] * 24, "c", None), (None, values[0].tolist(), "c", None)]
    got = whitening.whiten(vectors(spark, values, more))
    assert got.columns == ["vec_id", "note", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = sorted(got.collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0, r.component))
    n, far, white, share = plain([*values.tolist(), values[0].tolist()])
    assert len(rows) == 301 * 16
    assert {r.n for r in rows} == {n} and [int(r.deviation) for r in rows[::16]] == far.tolist()
    out = np.array([r.whitened for r in rows]).reshape(-1, 16)
    assert np.abs(out * np.sign((out * white).sum(0)) - white).max() < 1e-9
    assert np.abs([r.explained for r in rows[:16]] - share).max() < 1e-12
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-10


def test_wide_entries_stay_exact(spark):
    rng = np.random.default_rng(5)
    values = (rng.normal(size=(40, 3)) * [1e9, 1e3, 1.0]).astype(np.float32)
    got = whitening.whiten(vectors(spark, values)).where("component = 1").collect()
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in values]
    s = [sum(c) for c in zip(*x)]
    assert {r.vec_id: int(r.deviation) for r in got} == {k: sum((40 * a - b) ** 2 for a, b in zip(v, s)) for k, v in enumerate(x)}


def test_products_are_exact():
    rng = np.random.default_rng(6)
    for most in (5, 1 << 19, 1 << 40, 1 << 55):
        y = rng.integers(-most, most, (50, 3))
        parts = whitening.limbs(y)
        whole = sum(np.vectorize(int, otypes=[object])(p) * (1 << (whitening.LIMB * k)) for k, p in enumerate(parts))
        assert whole.tolist() == y.tolist()


@pytest.mark.parametrize("values", [
    np.linspace(1, 2, 30), [1.0] * 10 + [0.5] * 20 + [0.25] * 2 + [0.1, 0.2], 1 + 1e-9 * np.arange(12),
    [*(1 + 1e-8 * np.arange(6)), *(0.3 + 1e-10 * np.arange(6)), 0.7], 10.0 ** -np.arange(12), [3.0], [1.0] * 5])
def test_refined_eigenvectors(values):
    rng, values = np.random.default_rng(7), np.array(values, np.longdouble)
    d = len(values)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q + q @ (np.eye(d) - q.T @ q) / 2
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    e, v = whitening.eigen(a)
    assert np.abs(e - np.sort(values)[::-1]).max() < 1e-16 * d
    assert np.abs(a @ v - v * e).max() < 1e-16 * d and np.abs(v.T @ v - np.eye(d)).max() < 1e-15


def test_few_vectors(spark):
    for values in (np.zeros((0, 3)), np.ones((1, 3)), np.ones((5, 3))):
        got = whitening.whiten(vectors(spark, values.astype(np.float32)))
        assert got.count() == 0 and got.columns[-1] == "identity_error"
    line = whitening.whiten(vectors(spark, np.outer(np.arange(5), [1.0, 2.0, 0.0]).astype(np.float32))).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12
