"""Periodic runs against trying every period."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np

from overstats.llm import periods
from tests.llm import cases


def brute(w: list) -> list[tuple[int, int, int]]:
    best: dict = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in best.items())


def sequence(rng: random.Random) -> list[int]:
    n, kind = rng.randrange(200), rng.randrange(5)
    if kind < 2:
        return [rng.randrange(kind + 1) for _ in range(n)]
    out: list[int] = [0]
    while len(out) < n and kind == 2:
        base = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
        out += (base * rng.randrange(1, 12))[: rng.randrange(1, 80)]
    before = [1]
    while len(out) < n and kind == 3:
        before, out = out, out + before
    for _ in range(rng.randrange(6) if kind == 4 else 0):
        out = (out + [rng.randrange(3) for _ in range(rng.randrange(5))]) * rng.randrange(1, 6)
    return out[:500]


def test_runs_equal_those_of_all_periods():
    rng = random.Random(11)
    for _ in range(400):
        texts = [sequence(rng) for _ in range(rng.randrange(1, 5))]
        ids = periods.numbered([[str(x).encode() for x in t] for t in texts])
        want, begin = [], 0
        for t in texts:
            want += [(s + begin, n, q) for s, n, q in brute(t)]
            begin += len(t)
        assert list(zip(*(x.tolist() for x in periods.runs(ids)))) == want


def test_long_and_regular_texts_stay_fast():
    for words, n in ((np.zeros(200_000, np.int64), 1), (np.tile(np.arange(5000), 40), 1), (np.arange(200_000), 0)):
        assert len(periods.runs(words)[0]) == n


def test_symbols_of_a_round_derive_the_text():
    words = np.array([x for x in b"abcabcabcabcxyabcabxyabcab"], np.int64)
    for first, border, end, symbol, at in periods.grammar(words, np.zeros(len(words), np.int64)):
        for k, place in zip(symbol.tolist(), at.tolist()):
            size = end[k] - first[k]
            assert first[k] < border[k] < end[k] and words[place : place + size].tolist() == words[first[k] : end[k]].tolist()
    assert (int(first[0]), int(end[0])) == (0, len(words))


def test_query_equals_brute_force(spark):
    rng = random.Random(2)
    more = [(500 + k, " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for k in range(60)]
    more += [(600, "x y " * 9), (601, "é\u0085é " * 12 + "\x1c q"), (602, "a\x0bb\x0cc\r" * 8), (603, "tail " * 3000)]
    docs = cases.documents(spark, more)
    got = sorted(map(tuple, periods.digests(docs).collect()), key=repr)
    want = []
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            w = w[:a] + [w[a + i % (1 + (len(w) - a) // (3 + g % 8))] for i in range(len(w) - a)]
        found = brute(w)
        s, n, q = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
        gone = {i for a, m, p in found for i in range(a + p, a + m)}
        want.append((r.doc_id, len(found), s, n, q, 1000 * n // q if found else None, hashlib.sha256("".join(f"{a},{m},{p}\n" for a, m, p in found).encode()).hexdigest(),
                     hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in got) > 20


def test_other_columns_and_empty_tables(spark):
    docs = cases.documents(spark).withColumnRenamed("hits", "RUNS").withColumnRenamed("k0", "by")
    found = periods.find(docs)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "by", "component_id", "runs", "kept_words"]
    assert found.count() == docs.count()
    assert periods.digests(cases.empty(spark)).count() == 0
