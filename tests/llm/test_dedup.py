"""MinHash groups and repeated lines against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from overstats.llm import linededup, minhash
from overstats.llm.components import components
from tests.llm import cases


def shingles(text: str | None, width: int) -> frozenset:
    w = cases.words(text)
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def groups(rows: list[tuple], width: int) -> dict:
    """Set of each row's text and the smallest id that links reach."""
    sets = list({shingles(t, width) for _, t in rows} - {frozenset()})
    root = {s: s for s in sets}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for k, a in enumerate(sets):
        for b in sets[:k]:
            if 100 * len(a & b) >= 80 * len(a | b):
                root[find(a)] = find(b)
    ids: dict = {}
    for i, t in rows:
        if (s := shingles(t, width)) and i is not None:
            ids[find(s)] = min(i, ids.get(find(s), i))
    return {s: ids.get(find(s)) for s in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_groups_equal_all_pairs(spark, width):
    docs = cases.documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = groups(rows, width)
    got = minhash.near_duplicates(docs, width=width).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted(
        (str(i), len(shingles(t, width)), str(want[shingles(t, width)] if shingles(t, width) else i)) for i, t in rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_columns_of_any_name(spark):
    docs = cases.documents(spark, n=5)
    for name in ("_w", "_k0", "_K1", "_n", "c1"):
        docs = docs.withColumn(name, docs.hits)
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns and {r["_K1"] for r in kept.collect()} == {7}
    assert kept.count() == minhash.deduplicate(cases.documents(spark, n=5)).count()


def test_one_of_each_group_stays(spark):
    docs = cases.documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = groups(rows, 5)
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    filled = [shingles(t, 5) for _, t in got if shingles(t, 5)]
    assert len(filled) == len(set(filled)) == len(set(want.values()))
    assert sum(not shingles(t, 5) for _, t in got) == sum(not shingles(t, 5) for _, t in rows)
    assert {i for i, t in got if shingles(t, 5)} == set(want.values())


def test_one_of_near_equal_rows_of_one_id_or_none_stays(spark):
    words = [f"n{k}" for k in range(90)]
    near = lambda mark, n: [" ".join([*(f"{mark}{x}" for x in words), *(f"{mark}t{j}" for j in range(k))]) for k in range(n)]
    rows = [(1, t) for t in near("a", 3)] + [(None, t) for t in near("b", 4)] + [(None, near("b", 1)[0])]
    rows += [(None, near("c", 1)[0]), (7, near("c", 2)[1]), (7, near("c", 3)[2]), (8, near("c", 1)[0])]
    got = minhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.text[0], r.doc_id) for r in got) == [("a", 1), ("b", None), ("c", 7)]


def test_a_hub_whose_copies_are_far_from_each_other(spark):
    rng = random.Random(4)
    base = [f"b{k}" for k in range(120)]
    more = []
    for k in range(60):
        own = list(base)
        for at in rng.sample(range(120), rng.randrange(2, 16)):
            own[at] = f"r{k}_{at}"
        more.append((1000 + k, " ".join(own)))
    docs = spark.createDataFrame([(1100, " ".join(base)), *more], "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = groups(rows, 2)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, width=2).collect()} == {i: want[shingles(t, 2)] for i, t in rows}


def test_empty_table_has_no_groups(spark):
    assert minhash.near_duplicates(cases.empty(spark)).count() == 0
    assert minhash.deduplicate(cases.empty(spark)).columns == cases.empty(spark).columns


def test_block_intersections():
    rng = np.random.default_rng(2)
    a, b = ([np.unique(rng.integers(0, 9000, rng.integers(1, 5000)).astype(np.uint64)) for _ in range(7)] for _ in range(2))
    assert (minhash.intersections(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(500, 500 + k) for k in range(20)] + [(600 + k, 601 + k) for k in range(40)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            root[max(find(u), find(v))] = min(find(u), find(v))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_lines(rows: list[tuple[int, str]], min_words: int) -> dict[int, str | None]:
    """Each text without lines of runs that begin at an earlier place too."""
    seqs = []
    for i, t in sorted(rows):
        lines = t.split("\n")
        seqs.append((i, lines, [(k, x.strip(" \t\n\r\x0b\x0c")) for k, x in enumerate(lines) if cases.WORD.search(x.encode())]))
    out: dict[int, str | None] = {}
    for a, (i, lines, seq) in enumerate(seqs):
        size, gone = [len(cases.words(x)) for _, x in seq], set()
        for p in range(len(seq)):
            longest = 0
            for b in range(a + 1):
                for q in range(len(seqs[b][2]) if b < a else p):
                    n = 0
                    while p + n < len(seq) and q + n < len(seqs[b][2]) and seq[p + n][1] == seqs[b][2][q + n][1]:
                        n += 1
                    longest = max(longest, n)
            if sum(size[p : p + longest]) >= min_words:
                gone |= {seq[p + n][0] for n in range(longest)}
        text = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out[i] = text if not gone or re.search(r"[^\x20\x09-\x0D]", text) else None
    return out


@pytest.mark.parametrize("min_words", [1, 6, 50])
def test_lines_equal_brute_force(spark, min_words):
    rng = random.Random(min_words)
    pool = [" ".join(f"t{rng.randrange(50)}" for _ in range(rng.randrange(1, 9))) for _ in range(14)] + ["", " ", "\ta b "]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for k in range(26)]
    rows += [(90, rows[0][1]), (91, "\n".join(["same words here"] * 9)), (92, "\n".join(["again and again"] * 60))]
    got = {r.doc_id: r.text for r in linededup.delete_repeats(spark.createDataFrame(rows, "doc_id long, text string"), min_words=min_words).collect()}
    assert got == {i: t for i, t in brute_lines(rows, min_words).items() if t is not None}


def test_odd_rows_keep_their_lines(spark):
    docs = cases.documents(spark)
    got = linededup.delete_repeats(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    before = [(r.doc_id, r.text) for r in docs.collect()]
    for i in (300, 301, 302, 303, 304, 305, 306, 308, 309):
        assert [x for x in kept if x[0] == i] == [x for x in before if x[0] == i]
    assert sum(x[0] == 307 for x in kept) == 1  # rows that repeat are one document
    assert linededup.delete_repeats(cases.empty(spark)).count() == 0
