"""Tokens, languages, labels, secrets, phrases, search and chats."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer as Library

from overstats.llm import bpe, chat, decontaminate, langid, quality, search, secrets, subwords, toxicity
from overstats.llm.catalog import ORACLE, QUERIES
from tests.compare import connect, difference
from tests.llm import cases

FOLDER = "/root/testdata/sf0.001"


# --- tokens ----------------------------------------------------------------
def test_tokens_equal_the_library(spark):
    rng = random.Random(5)
    odd = ["<|endoftext|>", "a<|endoftext|> b", "  \n\n x", "it's I'LL", "a" * 500, " " * 300 + "b", "aaaa bbbb" * 30, "\x85  \xa0x", "١٢٣ ⅷ x²"]
    odd += ["".join(rng.choice("etaoinshr ") for _ in range(2000))]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000), rng.randrange(0x1F300, 0x1F600)])) for _ in range(40)) for _ in range(200)]
    docs = cases.documents(spark, [(400 + k, x) for k, x in enumerate(odd)])
    library = Library.from_file(bpe.default_path())
    both = bpe.encode(docs, bpe.default_path(), decoded_col="back")
    for r in both.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.back == library.decode(want, skip_special_tokens=False) == (r.text or "")
    again = bpe.decode(both.select("doc_id", "ids"), bpe.default_path()).where("doc_id = 305").first()
    assert again.decoded == docs.where("doc_id = 305").first().text
    assert bpe.encode(cases.empty(spark), bpe.default_path()).count() == 0


def test_bytes_that_are_no_text_decode_as_the_library_does(spark):
    library = Library.from_file(bpe.default_path())
    lists = [[bpe.Tokenizer(bpe.load(bpe.default_path())).byte_ids[b] for b in x] for x in (b"\xff", b"a\xc3", b"\xe2\x82", b"\xf0\x9f\x98z")] + [[], None]
    got = bpe.decode(spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, ids array<int>"), bpe.default_path()).collect()
    assert [r.decoded for r in sorted(got)] == [library.decode(x or [], skip_special_tokens=False) for x in lists]


def test_compatible_pairs_are_those_that_merging_leaves():
    t = bpe.Tokenizer(bpe.load(bpe.default_path()))
    rng = np.random.default_rng(1)
    tokens = np.array([x for x in t.vocab.values() if len(t.bytes[x]) < 8])
    a, b = rng.choice(tokens, 4000), rng.choice(tokens, 4000)
    assert t.compatible(a, b).tolist() == [t.exact(t.bytes[x] + t.bytes[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]


# --- phrases ---------------------------------------------------------------
def hits(text: str | None, windows: dict) -> tuple[int, set, set]:
    w = cases.alnum(text)
    hit, items = set(), set()
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                items |= windows[tuple(w[k : k + n])]
    return len(w), hit, items


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_phrases_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "PHRASE_BYTES", block)
    docs = cases.documents(spark)
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 250").collect()}
    items = [(1, texts[100]), (2, " ".join(texts[3].split()[:4]).upper()), (3, None), (4, ""), (None, texts[5]), (5, "nowhere at all"), (6, "one"), (7, texts[100])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows: dict = defaultdict(set)
    for i, t in items:
        w = cases.alnum(t)
        for k in range(max(1, len(w) - 9)) if w else ():  # phrases of items without id hit, but are no items
            windows[tuple(w[k : k + 10])] |= {str(i)} if i is not None else set()
    found = decontaminate.find(docs, bench)
    assert "source" in found.columns and found.columns.count("hits") == 1
    by_text = {(r.doc_id, r.text): hits(r.text, windows) for r in docs.collect()}
    want = sorted((str(i), n, len(h), sorted(x)) for (i, t), (n, h, x) in by_text.items() for _ in range(1 + (i == 307)))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, sorted(r["items"])) for r in found.collect()) == want
    cleaned = decontaminate.clean(docs, bench)
    assert cleaned.columns == docs.columns
    left = [(r.doc_id, r.text) for r in cleaned.collect()]
    assert not any(hits(t, windows)[1] for _, t in left)
    clean = {(i, t) for (i, t), (_, h, _) in by_text.items() if not h}
    assert clean <= set(left)
    assert {i for i, _ in left} == {i for (i, t), (n, h, _) in by_text.items() if len(h) < n or not n}


@pytest.mark.parametrize("size", [8 << 20, 60])
def test_a_cut_leaves_no_phrase_of_another_block(spark, monkeypatch, size):
    """Cutting one phrase joins the halves of another, whichever block is searched first."""
    monkeypatch.setattr(decontaminate, "PHRASE_BYTES", size)
    a, b, c = ([f"{x}{k}" for k in range(10)] for x in "abc")
    texts = [[*b[:5], *a, *b[5:]], [*a[:5], *b, *a[5:]], [*c[:3], *b[:5], *a[:9], *c, *a[9:], *b[5:], *c[3:]], ["only"]]
    docs = spark.createDataFrame([(k, " ".join(["x", *t, "y"]), k) for k, t in enumerate(texts)], "doc_id long, text string, CUT int")
    bench = spark.createDataFrame([("a", " ".join(a)), ("b", " ".join(b)), (None, " ".join(c)), ("b", " ".join(b))], "item_id string, text string")
    got = {r.doc_id: r.text.split() for r in decontaminate.clean(docs, bench).collect()}
    assert got == {0: ["x", "y"], 1: ["x", "y"], 2: ["x", "y"], 3: ["x", "only", "y"]}
    assert decontaminate.clean(docs, bench).columns == docs.columns


def test_batches_with_and_without_hits_in_one_task(spark):
    docs = spark.createDataFrame([(k, "red fox jumps over" if k % 40 == 7 else f"text {k}") for k in range(200)], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([("a", "fox jumps")], "item_id string, text string")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(setting)
    spark.conf.set(setting, "5")
    try:
        left = {r.doc_id: r.text for r in decontaminate.clean(docs, bench).collect()}
        assert len(left) == 200 and left[47].split() == ["red", "over"] and left[48] == "text 48"
        assert decontaminate.find(docs, bench).where("n_hit > 0").count() == 5
    finally:
        spark.conf.set(setting, was)


def test_no_phrases_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(cases.documents(spark), none).where("n_hit > 0").count() == 0
    assert decontaminate.clean(cases.empty(spark), none).count() == 0


def test_suffixes_are_in_order():
    rng = np.random.default_rng(0)
    symbols = np.concatenate([rng.integers(0, 4, 300), np.tile([1, 2, 3], 40), [0]])
    separate = iter(range(len(symbols)))
    ranks = [(0, next(separate)) if x == 0 else (1, x) for x in symbols.tolist()]
    assert decontaminate.suffix_array(symbols).tolist() == sorted(range(len(symbols)), key=lambda k: ranks[k:])


# --- languages and labels --------------------------------------------------
def test_languages_are_told_apart(spark):
    got = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    both = got.join(docs, "doc_id")
    assert both.where("held_out and lang = lang_pred").count() >= 0.98 * both.where("held_out").count() > 0
    assert both.where("score < 0 or score > 1").count() == 0


def test_language_of_odd_texts(spark):
    model = langid.fit(["the cat and the dog", "of the and", "le chat et la souris", "de la et"], ["en", "en", "fr", "fr"])
    docs = cases.documents(spark)
    got = langid.predict(docs, model)
    assert got.columns.count("score") == 1 and got.count() == docs.count()
    assert {r.doc_id for r in got.where("lang_pred = 'und' and score = 0").collect()} == {300, 301, 302, 309, None}
    assert langid.learn(cases.empty(spark)) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_languages_of_long_texts_and_of_few_short_ones_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 24)
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 100)
    seen = []
    fit = langid.fit_packed
    monkeypatch.setattr(langid, "fit_packed", lambda texts, languages: seen.append((texts, languages)) or fit(texts, languages))
    short = [(k, f"the cat and the dog {k}", "en") for k in range(10)]
    rows = short + [(100 + k, f"the house of the cat {k} " * 30, "en") for k in range(4000)]
    rows += [(9000 + k, "le chat et la souris " * (10 + k), "fr") for k in range(30)] + [(9500 + k, "42 -- !!", "en") for k in range(500)]
    rows += [(9999, "el gato y el perro", "es")] * 3000
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model[0] == ["en", "es", "fr"]
    (texts, languages), = seen
    assert Counter(languages) == {"en": 8, "es": 1, "fr": 8}
    pack = lambda x: langid.packed(*langid.tb.utf8(langid.pa.array([x])))[0]
    assert {x for x, y in zip(texts, languages) if y == "en"} <= {pack(t) for _, t, _ in short}
    docs = spark.createDataFrame([(1, "la souris et le chat"), (2, "the dog and the cat")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()} == {1: "fr", 2: "en"}


def test_landmark_scores_are_ridge_regression():
    texts = ["the cat", "a dog and cat", "le chat", "et la souris", "un chien"]
    names, matrix = langid.fit(texts, ["en", "en", "fr", "fr", "fr"])
    x = langid.presence(*langid.tb.utf8(langid.pa.array(texts))).astype(float)
    x /= np.sqrt(x.sum(1, keepdims=True))
    kernel = x @ x.T
    target = np.array([[1, 0], [1, 0], [0, 1], [0, 1], [0, 1]], float)
    want = kernel @ np.linalg.solve(kernel + langid.RIDGE * 5 * np.eye(5), target)
    assert names == ["en", "fr"] and np.allclose(x @ matrix, want, atol=1e-3)


def test_labels_are_learned(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for name, label, least in (("op2_toxicity", "toxic", 0.85), ("op5_quality", "quality", 0.95)):
        both = QUERIES[name](spark, folder).join(labels, "doc_id").where("held_out")
        assert both.where(f"predicted = {label}").count() >= least * both.count() > 0


@pytest.mark.parametrize("kind", [toxicity.FEATURES, quality.FEATURES])
def test_labels_of_long_texts_are_learned(spark, monkeypatch, kind):
    monkeypatch.setattr(subwords, "SAMPLE", 40)
    monkeypatch.setattr(subwords, "SAMPLE_BYTES", 200)
    sizes = []
    calibrated = subwords.calibrated
    monkeypatch.setattr(subwords, "calibrated", lambda rows, labels, totals: sizes.append(Counter(labels)) or calibrated(rows, labels, totals))
    good = [(k, f"good words there {k % 9}" * (1 if k % 50 == 0 else 40), 0) for k in range(3000)]  # 60 short ones
    bad = [(5000 + k, f"bad words here {k % 9} " * (20 + k), 1) for k in range(60)]
    lost = [(8000 + k, None, 1) for k in range(200)]
    rows = spark.createDataFrame(good + bad + lost, "doc_id long, text string, toxic int")
    docs = rows.select("doc_id", "text").where("doc_id < 8100")
    model = subwords.learn(rows.select("doc_id", "toxic"), docs, "toxic", kind)
    assert sizes == [{0: 40, 1: 40}]
    got = {r.doc_id: r.score for r in subwords.score(docs, model, kind).collect()}
    assert min(got[5000 + k] for k in range(60)) > max(got[k] for k in range(3000))


@pytest.mark.parametrize("kind", [toxicity.FEATURES, quality.FEATURES])
def test_scores_of_odd_texts(spark, kind):
    model = subwords.fit(["bad words here", "good words there"] * 9, [1, 0] * 9, kind)
    docs = cases.documents(spark)
    got = subwords.score(docs, model, kind)
    assert got.columns.count("score") == 1 and got.count() == docs.count()
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    assert len({r.score for r in got.where("doc_id in (300, 301, 302)").collect()}) == 1
    assert subwords.learn(spark.createDataFrame([], "doc_id long, toxic int"), docs, "toxic", kind) is None
    assert {r.score for r in subwords.score(docs, None, kind).collect()} == {0.5}


def test_features_are_n_grams_between_marks():
    kind = subwords.Features(2, 3, True, False, False)
    own = [subwords.buckets(*subwords.tb.utf8(subwords.pa.array([t])), kind)[0] for t in ("ab", "AB!", "ba", "", "abc")]
    assert [len(x) for x in own] == [5, 5, 5, 0, 7]  # <a ab b> <ab ab>
    assert sorted(own[0]) == sorted(own[1]) != sorted(own[2])
    assert set(own[0]) & set(own[4])


# --- secrets ---------------------------------------------------------------
def spans(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secrets_equal_brute_force(spark):
    odd = ["password: token: abcdefgh", "é😀 PassWord = 'abc.def-1'", "api_key=abcde apikey=abcdefg", "token=token=secret1", "AKIA" + "A" * 15 + " AKIA" + "B" * 16,
           "x" + "0" * 23 + " " + "f" * 24, "secret:" + "é" * 9, "token='Zz9Yy8Xx7Ww6Vv5Uu4Tt'", "paſſword=abcdefgh", "toKen=abcdefgh", "Aa1" * 9, "secret=abcdef" * 400]
    more = [(400 + k, x) for k, x in enumerate(odd)] + [(500 + k, "token = copied1widely2Example3") for k in range(4)]
    docs = cases.documents(spark, more).withColumnRenamed("hits", "base")
    got = secrets.find(docs)
    assert got.count() == docs.count() and got.columns.count("base") == 1
    texts = {r.doc_id: r.text for r in docs.collect()}
    names = (*secrets.KINDS,)
    for r in got.where("doc_id is not null").collect():
        assert [(x.start, names.index(x.kind), x.end) for x in r.base] == spans(texts[r.doc_id])
    added = {r.doc_id: [texts[r.doc_id][x.start : x.end] for x in r.added] for r in got.where("doc_id >= 400").collect()}
    assert added[407]
    copied = {r.doc_id: r.base[0] for r in got.where("doc_id >= 500").collect()}
    assert {(x.owners, x.repos) for x in copied.values()} == {(len({r.source for r in docs.where("doc_id >= 500").collect()}), 4)}
    assert all(not added[500 + k] for k in range(4))
    assert secrets.find(cases.empty(spark)).count() == 0


def test_copies_within_one_source_or_none_are_examples(spark):
    live, pasted, shared = ("Zz9Yy8Xx7Ww6Vv5Uu4Tt" + x for x in "abc")
    rows = [(k, f"token={pasted}", "hot") for k in range(40)] + [(100, f"token={live}", "hot"), (101, f"again {live}", "hot")]
    rows += [(200 + k, f"token={shared}", None) for k in range(4)] + [(300, f"key {live}N", None)]
    rows += [(None, f"key {shared}N", None) for _ in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = secrets.find(docs).collect()
    assert {r.doc_id for r in got if r.added} == {100, 101, 300}
    seen = {r.doc_id: (r.base[0].owners, r.base[0].repos) for r in got if r.base}
    assert (seen[0], seen[100], seen[200]) == ((1, 40), (1, 2), (4, 4))


# --- search ----------------------------------------------------------------
def test_search_equals_full_scoring(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_BYTES", 9000)
    monkeypatch.setattr(search, "QUERY_BYTES", 9000)
    monkeypatch.setattr(search, "FIRST", 20)
    monkeypatch.setattr(search, "BLOCK", 4)
    docs = cases.documents(spark, n=90).where("doc_id is not null")
    rows = [(r.doc_id, Counter(cases.alnum(r.text))) for r in docs.collect()]
    queries = docs.where("doc_id % 10 = 0").selectExpr("doc_id as id", "text")
    n, mean = len(rows), sum(sum(x.values()) for _, x in rows) / len(rows)
    df = Counter(x for _, own in rows for x in own)
    got = defaultdict(list)
    for r in search.search(docs.repartition(3), queries, k=5).orderBy("query", "rank").collect():
        got[r["query"]].append((round(r.score, 6), r.doc_id))
    for q in queries.collect():
        asked, want = set(cases.alnum(q.text)), []
        for i, own in rows:
            score = sum(math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * own[x] * 2.2 / (own[x] + 1.2 * (0.25 + 0.75 * sum(own.values()) / mean)) for x in asked if x in own)
            if score > 0:
                want.append((-round(score, 6), i))
        assert got.get(q.id, []) == [(-s, i) for s, i in sorted(want)[:5]]
    none = spark.createDataFrame([], "id long, text string")
    assert search.search(docs, none).count() == 0
    assert search.search(cases.empty(spark), queries).count() == 0


@pytest.mark.parametrize("cells", [1 << 24, 4000])
def test_common_terms_are_no_lists(monkeypatch, cells):
    """Lists that are read are those of rarer terms, and the best are those of full scoring, to the ninth digit."""
    monkeypatch.setattr(search, "FIRST", 50)
    monkeypatch.setattr(search, "REST", 0.3)
    monkeypatch.setattr(search, "BLOCK", 16)
    monkeypatch.setattr(search, "CELLS", cells)
    draw = np.random.default_rng(5)
    counts = [Counter((draw.zipf(1.3, 60) % 400).tolist()) for _ in range(600)]
    found = [(np.array(sorted(x)), np.array([x[t] for t in sorted(x)]), 60) for x in counts]
    df = Counter(t for x in counts for t in x)
    idf = np.array([math.log(1 + (600 - df[t] + 0.5) / (df[t] + 0.5)) for t in range(400)])
    weight = lambda x, t: idf[t] * x[t] * 2.2 / (x[t] + 1.2) if t in x else 0.0
    queries = [found[k][0] for k in range(0, 600, 20)] + [np.array([399]), np.zeros(0, int)]
    want = [[sum(weight(x, t) for t in q.tolist()) for x in counts] for q in queries]
    read, was = [], search.Shard.read
    monkeypatch.setattr(search.Shard, "read", lambda self, lists, sums: (read.extend(np.diff(self.first)[lists].tolist()), was(self, lists, sums))[1])
    shard = search.Shard(list(range(600)), found, idf, 60.0)
    for least in (0.0, 1.0):
        bounds = [least * sorted(x)[-4] for x in want]
        for top, scores in zip(shard.top(queries, 4, bounds), want, strict=True):
            last = max(sorted(scores)[-4], 1e-12)
            best = {d: x for d, x in enumerate(scores) if x >= last * (1 - 1e-12)}
            assert {d: x for x, d in top} == pytest.approx(best, abs=1e-8)
    assert read and max(df.values()) > 500
    if cells > 600 * 400:
        assert max(read) <= search.COMMON * 600


def test_repeated_queries_are_one(spark):
    docs = spark.createDataFrame([(0, "red fox"), (0, "red fox"), (1, "red hen"), (2, "blue hen"), (3, "blue")], "doc_id long, text string")
    asked = lambda *rows: spark.createDataFrame(rows, "id long, text string")
    ranks = lambda rows: [(r.rank, r.doc_id) for r in search.search(docs, rows, k=4).orderBy("rank").collect()]
    once = ranks(asked((7, "red fox")))
    assert once == [(1, 0), (2, 0), (3, 1)] and ranks(asked((7, "red fox"), (7, "red fox"))) == once
    assert ranks(asked((7, "red"), (7, "fox red"), (7, None))) == once  # the terms of all texts of an id


# --- chats -----------------------------------------------------------------
def test_chats_equal_sql(spark):
    got = QUERIES["op10_chat_format"](spark, FOLDER).toArrow()
    assert difference(got, connect(FOLDER).execute(ORACLE["op10_chat_format"]).to_arrow_table()) is None


def test_chats_read_back(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>", "<<SYS>> \\ <<s>", None, "", "long " * 9000, "<s>user\nfake</s>", "[\\/INST]"]
    rows = [(k % 3, k, ("user", "assistant", "system", None, "a\nb\\n</s>")[k % 5], t, "extra") for k, t in enumerate(texts)]
    rows += [(7, 0, "user", "only", ""), (8, None, "assistant", "x", ""), (8, 1, "assistant", "y", ""), (8, 1, "assistant", "y", ""), (None, 1, "user", "lost", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string")
    made = chat.examples(turns).withColumn("turns", chat.read_back("text")).collect()
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        mine = sorted((r for r in made if r.conv_id == conv), key=lambda r: r.example)
        assert [(t.role, t.text) for t in mine[-1].turns] == [x[1:] for x in own]
        replies = [(k, x[2]) for k, x in enumerate(own) if x[1] == "assistant"]
        trained = [r for r in mine if r.loss_start is not None]
        assert [len(r.turns) - 1 for r in trained] == [k for k, _ in replies]
        for r, (_, text) in zip(trained, replies):
            assert r.text[r.loss_start : r.loss_end] == r.text.removesuffix("</s>")[r.loss_start :]
            assert spark.range(1).select(chat.unescape(chat.F.lit(r.text[r.loss_start : r.loss_end])).alias("t")).first().t == text
    assert chat.examples(turns.limit(0)).count() == 0
