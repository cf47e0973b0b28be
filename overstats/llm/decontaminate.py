"""Benchmark decontamination: an FM-index per shard of the corpus, searched for every benchmark phrase.

A phrase is a window of ``WINDOW`` consecutive words of a benchmark item (an item of fewer words is one phrase).
Each task cuts its texts into shards and builds, over the words of a shard, a suffix array, its Burrows-Wheeler
transform and a wavelet matrix of that. Backward search narrows all phrases at once, one word a step, by wavelet
ranks; occurrences are located by walking back to sampled suffix positions, and their word spans are merged.

Words that no phrase has can't be part of an occurrence: a run of them is one separator of the index. Texts never
leave their task and nothing is shuffled. Phrases go to the tasks in blocks of items whose text is at most
``PHRASE_BYTES`` (one block, unless a single item is longer); every block is searched in every text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overstats.llm import textbytes as tb
from overstats.llm.store import map_batches, save

WINDOW = 10
#: Text of benchmark items sent to each task at a time.
PHRASE_BYTES = 8 << 20
#: Bytes of text in a shard, unless a text is longer.
SHARD = 4 << 20
#: Every so many positions of a shard is kept with the index.
SAMPLE = 32


class Phrases:
    """Distinct windows of benchmark items over a small vocabulary."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        data, offsets = tb.utf8(pa.array([text for _, text in items], pa.string()))
        data = tb.LOWER[data]
        starts, ends, bounds = tb.words(data, offsets, tb.ALNUM)
        hashed = tb.hashes(data, starts, ends)
        self.vocabulary = np.unique(hashed)
        ids = np.searchsorted(self.vocabulary, hashed) + 1
        numbers: dict[tuple, int] = {}
        owners: list[set[str]] = []
        for (name, _), low, high in zip(items, bounds[:-1], bounds[1:]):
            own = ids[low:high].tolist()
            for at in range(max(1, len(own) - window + 1)) if own else ():
                number = numbers.setdefault(tuple(own[at : at + window]), len(numbers))
                if number == len(owners):
                    owners.append(set())
                if name is not None:
                    owners[number].add(name)
        self.owners = [sorted(x) for x in owners]
        self.lengths = np.array([len(x) for x in numbers], np.int64)
        #: Words of each phrase from its last one on, as backward search takes them.
        self.reversed = np.zeros((len(numbers), window), np.int64)
        for number, phrase in enumerate(numbers):
            self.reversed[number, : len(phrase)] = phrase[::-1]


class Wavelet:
    """Ranks of symbols in a sequence: one bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.levels = []
        for bit in range(width - 1, -1, -1):
            ones = (symbols >> bit) & 1 == 1
            packed = np.packbits(ones, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            counts = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=counts[1:])
            self.levels.append((bit, packed, counts, len(symbols) - int(counts[-1])))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position ``at``."""
        low, at = np.zeros(len(at), np.int64), at.copy()
        for bit, packed, counts, zeros in self.levels:
            one = (symbols >> bit) & 1 == 1
            for x in (low, at):
                word = x >> 6
                inside = packed[word] & ((np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1))
                ranks = counts[word] + np.bitwise_count(inside)
                x[:] = np.where(one, zeros + ranks, x - ranks)
        return at - low


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``symbols`` (0: separators, each its own symbol, in order of position; the last is one)."""
    n = len(symbols)
    separators = np.flatnonzero(symbols == 0)
    rank = symbols + len(separators) - 1
    rank[separators] = np.arange(len(separators))
    bits = max(1, int(rank.max()).bit_length())
    step = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(step):
        key <<= bits
        key[: max(0, n - k)] |= rank[k:]
    order = np.argsort(key)
    key = key[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while True:  # ranks double in depth; only suffixes that are still tied are sorted again
        tied = ~(first & np.concatenate([first[1:], [True]]))
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        own = order[at]
        group, nxt = rank[own], rank[own + step]
        again = np.lexsort((nxt, group))
        own, group, nxt = own[again], group[again], nxt[again]
        order[at] = own
        first[at] = np.concatenate([[True], (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])])
        rank[own] = np.maximum.accumulate(np.where(first[at], at, 0))
        step *= 2


class Index:
    """FM-index of a sequence of word numbers; 0 separates and ends it."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        order = suffix_array(symbols)
        self.bwt = symbols[order - 1]  # before the first suffix stands the last separator
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols + 1))])
        self.wavelet = Wavelet(self.bwt, max(1, n_symbols.bit_length()))
        self.sampled = (order % SAMPLE == 0) | (self.bwt == 0)
        self.positions = order[self.sampled]
        self.place = np.cumsum(self.sampled) - 1

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of all occurrences."""
        n = len(phrases.lengths)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.bwt), np.int64)
        active = np.arange(n)
        for step in range(phrases.reversed.shape[1]):
            active = active[(phrases.lengths[active] > step) & (high[active] > low[active])]
            symbol = phrases.reversed[active, step]
            low[active] = self.before[symbol] + self.wavelet.rank(symbol, low[active])
            high[active] = self.before[symbol] + self.wavelet.rank(symbol, high[active])
            # a phrase that ended keeps its interval
        counts = np.maximum(high - low, 0)
        which = np.repeat(np.arange(n), counts)
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        found = np.zeros(len(rows), np.int64)
        walking, steps = np.arange(len(rows)), 0
        while len(walking):
            here = rows[walking]
            done = self.sampled[here]
            found[walking[done]] = self.positions[self.place[here[done]]] + steps
            walking, here = walking[~done], here[~done]
            symbol = self.bwt[here]
            rows[walking] = self.before[symbol] + self.wavelet.rank(symbol, here)
            steps += 1
        return which, found


class Hits:
    """Occurrences in one shard: words, and those that some occurrence covers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, phrases: Phrases):
        data = tb.LOWER[data]
        self.starts, self.ends, self.bounds = tb.words(data, offsets, tb.ALNUM)
        n = len(self.starts)
        self.covered = np.zeros(n, bool)
        self.pairs = np.zeros((0, 2), np.int64)
        if not n or not len(phrases.lengths):
            return
        hashed = tb.hashes(data, self.starts, self.ends)
        at = np.searchsorted(phrases.vocabulary, hashed)
        at[at == len(phrases.vocabulary)] = 0
        ids = np.where(phrases.vocabulary[at] == hashed, at + 1, 0)
        known = ids > 0
        apart = np.zeros(n, bool)  # a separator goes before this word
        apart[1:] = known[1:] & ~known[:-1]
        inner = self.bounds[1:-1]
        apart[inner[inner < n]] = True
        apart &= known
        kept = np.flatnonzero(known)
        if not len(kept):
            return
        place = np.arange(len(kept)) + np.cumsum(apart[kept])
        symbols = np.zeros(place[-1] + 2, np.int64)
        symbols[place] = ids[kept]
        which, found = Index(symbols, len(phrases.vocabulary)).search(phrases)
        word = kept[np.searchsorted(place, found)]
        steps = np.zeros(n + 1, np.int64)
        np.add.at(steps, word, 1)
        np.add.at(steps, word + phrases.lengths[which], -1)
        self.covered = np.cumsum(steps[:-1]) > 0
        self.pairs = np.unique(np.stack([np.searchsorted(self.bounds, word, "right") - 1, which], 1), axis=0)

    def texts(self, phrases: Phrases) -> Iterator[tuple[int, int, list[tuple[int, int]], set[str]]]:
        """Of each text: words, covered words, merged byte spans in the shard, items."""
        items: dict[int, set[str]] = {}
        for text, which in self.pairs.tolist():
            items.setdefault(text, set()).update(phrases.owners[which])
        for text, (low, high) in enumerate(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist())):
            if text not in items:
                yield high - low, 0, [], set()
                continue
            covered = np.concatenate([[False], self.covered[low:high], [False]])
            edges = np.flatnonzero(covered[1:] != covered[:-1]).reshape(-1, 2)
            yield high - low, int(covered.sum()), [(int(self.starts[low + a]), int(self.ends[low + b - 1])) for a, b in edges], items[text]


def phrase_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> tuple[int, Callable[[], Iterator[Phrases]]]:
    """How many blocks of bounded size the benchmark's phrases take, and these blocks, as often as they are asked for.

    Repeated rows count once; the phrases of items without id belong to nobody.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-2 * size // PHRASE_BYTES))

    def blocks() -> Iterator[Phrases]:
        for k in range(n):
            block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
            yield Phrases([tuple(r) for r in block.collect()], window)

    return n, blocks


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without its text, plus n_words, hits (merged character spans of hit words, end exclusive), n_hit, items.

    Null and empty texts have no words, items without words no phrases; an empty benchmark hits nothing. Phrases of items
    without id hit words all the same, but are no items. Repeated rows each get their result; columns of ``docs`` named like
    the new ones, whatever their case, are replaced.
    """
    new = ("n_words", "n_hit", "hits", "items")
    kept = [c for c in docs.columns if c != text_col and c.lower() not in new]
    df = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("_llm_text"),
                     F.array().cast("array<struct<start:int,end:int>>").alias("hits"), F.array().cast("array<string>").alias("items"))
    out = T.StructType([*df.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType())])
    for k, phrases in enumerate(phrase_blocks(benchmark, item_col, item_text_col, window)[1]()):
        df = save(df, "phrases") if k else df
        df = map_batches(df.drop("n_words", "n_hit"), _marked(phrases), out)
    return df.drop("_llm_text")


def _marked(phrases: Phrases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_llm_text"))
            before = batch.column(batch.schema.get_field_index("hits")).to_pylist()
            had = batch.column(batch.schema.get_field_index("items")).to_pylist()
            spans, items, n_words, n_hit = [], [], [], []
            for low, high, data, offsets in tb.blocks(texts, SHARD):
                hits = Hits(data, offsets, phrases)
                chars = None
                for k, (words, hit, own, names) in enumerate(hits.texts(phrases)):
                    n_words.append(words)
                    if not own:
                        spans.append(before[low + k]), items.append(had[low + k])
                    else:
                        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if chars is None else chars
                        at = chars[offsets[k]]
                        new = [{"start": int(chars[a] - at), "end": int(chars[b] - at)} for a, b in own]
                        spans.append(merged([*before[low + k], *new])), items.append(sorted({*had[low + k], *names}))
                    n_hit.append(hit if not before[low + k] else _covered(texts[low + k].as_py(), spans[-1]))
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            columns["hits"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            columns["items"] = pa.array(items, pa.list_(pa.string()))
            columns |= {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def merged(spans: list[dict]) -> list[dict]:
    """Union of spans; those that overlap become one."""
    out: list[dict] = []
    for span in sorted(spans, key=lambda x: (x["start"], x["end"])):
        if out and span["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], span["end"])
        else:
            out.append(dict(span))
    return out


def _covered(text: str, spans: list[dict]) -> int:
    """Words inside the spans, which begin and end with words."""
    parts = pa.array([text[x["start"] : x["end"]] for x in spans], pa.string())
    return len(tb.words(*tb.utf8(parts), _EITHER_CASE)[0])


_EITHER_CASE = tb.ALNUM | (np.isin(np.arange(256), np.arange(65, 91)))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with every hit word span cut out of its text, again until no phrase occurs.

    A cut leaves a line break. Texts without hits stay as they are, null included; a text of which no word is
    left goes. Other columns are kept. If the phrases take several blocks, cutting those of one can join the halves of one
    of another: texts that a pass over all blocks has changed go through all blocks again.
    """
    names = docs.columns
    at = names.index(text_col)
    work = docs.toDF(*[f"c{k}" for k in range(len(names))]).withColumn("cut", F.lit(False))
    n, blocks = phrase_blocks(benchmark, item_col, item_text_col, window)
    done, schema = None, work.schema
    while True:
        for k, phrases in enumerate(blocks()):
            work = map_batches(save(work, "phrases") if k else work, _cut(phrases, f"c{at}"), schema)
        if n == 1:  # a text was cut until none of its phrases occurred
            return work.drop("cut").toDF(*names)
        work = save(work, "phrases")
        clean_now = work.where("not cut")
        done = clean_now if done is None else done.union(clean_now)
        work = work.where("cut").withColumn("cut", F.lit(False))
        if work.isEmpty():
            return done.drop("cut").toDF(*names)


def _cut(phrases: Phrases, text_col: str):
    # The last column tells whether a text was cut.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            changed: dict[int, str] = {}
            for low, high, data, offsets in tb.blocks(batch.column(at), SHARD):
                hits = Hits(data, offsets, phrases)
                for k, (words, hit, own, _) in enumerate(hits.texts(phrases)):
                    while own:
                        raw, base = (data[offsets[k] : offsets[k + 1]].tobytes(), int(offsets[k])) if low + k not in changed else (changed[low + k].encode(), 0)
                        parts, last = [], 0
                        for a, b in own:
                            parts.append(raw[last : a - base])
                            last = b - base
                        changed[low + k] = b"\n".join([*parts, raw[last:]]).decode()
                        _, _, own, _ = next(Hits(*tb.utf8(pa.array([changed[low + k]], pa.string())), phrases).texts(phrases))
            if not changed:
                yield batch
                continue
            texts = batch.column(at).to_pylist()
            for k, text in changed.items():
                texts[k] = text
            keep = np.ones(len(texts), bool)
            for k, text in changed.items():
                keep[k] = len(tb.words(*tb.utf8(pa.array([text], pa.string())), _EITHER_CASE)[0]) > 0
            columns = [batch.column(i) if i != at else pa.array(texts, batch.schema.field(at).type) for i in range(batch.num_columns - 1)]
            columns.append(pa.array([was or k in changed for k, was in enumerate(batch.column(batch.num_columns - 1).to_pylist())]))
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))

    return run


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
                        "hits")
