"""Periodic runs of words, found on a grammar of the text.

A run is a stretch of words that repeats with a smallest period q, at least ``TIMES`` times and ``LEAST`` words long, and
that no neighbour extends. Texts of a block are handled side by side in numpy, each with word ids of its own:

* Two neighbouring words inside a run occur next to each other at least TIMES - 1 times in their text. Stretches of which
  all neighbours do (asked again until nothing changes) hold all runs whole; the rest needs no grammar.
* Re-Pair: in rounds, repeated pairs of symbols become symbols, the commoner pair before its neighbours; where no pair
  repeats any more, neighbours are paired up until a stretch is one symbol. Rounds shrink a stretch by a constant factor,
  so the derivation is shallow and the words below the different symbols of a round are at most those of the text.
* The smallest symbol that spans a run has it across the border of its two halves. For each new symbol, at its first
  place, the squares that end or begin at the border are tested for all periods at once, and extended both ways within the
  symbol. This is done once for a symbol, however often it is used.
* Runs of a symbol are moved to all its places. What a smaller symbol has seen of a run that goes on beyond it lies within
  the whole run, which a larger symbol has: merging keeps, for each period, the intervals that lie in no other.

Equality of stretches of words is that of names: stretches of 2 ** k words get equal numbers if and only if they are equal,
level by level, so nothing rests on hashes. A text is a row of its task; nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overstats.llm import textbytes as tb
from overstats.llm.store import map_batches

TIMES, LEAST = 4, 6
#: (symbol, period) pairs tested at once.
TESTS = 1 << 20
#: Bytes of text handled side by side, unless a single text is longer.
BLOCK = 1 << 20


class Names:
    """Equality of stretches of a sequence: level k numbers its stretches of 2 ** k."""

    def __init__(self, sequence: np.ndarray, longest: int):
        self.levels = [sequence]
        while 2 << (len(self.levels) - 1) <= longest:
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            pairs = last[:-half].astype(np.int64) * (int(last.max()) + 1) + last[half:]
            self.levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``size`` words at a and b are equal."""
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.zeros(len(a), bool)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            names, rest = self.levels[k], size[at] - (1 << k)
            x, y = a[at], b[at]
            out[at] = (names[x] == names[y]) & (names[x + rest] == names[y + rest])
        return out

    def right(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on, up to ``most``."""
        return self._common(a, b, most, 1)

    def left(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b, up to ``most``."""
        return self._common(a, b, most, -1)

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        found = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names, size, asked = self.levels[k], 1 << k, np.arange(len(a))
            while len(asked):  # the top level may fit several times, the others once
                asked = asked[found[asked] + size <= most[asked]]
                shift = found[asked] if way > 0 else -found[asked] - size
                asked = asked[names[a[asked] + shift] == names[b[asked] + shift]]
                found[asked] += size
                if k < len(self.levels) - 1:
                    break
        return found


def ranges(sizes: np.ndarray) -> np.ndarray:
    """0 ... sizes[0] - 1, 0 ... sizes[1] - 1, and so on."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def stretches(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches that may hold runs. Each text has ids of its own, so none spans two texts."""
    code = ids[:-1].astype(np.int64) * (int(ids.max()) + 1 if len(ids) else 1) + ids[1:]
    left = np.arange(len(code))
    while len(left):
        _, inverse, counts = np.unique(code[left], return_inverse=True, return_counts=True)
        kept = left[counts[inverse] >= TIMES - 1]
        first = np.flatnonzero(np.diff(kept, prepend=-2) > 1)
        sizes = np.diff(first, append=len(kept))
        kept = kept[np.repeat(sizes >= LEAST - 1, sizes)]
        if len(kept) == len(left):
            break
        left = kept
    first = np.flatnonzero(np.diff(left, prepend=-2) > 1)
    sizes = np.diff(first, append=len(left))
    return left[first], left[first] + sizes + 1


def chosen(rank: np.ndarray, candidate: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Pairs to replace, no two of which overlap: those that outrank their neighbours; of neighbours alike every second.

    ``rank`` is that of each pair, ``joined`` whether the pair lies within one stretch.
    """
    rank = np.where(candidate & joined, rank, -1)
    edge = np.flatnonzero(np.diff(rank, prepend=-2) != 0)  # plateaus of pairs alike
    value, sizes = rank[edge], np.diff(edge, append=len(rank))
    before, after = np.append(-1, value[:-1]), np.append(value[1:], -1)
    top = (value >= 0) & (value > before) & (value > after)
    return np.flatnonzero(np.repeat(top, sizes) & (ranges(sizes) % 2 == 0))


def spread(x: np.ndarray) -> np.ndarray:
    """An order of numbers that has nothing to do with their size."""
    return (tb.mix(x.astype(np.uint64) + np.uint64(1)) >> np.uint64(40)).astype(np.int64)


Rule = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def grammar(words: np.ndarray, stretch: np.ndarray) -> Iterator[Rule]:
    """Rounds of Re-Pair on a sequence whose words belong to the stretches ``stretch`` (ascending numbers).

    A round gives, of its new symbols, first place, border and end in the sequence, and of all places of these symbols
    symbol and place.
    """
    symbols, starts, owner = words.astype(np.int64), np.arange(len(words)), stretch
    ends = starts + 1
    repeats = True
    while len(symbols) > 1:
        joined = owner[:-1] == owner[1:]
        if not joined.any():
            return
        code = symbols[:-1] * (int(symbols.max()) + 1) + symbols[1:]
        _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
        at = np.zeros(0, np.int64)
        if repeats:
            often = np.frexp(counts.astype(np.float64))[1].astype(np.int64)  # of about as many, in no order along the text
            order = np.lexsort((spread(np.arange(len(counts))), often))
            rank = np.empty(len(counts), np.int64)
            rank[order] = np.arange(len(counts))
            at = chosen(rank[inverse], counts[inverse] > 1, joined)
            repeats = len(at) > 0
        if not repeats:  # nothing repeats any more: neighbours pair up
            sizes = np.diff(np.flatnonzero(np.diff(owner, prepend=-1)), append=len(owner))
            at = np.flatnonzero((ranges(sizes)[:-1] % 2 == 0) & joined)
        _, first, symbol = np.unique(code[at], return_index=True, return_inverse=True)
        yield starts[at[first]], starts[at[first] + 1], ends[at[first] + 1], symbol, starts[at]
        symbols[at] = int(symbols.max()) + 1 + symbol
        ends[at] = ends[at + 1]
        kept = np.ones(len(symbols), bool)
        kept[at + 1] = False
        symbols, starts, ends, owner = symbols[kept], starts[kept], ends[kept], owner[kept]
        symbols = np.unique(symbols, return_inverse=True)[1].astype(np.int64)


def crossing(names: Names, first: np.ndarray, border: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, start within it, length, smallest period) of the runs across the border of each symbol, within the symbol."""
    found = []
    for side in (0, 1):
        # half of the run's periods lie on one side of the border, so there is a square that ends or begins at it
        reach = np.minimum((border - first if side == 0 else end - border) // (TIMES // 2), (end - first) // TIMES)
        asked = np.flatnonzero(reach > 0)
        low = 0
        total = np.cumsum(reach[asked])
        while low < len(asked):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + TESTS, "right")))
            x = np.repeat(asked[low:high], reach[asked[low:high]])
            q = ranges(reach[asked[low:high]]) + 1
            low = high
            a = border[x] - 2 * q if side == 0 else border[x]  # the square's begin
            words = names.levels[0]
            maybe = np.flatnonzero((words[a] == words[a + q]) & (words[a + q - 1] == words[a + 2 * q - 1]))
            x, q, a = x[maybe], q[maybe], a[maybe]
            same = names.equal(a, a + q, q)
            x, q, a = x[same], q[same], a[same]
            start = a - names.left(a, a + q, a - first[x])
            stop = a + 2 * q + names.right(a + q, a + 2 * q, end[x] - a - 2 * q)
            good = (start < border[x]) & (stop > border[x]) & (stop - start >= np.maximum(LEAST, TIMES * q))
            found.append((x[good], (start - first[x])[good], (stop - start)[good], q[good]))
    x, start, length, q = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))
    order = np.lexsort((q, length, start, x))  # of equal stretches the smallest period is the run's
    x, start, length, q = x[order], start[order], length[order], q[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return x[new], start[new], length[new], q[new]


def maximal(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the intervals of each period those that lie in no other, by start, then period."""
    end = start + length
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    if len(start):
        group = np.cumsum(np.diff(period, prepend=-1) != 0)  # the highest end so far, afresh for each period
        base = group * (int(end.max()) + 1)
        furthest = np.maximum.accumulate(np.append(-1, (end + base)[:-1]))
        kept = end + base > np.maximum(furthest, base)
        start, end, period = start[kept], end[kept], period[kept]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, smallest period) of all runs, by start, then period. Each text must have ids of its own."""
    none = np.zeros(0, np.int64)
    first, last = stretches(ids)
    if not len(first):
        return none, none, none
    sizes = last - first
    place = np.repeat(first, sizes) + ranges(sizes)
    words = np.unique(ids[place], return_inverse=True)[1].astype(np.int32)
    owner = np.repeat(np.arange(len(first)), sizes)
    names = Names(words, int(sizes.max()) // 2)
    parts = []
    for head, border, end, symbol, at in grammar(words, owner):
        x, start, length, period = crossing(names, head, border, end)
        if len(x):
            # every place of a symbol takes the symbol's runs
            low, high = np.searchsorted(x, symbol, "left"), np.searchsorted(x, symbol, "right")
            which = np.repeat(low, high - low) + ranges(high - low)
            parts.append((np.repeat(at, high - low) + start[which], length[which], period[which]))
    if not parts:
        return none, none, none
    start, length, period = (np.concatenate([p[k] for p in parts]) for k in range(3))
    start, length, period = maximal(start, length, period)
    return place[start], length, period


def numbered(texts: list[list[bytes]]) -> np.ndarray:
    """Ids of the words of all texts, in a row; no two texts share an id."""
    ids: list[int] = []
    used = 0
    for words in texts:
        own: dict[bytes, int] = {}
        ids += [own.setdefault(w, used + len(own)) for w in words]
        used += len(own)
    return np.array(ids, np.int64)


def planted(places: np.ndarray, doc_id: str) -> np.ndarray:
    """The words of a text, by their places, with the periodic stretch that the id of its document asks for."""
    h, n = zlib.crc32(doc_id.encode()), len(places)
    if h % 10 or not n:
        return places
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = places.copy()
    out[a:] = places[a + np.arange(n - a) % p]
    return out


def find(df: DataFrame, text_col: str = "text", runs_col: str = "runs", kept_col: str = "kept_words", change: Callable[[np.ndarray, str], np.ndarray] | None = None, change_by: str | None = None) -> DataFrame:
    """``df`` plus its texts' runs, array of (start, length, period) by start and period, and the words that stay when of
    each run only the first period does, joined by a space.

    Words are runs of anything but white space; null and empty texts have none: no runs, and the empty string. Runs may
    overlap; a word goes if any run asks for it. ``change`` may put other words of the text in their places, given the places
    and the row's ``change_by`` as text (rows where that is null stay as they are). Columns of ``df`` named like the new ones, whatever their
    case, are replaced.
    """
    new = (runs_col.lower(), kept_col.lower())
    names = [c for c in df.columns if c.lower() not in new]
    by = (F.col(f"`{change_by}`") if change_by else F.lit(None)).cast("string")
    source = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)], by.alias("by"), F.col(f"`{text_col}`").cast("string").alias("text"))
    at = len(names)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    one = T.StructType([T.StructField(k, T.LongType()) for k in ("start", "length", "period")])
    out = T.StructType([*source.schema.fields[:-2], T.StructField("runs", T.ArrayType(one)), T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, _, _ in tb.blocks(batch.column(at + 1), BLOCK):
                part = batch.slice(low, high - low)
                texts = [(x or "").encode().split() for x in part.column(at + 1).to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
                ids = numbered(texts)
                which, moved = np.arange(len(ids)), set()
                for k, value in enumerate(part.column(at).to_pylist() if change else []):
                    own = which[bounds[k] : bounds[k + 1]]
                    if value is not None and (new := change(own, value)) is not own:
                        which[bounds[k] : bounds[k + 1]] = new
                        moved.add(k)
                start, length, period = runs(ids[which])
                gone = np.bincount(start + period, minlength=len(ids) + 1) - np.bincount(start + length, minlength=len(ids) + 1)
                stays = np.cumsum(gone)[:-1] == 0
                kept = []
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    if k not in moved and stays[a:b].all():
                        kept.append(b" ".join(texts[k]))
                    else:
                        kept.append(b" ".join([texts[k][j] for j in (which[a:b][stays[a:b]] - a).tolist()]))
                cuts = np.searchsorted(start, bounds)
                start = start - bounds[np.searchsorted(bounds, start, "right") - 1]
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(run_type)))
                yield pa.RecordBatch.from_arrays([*part.columns[:at], lists, pa.array(kept, pa.binary()).cast(pa.string())], names=out.names)

    return map_batches(source, run, out).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], F.col("runs").alias(runs_col), F.col("kept").alias(kept_col))


def digests(df: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the longest (then first, then of the smallest period), and digests of runs and words."""
    found = find(df.select("doc_id", "text"), change=planted, change_by="doc_id")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("kept_words", 256).alias("collapsed_sha256"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Periodic runs of every document."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
