"""Byte-level BPE: greedy tokens are proposed, every adjacent pair is tested at once, failing words are merged exactly.

A text is cut into words by the tokenizer's pattern. For each word not met before, the longest vocabulary entry at
each place is proposed. Two neighbours are compatible if no merge across their border comes before the merges that
build them up; a proposal is BPE's own result exactly if all its neighbours are compatible (and each token is what
its bytes alone encode to, which only such tokens are proposed for). Pairs are tested for all new words together in
numpy; the words that fail, and only those, go through merging in rank order.

Each row is encoded by itself: no shuffle. The vocabulary (its file's size is checked) goes to every task; the words
a task remembers are bounded by ``REMEMBER``.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overstats.llm import textbytes as tb
from overstats.llm.store import map_batches

#: Words of which a task keeps the ids; then it starts afresh.
REMEMBER = 250_000
#: Largest tokenizer file that is sent to the tasks.
FILE_BYTES = 64 << 20
#: How byte-level BPE cuts a text into words (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = np.int64(1) << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in prints)
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizer:
    """Vocabulary and merges of a byte-level BPE tokenizer file."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        if not plain or spec["normalizer"] or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain byte-level BPE tokenizers are read")
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError("added tokens that look at their surroundings are not read")
        letters = byte_letters()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        n = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.bytes = [b""] * n
        for token, at in model["vocab"].items():
            self.bytes[at] = bytes(letters[c] for c in token)
        for token, at in self.special.items():
            self.bytes[at] = token.encode()
        ids = {self.bytes[at]: at for at in model["vocab"].values()}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        #: Of each token: when its merge comes, and its two halves; -1 for single bytes.
        self.rank, self.halves = np.full(n, -1, np.int64), np.full((n, 2), -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = (model["vocab"][x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            whole = ids[self.bytes[a] + self.bytes[b]]
            if (a, b) not in self.merges:
                self.merges[a, b] = rank, whole
                if self.rank[whole] < 0:
                    self.rank[whole], self.halves[whole] = rank, (a, b)
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.wholes = np.zeros(len(model["merges"]), np.int64)
        for rank, whole in self.merges.values():
            self.wholes[rank] = whole
        self.byte_array = np.array(self.byte_ids, np.int64)
        self.byte_ranks = self.ranks(np.repeat(self.byte_array, 256), np.tile(self.byte_array, 256)).reshape(256, 256)
        #: Tokens that their own bytes encode to.
        self.vocab = {x: at for x, at in ids.items() if len(x) == 1 or self.exact(x) == [at]}
        #: Length of the longest entry that begins with two bytes.
        self.longest: dict[bytes, int] = {}
        for x in self.vocab:
            self.longest[x[:2]] = max(len(x), self.longest.get(x[:2], 1))

    def exact(self, word: bytes) -> list[int]:
        """BPE by merging: the lowest rank first, of equal ones the leftmost."""
        ids = [self.byte_ids[b] for b in word]
        merges = self.merges
        if len(ids) > 40:
            return self._exact_long(ids)
        while len(ids) > 1:
            best = min(((m[0], i, m[1]) for i, pair in enumerate(zip(ids, ids[1:])) if (m := merges.get(pair))), default=None)
            if best is None:
                break
            ids[best[1] : best[1] + 2] = [best[2]]
        return ids

    def _exact_long(self, ids: list[int]) -> list[int]:
        merges, n = self.merges, len(ids)
        nxt, prev = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, whole = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = whole, -1, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for x, y in ((prev[i], i), (i, nxt[i])):
                if x >= 0 and y >= 0 and (m := merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
        return [x for x in ids if x >= 0]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NEVER where there is none."""
        key = a << 32 | b
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.key_ranks[place], NEVER)

    def exact_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """What :meth:`exact` gives for each word, and how many ids: one merge of every word at a time."""
        lengths = np.array([len(x) for x in words], np.int64)
        sizes, found = np.zeros(len(words), np.int64), []
        for low, width in ((0, 8), (8, 16), (16, 40)):
            own = np.flatnonzero((lengths > low) & (lengths <= width))
            if not len(own):
                continue
            length = lengths[own]
            raw = np.frombuffer(b"".join(words[k].ljust(width, b"\0") for k in own.tolist()), np.uint8).reshape(-1, width)
            ids = self.byte_array[raw]
            rank = np.full(raw.shape, NEVER)
            rank[:, :-1] = self.byte_ranks[raw[:, :-1], raw[:, 1:]]
            rank[np.arange(width)[None, :] >= length[:, None] - 1] = NEVER
            alive = np.arange(width)[None, :] < length[:, None]
            after = np.tile(np.arange(1, width + 1), (len(own), 1))
            before = np.tile(np.arange(-1, width - 1), (len(own), 1))
            row = np.arange(len(own))
            while True:
                at = rank[row].argmin(1)
                best = rank[row, at]
                go = best < NEVER
                row, at, best = row[go], at[go], best[go]
                if not len(row):
                    break
                gone = after[row, at]
                right = after[row, gone]
                ids[row, at], alive[row, gone], rank[row, gone], after[row, at] = self.wholes[best], False, NEVER, right
                more = right < length[row]
                rank[row, at] = NEVER
                r, x, y = row[more], at[more], right[more]
                before[r, y] = x
                rank[r, x] = self.ranks(ids[r, x], ids[r, y])
                left = before[row, at]
                more = left >= 0
                r, x, y = row[more], left[more], at[more]
                rank[r, x] = self.ranks(ids[r, x], ids[r, y])
            sizes[own] = alive.sum(1)
            found.append((own, ids[alive]))
        for k in np.flatnonzero(lengths > 40).tolist():
            ids = self.exact(words[k])
            sizes[k] = len(ids)
            found.append((np.array([k]), np.array(ids, np.int64)))
        starts = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.int64)
        for own, ids in found:
            flat[places(starts[own], sizes[own])] = ids
        return flat, sizes

    def propose(self, word: bytes) -> list[int]:
        """The longest entry at each place."""
        get, longest, n, at, out = self.vocab.get, self.longest.get, len(word), 0, []
        while at < n:
            for end in range(min(n, at + longest(word[at : at + 2], 1)), at, -1):
                token = get(word[at:end])
                if token is not None:
                    out.append(token)
                    at = end
                    break
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the tokens stay apart when ``left`` stands before ``right``.

        Both are taken apart again, the later merge first; at each state the merge of the two pieces at the border
        would have come if it precedes the one that buries the left piece, and does not follow that of the right.
        """
        good = np.ones(len(left), bool)
        at, a, b = np.arange(len(left)), left.astype(np.int64), right.astype(np.int64)
        until_a, until_b = np.full(len(at), NEVER), np.full(len(at), NEVER)
        while len(at):
            rank = self.ranks(a, b)
            crossed = (rank < until_a) & (rank <= until_b) & (rank < NEVER)
            good[at[crossed]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            go = ~crossed & ((rank_a >= 0) | (rank_b >= 0))
            first = (rank_a > rank_b) | ((rank_a == rank_b) & (rank_a >= 0))
            until_a, until_b = np.where(first, rank_a, until_a)[go], np.where(first, until_b, rank_b)[go]
            a, b = np.where(first, self.halves[a, 1], a)[go], np.where(first, b, self.halves[b, 0])[go]
            at = at[go]
        return good

    @cached_property
    def cut(self) -> regex.Pattern:
        return regex.compile(WORDS)

    @cached_property
    def cut_special(self) -> regex.Pattern:
        return regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def memory(self) -> Memory:
        return Memory(self)


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start .. start + size - 1 of all, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start:start + size] of all, one after the other."""
    return values[places(starts, sizes)]


class Memory:
    """Ids of the words a task has met."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.clear()

    def clear(self) -> None:
        special = list(self.tokenizer.special.values())
        self.known: dict[str | int, int] = {x: k for k, x in enumerate(special)}
        self.ids, self.starts, self.sizes = np.array(special, np.int32), np.arange(len(special)), np.ones(len(special), np.int64)

    def learn(self, new: list[str]) -> None:
        t = self.tokenizer
        proposals = [t.propose(x.encode()) for x in new]
        sizes = np.array([len(x) for x in proposals], np.int64)
        ids = np.array([i for x in proposals for i in x], np.int64)
        word = np.repeat(np.arange(len(new)), sizes)
        border = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(ids[border] << 32 | ids[border + 1], return_inverse=True)
        good = t.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        failed = np.unique(word[border[~good[which]]])
        if len(failed):
            passed, sizes = np.ones(len(new), bool), sizes.copy()
            passed[failed] = False
            mended, sizes[failed] = t.exact_many([new[k].encode() for k in failed.tolist()])
            starts = np.cumsum(sizes) - sizes
            flat = np.empty(int(sizes.sum()), np.int64)
            flat[places(starts[passed], sizes[passed])] = ids[passed[word]]
            flat[places(starts[failed], sizes[failed])] = mended
            ids = flat
        self.known.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids, self.sizes = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.sizes, sizes])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many of them each text has."""
        t = self.tokenizer
        words: list[str | int] = []
        bounds = [0]
        for text in texts:
            parts = t.cut_special.split(text) if t.special else [text]
            for k, part in enumerate(parts):
                if k % 2:
                    words.append(t.special[part])
                else:
                    words.extend(t.cut.findall(part))
            bounds.append(len(words))
        if len(self.known) > REMEMBER:
            self.clear()
        new = [x for x in dict.fromkeys(words) if x not in self.known]
        if new:
            self.learn(new)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        sizes = self.sizes[at]
        before = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        return gather(self.ids, self.starts[at], sizes), np.diff(before)


def load(path: str) -> str:
    """The tokenizer file, of bounded size."""
    with open(path, encoding="utf-8") as file:
        spec = file.read(FILE_BYTES + 1)
    if len(spec) > FILE_BYTES:
        raise ValueError(f"{path} is too large to send to every task")
    return spec


def _other(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c not in names]


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, keep_text: bool = True) -> DataFrame:
    """``df`` plus the ids of its texts (array<int>), and with ``decoded_col`` the text decoded from these ids.

    Null is the empty text: no ids. Columns of ``df`` named like the new ones are replaced.
    """
    spec = df.sparkSession.sparkContext.broadcast(load(path))
    kept = _other(df, ids_col, decoded_col, *() if keep_text else (text_col,))
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(ids_col))
    out = T.StructType([*source.schema.fields[:-1], T.StructField(ids_col, T.ArrayType(T.IntegerType())), *([T.StructField(decoded_col, T.StringType())] if decoded_col else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, data = Tokenizer(spec.value).memory(), flat_bytes(spec.value)
        for batch in batches:
            for low, high, _, _ in tb.blocks(batch.column(len(kept))):
                part = batch.slice(low, high - low)
                ids, counts = memory.encode(part.column(len(kept)).to_pylist())
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], lists, *[decoded(lists, data) for _ in out.names[len(kept) + 1 :]]], names=out.names)

    return map_batches(source, run, out)


def decoded(lists: pa.ListArray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Array:
    """Texts of lists of ids; bytes that are no UTF-8 become U+FFFD."""
    data, starts, sizes = table
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes[flat])]).astype(np.int64)[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
    raw = gather(data, starts[flat], sizes[flat])
    texts = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(ends), pa.py_buffer(raw))
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        texts = pa.array([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])], pa.large_string())
    return texts.cast(pa.string())


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` plus the text of its ids. Null ids are none; bytes that are no UTF-8 become U+FFFD; unknown ids fail."""
    spec = df.sparkSession.sparkContext.broadcast(load(path))
    source = df.select(*[F.col(f"`{c}`") for c in _other(df, text_col)])
    at = source.columns.index(ids_col)
    out = T.StructType([*source.schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = flat_bytes(spec.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded(batch.column(at), table)], names=out.names)

    return map_batches(source, run, out)


def flat_bytes(spec: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens, and where each begins and how long it is."""
    parsed, letters = json.loads(spec), byte_letters()
    tokens = {at: bytes(letters[c] for c in token) for token, at in parsed["model"]["vocab"].items()}
    tokens |= {x["id"]: x["content"].encode() for x in parsed["added_tokens"]}
    every = [tokens.get(k, b"") for k in range(max(tokens) + 1)]
    sizes = np.array([len(x) for x in every], np.int64)
    return np.frombuffer(b"".join(every), np.uint8), np.cumsum(sizes) - sizes, sizes


def default_path() -> str:
    """Where the public byte-level vocabulary is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and digests of the ids and of the text decoded from them."""
    both = encode(df.select("doc_id", "text"), path or default_path(), decoded_col="decoded", keep_text=False)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
