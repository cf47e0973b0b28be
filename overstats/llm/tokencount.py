"""Token counts: every distinct pre-token is counted once, every text is a sum over its pre-tokens.

A sentencepiece BPE model merges nothing across two signs that stand next to each other in none of its pieces. So a
text, with the space sign that the model puts before it, falls into pre-tokens that are encoded independently, and its
number of tokens is the sum of theirs. ``PATTERNS`` cut between two signs by the kinds of these two alone; the first
that leaves every piece of the model whole is taken.

One pass over the texts gathers the pre-tokens and in how many texts each occurs; each distinct one is encoded once. A
second pass takes the frequencies of the pre-tokens of each text and joins them to the counts. Pre-tokens that many
texts have would be hot keys of this join, so the commonest ones (``HOT`` at most, found by a histogram of their
frequencies) are looked up in a broadcast table; a key that is left holds no more than about one HOT-th of all
(text, pre-token) rows. No ids of a text are ever made.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overstats.llm.store import map_batches, save

#: Pre-tokens in the broadcast table at most; each takes KEY_BYTES and two numbers.
HOT = 1 << 18
KEY_BYTES = 32
#: Distinct pre-tokens and their signs that a task gathers before it passes them on.
GATHER, GATHER_SIGNS = 200_000, 32 << 20
#: Largest model file that is sent to the tasks.
FILE_BYTES = 64 << 20
#: Steps to a doubling in the histogram of frequencies.
STEPS = 8
LIMIT = 4096
SPACE = "▁"
#: Signs that ``re`` takes for parts of words, that are neither letters nor decimal digits, and that pieces join to other signs.
NUMERALS = "_²"
#: Space signs with letters, with other signs or with one digit after them; with all up to the next space signs.
PATTERNS = (f"{SPACE}*[^\\W\\d{NUMERALS}]+|{SPACE}*(?:[^{SPACE}\\w]|[{NUMERALS}])+|{SPACE}*\\d|{SPACE}+", f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: No piece has it next to another sign, so it keeps what follows apart from the sign before the text.
APART = "\n"


def pretokens(text: str, pattern: re.Pattern) -> list[str]:
    """The parts of a text that are encoded independently. An empty text has none."""
    return pattern.findall(SPACE + text.replace(" ", SPACE)) if text else []


def key(pretoken: str) -> bytes:
    """The pre-token in UTF-8, or a digest if that is long; 0xFF, which no UTF-8 has, sets digests apart."""
    raw = pretoken.encode()
    return raw if len(raw) <= KEY_BYTES else b"\xff" + hashlib.blake2b(raw, digest_size=KEY_BYTES - 1).digest()


class Counts:
    """Numbers of tokens of pre-tokens."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(self.model.get_piece_size())
        pieces = [self.model.id_to_piece(k) for k in ids if not (self.model.is_control(k) or self.model.is_unknown(k) or self.model.is_byte(k))]
        if SPACE not in pieces or any(APART in x and len(x) > 1 for x in pieces) or self.ids_of("a  Å ") != self.ids_of(f"a{SPACE * 2}Å{SPACE}") or len(self.ids_of(" ")) == 0:
            raise ValueError("only models that keep white space and put a space sign before the text are read")
        whole = [p for p in map(re.compile, PATTERNS) if all(p.fullmatch(x) and len(p.findall(x)) == 1 for x in pieces)]
        if not whole:
            raise ValueError("pieces of this model reach across the beginning of a word")
        self.pattern = whole[0]
        self.before = len(self.ids_of(APART))

    def ids_of(self, text: str) -> list[int]:
        return self.model.encode(text)

    def of(self, found: list[str]) -> list[int]:
        """Each is encoded behind APART, whose own tokens are taken off."""
        return [len(x) - self.before for x in self.model.encode([APART + x for x in found], num_threads=1)]


def load(path: str) -> bytes:
    """The model file, of bounded size."""
    with open(path, "rb") as file:
        model = file.read(FILE_BYTES + 1)
    if len(model) > FILE_BYTES:
        raise ValueError(f"{path} is too large to send to every task")
    return model


def default_path() -> str:
    """Where the public piece vocabulary is installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(texts: DataFrame, model: bytes) -> DataFrame:
    """(key, tokens, texts): every distinct pre-token of ``texts`` (one string column), counted once."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def flushed(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pretoken", "texts"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = Counts(shared.value).pattern
        seen: Counter = Counter()
        signs = 0
        for batch in batches:
            for text in batch.column(0):
                own = set(pretokens(text.as_py() or "", pattern))
                before = len(seen)
                seen.update(own)
                signs += sum(map(len, own)) if len(seen) > before else 0
                if len(seen) > GATHER or signs > GATHER_SIGNS:
                    yield flushed(seen)
                    seen, signs = Counter(), 0
        if seen:
            yield flushed(seen)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(shared.value)
        for batch in batches:
            found = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([key(x) for x in found], pa.binary()), pa.array(counts.of(found), pa.int64()), batch.column(1)], names=["key", "tokens", "texts"])

    distinct = map_batches(texts, gather, "pretoken string, texts long").groupBy("pretoken").agg(F.sum("texts").alias("texts"))
    return save(map_batches(distinct, count, "key binary, tokens long, texts long"), "pretokens")


def commonest(counted: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``counted`` in the highest steps of frequency that hold at most ``most`` rows together, and the others."""
    step = F.floor(F.log2("texts") * STEPS)
    held, least = 0, None
    for r in sorted(counted.groupBy(step.alias("step")).count().collect(), reverse=True):
        held += r["count"]
        if held > most:
            break
        least = r.step
    if least is None:
        return counted.where("false"), counted
    return counted.where(step >= least), counted.where(step < least)


def count_tokens(df: DataFrame, path: str | None = None, text_col: str = "text", bytes_col: str = "n_bytes", tokens_col: str = "n_tokens", hot: int = HOT, keep_text: bool = True) -> DataFrame:
    """``df`` plus the bytes (UTF-8) of its texts and how many tokens the model of ``path`` makes of them.

    Null and empty texts have 0 of both. Every row stays, repeated ones too; columns of ``df`` named like the new ones,
    whatever their case, are replaced. Without ``keep_text`` the texts are left out, and then not written and shuffled.
    """
    new = (bytes_col.lower(), tokens_col.lower())
    names = [c for c in df.columns if c.lower() not in new and (keep_text or c != text_col)]
    kept = [f"c{k}" for k in range(len(names))]
    model = load(path or default_path())
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    counted = vocabulary(df.select(text.alias("text")), model)
    common, rare = commonest(counted, hot)
    found = common.select("key", "tokens").toArrow()
    table = df.sparkSession.sparkContext.broadcast((Counts(model).pattern.pattern, dict(zip(found["key"].to_pylist(), found["tokens"].to_pylist()))))
    source = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, kept)], F.monotonically_increasing_id().alias("row"), text.alias("text"))
    out = T.StructType([*source.schema.fields[:-1], T.StructField("bytes", T.LongType()), T.StructField("known", T.LongType()),
                        T.StructField("rest", T.ArrayType(T.StructType([T.StructField("key", T.BinaryType()), T.StructField("times", T.LongType())])))])
    at = len(kept) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, keyed = table.value
        pattern, known = re.compile(pattern), {}
        for batch in batches:
            sizes, sums, keys, times, ends = [], [], [], [], [0]
            for text in batch.column(at):
                text = text.as_py()
                total = 0
                for pretoken, n in Counter(pretokens(text, pattern)).items():
                    tokens = known.get(pretoken)
                    if tokens is None:
                        k = key(pretoken)
                        tokens = keyed.get(k)
                        if tokens is None:
                            keys.append(k)
                            times.append(n)
                            continue
                        if len(pretoken) <= KEY_BYTES:
                            known[pretoken] = tokens  # as many as the table has at most
                    total += tokens * n
                sizes.append(len(text.encode()))
                sums.append(total)
                ends.append(len(keys))
            rest = pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(times, pa.int64())], names=["key", "times"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)], names=out.names)

    summed = save(map_batches(source, run, out), "known")
    looked_up = summed.select("row", F.inline("rest")).join(rare.select("key", "tokens"), "key")
    others = looked_up.groupBy("row").agg(F.sum(F.col("times") * F.col("tokens")).alias("others"))
    both = summed.drop("rest").join(others, "row", "left")
    return both.select(*[F.col(k).alias(c) for c, k in zip(names, kept)], F.col("bytes").alias(bytes_col), (F.col("known") + F.coalesce("others", F.lit(0))).alias(tokens_col))


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, keep_text=False).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
