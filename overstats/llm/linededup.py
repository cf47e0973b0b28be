"""Repeated runs of lines: a suffix array over line numbers by prefix doubling; later copies of a run are deleted.

A run is a sequence of consecutive lines (white space at both ends of a line doesn't count, blank lines are passed
over) of at least ``MIN_WORDS`` words in all. A line goes if it lies in some run that also begins at an earlier place,
places being ordered by document id, then by line. The earliest occurrence of a line therefore never goes.

* Every line gets the rank of its content among all lines that occur more than once. Doubling joins the rank of a
  place with the rank 2^k lines further and ranks the pairs in order: the suffix array's order by the first 2^(k+1)
  lines. Suffixes of one rank are an interval of the array whose longest common prefix has at least so many lines; a
  suffix that is alone in its interval is dropped, so that only repeated text is sorted again.
* A maximal repeated run is the union of its shortest stretches of enough words: from each line on, and up to each
  line. Their lengths bound the depth of doubling (lines have a word, so at most MIN_WORDS lines), however long the
  runs are. The interval of a stretch of n lines is that of the ranks of its first and last 2^floor(log2 n) lines; all
  of it but its earliest member are later copies.
* Equal pairs are folded before they are shuffled or ranked, so a hot line is one row per task; rows then join the
  ranks by plain equi-joins, which adaptive execution splits. A document's lines are never gathered, only the numbers
  of its deleted lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overstats.llm import textbytes as tb
from overstats.llm.store import forget, map_batches, save

MIN_WORDS = 50
PLACE = ["k0", "k1", "pos"]


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumns({"k0": F.xxhash64(F.col(f"`{id_col}`")), "k1": F.xxhash64(F.col(f"`{text_col}`").cast("string"))})


def lines(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """Lines that aren't blank, of texts with enough words: document key and id, number among them (pos), number in the
    text (line), content, and lines of the shortest stretch of enough words from here on (ahead) and up to here (back); 0: none."""
    source = _keys(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")), "id", "text").select("k0", "k1", "id", "text")
    out = T.StructType([*source.schema.fields[:3], *[T.StructField(x, T.IntegerType()) for x in ("pos", "line", "ahead", "back")], T.StructField("content", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in tb.blocks(batch.column(3)):
                starts, ends, bounds = tb.words(data, offsets, tb.NOT_SPACE)
                if not len(starts):
                    continue
                breaks = np.flatnonzero(data == 10)
                text = np.repeat(np.arange(high - low), np.diff(bounds))
                number = np.searchsorted(breaks, starts)
                first = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (text[1:] != text[:-1])]))
                size = np.diff(np.concatenate([first, [len(starts)]]))
                text, total = text[first], np.concatenate([[0], np.cumsum(size)])
                content = tb.hashes(data, starts[first], ends[first + size - 1])
                own = np.searchsorted(text, np.arange(high - low + 1))
                begin, end = own[text], own[text + 1]
                at = np.arange(len(first))
                ahead = np.searchsorted(total, total[:-1] + min_words) - at
                back = at + 2 - np.searchsorted(total, total[1:] - min_words, "right")
                ahead[at + ahead > end] = 0
                back[(at + 1 - back < begin) | (back > at + 1)] = 0
                line = number[first] - np.searchsorted(breaks, offsets[:-1])[text]
                keep = total[end] - total[begin] >= min_words
                rows = batch.slice(low, high - low).select([0, 1, 2]).take(pa.array(text[keep]))
                numbers = [pa.array(x[keep].astype(np.int32)) for x in (at - begin, line, ahead, back)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *numbers, pa.array(content[keep].view(np.int64))], names=out.names)

    return map_batches(source, run, out)


def _ranks(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The values of ``by`` that several rows have, numbered (``name``) in their order."""
    repeated = df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return save(repeated.orderBy(*by).withColumn(name, F.monotonically_increasing_id()), "ranks")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(k0, k1, lines: numbers of the lines to delete, from 0) of the documents concerned, and the keys (k0, k1) of rows
    that repeat in id and text. k0 and k1 hash a row's id and text."""
    every = save(lines(docs, id_col, text_col, min_words), "lines")
    active = every.join(_ranks(every, "rank", "content"), "content").drop("content")
    counted = save(active.groupBy(*PLACE, "id", "line", "ahead", "back", "rank").agg(F.count("*").alias("n")), "active")
    again = save(counted.where("n > 1").select("k0", "k1").distinct(), "again")
    ahead = counted.where("ahead > 0").select(*PLACE, "id", F.col("ahead").alias("length"))
    back = counted.where("back > 0").select("k0", "k1", (F.col("pos") - F.col("back") + 1).alias("pos"), "id", F.col("back").alias("length"))
    stretches = save(ahead.union(back).distinct(), "stretches")
    deepest = stretches.agg(F.max("length")).first()[0] or 0
    level, later, width = counted.select(*PLACE, "rank"), [], 1
    while width <= deepest:
        own = stretches.where((F.col("length") >= width) & (F.col("length") < 2 * width))
        last = level.select("k0", "k1", F.col("pos").alias("last"), F.col("rank").alias("y"))
        named = (own.join(level.withColumnRenamed("rank", "x"), PLACE).withColumn("last", F.col("pos") + F.col("length") - width)
                 .join(last, ["k0", "k1", "last"]).drop("last"))
        named = save(named, "intervals")
        place = F.struct("id", "k1", "pos")
        earliest = named.groupBy("length", "x", "y").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
        copies = named.join(earliest, ["length", "x", "y"]).where(~place.eqNullSafe(F.col("first"))).select(*PLACE, "length")
        later.append(save(copies, "copies"))
        forget(named)
        if 2 * width <= deepest:
            pairs = level.join(level.select("k0", "k1", (F.col("pos") - width).alias("pos"), F.col("rank").alias("next")), PLACE)
            pairs = save(pairs, "pairs")
            level = save(pairs.join(_ranks(pairs, "name", "rank", "next"), ["rank", "next"]).select(*PLACE, F.col("name").alias("rank")), "level")
        width *= 2
    if not later:
        return counted.select("k0", "k1", F.array("line").alias("lines")).limit(0), again
    copies = later[0]
    for more in later[1:]:
        copies = copies.union(more)
    gone = copies.select("k0", "k1", F.explode(F.sequence("pos", F.col("pos") + F.col("length") - 1)).alias("pos")).distinct()
    numbered = gone.join(counted.select(*PLACE, "line"), PLACE)
    return numbered.groupBy("k0", "k1").agg(F.collect_list("line").alias("lines")), again


def delete_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the lines of later copies; a document of which no line with words is left goes.

    Null, empty and short texts stay as they are, and so do documents without later copies. Rows that repeat in id and
    text are one document: of enough words, one row stays. The columns are those of ``docs``.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    inner = docs.select(F.struct(F.lit(None).cast("int").alias("none"), *others).alias("doc"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    gone, again = repeated_lines(docs, id_col, text_col, min_words)
    keyed = _keys(inner, "id", "text").drop("id").join(gone, ["k0", "k1"], "left")
    left = F.filter(F.split("text", "\n", -1), lambda line, number: ~F.array_contains("lines", number))
    cut = keyed.withColumn("text", F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    cut = cut.where(F.col("lines").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if not again.isEmpty():  # rows that repeat meet again; all others go straight on
        again = again.withColumn("again", F.lit(True))
        cut = cut.join(again, ["k0", "k1"], "left_anti").unionByName(cut.join(again, ["k0", "k1"], "left_semi").dropDuplicates(["k0", "k1"]))
    return cut.select(*[(F.col("text").cast(docs.schema[c].dataType) if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without later copies of repeated runs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return delete_repeats(docs).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
