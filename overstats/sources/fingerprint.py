"""Identity of the inputs: content digests and the newest file's time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of a node of the digest tree, about, and hex digits by which a node has children.
LEAF, STEP = 4096, 3


def files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Name, checksum and size of every file, independent of its packaging."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option(
        "recursiveFileLookup", True
    ).load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.sha2("content", 256).alias("checksum"), F.col("length").alias("size"),
        F.col("modificationTime").alias("modified_at"),
    )


def fingerprint(entries: DataFrame, archive: str = "archive", digits: int | None = None) -> DataFrame:
    """One digest per archive from its files' names, checksums and sizes, however they are packed.

    A file is the hash of its line; equal lines are one with their number. Hashes fall into a tree by their first digits:
    a leaf digests its sorted hashes, a node the digests of its children. ``digits`` is the leaves' prefix; by default as
    many as leave a leaf of the largest archive some LEAF files, in steps of STEP, so that no list that is gathered grows
    with the input.
    """
    c = F.col
    line = F.sha2(F.concat_ws("\t", c("name"), c("checksum").cast("string"), c("size").cast("string")), 256)
    lines = entries.groupBy(archive, line.alias("hash")).agg(F.count(F.lit(1)).alias("files"))
    if digits is None:
        most = lines.groupBy(archive).count().agg(F.max("count")).first()[0] or 0
        digits = 0
        while most > LEAF * 16**digits:
            digits += STEP
    nodes = lines.select(archive, "files", F.substring("hash", 1, digits).alias("node"), c("hash").alias("order"),
                         F.concat_ws("\t", "hash", c("files").cast("string")).alias("line"))
    while True:
        nodes = nodes.groupBy(archive, "node").agg(F.sum("files").alias("files"), F.sha2(F.array_join(F.transform(F.sort_array(
            F.collect_list(F.struct("order", "line"))), lambda r: r["line"]), "\n"), 256).alias("digest"))
        if digits == 0:
            return nodes.select(archive, "files", c("digest").alias("sha256"))
        digits = max(0, digits - STEP)
        nodes = nodes.select(archive, "files", F.substring("node", 1, digits).alias("node"), c("node").alias("order"),
                             F.concat_ws("\t", "node", "digest").alias("line"))


def combined(archives: DataFrame, archive: str = "archive") -> DataFrame:
    """One fingerprint for all archives (a handful of rows)."""
    line = F.concat_ws("\t", archive, "sha256")
    return archives.agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256)).alias("fingerprint"))


def generated_at(entries: DataFrame, override: str | None = None) -> DataFrame:
    """The dataset's time: its newest input, so rebuilding changes nothing."""
    kind = entries.schema["modified_at"].dataType
    newest = F.max("modified_at") if override is None else F.lit(override).cast(kind)
    return entries.agg(F.coalesce(newest, F.lit("1970-01-01 00:00:00").cast(kind)).alias("generated_at"))


def unchanged(spark: SparkSession, current: DataFrame, runs: DataFrame) -> bool:
    """Is the current fingerprint the last complete run's?"""
    last = runs.where(F.col("status") == "complete").orderBy(
        F.desc("finished_at"), F.desc("run_id")
    ).select("fingerprint").limit(1)
    return not current.join(last, "fingerprint", "left_semi").isEmpty()
