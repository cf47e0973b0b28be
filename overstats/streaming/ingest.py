"""Incremental ingest: new and revised match files into a published table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from overstats.operators import publish
from overstats.session import materialise
from overstats.sources.documents import MATCH_DDL, latest_revision, match_id_of, with_format


def document_stream(spark: SparkSession, path: str, fmt: str, files_per_batch: int = 10000
                    ) -> DataFrame:
    """Match files as they land, as the batch reads them; a revised file is the same id, modified later."""
    landed = (
        spark.readStream.schema(f"{MATCH_DDL}, _corrupt STRING")
        .option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.json")
        .json(path)
        .select(
            match_id_of(F.col("_metadata.file_name")).alias("match_id"),
            F.lit(fmt).alias("fmt"), F.col("_metadata.file_modification_time").alias("modified_at"),
            F.col("_metadata.file_name").alias("file_name"), "info", "innings", "_corrupt",
        )
        .where(F.col("_corrupt").isNull() & F.col("info").isNotNull()).drop("_corrupt")
    )
    return with_format(landed)


def ingest(stream: DataFrame, root: str, checkpoint: str, derive: Callable[[DataFrame], DataFrame],
           keys: Sequence[str] = ("match_id",), buckets: int | None = None) -> StreamingQuery:
    """Run every waiting file through ``derive`` and replace the rows of its match.

    The table lies in buckets of its matches (``buckets`` when it begins): a batch reads and writes those of its own matches
    and no others.

    ``derive`` maps documents to rows with a ``match_id``, as many a match as
    it likes as long as ``keys`` tell them apart. Older revisions never overwrite newer ones, and replaying a batch changes
    nothing, so a restart after a failure is safe. A match that ``derive`` gives no rows loses those it had. If
    somebody else publishes meanwhile, the batch fails and is run again at the next start.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, _batch_id: int) -> None:
        newest = materialise(latest_revision(batch), "batch")
        seen = publish.current(spark, root)
        arrived = newest.select("match_id", "modified_at")
        if seen is not None:  # only the buckets of the batch's matches are read, and of these two columns
            ids = [r[0] for r in arrived.select(publish.bucket_of(["match_id"], seen["buckets"])).distinct().collect()]
            known = publish.rows_of(spark, root, seen, ids).groupBy("match_id").agg(F.max("modified_at").alias("_seen"))
            arrived = arrived.join(known, "match_id", "left").where(F.col("_seen").isNull() | (F.col("modified_at") >= F.col("_seen"))).drop("_seen")
        arrived = materialise(arrived, "arrived")
        rows = derive(newest).drop("modified_at").join(arrived, "match_id")
        publish.publish(spark, root, rows, list(keys), bucket_by=["match_id"], groups=arrived, buckets=buckets, seen=seen["version"] if seen else 0)

    return stream.writeStream.foreachBatch(merge).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
