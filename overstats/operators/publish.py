"""Incremental publishing: row hashes, change sets, snapshots, guards, run log."""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overstats import config as C
from overstats.session import file_system, materialise


def row_hash(df: DataFrame, exclude: Sequence[str] = ()) -> Column:
    """Content hash of a row: columns in name order, nulls kept.

    Maps are turned into sorted entries first: they have no order of their own.
    """
    fields = dict(df.dtypes)
    cols = []
    for name in sorted(c for c in df.columns if c not in exclude):
        col = F.col(name)
        if fields[name].startswith("map<"):
            col = F.sort_array(F.map_entries(col))
        cols.append(col.alias(name))
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def group_hash(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One hash per key over all of its rows, whatever their order.

    Row hashes are summed, exactly, rather than collected, so the group's
    size doesn't matter; the count guards against rows cancelling out.
    """
    digest = row_hash(df, exclude=keys)
    halves = [F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")
              for i in range(4)]
    sums = df.select(*keys, *[h.alias(f"_h{i}") for i, h in enumerate(halves)]).groupBy(
        *keys
    ).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_h{i}").alias(f"_h{i}") for i in range(4)])
    parts = [F.col(f"_h{i}").cast("string") for i in range(4)]
    return sums.select(
        *keys, F.sha2(F.concat_ws("|", F.col("_n").cast("string"), *parts), 256).alias("hash")
    )


def change_set(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Status of every key: inserted, updated, deleted or unchanged."""
    keys = list(keys)
    was = old.select(*keys, row_hash(old, keys).alias("_was"))
    now = new.select(*keys, row_hash(new, keys).alias("_now"))
    c = F.col
    return was.join(now, keys, "full_outer").select(
        *keys,
        F.when(c("_was").isNull(), "inserted").when(c("_now").isNull(), "deleted")
        .when(c("_was") != c("_now"), "updated").otherwise("unchanged").alias("status"),
    )


def change_counts(changes: DataFrame, table: str) -> DataFrame:
    return changes.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(table).alias("table"), "status", "n"
    )


# ---------------------------------------------------------------------------
# Snapshots: a table lies in buckets of its key; a version names one folder for each
# ---------------------------------------------------------------------------
#: Rows of a bucket, about, when a table is first published; and buckets of a table at most.
BUCKET_ROWS, MOST_BUCKETS = 1_000_000, 1 << 14
HASH, BUCKET = "_row_hash", "_bucket"


class Conflict(Exception):
    """Somebody else published between reading a table and switching to what came of it."""


def _version_path(root: str, version: int) -> str:
    return f"{root}/_versions/{version:09d}.json"


def current(spark: SparkSession, root: str) -> dict | None:
    """The newest version of a table, None before the first: version, keys, buckets, schema and each bucket's folder.

    A file that holds no version has a number all the same, which is not given again.
    """
    fs, folder = file_system(spark, f"{root}/_versions")
    if not fs.exists(folder):
        return None
    names = sorted((f.getPath().getName() for f in fs.listStatus(folder)), reverse=True)
    names = [n for n in names if n.endswith(".json") and n[0].isdigit()]
    for name in names:
        row = spark.read.text(f"{root}/_versions/{name}", wholetext=True).first()
        try:
            return json.loads(row.value if row else "") | {"version": int(names[0][:-5])}
        except ValueError:
            continue
    return None


def current_path(spark: SparkSession, root: str) -> str | None:
    """Where the newest version of a table is described, None before the first."""
    now = current(spark, root)
    return None if now is None else _version_path(root, now["version"])


def rows_of(spark: SparkSession, root: str, now: dict, buckets: Sequence[int] | None = None) -> DataFrame:
    """Rows of a version with their stored hashes, of all or some buckets."""
    schema = T.StructType.fromJson(now["schema"])
    wanted = now["folders"].items() if buckets is None else [(str(b), now["folders"][str(b)]) for b in buckets if str(b) in now["folders"]]
    paths = [f"{root}/{folder}/{BUCKET}={b}" for b, folder in wanted]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest version of a table, None before the first."""
    now = current(spark, root)
    return None if now is None else rows_of(spark, root, now).drop(HASH)


def open_snapshots(spark: SparkSession, root: str, tables: Sequence[str]
                   ) -> tuple[dict[str, DataFrame], list[str]]:
    """Every table of a build that is there, and the names of those that aren't."""
    found = {t: read_snapshot(spark, f"{root}/{t}") for t in tables}
    return {t: d for t, d in found.items() if d is not None}, [
        t for t, d in found.items() if d is None]


def bucket_of(columns: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def _same(keys: Sequence[str], a: str, b: str) -> Column:
    """Equal keys; null is a key like any other."""
    return functools.reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def publish(spark: SparkSession, root: str, new: DataFrame, keys: Sequence[str],
            scope: Column | None = None, deletes: bool = True, bucket_by: Sequence[str] | None = None,
            groups: DataFrame | None = None, buckets: int | None = None, seen: int | None = None) -> DataFrame:
    """Upsert and delete: write the buckets that change, then switch to them. Returns the change counts.

    Rows outside ``scope`` are left alone; inside it, rows that are gone from ``new`` are deleted, unless ``deletes`` is
    false. With ``groups`` the scope is the stored rows whose ``bucket_by`` columns (the keys, if not given) occur there, and
    only buckets of these groups are read. Rows are compared by the hashes stored with them. Nothing is written when nothing
    changed. ``keys`` must tell the rows of ``new`` apart.

    Number and columns of the buckets stay as first published; a new schema writes all of them. The switch is one small file
    that must not exist yet: readers see the version before or the one after, never a mix, and of two writers that began
    with the same version (``seen``, if the caller read it before) the second gets a :class:`Conflict` and can begin anew.
    """
    keys, name = list(keys), root.rstrip("/").rsplit("/", 1)[-1]
    now = current(spark, root)
    version = now["version"] if now else 0
    if seen is not None and seen != version:
        raise Conflict(f"{root}: version {version} is newer than {seen}")
    by = list(now["bucket_by"]) if now else list(bucket_by or keys)
    if not set(by) <= set(keys):
        raise ValueError(f"{by} are no keys of {name}")
    if scope is not None:
        new = new.where(F.coalesce(scope, F.lit(False)))
    columns = new.columns
    new = materialise(new.select("*", row_hash(new, keys).alias(HASH)), "publish")  # what is compared is what gets written
    count = now["buckets"] if now else buckets or min(MOST_BUCKETS, max(1, -(-new.count() // BUCKET_ROWS)))
    bucket = bucket_of(by, count)
    schema = new.schema.jsonValue()
    alike = now is not None and _shape(now["schema"]) == _shape(schema)
    asked = None
    if groups is not None and alike:
        asked = sorted(r[0] for r in groups.select(bucket.alias("b")).distinct().collect())  # no more than there are buckets
    old = rows_of(spark, root, now, asked) if now else spark.createDataFrame([], new.schema)
    inside = old if scope is None else old.where(F.coalesce(scope, F.lit(False)))
    if groups is not None:
        inside = inside.alias("o").join(groups.select(*by).distinct().alias("g"), _same(by, "o", "g"), "left_semi")
    was = inside.select(*keys, HASH, F.lit(True).alias("there")).alias("o")
    is_now = new.select(*keys, HASH, F.lit(True).alias("there")).alias("n")
    gone = F.when(F.col("n.there").isNull(), "deleted" if deletes else "unchanged")
    status = gone.when(F.col("o.there").isNull(), "inserted").when(F.col(f"o.{HASH}") != F.col(f"n.{HASH}"), "updated").otherwise("unchanged")
    pick = [F.when(F.col("n.there").isNull(), F.col(f"o.{k}")).otherwise(F.col(f"n.{k}")).alias(k) for k in keys]
    changes = materialise(was.join(is_now, _same(keys, "o", "n"), "full_outer").select(*pick, status.alias("status")), "changes")
    found = changes.groupBy("status", bucket.alias(BUCKET)).count().collect()  # at most four numbers a bucket
    rows = [(name, s, sum(r["count"] for r in found if r["status"] == s)) for s in sorted({r["status"] for r in found})]
    counts = spark.createDataFrame(rows, "table string, status string, n long")
    touched = sorted({r[BUCKET] for r in found if r["status"] != "unchanged"})
    if now is not None and not alike:
        touched = list(range(count))
    if now is not None and not touched:
        return counts
    changed = changes.where("status <> 'unchanged'")
    stored = rows_of(spark, root, now, touched) if now else old
    if now is not None and not alike:
        stored = stored.drop(HASH).unionByName(new.limit(0).drop(HASH), allowMissingColumns=True).select(columns)
        stored = stored.select("*", row_hash(stored, keys).alias(HASH))
    kept = stored.alias("s").join(changed.select(*keys).alias("c"), _same(keys, "s", "c"), "left_anti")
    added = new.alias("s").join(changed.where("status <> 'deleted'").select(*keys).alias("c"), _same(keys, "s", "c"), "left_semi")
    folder = f"v{version + 1:06d}-{uuid.uuid4().hex[:8]}"
    whole = kept.select(*columns, HASH).unionByName(added.select(*columns, HASH)).withColumn(BUCKET, bucket)
    whole.repartition(max(1, len(touched)), BUCKET).write.partitionBy(BUCKET).parquet(f"{root}/{folder}")
    fs, path = file_system(spark, f"{root}/{folder}")
    written = {f.getPath().getName().partition("=")[2] for f in fs.listStatus(path) if f.isDirectory()}
    folders = {b: f for b, f in (now["folders"] if now else {}).items() if int(b) not in set(touched)}
    folders |= {b: folder for b in written if b.isdigit()}
    _switch(spark, root, {"version": version + 1, "keys": keys, "bucket_by": by, "buckets": count, "schema": schema, "folders": folders})
    return counts


def _shape(schema: dict) -> list:
    """Names and types, in name order: what rows of two versions must share to lie side by side."""
    return sorted((f["name"], json.dumps(f["type"], sort_keys=True)) for f in schema["fields"])


def _switch(spark: SparkSession, root: str, version: dict) -> None:
    """Make ``version`` the newest, unless one of its number is there already: written beside, then renamed."""
    fs, path = file_system(spark, _version_path(root, version["version"]))
    beside = file_system(spark, f"{root}/_versions/_{uuid.uuid4().hex}")[1]
    out = fs.create(beside, False)
    try:
        out.write(bytearray(json.dumps(version).encode()))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
    never_over = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(beside, path, never_over)
    except Py4JJavaError as error:
        fs.delete(beside, False)
        if fs.exists(path):
            raise Conflict(f"{root}: version {version['version']} is there already") from error
        raise


def drop_unused(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete folders that none of the newest ``keep`` versions names, and the versions before them; returns the folders.

    For times without writers: a folder that is being written is in no version yet.
    """
    fs, folder = file_system(spark, f"{root}/_versions")
    names = sorted((n for n in (f.getPath().getName() for f in fs.listStatus(folder)) if n[0].isdigit()), reverse=True)
    used = set(current(spark, root)["folders"].values())
    for name in names[:keep]:
        row = spark.read.text(f"{root}/_versions/{name}", wholetext=True).first()
        used |= set(json.loads(row.value)["folders"].values())
    for name in names[keep:]:
        fs.delete(file_system(spark, f"{root}/_versions/{name}")[1], False)
    table = file_system(spark, root)[1]
    gone = sorted(n for n in (f.getPath().getName() for f in fs.listStatus(table)) if n.startswith("v0") and n not in used)
    for name in gone:
        fs.delete(file_system(spark, f"{root}/{name}")[1], True)
    return gone


# ---------------------------------------------------------------------------
# Guards and the run log
# ---------------------------------------------------------------------------
def input_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per format key of each input table (a key of '' counts the table)."""
    parts = []
    for kind, df in tables.items():
        key = F.col("format_key") if "format_key" in df.columns else F.lit("")
        parts.append(df.groupBy(key.alias("format_key")).agg(
            F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "format_key", "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def shrink_problems(before: DataFrame, now: DataFrame, limit: float = C.SHRINK_LIMIT,
                    skip: Sequence[str] = (), format_keys: Sequence[str] | None = None
                    ) -> DataFrame:
    """Counts that fell below 95% of the last complete run's."""
    c = F.col
    was = before.select("kind", "format_key", c("n").alias("before"))
    out = was.join(now.select("kind", "format_key", c("n").alias("after")),
                   ["kind", "format_key"], "left").withColumn(
        "after", F.coalesce("after", F.lit(0).cast("bigint")))
    if skip:
        out = out.where(~c("kind").isin(*skip))
    if format_keys is not None:
        out = out.where((c("format_key") == "") | c("format_key").isin(*format_keys))
    return out.where((c("before") > 0) & (c("after") < c("before") * F.lit(limit)))


def missing_replays(matches: DataFrame, replays: DataFrame) -> DataFrame:
    """Matches marked as having a replay that none was stored for."""
    return matches.where("has_replay").select("match_id").distinct().join(
        replays.select("match_id"), "match_id", "left_anti"
    )


def assert_live(provenance: str) -> None:
    if provenance != "live":
        raise ValueError(f"refusing to publish a {provenance!r} dataset: only live data is published")


def append_run(spark: SparkSession, path: str, run: dict) -> None:
    schema = ("run_id string, status string, started_at timestamp, finished_at timestamp, "
              "fingerprint string, partial boolean, counts map<string,bigint>, "
              "changes map<string,bigint>")
    spark.createDataFrame([run], schema).coalesce(1).write.mode("append").parquet(path)


def retained_runs(runs: DataFrame, keep: int = C.RUNS_KEPT) -> DataFrame:
    """The newest runs, and always the last complete one."""
    c = F.col
    newest = runs.orderBy(F.desc("finished_at"), F.desc("run_id")).limit(keep)
    complete = runs.where(c("status") == "complete").orderBy(
        F.desc("finished_at"), F.desc("run_id")).limit(1)
    return newest.unionByName(complete).dropDuplicates(["run_id"])


def active_run(runs: DataFrame) -> DataFrame:
    """The dataset readers see: the latest complete run; partial ones never."""
    return runs.where(F.col("status") == "complete").orderBy(
        F.desc("finished_at"), F.desc("run_id")).limit(1)


def data_as_of(summary: DataFrame) -> DataFrame:
    return summary.agg(F.max("last_date").alias("data_as_of"))


def rekey_old(rows: DataFrame, column: str = "fmt") -> DataFrame:
    """Give rows of the first schema (men's, keyed by format) their format key."""
    key = F.when(F.col(column).isin(*C.CORE_FORMATS), F.concat(column, F.lit("-m")))
    return rows.withColumns(
        {"format_key": F.coalesce(key, F.col(column)), "gender": F.lit("male")}
    )
