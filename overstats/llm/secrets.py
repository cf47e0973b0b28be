"""Secrets in texts, and how widely each is owned over the whole corpus.

Base spans are matches of three fixed patterns. Every matched value, and every other long token that mixes letters of
both cases with digits, is a candidate. Its hash is counted over the corpus: by how many owners, and in how many
repositories, it occurs. A value of many owners, or of many repositories even of one owner, is an example that was
copied about; a value that one owner alone has in few repositories and that looks random is live-looking, and the method
adds it as a span of kind ``live``.

Built-in expressions only. Matches of a pattern are placed by splitting the text at them: the pieces between the
matches and the matches themselves give all offsets in code points. Counting folds by (hash, owner) and then by hash,
so a value that half of the corpus has is a row per owner; candidates join their counts by hash, and adaptive
execution splits a hot hash. Texts aren't shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overstats.llm.store import save

#: The base patterns (fixed values), in the order in which kinds are listed.
KINDS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
#: Long tokens that the method looks at besides.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
LEAST_VALUE = 6
#: A live-looking value has one owner, few repositories and at least so many different signs.
MOST_OWNERS, MOST_REPOS, LEAST_SIGNS = 1, 5, 10
SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"


def matches(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost matches that don't overlap, with their places in code points, as SPAN."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), pair["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(pairs, empty, step, lambda s: s["spans"])).otherwise(F.array().cast(SPAN))


def _value(span: Column) -> Column:
    """What is secret in a match: the assigned value, else all of it."""
    return F.when(span["kind"] == 0, F.regexp_extract(span["value"], KINDS["assign"], 2)).otherwise(span["value"])


def _hashed(name: str) -> Column:
    """Hash of a name; null without one."""
    return F.when(F.col(f"`{name}`").isNotNull(), F.xxhash64(F.col(f"`{name}`").cast("string")))


def find(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """``docs`` without its text plus base (spans of the three kinds) and added (spans of kind ``live``), each an array
    of structs start, end, kind, owners, repos, ordered by start, then kind.

    Null and empty texts have no spans. A row whose repository is null is a repository of its own, and a repository
    whose owner is null is its own owner. Repeated rows each have their spans and are one repository if they share its name. Columns of ``docs`` named base or added are replaced.
    """
    columns = [c for c in docs.columns if c not in (text_col, "base", "added")]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = F.concat(*[matches(F.col("text"), pattern, k) for k, pattern in enumerate(KINDS.values())])
    other = F.filter(matches(F.col("text"), TOKEN, len(KINDS)), lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]"))
    spans = F.transform(F.concat("base", "other"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), _value(s).alias("value")))
    spans = F.filter(spans, lambda s: F.length(s["value"]) >= LEAST_VALUE)
    hashed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.sha2(s["value"], 256).alias("hash"),
                                                     F.size(F.array_distinct(F.split(s["value"], ""))).alias("signs")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), _hashed(owner_col).alias("owner"), _hashed(repo_col).alias("repo"), text.alias("text"))
    rows = rows.withColumns({"base": base, "other": other}).withColumn("spans", spans).select(F.monotonically_increasing_id().alias("row"), "doc", "owner", "repo", hashed.alias("spans"))
    rows = save(rows, "secrets")
    repo = F.coalesce("repo", F.xxhash64(F.lit("row"), "row"))
    owner = F.coalesce("owner", F.xxhash64(F.lit("repo"), repo))
    each = rows.where(F.size("spans") > 0).select("row", owner.alias("owner"), repo.alias("repo"), F.explode("spans").alias("span")).select("row", "owner", "repo", "span.*")
    counts = (each.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("repos"))
              .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")))
    known = each.join(counts, "hash")
    live = (F.col("owners") <= MOST_OWNERS) & (F.col("repos") <= MOST_REPOS) & (F.col("signs") >= LEAST_SIGNS)
    span = lambda kind: F.struct("start", F.lit(kind).cast("int").alias("kind") if kind is not None else F.col("kind"), "end", "owners", "repos")
    found = known.groupBy("row").agg(F.collect_list(F.when(F.col("kind") < len(KINDS), span(None))).alias("base"), F.collect_list(F.when(live, span(len(KINDS)))).alias("added"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,owners:bigint,repos:bigint>>")
    names = F.array(*[F.lit(x) for x in (*KINDS, "live")])

    def named(spans: str) -> Column:
        ordered = F.array_sort(F.coalesce(spans, empty))
        return F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("kind"), s["owners"].alias("owners"), s["repos"].alias("repos"))).alias(spans)

    joined = rows.drop("spans").join(found, "row", "left")
    return joined.select(*[F.col(f"doc.`{c}`") for c in columns], named("base"), named("added"))


def listed(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document; its source is the owner, the document the repository."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = find(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    order = F.array(*[F.lit(x) for x in (*KINDS, "live")])
    both = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("turn"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(both).alias("spans"),
                        F.size("added").cast("long").alias("n_live"))
