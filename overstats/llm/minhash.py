"""Near-duplicate documents: MinHash with tensored banding, links confirmed on the full shingle sets.

Banding with L tables of k minhashes each takes L x k minhashes. Here two small collections of ``TABLES`` half keys of
``HALF`` minhashes are made, and table (i, j) is keyed by half key i of the first and j of the second: TABLES squared
tables from about the square root of the minhashes. Two sets of similarity s meet in some table with probability
(1 - (1 - s^HALF)^TABLES)^2: 0.99993 at 0.8, 0.999999 at 0.9.

* Documents of the same set become one node first; a hot group of copies folds before the shuffle.
* In a table, members of a bucket are paired with one of them, not with each other: within each Arrow batch first, so
  that a bucket reaches the shuffle as one row per batch, however many members it has.
* Pairs are confirmed on the sets of whole texts. Buckets whose members then still lie in several components are
  looked at again, members of different components being compared in blocks, so that no link that could join
  components is lost. Members of a bucket's largest component are only compared with those outside it.
* Components come from alternating stars over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overstats.llm import textbytes as tb
from overstats.llm.components import components
from overstats.llm.store import forget, map_batches, save

TABLES, HALF = 10, 2
THRESHOLD = 80
#: Nodes whose buckets are folded together before they are shuffled.
FOLD = 4000
#: Rows and shingles of a block of texts that are compared with those of another.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 400_000
#: Bits of the filter that keeps texts out of a shuffle.
BITS = 1 << 22
_SEEDS = np.random.default_rng(71).integers(1, 2**63, (2, 2 * TABLES * HALF), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; with fewer words than ``width``, of all words as one."""
    data = tb.LOWER[data]
    starts, ends, bounds = tb.words(data, offsets, tb.NOT_SPACE)
    words = tb.hashes(data, starts, ends)
    n = max(0, len(words) - width + 1)
    shingles = tb.chain(*(words[k : k + n] for k in range(width))) if n else words[:0]
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if high - low >= width:
            own = np.sort(shingles[low : high - width + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif high > low:
            yield tb.chain(*(words[k : k + 1] for k in range(low, high))) ^ np.uint64(high - low)
        else:
            yield words[:0]


def half_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 2 x TABLES half keys for each (not empty) set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(x) for x in sets[:-1])])
    lowest = [np.minimum.reduceat((flat ^ a) * b, starts) for a, b in _SEEDS.T]
    return np.stack([tb.chain(np.full(len(sets), k, np.uint64), *lowest[k * HALF : (k + 1) * HALF]) for k in range(2 * TABLES)], 1)


def digests(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Two 64-bit digests of each set."""
    return [np.array([np.add.reduce(tb.mix(x ^ seed)) for x in sets], np.uint64).view(np.int64) for seed in _SEEDS[0, :2]]


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Of each row: id, n_shingles, a 128-bit digest of the set (h1, h2), and the half keys (none for an empty set)."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = T.StructType([source.schema["id"], T.StructField("n_shingles", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("halves", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in tb.blocks(batch.column(1)):
                sets = list(shingle_sets(data, offsets, width))
                filled = [k for k, x in enumerate(sets) if len(x)]
                halves: list = [None] * len(sets)
                if filled:
                    for k, row in zip(filled, half_keys([sets[k] for k in filled]).view(np.int64)):
                        halves[k] = row
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array([len(x) for x in sets], pa.int64()), *map(pa.array, digests(sets)), pa.array(halves, pa.list_(pa.int64()))], names=out.names)

    return map_batches(source, run, out)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of some thousands of nodes at a time: (key, node, member); member is null in the one row of a key that goes on."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(x.num_rows for x in waiting) >= FOLD:
            yield _star(waiting)
            waiting = []
    if waiting:
        yield _star(waiting)


def _star(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    node = np.concatenate([x.column(0).to_numpy() for x in batches])
    halves = np.concatenate([x.column(1).flatten().to_numpy() for x in batches]).view(np.uint64).reshape(-1, 2 * TABLES)
    key = tb.mix(halves[:, :TABLES, None] * np.uint64(3) + halves[:, None, TABLES:]).reshape(-1)
    member = np.repeat(node, TABLES * TABLES)
    order = np.lexsort((member, key))
    key, member = key[order], member[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    center = member[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(center), pa.array(member, mask=first)], names=["key", "node", "member"])


def _confirm(width: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = np.zeros(len(u), bool)
            left = batch.column(2)
            for low, high, data, offsets in tb.blocks(left):
                mine = shingle_sets(data, offsets, width)
                others = _sets(batch.column(3).slice(low, high - low), width)
                for k, (x, y) in enumerate(zip(mine, others)):
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    same = int(np.count_nonzero(both[1:] == both[:-1]))
                    keep[low + k] = 100 * same >= threshold * (len(both) - same)
            yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])

    return run


def _sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in tb.blocks(texts):
        yield from shingle_sets(data, offsets, width)


def _texts(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, text) of the given nodes.

    A bitmap of ``BITS`` bits, whatever the number of nodes, keeps most other texts from being shuffled; when it
    fills up, more texts pass and the join drops them.
    """
    wanted = np.zeros(BITS, bool)
    wanted[nodes.select(F.pmod("h1", F.lit(BITS)).alias("bit")).distinct().toArrow().column(0).to_numpy()] = True
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))
    source = docs.select(F.xxhash64(F.col(f"`{id_col}`")).alias("id_hash"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            for low, high, data, offsets in tb.blocks(batch.column(1)):
                sets = list(shingle_sets(data, offsets, width))
                h1, h2 = digests(sets)
                keep = wanted[h1 % BITS] & np.array([len(x) > 0 for x in sets])
                rows = batch.slice(low, high - low).filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(h1[keep]), pa.array(h2[keep])], names=["id_hash", "text", "h1", "h2"])

    found = map_batches(source, run, "id_hash long, text string, h1 long, h2 long")
    keys = ["h1", "h2", "id_hash"]
    return found.join(nodes.select("node", "h1", "h2", F.xxhash64("id").alias("id_hash")), keys).dropDuplicates(keys).select("node", "text")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, threshold: int) -> DataFrame:
    """The pairs (u, v) whose texts' full sets are similar enough. Sizes rule pairs out before a text is moved."""
    size = nodes.select("node", "n_shingles")
    near = save(pairs.join(size.withColumnsRenamed({"node": "u", "n_shingles": "n_u"}), "u")
                .join(size.withColumnsRenamed({"node": "v", "n_shingles": "n_v"}), "v")
                .where(F.lit(100) * F.least("n_u", "n_v") >= F.lit(threshold) * F.greatest("n_u", "n_v")).select("u", "v"), "pairs")
    asked = near.select(F.col("u").alias("node")).union(near.select("v")).distinct()
    texts = save(_texts(nodes.join(asked, "node", "left_semi"), docs, id_col, text_col, width), "texts")
    both = (near.join(texts.withColumnsRenamed({"node": "v", "text": "text_v"}), "v")
            .join(texts.withColumnsRenamed({"node": "u", "text": "text_u"}), "u").select("u", "v", "text_u", "text_v"))
    links = save(map_batches(both, _confirm(width, threshold), "u long, v long"), "links")
    forget(near, texts)
    return links


def _blocks(n: str, size: str) -> F.Column:
    return F.ceil(F.greatest(F.col(n) / BLOCK_ROWS, F.col(size) / BLOCK_SHINGLES)).cast("int")


def _compared(family: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, threshold: int) -> DataFrame:
    """Links (u, v) between members of different components of a family.

    ``family``: center, node, component, largest (component), n_blocks, n_asking. The members outside the largest
    component ask, in n_asking blocks; all members answer, in n_blocks. A task takes one block of each: no pairs are
    emitted but the links found, of which it leaves out those that join nothing new.
    """
    family = save(family, "asked")
    texts = save(_texts(nodes.join(family.select("node").distinct(), "node", "left_semi"), docs, id_col, text_col, width), "texts")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    asks = family.where("component != largest").select("center", own("n_asking").alias("a"), every("n_blocks").alias("b"), "node", "component", F.lit(True).alias("asks"))
    answers = family.select("center", every("n_asking").alias("a"), own("n_blocks").alias("b"), "node", "component", F.lit(False).alias("asks"))
    dealt = asks.union(answers).join(texts, "node")

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        sets = [x for chunk in table.column("text").chunks for x in _sets(chunk, width)]
        node, component = table.column("node").to_numpy(), table.column("component").to_numpy()
        mine, theirs = np.flatnonzero(asks), np.flatnonzero(~asks)
        u, v = [], []
        if len(mine) and len(theirs):
            same = intersections([sets[k] for k in mine], [sets[k] for k in theirs])
            size = np.array([len(x) for x in sets], np.int64)
            near = 100 * same >= threshold * (size[mine][:, None] + size[theirs][None, :] - same)
            near &= component[mine][:, None] != component[theirs][None, :]
            joined: dict[int, int] = {}

            def root(x: int) -> int:
                while joined.get(x, x) != x:
                    x = joined[x]
                return x

            for a, b in np.argwhere(near).tolist():
                x, y = root(component[mine[a]]), root(component[theirs[b]])
                if x != y:
                    joined[x] = y
                    u.append(node[mine[a]]), v.append(node[theirs[b]])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    links = save(dealt.groupBy("center", "a", "b").applyInArrow(run, "u long, v long"), "links")
    forget(family, texts)
    return links


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``a`` with each of ``b``, by products of presence matrices."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    row_a, row_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    shared = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float64)
    places = []
    for flat, row in ((flat_a, row_a), (flat_b, row_b)):
        at = np.searchsorted(shared, flat)
        at[at == len(shared)] = 0
        has = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        order = np.argsort(at[has], kind="stable")
        places.append((at[has][order], row[has][order]))
    for low in range(0, len(shared), 4096):
        parts = []
        for (at, row), n in zip(places, (len(a), len(b))):
            first, last = np.searchsorted(at, [low, low + 4096])
            part = np.zeros((n, 4096), np.float32)
            part[row[first:last], at[first:last] - low] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, h1, h2, component_id (smallest id of its group), kept.

    Documents are linked if 100 x intersection >= ``threshold`` x union of their sets of ``width``-word shingles, words
    being lower-cased (A-Z) runs without white space; a group is what links reach. Null and empty texts and texts
    without words are linked with nothing. A null id never names a group that has another. Repeated rows are rows of
    their group, each. An empty table gives an empty result; other columns aren't looked at.
    """
    rows, nodes = _grouped(docs, id_col, text_col, width, threshold)
    group = nodes.groupBy("component").agg(F.min("id").alias("component_id"))
    named_nodes = nodes.join(group, "component").select("h1", "h2", "component_id", F.lit(True).alias("linked"))
    out = rows.drop("halves").join(named_nodes, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "h1", "h2", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and component, node, h1, h2, id (the smallest) of every different set."""
    rows = save(signatures(docs, id_col, text_col, width), "signatures")
    folded = rows.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("halves").alias("halves"))
    nodes = save(folded.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    starred = save(map_batches(nodes.select("node", "halves"), _stars, "key long, node long, member long"), "tables")
    alone = starred.where("member is null")
    center = alone.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("n")).where("n > 1")
    across = alone.join(center, "key").where("node != center").select("key", F.col("center").alias("u"), F.col("node").alias("v"))
    stars = save(starred.where("member is not null").select("key", F.col("node").alias("u"), F.col("member").alias("v")).union(across), "stars")
    pairs = save(stars.select("u", "v").distinct(), "pairs")
    known = nodes.select("node", "id", "h1", "h2", "n_shingles")
    links = confirmed(pairs, known, docs, id_col, text_col, width, threshold)
    found = save(components(links), "components")
    # Buckets whose members still lie apart, by their center: members of different components are compared in blocks.
    crowded = stars.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    bucket = stars.join(crowded, "key", "left_semi").join(center.select("key", "center"), "key", "left").withColumn("center", F.coalesce("center", "u"))
    family = save(bucket.select("center", F.col("v").alias("node")).union(bucket.select("center", "u")).distinct()
                  .join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
                  .join(known.select("node", "n_shingles"), "node"), "families")
    sides = save(family.groupBy("center", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size")), "sides")
    opened = sides.groupBy("center").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "component"))["component"].alias("largest"), F.count("*").alias("sides")).where("sides > 1")
    asking = sides.join(opened.select("center", "largest"), "center").where("component != largest").groupBy("center").agg(F.sum("n").alias("n_asking"), F.sum("size").alias("size_asking"))
    blocks = opened.join(asking, "center").select("center", "largest", _blocks("n", "size").alias("n_blocks"), _blocks("n_asking", "size_asking").alias("n_asking"))
    more = _compared(family.drop("n_shingles").join(blocks, "center"), known, docs, id_col, text_col, width, threshold)
    forget(starred, stars, pairs, family, sides)
    if not more.isEmpty():
        found = save(components(links.union(more)), "components")
    return rows, known.join(found, "node", "left").select(F.coalesce("component", "node").alias("component"), "node", "h1", "h2", "id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest id; columns as they were.

    Of rows that repeat in id and set one stays, of sets of one id in a group that of the smallest signature. A row
    without id stays only in a group without any id.
    """
    names = docs.columns  # columns may have any names: they have others in here
    docs = docs.toDF(*[f"c{k}" for k in range(len(names))])
    id_col, text_col = (f"c{names.index(c)}" for c in (id_col, text_col))
    rows, nodes = _grouped(docs, id_col, text_col, width, threshold)
    first = nodes.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2")).alias("first"))
    first = first.select(F.xxhash64("first.id").alias("_k0"), F.col("first.h1").alias("_k1"), F.col("first.h2").alias("_k2"))
    stay = rows.where("n_shingles > 0").groupBy(F.xxhash64("id").alias("_k0"), F.col("h1").alias("_k1"), F.col("h2").alias("_k2")).agg(F.count("*").alias("_n"))
    stay = stay.join(first, ["_k0", "_k1", "_k2"])
    stay = save(stay, "stay")
    schema = T.StructType([*docs.schema.fields, T.StructField("_k1", T.LongType()), T.StructField("_k2", T.LongType()), T.StructField("_w", T.LongType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in tb.blocks(batch.column(at)):
                sets = list(shingle_sets(data, offsets, width))
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, *map(pa.array, digests(sets)), pa.array([len(x) for x in sets], pa.int64())], names=[*batch.schema.names, "_k1", "_k2", "_w"])

    marked = map_batches(docs, run, schema).withColumn("_k0", F.xxhash64(F.col(f"`{id_col}`")))
    keys = ["_k0", "_k1", "_k2"]
    kept = marked.join(stay, keys, "left").where("_w = 0 or _n is not null")
    if not stay.where("_n > 1").isEmpty():  # rows that repeat meet again; all others go straight on
        kept = kept.where("_w = 0 or _n = 1").unionByName(kept.where("_w > 0 and _n > 1").dropDuplicates(keys))
    return kept.select(*docs.columns).toDF(*names)


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Groups of all documents over 2-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, width=2).select("doc_id", "n_shingles", "component_id", "kept")
