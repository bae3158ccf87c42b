"""Near-duplicate documents by MinHash with tensored banding; links are confirmed on full shingle sets.

A document's set is its distinct shingles of `width` words (a document of fewer words has its whole sequence as one;
without words or with null text the set is empty and links with nothing). Documents link when
100 * |intersection| >= threshold * |union|.

Tensored banding: m half-bands of `rows` minhashes each are computed, and table keys are formed from pairs of
half-bands, so m * rows minhashes serve m * (m - 1) / 2 tables of 2 * rows minhashes. A pair of documents meets if two
of its m half-bands agree; m is the smallest for which a pair at the threshold is missed with at most `miss`.

Documents of equal sets form a class and are compared as one. Each class meets one other class, the most central of
those at the head of its table keys: at most one pair a class, however large a group of near copies is, and the links
form a forest. Keys that still hold several components are joined into clusters, and their classes are compared block by
block, where components differ and blocks have a key in common; only links leave a block. Blocks are bounded by the
shingles that they hold, and classes of a key lie together, so that a cluster which keys merely chain stays sparse.

Null ids: such a row has its n_shingles, component_id null and kept true. Rows that repeat an id share its component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, forest_roots
from .shared import cut
from .textkernel import mix, runs, shingle_sets, slices, text_buffers

SALTS = 16
SKETCH = "id long, n_shingles long, set_id binary, bands array<long>"


def half_bands(threshold: int, rows: int, miss: float) -> int:
    """How many half-bands are needed so that fewer than two agree with a chance of at most `miss` at the threshold."""
    p, m = (threshold / 100) ** rows, 2
    while (1 - p) ** m + m * p * (1 - p) ** (m - 1) > miss:
        m += 1
    return m


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    counter = np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    made = mix(counter)
    return made[:n], made[n:] | np.uint64(1)


def _bands(own: np.ndarray, m: int, rows: int) -> np.ndarray:
    flips, factors = _seeds(m * rows)
    lows = np.full(m * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 4096):
        np.minimum(lows, ((own[at : at + 4096, None] ^ flips) * factors).min(axis=0), out=lows)
    key = np.arange(1, m + 1, dtype=np.uint64)
    for k in range(rows):
        key = mix(key * np.uint64(0xE7037ED1A0B428DB) + lows[k::rows])
    return key.view(np.int64)


def _set_id(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def _sketch(batches: Iterator[pa.RecordBatch], width: int, m: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = text_buffers(batch.column(1))
        for a, b in slices(bounds):
            sets = shingle_sets(data, bounds[a : b + 1], width)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_set_id(s) for s in sets], pa.binary()),
                    pa.array([_bands(s, m, rows) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                ],
                names=["id", "n_shingles", "set_id", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = text_buffers(batch.column(0))
        for a, b in slices(bounds):
            sets = shingle_sets(data, bounds[a : b + 1], width)
            yield pa.RecordBatch.from_arrays([pa.array([_set_id(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["set_id", "items"])


def sketch(docs: DataFrame, width: int, m: int, rows: int) -> DataFrame:
    """docs(id, text) to SKETCH rows, one for each input row; set_id is a digest of the whole set, null if it is empty."""
    return docs.select(F.col("id").cast("long"), "text").mapInArrow(partial(_sketch, width=width, m=m, rows=rows), SKETCH)


def _table_members(classes: DataFrame, m: int) -> DataFrame:
    """(key, set_id, weight) for the table keys of classes. Half-bands that no other class has are dropped first,
    which leaves most documents without any pair of half-bands to combine."""
    bands = classes.select("set_id", F.posexplode("bands").alias("band", "value"))
    shared = bands.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    kept = bands.join(shared, ["band", "value"]).groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("band", "value"))).alias("own"), F.sum("n").alias("weight")).where(F.size("own") > 1)
    kept = cut(kept, "halves")
    pairs = F.flatten(F.transform("own", lambda a, i: F.transform(F.slice("own", i + 2, F.lit(m)), lambda b: F.xxhash64(a["band"], a["value"], b["band"], b["value"]))))
    return kept.select("set_id", "weight", F.explode(pairs).alias("key"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (src, dst) that link, judged on their full sets."""
    left = sets.select(F.col("set_id").alias("src"), F.col("items").alias("a"))
    right = sets.select(F.col("set_id").alias("dst"), F.col("items").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    lengths = F.size("a") + F.size("b")
    possible = 100 * F.least(F.size("a"), F.size("b")) >= threshold * F.greatest(F.size("a"), F.size("b"))
    return pairs.join(left, "src").join(right, "dst").where(possible).where(100 * both >= threshold * (lengths - both)).select("src", "dst")


def _compare_blocks(group: pa.Table, threshold: int) -> pa.RecordBatch | None:
    """Links between components, from all pairs of one or two blocks of classes: columns unit, side, component, items.

    Intersections come from one product of incidence matrices over the shingles that two classes share at least; only
    a spanning forest of the links is returned.
    """
    component = np.asarray(group.column("component").combine_chunks().to_numpy(zero_copy_only=False))
    side = np.asarray(group.column("side"))
    items = group.column("items").combine_chunks()
    sizes = np.diff(np.asarray(items.offsets)).astype(np.int64)
    names, owner = np.unique(component, return_inverse=True)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    _, column, counts = np.unique(np.asarray(items.flatten()), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    rows, column = rows[shared], column[shared]
    both = np.zeros((len(sizes), len(sizes)), np.float32)
    used, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    for at in range(0, len(used), 1 << 12):
        a, b = np.searchsorted(column, [at, at + (1 << 12)])
        held = np.zeros((len(sizes), min(1 << 12, len(used) - at)), np.float32)
        held[rows[a:b], column[a:b] - at] = 1
        both += held @ held.T
    linked = 100 * both >= threshold * (sizes[:, None] + sizes[None, :] - both)
    linked &= owner[:, None] != owner[None, :]
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for x, y in zip(*(owner[k].tolist() for k in np.nonzero(np.triu(linked))), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            edges.append((x, y))
    return pa.RecordBatch.from_arrays([pa.array([names[x] for x, _ in edges], pa.binary()), pa.array([names[y] for _, y in edges], pa.binary())], names=["src", "dst"]) if edges else None


def _first_pairs(members: DataFrame) -> DataFrame:
    """(set_id, hub): for each class the most central of the heads of its keys, by how widely half-bands are shared.

    A head ranks above all that meet it, so the pairs are a forest with at most one pair a class.
    """
    rank = F.struct("weight", "set_id")
    heads = members.groupBy("key").agg(F.max(rank).alias("head"))
    best = members.join(heads, "key").groupBy("set_id").agg(F.max("head")["set_id"].alias("hub"))
    return best.where("hub != set_id")


def _open_members(members: DataFrame, label: DataFrame, tested: DataFrame) -> DataFrame:
    """(key, set_id, component) of the keys whose classes lie in several components and are not one pair that was tested."""
    told = members.select("key", "set_id").join(label, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    ends = [F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.min("set_id").alias("src"), F.max("set_id").alias("dst")]
    keys = told.groupBy("key").agg(*ends).where("lo != hi")
    done = tested.select(F.least("set_id", "hub").alias("src"), F.greatest("set_id", "hub").alias("dst"), F.lit(2).cast("long").alias("n"))
    return told.join(keys.join(done, ["src", "dst", "n"], "left_anti").select("key"), "key")


def _block_links(members: DataFrame, sets: DataFrame, threshold: int, block: int = 1 << 17) -> DataFrame:
    """(src, dst): components that link, of members(key, set_id, component). Classes travel, pairs do not.

    A class lies with those of its largest key. Clusters are what keys connect of these lots. A cluster of up to `block`
    shingles is one block (a class counts as block / 1024 at least). In a larger one small lots share blocks, and a lot that
    holds more than a block is dealt into blocks of its own.
    """
    sized = members.join(members.groupBy("key").agg(F.count("*").alias("n")), "key")
    lots = cut(sized.groupBy("set_id", "component").agg(F.max(F.struct("n", "key"))["key"].alias("lot")), "lots")
    keyed = cut(members.select("key", "set_id").join(lots.select("set_id", "lot"), "set_id"), "open")
    heads = keyed.groupBy("key").agg(F.min("lot").alias("src"), F.max("lot").alias("dst")).where("src != dst").select("key", "src")
    chained = keyed.join(heads, "key").where("lot != src").select("src", F.col("lot").alias("dst")).distinct()
    clusters = connected_components(chained).select(F.col("node").alias("lot"), F.col("component").alias("cluster"))
    placed = lots.join(clusters, "lot", "left").withColumn("cluster", F.coalesce("cluster", "lot"))
    placed = cut(placed.join(sets.select("set_id", F.greatest(F.size("items"), F.lit(block >> 10)).alias("size")), "set_id"), "placed")
    parts = lambda total: F.ceil(F.col(total) / F.lit(block))
    whole = placed.groupBy("cluster").agg(F.sum("size").alias("total"))
    own = placed.groupBy("cluster", "lot").agg(F.sum("size").alias("own"))
    small = F.pmod(F.xxhash64("lot"), parts("total"))
    spot = F.when(F.col("total") <= block, F.xxhash64("cluster")).when(F.col("own") <= block, F.xxhash64("cluster", small)).otherwise(F.xxhash64("cluster", "lot", F.pmod(F.xxhash64("set_id"), parts("own"))))
    dealt = cut(placed.join(whole, "cluster").join(own, ["cluster", "lot"]).select("set_id", "component", spot.alias("block")), "dealt")
    # The blocks that each key reaches, alike for many keys, and from them the pairs of blocks with a key in common.
    reached = keyed.join(dealt.select("set_id", "block"), "set_id").groupBy("key").agg(F.sort_array(F.collect_set("block")).alias("blocks")).select("blocks").distinct()
    pairs = F.flatten(F.transform("blocks", lambda a: F.transform(F.filter("blocks", lambda b: b >= a), lambda b: F.struct(a.alias("block"), b.alias("other")))))
    meets = reached.select(F.explode(pairs).alias("pair")).select("pair.*").distinct()
    ends = meets.select(F.xxhash64("block", "other").alias("unit"), F.explode(F.array_distinct(F.array("block", "other"))).alias("block"), F.col("other"))
    rows = ends.withColumn("side", (F.col("block") == F.col("other")).cast("int")).join(dealt, "block").join(sets, "set_id")
    rows = rows.select("unit", "side", "component", "items").repartition("unit").sortWithinPartitions("unit")
    return rows.mapInArrow(partial(runs, work=partial(_compare_blocks, threshold=threshold)), "src binary, dst binary").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 80, rows: int = 3, miss: float = 1e-4) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id (smallest id reachable, itself included), kept."""
    m = half_bands(threshold, rows, miss)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = cut(sketch(texts, width, m, rows), "sketch")
    classes = sketched.where("set_id is not null and id is not null").groupBy("set_id").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.count("*").alias("n"))
    classes = cut(classes, "classes")
    members = cut(_table_members(classes, m), "members")

    # Full sets of the classes that share a table with another, from the text of one document of each.
    wanted = members.select("set_id").distinct().join(classes.select("set_id", "id"), "set_id")
    found = texts.join(wanted.select("id").distinct().hint("shuffle_hash"), "id").select("text").mapInArrow(partial(_sets, width=width), "set_id binary, items array<long>")
    sets = cut(found.join(wanted.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"]), "sets")

    tested = cut(_first_pairs(members), "pairs")
    linked = _verified(tested.select(F.col("set_id").alias("src"), F.col("hub").alias("dst")), sets, threshold)
    label = forest_roots(linked.select(F.col("src").alias("node"), F.col("dst").alias("parent"))).select(F.col("node").alias("set_id"), "component")

    rest = cut(_open_members(members, label, tested), "rest")
    late = cut(_block_links(rest, sets, threshold), "late")
    moved = connected_components(late).select(F.col("node").alias("component"), F.col("component").alias("to"))
    grouped = classes.select("set_id", "id", "n").join(label, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    grouped = grouped.join(moved, "component", "left").select("set_id", "id", "n", F.coalesce("to", "component").alias("component"))
    lows = grouped.groupBy("component").agg(F.min("id").alias("low"))
    # From class to rows only where a row is not its own component, with the rows of a class dealt to SALTS keys.
    told = grouped.join(lows, "component").where("n > 1 or low < id").select("set_id", "low", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = sketched.select("id", "n_shingles", "set_id", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")).join(told, ["set_id", "salt"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("low", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all of their columns. Rows with a null id stay."""
    gone = near_duplicates(docs, id_col, text_col, **parameters).where(~F.col("kept")).select(F.col(id_col).alias("key")).distinct()
    told = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(f"`{id_col}`").cast("long").alias("key"))
    return told.join(gone, "key", "left_anti").select(*[F.col(f"whole.`{c}`").alias(c) for c in docs.columns])
