"""Near-duplicate vectors by NN-descent over a neighbour graph, within equal labels.

Neighbour lists hold up to k neighbours of cosine `near` or more. They begin with the blocks of a few random-hyperplane
trees and are refined by neighbours-of-neighbours joins until hardly any list changes. Edges at the threshold form
components. A list that is full of links is saturated: its true length is beyond k. Lists are therefore enlarged to the
whole component, whose members are compared block by block, so link counts are exact within a component however large
it is, and no pair is ever a row. Lists full of links of their own component do not see another component at the
threshold: further trees therefore compare members of different components only, and components that link are merged,
until fresh trees find no more and so many were built that a pair alone is missed with a chance of `MISS` at most. (Trees
deal a leaf that is too large into parts, where the chance is higher.) An audit compares a bounded sample of vectors with
all vectors, half of them drawn from those that have a neighbour of cosine `near`, where links are likely; while the mean
share of a vector's links that lie within its component is under `recall`, more trees are added, and after `most_rounds`
it is an error. Where the sample has no link at all there is nothing to measure, and a warning says so.

Equal vectors of a label are compared as one and counted as often as they are there. Vectors that are null, zero, or
hold null or non-finite components, or whose label is null, link with nothing. Vectors of different length never link.
One row per input row; rows with a null id keep a null component_id, link with nothing and are kept.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import cut
from .textkernel import runs

PAIRS = "node long, nbr long, sim double"
MISS = 1e-3
SALTS = 16


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def _near_pairs(group: pa.Table, k: int, near: float) -> pa.RecordBatch | None:
    """The k nearest of each member among the members, or among those of other components: columns key, id, unit and perhaps component."""
    ids = np.asarray(group.column("id"))
    ids, first = np.unique(ids, return_index=True)
    if len(ids) < 2:
        return None
    unit = _matrix(group.column("unit"))[first]
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    if "component" in group.column_names:
        component = np.asarray(group.column("component"))[first]
        sims[component[:, None] == component[None, :]] = -2
    if len(ids) > k:
        floor = np.partition(sims, len(ids) - k, axis=1)[:, len(ids) - k]
        rows, cols = np.nonzero((sims >= near) & (sims >= floor[:, None]))
    else:
        rows, cols = np.nonzero(sims >= near)
    return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(ids[cols]), pa.array(sims[rows, cols])], names=["node", "nbr", "sim"]) if len(rows) else None


def _codes(batches: Iterator[pa.RecordBatch], trees: int, bits: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Codes of the trees for (id, group, unit, bits); a group takes as many of the planes as its size asks for."""
    for batch in batches:
        ids, group, units, own_bits = (batch.column(k) for k in range(4))
        lengths = np.diff(np.asarray(units.offsets)) if len(units) else np.zeros(0, int)
        for dim in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == dim)
            unit = np.asarray(units.take(pa.array(own)).flatten()).reshape(len(own), dim)
            planes = np.random.default_rng([seed, dim]).standard_normal((dim, trees * bits))
            signs = (unit @ planes > 0).reshape(len(own), trees, bits)
            taken = np.arange(bits) < np.asarray(own_bits)[own][:, None]
            codes = (signs * (taken << np.arange(bits))[:, None, :]).sum(axis=2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.asarray(ids)[own], trees)), pa.array(np.repeat(np.asarray(group)[own], trees)), pa.array(np.tile(np.arange(trees), len(own)) + seed * trees), pa.array(codes.reshape(-1))],
                names=["id", "group", "tree", "code"],
            )


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, groups, rows = batch.column(0), batch.column(1), batch.column(2)
        kept, units = [], []
        for i in range(batch.num_rows):
            v = np.asarray(rows[i].values, np.float64)
            if np.isfinite(v).all() and (top := np.abs(v).max(initial=0.0)) > 0:
                v = v / top
                kept.append(i)
                units.append(v / np.sqrt(v @ v))
        take = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([ids.take(take), groups.take(take), pa.array(units, pa.list_(pa.float64()))], names=["id", "group", "unit"])


def _in_groups(rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(partial(runs, work=work), schema)


def _forest(vectors: DataFrame, trees: int, bits: int, seed: int, leaf: int, k: int, near: float) -> DataFrame:
    """Pairs within the leaves of random-hyperplane trees; a leaf over `leaf` vectors is dealt into parts by hash. Where
    vectors have a component, pairs of different components only."""
    codes = vectors.select("id", "group", "unit", "bits").mapInArrow(partial(_codes, trees=trees, bits=bits, seed=seed), "id long, group long, tree long, code long")
    codes = cut(codes, "codes")
    sizes = codes.groupBy("group", "tree", "code").agg(F.ceil(F.count("*") / F.lit(leaf)).alias("parts"), F.count("*").alias("n")).where("n > 1")
    dealt = codes.join(sizes, ["group", "tree", "code"]).select("id", F.xxhash64("group", "tree", "code", F.pmod(F.xxhash64("id", "tree"), "parts")).alias("key"))
    columns = [c for c in ("key", "id", "unit", "component") if c == "key" or c in vectors.columns]
    return _in_groups(dealt.join(vectors, "id").select(columns), partial(_near_pairs, k=k, near=near), PAIRS)


def _merged(labels: DataFrame, pairs: DataFrame) -> DataFrame | None:
    """labels(id, component) of all vectors with the components of each pair (node, nbr) made one; None if there is no pair."""
    a, b = (labels.select(F.col("id").alias(end), F.col("component").alias(name)) for end, name in (("node", "src"), ("nbr", "dst")))
    met = cut(pairs.join(a, "node").join(b, "nbr").select("src", "dst").distinct(), "met")
    if met.isEmpty():
        return None
    heads = connected_components(met).select(F.col("node").alias("component"), F.col("component").alias("head"))
    return cut(labels.join(heads, "component", "left").select("id", F.coalesce("head", "component").alias("component")), "labels")


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """Neighbour lists (node, nbr, sim) cut to the k nearest; tasks cut theirs first, so a hub's candidates are never together."""
    best = pairs.groupBy("node", "nbr").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), F.desc("nbr")))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _joined(lists: DataFrame, vectors: DataFrame, k: int, near: float, width: int) -> DataFrame:
    """Pairs among each node's neighbours, forward and reverse. Reverse neighbours beyond `width` form groups of their own."""
    forward = lists.select(F.xxhash64("node", F.lit(0)).alias("key"), F.col("nbr").alias("id"))
    hubs = lists.groupBy("nbr").agg(F.ceil(F.count("*") / F.lit(width)).alias("parts"))
    reverse = lists.join(hubs, "nbr").select(F.xxhash64("nbr", F.pmod(F.xxhash64("node"), "parts")).alias("key"), F.col("node").alias("id"))
    members = forward.union(reverse).distinct()
    return _in_groups(members.join(vectors, "id").select("key", "id", "unit"), partial(_near_pairs, k=k, near=near), PAIRS)


def _block_links(group: pa.Table, threshold: float) -> pa.RecordBatch | None:
    """For one pair of blocks (side 0 and 1; one block with itself has only side 0) the links of each member to the other."""
    side, ids, mult = (np.asarray(group.column(c)) for c in ("side", "id", "mult"))
    unit = _matrix(group.column("unit"))
    both = group.column("both")[0].as_py()
    one, two = (np.flatnonzero(side == k) for k in (0, 1)) if both else (np.arange(len(ids)),) * 2
    if not len(one) or not len(two):
        return None
    links = np.zeros(len(ids), np.int64)
    for at in range(0, len(one), 512):
        part = one[at : at + 512]
        hit = unit[part] @ unit[two].T >= threshold
        if both:
            links[two] += hit.T @ mult[part]
        else:
            hit[np.arange(len(part)), part] = False
        links[part] += hit @ mult[two]
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links)], names=["id", "links"])


def _component_links(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(id, links) of members(id, component, mult, unit): each component's blocks meet pairwise, as blocks."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks"))
    placed = members.join(sizes, "component").withColumn("at", F.pmod(F.xxhash64("id"), "blocks"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    lo, hi = F.least("at", "other"), F.greatest("at", "other")
    met = met.select(F.xxhash64("component", lo, hi).alias("key"), (F.col("at") > F.col("other")).cast("int").alias("side"), (F.col("at") != F.col("other")).alias("both"), "id", "mult", "unit")
    found = _in_groups(met, partial(_block_links, threshold=threshold), "id long, links long")
    return found.groupBy("id").agg(F.sum("links").alias("links"))


def _audit(batches: Iterator[pa.RecordBatch], queries: list[tuple[int, int, list[float]]], threshold: float) -> Iterator[pa.RecordBatch]:
    asked: dict[tuple[int, int], list[int]] = {}
    for i, (_, group, unit) in enumerate(queries):
        asked.setdefault((group, len(unit)), []).append(i)
    for batch in batches:
        ids, groups, units = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2)
        lengths = np.diff(np.asarray(units.offsets)) if len(units) else np.zeros(0, int)
        left, right = [], []
        for (group, dim), own in asked.items():
            rows = np.flatnonzero((groups == group) & (lengths == dim))
            if len(rows):
                unit = np.asarray(units.take(pa.array(rows)).flatten()).reshape(len(rows), dim)
                q, r = np.nonzero(np.array([queries[i][2] for i in own]) @ unit.T >= threshold)
                left += [queries[own[i]][0] for i in q]
                right += ids[rows[r]].tolist()
        pairs = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["src", "dst"])


def audit_recall(vectors: DataFrame, components: DataFrame, lists: DataFrame, threshold: float, sample: int = 200) -> float | None:
    """Of `sample` vectors, compared with all vectors, the mean share of a vector's links that lie in its component; None
    if they have no link. Half of the sample is drawn from the vectors with a neighbour list, the rest from all."""
    some = vectors.join(lists.select(F.col("node").alias("id")).distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample // 2)
    rest = vectors.orderBy(F.xxhash64("id"), "id").limit(sample - sample // 2)
    queries = [(r["id"], r["group"], r["unit"]) for r in some.union(rest).dropDuplicates(["id"]).collect()]
    pairs = vectors.select("id", "group", "unit").mapInArrow(partial(_audit, queries=queries, threshold=threshold), "src long, dst long")
    a, b = components.select(F.col("id").alias("src"), F.col("component").alias("ca")), components.select(F.col("id").alias("dst"), F.col("component").alias("cb"))
    hit = F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).cast("long")
    return pairs.join(a, "src", "left").join(b, "dst", "left").groupBy("src").agg(F.avg(hit).alias("share")).agg(F.avg("share")).first()[0]


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, near: float = 0.8, k: int = 10, trees: int = 8, leaf: int = 256, recall: float = 0.98, most_rounds: int = 4, block: int = 4096) -> DataFrame:
    """One row per input row: id_col, n_links, component_id, kept."""
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = given.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull()))
    classes = cut(sound.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("mult")), "classes")
    keyed = classes.select(F.col("rep").alias("id"), F.xxhash64("label", F.size("vector")).alias("group"), "vector")
    units = cut(keyed.mapInArrow(_units, "id long, group long, unit array<double>"), "units")
    sizes = units.groupBy("group").agg(F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.lit(2.0), F.count("*") / F.lit(leaf / 4))))).cast("int").alias("bits"))
    vectors = cut(units.join(sizes, "group").select("id", "group", "unit", "bits"), "vectors")
    bits = vectors.agg(F.max("bits")).first()[0] or 1
    alone = (1 - np.arccos(min(threshold, 1.0)) / np.pi) ** bits
    enough = 0 if alone == 1 else int(np.ceil(np.log(MISS) / np.log(1 - alone)))

    lists, labels, seed = None, None, 0
    for _ in range(most_rounds):
        fresh = _forest(vectors, trees, bits, seed, leaf, k, near)
        seed += 1
        lists = cut(_top(fresh if lists is None else fresh.union(lists), k), "lists", lists)
        for _ in range(3):
            refined = cut(_top(_joined(lists, vectors, k, near, 4 * k).union(lists), k), "lists")
            changed, size = refined.join(lists, ["node", "nbr"], "left_anti").count(), refined.count()
            lists = refined
            if changed <= 0.01 * size:
                break
        single = vectors.select("id", F.col("id").alias("component")) if labels is None else labels
        links = lists.where(F.col("sim") >= threshold)
        labels = _merged(single, links) or single
        while True:
            apart = vectors.join(labels, "id")
            more = _merged(labels, _forest(apart, trees, bits, seed, leaf, k, threshold))
            seed += 1
            labels = more or labels
            if more is None and seed * trees >= enough:
                break
        told = audit_recall(vectors, labels, lists, threshold)
        if told is None:
            warnings.warn("no vector of the audit's sample has a link: recall is not measured", stacklevel=2)
        if told is None or told >= recall:
            break
    else:
        raise RuntimeError(f"recall {told:.3f} of links is under {recall} after {most_rounds} rounds")

    shared = labels.groupBy("component").count().where("count > 1").select("component")
    components = cut(labels.join(shared, "component").select(F.col("id").alias("node"), "component"), "components")
    counted = classes.select(F.col("rep").alias("id"), "mult")
    members = components.withColumnRenamed("node", "id").join(counted, "id").join(vectors.select("id", "unit"), "id")
    links = cut(_component_links(members, threshold, block), "links")
    of_class = counted.join(components.withColumnRenamed("node", "id"), "id", "left").join(links, "id", "left").select("id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    # From class to rows by the vector itself, only where there are links and with the rows of a class dealt to SALTS keys; a
    # class that is no sound vector links with nothing, not even its copies.
    of_class = of_class.where("n_links > 0").join(vectors.select("id"), "id", "left_semi").withColumnRenamed("id", "rep")
    linked = classes.select("label", "vector", "rep").join(of_class, "rep").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = given.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(linked, ["label", "vector", "salt"], "left")
    component = F.coalesce("component", "id")
    return told.select(F.col("id").alias(id_col), F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
