"""Hard negatives by a Voronoi-partitioned distributed join for the nearest neighbours.

A score is the inner product of two vectors of whole numbers (floor(256 * x)). With M the largest norm, a row x becomes
(x, sqrt(M^2 - |x|^2)) and an anchor q becomes (q, 0): their squared distance is |q|^2 + M^2 - 2 q.x, so the nearest rows
are those of the highest score, and distances in that space give bounds of scores.

An anchor asks for the first k rows of a score window, among the rows of its own label or of all other labels. Anchors and
rows lie in the cells of their nearest pivots. First, anchors meet the rows of their own cell: what they find gives each
cell the lowest score that is still of use to one of its anchors. Then the partition bounds of a cell (the radius of its
anchors, their norms, the lowest and highest useful score) decide which rows of other cells might serve it, and only these
are replicated to it. Within a cell blocks of anchors meet blocks of rows, so a task holds one block of each however many
rows a cell or a label has; what blocks find is cut to k before it is merged. Labels of the own-label join are dealt into
buckets, so that rows go to anchors of other labels rarely; scores and labels are compared exactly in the end.

Through the driver and to all tasks go the pivots (at most `cells`) and a few numbers a cell and bucket, nothing else.
Where vectors have no clusters, bounds exclude few rows and the work is that of all blocks of anchors with all blocks of
rows: the set of anchors against all rows.

Rows with a null id, a null label, a null vector or a null or non-finite component take no part. Shorter vectors count as
padded with zeros. Rows that repeat an id are rows of their own; an anchor is no row of its own. Ties go by the smaller id.
Labels that are no whole numbers are told apart by a 64-bit hash. Other columns are not read. Without rows or anchors the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .shared import cut
from .textkernel import runs
from .vectors import matrix, whole_vectors

FOUND = "anchor long, positive long, row long, id long, score long"
LEAST, MOST = -(1 << 62), 1 << 62


@dataclass
class Cells:
    """Pivots (cells, length + 1), the largest squared norm, and for each cell and bucket what its anchors need: how many
    they are, their radius, least and greatest squared norm, lowest and highest useful score."""

    pivots: np.ndarray
    norm: float
    buckets: int
    count: np.ndarray | None = None
    radius: np.ndarray | None = None
    norms: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    chunks: np.ndarray | None = None

    def distances(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        """From the rows x, with their last coordinate, to all pivots."""
        own = (x * x).sum(axis=1)
        tail = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.norm - own, 0))
        squares = (own + tail * tail)[:, None] - 2 * (x @ self.pivots[:, :-1].T + tail[:, None] * self.pivots[None, :, -1]) + (self.pivots**2).sum(axis=1)
        return np.sqrt(np.maximum(squares, 0))

    def serves(self, far: np.ndarray, bucket: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Which cells a row that is `far` from their pivots might serve, its own (home) left out."""
        radius, low, high, count = (a.reshape(-1, self.buckets)[:, bucket].T for a in (self.radius, self.low, self.high, self.count))
        least, greatest = (self.norms[k].reshape(-1, self.buckets)[:, bucket].T for k in (0, 1))
        slack = 1e-6 * (self.norm + 1)
        best = (greatest + self.norm - np.maximum(far - radius, 0) ** 2) / 2
        worst = (least + self.norm - (far + radius) ** 2) / 2
        told = (count > 0) & (best + slack >= low) & (worst - slack <= high)
        told[np.arange(len(far)), home] = False
        return told


def _hashed(values: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    x = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) % np.asarray(n, np.uint64)).astype(np.int64)


def _place(batches: Iterator[pa.RecordBatch], cells: Cells, length: int, anchors: bool) -> Iterator[pa.RecordBatch]:
    """(row, cell, far, norm) of rows (row, vector)."""
    for batch in batches:
        x = matrix(batch.column(1), length).astype(np.float64)
        far = cells.distances(x, anchors)
        cell = far.argmin(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), pa.array(far[np.arange(len(x)), cell]), pa.array((x * x).sum(axis=1))], names=["row", "cell", "far", "norm"])


def _reach(batch: pa.RecordBatch, cells: Cells, length: int, at_home: bool) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a batch (row, bucket, vector, ...) and the cells that each goes to."""
    x = matrix(batch.column(2), length).astype(np.float64)
    far, bucket = cells.distances(x, False), np.asarray(batch.column(1))
    home = far.argmin(axis=1)
    if not at_home:
        return np.nonzero(cells.serves(far, bucket, home))
    some = np.flatnonzero(cells.count.reshape(-1, cells.buckets)[home, bucket] > 0)
    return some, home[some]


def _counts(batches: Iterator[pa.RecordBatch], cells: Cells, length: int, at_home: bool) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(cells.count), np.int64)
    for batch in batches:
        row, cell = _reach(batch, cells, length, at_home)
        total += np.bincount(cell * cells.buckets + np.asarray(batch.column(1))[row], minlength=len(total))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["spot", "n"])


def _deal(batches: Iterator[pa.RecordBatch], cells: Cells, length: int, at_home: bool, anchor_block: int) -> Iterator[pa.RecordBatch]:
    """Each row to one chunk of each cell it serves, and there to all blocks of anchors."""
    for batch in batches:
        row, cell = _reach(batch, cells, length, at_home)
        spot = cell * cells.buckets + np.asarray(batch.column(1))[row]
        chunk = _hashed(np.asarray(batch.column(0))[row], cells.chunks[spot])
        blocks = -(-cells.count[spot] // anchor_block)
        again = np.repeat(np.arange(len(row)), blocks)
        block = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        taken = batch.take(pa.array(row[again]))
        yield pa.RecordBatch.from_arrays([pa.array(spot[again]), pa.array(block), pa.array(chunk[again]), *(taken.column(k) for k in (0, 2, 3, 4))], names=["spot", "block", "chunk", "row", "vector", "id", "label"])


def _windows(group: pa.Table, k: int, same: bool, length: int) -> pa.RecordBatch | None:
    """The first k rows of each window of each anchor in a block: columns key, asks, row, vector, id, label, windows."""
    asks = np.asarray(group.column("asks"))
    one, two = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(one) or not len(two):
        return None
    x = matrix(group.column("vector"), length)
    rows, ids, labels = (np.asarray(group.column(c)) for c in ("row", "id", "label"))
    # 64-bit floats hold these products exactly up to 2^53; beyond that, integers.
    kind = np.float64 if float(np.abs(x).max()) ** 2 * length < 2**53 else np.int64
    order = two[np.lexsort((rows[two], ids[two]))]
    theirs = x[order].astype(kind)
    windows = group.column("windows").combine_chunks()
    found = []
    for at in range(0, len(one), 256):
        part = one[at : at + 256]
        scores = np.asarray(x[part].astype(kind) @ theirs.T).astype(np.int64)
        fits = (labels[part][:, None] == labels[order][None, :]) == same
        fits &= rows[part][:, None] != rows[order][None, :]
        for i, a in enumerate(part):
            own = np.flatnonzero(fits[i])
            score = scores[i, own]
            for w in windows[int(a)].as_py():
                hit = np.flatnonzero((score >= w["lo"]) & (score <= w["hi"]))
                if len(hit) > k:
                    floor = np.partition(score[hit], len(hit) - k)[len(hit) - k]
                    hit = hit[score[hit] >= floor]
                hit = hit[np.argsort(-score[hit], kind="stable")[:k]]  # rows are in the order of ids
                found += [(rows[a], w["positive"], rows[order[own[h]]], ids[order[own[h]]], score[h]) for h in hit]
    if not found:
        return None
    return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*found, strict=True)], names=["anchor", "positive", "row", "id", "score"])


def _first(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def first_in_windows(rows: DataFrame, asked: DataFrame, cells: Cells, length: int, k: int, same: bool, anchor_block: int = 1024, row_block: int = 8192) -> DataFrame:
    """(anchor, positive, row, id, score, rank): the first k rows of each window of asked(row, id, label, vector, windows of
    (positive, lo, hi)), of the anchor's label or of all others. rows(row, id, label, vector); label is a long here."""
    spark = rows.sparkSession
    cells = Cells(cells.pivots, cells.norm, 16 if same else 1)
    bucket = F.pmod(F.xxhash64("label"), F.lit(cells.buckets)).cast("long")
    placed = asked.select("row", "vector").mapInArrow(partial(_place, cells=cells, length=length, anchors=True), "row long, cell long, far double, norm double")
    asked = cut(asked.join(placed, "row").withColumn("spot", F.col("cell") * cells.buckets + bucket), "asked")
    spots = len(cells.pivots) * cells.buckets
    cells.count, cells.radius, cells.norms = np.zeros(spots, np.int64), np.zeros(spots), np.zeros((2, spots))
    for spot, n, radius, least, greatest in asked.groupBy("spot").agg(F.count("*"), F.max("far"), F.min("norm"), F.max("norm")).collect():
        cells.count[spot], cells.radius[spot], cells.norms[0, spot], cells.norms[1, spot] = n, radius, least, greatest
    given = rows.select("row", bucket.alias("bucket"), "vector", "id", "label")

    def joined(at_home: bool) -> DataFrame:
        counts = given.mapInArrow(partial(_counts, cells=cells, length=length, at_home=at_home), "spot long, n long").groupBy("spot").agg(F.sum("n"))
        cells.chunks = np.ones(spots, np.int64)
        for spot, n in counts.collect():
            cells.chunks[spot] = -(-n // row_block)
        sent = Cells(**vars(cells))
        dealt = given.mapInArrow(partial(_deal, cells=sent, length=length, at_home=at_home, anchor_block=anchor_block), "spot long, block long, chunk long, row long, vector array<int>, id long, label long")
        dealt = dealt.select(F.xxhash64("spot", "block", "chunk").alias("key"), F.lit(False).alias("asks"), "row", "vector", "id", "label", F.lit(None).cast("array<struct<positive:long,lo:long,hi:long>>").alias("windows"))
        numbers = spark.createDataFrame([(s, int(-(-cells.count[s] // anchor_block)), int(cells.chunks[s])) for s in np.flatnonzero(cells.count).tolist()], "spot long, blocks long, chunks long")
        asking = asked.join(F.broadcast(numbers), "spot").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        asking = asking.select(F.xxhash64("spot", F.pmod(F.xxhash64("row"), "blocks"), "chunk").alias("key"), F.lit(True).alias("asks"), "row", "vector", "id", "label", "windows")
        return asking.union(dealt).repartition("key").sortWithinPartitions("key").mapInArrow(partial(runs, work=partial(_windows, k=k, same=same, length=length)), FOUND)

    near = cut(_first(joined(True), k), "near")
    asks = asked.select(F.col("row").alias("anchor"), "spot", F.explode("windows").alias("w")).select("anchor", "spot", "w.*")
    last = near.where(F.col("rank") == k).select("anchor", "positive", F.col("score").alias("at"))
    useful = asks.join(last, ["anchor", "positive"], "left").groupBy("spot").agg(F.min(F.coalesce("at", "lo")), F.max("hi"))
    cells.low, cells.high = np.full(spots, np.inf), np.full(spots, -np.inf)
    for spot, low, high in useful.collect():
        cells.low[spot], cells.high[spot] = low, high
    return _first(near.drop("rank").union(joined(False)), k)


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, cells: int = 256, cell_anchors: int = 512) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor: a condition on the column `id`. An anchor's positives are its first other rows of the same label; for each,
    the first rows of other labels of `least` to `most` per cent of the positive's score.
    """
    whole_number = isinstance(rows.schema[label_col].dataType, IntegralType)
    number = F.col(label_col).cast("long") if whole_number else F.xxhash64(F.col(label_col).cast("string"))
    given = rows.select(F.col(id_col).cast("long").alias("id"), number.alias("label"), F.col(label_col).isNotNull().alias("labelled"), F.col(vector_col).cast("array<double>").alias("vector"))
    whole, length = whole_vectors(given.where("id is not null and labelled").drop("labelled").withColumn("row", F.monotonically_increasing_id()), "whole")
    anchors = whole.where(is_anchor)
    norm = whole.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).first()[0] or 0.0
    n = min(cells, -(-anchors.count() // cell_anchors))
    some = anchors.orderBy(F.xxhash64("row"), "row").limit(n).select("vector").collect()
    pivots = np.array([[*r[0], 0] for r in some], np.float64).reshape(len(some), length + 1)
    if not len(pivots):
        pivots = np.zeros((1, length + 1))
    found = Cells(pivots, norm, 1)

    every = F.array(F.struct(F.lit(0).cast("long").alias("positive"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi")))
    good = cut(first_in_windows(whole, anchors.withColumn("windows", every), found, length, positives, True), "positives")
    # Rounded inwards, so that least * score <= 100 * other <= most * score; a negative score has no such window.
    lo, hi = F.expr(f"({least} * score + 99) div 100"), F.expr(f"({most} * score) div 100")
    wanted = good.where("score >= 0").groupBy("anchor").agg(F.collect_list(F.struct(F.col("row").alias("positive"), lo.alias("lo"), hi.alias("hi"))).alias("windows"))
    asked = anchors.join(wanted.withColumnRenamed("anchor", "row"), "row")
    bad = first_in_windows(whole, asked, found, length, negatives, False)
    told = good.select("anchor", F.col("row").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    told = told.join(bad.select("anchor", "positive", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank"), ["anchor", "positive"])
    names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return told.join(names, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
