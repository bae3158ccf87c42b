"""Palettes that are data: median cut in rounds, matching to a palette of each image or line, palette reuse and slots.

A palette table has the columns of its keys, `idx` and r, g, b (whole numbers or doubles). Everything here is joins, folded
counts and windows, but for the walk over an image's lines that decides which line keeps the palette before it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import METRICS
from .rounds import settle

CHANNELS = ("r", "g", "b")


def _entries(palettes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, entries): each palette as an array in the order of idx; a palette is a few hundred entries at most."""
    entry = F.struct(F.col("idx").cast("long").alias("i"), *[F.col(c).cast("double").alias(f"p{c}") for c in CHANNELS])
    return palettes.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def _joined(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which null keys are keys like others; the table's keys go."""
    renamed = table.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(renamed, same).drop(*[f"__{k}" for k in keys])


def candidate_entries(colours: DataFrame, palettes: DataFrame, keys: tuple[str, ...], side: int = 32) -> DataFrame:
    """(keys, cell, near): for the cells of RGB space (cubes of `side` levels) that colours lie in, the entries of the
    palette that can be nearest to a colour of the cell.

    An entry can be nearest only if its least distance to the cell is no more than another's greatest one. Which those are
    depends on the cell and the palette alone, so they are found once a cell and not once a pixel.
    """
    cells = colours.select(*keys, *[F.floor(F.col(c) / side).alias(f"__{c}") for c in CHANNELS]).distinct()
    low = lambda c: F.col(f"__{c}") * F.lit(float(side))
    high = lambda c: low(c) + F.lit(float(side))  # noqa: E731  colours need not be whole numbers
    square = lambda x: x * x
    least = lambda e: sum((square(F.greatest(low(c) - e[f"p{c}"], e[f"p{c}"] - high(c), F.lit(0.0))) for c in CHANNELS), F.lit(0.0))
    most = lambda e: sum((square(F.greatest(F.abs(e[f"p{c}"] - low(c)), F.abs(e[f"p{c}"] - high(c)))) for c in CHANNELS), F.lit(0.0))
    # A lambda variable is computed once a row; a column of its own would be computed again for each entry.
    reach = F.array(F.array_min(F.transform("entries", most)) + F.lit(1e-6))
    near = F.transform(reach, lambda top: F.filter("entries", lambda e: least(e) <= top))[0]
    return _joined(cells, _entries(palettes, keys), list(keys)).select(*keys, *[f"__{c}" for c in CHANNELS], near.alias("near"))


def nearest_in(pixels: DataFrame, palettes: DataFrame, keys: tuple[str, ...] = ("image_id",), metric: str = "euclid", out: str = "idx", side: int = 32) -> DataFrame:
    """pixels with `out`: the idx of the nearest entry of the palette of their keys, the lowest on a tie. Pixels without a
    palette have no row; nulls in keys are a key like others.

    For the squared distance each pixel is compared with the candidates of its cell only; the join is on keys and cell, so
    that one image of one palette is dealt out by colour. Other metrics look at all entries.
    """
    text = METRICS[metric]
    if metric != "euclid":
        table = _entries(palettes, keys).withColumnRenamed("entries", "__near")
        told = _joined(pixels, table, list(keys))
    else:
        table = candidate_entries(pixels, palettes, keys, side).withColumnRenamed("near", "__near")
        placed = pixels.withColumns({f"__c{c}": F.floor(F.col(c) / side) for c in CHANNELS})
        table = table.withColumnsRenamed({f"__{c}": f"__c{c}" for c in CHANNELS})
        told = _joined(placed, table, [*keys, *[f"__c{c}" for c in CHANNELS]]).drop(*[f"__c{c}" for c in CHANNELS])
    for p in ("pr", "pg", "pb"):
        text = text.replace(p, f"e.{p}")
    best = F.expr(f"array_min(transform(__near, e -> named_struct('d', cast({text} as double), 'i', e.i))).i")
    return told.withColumn(out, best).drop("__near")


def nearest_by_line(pixels: DataFrame, slots: DataFrame, palettes: DataFrame, keys: tuple[str, ...] = ("image_id",), out: str = "idx") -> DataFrame:
    """nearest_in by slots(keys, y, slot) and palettes(keys, slot, idx, r, g, b); pixels keep their slot."""
    return nearest_in(_joined(pixels, slots.select(*keys, "y", "slot"), [*keys, "y"]), palettes, (*keys, "slot"), out=out)


def frequent_palette(pixels: DataFrame, colours: int, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, idx, r, g, b): the most frequent colours of each image, ties by channels; counts are folded first, and each
    task keeps `colours` an image at most."""
    counts = pixels.groupBy(*keys, *CHANNELS).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), *CHANNELS)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= colours).select(*keys, (F.col("rank") - 1).cast("long").alias("idx"), *CHANNELS)


def _stats(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """What a box is told by: its pixels, spans and sums."""
    spans = [(F.max(c) - F.min(c)).alias(f"span_{c}") for c in CHANNELS]
    return rows.groupBy(*keys, "path").agg(F.sum("n").alias("size"), *spans, *[F.sum(F.col(c) * F.col("n")).alias(f"sum_{c}") for c in CHANNELS])


def _taken(boxes: DataFrame, colours: int, order: str, keys: tuple[str, ...]) -> DataFrame:
    """boxes with `taken`: whether the box is one of the first `colours - 1` to be split, of those known so far.

    widest: boxes of the greatest span first, and of equal ones the leftmost that is there; since no half is wider than its
    box, this is the order of spans and then of paths. fifo: by depth and path. Boxes of one pixel are never split.
    """
    able = F.col("size") > 1
    first = [F.greatest(*[f"span_{c}" for c in CHANNELS]).desc(), F.col("path")] if order == "widest" else [F.length("path"), F.col("path")]
    line = Window.partitionBy(*keys, able).orderBy(*first)
    return boxes.withColumn("taken", able & (F.row_number().over(line) < colours))


def median_cut(pixels: DataFrame, colours: int, order: str = "widest", keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, idx, r, g, b) of all images at once: boxes are split at the middle pixel of their longest axis until there are
    `colours`, and each becomes its mean. Pixels are ordered by that axis and then by the other channels.

    Colours are folded to counts, and a box is a path of halves (0 below, 1 above). A round splits every box that may still
    be among the first `colours - 1`: a window of running counts over each box's colours, where the colour at the middle may
    fall to both halves. As many rounds as the deepest box; what is split no further leaves its mean and drops out.
    idx: for `widest` boxes stand from left to right, for `fifo` in the order of the queue.
    """
    if order not in ("widest", "fifo"):
        raise ValueError("order is widest or fifo")
    rows = pixels.groupBy(*keys, *CHANNELS).agg(F.count("*").alias("n")).withColumn("path", F.lit(""))
    boxes, depth = None, 0
    while True:
        rows = settle(rows)
        own = _stats(rows, keys)
        boxes = settle(own if boxes is None else boxes.drop("taken").unionByName(own))
        boxes = _taken(boxes, colours, order, keys)
        split = boxes.where(F.col("taken") & (F.length("path") == depth))
        if split.isEmpty():
            break
        widest = F.greatest(*[f"span_{c}" for c in CHANNELS])
        axis = F.when(F.col("span_r") == widest, 0).when(F.col("span_g") == widest, 1).otherwise(2)
        cut = _joined(rows, split.select(*keys, "path", axis.alias("axis"), F.expr("size div 2").alias("half")), [*keys, "path"])
        chosen = lambda *by_axis: F.when(F.col("axis") == 0, F.col(by_axis[0])).when(F.col("axis") == 1, F.col(by_axis[1])).otherwise(F.col(by_axis[2]))
        line = Window.partitionBy(*keys, "path").orderBy(chosen("r", "g", "b"), chosen("g", "r", "r"), chosen("b", "b", "g"))
        upto = cut.withColumn("upto", F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        below = F.greatest(F.lit(0), F.least(F.col("n"), F.col("half") - F.col("upto") + F.col("n")))
        halves = F.array(F.struct(F.lit("0").alias("side"), below.alias("n")), F.struct(F.lit("1").alias("side"), (F.col("n") - below).alias("n")))
        dealt = upto.select(*keys, *CHANNELS, "path", F.explode(halves).alias("h")).where("h.n > 0")
        rows = dealt.select(*keys, *CHANNELS, F.col("h.n").alias("n"), F.concat("path", "h.side").alias("path"))
        depth += 1
    parents = boxes.where("taken").select(*keys, F.col("path").alias("parent"))
    held = boxes.where(~F.col("taken")).withColumn("parent", F.when(F.length("path") > 0, F.expr("left(path, length(path) - 1)")))
    leaves = _joined(held.where(F.col("parent").isNotNull()), parents, [*keys, "parent"]).unionByName(held.where(F.col("parent").isNull())).drop("parent")
    place = [F.col("path")] if order == "widest" else [F.length("path"), F.col("path")]
    idx = F.row_number().over(Window.partitionBy(*keys).orderBy(*place)).cast("long") - 1
    return leaves.select(*keys, idx.alias("idx"), *[(F.col(f"sum_{c}") / F.col("size")).alias(c) for c in CHANNELS])


def _walk(rows: pd.DataFrame, keys: tuple[str, ...], tolerance: float) -> pd.DataFrame:
    """Which line's palette each line of an image uses; rows are lines with arrays of colours, counts and entries."""
    out, kept, owner = [], None, None
    for y, colours, counts, entries in rows.sort_values("y")[["y", "colours", "counts", "entries"]].itertuples(index=False):
        line = np.stack(list(colours)).astype(float)
        weights = np.asarray(list(counts), float)
        fit = lambda palette: float((np.sqrt(((line[:, None] - palette[None]) ** 2).sum(axis=2).min(axis=1)) * weights).sum() / weights.sum())  # noqa: B023, E731
        error = fit(kept) if kept is not None else None
        if error is None or error > tolerance:
            kept, owner = np.stack(list(entries)).astype(float), y
            error = fit(kept)
        out.append((y, owner, error))
    return pd.DataFrame({**{k: rows[k].iloc[0] for k in keys}, "y": [o[0] for o in out], "owner": [o[1] for o in out], "error": [o[2] for o in out]})


def reuse_palettes(pixels: DataFrame, palettes: DataFrame, tolerance: float, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, y, owner, error): the line whose palette each line uses. palettes(keys, y, idx, r, g, b) are the lines' own;
    the palette in use is kept while the mean distance of a line's pixels to it is at most `tolerance`.

    Colours are folded by line first. The walk from line to line is a fold over an image's lines, a row each; nothing else
    is sequential.
    """
    folded = pixels.groupBy(*keys, "y", *CHANNELS).agg(F.count("*").alias("n"))
    rgb = F.array(*[F.col(c).cast("double") for c in CHANNELS])
    lines = folded.groupBy(*keys, "y").agg(F.collect_list(F.struct(rgb.alias("c"), "n")).alias("own")).select(*keys, "y", F.col("own.c").alias("colours"), F.col("own.n").alias("counts"))
    tables = palettes.groupBy(*keys, "y").agg(F.sort_array(F.collect_list(F.struct("idx", rgb.alias("c")))).alias("own")).select(*keys, "y", F.col("own.c").alias("entries"))
    types = dict(pixels.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", y {types['y']}, owner {types['y']}, error double"
    return _joined(lines, tables, [*keys, "y"]).groupBy(*keys).applyInPandas(lambda rows: _walk(rows, keys, tolerance), schema)


def palette_key(entries: Column) -> Column:
    """What makes palettes one: their channels cut to whole numbers, in order; entries as an array of (idx, r, g, b)."""
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(",", *[F.floor(e[c]).cast("string") for c in CHANNELS])), "|")


def palette_slots(owners: DataFrame, palettes: DataFrame, most: int = 16, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, y, owner, slot, slot_owner): lines whose palettes have the same key share a slot, numbered by first sight.

    owners(keys, y, owner) and palettes(keys, y, idx, r, g, b). Where an image would take more than `most` slots, its lines
    are dealt into `most` runs of equal length (the last takes the rest), and a run shows the palette of its middle line.
    slot_owner: the line whose palette the slot holds. Windows run over an image's lines and its distinct palettes.
    """
    entry = F.struct("idx", *CHANNELS)
    keyed = palettes.groupBy(*keys, F.col("y").alias("owner")).agg(palette_key(F.sort_array(F.collect_list(entry))).alias("key"))
    lines = _joined(owners.select(*keys, "y", "owner"), keyed, [*keys, "owner"])
    first = lines.groupBy(*keys, "key").agg(F.min("y").alias("first"), F.min_by("owner", "y").alias("slot_owner"))
    line = Window.partitionBy(*keys)
    slots = first.withColumns({"slot": F.row_number().over(line.orderBy("first")).cast("long") - 1, "slots": F.count("*").over(line)})
    told = _joined(lines, slots.drop("first"), [*keys, "key"]).withColumns({"place": F.row_number().over(line.orderBy("y")) - 1, "height": F.count("*").over(line)})
    each = F.expr(f"greatest(height div {most}, 1)")
    run = F.least(F.expr(f"place div greatest(height div {most}, 1)"), F.lit(most - 1)).cast("long")
    told = told.withColumn("run", run).withColumn("middle", ((F.col("run") * each + F.when(F.col("run") == most - 1, F.col("height")).otherwise((F.col("run") + 1) * each)) / 2).cast("long"))
    middles = told.select(*keys, F.col("place").cast("long").alias("middle"), F.col("owner").alias("run_owner"))
    full = F.col("slots") > most
    merged = _joined(told, middles, [*keys, "middle"])
    return merged.select(*keys, "y", "owner", F.when(full, F.col("run")).otherwise(F.col("slot")).alias("slot"), F.when(full, F.col("run_owner")).otherwise(F.col("slot_owner")).alias("slot_owner"))
