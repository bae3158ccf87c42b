"""Equalisation by the ranks of sliding windows, in time that does not grow with the window.

Histograms are held cumulated: a pixel of level v adds one to all bins from v on. A block of pixels keeps one of them for
each column of its window's rows, adds the row that comes in and takes off the one that goes, and running sums along x make
the histogram of any span of columns a difference of two. Each pixel then reads one bin of it.

Besides the window centred on each pixel there is the scan that carries one histogram on from pixel to pixel and from line
to line without clearing it. There an image is dealt into bands of lines: what a band adds to the histogram is 256 numbers,
whose running sums over an image's bands are joined back to the bands' pixels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rounds import settle

BINS = 256
_BINS = np.arange(BINS)
LUMA = "(0.299e0*r + 0.587e0*g + 0.114e0*b)"
LEVEL = f"cast(least(greatest(floor({LUMA}), 0), 255) as bigint)"


def _hot(line: np.ndarray) -> np.ndarray:
    """What a line of levels (-1: no pixel) adds to the cumulated histograms of its columns."""
    return (line[:, None] <= _BINS) & (line[:, None] >= 0)


def _spans(grid: np.ndarray, first: int, last: int, above: int, below: int):
    """For each line y of first .. last - 1 of a grid of levels: y, and the cumulated histograms of the columns 0 .. c - 1
    (c = 0 .. width) over the lines y - above .. y + below - 1."""
    height, width = grid.shape
    columns = np.zeros((width, BINS), np.int32)
    for y in range(max(0, first - above), min(height, first + below)):
        columns += _hot(grid[y])
    upto = np.zeros((width + 1, BINS), np.int32)
    for y in range(first, last):
        if y > first:
            if 0 <= y + below - 1 < height:
                columns += _hot(grid[y + below - 1])
            if 0 <= y - above - 1 < height:
                columns -= _hot(grid[y - above - 1])
        np.cumsum(columns, axis=0, out=upto[1:])
        yield y, upto


def window_rank(pixels: DataFrame, window: int, value: str = "bin", keys: tuple[str, ...] = (), side: int = 128) -> DataFrame:
    """(keys, y, x, below, size): of the pixels in a window of half its width on each side, clipped at the edges, how many are
    not above the pixel. Values are 0 .. 255. One shuffle: pixels go to the blocks of side * side places that they are near."""
    reach = window // 2
    if reach > side:
        raise ValueError("a window reaches beyond the blocks next to its own")

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(rows["by"].iloc[0]) * side - reach, int(rows["bx"].iloc[0]) * side - reach
        wide = side + 2 * reach
        grid = np.full((wide, wide), -1, np.int64)
        grid[rows["y"] - y0, rows["x"] - x0] = rows[value]
        own = rows[(rows["y"] // side == rows["by"]) & (rows["x"] // side == rows["bx"])].sort_values("y")
        ys, xs, levels = (own["y"] - y0).to_numpy(), (own["x"] - x0).to_numpy(), own[value].to_numpy()
        below, size = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        if len(own):
            cuts = np.searchsorted(ys, np.arange(int(ys[0]), int(ys[-1]) + 2))
            for y, upto in _spans(grid, int(ys[0]), int(ys[-1]) + 1, reach, reach + 1):
                at = slice(cuts[y - ys[0]], cuts[y - ys[0] + 1])
                right, left = xs[at] + reach + 1, xs[at] - reach
                below[at] = upto[right, levels[at]] - upto[left, levels[at]]
                size[at] = upto[right, BINS - 1] - upto[left, BINS - 1]
        return own[[*keys, "y", "x"]].assign(below=below, size=size)

    near = lambda c: F.array_distinct(F.transform(F.array(F.lit(-reach), F.lit(0), F.lit(reach)), lambda d: F.floor((F.col(c) + d) / F.lit(float(side)))))
    dealt = pixels.select(*keys, "y", "x", F.col(value).cast("long").alias(value)).withColumn("by", F.explode(near("y"))).withColumn("bx", F.explode(near("x"))).where("by >= 0 and bx >= 0")
    kinds = dict(pixels.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, "y", "x"]) + ", below long, size long"
    return dealt.groupBy(*keys, "by", "bx").applyInPandas(work, schema)


def carried_rank(pixels: DataFrame, window: int, keys: tuple[str, ...] = (), band: int = 64) -> DataFrame:
    """pixels(keys, y, x, r, g, b) with `bin`, `below` and `size` by the carried histogram, in the order of lines.

    With h half the window: the histogram begins with the lines under h and the columns under the window. At each pixel,
    `below` counts its bins up to the pixel's and `size` all of it; then the column x + h of the lines y - h .. y + h - 1 is
    added where there is one, and the column x - h taken off. Nothing is cleared at the end of a line, so counts of bins may
    fall below zero. A band with the lines it looks at is a group; images wider than memory are not for this form.
    """
    half = window // 2
    binned = pixels.select(*keys, "y", "x", "r", "g", "b", F.expr(LEVEL).alias("bin"))
    extent = binned.groupBy(*keys).agg((F.max("x") + 1).alias("__w"))
    sized = binned.join(extent, list(keys)) if keys else binned.crossJoin(F.broadcast(extent))
    bands = F.sequence(F.greatest(F.floor((F.col("y") - half + 1) / F.lit(float(band))), F.lit(0)), F.floor((F.col("y") + half) / F.lit(float(band))))
    dealt = sized.withColumn("band", F.explode(bands))
    kinds = dict(sized.dtypes)

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        number, width = int(rows["band"].iloc[0]), int(rows["__w"].iloc[0])
        y0 = max(0, number * band - half)
        grid = np.full((int(rows["y"].max()) - y0 + 1, width), -1, np.int64)
        grid[rows["y"] - y0, rows["x"]] = rows["bin"]
        own = rows[rows["y"] // band == number].sort_values(["y", "x"])
        if not len(own):  # only lines that other bands look at
            return own[[*keys, "y", "x", "r", "g", "b", "bin"]].assign(below=own["bin"], size=own["bin"], band=own["band"], added=None)
        carried = np.zeros(BINS, np.int64)
        if number == 0:
            for line in grid[:half, :window]:
                carried += _hot(line).sum(axis=0)
        ys, xs, levels = (own["y"] - y0).to_numpy(), own["x"].to_numpy(), own["bin"].to_numpy()
        below, size = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        first, last = int(ys[0]), int(ys[-1])
        cuts = np.searchsorted(ys, np.arange(first, last + 2))
        for y, upto in _spans(grid, first, last + 1, half, half):
            at = slice(cuts[y - first], cuts[y - first + 1])
            right, left = np.minimum(xs[at] + half, width), np.maximum(xs[at] - half, 0)
            begin = np.minimum(half, right)
            read = lambda level: carried[level] + upto[right, level] - upto[begin, level] - upto[left, level]  # noqa: B023, E731
            below[at], size[at] = read(levels[at]), read(BINS - 1)
            carried += upto[width] - upto[min(half, width)] - upto[max(0, width - half)]
        told = own[[*keys, "y", "x", "r", "g", "b", "bin"]].assign(below=below, size=size, band=number, added=None)
        end = told.iloc[:1].assign(bin=-1, added=[carried.tolist()])
        return pd.concat([told, end])

    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, "y", "x", "r", "g", "b"]) + ", bin long, below long, size long, band long, added array<long>"
    found = settle(dealt.groupBy(*keys, "band").applyInPandas(work, schema))
    ends = found.where("bin < 0").select(*keys, "band", F.posexplode("added").alias("level", "n"))
    before = Window.partitionBy(*keys, "level").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("n", F.coalesce(F.sum("n").over(before), F.lit(0))).groupBy(*keys, "band").agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "n"))), lambda e: e["n"]).alias("carry"))
    told = found.where("bin >= 0").drop("added").join(carry, [*keys, "band"])
    return told.withColumns({"below": F.col("below") + F.element_at("carry", F.col("bin").cast("int") + 1), "size": F.col("size") + F.element_at("carry", BINS)}).drop("band", "carry")


def carried_equalise(pixels: DataFrame, window: int = 40, keys: tuple[str, ...] = (), additive: bool = False, band: int = 64) -> DataFrame:
    """Sliding-window equalisation with the carried histogram: channels times new / old level, where there is one, or plus
    new - old. The new level is 255 times the share; without pixels in the histogram it is the old one, or, in the additive
    form, the old one over 255."""
    ranks = carried_rank(pixels, window, keys, band)
    if additive:
        new = F.expr("case when size > 0 then below / cast(size as double) * 255e0 else bin / 255e0 end")
        made = {c: F.col(c) + F.col("__new") - F.col("bin") for c in "rgb"}
    else:
        new = F.expr("case when size > 0 then below * 255 / cast(size as double) else cast(bin as double) end")
        made = {c: F.when(F.col("bin") > 0, F.col(c) * (F.col("__new") / F.col("bin"))).otherwise(F.col(c).cast("double")) for c in "rgb"}
    told = ranks.withColumn("__new", new)
    return told.withColumns({c: F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)) for c, v in made.items()}).select(*keys, "y", "x", "r", "g", "b")
