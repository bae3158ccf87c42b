"""Histograms, equalisation, windows over neighbours, palette selection.

`keys` name the columns that tell images apart; hot images are folded by partial aggregation, and windows run over rows
and columns of an image, so one large image spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sliding import window_rank

LUMA_BIN = "(299*r + 587*g + 114*b) div 1000"
BINS = 256


def with_bin(pixels: DataFrame, expression: str = LUMA_BIN, name: str = "bin") -> DataFrame:
    return pixels.withColumn(name, F.expr(expression))


def histogram(pixels: DataFrame, keys: tuple[str, ...] = (), bins: str = "bin") -> DataFrame:
    return pixels.groupBy(*keys, bins).agg(F.count("*").alias("n"))


def joint_histograms(pixels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, channel, value, n, share) of red, green, blue and luma (cut to a whole number), dense over 256 values: counts,
    and counts over the greatest of all four channels. Counts are folded before they move, then an image has 1024 rows."""
    level = F.expr("cast(least(floor(0.299e0*r + 0.587e0*g + 0.114e0*b), 255) as bigint)")
    each = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("long").alias("value")) for c in "rgb"], F.struct(F.lit("luma").alias("channel"), level.alias("value")))
    counts = pixels.select(*keys, F.explode(each).alias("p")).groupBy(*keys, "p.channel", "p.value").agg(F.count("*").alias("n"))
    top = counts.groupBy(*keys).agg(F.max("n").alias("__top"))
    dense = top.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in ("r", "g", "b", "luma")]))).withColumn("value", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long"))))
    told = dense.join(counts, [*keys, "channel", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return told.withColumn("share", F.col("n") / F.col("__top")).drop("__top")


def cdf(counts: DataFrame, keys: tuple[str, ...] = (), bins: str = "bin") -> DataFrame:
    """counts with the running sum over bins; at most 256 rows a group."""
    return counts.withColumn("cdf", F.sum("n").over(Window.partitionBy(*keys or [F.lit(0)]).orderBy(bins).rowsBetween(Window.unboundedPreceding, 0)))


def equalise(pixels: DataFrame, keys: tuple[str, ...] = (), form: str = "scale") -> DataFrame:
    """Luma histogram equalisation. scale: channels times new/old luma; additive: plus new-old; lut columns stay as
    `bin` and `new`. An image of one luma keeps it. The table of bins is joined, 256 rows an image at most."""
    binned = with_bin(pixels)
    levels = cdf(histogram(binned, keys), keys)
    whole = Window.partitionBy(*keys or [F.lit(0)])
    spread = levels.withColumns({"lo": F.min("cdf").over(whole), "total": F.max("cdf").over(whole)})
    lut = spread.select(*keys, "bin", F.expr("case when total = lo then bin else (cdf - lo) * 255 div (total - lo) end").alias("new"))
    told = binned.join(lut, [*keys, "bin"])
    if form == "additive":
        return told.withColumns({c: F.greatest(F.least(F.expr(f"{c} + new - bin"), F.lit(255)), F.lit(0)) for c in "rgb"})
    return told.withColumns({c: F.when(F.col("bin") > 0, F.least(F.expr(f"{c} * new div bin"), F.lit(255))).otherwise(F.col(c)) for c in "rgb"})


def equalise_channel(pixels: DataFrame, channel: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """One channel equalised by its own histogram."""
    levels = cdf(histogram(pixels, keys, channel), keys, channel)
    whole = Window.partitionBy(*keys or [F.lit(0)])
    lut = levels.withColumn("total", F.max("cdf").over(whole)).select(*keys, channel, F.expr("cdf * 255 div total").alias("__new"))
    return pixels.join(lut, [*keys, channel]).withColumn(channel, F.col("__new")).drop("__new")


def clipped_histogram(pixels: DataFrame, tile_width: int, tile_height: int, clip: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ty, tx, bin, n, cdf), dense over 256 bins: counts above the limit are cut and shared over all bins."""
    tiled = with_bin(pixels).withColumns({"ty": F.expr(f"y div {tile_height}"), "tx": F.expr(f"x div {tile_width}")})
    tile = [*keys, "ty", "tx"]
    counts = histogram(tiled, tuple(tile))
    total = counts.groupBy(*tile).agg(F.sum("n").alias("size"))
    limit = F.greatest(F.expr(f"cast(floor(size * {clip!r}D / 256) as bigint)"), F.lit(1))
    dense = total.withColumn("limit", limit).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")))).join(counts, [*tile, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    over = F.sum(F.greatest(F.col("n") - F.col("limit"), F.lit(0))).over(Window.partitionBy(*tile))
    shared = dense.withColumn("excess", over).withColumn("n", F.expr("least(n, limit) + excess div 256"))
    return cdf(shared.select(*tile, "bin", "n"), tuple(tile))


def clahe(pixels: DataFrame, tile_width: int = 40, tile_height: int = 25, clip: float = 3.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Contrast-limited equalisation by tiles; channels are scaled by new/old luma."""
    levels = clipped_histogram(pixels, tile_width, tile_height, clip, keys)
    tile = [*keys, "ty", "tx"]
    lut = levels.withColumn("total", F.max("cdf").over(Window.partitionBy(*tile))).select(*tile, "bin", F.expr("cdf * 255 div total").alias("new"))
    tiled = with_bin(pixels).withColumns({"ty": F.expr(f"y div {tile_height}"), "tx": F.expr(f"x div {tile_width}")})
    told = tiled.join(lut, [*tile, "bin"])
    return told.withColumns({c: F.when(F.col("bin") > 0, F.least(F.expr(f"{c} * new div bin"), F.lit(255))).otherwise(F.col(c)) for c in "rgb"})


def local_rank(pixels: DataFrame, reach: int, value: str = "bin", keys: tuple[str, ...] = ()) -> DataFrame:
    """Each pixel's rank among its (2 reach + 1)^2 neighbours, clipped at the edges: new = 255 * (those not above it) / all.

    Pixels are sent to the blocks of `4 * reach` that their window touches and compared there, so no block is unbounded.
    """
    side = 4 * max(reach, 1)
    spread = lambda c: F.array_distinct(F.array(F.expr(f"({c} - {reach} + {side}) div {side}"), F.expr(f"({c} + {side}) div {side}"), F.expr(f"({c} + {reach} + {side}) div {side}")))
    place = [*keys, "by", "bx"]
    around = pixels.select(*keys, F.col("y").alias("ny"), F.col("x").alias("nx"), F.col(value).alias("nv"), F.explode(spread("y")).alias("by"), "x")
    around = around.select(*keys, "ny", "nx", "nv", "by", F.explode(spread("x")).alias("bx"))
    own = pixels.withColumns({"by": F.expr(f"(y + {side}) div {side}"), "bx": F.expr(f"(x + {side}) div {side}")})
    near = (F.abs(F.col("ny") - F.col("y")) <= reach) & (F.abs(F.col("nx") - F.col("x")) <= reach)
    met = own.join(around, place).where(near)
    counts = met.groupBy(*keys, "y", "x", value).agg(F.count("*").alias("size"), F.count_if(F.col("nv") <= F.col(value)).alias("below"))
    return counts.select(*keys, "y", "x", value, F.expr("below * 255 div size").alias("new"))


LUMA = "(0.299e0*r + 0.587e0*g + 0.114e0*b)"


def _scaled(pixels: DataFrame, new: str, dark: bool = False) -> DataFrame:
    """Channels times new/old luma, clamped; a pixel of hardly any luma stays, or becomes the new grey where `dark`."""
    scale = {c: F.least(F.greatest(F.expr(f"{c} * ({new} / {LUMA})"), F.lit(0.0)), F.lit(255.0)) for c in "rgb"}
    return pixels.withColumns({c: F.when(F.expr(f"{LUMA} > 0.001e0"), v).otherwise(F.expr(new) if dark else F.col(c).cast("double")) for c, v in scale.items()})


def equalise_share(pixels: DataFrame, keys: tuple[str, ...] = (), dark: bool = False) -> DataFrame:
    """Luma equalisation by shares: the new luma is 255 times the share of pixels that are not brighter, not rounded."""
    binned = with_bin(pixels, f"cast(least(greatest(floor({LUMA}), 0), 255) as bigint)")
    levels = cdf(histogram(binned, keys), keys)
    total = F.max("cdf").over(Window.partitionBy(*keys or [F.lit(0)]))
    lut = levels.withColumn("__total", total).select(*keys, "bin", F.expr("cdf / __total * 255e0").alias("__new"))
    return _scaled(binned.join(lut, [*keys, "bin"]), "__new", dark).drop("__new")


def clahe_share(pixels: DataFrame, tile_width: int = 40, tile_height: int = 25, clip: float = 3.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Contrast-limited equalisation by tiles and shares: counts are cut at floor(clip * pixels / 256), what is cut goes to
    all bins in whole numbers, and the running sum is divided by the tile's pixels."""
    tiled = with_bin(pixels, f"cast(least(greatest(floor({LUMA}), 0), 255) as bigint)").withColumns({"ty": F.expr(f"y div {tile_height}"), "tx": F.expr(f"x div {tile_width}")})
    tile = [*keys, "ty", "tx"]
    counts = histogram(tiled, tuple(tile))
    dense = counts.groupBy(*tile).agg(F.sum("n").alias("size")).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long"))))
    cut_off = dense.join(counts, [*tile, "bin"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "limit": F.expr(f"cast(floor({clip!r}D * size / 256) as bigint)")})
    over = F.sum(F.greatest(F.col("n") - F.col("limit"), F.lit(0))).over(Window.partitionBy(*tile))
    shared = cut_off.withColumn("excess", over).withColumn("n", F.expr("least(n, limit) + excess div 256"))
    lut = cdf(shared, tuple(tile)).select(*tile, "bin", F.expr("cdf / size * 255e0").alias("__new"))
    return _scaled(tiled.join(lut, [*tile, "bin"]), "__new").drop("__new", "ty", "tx")


def _blocks(pixels: DataFrame, values: list[str], reach: int, side: int, keys: tuple[str, ...]) -> DataFrame:
    """Each pixel in the block of side * side places that holds it, and in those whose windows it is in: one shuffle."""
    if reach > side:
        raise ValueError("a window reaches beyond the blocks next to its own")
    near = lambda c: F.array_distinct(F.transform(F.array(F.lit(-reach), F.lit(0), F.lit(reach)), lambda d: F.floor((F.col(c) + d) / F.lit(float(side)))))
    return pixels.select(*keys, "y", "x", *values).withColumn("by", F.explode(near("y"))).withColumn("bx", F.explode(near("x"))).where("by >= 0 and bx >= 0")


def _block_work(pixels: DataFrame, values: list[str], made: dict[str, str], work: Callable[..., dict[str, np.ndarray]], reach: int, keys: tuple[str, ...], side: int, edges: bool = False) -> DataFrame:
    """(keys, y, x, made): work on the windows around a block's own pixels, as arrays of pixels by height by width for each
    value. edges: the border of the image is repeated outwards; without it what is outside is -1."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(rows["by"].iloc[0]) * side - reach, int(rows["bx"].iloc[0]) * side - reach
        wide = side + 2 * reach
        own = rows[(rows["y"] // side == rows["by"]) & (rows["x"] // side == rows["bx"])]
        if not len(own):
            return pd.DataFrame({c: [] for c in [*keys, "y", "x", *made]})
        windows = []
        for v in values:
            held = np.full((wide, wide), -1, np.int64)
            held[rows["y"] - y0, rows["x"] - x0] = rows[v]
            if edges:
                width, height = int(rows["__w"].iloc[0]), int(rows["__h"].iloc[0])
                inside = lambda at, top: np.clip(np.arange(at, at + wide), max(at, 0), min(at + wide, top) - 1) - at
                held = held[np.ix_(inside(y0, height), inside(x0, width))]
            windows.append(np.lib.stride_tricks.sliding_window_view(held, (2 * reach + 1, 2 * reach + 1)))
        ys, xs = (own["y"] - y0 - reach).to_numpy(), (own["x"] - x0 - reach).to_numpy()
        parts = []
        for at in range(0, len(own), 512):
            parts.append(work(*(w[ys[at : at + 512], xs[at : at + 512]] for w in windows)))
        return own[[*keys, "y", "x"]].assign(**{c: np.concatenate([p[c] for p in parts]) for c in made})

    kinds = dict(pixels.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, "y", "x"]) + "".join(f", {c} {t}" for c, t in made.items())
    given = with_extent(pixels.select(*keys, "y", "x", *values), keys) if edges else pixels
    return _blocks(given, values + ["__w", "__h"] * edges, reach, side, keys).groupBy(*keys, "by", "bx").applyInPandas(run, schema)


def window_equalise(pixels: DataFrame, window: int = 40, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sliding-window equalisation: the new luma is 255 times the share of the window's pixels that are not above the own."""
    binned = with_bin(pixels, f"cast(least(greatest(floor({LUMA}), 0), 255) as bigint)")
    ranks = window_rank(binned, window, keys=keys).select(*keys, "y", "x", F.expr("below * 255e0 / size").alias("__new"))
    return _scaled(binned.join(ranks, [*keys, "y", "x"]), "__new").drop("__new")


def with_extent(pixels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """pixels with the width and height of their image, __w and __h: a row an image is joined."""
    extent = pixels.groupBy(*keys).agg((F.max("x") + 1).alias("__w"), (F.max("y") + 1).alias("__h"))
    return pixels.join(extent, list(keys)) if keys else pixels.crossJoin(F.broadcast(extent))


def median(pixels: DataFrame, reach: int, channels: tuple[str, ...] = ("r", "g", "b"), keys: tuple[str, ...] = (), side: int = 64) -> DataFrame:
    """(keys, y, x, channels): the median of the (2 reach + 1)^2 values around each pixel, by channel, edges replicated."""
    middle = (2 * reach + 1) ** 2 // 2
    work = lambda *windows: {c: np.partition(w.reshape(len(w), -1), middle, axis=1)[:, middle] for c, w in zip(channels, windows, strict=True)}
    return _block_work(pixels, list(channels), dict.fromkeys(channels, "long"), work, reach, keys, side, True)


def sigma_filter(pixels: DataFrame, reach: int, sigma: int, keys: tuple[str, ...] = (), side: int = 64) -> DataFrame:
    """The mean of the neighbours that differ by less than sigma in sum over the channels (itself always included)."""

    def work(*windows: np.ndarray) -> dict[str, np.ndarray]:
        gap = sum(np.abs(w - w[:, reach, reach][:, None, None]) for w in windows)
        near = gap < sigma
        return {c: (w * near).sum(axis=(1, 2)) / near.sum(axis=(1, 2)) for c, w in zip("rgb", windows, strict=True)}

    return _block_work(pixels, ["r", "g", "b"], dict.fromkeys("rgb", "double"), work, reach, keys, side, True)


def top_colours(matched: DataFrame, n: int, keys: tuple[str, ...] = (), idx: str = "idx") -> DataFrame:
    """The n most frequent indices of a group, with their counts and ranks; ties go to the lower index."""
    counts = matched.groupBy(*keys, idx).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys or [F.lit(0)]).orderBy(F.desc("n"), idx)
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def darkest_total(matched: DataFrame, keys: tuple[str, ...] = (), idx: str = "idx") -> DataFrame:
    """The index with the largest sum of darkness (255 - luma) of a group; ties go to the lower index."""
    sums = matched.groupBy(*keys, idx).agg(F.sum(F.expr(f"255 - {LUMA_BIN}")).alias("weight"))
    return sums.groupBy(*keys).agg(F.max_by(F.struct(idx, "weight"), F.struct("weight", -F.col(idx))).alias("top")).select(*keys, f"top.{idx}", "top.weight")


def by_brightness(colours: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """colours(r, g, b) with `place`: from the darkest, by the sum of channels, ties by channels; a palette's rows at most."""
    return colours.withColumn("place", F.row_number().over(Window.partitionBy(*keys or [F.lit(0)]).orderBy(F.expr("r + g + b"), "r", "g", "b")).cast("long") - 1)
