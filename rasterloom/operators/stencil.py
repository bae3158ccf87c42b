"""3x3 neighbourhoods of all channels at once, with one exchange of the pixels.

Pixels go to tiles of side * side places, and those at a tile's edge also to the tile beyond it. Within a tile the rows above
and below stand next to a pixel by one window along y, and the columns beside it by one along x; both windows need the
tile's pixels together and nothing else, so they sort but do not shuffle again, whatever the number of channels and kernels.
A large image spreads over its tiles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Kernel = tuple[tuple[float, ...], ...]

# Kernels.
KERNELS: dict[str, Kernel] = {
    "lowpass": ((1 / 9,) * 3,) * 3,
    "box": ((1.0,) * 3,) * 3,
    "sharpen": ((0.0, -1.0, 0.0), (-1.0, 5.0, -1.0), (0.0, -1.0, 0.0)),
    "emboss": ((-2.0, -1.0, 0.0), (-1.0, 1.0, 1.0), (0.0, 1.0, 2.0)),
    "laplacian": ((-1.0, -1.0, -1.0), (-1.0, 8.0, -1.0), (-1.0, -1.0, -1.0)),
    "sobel_x": ((-1.0, 0.0, 1.0), (-2.0, 0.0, 2.0), (-1.0, 0.0, 1.0)),
    "sobel_y": ((-1.0, -2.0, -1.0), (0.0, 0.0, 0.0), (1.0, 2.0, 1.0)),
}


def neighbourhoods(pixels: DataFrame, channels: tuple[str, ...], keys: tuple[str, ...] = (), side: int = 128) -> tuple[DataFrame, Callable[[int, int, str], Column], Column]:
    """pixels with what stands around them, tap(dy, dx, channel) as a column of it, and whether all eight neighbours are there.

    Null where there is no pixel. The columns that begin with __ are dropped by the caller.
    """
    near = lambda c: F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor((F.col(c) + d) / F.lit(float(side)))))
    dealt = pixels.withColumn("__by", F.explode(near("y"))).withColumn("__bx", F.explode(near("x"))).repartition(*keys, "__by", "__bx")
    tile = [*keys, "__by", "__bx"]
    down, across = Window.partitionBy(*tile, "x").orderBy("y"), Window.partitionBy(*tile, "y").orderBy("x")
    own = F.struct(F.col("y").alias("at"), *[F.col(c) for c in channels])
    beside = lambda step, line, at, value: (lambda held: F.when(held["at"] == F.col(at) + step, held))((F.lag if step < 0 else F.lead)(value).over(line))
    column = dealt.withColumns({"__up": beside(-1, down, "y", own), "__down": beside(1, down, "y", own)})
    three = F.struct(F.col("x").alias("at"), F.col("__up").alias("up"), own.alias("mid"), F.col("__down").alias("down"))
    held = column.withColumns({"__left": beside(-1, across, "x", three), "__right": beside(1, across, "x", three)})
    held = held.where((F.floor(F.col("y") / F.lit(float(side))) == F.col("__by")) & (F.floor(F.col("x") / F.lit(float(side))) == F.col("__bx")))
    rows = ("up", "mid", "down")

    def tap(dy: int, dx: int, channel: str) -> Column:
        if dx == 0:
            return F.col(channel) if dy == 0 else F.col(f"__{rows[dy + 1]}")[channel]
        return F.col("__left" if dx < 0 else "__right")[rows[dy + 1]][channel]

    whole = F.lit(True)
    for name in ("__up", "__down", "__left.up", "__left.down", "__left.mid", "__right.up", "__right.down", "__right.mid"):
        whole = whole & F.col(name).isNotNull()
    return held, tap, whole


def _sum(tap: Callable[[int, int, str], Column], kernel: Kernel, channel: str) -> Column:
    return sum((F.lit(w) * tap(j - 1, i - 1, channel) for j, row in enumerate(kernel) for i, w in enumerate(row) if w), F.lit(0.0))


def _plain(held: DataFrame) -> DataFrame:
    return held.drop("__by", "__bx", "__up", "__down", "__left", "__right")


def _clamped(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(255.0))


def convolve(pixels: DataFrame, kernel: Kernel, channel: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The pixels with `conv`, a 3x3 sum over the channel; null at the border, for the caller to keep what it will."""
    held, tap, whole = neighbourhoods(pixels, (channel,), keys)
    return _plain(held.withColumn("conv", F.when(whole, _sum(tap, kernel, channel))))


def filtered(pixels: DataFrame, kernel: str, channels: tuple[str, ...] = ("r", "g", "b"), keys: tuple[str, ...] = (), strength: float = 1.0, depth: float = 1.0, offset: float = 0.0) -> DataFrame:
    """A 3x3 filter of all channels, clamped to 0..255; border pixels are unchanged.

    The sum is multiplied by `depth`; `strength` is how far a pixel goes from what it was to that; `offset` is added at last.
    """
    held, tap, whole = neighbourhoods(pixels, channels, keys)
    made = {}
    for c in channels:
        conv = _sum(tap, KERNELS[kernel], c) * F.lit(depth) if depth != 1.0 else _sum(tap, KERNELS[kernel], c)
        moved = conv if strength == 1.0 else F.col(c) + (conv - F.col(c)) * F.lit(strength)
        made[c] = F.when(whole, _clamped(moved + F.lit(offset) if offset else moved)).otherwise(F.col(c).cast("double"))
    return _plain(held.withColumns(made))


def _gradient(tap: Callable[[int, int, str], Column], channel: str) -> Column:
    gx, gy = _sum(tap, KERNELS["sobel_x"], channel), _sum(tap, KERNELS["sobel_y"], channel)
    return F.sqrt(gx * gx + gy * gy)


def sobel(pixels: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), keys: tuple[str, ...] = ()) -> DataFrame:
    """(pixel + gradient) / 2 of all channels, clamped; border pixels are unchanged."""
    held, tap, whole = neighbourhoods(pixels, channels, keys)
    return _plain(held.withColumns({c: F.when(whole, _clamped((F.col(c) + _gradient(tap, c)) * 0.5)).otherwise(F.col(c).cast("double")) for c in channels}))


def edges(pixels: DataFrame, threshold: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """255 where the mean gradient of the three channels is over the threshold, else 0; border pixels are unchanged."""
    held, tap, whole = neighbourhoods(pixels, ("r", "g", "b"), keys)
    mean = sum((_gradient(tap, c) for c in "rgb"), F.lit(0.0)) / F.lit(3.0)
    return _plain(held.withColumns({c: F.when(whole, F.when(mean > F.lit(float(threshold)), 255).otherwise(0)).otherwise(F.col(c)) for c in "rgb"}))
