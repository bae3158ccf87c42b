"""Text modes: for each cell of pixels a glyph, a foreground and a background.

One shuffle by cell; a cell is an array of its pixels (64 of them), and its pattern is told from the array. No row is made
for a glyph or a pair of colours: glyphs are a constant array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import luma
from ..functions.palettes import Colour
from . import color, packing

# The block characters of code page 437 and their 8x8 patterns, rows from the top, leftmost pixel highest.
BLOCKS_437 = (
    (32, 0x0000000000000000),
    (176, 0x2288228822882288),
    (177, 0x55AA55AA55AA55AA),
    (178, 0x77DD77DD77DD77DD),
    (219, 0xFFFFFFFFFFFFFFFF),
    (220, 0x00000000FFFFFFFF),
    (221, 0xF0F0F0F0F0F0F0F0),
    (222, 0x0F0F0F0F0F0F0F0F),
    (223, 0xFFFFFFFF00000000),
)


def _gap(pixel: Column, index: Column, palette: list[Colour]) -> Column:
    table = color.palette_array(palette)
    entry = F.element_at(table, index.cast("int") + 1)
    return sum(((pixel[c] - entry[f"p{c}"]) * (pixel[c] - entry[f"p{c}"]) for c in "rgb"), F.lit(0))


def pattern(fg: str, bg: str, palette: list[Colour]) -> Column:
    """The bits of the pixels of `own` that are no further from the foreground than from the background."""
    bit = lambda p: F.when(_gap(p, F.col(fg), palette) <= _gap(p, F.col(bg), palette), F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(63) - (p["y"] % 8 * 8 + p["x"] % 8).cast("int"))).otherwise(F.lit(0).cast("long"))
    return F.aggregate("own", F.lit(0).cast("long"), lambda bits, p: bits.bitwiseOR(bit(p)))


def _cells(pixels: DataFrame, keys: tuple[str, ...], *aggregates: Column) -> DataFrame:
    own = F.collect_list(F.struct("y", "x", "r", "g", "b")).alias("own")
    return pixels.withColumns({"cy": F.expr("y div 8"), "cx": F.expr("x div 8"), "__l": F.expr(luma("r", "g", "b"))}).groupBy(*keys, "cy", "cx").agg(own, *aggregates)


def _match(cells: DataFrame, pixel: str, palette: list[Colour], out: str, otherwise: int) -> DataFrame:
    """cells with `out`: the index of the entry nearest to the pixel of a column, or a fixed one where it is null."""
    flat = cells.withColumns({c: F.col(f"{pixel}.{c}") for c in "rgb"})
    return color.nearest(flat, palette, out=out).withColumn(out, F.when(F.col(pixel).isNull(), F.lit(otherwise).cast("long")).otherwise(F.col(out))).drop(*"rgb")


def text_cells(pixels: DataFrame, palette: list[Colour], keys: tuple[str, ...] = (), glyphs: tuple[tuple[int, int], ...] = BLOCKS_437, backgrounds: int = 8) -> DataFrame:
    """(keys, cy, cx, code, fg, bg, distance): the foreground is the entry nearest to the cell's brightest pixel (the last
    entry, if all are black), the background that of the first `backgrounds` entries nearest to its darkest one, and the
    glyph the one that differs in the fewest pixels. Of equal pixels the first in order of rows counts, of equal glyphs the
    first."""
    rgb = F.struct("r", "g", "b")
    bright = F.max_by(F.when(F.col("__l") > 0, rgb), F.struct(F.col("__l"), -F.col("y"), -F.col("x"))).alias("__bright")
    dark = F.min_by(rgb, F.struct("__l", "y", "x")).alias("__dark")
    cells = _match(_cells(pixels, keys, bright, dark), "__bright", palette, "fg", len(palette) - 1)
    cells = _match(cells, "__dark", palette[:backgrounds], "bg", 0)
    told = packing.nearest_glyph(cells.withColumn("pattern", pattern("fg", "bg", palette)), list(glyphs))
    return told.select(*keys, "cy", "cx", "code", "fg", "bg", "distance")


def dark_background(pixels: DataFrame, palette: list[Colour], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bg): the entry whose pixels have the greatest sum of darkness, each a whole number of 0 .. 255; the first of
    equal ones."""
    weight = F.expr(f"cast((1 - {luma('r', 'g', 'b')} / 255e0) * 255 as bigint)")
    sums = color.nearest(pixels, palette).groupBy(*keys, "idx").agg(F.sum(weight).alias("weight"))
    return sums.groupBy(*keys).agg(F.max_by("idx", F.struct("weight", -F.col("idx"))).alias("bg"))


def character_cells(pixels: DataFrame, palette: list[Colour], glyphs: list[tuple[int, int]], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, cy, cx, code, fg, bg, distance) on one background an image: the foreground is the entry nearest to the pixel
    whose luma is furthest from the background's (entry 1, if none is away from it), and 1 or 0 where that is the background
    itself, whichever is on the other side of entry 8."""
    ground = dark_background(pixels, palette, keys)
    told = pixels.join(ground, list(keys)) if keys else pixels.crossJoin(F.broadcast(ground))
    shade = F.element_at(F.array(*[F.expr(luma(f"{r}", f"{g}", f"{b}")) for r, g, b in palette]), F.col("bg").cast("int") + 1)
    told = told.withColumn("__far", F.abs(F.expr(luma("r", "g", "b")) - shade))
    far = F.max_by(F.when(F.col("__far") > 0, F.struct("r", "g", "b")), F.struct(F.col("__far"), -F.col("y"), -F.col("x"))).alias("__pixel")
    cells = _match(_cells(told, keys, far, F.first("bg").alias("bg")), "__pixel", palette, "fg", 1)
    cells = cells.withColumn("fg", F.when(F.col("fg") == F.col("bg"), F.when(F.col("bg") < 8, 1).otherwise(0).cast("long")).otherwise(F.col("fg")))
    found = packing.nearest_glyph(cells.withColumn("pattern", pattern("fg", "bg", palette)), glyphs)
    return found.select(*keys, "cy", "cx", "code", "fg", "bg", "distance")
