"""Native files made by relational operators: pixels to bytes, bytes to runs, and parts in their order to one binary.

A file comes together in two levels: the parts of a line in one group, then the lines of a file, whose text is at most the
file in hex. No pixel goes through Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.palettes import Colour
from . import color, packing
from .statistics import with_extent


def scaled(pixels: DataFrame, width: int, height: int, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Images brought to width by height, each place showing the pixel under it; a source pixel makes the places that show it,
    so nothing is joined but an image's extent."""
    places = lambda c, own, to: F.sequence(F.expr(f"({c} * {to} + {own} - 1) div {own}"), F.expr(f"(({c} + 1) * {to} + {own} - 1) div {own} - 1"))
    shown = lambda c, own, to: F.when(F.expr(f"({c} * {to} + {own} - 1) div {own} <= (({c} + 1) * {to} + {own} - 1) div {own} - 1"), places(c, own, to))
    tall = with_extent(pixels.select(*keys, "y", "x", "r", "g", "b"), keys).withColumn("__y", F.explode(shown("y", "__h", height)))
    return tall.withColumn("__x", F.explode(shown("x", "__w", width))).select(*keys, F.col("__y").alias("y"), F.col("__x").alias("x"), "r", "g", "b")


def byte_hex(value: Column) -> Column:
    return F.lpad(F.hex(value), 2, "0")


def assemble(parts: DataFrame, keys: tuple[str, ...] = ("image_id",), head: str = "", tail: str = "") -> DataFrame:
    """(keys, content): parts(keys, line, at, hex) in the order of line and at, between fixed bytes (in hex)."""
    joined = lambda order: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "hex"))), lambda p: p["hex"]), "").alias("hex")
    lines = parts.groupBy(*keys, "line").agg(joined("at"))
    files = lines.groupBy(*keys).agg(joined("line"))
    return files.select(*keys, F.unhex(F.concat(F.lit(head), "hex", F.lit(tail))).alias("content"))


def spectrum_screen(pixels: DataFrame, palette: list[Colour], keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, content): 256 by 192 pixels with two colours a cell of 8 by 8, as the screen memory of the machine: thirds of
    eight interleaved lines, then a byte of colours a cell."""
    fitted = scaled(pixels, 256, 192, keys)
    cells = packing.cell_quantise(color.nearest(fitted, palette), 2, keys=keys)
    chosen = packing.cell_choose(fitted, cells, palette, keys=keys)
    lines = packing.pack_bits(chosen, "1 - slot", keys).select(*keys, F.expr("y div 64 * 64 + y % 8 * 8 + y div 8 % 8").alias("line"), F.col("col").alias("at"), byte_hex(F.col("byte")).alias("hex"))
    one, two = F.element_at("colours", 1), F.coalesce(F.try_element_at("colours", F.lit(2)), F.element_at("colours", 1))
    half = lambda c: F.call_function("shiftright", c, F.lit(1))
    both = half(one) + F.call_function("shiftleft", half(two), F.lit(3)) + F.call_function("shiftleft", one.bitwiseOR(two).bitwiseAND(F.lit(1).cast("long")), F.lit(6))
    colours = cells.select(*keys, (F.lit(192) + F.col("cy")).alias("line"), F.col("cx").alias("at"), byte_hex(both).alias("hex"))
    return assemble(lines.unionByName(colours), keys)


def pcx_head(width: int, height: int, depth: int, palette: list[Colour]) -> str:
    """The 128 bytes before the lines of a packed PCX file, in hex."""
    word = lambda n: n.to_bytes(2, "little")
    size = b"".join(map(word, (0, 0, width - 1, height - 1, 72, 72)))
    line = -(-width * depth // 16) * 2
    return (bytes((10, 5, 1, depth)) + size + b"".join(map(bytes, palette[:16])).ljust(48, b"\0") + bytes((0, 1)) + word(line) + word(1)).ljust(128, b"\0").hex().upper()


def pcx_file(pixels: DataFrame, palette: list[Colour], width: int = 320, height: int = 200, depth: int = 2, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, content): pixels of `depth` bits, packed, and each line's bytes as runs of at most 63. Lines have an even number
    of bytes."""
    packed = packing.pack_bits(color.nearest(scaled(pixels, width, height, keys), palette), "idx", keys, depth)
    if -(-width * depth // 8) % 2:
        odd = packed.select(*keys, "y").distinct().select(*keys, "y", F.lit(-(-width * depth // 8)).cast("long").alias("col"), F.lit(0).cast("long").alias("byte"))
        packed = packed.unionByName(odd)
    lines = packing.runs(packed, "byte", "col", (*keys, "y"))
    return assemble(lines.select(*keys, F.col("y").alias("line"), F.col("start").alias("at"), packing.pcx_bytes(F.col("length"), F.col("value")).alias("hex")), keys, pcx_head(width, height, depth, palette))
