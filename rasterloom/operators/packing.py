"""Bit packing, runs, glyphs, cells, addresses and checksums, as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pack_bits(pixels: DataFrame, bit: str, keys: tuple[str, ...] = (), depth: int = 1) -> DataFrame:
    """Pixels of `depth` bits to bytes, the leftmost highest: (keys, y, col, byte). Rows are padded with zero bits."""
    per = 8 // depth
    shift = F.expr(f"cast({depth} * ({per} - 1 - x % {per}) as int)")
    value = F.call_function("shiftleft", F.expr(bit).cast("long"), shift)
    return pixels.groupBy(*keys, "y", F.expr(f"x div {per}").alias("col")).agg(F.bit_or(value).alias("byte"))


def pack_planes(pixels: DataFrame, idx: str, planes: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Indices to bit planes: (keys, y, plane, col, byte)."""
    spread = pixels.withColumn("plane", F.explode(F.sequence(F.lit(0), F.lit(planes - 1))))
    bit = F.call_function("shiftright", F.col(idx).cast("long"), F.col("plane")).bitwiseAND(F.lit(1).cast("long"))
    value = F.call_function("shiftleft", bit, F.expr("cast(7 - x % 8 as int)"))
    return spread.groupBy(*keys, "y", "plane", F.expr("x div 8").alias("col")).agg(F.bit_or(value).alias("byte"))


#: Byte addresses as SQL text in y and col.
ADDRESSES = {
    "zx": "(y & 7) * 256 + (y & 56) * 4 + (y & 192) * 32 + col",
    "cpc": "(y div 8) * 80 + (y & 7) * 2048 + col",
    "linear40": "y * 40 + col",
    "cell8": "(y div 8) * 320 + col * 8 + (y & 7)",
}


def runs(rows: DataFrame, value: str, order: str = "x", keys: tuple[str, ...] = ("y",), most: int = 63) -> DataFrame:
    """Runs of equal values, cut at `most`: (keys, start, value, length)."""
    line = Window.partitionBy(*keys).orderBy(order)
    changed = F.when(F.lag(value).over(line) == F.col(value), 0).otherwise(1)
    marked = rows.withColumn("__new", changed).withColumn("__run", F.sum("__new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.row_number().over(Window.partitionBy(*keys, "__run").orderBy(order)) - 1
    cut_up = marked.withColumn("__part", F.floor(inside / most))
    return cut_up.groupBy(*keys, "__run", "__part").agg(F.min(order).alias("start"), F.first(value).alias("value"), F.count("*").alias("length")).drop("__run", "__part")


def pcx_bytes(length: Column, value: Column) -> Column:
    """A run as PCX bytes in hex: the value alone, or a count byte and the value."""
    both = F.concat(F.hex(length + 192), F.lpad(F.hex(value), 2, "0"))
    return F.when((length == 1) & (value < 192), F.lpad(F.hex(value), 2, "0")).otherwise(both)


def changes(cells: DataFrame, fg: str, bg: str, order: tuple[str, ...] = ("y", "x"), keys: tuple[str, ...] = ()) -> DataFrame:
    """The cells whose colours differ from those of the cell before, over row ends; the first of an image always counts.

    Only the last cell of a row matters to the next: rows are compared within themselves, and their ends in one short pass
    over an image's rows.
    """
    y, x = order
    line = Window.partitionBy(*keys, y).orderBy(x)
    ends = cells.groupBy(*keys, y).agg(F.max_by(F.struct(fg, bg), x).alias("end"))
    before = ends.withColumn("__up", F.lag("end").over(Window.partitionBy(*keys or [F.lit(0)]).orderBy(y))).select(*keys, y, "__up")
    told = cells.withColumn("__left", F.lag(F.struct(fg, bg)).over(line)).join(before, [*keys, y])
    last = F.coalesce("__left", "__up")
    return told.where(last.isNull() | (last != F.struct(fg, bg))).drop("__left", "__up")


def cell_patterns(pixels: DataFrame, on: str, key: str) -> DataFrame:
    """8x8 cells to 64-bit patterns, row by row, leftmost highest: (key, pattern)."""
    bit = F.call_function("shiftleft", F.expr(on).cast("long"), F.expr("cast(63 - (y * 8 + x) as int)"))
    return pixels.groupBy(key).agg(F.bit_or(bit).alias("pattern"))


def nearest_glyph(cells: DataFrame, glyphs: list[tuple[int, int]], pattern: str = "pattern") -> DataFrame:
    """The code of the glyph with the fewest differing bits; ties go to the first glyph. Glyphs are a constant array."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(code).cast("long").alias("code"), F.lit(bits if bits < 1 << 63 else bits - (1 << 64)).cast("long").alias("bits")) for k, (code, bits) in enumerate(glyphs)])
    best = F.array_min(F.transform(table, lambda g: F.struct(F.bit_count(F.col(pattern).bitwiseXOR(g["bits"])).cast("long").alias("d"), g["k"].alias("k"), g["code"].alias("code"))))
    return cells.withColumn("__best", best).withColumns({"code": F.col("__best.code"), "distance": F.col("__best.d")}).drop("__best")


def charset(cells: DataFrame, key: str, most: int = 256, pattern: str = "pattern", keys: tuple[str, ...] = ()) -> DataFrame:
    """Patterns to codes, first come first served within an image; (keys, key, pattern, code, distance).

    Patterns beyond the last code take the nearest of those that have one (lowest code on a tie). Tasks keep `most` patterns
    an image before they are numbered, so an image's kept ones are few rows, and then one row of the side that is joined.
    """
    first = cells.groupBy(*keys, pattern).agg(F.min(key).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*keys or [F.lit(0)]).orderBy("first", pattern))
    kept = first.withColumn("rank", rank).where(F.col("rank") <= most).select(*keys, F.col(pattern).alias("__kept"), (F.col("rank") - 1).cast("long").alias("code"))
    held = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("code", "__kept"))).alias("__table"))
    told = cells.join(held, list(keys)) if keys else cells.crossJoin(F.broadcast(held))
    gap = lambda g: F.struct(F.bit_count(F.col(pattern).bitwiseXOR(g["__kept"])).cast("long").alias("d"), g["code"].alias("code"))
    # A pattern that has a code is at distance 0 from it and from no other.
    return told.withColumn("__best", F.array_min(F.transform("__table", gap))).select(*keys, key, pattern, F.col("__best.code").alias("code"), F.col("__best.d").alias("distance"))


def cell_quantise(matched: DataFrame, colours: int, width: int = 8, height: int = 8, idx: str = "idx", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, cy, cx, colours): the most frequent indices of each cell, in order; one shuffle with counts folded first."""
    celled = matched.withColumns({"cy": F.expr(f"y div {height}"), "cx": F.expr(f"x div {width}")})
    counts = celled.groupBy(*keys, "cy", "cx", idx).agg(F.count("*").alias("n"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(idx).alias("i"))))
    return counts.groupBy(*keys, "cy", "cx").agg(F.transform(F.slice(ranked, 1, colours), lambda c: c["i"]).alias("colours"))


def cell_choose(pixels: DataFrame, cells: DataFrame, palette: list[tuple[int, int, int]], width: int = 8, height: int = 8, last: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """pixels with `slot` and `idx`: which of its cell's colours, cells(keys, cy, cx, colours), is nearest to each pixel.

    On a tie the first of the cell's colours is taken, or the last. One join on the cell; a cell's colours are a few.
    """
    celled = pixels.withColumns({"cy": F.expr(f"y div {height}"), "cx": F.expr(f"x div {width}")}).join(cells.select(*keys, "cy", "cx", "colours"), [*keys, "cy", "cx"])
    table = F.array(*[F.struct(F.lit(r).cast("long").alias("r"), F.lit(g).cast("long").alias("g"), F.lit(b).cast("long").alias("b")) for r, g, b in palette])
    gap = lambda c, p: (F.col(c) - p[c]) * (F.col(c) - p[c])
    placed = F.transform("colours", lambda i, k: F.struct(sum((gap(c, F.element_at(table, i.cast("int") + 1)) for c in "rgb"), F.lit(0)).alias("d"), (-k if last else k).alias("k"), i.alias("i")))
    best = celled.withColumn("__best", F.array_min(placed))
    return best.withColumns({"slot": F.abs("__best.k").cast("long"), "idx": F.col("__best.i")}).drop("__best", "colours")


def contrast_cells(pixels: DataFrame, background: tuple[int, int, int], foreground: str, least: float = 0.1, width: int = 8, height: int = 8, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, cy, cx, fg): of each cell's pixels the one whose luma (0..1) is furthest from the background's tells the
    foreground, the column `foreground` of that pixel; null where no pixel is `least` away. The first in order of rows wins a tie."""
    luma = "(0.299e0*{} + 0.587e0*{} + 0.114e0*{})/255e0".format
    gap = F.expr(f"abs({luma('r', 'g', 'b')} - {luma(*background)})")
    celled = pixels.withColumns({"cy": F.expr(f"y div {height}"), "cx": F.expr(f"x div {width}"), "__gap": gap})
    strong = F.when(F.col("__gap") >= F.lit(least), F.struct("__gap", -F.col("y"), -F.col("x")))
    return celled.groupBy(*keys, "cy", "cx").agg(F.max_by(foreground, strong).alias("fg"))


def best_pair(segments: DataFrame, keys: tuple[str, ...], palette: list[tuple[int, int, int]]) -> DataFrame:
    """For each segment the pair (i, j), i <= j, of colours with the least sum of squared distances, each pixel taking
    the nearer of the two; the first pair on ties. Pairs are a constant array: one shuffle, of summed arrays."""
    n = len(palette)
    d = [F.expr(f"(r-{r})*(r-{r}) + (g-{g})*(g-{g}) + (b-{b})*(b-{b})") for r, g, b in palette]
    flat = [(i, j) for i in range(n) for j in range(i, n)]
    sums = segments.groupBy(*keys).agg(*[F.sum(F.least(d[i], d[j]) if i != j else d[i]).alias(f"__s{i}_{j}") for i, j in flat])
    best = F.array_min(F.array(*[F.struct(F.col(f"__s{i}_{j}").alias("err"), F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i, j in flat]))
    return sums.withColumn("__b", best).select(*keys, "__b.i", "__b.j", "__b.err")


def byte_sum(bytes_col: str, modulus: int = 65536) -> Column:
    """The sum of the bytes of a hex string, by pairs of digits."""
    pairs = F.sequence(F.lit(1), F.expr(f"length({bytes_col}) - 1"), F.lit(2))
    return F.pmod(F.aggregate(pairs, F.lit(0).cast("long"), lambda total, k: total + F.conv(F.substring(F.col(bytes_col), k, F.lit(2)), 16, 10).cast("long")), F.lit(modulus))


def _words(bytes_col: str) -> Column:
    """The big-endian 32-bit words of a hex string."""
    places = F.sequence(F.lit(1), F.expr(f"length({bytes_col}) - 7"), F.lit(8))
    return F.transform(places, lambda k: F.conv(F.substring(F.col(bytes_col), k, F.lit(8)), 16, 10).cast("long"))


def block_checksum(bytes_col: str) -> Column:
    """What makes the 32-bit words of a block add up to 0, wrapping."""
    return F.pmod(-F.aggregate(_words(bytes_col), F.lit(0).cast("long"), lambda total, w: total + w), F.lit(1 << 32))


def boot_checksum(bytes_col: str) -> Column:
    """The complement of the sum of 32-bit words in which each carry is added back."""
    top = F.lit(1 << 32)
    added = F.aggregate(_words(bytes_col), F.lit(0).cast("long"), lambda total, w: F.when(total + w >= top, total + w - top + 1).otherwise(total + w))
    return F.lit((1 << 32) - 1) - added


def name_hash(name: Column, buckets: int = 72) -> Column:
    """The hash of a directory entry: length, then times 13 plus each upper-cased character, kept to 11 bits."""
    codes = F.transform(F.split(F.upper(name), ""), lambda c: F.ascii(c).cast("long"))
    return F.pmod(F.aggregate(codes, F.length(name).cast("long"), lambda h, c: (h * 13 + c).bitwiseAND(F.lit(0x7FF).cast("long"))), F.lit(buckets))
