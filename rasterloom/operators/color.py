"""Projections over pixels: colour adjustment, quantisers, ordered dither, geometry, and nearest-colour matching.

Pixels carry x, y, r, g, b; every function is DataFrame in, DataFrame out, without a shuffle unless it says so.
Ties in a match go to the lowest palette index.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import METRICS, blue_shade, hue, lightness, luma, red_shade, saturation, whole_luma
from ..functions.palettes import Colour

CHANNELS = ("r", "g", "b")


def palette_array(palette: list[Colour]) -> Column:
    """A palette as a constant array of structs, in index order."""
    return F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(r).cast("long").alias("pr"), F.lit(g).cast("long").alias("pg"), F.lit(b).cast("long").alias("pb")) for i, (r, g, b) in enumerate(palette)])


def _cube_levels(palette: list[Colour]) -> list[list[tuple[int, int]]] | None:
    """For each channel its levels and what each adds to the index, if the palette is all their combinations, else None."""
    place = {c: i for i, c in reversed(list(enumerate(palette)))}
    base, levels = palette[0], []
    for k in range(3):
        along = [(v, place.get((*base[:k], v, *base[k + 1 :]))) for v in dict.fromkeys(c[k] for c in palette)]
        if any(i is None for _, i in along):
            return None
        levels.append(along)
    sums = all(place.get((r, g, b)) == i + j + k for r, i in levels[0] for g, j in levels[1] for b, k in levels[2])
    return levels if sums and len(place) == len(palette) == len(levels[0]) * len(levels[1]) * len(levels[2]) else None


#: What a metric needs of a pixel and of an entry alone.
FEATURES = {"h": hue, "s": saturation, "l": lightness, "u": blue_shade, "v": red_shade, "y": luma, "w": whole_luma}


def nearest(pixels: DataFrame, palette: list[Colour], metric: str = "euclid", out: str = "idx", memo: bool = False) -> DataFrame:
    """The index of the nearest palette entry for each pixel: an arg-min over constants, so no join and no shuffle.

    What the metric needs of a pixel alone is computed once a pixel, and of an entry once in all. In a palette that is a cube
    the nearest level of each channel makes the nearest entry. memo: match each distinct colour once and join it back, for
    large palettes and few colours (one shuffle of colours).
    """
    if memo:
        colours = nearest(pixels.select(*CHANNELS).distinct(), palette, metric, out)
        return pixels.join(colours, list(CHANNELS))
    levels = _cube_levels(palette) if metric == "euclid" and len(palette) > 8 else None
    if levels:
        best = [F.least(*[F.struct(((F.col(c) - v) * (F.col(c) - v)).alias("d"), F.lit(i).cast("long").alias("i")) for v, i in own])["i"] if len(own) > 1 else F.lit(0).cast("long") for c, own in zip(CHANNELS, levels, strict=True)]
        return pixels.withColumn(out, best[0] + best[1] + best[2])
    text, made = METRICS[metric], {}
    for name, feature in FEATURES.items():
        if feature("r", "g", "b") in text:
            made[f"__{name}"] = F.expr(feature("r", "g", "b"))
            text = text.replace(feature("r", "g", "b"), f"__{name}").replace(feature("pr", "pg", "pb"), f"p{name}")
    if metric != "euclid":
        # In doubles, where whole numbers stay exact: checks of whole ones for overflow would make the code too long to be compiled.
        made |= {f"__{c}": F.col(c).cast("double") for c in CHANNELS}
        text = re.sub(r"\b[rgb]\b", lambda m: f"__{m[0]}", text)
    entries, kind = [], "L" if metric == "euclid" else "e0"
    for i, (r, g, b) in enumerate(palette):
        names = {"pr": f"{r}{kind}", "pg": f"{g}{kind}", "pb": f"{b}{kind}"} | {f"p{name}": "(" + FEATURES[name](f"{r}L", f"{g}L", f"{b}L") + ")" for name in FEATURES if f"__{name}" in made}
        entries.append((i, re.sub(r"\bp[rgbhsluvyw]\b", lambda m, n=names: n[m[0]], text)))
    if len(palette) <= UNROLLED:
        best = F.least(*[F.struct(F.expr(f"cast({d} as double)").alias("d"), F.lit(i).cast("long").alias("i")) for i, d in entries])["i"] if len(entries) > 1 else F.lit(0).cast("long")
        return pixels.withColumns(made).withColumn(out, best).drop(*made) if made else pixels.withColumn(out, best)
    fields = ["'i', {i}L", "'pr', {r}L", "'pg', {g}L", "'pb', {b}L"] + [f"'p{name}', {{p{name}}}" for name in FEATURES if f"__{name}" in made]
    table = "array(" + ", ".join("named_struct(" + ", ".join(fields).format(i=i, r=r, g=g, b=b, **{f"p{name}": f(f"{r}L", f"{g}L", f"{b}L") for name, f in FEATURES.items()}) + ")" for i, (r, g, b) in enumerate(palette)) + ")"
    told = re.sub(r"\b(p[rgbhsluvyw])\b", r"p.\1", text)
    best = F.expr(f"array_min(transform({table}, p -> named_struct('d', cast({told} as double), 'i', p.i))).i")
    return (pixels.withColumns(made) if made else pixels).withColumn(out, best).drop(*made)


#: Palettes of so many entries are matched by expressions of their own, others by one over an array.
UNROLLED = 32


def saturate(pixels: DataFrame, amount: float, clamp: bool = True) -> DataFrame:
    """Each channel moved from the luma by `amount`; 1 leaves the pixels alone, clamp included."""
    if amount == 1.0:
        return pixels
    grey = luma("r", "g", "b")
    moved = {c: F.expr(f"{grey} + ({c} - {grey}) * {amount!r}D") for c in CHANNELS}
    return pixels.withColumns({c: F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)) if clamp else v for c, v in moved.items()})


def gamma(pixels: DataFrame, value: float, inverse: bool = True, top: float = 255.0) -> DataFrame:
    """Channels of 0..top raised to 1/value, or to value if not inverse; 1 leaves the pixels alone."""
    if value == 1.0:
        return pixels
    power = 1.0 / value if inverse else value
    return pixels.withColumns({c: F.pow(F.col(c) / F.lit(top), F.lit(power)) * F.lit(top) for c in CHANNELS})


def unpremultiply(pixels: DataFrame) -> DataFrame:
    """Channels divided by alpha, where there is any; a as 0..255."""
    return pixels.withColumns({c: F.when(F.col("a") > 0, F.least(F.expr(f"{c} * 255 div a"), F.lit(255))).otherwise(F.col(c)) for c in CHANNELS})


def to_hsl(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({"h": F.expr(hue("r", "g", "b")), "s": F.expr(saturation("r", "g", "b")), "l": F.expr(lightness("r", "g", "b"))})


def solarize(pixels: DataFrame, threshold: int = 128) -> DataFrame:
    return pixels.withColumns({c: F.when(F.col(c) > threshold, 255 - F.col(c)).otherwise(F.col(c)) for c in CHANNELS})


#: Device grids: a channel as SQL text with {c} for it.
QUANTISERS = {
    "four_bit_round": "((({c} * 15 + 127) div 255) * 17)",
    "twelve_bit": "(least(({c} + 8) div 17, 15) * 17)",
    "nine_bit": "(({c} * 7 + 127) div 255)",
    "nine_bit_file": "({c} div 32)",
    "six_bit": "(({c} div 4) * 4)",
    "ham8": "({c} & 252)",
}


def quantise(pixels: DataFrame, grid: str) -> DataFrame:
    return pixels.withColumns({c: F.expr(QUANTISERS[grid].format(c=c)) for c in CHANNELS})


def byte_332(pixels: DataFrame, out: str = "code") -> DataFrame:
    return pixels.withColumn(out, F.expr("(r div 32) * 32 + (g div 32) * 4 + (b div 64)"))


def bayer(size: int) -> list[list[int]]:
    """The ordered matrix of a power-of-two size: four copies of the half-size one, times four, plus 0 2 / 3 1."""
    if size == 1:
        return [[0]]
    half, n = bayer(size // 2), size // 2
    return [[4 * half[y % n][x % n] + ((0, 2), (3, 1))[y // n][x // n] for x in range(size)] for y in range(size)]


def nested(inner: list[list[int]], offsets: tuple[int, int, int, int]) -> list[list[int]]:
    """A matrix of twice the size: four times the inner one, plus an offset for each quarter, row by row."""
    n = len(inner)
    return [[4 * inner[y % n][x % n] + offsets[2 * (y // n) + x // n] for x in range(2 * n)] for y in range(2 * n)]


def tiled_squares(inner: list[list[int]]) -> list[list[int]]:
    """A matrix of the squared size: the inner one over and over, times its number of cells, plus itself writ large."""
    n = len(inner)
    return [[inner[y % n][x % n] * n * n + inner[y // n][x // n] for x in range(n * n)] for y in range(n * n)]


#: The ordered matrices of 16 by 16 cells in use, by name.
MATRICES_16 = {"recursive": bayer(16), "nested": nested(bayer(8), (0, 128, 192, 64)), "squares": tiled_squares(bayer(4))}


def golden_matrix(size: int) -> list[list[float]]:
    """Noise without low frequencies, near enough: a linear hash of the place moved on by the golden ratio."""
    # The multipliers of x and y, and the fraction of the golden ratio.
    return [[(((x * 12345 + y * 67890) & 0xFFFF) / 65536 + 0.618033988749895) % 1.0 * size * size for x in range(size)] for y in range(size)]


def ordered_dither(pixels: DataFrame, size: int, strength: float = 64.0, matrix: list[list[float]] | None = None) -> DataFrame:
    """c + (m/n^2 - 0.5) * strength, clamped to 0..255; the matrix is a constant array."""
    cells = [v for row in (matrix or bayer(size)) for v in row]
    place = F.expr(f"cast((y % {size}) * {size} + (x % {size}) as int) + 1")
    shift = (F.element_at(F.array(*[F.lit(float(v)) for v in cells]), place) / F.lit(float(size * size)) - F.lit(0.5)) * F.lit(strength)
    return pixels.withColumn("__shift", shift).withColumns({c: F.least(F.greatest(F.col(c) + F.col("__shift"), F.lit(0.0)), F.lit(255.0)) for c in CHANNELS}).drop("__shift")


def noise_dither(pixels: DataFrame, strength: float = 64.0, seed: int = 0, keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """The same offset for all channels, uniform by a hash of the place: reruns agree."""
    shift = (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20)) - F.lit(0.5)) * F.lit(strength)
    return pixels.withColumn("__shift", shift).withColumns({c: F.least(F.greatest(F.col(c) + F.col("__shift"), F.lit(0.0)), F.lit(255.0)) for c in CHANNELS}).drop("__shift")


def flip(pixels: DataFrame, width: int | Column | None = None, height: int | Column | None = None) -> DataFrame:
    """Mirrored at the given width, or upside down at the given height."""
    out = pixels if width is None else pixels.withColumn("x", F.lit(width) - 1 - F.col("x"))
    return out if height is None else out.withColumn("y", F.lit(height) - 1 - F.col("y"))


def upscale(pixels: DataFrame, factor: int) -> DataFrame:
    steps = F.array(*[F.lit(k) for k in range(factor)])
    wide = pixels.withColumn("__dy", F.explode(steps)).withColumn("__dx", F.explode(steps))
    return wide.withColumns({"x": F.col("x") * factor + F.col("__dx"), "y": F.col("y") * factor + F.col("__dy")}).drop("__dx", "__dy")


def resize(pixels: DataFrame, width: int | str, height: int | str, to_width: int, to_height: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Area average into a smaller raster: one aggregation on the target place. Sizes are numbers or SQL text."""
    at = pixels.withColumns({"x": F.expr(f"x * {to_width} div {width}"), "y": F.expr(f"y * {to_height} div {height}")})
    return at.groupBy(*keys, "y", "x").agg(*[F.avg(c).alias(c) for c in CHANNELS])


def merge_pairs(pixels: DataFrame, rule: str = "average", keys: tuple[str, ...] = ()) -> DataFrame:
    """Two neighbours in a row become one pixel: average, the luma-weighted mean, or the brighter (the left one on a tie)."""
    pairs = pixels.withColumns({"__x": F.col("x"), "x": F.expr("x div 2"), "__l": F.expr("299*r + 587*g + 114*b")}).groupBy(*keys, "y", "x")
    if rule == "average":
        return pairs.agg(*[F.expr(f"sum({c}) div count(*)").alias(c) for c in CHANNELS])
    if rule == "weighted":
        return pairs.agg(*[F.expr(f"case when sum(__l) = 0 then avg({c}) else sum({c} * __l) / sum(__l) end").cast("double").alias(c) for c in CHANNELS])
    top = pairs.agg(F.max_by(F.struct(*CHANNELS), F.struct("__l", -F.col("__x"))).alias("p"))
    return top.select(*keys, "y", "x", "p.r", "p.g", "p.b")


#: Palettes by rule: how many entries, and each channel as SQL text in the index i.
PALETTE_RULES = {
    "ega64": (64, *(f"170 * (i div {1 << k} % 2) + 85 * (i div {1 << (k + 3)} % 2)" for k in (2, 1, 0))),
    "rgb332": (256, "(i div 32) * 36", "(i div 4 % 8) * 36", "(i % 4) * 85"),
    "gime64": (64, "(i div 16) * 85", "(i div 4 % 4) * 85", "(i % 4) * 85"),
    "v9938": (512, *(f"cast(floor(255 * (i div {8**k} % 8) / 7e0 + 0.5e0) as bigint)" for k in (2, 1, 0))),
    "ocs4096": (4096, *(f"(i div {16**k} % 16) * 17" for k in (2, 1, 0))),
}


def palette_rows(spark: SparkSession, name: str) -> DataFrame:
    """(idx, r, g, b) of a palette that a rule gives."""
    n, r, g, b = PALETTE_RULES[name]
    return spark.range(n).withColumnRenamed("id", "i").select(F.col("i").alias("idx"), F.expr(r).alias("r"), F.expr(g).alias("g"), F.expr(b).alias("b"))


def palette_uses(pixels: DataFrame, palette: DataFrame, bits: int) -> DataFrame:
    """palette(idx, r, g, b) with n: how many pixels have an entry's colour, both cut to the top `bits` of each channel."""
    top = lambda c: F.expr(f"{c} div {1 << (8 - bits)}").alias(f"__{c}")
    counts = pixels.select(*[top(c) for c in CHANNELS]).groupBy(*[f"__{c}" for c in CHANNELS]).agg(F.count("*").alias("n"))
    return palette.select("*", *[top(c) for c in CHANNELS]).join(counts, [f"__{c}" for c in CHANNELS], "left").withColumn("n", F.coalesce("n", F.lit(0))).drop(*[f"__{c}" for c in CHANNELS])


def lookup(pixels: DataFrame, palette: list[Colour], out: str = "idx") -> DataFrame:
    """The index of each pixel's very colour, the first of equal entries; null for a colour that is not in the palette. A
    palette is at most some thousand rows, so it is broadcast."""
    rows = pixels.sparkSession.createDataFrame([(*map(int, c), i) for c, i in {c: i for i, c in reversed(list(enumerate(map(tuple, palette))))}.items()], f"r long, g long, b long, {out} long")
    return pixels.join(F.broadcast(rows), list(CHANNELS), "left")


def render(indices: DataFrame, palette: list[Colour], idx: str = "idx") -> DataFrame:
    """Indices back to colours."""
    return indices.withColumn("__p", F.element_at(palette_array(palette), F.col(idx).cast("int") + 1)).withColumns({"r": F.col("__p.pr"), "g": F.col("__p.pg"), "b": F.col("__p.pb")}).drop("__p")


def hex_colour() -> Column:
    return F.format_string("#%02X%02X%02X", "r", "g", "b")
