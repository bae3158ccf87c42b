"""Kernels that carry state from pixel to pixel: error diffusion, hold-and-modify, scanline palettes, median cut.

They run as grouped functions, one image (or one row, where rows are independent) at a time; parallel over images.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.palettes import Colour

# Fixed values: (dx, dy, weight) and the divisor of each kernel.
DIFFUSION: dict[str, tuple[tuple[tuple[int, int, int], ...], int]] = {
    "floyd_steinberg": (((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)), 16),
    "atkinson": (((1, 0, 1), (2, 0, 1), (-1, 1, 1), (0, 1, 1), (1, 1, 1), (0, 2, 1)), 8),
    "jarvis_judice_ninke": (((1, 0, 7), (2, 0, 5), (-2, 1, 3), (-1, 1, 5), (0, 1, 7), (1, 1, 5), (2, 1, 3), (-2, 2, 1), (-1, 2, 3), (0, 2, 5), (1, 2, 3), (2, 2, 1)), 48),
    "stucki": (((1, 0, 8), (2, 0, 4), (-2, 1, 2), (-1, 1, 4), (0, 1, 8), (1, 1, 4), (2, 1, 2), (-2, 2, 1), (-1, 2, 2), (0, 2, 4), (1, 2, 2), (2, 2, 1)), 42),
    "burkes": (((1, 0, 8), (2, 0, 4), (-2, 1, 2), (-1, 1, 4), (0, 1, 8), (1, 1, 4), (2, 1, 2)), 32),
}


def _image(rows: pd.DataFrame) -> np.ndarray:
    """Rows of one image as an array of height, width and three channels."""
    out = np.zeros((int(rows["y"].max()) + 1, int(rows["x"].max()) + 1, 3))
    out[rows["y"], rows["x"]] = rows[["r", "g", "b"]].to_numpy(float)
    return out


def _wavefront(work: np.ndarray, tables: np.ndarray, slots: np.ndarray, kernel: str, amount: float, whole: bool, lines: int | None = None) -> np.ndarray:
    """Indices of an image with its error diffused; work is spent. Of its lines only the first `lines` are done, if that is
    given; the others take their errors.

    Pixels whose errors do not meet are done at once, along slanted lines: line t holds the pixels with x + slant * y = t.
    The slant is such that each pixel still gets its errors in the order of a scan by rows, so the sums are the same.
    """
    taps, total = DIFFUSION[kernel]
    bottom, width, _ = work.shape
    height = bottom if lines is None else lines
    slant = max(dx for dx, dy, _ in taps if not dy) - min(dx for dx, _, _ in taps) + 1
    ordered = sorted(taps, key=lambda tap: (-tap[1], -tap[0]))
    same = np.append(slots[1:] == slots[:-1], False)
    one = len(tables) == 1
    # Lines one after the other, with room around them for errors that leave the image: a slanted line is then every step-th place.
    left, right, below = -min(dx for dx, _, _ in taps), max(dx for dx, _, _ in taps), max(dy for _, dy, _ in taps)
    wide = max(left + width + right, slant + 1)
    step = wide - slant
    room, told = np.zeros(((bottom + below) * wide, 3)), np.zeros(height * wide, np.int64)
    inner = room.reshape(-1, wide, 3)[:bottom, left : left + width]
    inner[:] = work
    for t in range(width + slant * (height - 1)):
        top = max(0, -(-(t - width + 1) // slant))
        n = min(height - 1, t // slant) + 1 - top
        if n <= 0:
            continue
        first, reach = top * step + left + t, (n - 1) * step + 1
        want = np.minimum(np.maximum(room[first : first + reach : step], 0), 255)
        palette = tables[0] if one else tables[slots[top : top + n]]
        gap = palette - want[:, None]
        gap *= gap
        best = (gap[..., 0] + gap[..., 1] + gap[..., 2]).argmin(axis=1)
        told[first : first + reach : step] = best
        error = want - (palette[best] if one else palette[np.arange(n), best])
        if not whole:
            error = error * (amount / total)
        for dx, dy, weight in ordered:
            share = np.trunc(error * (weight / total * amount)) if whole else error * weight
            if dy and not one:
                share = np.where(same[top : top + n, None], share, 0)
            at = first + dy * wide + dx
            room[at : at + reach : step] += share
    work[:] = inner
    return told.reshape(height, wide)[:, left : left + width].copy()


def diffuse_array(image: np.ndarray, palette: np.ndarray, kernel: str = "floyd_steinberg", amount: float = 1.0, cell: tuple[int, int] | None = None, slots: np.ndarray | None = None, whole: bool = False) -> np.ndarray:
    """Indices of an image with its error diffused; sources are clamped before use, ties go to the lowest index.

    cell: cells of (width, height) keep their error inside. slots: the palette of each line, palette then being a table of
    palettes; where the next line has another one, error stays in its line. whole: pixels and each share of an error are cut
    to whole numbers.
    """
    height, width, _ = image.shape
    work = np.trunc(image) if whole else image.astype(float).copy()
    out = np.zeros((height, width), np.int64)
    tables, lines = (palette[None], np.zeros(height, np.int64)) if slots is None else (palette, np.asarray(slots))
    cw, ch = cell or (max(width, 1), max(height, 1))
    for top in range(0, height, ch):
        for left in range(0, width, cw):
            own = (slice(top, top + ch), slice(left, left + cw))
            out[own] = _wavefront(work[own], tables, lines[top : top + ch], kernel, amount, whole)
    return out


def _grid(keys: pd.DataFrame, columns: list[str], values: np.ndarray) -> pd.DataFrame:
    height, width = values.shape
    y, x = np.divmod(np.arange(height * width), width)
    return pd.DataFrame({**{c: keys[c].iloc[0] for c in columns}, "y": y, "x": x, "idx": values.reshape(-1)})


def diffuse(pixels: DataFrame, palette: list[Colour], kernel: str = "floyd_steinberg", amount: float = 1.0, keys: tuple[str, ...] = ("image_id",), cell: tuple[int, int] | None = None, whole: bool = False) -> DataFrame:
    """(keys, y, x, idx) of every image."""

    def work(rows: pd.DataFrame, colours: np.ndarray) -> pd.DataFrame:
        return _grid(rows, list(keys), diffuse_array(_image(rows), colours, kernel, amount, cell, whole=whole))

    schema = ", ".join(f"{c} {dict(pixels.dtypes)[c]}" for c in keys)
    return pixels.groupBy(*keys).applyInPandas(partial(work, colours=np.array(palette, float)), f"{schema}, y long, x long, idx long")


def _bands(batches: Iterator[pa.RecordBatch], keys: int, band: int) -> Iterator[tuple[list[pa.Array], int, np.ndarray]]:
    """(key, number, lines) of every band of every image in order, from rows (keys, band, width, height, cells) that come so, an
    image's own size before its bands, as band -1. Where there are no pixels, lines are black, as in _image()."""
    key, after, width, height = [], 0, 0, 0

    def shown(number: int, cells: np.ndarray) -> tuple[list[pa.Array], int, np.ndarray]:
        lines = np.zeros((min(band, height - number * band), width, 3))
        lines[: cells.shape[0], : cells.shape[1]] = cells
        return key, number, lines

    blank = lambda upto: (shown(number, np.zeros((0, 0, 3))) for number in range(after, upto))
    for batch in batches:
        for k, (number, wide, tall, cells) in enumerate(zip(*(c.to_pylist() for c in batch.columns[keys:]), strict=True)):
            if number < 0:
                yield from blank(-(-height // band))
                key, after, width, height = [c.slice(k, 1) for c in batch.columns[:keys]], 0, wide, tall
                continue
            yield from blank(number)
            yield shown(number, np.frombuffer(cells).reshape(tall, wide, 3))
            after = number + 1
    yield from blank(-(-height // band))


def _chained(batches: Iterator[pa.RecordBatch], names: list[str], band: int, palette: np.ndarray, kernel: str, amount: float, whole: bool) -> Iterator[pa.RecordBatch]:
    """The indices of each band that _bands() tells. A band waits for the lines below it that take its errors; these, as they
    are then, are all that goes on to the next one."""
    reach, held = max(dy for _, dy, _ in DIFFUSION[kernel][0]), None
    for key, number, lines in chain(_bands(batches, len(names), band), [([], 0, np.zeros((0, 0, 3)))]):
        lines = np.trunc(lines) if whole else lines
        if held:
            own, place, above = held
            work = np.concatenate([above, lines[:reach]]) if number else above
            told = _wavefront(work, palette[None], np.zeros(len(work), np.int64), kernel, amount, whole, len(above))
            lines = np.concatenate([work[len(above) :], lines[reach:]]) if number else lines
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([v]) for v in (place, told.shape[1], told.astype(np.int32).tobytes()))], names=[*names, "__band", "__w", "told"])
        held = key, number, lines


def _spread(batches: Iterator[pa.RecordBatch], names: list[str], band: int) -> Iterator[pa.RecordBatch]:
    """The pixels of what _chained() tells, a batch a band."""
    for batch in batches:
        for k, (number, width, told) in enumerate(zip(*(c.to_pylist() for c in batch.columns[len(names) :]), strict=True)):
            idx = np.frombuffer(told, np.int32).astype(np.int64)
            y, x = np.divmod(np.arange(len(idx)), width)
            own = pa.array(np.full(len(idx), k))
            yield pa.RecordBatch.from_arrays([*(c.take(own) for c in batch.columns[: len(names)]), *(pa.array(v) for v in (y + number * band, x, idx))], names=[*names, "y", "x", "idx"])


def diffuse_bands(pixels: DataFrame, palette: list[Colour], kernel: str = "floyd_steinberg", amount: float = 1.0, keys: tuple[str, ...] = ("image_id",), band: int = 64, whole: bool = False) -> DataFrame:
    """(keys, y, x, idx) of every image, as diffuse() gives it, with no group larger than a band of lines.

    Pixels become bands and indices become pixels side by side. Between the two is one fold over an image's bands, from top to
    bottom, that holds a band and the lines below it that take its errors; images are done side by side. Sums are added up in
    the same order as in one scan, so they are the same to the last bit.
    """
    if band < max(dy for _, dy, _ in DIFFUSION[kernel][0]):
        raise ValueError("errors reach beyond the next band")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["__band"].iloc[0])
        cells = _image(rows.assign(y=rows["y"] - number * band))
        return rows[[*keys, "__band"]].iloc[:1].assign(__w=cells.shape[1], __h=cells.shape[0], cells=[cells.tobytes()])

    types = dict(pixels.dtypes)
    own = "".join(f"`{c}` {types[c]}, " for c in keys)
    placed = pixels.select(*keys, "y", "x", "r", "g", "b", F.expr(f"cast(y div {band} as bigint)").alias("__band"))
    packed = placed.groupBy(*keys, "__band").applyInPandas(pack, f"{own}__band long, __w long, __h long, cells binary")
    size = [(F.max(c) + 1).cast("long").alias(n) for c, n in (("x", "__w"), ("y", "__h"))]
    sizes = pixels.groupBy(*keys).agg(*size).where("__w is not null").select(*keys, F.lit(-1).cast("long").alias("__band"), "__w", "__h", F.lit(None).cast("binary").alias("cells"))
    dealt = packed.unionByName(sizes)
    ordered = (dealt.repartition(*keys) if keys else dealt.repartition(1)).sortWithinPartitions(*keys, "__band")
    told = ordered.mapInArrow(partial(_chained, names=list(keys), band=band, palette=np.array(palette, float), kernel=kernel, amount=amount, whole=whole), f"{own}__band long, __w long, told binary")
    return told.repartition(*keys, "__band").mapInArrow(partial(_spread, names=list(keys), band=band), f"{own}y long, x long, idx long")


def diffuse_lines(pixels: DataFrame, palettes: list[list[Colour]], slots: DataFrame, kernel: str = "floyd_steinberg", amount: float = 1.0, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, y, x, idx) of images whose lines have palettes of their own: slots(keys, y, slot) is joined to the lines."""

    def work(rows: pd.DataFrame, tables: np.ndarray) -> pd.DataFrame:
        lines = rows.drop_duplicates("y").sort_values("y")["slot"].to_numpy()
        return _grid(rows, list(keys), diffuse_array(_image(rows), tables, kernel, amount, slots=lines))

    schema = ", ".join(f"{c} {dict(pixels.dtypes)[c]}" for c in keys)
    told = pixels.join(slots.select(*keys, "y", "slot"), [*keys, "y"])
    return told.groupBy(*keys).applyInPandas(partial(work, tables=np.array(palettes, float)), f"{schema}, y long, x long, idx long")


def ham_rows(lines: np.ndarray, palette: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and colours of lines of equal length, all lines at once: a palette entry, or the colour before with one channel
    set to its top bits.

    The code is 2 control bits and `bits` data bits: 0 palette, 1 blue, 2 red, 3 green. A line begins at palette entry 0.
    Ties go to the palette, then red, green, blue.
    """
    n, width, _ = lines.shape
    step, rows = 255 / ((1 << bits) - 1), np.arange(n)
    before = np.repeat(palette[:1].astype(float), n, axis=0)
    codes, colours = np.zeros((n, width), np.int64), np.zeros((n, width, 3))
    for x in range(width):
        want = lines[:, x]
        gap = ((palette[None] - want[:, None]) ** 2).sum(axis=2)
        code = gap.argmin(axis=1)
        error, made = gap[rows, code], palette[code].astype(float)
        for channel, control in ((0, 2), (1, 3), (2, 1)):
            level = np.clip(np.floor(want[:, channel] / step + 0.5), 0, (1 << bits) - 1).astype(np.int64)
            tried = before.copy()
            tried[:, channel] = level * step
            missed = ((tried - want) ** 2).sum(axis=1)
            better = missed < error
            error = np.where(better, missed, error)
            code = np.where(better, control << bits | level, code)
            made = np.where(better[:, None], tried, made)
        before = made
        codes[:, x], colours[:, x] = code, made
    return codes, colours


def ham_row(row: np.ndarray, palette: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """ham_rows of one line."""
    codes, colours = ham_rows(np.asarray(row, float)[None], palette, bits)
    return codes[0], colours[0]


def hold_and_modify(pixels: DataFrame, palette: list[Colour], bits: int = 4, keys: tuple[str, ...] = ("image_id",), band: int = 256) -> DataFrame:
    """(keys, y, x, code). Rows are independent: bands of `band` rows are the unit of parallelism, and all rows of a band go
    from left to right together. Rows that are shorter than others end where they end."""
    colours = np.array(palette, float)

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        at = rows.assign(row=rows["y"] - rows["y"].min()).sort_values(["row", "x"])
        place = at.groupby("row").cumcount().to_numpy()
        lines = np.zeros((int(at["row"].max()) + 1, int(place.max()) + 1, 3))
        lines[at["row"], place] = at[["r", "g", "b"]].to_numpy(float)
        codes, _ = ham_rows(lines, colours, bits)
        return at[[*keys, "y", "x"]].assign(code=codes[at["row"], place])

    types = dict(pixels.dtypes)
    return pixels.withColumn("__band", F.expr(f"y div {band}")).groupBy(*keys, "__band").applyInPandas(work, ", ".join(f"{c} {types[c]}" for c in (*keys, "y", "x")) + ", code long")


def median_cut(points: np.ndarray, colours: int, order: str = "widest") -> np.ndarray:
    """Boxes split at the middle of their longest axis until there are `colours`; the mean of each box.

    widest: the box of the largest range is next; fifo: boxes wait in a queue. Points are ordered by the axis and then by
    all channels, so that equal values do not depend on their place.
    """
    boxes = [points]
    while len(boxes) < colours:
        spans = [np.ptp(b, axis=0) if len(b) > 1 else np.zeros(3) for b in boxes]
        able = [k for k, b in enumerate(boxes) if len(b) > 1]
        if not able:
            break
        pick = able[0] if order == "fifo" else max(able, key=lambda k: (spans[k].max(), -k))
        box, axis = boxes.pop(pick), int(np.argmax(spans[pick]))
        rest = [c for c in range(3) if c != axis]
        box = box[np.lexsort((box[:, rest[1]], box[:, rest[0]], box[:, axis]))]
        halves = [box[: len(box) // 2], box[len(box) // 2 :]]
        boxes = boxes + halves if order == "fifo" else boxes[:pick] + halves + boxes[pick:]
    return np.array([b.mean(axis=0) for b in boxes])


def adaptive_palette(pixels: DataFrame, colours: int, order: str = "widest", keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, idx, r, g, b) of each image."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        made = median_cut(rows[["r", "g", "b"]].to_numpy(float), colours, order)
        return pd.DataFrame({**{c: rows[c].iloc[0] for c in keys}, "idx": range(len(made)), "r": made[:, 0], "g": made[:, 1], "b": made[:, 2]})

    types = dict(pixels.dtypes)
    return pixels.groupBy(*keys).applyInPandas(work, ", ".join(f"{c} {types[c]}" for c in keys) + ", idx long, r double, g double, b double")


def line_palettes(pixels: DataFrame, colours: int, tolerance: float, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, y, owner, error): the line whose palette each line uses. A palette is kept while the mean distance of a
    line's pixels to it is at most `tolerance`; 0 never keeps one."""

    def fit(line: np.ndarray, palette: np.ndarray) -> float:
        return float(np.sqrt(((line[:, None] - palette[None]) ** 2).sum(axis=2).min(axis=1)).mean())

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        image, out, palette, owner = _image(rows), [], None, 0
        for y, line in enumerate(image):
            error = fit(line, palette) if palette is not None else 0.0
            if palette is None or tolerance <= 0 or error > tolerance:
                palette, owner = median_cut(line, colours, "fifo"), y
                error = fit(line, palette)
            out.append((y, owner, error))
        return pd.DataFrame({**{c: rows[c].iloc[0] for c in keys}, "y": [o[0] for o in out], "owner": [o[1] for o in out], "error": [o[2] for o in out]})

    types = dict(pixels.dtypes)
    return pixels.groupBy(*keys).applyInPandas(work, ", ".join(f"{c} {types[c]}" for c in keys) + ", y long, owner long, error double")


def hold_fold(pixels: DataFrame, palette: list[Colour], keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, y, codes): four-bit hold-and-modify as a fold of built-in functions over each row's pixels.

    As ham_row with four bits, in integers: a level is worth 17.
    """
    line = F.sort_array(F.collect_list(F.struct("x", "r", "g", "b")))
    entries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b")) for i, (r, g, b) in enumerate(palette)])
    first = F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip("rgb", palette[0], strict=True)], F.array().cast("array<bigint>").alias("codes"))

    def error(r, g, b, p):
        return ((r - p["r"]) * (r - p["r"]) + (g - p["g"]) * (g - p["g"]) + (b - p["b"]) * (b - p["b"])).cast("long")

    def made(err, order, code, r, g, b):
        return F.struct(err.alias("err"), F.lit(order).alias("order"), code.cast("long").alias("code"), r.cast("long").alias("r"), g.cast("long").alias("g"), b.cast("long").alias("b"))

    def step(state, p):
        nearest = F.array_min(F.transform(entries, lambda e: made(error(e["r"], e["g"], e["b"], p), 0, e["i"], e["r"], e["g"], e["b"])))
        level = lambda c: F.call_function("div", p[c] + 8, F.lit(17))
        tried = [nearest]
        for order, c, control in ((1, "r", 2), (2, "g", 3), (3, "b", 1)):
            rgb = [level(c) * 17 if k == c else state[k] for k in "rgb"]
            tried.append(made(error(*rgb, p), order, F.lit(16 * control) + level(c), *rgb))
        best = F.array_min(F.array(*tried))
        return F.transform(F.array(best), lambda w: F.struct(w["r"].alias("r"), w["g"].alias("g"), w["b"].alias("b"), F.concat(state["codes"], F.array(w["code"])).alias("codes")))[0]

    return pixels.groupBy(*keys, "y").agg(line.alias("line")).select(*keys, "y", F.aggregate("line", first, step)["codes"].alias("codes"))
