"""Machines: from an image's pixels to its native file, by a table of modes.

convert() is one grouped function per image: resize by area, match (with error diffusion if asked), restrict to the cell's
colours where the mode has cells, pack and encode. A failing image gets an error, and no other image is touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf

from ..functions import encoders as enc
from ..functions.palettes import BBC, C64, CGA, COCO_SET, COCO_TWO, IIGS, PALETTES, TMS9918, VIC20, ZX, Colour, atari_register
from .sequential import diffuse_array, median_cut


@dataclass(frozen=True)
class Mode:
    """palette: fixed colours; choice: colours of which the image's most frequent are taken; neither: median cut. palettes:
    how many strips of lines have a palette of their own."""

    machine: str
    name: str
    width: int
    height: int
    palette: tuple[Colour, ...] | None
    colours: int
    extension: str
    encode: Callable[[np.ndarray, list[Colour]], bytes]
    cell: tuple[int, int] | None = None
    cell_colours: int = 2
    choice: tuple[Colour, ...] | None = None
    palettes: int = 1


def cell_restricted(grid: np.ndarray, colours: np.ndarray, image: np.ndarray, cell: tuple[int, int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices limited to each cell's n most frequent (lowest first on a tie), and those by cell: rows, columns, n."""
    w, h = cell
    rows, columns = grid.shape[0] // h, grid.shape[1] // w
    out, table = grid.copy(), np.zeros((rows, columns, n), np.int64)
    for cy in range(rows):
        for cx in range(columns):
            own = (slice(cy * h, cy * h + h), slice(cx * w, cx * w + w))
            counts = np.bincount(grid[own].reshape(-1), minlength=len(colours))
            best = sorted(range(len(colours)), key=lambda i: (-counts[i], i))[:n]
            best = [i for i in best if counts[i]] or [0]
            best += [best[0]] * (n - len(best))
            gap = ((image[own][:, :, None] - colours[best][None, None]) ** 2).sum(axis=3)
            out[own] = np.array(best)[gap.argmin(axis=2)]
            table[cy, cx] = best
    return out, table


def _pairs(grid: np.ndarray, table: np.ndarray, cell: tuple[int, int]) -> np.ndarray:
    """Which of its cell's colours each pixel has."""
    spread = np.repeat(np.repeat(table, cell[1], axis=0), cell[0], axis=1)
    return (spread == grid[..., None]).argmax(axis=2)


def _zx(grid: np.ndarray, palette: list[Colour], table: np.ndarray) -> bytes:
    bits = _pairs(grid, table, (8, 8)) == 0
    ink, paper = table[..., 0], table[..., 1]
    return enc.spectrum_screen(bits, (ink >> 1) | (paper >> 1) << 3 | ((ink | paper) & 1) << 6)


def _c64(grid: np.ndarray, palette: list[Colour], table: np.ndarray) -> bytes:
    return enc.c64_hires(_pairs(grid, table, (8, 8)) == 0, table[..., 0] << 4 | table[..., 1])


def _koala(grid: np.ndarray, palette: list[Colour], table: np.ndarray) -> bytes:
    """The background is the commonest colour; each cell has three more."""
    background = int(np.bincount(grid.reshape(-1), minlength=16).argmax())
    spread = np.repeat(np.repeat(table, 8, axis=0), 4, axis=1)
    pairs = np.where(grid == background, 0, (spread == grid[..., None]).argmax(axis=2) + 1)
    return enc.c64_multicolour(pairs, table[..., 0] << 4 | table[..., 1], table[..., 2], background)


def _screen2(grid: np.ndarray, palette: list[Colour], table: np.ndarray) -> bytes:
    """13,063 bytes: patterns, colours of each line of a character, and the name table."""
    bits = _pairs(grid, table, (8, 1)) == 0
    pattern = enc.cells(np.packbits(bits.astype(np.uint8), axis=1))
    colour = enc.cells((table[..., 0] << 4 | table[..., 1]).astype(np.uint8))
    names = bytes(range(256)) * 3
    body = pattern + colour + names
    return enc.bsave(body, 0x37FF)


def _register(colour: Colour) -> int:
    table = PALETTES["atari128"]
    return atari_register(table.index(tuple(colour))) if tuple(colour) in table else 0


def frequent(image: np.ndarray, table: np.ndarray, n: int) -> list[Colour]:
    """The n entries of a table that are nearest to most pixels, the most frequent first, padded with black."""
    pixels, counts = np.unique(np.clip(image, 0, 255).astype(int).reshape(-1, 3), axis=0, return_counts=True)
    total = np.zeros(len(table), int)
    for at in range(0, len(pixels), 4096):
        near = ((pixels[at : at + 4096, None] - table[None]) ** 2).sum(axis=2).argmin(axis=1)
        np.add.at(total, near, counts[at : at + 4096])
    best = [i for i in np.argsort(-total, kind="stable").tolist() if total[i]][:n]
    return [tuple(int(v) for v in table[i]) for i in best] + [(0, 0, 0)] * (n - len(best))


def _grid_only(encode: Callable[[np.ndarray, list[Colour]], bytes]) -> Callable[..., bytes]:
    return lambda grid, palette, table: encode(grid, palette)


def _half_blocks(grid: np.ndarray, palette: list[Colour]) -> bytes:
    """A text screen of upper half blocks, two pixels a cell; backgrounds have eight colours."""
    return enc.ansi([[(0xDF, int(top), int(low) & 7) for top, low in zip(grid[y], grid[y + 1], strict=True)] for y in range(0, len(grid), 2)], "IMAGE", date(1990, 1, 1))


MODES: dict[str, Mode] = {
    f"{m.machine}_{m.name}": m
    for m in (
        Mode("zx", "hires", 256, 192, tuple(ZX), 16, "scr", _zx, (8, 8), 2),
        Mode("c64", "hires", 320, 200, tuple(C64), 16, "art", _c64, (8, 8), 2),
        Mode("c64", "multicolour", 160, 200, tuple(C64), 16, "kla", _koala, (4, 8), 3),
        Mode("msx", "screen2", 256, 192, tuple(TMS9918), 16, "sc2", _screen2, (8, 1), 2),
        Mode("msx", "screen8", 256, 212, tuple(PALETTES["rgb332"]), 256, "sc8", _grid_only(lambda g, p: enc.msx_screen8(g))),
        Mode("pc", "cga", 320, 200, tuple(PALETTES["cga4_1_high"]), 4, "pcx", _grid_only(lambda g, p: enc.pcx(g, p, 2))),
        Mode("pc", "ega", 320, 200, tuple(CGA), 16, "pcx", _grid_only(lambda g, p: enc.pcx(g, p, 4))),
        Mode("pc", "vga", 320, 200, None, 256, "pcx", _grid_only(lambda g, p: enc.pcx(g, p, 8))),
        Mode("amiga500", "standard", 320, 256, None, 32, "iff", _grid_only(lambda g, p: enc.ilbm(g, p, 5))),
        Mode("amiga1200", "standard", 320, 256, None, 256, "iff", _grid_only(lambda g, p: enc.ilbm(g, p, 8))),
        Mode("atarist", "low", 320, 200, None, 16, "pi1", _grid_only(lambda g, p: enc.degas(g, p, 0))),
        Mode("atarist", "medium", 640, 200, None, 4, "pi2", _grid_only(lambda g, p: enc.degas(g, p, 1))),
        Mode("atarist", "high", 640, 400, ((255, 255, 255), (0, 0, 0)), 2, "pi3", _grid_only(lambda g, p: enc.degas(g, p, 2))),
        Mode("iigs", "256", 320, 200, None, 16, "shr", _grid_only(lambda g, p: enc.super_hires(g, p, [16 * y // 200 for y in range(200)])), palettes=16),
        Mode("iigs", "brooks", 320, 200, None, 16, "3200", _grid_only(enc.brooks), palettes=200),
        Mode("pc", "ansi", 80, 50, tuple(CGA), 16, "ans", _grid_only(_half_blocks)),
        Mode("iigs", "320", 320, 200, tuple(IIGS), 16, "shr", _grid_only(lambda g, p: enc.super_hires(g, [p], [0] * 200))),
        *(Mode("bbc", f"mode{n}", w, 256, None, k, "bbc", _grid_only(lambda g, p, d=d, n=n: enc.bbc_file(g, p, d, n)), choice=tuple(BBC)) for n, w, k, d in ((0, 640, 2, 1), (1, 320, 4, 2), (2, 160, 8, 4), (4, 320, 2, 1), (5, 160, 4, 2))),
        Mode("cpc", "mode1", 320, 200, tuple(PALETTES["cpc"][i] for i in (0, 26, 6, 2)), 4, "scr", _grid_only(lambda g, p: enc.cpc_screen(enc.cpc_mode1_byte(g.reshape(200, 80, 4))))),
        Mode("cpc", "mode0", 160, 200, tuple(PALETTES["cpc"][:16]), 16, "scr", _grid_only(lambda g, p: enc.cpc_screen(enc.cpc_mode0_byte(g[:, 0::2], g[:, 1::2])))),
        Mode("coco", "coco3", 320, 200, tuple(PALETTES["coco3"]), 16, "cm3", _grid_only(lambda g, p: enc.pack_rows(g, 4).tobytes())),
        Mode("coco", "coco3_4", 640, 200, tuple(PALETTES["coco3"][:4]), 4, "cm3", _grid_only(lambda g, p: enc.pack_rows(g, 2).tobytes())),
        *(Mode("coco", f"pmode{n}", w, h, tuple(COCO_SET if k == 4 else COCO_TWO), k, "bin", _grid_only(lambda g, p, d=d: enc.pack_rows(g, d).tobytes())) for n, w, h, k, d in ((1, 128, 96, 4, 2), (2, 128, 192, 2, 1), (3, 128, 192, 4, 2), (4, 256, 192, 2, 1))),
        *(Mode("atari800", f"gr{n}", w, 192, None, k, f"gr{n}", _grid_only(lambda g, p, d=d: enc.atari_file(g, [_register(c) for c in p], d)), choice=tuple(PALETTES["atari128"])) for n, w, k, d in ((8, 320, 2, 1), (10, 80, 9, 4), (15, 160, 4, 2))),
        Mode("atari800", "gr9", 80, 192, tuple((lum * 255 // 15,) * 3 for lum in range(16)), 16, "gr9", _grid_only(lambda g, p: enc.atari_file(g, [lum // 2 << 1 for lum in range(16)], 4))),
        Mode("atari800", "gr11", 80, 192, tuple(PALETTES["atari128"][8 * hue + 4] for hue in range(16)), 16, "gr11", _grid_only(lambda g, p: enc.atari_file(g, [hue << 4 | 8 for hue in range(16)], 4))),
        Mode("msx", "screen5", 256, 212, None, 16, "sc5", _grid_only(enc.msx_screen5), choice=tuple(PALETTES["v9938"])),
        Mode("vic20", "preview", 176, 184, tuple(VIC20), 16, "bmp", _grid_only(lambda g, p: enc.bmp24(np.array(p)[g]))),
    )
}


def resize_array(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area average where the image is larger, the nearest pixel where it is smaller."""
    h, w, _ = image.shape
    ys, xs = (np.arange(height + 1) * h / height).astype(int), (np.arange(width + 1) * w / width).astype(int)
    total = np.zeros((h + 1, w + 1, 3))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    top, left = np.minimum(ys[:-1], h - 1), np.minimum(xs[:-1], w - 1)
    bottom, right = np.maximum(ys[1:], top + 1), np.maximum(xs[1:], left + 1)
    area = (bottom - top)[:, None] * (right - left)[None]
    return (total[np.ix_(bottom, right)] - total[np.ix_(top, right)] - total[np.ix_(bottom, left)] + total[np.ix_(top, left)]) / area[..., None]


def _in_strips(fitted: np.ndarray, mode: Mode, dither: str | None) -> tuple[np.ndarray, list[Colour], bytes]:
    """Lines with the palette of their strip; error does not leave a strip."""
    slots = np.arange(mode.height) * mode.palettes // mode.height
    tables = np.array([[np.round(c) for c in median_cut(fitted[slots == k].reshape(-1, 3), mode.colours)] for k in range(mode.palettes)])
    if dither:
        grid = diffuse_array(fitted, tables, dither, slots=slots)
    else:
        grid = np.stack([((row[:, None] - tables[slots[y]][None]) ** 2).sum(axis=2).argmin(axis=1) for y, row in enumerate(fitted)])
    palettes = [[tuple(int(v) for v in c) for c in table] for table in tables]
    return grid, [c for p in palettes for c in p], mode.encode(grid, palettes, None)


def convert_array(image: np.ndarray, mode: Mode, dither: str | None = None) -> tuple[np.ndarray, list[Colour], bytes]:
    if image.size == 0:
        raise ValueError("emptyImage")
    fitted = resize_array(image.astype(float), mode.width, mode.height)
    if mode.palettes > 1:
        return _in_strips(fitted, mode, dither)
    if mode.palette:
        palette = list(mode.palette)
    elif mode.choice:
        palette = frequent(fitted, np.array(mode.choice), mode.colours)
    else:
        palette = [tuple(int(round(v)) for v in c) for c in median_cut(fitted.reshape(-1, 3), mode.colours)]
    colours = np.array(palette, float)
    if dither:
        grid = diffuse_array(fitted, colours, dither)
    else:
        grid = np.stack([((row[:, None] - colours[None]) ** 2).sum(axis=2).argmin(axis=1) for row in fitted])
    table = None
    if mode.cell:
        grid, table = cell_restricted(grid, colours, fitted, mode.cell, mode.cell_colours)
    return grid, palette, mode.encode(grid, palette, table)


def _work(rows: pd.DataFrame, mode: str, dither: str | None) -> pd.DataFrame:
    key = rows["image_id"].iloc[0]
    try:
        image = np.zeros((int(rows["y"].max()) + 1, int(rows["x"].max()) + 1, 3))
        image[rows["y"], rows["x"]] = rows[["r", "g", "b"]].to_numpy(float)
        grid, _, data = convert_array(image, MODES[mode], dither)
        return pd.DataFrame({"image_id": [key], "mode": [mode], "extension": [MODES[mode].extension], "width": [grid.shape[1]], "height": [grid.shape[0]], "indices": [grid.reshape(-1)], "content": [data], "error": [None]})
    except Exception as error:  # noqa: BLE001
        return pd.DataFrame({"image_id": [key], "mode": [mode], "extension": [None], "width": [None], "height": [None], "indices": [None], "content": [None], "error": [str(error)]})


def convert(pixels: DataFrame, mode: str, dither: str | None = None) -> DataFrame:
    """(image_id, mode, extension, width, height, indices, content, error) of pixels(image_id, y, x, r, g, b)."""
    kind = dict(pixels.dtypes)["image_id"]
    return pixels.select("image_id", "y", "x", "r", "g", "b").groupBy("image_id").applyInPandas(partial(_work, mode=mode, dither=dither), f"image_id {kind}, mode string, extension string, width long, height long, indices array<long>, content binary, error string")


def _encode(rows: pd.DataFrame, kind: str) -> pd.DataFrame:
    image = np.zeros((int(rows["y"].max()) + 1, int(rows["x"].max()) + 1, 3), np.int64)
    image[rows["y"], rows["x"]] = rows[["r", "g", "b"]].to_numpy()
    return pd.DataFrame({"image_id": [rows["image_id"].iloc[0]], "content": [{"bmp": enc.bmp24, "png": enc.png}[kind](image)]})


def previews(pixels: DataFrame, kind: str = "png") -> DataFrame:
    """(image_id, content): images(image_id, y, x, r, g, b) as PNG or BMP files, as they are."""
    types = dict(pixels.dtypes)
    return pixels.select("image_id", "y", "x", "r", "g", "b").groupBy("image_id").applyInPandas(partial(_encode, kind=kind), f"image_id {types['image_id']}, content binary")


class MachineTable:
    """SELECT * FROM machine(TABLE(px) PARTITION BY (image_id), 'zx_hires'): a native file of each image.

    px has image_id, y, x, r, g, b; an image is a partition of the table argument. An unknown mode is told in `error`.
    """

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.mode: str | None = None

    def eval(self, row: Row, mode: str) -> None:
        self.mode = mode
        self.rows.append(tuple(row[c] for c in ("image_id", "y", "x", "r", "g", "b")))

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            key = self.rows[0][0]
            if self.mode not in MODES:
                yield None if key is None else str(key), self.mode, None, None, None, None, f"no mode {self.mode}"
                return
            told = _work(pd.DataFrame(self.rows, columns=["image_id", "y", "x", "r", "g", "b"]), self.mode, None).iloc[0]
            whole = lambda v: None if pd.isna(v) else int(v)
            yield None if key is None else str(key), self.mode, told["extension"], whole(told["width"]), whole(told["height"]), told["content"], told["error"]


def register(spark: SparkSession) -> None:
    """machine(TABLE ... PARTITION BY (image_id), mode) for SQL."""
    spark.udtf.register("machine", udtf(MachineTable, returnType="image_id string, mode string, extension string, width bigint, height bigint, content binary, error string"))
