"""Rasters as pixel tables, and images decoded to them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "image_id string, y int, x int, r int, g int, b int, a int"


def orders_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image of width 150 from the orders table: x, y, r, g, b as longs."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(
        F.expr("o_orderkey % 150").alias("x"),
        F.expr("o_orderkey div 150").alias("y"),
        F.expr("cast(floor(o_totalprice) as bigint) % 256").alias("r"),
        F.expr("(o_custkey * 7) % 256").alias("g"),
        F.expr("(o_orderkey * 31 + o_custkey) % 256").alias("b"),
    )


def embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8x8 grey cell per vector: vec_id, x, y, lum."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    placed = vectors.select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return placed.selectExpr("vec_id", "cast(pos % 8 as bigint) as x", "cast(pos div 8 as bigint) as y", "cast(floor((cast(v as double) + 1.0D) * 127.5D) as bigint) as lum")


def _png_lines(raw: bytes, height: int, width: int, step: int) -> np.ndarray:
    """The lines of a PNG with their filters undone: height by width by step. Only what depends on the pixel to the left
    runs pixel by pixel, all its channels at once."""
    rows = np.frombuffer(raw, np.uint8, height * (width * step + 1)).reshape(height, width * step + 1)
    out = np.zeros((height, width, step), np.uint8)
    above = np.zeros((width, step), np.int64)
    for y, (mode, line) in enumerate(zip(rows[:, 0].tolist(), rows[:, 1:].reshape(height, width, step).astype(np.int64), strict=True)):
        if mode == 1:
            line = line.cumsum(axis=0)
        elif mode == 2:
            line = line + above
        elif mode in (3, 4):
            left, corner = np.zeros(step, np.int64), np.zeros(step, np.int64)
            for x in range(width):
                up = above[x]
                if mode == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left, corner = (line[x] + guess) & 255, up
                line[x] = left
        above = line & 255
        out[y] = above
    return out


def _png(data: bytes) -> np.ndarray:
    """RGBA of an 8-bit, non-interlaced PNG: height by width by four."""
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
    if depth != 8 or interlaced:
        raise ValueError("only 8-bit PNG without interlacing")
    at, packed, table, clear = 8, [], b"", b""
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if name == b"IDAT":
            packed.append(body)
        table = body if name == b"PLTE" else table
        clear = body if name == b"tRNS" else clear
        at += size + 12
    lines = _png_lines(zlib.decompress(b"".join(packed)), height, width, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind])
    out = np.full((height, width, 4), 255, np.uint8)
    if kind == 3:
        colours = np.full((256, 4), 255, np.uint8)
        colours[: len(table) // 3, :3] = np.frombuffer(table, np.uint8).reshape(-1, 3)
        colours[: len(clear), 3] = np.frombuffer(clear, np.uint8)
        return colours[lines[..., 0]]
    out[..., :3] = lines[..., :3] if kind in (2, 6) else lines[..., :1]
    if kind in (4, 6):
        out[..., 3] = lines[..., -1]
    return out


def _bmp(data: bytes) -> np.ndarray:
    """RGBA of an uncompressed 24- or 32-bit BMP: height by width by four."""
    offset, _, width, height, _, bits = struct.unpack("<IIiiHH", data[10:30])
    if bits not in (24, 32):
        raise ValueError("only 24- and 32-bit BMP")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, abs(height) * stride, offset).reshape(abs(height), stride)[:, : width * bits // 8].reshape(abs(height), width, bits // 8)
    out = np.full((abs(height), width, 4), 255, np.uint8)
    out[..., :3] = rows[::-1 if height > 0 else 1, :, 2::-1]
    return out


def decode_image(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and RGBA bytes."""
    grid = _grid(data)
    return grid.shape[1], grid.shape[0], grid.tobytes()


def _grid(data: bytes) -> np.ndarray:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("not a PNG or BMP file")


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for key, content in zip(batch["image_id"], batch["content"], strict=True):
            grid = _grid(bytes(content))
            y, x = np.divmod(np.arange(grid.shape[0] * grid.shape[1]), max(grid.shape[1], 1))
            yield pd.DataFrame({"image_id": key, "y": y, "x": x, **{c: grid[..., k].reshape(-1).astype(np.int64) for k, c in enumerate("rgba")}})


#: What a file's head tells, as (width, height, bits a pixel, colour space, dots an inch, alpha).
HEAD = "width long, height long, bits_per_pixel long, color_space string, dpi long, has_alpha boolean"


def _head(data: bytes) -> tuple[int, int, int, str, int, bool] | None:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        width, height, depth, kind = struct.unpack(">IIBB", data[16:26])
        at, dpi, clear = 8, 72, False
        while at + 8 <= len(data):
            size, name = struct.unpack(">I4s", data[at : at + 8])
            if name == b"pHYs" and data[at + 16] == 1:
                dpi = round(struct.unpack(">I", data[at + 8 : at + 12])[0] * 0.0254)
            clear = clear or name == b"tRNS"
            if name == b"IDAT":
                break
            at += size + 12
        return width, height, depth * {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind], "Grayscale" if kind in (0, 4) else "RGB", dpi, clear or kind in (4, 6)
    if data[:2] == b"BM":
        width, height, _, bits = struct.unpack("<iiHH", data[18:30])
        metre = struct.unpack("<i", data[38:42])[0]
        return width, abs(height), bits, "RGB", round(metre * 0.0254) if metre > 0 else 72, bits == 32
    return None


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        told = [_head(bytes(c)) or (None,) * 6 for c in batch["content"]]
        yield pd.DataFrame({"image_id": batch["image_id"], **{c.split()[0]: [t[k] for t in told] for k, c in enumerate(HEAD.split(", "))}})


def metadata(images: DataFrame) -> DataFrame:
    """images(image_id, content) with what their heads tell: no image is decoded; nulls where the format is unknown."""
    return images.select("image_id", "content").mapInPandas(_heads, f"image_id {dict(images.dtypes)['image_id']}, {HEAD}")


def pasted(spark: SparkSession, blobs: list[tuple[str, bytes]]) -> DataFrame:
    """images of a few blobs at hand, as read_images has them: no file, 72 dots an inch."""
    return spark.createDataFrame([(f"paste:{k}", name, "Clipboard", len(content), bytearray(content)) for k, (name, content) in enumerate(blobs)], "image_id string, name string, format string, file_size long, content binary")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """images(image_id, name, format, file_size, content) below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.col("path").alias("image_id"), name.alias("name"), F.upper(F.element_at(F.split(name, r"\."), -1)).alias("format"), F.col("length").alias("file_size"), "content")


def pixels(images: DataFrame) -> DataFrame:
    """PIXELS of images(image_id, content), decoded image by image."""
    return images.select("image_id", "content").mapInPandas(_decode, PIXELS)
