"""Vectors as whole numbers, for the operators that have to be exact."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

SCALE = 256


def is_sound(vector: Column) -> Column:
    """True where a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & ~F.exists(F.coalesce(vector, F.array().cast("array<double>")), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def whole_vectors(rows: DataFrame, name: str, multiple: int = 1) -> tuple[DataFrame, int]:
    """A table in the shared folder of rows(..., vector), with sound vectors only and each component x as floor(256 * x),
    and the length of its vectors.

    Vectors are padded with zeros to the longest one, and that to a multiple of `multiple`. Components are held within
    +-limit(length), which for 64 of them is 2^27, so that sums of squared differences of one vector fit into 64 bits.
    """
    sound = rows.where(is_sound(F.col("vector")))
    longest = sound.agg(F.max(F.size("vector"))).first()[0] or 0
    length = max(1, -(-longest // multiple)) * multiple
    bound = float(limit(length))
    ints = F.transform("vector", lambda x: F.floor(F.least(F.greatest(x * SCALE, F.lit(-bound)), F.lit(bound))).cast("int"))
    padded = F.concat(ints, F.array_repeat(F.lit(0), F.lit(length) - F.size("vector")))
    return cut(sound.withColumn("vector", padded), name), length


def limit(length: int) -> int:
    return min(1 << 27, math.isqrt((1 << 62) // (4 * length)))


def matrix(column: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    """The rows of a column of equally long integer lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), length)
