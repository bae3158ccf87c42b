"""Vector codes: each part of a vector is replaced by the number of the nearest entry of that part's codebook.

Components are whole numbers (floor(256 * x)) and vectors are cut into `parts` equal consecutive parts. A part's codebook
begins as that part of the `entries` smallest ids. Each round assigns every part to its nearest entry by squared Euclidean
distance, the lower index on a tie, and replaces an entry by the componentwise floor(sum / count) of its parts; entries
without a part stay. All of it is exact: distances come from |c|^2 - 2 x.c, in products of 64-bit integers.

Codebooks are the only thing that goes through the driver or to all tasks: parts * entries * width integers, whatever the
input. Tasks add up what they assign, so each sends one row for an entry and position that it has met at most.

Rows whose vector is null or holds null or non-finite components are dropped. Shorter vectors count as padded with zeros
to the longest one, and its length to a multiple of `parts`; components are bounded (see whole_vectors). Rows with a null
id are coded but never begin a codebook (where all are null there is none, and code and error are null); of rows that repeat an id, the smaller vector comes first. Rows that are repeated
weigh as often as they are there. With fewer rows than `entries` codebooks are as short; without rows the result is empty.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .vectors import matrix, whole_vectors


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part of x(rows, parts, width), and its squared distance; books(parts, entries, width)."""
    codes = np.empty(x.shape[:2], np.int64)
    apart = np.empty(x.shape[:2], np.int64)
    rows = np.arange(len(x))
    for p, book in enumerate(books):
        own = np.ascontiguousarray(x[:, p])
        far = (book * book).sum(axis=1) - 2 * (own @ book.T)
        codes[:, p] = far.argmin(axis=1)  # the first of equal ones
        apart[:, p] = far[rows, codes[:, p]] + (own * own).sum(axis=1)
    return codes, apart


def _blocks(batch: pa.RecordBatch, books: np.ndarray, most: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    parts, _, width = books.shape
    for at in range(0, batch.num_rows, most):
        block = batch.slice(at, most)
        yield block, matrix(block.column(block.schema.get_field_index("vector")), parts * width).reshape(-1, parts, width)


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a task has assigned, added up: part, entry, position, total, n."""
    parts, entries, width = books.shape
    totals, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
    for batch in batches:
        for _, x in _blocks(batch, books):
            codes, _ = assign(x, books)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                used, first = np.unique(codes[order, p], return_index=True)
                totals[p, used] += np.add.reduceat(x[order, p], first, axis=0)
                counts[p] += np.bincount(codes[:, p], minlength=entries)
    part, entry = np.nonzero(counts)
    n = len(part)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(part, width)), pa.array(np.repeat(entry, width)), pa.array(np.tile(np.arange(width), n)), pa.array(totals[part, entry].reshape(-1)), pa.array(np.repeat(counts[part, entry], width))],
        names=["part", "entry", "position", "total", "n"],
    )


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, x in _blocks(batch, books):
            if books.size:
                codes, apart = assign(x, books)
                made = pa.array([row.tobytes().hex() for row in codes.astype(np.uint8)], pa.string()), pa.array(apart.sum(axis=1))
            else:
                made = pa.nulls(len(x), pa.string()), pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), *made], names=["id", "label", "code", "error"])


def first_books(vectors: DataFrame, length: int, parts: int, entries: int) -> np.ndarray:
    some = vectors.where("id is not null").orderBy("id", "vector").limit(entries).select("vector").collect()
    return np.array([r[0] for r in some], np.int64).reshape(len(some), parts, length // parts).transpose(1, 0, 2)


def next_books(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round. The rows that come back are one for an entry and position: the codebooks themselves."""
    sums = vectors.mapInArrow(partial(_sums, books=books), "part long, entry long, position long, total long, n long")
    merged = sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    moved = books.copy()
    for part, entry, position, value in merged.select("part", "entry", "position", F.expr("(total - pmod(total, n)) div n")).collect():
        moved[part, entry, position] = value
    return moved


def train(vectors: DataFrame, length: int, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray:
    """Codebooks (parts, entries, width) of whole_vectors' rows(id, label, vector)."""
    if not 1 <= entries <= 256 or length % parts:
        raise ValueError("a code has one byte a part: 1 to 256 entries, and vectors of a multiple of the parts")
    books = first_books(vectors, length, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = next_books(vectors, books)
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def decode(codes: DataFrame, books: np.ndarray, code_col: str = "code") -> DataFrame:
    """codes with the vector (array<long>) that each code stands for, as column decoded; null for null."""
    parts, _, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if c is None else books[np.arange(parts), np.frombuffer(bytes.fromhex(c), np.uint8)].reshape(-1).tolist() for c in batch.column(batch.schema.get_field_index(code_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.int64()))], names=[*batch.schema.names, "decoded"])

    return codes.mapInArrow(work, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in codes.schema)}, decoded array<long>")


def summed_by(rows: DataFrame, key: str, value: str, into: str) -> DataFrame:
    """rows with the sum of `value` over the rows of an equal key (nulls together). At most HOT keys hold more than one in
    HOT of the rows: their sums are broadcast, and only the rows of the other keys are dealt out by key."""
    HOT = 1000
    sums = cut(rows.groupBy(F.col(key).alias("__key")).agg(F.sum(value).alias(into), F.count("*").alias("__n")), "sums")
    most = rows.count()
    hot, rest = sums.where(F.col("__n") * HOT > most).drop("__n"), sums.where(F.col("__n") * HOT <= most).drop("__n")
    same = lambda: F.col(key).eqNullSafe(F.col("__key"))
    warm = rows.join(F.broadcast(hot), same()).drop("__key")
    cold = rows.join(F.broadcast(hot), same(), "left_anti").join(rest, same()).drop("__key")
    return warm.unionByName(cold)


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column | None = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """id_col, code, error, label_error, codebooks_sha256 of the rows that have a sound vector."""
    label = F.lit(None).cast("string") if label_col is None else F.col(label_col) if isinstance(label_col, str) else label_col
    given = rows.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    vectors, length = whole_vectors(given, "whole", parts)
    books = train(vectors, length, parts, entries, rounds)
    kind = vectors.schema["label"].dataType.simpleString()
    coded = cut(vectors.mapInArrow(partial(_coded, books=books), f"id long, label {kind}, code string, error long"), "coded")
    return summed_by(coded, "label", "error", "label_error").select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
