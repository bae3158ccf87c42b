"""Array kernels on Arrow string buffers: words, word hashes and k-word shingles of whole texts, without Python strings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def slices(bounds: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes, at least one row each."""
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1)
        yield first, min(last, len(bounds) - 1)
        first = last


def words_of(data: np.ndarray, bounds: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and how many words each row has. fold: lower-case A-Z first."""
    rows = len(bounds) - 1
    body = data[bounds[0] : bounds[-1]]
    inside = ~_SPACE[body]
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    edges = bounds[:-1] - bounds[0]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    at = edges[(edges < len(body))]
    opens[at] = inside[at]
    starts = np.flatnonzero(opens)
    letters = (_FOLD[body] if fold else body)[inside]
    first = (np.cumsum(inside) - 1)[starts]
    lengths = np.diff(np.append(first, len(letters)))
    powers = np.full(int(lengths.max()), _BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    terms = (letters.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(letters)) - np.repeat(first, lengths)]
    hashes = mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64))
    counts = np.diff(np.append(np.searchsorted(starts, edges), len(starts)))
    return hashes, counts


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int, fold: bool = True) -> list[np.ndarray]:
    """For each row its sorted distinct shingles of `width` words as 64-bit hashes; fewer words make one shingle, none an empty set."""
    hashes, counts = words_of(data, bounds, fold)
    ends = np.cumsum(counts)
    n = len(hashes) - width + 1
    wide = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        wide += np.uint64(width)
        for k in range(width):
            wide = mix(wide * _STEP + hashes[k : k + n])
    sets = []
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= width:
            own = np.sort(wide[end - count : end - width + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            sets.append(own[keep])
        elif count:
            one = np.full(1, count, np.uint64)
            for h in hashes[end - count : end]:
                one = mix(one * _STEP + h)
            sets.append(one)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def runs(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """work on each run of rows with an equal first column, of rows that come sorted by it."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch])
        held = pa.concat_tables([rest, held]).combine_chunks() if rest is not None else held
        keys = np.asarray(held.column(0))
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=False):
            if (made := work(held.slice(a, b - a))) is not None:
                yield made
        rest = held.slice(int(cuts[-1])) if len(cuts) else held
    if rest is not None and (made := work(rest)) is not None:
        yield made
