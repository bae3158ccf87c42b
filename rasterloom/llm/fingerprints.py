"""Fingerprints of whole texts from improbable byte windows, in chained Bloom filters.

A feature is a window of WIDTH bytes of the UTF-8 text. Its entropy (0 to LEVELS) is rare or common among all windows of
the corpus; windows of rarer entropy come first, those under LOW last (runs of few bytes, which unlike texts share). Of each
REACH windows in a row the first of the rarest gets a point, and windows of POINTS points or more are selected; a text of up
to CAPACITY windows selects all of them. A text under WIDTH bytes is one feature; an empty one has none.

Selected features, each once, fill Bloom filters of BITS bits one after the other, CAPACITY features to a filter, HASHES
bits to a feature. A fingerprint is the base64 text of the filters, each as a byte with its number of features and BITS / 8
bytes. Two filters are compared by their common bits, normalised so that what filters of their sizes share by chance is 0
and all bits of the lesser one are 1. The likeness of two fingerprints is the mean of what each filter of the shorter one
finds best in the other, weighted by features: 1 for equal ones, 0 where one is empty.

The entropy table is counted over all windows of all texts; `ranks` takes a stored one, for fingerprints that are to be
compared across corpora. Equal texts have equal fingerprints under one table. Null texts are empty ones. Texts are worked
on in blocks of bytes, so a very long one takes memory for a few bytes each of its own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernel import mix, slices, text_buffers

WIDTH, REACH, POINTS = 32, 32, 8
LEVELS, LOW = 1000, 100
BITS, CAPACITY, HASHES = 2048, 160, 5
#: Bytes worked on at a time: their sorted keys stay in a core's cache and in 32 bits.
BLOCK = 1 << 16
#: c * log2(c) of c equal bytes in a window, as whole numbers.
_SPREAD = np.round(np.array([0.0, *(c * np.log2(c) for c in range(1, WIDTH + 1))]) * 2**20).astype(np.int64)
_STEP = np.diff(_SPREAD, prepend=0)


def _levels(data: np.ndarray) -> np.ndarray:
    """The entropy of the window that starts at each byte, as far as there is one.

    Sliding on by one byte takes away the step of that byte's count in the window and adds that of the new byte's count;
    counts are distances in the bytes sorted by value and place.
    """
    n = len(data)
    if n < WIDTH:
        return np.zeros(0, np.uint16)
    order = np.argsort(data, kind="stable")
    key = data[order].astype(np.int32) * (2 * n + WIDTH) + order.astype(np.int32)
    at = np.arange(n)
    ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
    ahead[order] = _STEP[np.searchsorted(key, key + np.int32(WIDTH)) - at]
    behind[order] = _STEP[at - np.searchsorted(key, key - np.int32(WIDTH), "right") + 1]
    held = np.cumsum(behind)[WIDTH - 1 :]
    held[1:] -= np.cumsum(ahead[: n - WIDTH])
    whole = int(_SPREAD[WIDTH])
    return ((whole - held) * LEVELS // whole).astype(np.uint16)


def levels(data: np.ndarray) -> np.ndarray:
    found = [_levels(data[a : a + BLOCK + WIDTH - 1]) for a in range(0, max(len(data) - WIDTH + 1, 0), BLOCK)]
    return np.concatenate(found) if found else np.zeros(0, np.uint16)


def _points(rank: np.ndarray) -> np.ndarray:
    """How often each window is the first of the rarest among REACH windows in a row."""
    n = len(rank)
    points = np.zeros(n, np.uint8)
    for a in range(0, max(n - REACH + 1, 0), BLOCK):
        best = (rank[a : a + BLOCK + REACH - 1].astype(np.int64) << 32) + np.arange(a, min(n, a + BLOCK + REACH - 1))
        span = 1
        while span < REACH:
            wide = min(span, REACH - span)
            best = np.minimum(best[:-wide], best[wide:])
            span += wide
        times = np.bincount((best & 0xFFFFFFFF) - a)
        points[a : a + len(times)] += times.astype(np.uint8)
    return points


def _hashes(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the windows of `width` bytes."""
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), BLOCK >> 2):
        part = starts[a : a + (BLOCK >> 2)]
        own = np.zeros((len(part), -(-width // 8) * 8), np.uint8)
        own[:, :width] = data[part[:, None] + np.arange(width)]
        h = np.full(len(own), width, np.uint64)
        for word in own.view(np.uint64).T:
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + word)
        out[a : a + len(own)] = h
    return out


def selected(found: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Where the selected windows of a text start; found: the text's levels."""
    return np.arange(len(found)) if len(found) <= CAPACITY else np.flatnonzero(_points(ranks[found]) >= POINTS)


def filters(found: list[int]) -> bytes:
    """The hashes of features, each taken once and in their order, in chained Bloom filters."""
    own = np.array(list(dict.fromkeys(found)), np.uint64)
    chain = -(-len(own) // CAPACITY)
    if not chain:
        return b""
    which = np.arange(len(own)) // CAPACITY
    places = (own[:, None] >> (11 * np.arange(HASHES)).astype(np.uint64)) % np.uint64(BITS)
    bits = np.zeros((chain, BITS), bool)
    bits[which[:, None], places.astype(np.int64)] = True
    counts = np.bincount(which).astype(np.uint8)
    return np.concatenate([counts[:, None], np.packbits(bits, axis=1)], axis=1).tobytes()


def digests(texts: list[bytes], ranks: np.ndarray) -> list[bytes]:
    """The filters of each text; short texts are worked on together."""
    out: list[bytes] = []
    bounds = np.cumsum([0, *map(len, texts)])
    for a, b in slices(bounds, BLOCK):
        data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        found = levels(data)
        spans = list(zip((bounds[a:b] - bounds[a]).tolist(), (bounds[a + 1 : b + 1] - bounds[a]).tolist(), strict=True))
        starts = [selected(found[s : max(s, e - WIDTH + 1)], ranks) + s for s, e in spans]
        hashes = _hashes(data, np.concatenate(starts), WIDTH).tolist()
        at = 0
        for (s, e), own in zip(spans, starts, strict=True):
            short = 0 < e - s < WIDTH
            out.append(filters(_hashes(data, np.array([s]), e - s).tolist() if short else hashes[at : at + len(own)]))
            at += len(own)
    return out


def _split(digest: bytes) -> tuple[np.ndarray, np.ndarray]:
    held = np.frombuffer(digest, np.uint8).reshape(-1, 1 + BITS // 8)
    return held[:, 0].astype(np.int64), np.ascontiguousarray(held[:, 1:]).view(np.uint64)


def compare(a: bytes, b: bytes) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    (na, one), (nb, two) = map(_split, sorted((a, b), key=lambda x: (len(x), x)))
    if len(one) == len(two) and na.sum() > nb.sum():
        na, one, two = nb, two, one
    twos = np.bitwise_count(two).sum(axis=1, dtype=np.int64)
    total = 0.0
    for n, bits in zip(na.tolist(), one, strict=True):
        ones = int(np.bitwise_count(bits).sum())
        common = np.bitwise_count(two & bits).sum(axis=1, dtype=np.int64)
        chance = ones * twos / BITS
        best = ((common - chance) / np.maximum(np.minimum(ones, twos) - chance, 1e-9)).max()
        total += n * min(1.0, max(0.0, float(best)))
    return total / int(na.sum())


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LEVELS + 1, np.int64)
    for batch in batches:
        data, bounds = text_buffers(batch.column(0))
        for a, b in slices(bounds, BLOCK):
            found = levels(data[bounds[a] : bounds[b]])
            inside = np.ones(len(found), bool)
            for end in (bounds[a + 1 : b] - bounds[a]).tolist():
                inside[max(end - WIDTH + 1, 0) : end] = False  # windows over the end of a text
            total += np.bincount(found[inside], minlength=LEVELS + 1)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["level", "n"])


def level_ranks(texts: DataFrame, text_col: str = "text") -> list[int]:
    """The rank of each entropy level among all windows of all texts, the rarest first; those under LOW come last."""
    counted = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_histogram, "level long, n long").groupBy("level").agg(F.sum("n"))
    n = dict.fromkeys(range(LEVELS + 1), 0) | {r[0]: r[1] for r in counted.collect()}
    order = sorted(n, key=lambda level: (level < LOW, n[level], level))
    return [k for _, k in sorted(zip(order, range(len(order)), strict=True))]


def _text(digest: bytes) -> str:
    return base64.b64encode(digest).decode()


def fingerprint(text: Column, ranks: list[int]) -> Column:
    """The fingerprint of a text column under a table of level_ranks."""
    table = np.array(ranks)

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([_text(d) for d in digests([t.encode() for t in texts], table)])

    return made(F.coalesce(text, F.lit("")))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two columns of fingerprints; null where one is null."""

    @F.pandas_udf("double")
    def made(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else compare(base64.b64decode(x), base64.b64decode(y)) for x, y in zip(left, right, strict=True)], dtype="float64")

    return made(a, b)


@dataclass
class _Row:
    lot: int
    follows: bool
    id: int | None
    text: str
    digest: bytes = b""


def _in_lots(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[list[_Row]]:
    held, size = [], 0
    for batch in batches:
        for lot, follows, key, text in zip(*(batch.column(k) for k in range(4)), strict=True):
            held.append(_Row(lot.as_py(), follows.as_py(), key.as_py(), text.as_py() or ""))
            size += len(held[-1].text)
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


EDITED = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(batches: Iterator[pa.RecordBatch], ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (lot, follows, id, text) in their order; a lot ends with a row that only follows."""
    waits: list[_Row] = []
    for rows in _in_lots(batches):
        for row, made in zip(rows, digests([r.text.encode() for r in rows], ranks), strict=True):
            row.digest = made
        line = waits + rows
        pairs = [(a, b) for a, b in zip(line, line[1:]) if not a.follows]
        edits = [(a.text[: len(a.text) - len(a.text) // 3] + b.text[: len(a.text) // 3]).encode() for a, b in pairs]
        made = digests(edits, ranks)
        columns = [
            [a.id for a, _ in pairs],
            [len(a.text) for a, _ in pairs],
            [hashlib.sha256(e).hexdigest() for e in edits],
            [_text(a.digest) for a, _ in pairs],
            [_text(d) for d in made],
            [compare(a.digest, d) for (a, _), d in zip(pairs, made, strict=True)],
            [compare(a.digest, b.digest) for a, b in pairs],
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        waits = [line[-1]]


def _lots(keyed: DataFrame, lot_bytes: int, most_lots: int, each: int = 8) -> list[tuple[int, int, int]]:
    """The first keys (back, h, row) of lots of about lot_bytes: the least key and some of a sample of at most
    each * most_lots keys."""
    key = F.struct("back", "h", "row")
    size, least = keyed.agg(F.sum(F.octet_length("text")), F.min(key)).first()
    if least is None:
        return []
    n = max(1, min(most_lots, -(-size // lot_bytes)))
    drawn = keyed.orderBy(F.xxhash64("back", "h", "row"), "row").limit(each * n).select("back", "h", "row").collect() if n > 1 else []
    return sorted({tuple(least), *sorted(tuple(r) for r in drawn)[each - 1 :: each]})


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: list[int] | None = None, lot_bytes: int = 8 << 20, most_lots: int = 50_000) -> DataFrame:
    """One row per input row: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text of a document has its last floor(n_chars / 3) code points replaced by the first as many of the next
    document's text (or all), in the order of descending ids; after the last comes the first. Null ids come last; rows of
    an equal id go by a hash of their text. A document alone is next to itself.

    Documents are dealt once into lots of consecutive ones; the first document of a lot also goes, as a follower, to the
    lot before. Lots are bounded by keys drawn from a bounded sample.
    """
    ranks = level_ranks(docs, text_col) if ranks is None else ranks
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # ~id falls as id rises, without overflow.
    keyed = given.select("id", "text", F.coalesce(F.bitwise_not("id"), F.lit((1 << 63) - 1)).alias("back"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).withColumn("row", F.monotonically_increasing_id())
    firsts = _lots(keyed, lot_bytes, most_lots)

    @F.pandas_udf("array<int>")
    def lots_of(back: pd.Series, h: pd.Series, row: pd.Series) -> pd.Series:
        from bisect import bisect_right

        out = []
        for key in zip(back.tolist(), h.tolist(), row.tolist(), strict=True):
            own = bisect_right(firsts, key) - 1
            out.append([own, (own - 1) % len(firsts)] if firsts[own] == key else [own])
        return pd.Series(out)

    dealt = keyed.select("id", "text", "back", "h", "row", F.posexplode(lots_of("back", "h", "row")).alias("pos", "lot")).withColumn("follows", F.col("pos") == 1)
    ordered = dealt.repartition(max(1, len(firsts)), "lot").sortWithinPartitions("lot", "follows", "back", "h", "row")
    made = ordered.select("lot", "follows", "id", "text").mapInArrow(partial(_edited, ranks=np.array(ranks)), EDITED)
    return made.withColumnRenamed("id", id_col)
