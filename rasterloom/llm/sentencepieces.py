"""SentencePiece encoding and decoding over a relational lattice.

Encoding: texts are cut into units that no piece crosses: a run of space marks with the run of characters after it that
pieces join to one another. The distinct units of all texts are a relation. Their substrings of bounded length are exploded
and equi-joined to the piece table; the edges of a unit are grouped and folded with a higher-order aggregate, which gives
the boundaries of its pieces. For unigram models the fold is Viterbi's.
The given model is a BPE model, whose segmentation is no best path: there the fold replays its merges on the same edges,
best score first, the boundaries of a unit being the bits of a long. Units of more characters than a long has bits, and
those with pieces that can be merged later than their score says, are replayed from the same edges with a heap. Documents
are dealt into blocks by hash; the folded units are joined back to the blocks that hold them, and the texts of a block
are mapped unit by unit. The library's processor only reads the model: it encodes nothing. Models with pieces that hold
a space mark after another character, or with another than the plain normaliser, are refused.

One row per input row: n_tokens, ids, round_trip (whether decoding gives the text back, U+2581 read as a space). Null or
empty text has no ids. Extra columns are not read; null or repeated ids do no harm.

Texts cross one exchange, to their block, the rows of a block that a task holds together as one compressed cell; the
distinct units of a block cross two, to their fold and back, sorted so that neighbours are alike.
"""

from __future__ import annotations

import heapq
import itertools
import re
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut

MARK = "▁"
WORD = f"{MARK}*[^{MARK}]+|{MARK}+"
MOST_CHARS = 48
#: Boundaries of a unit that are bits of a long.
MOST_BITS = 62
#: Bytes of text in a block.
BLOCK = 24 << 20
#: Bytes of text that a task deals out at once.
PACK = 32 << 20
#: Starts of substrings that are cut from one slice of a unit, so that long units are not walked from their first character.
SLICE = 64
SCHEMA = "id long, n_tokens long, ids array<int>, round_trip boolean"


def piece_rows(processor: sentencepiece.SentencePieceProcessor) -> list[tuple[str, int, float]]:
    """(piece, id, score) of the pieces that text can match."""
    special = lambda i: processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i)
    return [(processor.id_to_piece(i), i, processor.get_score(i)) for i in range(processor.get_piece_size()) if not special(i)]


def _load(model: bytes) -> sentencepiece.SentencePieceProcessor:
    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    if any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in piece_rows(processor)):
        raise ValueError("a piece holds a space mark after another character")
    if processor.decode(processor.encode(" ａ  ①")) != " ａ  ①":
        raise ValueError("the model normalises its text")
    return processor


def lattice(words: DataFrame, pieces: DataFrame, most: int) -> DataFrame:
    """words(word) to (word, size, edges): the pieces found in each word, as structs of start, end, score and id.

    The piece table is fixed by the model, at most a few MB, so it is broadcast.
    """
    size = F.length("word")
    starts = words.select("word", size.alias("size"), F.explode(F.sequence(F.lit(1), size)).alias("start"))
    spans = starts.withColumn("span", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.col("size") - F.col("start") + 1))))
    cut_out = spans.withColumn("piece", F.substring("word", F.col("start"), F.col("span")))
    edges = cut_out.join(F.broadcast(pieces), "piece", "left").where("id is not null or span = 1")
    edge = F.struct((F.col("start") - 1).alias("start"), (F.col("start") - 1 + F.col("span")).alias("end"), "score", "id")
    return edges.groupBy("word", "size").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def unit_pattern(pieces: list[str]) -> str:
    """A pattern of units, for Java and Python alike. Characters that follow one another in some piece are of one class; no
    piece holds two characters of different classes, or one of none beside another. Only a space mark may precede any."""
    joined: dict[str, str] = {}

    def root(c: str) -> str:
        while joined.setdefault(c, c) != c:
            c = joined[c]
        return c

    for piece in pieces:
        for a, b in itertools.pairwise(piece.lstrip(MARK)):
            joined[root(a)] = root(b)
    spans: dict[str, list[list[int]]] = {}
    last = ("", 0)
    for c in sorted(joined):
        # Characters of no piece between two of a class are added to it, which is exact too; not so in ASCII.
        if root(c) == last[0] and (ord(c) == last[1] + 1 or ord(c) > 0xFF < last[1] + 1):
            spans[root(c)][-1][1] = ord(c)
        else:
            spans.setdefault(root(c), []).append([ord(c), ord(c)])
        last = (root(c), ord(c))
    if any(end > 0xFFFF for ranges in spans.values() for _, end in ranges):
        raise ValueError("pieces join characters beyond the basic plane")
    classes = ["[" + "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in ranges) + "]+" for ranges in spans.values()]
    return f"{MARK}*(?:{'|'.join([*sorted(classes, key=len, reverse=True), f'[^{MARK}]'])})|{MARK}+"


def disordered(scores: dict[str, float]) -> set[str]:
    """Pieces that a pass over edges, best score first, could merge too early or miss: the merges of better scores do not
    leave a piece in two parts."""
    found = set()
    for piece, score in scores.items():
        parts = list(piece)
        while len(parts) > 1:
            ready = [(-scores[a + b], k) for k, (a, b) in enumerate(itertools.pairwise(parts)) if scores.get(a + b, score) > score]
            if not ready:
                break
            k = min(ready)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(piece) > 2 and len(parts) != 2:
            found.add(piece)
    return found


def _widths(pieces: int, most: int) -> tuple[int, int]:
    """Bits of an edge: its span; its start and span. The rank is above them."""
    return most.bit_length(), 62 - pieces.bit_length()


def edges_of(units: DataFrame, pieces: DataFrame, most: int, count: int) -> DataFrame:
    """units(unit), distinct, to (unit, edges, odd): the pieces found in each unit, as longs of rank, start and span, best
    first; odd: one of them is out of order. Units dealt by hash stay where they are.

    The piece table (piece, rank, odd) is fixed by the model, at most a few MB, so it is broadcast.
    """
    span_bits, rank_at = _widths(count, most)
    size = F.length("unit")
    slices = units.select("unit", size.alias("size"), F.explode(F.sequence(F.lit(0), F.floor((size - 1) / SLICE).cast("int"))).alias("slice"))
    sliced = slices.select("unit", "size", (F.col("slice") * SLICE).alias("before"), F.when(F.col("size") <= SLICE, F.col("unit")).otherwise(F.substring("unit", F.col("slice") * SLICE + 1, F.lit(SLICE + most))).alias("cut"))
    # Starts in the slice; the last character of a unit starts nothing longer than itself.
    starts = sliced.select("unit", "size", "before", "cut", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(SLICE), F.col("size") - F.col("before") - 1)))).alias("at"))
    first = (F.col("before") == 0) & (F.col("at") == 1)
    # How long a piece can be that starts with these three characters; others start none longer than two.
    head = F.substring("cut", F.col("at"), F.lit(3))
    longest = pieces.where(F.length("piece") >= 3).groupBy(F.substring("piece", 1, 3).alias("head")).agg(F.max(F.length("piece")).alias("longest"))
    reach = starts.where(first | (F.col("before") + F.col("at") < F.col("size"))).withColumn("head", head).join(F.broadcast(longest), "head", "left")
    # A unit's first character alone stands for the unit itself, also where nothing else is found.
    spans = reach.withColumn("span", F.explode(F.sequence(F.when(first, F.lit(1)).otherwise(F.lit(2)), F.least(F.coalesce("longest", F.lit(2)), F.col("size") - F.col("before") - F.col("at") + 1))))
    cut_out = spans.select("unit", (F.col("before") + F.col("at") - 1).cast("long").alias("start"), "span", F.substring("cut", F.col("at"), F.col("span")).alias("piece"))
    edges = cut_out.join(F.broadcast(pieces), "piece", "left").where("rank is not null or (start = 0 and span = 1)")
    packed = F.when(F.col("span") > 1, F.shiftleft("rank", rank_at) + F.shiftleft("start", span_bits) + F.col("span"))
    return edges.groupBy("unit").agg(F.sort_array(F.collect_list(packed)).alias("edges"), F.coalesce(F.max(F.when(F.col("span") > 1, F.col("odd"))), F.lit(False)).alias("odd"))


def fold_merges(count: int, most: int) -> Column:
    """The boundaries of a unit from its edges, for a BPE model, as bits of a long: in order of score, then from the left,
    each edge that spans two present pieces is merged. What is not ready when its turn comes never is, but for odd edges."""
    span_bits, rank_at = _widths(count, most)
    one = F.lit(1).cast("long")
    shifted = lambda by: F.call_function("shiftleft", one, by)

    def step(bounds: Column, edge: Column) -> Column:
        start = F.shiftright(edge.bitwiseAND(F.lit((1 << rank_at) - 1)), span_bits).cast("int")
        end = start + edge.bitwiseAND(F.lit((1 << span_bits) - 1)).cast("int")
        within = F.call_function("shiftright", bounds, start)
        span = end - start
        # Of the bits from start to end both ends and one between are set.
        cells = within.bitwiseAND(shifted(span + 1) - one)
        ready = (F.bit_count(cells) == 3) & (cells.bitwiseAND(one + shifted(span)) == one + shifted(span))
        return F.when(ready, bounds - F.call_function("shiftleft", cells - one - shifted(span), start)).otherwise(bounds)

    return F.aggregate("edges", shifted(F.length("unit") + 1) - one, step)


def replay(size: int, edges: list[int], count: int, most: int) -> list[int]:
    """The ends of a unit's pieces: its merges one by one, from a heap, over the edges that the lattice gives."""
    span_bits, rank_at = _widths(count, most)
    known: dict[tuple[int, int], int] = {}
    for edge in edges:
        start = (edge & ((1 << rank_at) - 1)) >> span_bits
        known[start, start + (edge & ((1 << span_bits) - 1))] = edge >> rank_at
    ends = list(range(1, size + 1))  # by start, 0 once merged away
    before = list(range(-1, size))  # the start of the piece that ends at a place
    heap = [(rank, start, start + 1, end) for (start, end), rank in known.items() if end == start + 2]
    heapq.heapify(heap)

    def offer(start: int, middle: int) -> None:
        if start >= 0 and middle < size and (rank := known.get((start, ends[middle]))) is not None:
            heapq.heappush(heap, (rank, start, middle, ends[middle]))

    while heap:
        _, start, middle, end = heapq.heappop(heap)
        if ends[start] == middle and ends[middle] == end:
            ends[start], ends[middle], before[end] = end, 0, start
            offer(before[start], start)
            offer(start, end)
    return [end for end in ends if end]


def _byte_ids(char: Column, first_byte: int) -> Column:
    code = F.hex(F.encode(char, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.octet_length(char)), lambda k: F.conv(F.substring(code, 2 * k - 1, F.lit(2)), 16, 10).cast("int") + first_byte)


def fold_viterbi(first_byte: int, unknown: float = -1e6) -> Column:
    """The ids of a word from its edges, for a unigram model: the best path, folded over the edges by their ends. On equal
    scores the shorter last piece wins."""
    best = F.array(F.struct(F.lit(0.0).alias("total"), F.array().cast("array<struct<start:int,end:int,score:double,id:int>>").alias("path")))
    by_end = F.sequence(F.lit(1), F.col("size"))

    def step(state: Column, end: Column) -> Column:
        arriving = F.transform(
            F.filter("edges", lambda e: e["end"] == end),
            lambda e: F.struct((F.element_at(state, e["start"] + 1)["total"] + F.coalesce(e["score"], F.lit(unknown))).alias("total"), e["start"].alias("start"), F.struct(e["start"].alias("start"), e["end"].alias("end"), e["score"].alias("score"), e["id"].alias("id")).alias("edge")),
        )
        top = F.array_max(arriving)
        return F.concat(state, F.array(F.struct(top["total"].alias("total"), F.concat(F.element_at(state, top["start"] + 1)["path"], F.array(top["edge"])).alias("path"))))

    return _ids(F.element_at(F.aggregate(by_end, best, step), -1)["path"], first_byte)


def _ids(kept: Column, first_byte: int) -> Column:
    return F.flatten(F.transform(kept, lambda e: F.when(e["id"].isNotNull(), F.array(e["id"])).otherwise(_byte_ids(F.substring("word", e["start"] + 1, F.lit(1)), first_byte))))


def words_of(text: Column) -> Column:
    marked = F.concat(F.lit(MARK), F.replace(text, F.lit(" "), F.lit(MARK)))
    return F.when(F.length(text) > 0, F.regexp_extract_all(marked, F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _words(text: str) -> list[str]:
    """The words of a text, each without the space mark that it begins with."""
    if MARK not in text and "  " not in f" {text} ":
        return text.split(" ")
    return [w[1:] for w in re.findall(WORD, MARK + text.replace(" ", MARK))]


def _release() -> None:
    """Gives freed Arrow memory back: a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, packed) of (block, id, text): of some PACK bytes of rows at a time, those of a block as a compressed stream."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        held.clear()
        rows = rows.take(pc.sort_indices(rows.column("block")))
        blocks, starts, counts = np.unique(rows.column("block").to_numpy(), return_index=True, return_counts=True)
        packed = []
        for start, count in zip(starts.tolist(), counts.tolist(), strict=True):
            part = rows.slice(start, count).select(["id", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=options) as stream:
                stream.write_table(part)
            packed.append(sink.getvalue().to_pybytes())
        dealt = pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], names=["block", "packed"])
        del rows, part, sink, packed
        _release()
        yield dealt

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= PACK:
            yield from flush()
    if held:
        yield from flush()


def _unpack(packed: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(packed.as_buffer()).read_all()


def _block_units(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[pa.RecordBatch]:
    """(block, unit) of (block, packed), each once, or more often where a block's words pass the room for them. Units of one
    length stand together, in order: their rows take a third less in an exchange."""
    find = re.compile(pattern).findall
    words: set[str] = set()
    last = -1

    def flush() -> Iterator[pa.RecordBatch]:
        units = pa.array(sorted(sorted({u for w in words for u in find(MARK + w)}), key=len), pa.string())
        words.clear()
        for k in range(0, len(units), 50_000):
            part = units[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), last, np.int32)), part], names=["block", "unit"])

    for batch in batches:
        for block, packed in zip(batch.column("block").to_pylist(), batch.column("packed"), strict=True):
            if block != last or len(words) > 1_000_000:
                yield from flush()
            last = block
            for cell in _unpack(packed).column("text"):
                if text := cell.as_py():
                    words.update(_words(text))
    yield from flush()
    _release()


def segment(units: DataFrame, rows: list[tuple[str, int, float]]) -> DataFrame:
    """units(unit), distinct, to (unit, bounds, edges): where the pieces of a unit meet, as bits, or else the
    edges to replay. These are text: Spark sizes a list column anew for each row that it hands to Python."""
    order = {score: rank for rank, score in enumerate(sorted({score for _, _, score in rows}, reverse=True))}
    odd = disordered({piece: score for piece, _, score in rows})
    pieces = units.sparkSession.createDataFrame([(p, order[score], p in odd) for p, _, score in rows], "piece string, rank long, odd boolean")
    most = max(len(p) for p, _, _ in rows)
    hard = F.col("odd") | (F.length("unit") > MOST_BITS - 1)
    return edges_of(units, pieces, most, len(rows)).select("unit", F.when(~hard, fold_merges(len(rows), most)).alias("bounds"), F.when(hard, F.concat_ws(" ", F.col("edges").cast("array<string>"))).alias("edges"))


def frequent_words(texts: DataFrame, most: int) -> DataFrame:
    """The most frequent words, counted over all whole texts: as many of the steps of frequency, sixteen to a doubling,
    as hold about `most` words, and of the step that would pass it the words of the smallest hashes. No order over all
    words is needed. Words that are there once are not frequent."""
    words = texts.select(F.explode(words_of(F.col("text"))).alias("word")).where(F.length("word") <= MOST_CHARS)
    counts = cut(words.groupBy("word").agg(F.floor(16 * F.log2(F.count("*").cast("double"))).cast("int").alias("step")).where("step > 0"), "words")
    # One row a step of frequency: a thousand at most.
    steps = sorted(((r["step"], r["n"]) for r in counts.groupBy("step").agg(F.count("*").alias("n")).collect()), reverse=True)
    room, last, share = most, 0, 0.0
    for step, n in steps:
        if n > room:
            last, share = step, room / n
            break
        room -= n
    hashed = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return counts.where((F.col("step") > last) | ((F.col("step") == last) & (hashed < share))).select("word")


def _unit_ids(units: pa.Table, ids_of: dict[str, int], plain: dict[int, bytes], first_byte: int, most: int) -> tuple[dict[str, bytes], set[str]]:
    """The ids of each unit as int32 bytes, and the units that these ids do not give back."""
    made: dict[str, bytes] = {}
    lossy = set()
    for unit, bounds, edges in itertools.chain.from_iterable(zip(*(b.column(c).to_pylist() for c in ("unit", "bounds", "edges")), strict=True) for b in units.to_batches()):
        if edges is not None:
            ends = replay(len(unit), list(map(int, edges.split())), len(ids_of), most)
        else:
            ends, bounds = [], bounds & ~1
            while bounds:
                ends.append((bounds & -bounds).bit_length() - 1)
                bounds &= bounds - 1
        ids: list[int] = []
        start = 0
        for end in ends:
            piece = unit[start:end]
            if piece in ids_of:
                ids.append(ids_of[piece])
            else:
                ids.extend(first_byte + b for b in piece.encode())
            start = end
        made[unit] = array("i", ids).tobytes()
        if b"".join([plain[i] for i in ids]) != unit.replace(MARK, " ").encode():
            lossy.add(unit)
    return made, lossy


def _map_texts(parts: Iterator[pa.Table], made: dict[str, bytes], lossy: set[str], pattern: str) -> Iterator[pa.Table]:
    find = re.compile(pattern).findall

    class Words(dict):
        def __missing__(self, word: str) -> bytes:
            self[word] = ids = b"".join([made[u] for u in find(MARK + word)])
            return ids

    ids_of = Words().__getitem__
    for texts in parts:
        cells, sizes, trips = [], [], []
        for cell in texts.column("text"):
            text = cell.as_py()
            words = _words(text) if text else []
            cells.append(b"".join(map(ids_of, words)))
            sizes.append(len(cells[-1]) // 4)
            trips.append(not lossy or lossy.isdisjoint(u for w in words for u in find(MARK + w)))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(cells), np.int32)))
        yield pa.table({"id": texts.column("id"), "n_tokens": pa.array(sizes, pa.int64()), "ids": lists, "round_trip": pa.array(trips, pa.bool_())})


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", dictionary: int = 0) -> DataFrame:
    """One row per input row: id_col, n_tokens, ids, round_trip.

    dictionary: about so many of the most frequent words have their units folded once for all blocks, which takes a pass
    over the texts to count them.
    """
    with open(model_path, "rb") as file:
        processor = _load(file.read())
    rows = piece_rows(processor)
    pattern = unit_pattern([p for p, _, _ in rows])
    first_byte = processor.piece_to_id("<0x00>")
    ids_of = {p: i for p, i, _ in rows}
    plain = {i: p.replace(MARK, " ").encode() for p, i, _ in rows} | {first_byte + b: bytes([b]) for b in range(256)}
    most = max(map(len, ids_of))

    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known: dict[str, bytes] = {}
    lossy: set[str] = set()
    if dictionary:
        common = frequent_words(texts, dictionary).select(F.explode(F.regexp_extract_all("word", F.lit(pattern), F.lit(0))).alias("unit")).distinct()
        known, lossy = _unit_ids(segment(common, rows).toArrow(), ids_of, plain, first_byte, most)

    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(-(-size // BLOCK), spark.sparkContext.defaultParallelism)
    placed = texts.select(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("block"), "id", "text")
    dealt = placed.mapInArrow(_pack, "block int, packed binary").repartition(2 * blocks, "block")
    units = dealt.sortWithinPartitions("block").mapInArrow(partial(_block_units, pattern=pattern), "block int, unit string").where("unit is not null")
    if known:
        units = units.join(F.broadcast(spark.createDataFrame([(u,) for u in known], "unit string")), "unit", "left_anti")
    # Both readers of this exchange ask for all of it, by the count of blocks and the filter that a join brings, so that it
    # is made once.
    met = units.repartition(2 * blocks, "unit")
    folded = segment(met.groupBy("unit").agg(F.count("block").alias("n")).where("n > 0").select("unit"), rows)
    back = met.join(folded, "unit").repartition(2 * blocks, "block")

    def work(block_texts: pa.Table, block_units: pa.Table) -> pa.Table:
        made, bad = _unit_ids(block_units, ids_of, plain, first_byte, most)
        parts = map(_unpack, itertools.chain.from_iterable(block_texts.column("packed").chunks))
        mapped = pa.concat_tables(_map_texts(parts, known | made, lossy | bad, pattern))
        _release()
        return mapped

    paired = dealt.groupBy("block").cogroup(back.groupBy("block"))
    return paired.applyInArrow(work, SCHEMA).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, spark: SparkSession, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text): ids back to text through the piece table, as a join over positions; unknown ids read as nothing."""
    processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
    byte = lambda i: bytes([int(processor.id_to_piece(i)[3:-1], 16)]) if processor.is_byte(i) else b"" if processor.is_control(i) else processor.id_to_piece(i).replace(MARK, " ").encode()
    table = spark.createDataFrame([(i, byte(i)) for i in range(processor.get_piece_size())], "piece_id int, bytes binary")
    # Written once, so that both sides of the join below have the same numbers.
    keyed = cut(tokens.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), F.col(ids_col).alias("ids")), "numbered")
    placed = keyed.select("row", F.posexplode("ids").alias("at", "piece_id")).join(F.broadcast(table), "piece_id")
    joined = placed.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", F.hex("bytes").alias("hex")))).alias("cells"))
    whole = F.decode(F.unhex(F.concat_ws("", F.transform("cells", lambda c: c["hex"]))), "UTF-8")
    made = joined.select("row", F.when(F.startswith(whole, F.lit(" ")), F.substring(whole, F.lit(2), F.length(whole))).otherwise(whole).alias("text"))
    return keyed.join(made, "row", "left").select(id_col, F.coalesce("text", F.lit("")).alias("text"))
