"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import codebooks, fingerprints, negatives
from rasterloom.llm.vectors import limit, whole_vectors

VECTORS = "vec_id long, embedding array<double>, label int"


def embeddings(n, dim, seed, labels=3):
    r = random.Random(seed)
    return [(k, [r.uniform(-1, 1) for _ in range(dim)], r.randrange(labels)) for k in range(n)]


ODD = [(900, None, 1), (901, [0.5, None] * 8, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, 1)]


# ---- whole vectors


def test_whole_vectors_are_floored_padded_and_bounded(spark):
    rows = spark.createDataFrame([(1, [0.5, -0.001]), (2, [1e30, -1e30, 0.0]), (3, []), (4, None)], "id long, vector array<double>")
    told, length = whole_vectors(rows, "t", 4)
    assert length == 4 and {r["id"]: r["vector"] for r in told.collect()} == {1: [128, -1, 0, 0], 2: [limit(4), -limit(4), 0, 0], 3: [0, 0, 0, 0]}
    assert whole_vectors(rows.limit(0), "t", 4)[0].count() == 0


# ---- 12


def _codes(rows, parts, entries, rounds):
    kept = sorted((k, [math.floor(256 * x) for x in v], label) for k, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for _, v, _ in kept:
                met.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, own in met.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out = [(k, "".join(f"{near(cut(v, p), books[p])[1]:02x}" for p in range(parts)), sum(near(cut(v, p), books[p])[0] for p in range(parts)), label) for k, v, label in kept]
    total = Counter()
    for _, _, error, label in out:
        total[label] += error
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted((k, code, error, total[label], digest) for k, code, error, label in out)


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 8, 2), (16, 64, 2), (2, 3, 0), (8, 5, 4)])
def test_codes_equal_brute_force(spark, parts, entries, rounds):
    rows = embeddings(90, 16, parts) + ODD + [(950 + k, [0.25] * 16, None) for k in range(12)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("code", F.lit("clash")).withColumn("error", F.lit(1)).repartition(5)
    assert sorted(map(tuple, codebooks.compress(df, parts=parts, entries=entries, rounds=rounds).collect())) == _codes(rows, parts, entries, rounds)


def test_equal_distances_take_the_lower_entry():
    books = np.array([[[0, 0], [2, 0], [0, 0]]])
    codes, apart = codebooks.assign(np.array([[[1, 0]], [[0, 0]], [[2, 0]]]), books)
    assert codes.tolist() == [[0], [0], [1]] and apart.tolist() == [[1], [0], [0]]


def test_a_hot_label_is_summed_whole(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 1).when(F.col("id") < 4003, F.lit(None)).otherwise(F.col("id")).cast("int").alias("label"), F.lit(2).cast("long").alias("v"))
    told = {r["label"]: (r["n"], r["v"]) for r in codebooks.summed_by(rows, "label", "v", "s").groupBy("label").agg(F.count("*").alias("n"), F.max("s").alias("v")).collect()}
    assert told[1] == (4000, 8000) and told[None] == (3, 6) and told[4500] == (1, 2) and len(told) == 999


def test_codes_of_nothing_null_ids_repeats_and_short_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert codebooks.compress(empty).count() == 0
    only_null = codebooks.compress(spark.createDataFrame([(None, [0.5] * 16, 1)], VECTORS)).collect()
    assert [tuple(r)[:4] for r in only_null] == [(None, None, None, None)]
    twice = spark.createDataFrame([(1, [0.5] * 16, 1), (1, [0.5] * 16, 1), (1, [0.25] * 16, 1), (2, [0.5] * 3, 2), (None, [0.5] * 16, 1), (3, [], 4)], VECTORS)
    told = codebooks.compress(twice, entries=2, rounds=0).collect()
    assert len(told) == 6 and all(len(r["code"]) == 32 for r in told) and {r["error"] for r in told if r["vec_id"] == 1} == {0}
    assert codebooks.compress(twice, label_col=None).select("label_error").distinct().count() == 1


def test_decoded_codes_are_as_far_as_their_error(spark):
    rows = spark.createDataFrame(embeddings(40, 16, 8), VECTORS)
    given = rows.select(F.col("vec_id").alias("id"), F.lit(1).alias("label"), F.col("embedding").alias("vector"))
    whole, length = whole_vectors(given, "t", 4)
    books = codebooks.train(whole, length, 4, 8, 2)
    told = codebooks.decode(codebooks.compress(rows, parts=4, entries=8), books).collect()
    own = {r["id"]: r["vector"] for r in whole.collect()}
    assert all(sum((a - b) ** 2 for a, b in zip(own[r["vec_id"]], r["decoded"])) == r["error"] for r in told)
    with pytest.raises(ValueError):
        codebooks.train(whole, length, 5)


# ---- 13


def _hard(rows, every, positives=5, least=3):
    kept = [(k, [math.floor(256 * x) for x in v], label) for k, v, label in rows if k is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, (a, v, label) in enumerate(kept):
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), k, other == label) for j, (k, w, other) in enumerate(kept) if j != i)
        for p, pid, _ in [s for s in scored if s[2]][:positives]:
            bad = [(s, k) for s, k, same in scored if not same and 50 * -p <= 100 * -s <= 95 * -p][:least]
            out += [(a, pid, rank, k, -p, -s) for rank, (s, k) in enumerate(bad, 1)]
    return sorted(out)


def _told(df, every, **parameters):
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("id") % every == 0, **parameters).collect()))


@pytest.mark.parametrize("cell_anchors", [1000, 4, 1])
def test_negatives_equal_brute_force(spark, cell_anchors):
    rows = embeddings(300, 6, 3) + ODD + [(None, [0.5] * 6, 1), (400, [0.1] * 6, None), (401, [0.0] * 6, 2)]
    rows += [(410 + k, [0.3, 0.2, 0.1, 0.0, -0.1, 0.5], k % 2) for k in range(40)]  # copies: ties
    df = spark.createDataFrame(rows, VECTORS).withColumn("row", F.lit(1)).withColumn("id", F.lit("clash")).repartition(4)
    assert _told(df, 5, cell_anchors=cell_anchors) == _hard(rows, 5)


def test_cells_of_clusters_are_cut_off_by_their_bounds(spark):
    r = random.Random(4)
    centres = [[r.uniform(-1, 1) for _ in range(6)] for _ in range(6)]
    rows = [(k, [c + r.gauss(0, 0.01) for c in centres[k % 6]], k % 4) for k in range(600)]
    df = spark.createDataFrame(rows, VECTORS)
    assert _told(df, 6, cell_anchors=10) == _hard(rows, 6)


def test_a_row_is_sent_to_no_cell_that_it_cannot_serve():
    pivots = np.array([[100.0, 0, 0], [-100.0, 0, 0]])
    cells = negatives.Cells(pivots, 10_000.0, 1, np.array([1, 1]), np.zeros(2), np.full((2, 2), 10_000.0), np.array([9_000.0, 9_000.0]), np.array([1e18, 1e18]))
    x = np.array([[99.0, 1], [0, 100]])
    far = cells.distances(x, False)
    assert cells.serves(far, np.zeros(2, int), np.array([1, 1])).tolist() == [[True, False], [False, False]]


def test_small_blocks_and_long_vectors_give_the_same(spark):
    rows = embeddings(120, 3, 9)
    large = [(k, [x * 1e5 for x in v], label) for k, v, label in rows]
    for own in (rows, large):
        df = spark.createDataFrame(own, VECTORS)
        want = _hard(own, 4)
        whole, length = whole_vectors(df.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("vector")).withColumn("row", F.monotonically_increasing_id()), "t")
        anchors = whole.where("id % 4 = 0")
        every = F.array(F.struct(F.lit(0).cast("long").alias("positive"), F.lit(negatives.LEAST).alias("lo"), F.lit(negatives.MOST).alias("hi")))
        some = np.array([[*r["vector"], 0] for r in anchors.limit(3).collect()], float)
        norm = max(sum(x * x for x in r["vector"]) for r in whole.collect())
        told = negatives.first_in_windows(whole, anchors.withColumn("windows", every), negatives.Cells(some, float(norm), 1), length, 5, True, anchor_block=3, row_block=7)
        ids = {r["row"]: r["id"] for r in whole.collect()}
        met = {(ids[r["anchor"]], r["id"], r["score"]) for r in told.collect()}
        assert {(a, p, s) for a, p, _, _, s, _ in want} <= met and len(met) == 5 * len({a for a, _, _ in met})


def test_negatives_of_nothing_and_of_repeated_rows(spark):
    assert _told(spark.createDataFrame([], VECTORS), 2) == []
    assert _told(spark.createDataFrame([(1, [1.0], 1)], VECTORS), 2) == []  # no anchor
    assert _told(spark.createDataFrame([(2, [1.0], 1)], VECTORS), 2) == []  # no other row
    rows = [(2, [1.0, 0.5], 1)] * 2 + [(3, [0.7, 0.4], 2)] * 2
    assert _told(spark.createDataFrame(rows, VECTORS), 2) == _hard(rows, 2) != []


# ---- 11


def _level(window):
    whole = round(32 * 5 * 2**20)
    spread = sum(round(c * math.log2(c) * 2**20) for c in Counter(window).values())
    return (whole - spread) * 1000 // whole


def _windows(text):
    return [text[i : i + 32] for i in range(len(text) - 31)]


def _selected(text, ranks):
    windows = _windows(text)
    if not windows:
        return [text] if text else []
    if len(windows) <= 160:
        return windows
    points = Counter()
    order = [ranks[_level(w)] for w in windows]
    for i in range(len(windows) - 31):
        points[min(range(i, i + 32), key=lambda k: (order[k], k))] += 1
    return [w for k, w in enumerate(windows) if points[k] >= 8]


def _filters(features):
    own = list(dict.fromkeys(features))
    out = []
    for at in range(0, len(own), 160):
        bits = set()
        for f in own[at : at + 160]:
            h = int(fingerprints._hashes(np.frombuffer(f, np.uint8), np.array([0]), len(f))[0])
            bits |= {(h >> (11 * k)) % 2048 for k in range(5)}
        out.append((len(own[at : at + 160]), bits))
    return out


def _read(fingerprint):
    held = base64.b64decode(fingerprint)
    return [(held[a], {k for k in range(2048) if held[a + 1 + k // 8] >> (7 - k % 8) & 1}) for a in range(0, len(held), 257)]


def _likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if (len(b), sum(n for n, _ in b)) < (len(a), sum(n for n, _ in a)):
        a, b = b, a
    best = lambda x, y: (len(x & y) - len(x) * len(y) / 2048) / (min(len(x), len(y)) - len(x) * len(y) / 2048)
    return sum(n * min(1, max(0, *(best(x, y) for _, y in b))) if len(b) > 1 else n * min(1, max(0, best(x, b[0][1]))) for n, x in a) / sum(n for n, _ in a)


def _prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9))) for _ in range(n))


TEXTS = [None, "", "a", "né", "x" * 31, "x" * 32, "y" * 5000, _prose(30, 1), _prose(40, 2) + "é🦆" * 3, _prose(400, 3), _prose(400, 3) + " end", _prose(2500, 4), "   \n\t", _prose(12, 5)]


def test_fingerprints_equal_brute_force(spark):
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS)], "doc_id long, text string, fingerprint string").repartition(3)
    count = Counter(_level(w) for t in TEXTS for w in _windows((t or "").encode()))
    order = sorted(range(1001), key=lambda x: (x < 100, count[x], x))
    ranks = [order.index(x) for x in range(1001)]
    assert fingerprints.level_ranks(df) == ranks
    for lot_bytes in (1 << 23, 3000):
        told = {r["doc_id"]: r for r in fingerprints.edited_neighbours(df, lot_bytes=lot_bytes).collect()}
        assert len(told) == len(TEXTS)
        for k, t in enumerate(TEXTS):
            t, follows = t or "", TEXTS[k - 1] or ""
            edited = t[: len(t) - len(t) // 3] + follows[: len(t) // 3]
            own, other, after = (_filters(_selected(x.encode(), ranks)) for x in (t, edited, follows))
            assert told[k]["n_chars"] == len(t) and told[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert _read(told[k]["fingerprint"]) == own and _read(told[k]["edited_fingerprint"]) == other
            assert told[k]["near_edited"] == pytest.approx(_likeness(own, other)) and told[k]["near_next"] == pytest.approx(_likeness(own, after))


def test_blocks_do_not_show(monkeypatch):
    text = (_prose(3000, 6) + "z" * 700).encode()
    data, ranks = np.frombuffer(text, np.uint8), np.arange(1001)[::-1]
    whole = fingerprints.levels(data), fingerprints._points(ranks[fingerprints.levels(data)]), fingerprints.digests([text, text[:500]], ranks)
    monkeypatch.setattr(fingerprints, "BLOCK", 128)
    assert (fingerprints.levels(data) == whole[0]).all() and (fingerprints._points(ranks[whole[0]]) == whole[1]).all() and fingerprints.digests([text, text[:500]], ranks) == whole[2]


def test_likeness_tells_how_much_texts_share(spark):
    a, b = _prose(1500, 7), _prose(1500, 8)
    ranks = list(range(1001))
    df = spark.createDataFrame([(a, a), (a, a[: len(a) * 2 // 3] + b[: len(a) // 3]), (a, b), (a, a[1000:4000]), (a, ""), ("", None), (a, None)], "x string, y string")
    told = [r[0] for r in df.select(fingerprints.likeness(fingerprints.fingerprint(F.col("x"), ranks), fingerprints.fingerprint(F.col("y"), ranks))).collect()]
    assert told[0] == 1 and 0.55 < told[1] < 0.8 and told[2] < 0.1 and told[3] > 0.5 and told[4] == 0 and told[5] == 1 and told[6] == 0
    one, two = (fingerprints.digests([x.encode()], np.array(ranks))[0] for x in (a, b[:900]))
    assert fingerprints.compare(one, two) == fingerprints.compare(two, one)


def test_neighbours_of_nothing_one_row_null_and_repeated_ids(spark):
    schema = "doc_id long, text string"
    assert fingerprints.edited_neighbours(spark.createDataFrame([], schema)).count() == 0
    alone = fingerprints.edited_neighbours(spark.createDataFrame([(5, "abcdef")], schema)).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and alone["near_next"] == 1
    rows = [(None, "null id"), (7, "same text"), (7, "same text"), (7, None), (1, "last one here")] + [(7, f"text {k}") for k in range(300)]
    told = fingerprints.edited_neighbours(spark.createDataFrame(rows, schema).repartition(3), lot_bytes=200)
    assert sorted(r["n_chars"] for r in told.collect()) == sorted(len(t or "") for _, t in rows)
    assert told.where("doc_id = 1").first()["edited_sha256"] == hashlib.sha256(b"last one null").hexdigest()
    hidden = told.where("doc_id is null").first()["edited_sha256"]  # after the last comes the first of the sevens
    assert hidden in {hashlib.sha256(b"null " + (t or "").encode()[:2]).hexdigest() for _, t in rows}
