"""Palettes that are data, stencils, sliding histograms, running sums and text cells against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions.metrics import METRICS
from rasterloom.functions.palettes import C64, PALETTES
from rasterloom.operators import adaptive, blocks, packing, sequential, sliding, stencil, text_cells
from rasterloom.operators import statistics as st

R = np.random.default_rng(11)
PX = "image_id long, y long, x long, r long, g long, b long"


def raster(spark, images, height, width, levels=256):
    data = R.integers(0, levels, (images, height, width, 3))
    rows = [(i, y, x, *map(int, data[i, y, x])) for i in range(images) for y in range(height) for x in range(width)]
    return data, spark.createDataFrame(rows, PX).repartition(3)


# ---- matching


def test_nearest_in_equals_a_look_at_all_entries(spark):
    data, df = raster(spark, 2, 20, 20)
    tables = {0: R.integers(0, 256, (200, 3)), 1: np.concatenate([R.integers(90, 110, (6, 3)).repeat(2, axis=0), [[0, 0, 0], [255, 255, 255]]])}
    rows = [(i, k, *map(float, c)) for i, t in tables.items() for k, c in enumerate(t)]
    palettes = spark.createDataFrame(rows, "image_id long, idx long, r double, g double, b double")
    for side in (8, 32, 256):
        told = adaptive.nearest_in(df, palettes, side=side).collect()
        assert len(told) == 800
        for p in told:
            assert p["idx"] == ((tables[p["image_id"]] - data[p["image_id"], p["y"], p["x"]]) ** 2).sum(axis=1).argmin()
    few = adaptive.candidate_entries(df, palettes, ("image_id",), 32).where("image_id = 0").agg(F.avg(F.size("near"))).first()[0]
    assert few < 60  # of 200


def test_nearest_in_of_other_metrics_null_keys_and_nothing(spark):
    df = spark.createDataFrame([(None, 0, 0, 10, 10, 10), (1, 0, 0, 10, 10, 10), (2, 0, 0, 1, 1, 1)], PX)
    palettes = spark.createDataFrame([(None, 0, 200, 200, 200), (None, 1, 9, 9, 9), (1, 5, 10, 10, 10), (1, 3, 10, 10, 10)], "image_id long, idx long, r long, g long, b long")
    want = {(None, 1), (1, 3)}  # image 2 has no palette; of equal entries the lowest index
    for metric in METRICS:
        assert {(p["image_id"], p["idx"]) for p in adaptive.nearest_in(df, palettes, metric=metric).collect()} == want
    assert adaptive.nearest_in(df.limit(0), palettes).count() == adaptive.nearest_in(df, palettes.limit(0)).count() == 0


@pytest.mark.parametrize("order", ["widest", "fifo"])
@pytest.mark.parametrize(("levels", "colours"), [(256, 16), (3, 16), (1, 4), (20, 5), (256, 1)])
def test_median_cut_equals_the_boxes_one_by_one(spark, order, levels, colours):
    data, df = raster(spark, 2, 9, 7, levels)
    told = adaptive.median_cut(df, colours, order).orderBy("image_id", "idx").collect()
    for i in range(2):
        own = np.array([[p["r"], p["g"], p["b"]] for p in told if p["image_id"] == i])
        assert np.allclose(own, sequential.median_cut(data[i].reshape(-1, 3).astype(float), colours, order))


def test_median_cut_of_nothing(spark):
    assert adaptive.median_cut(spark.createDataFrame([], PX), 4).count() == 0
    with pytest.raises(ValueError):
        adaptive.median_cut(spark.createDataFrame([], PX), 4, "longest")


def test_reuse_equals_the_walk_over_an_image(spark):
    data, df = raster(spark, 2, 12, 10)
    smooth = df.withColumns({c: F.when(F.col("y") < 6, F.col(c) % 40).otherwise(F.col(c)) for c in "rgb"})
    palettes = adaptive.median_cut(smooth, 4, "fifo", ("image_id", "y"))
    for tolerance in (0.0, 20.0, 1e9):
        told = {(p["image_id"], p["y"]): (p["owner"], round(p["error"], 9)) for p in adaptive.reuse_palettes(smooth, palettes, tolerance).collect()}
        want = {(p["image_id"], p["y"]): (p["owner"], round(p["error"], 9)) for p in sequential.line_palettes(smooth, 4, tolerance).collect()}
        assert tolerance == 0.0 and all(o == y for (_, y), (o, _) in told.items()) or told == want


def test_slots_by_first_sight_and_by_runs(spark):
    owners = spark.createDataFrame([(0, y, o) for y, o in enumerate([0, 0, 2, 3, 3, 5, 6])], "image_id long, y long, owner long")
    entries = {0: 10.2, 2: 20.0, 3: 10.9, 5: 30.0, 6: 20.4}  # cut to whole numbers, 0 and 3 are one, and 2 and 6
    palettes = spark.createDataFrame([(0, o, 0, v, 0.0, 0.0) for o, v in entries.items()], "image_id long, y long, idx long, r double, g double, b double")
    told = {p["y"]: (p["slot"], p["slot_owner"]) for p in adaptive.palette_slots(owners, palettes, 16).collect()}
    assert told == {0: (0, 0), 1: (0, 0), 2: (1, 2), 3: (0, 0), 4: (0, 0), 5: (2, 5), 6: (1, 2)}
    full = {p["y"]: (p["slot"], p["slot_owner"]) for p in adaptive.palette_slots(owners, palettes, 2).collect()}
    assert full == {0: (0, 0), 1: (0, 0), 2: (0, 0), 3: (1, 5), 4: (1, 5), 5: (1, 5), 6: (1, 5)}


# ---- stencils


def test_stencils_equal_sums_around_and_use_one_exchange(spark):
    data, df = raster(spark, 2, 11, 13)
    for kernel, parameters in (("sharpen", {}), ("sharpen", {"strength": 0.3}), ("emboss", {"depth": 0.7, "offset": 128.0})):
        k = np.array(stencil.KERNELS[kernel])
        told = stencil.filtered(df, kernel, keys=("image_id",), **parameters).collect()
        assert len(told) == 2 * 11 * 13
        for p in told:
            i, y, x = p["image_id"], p["y"], p["x"]
            own = data[i, y, x].astype(float)
            if 0 < y < 10 and 0 < x < 12:
                conv = (data[i, y - 1 : y + 2, x - 1 : x + 2] * k[:, :, None]).sum(axis=(0, 1)) * parameters.get("depth", 1.0)
                own = np.clip(own + (conv - own) * parameters.get("strength", 1.0) + parameters.get("offset", 0.0), 0, 255)
            assert np.allclose([p["r"], p["g"], p["b"]], own)
    for made in (stencil.edges(df, 100.0, ("image_id",)), stencil.sobel(df, keys=("image_id",)), stencil.filtered(df, "box", keys=("image_id",))):
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("side", [2, 4, 128])
def test_tiles_do_not_show(spark, side):
    data, df = raster(spark, 1, 9, 10)
    held, tap, whole = stencil.neighbourhoods(df, ("g",), side=side)
    told = held.select("y", "x", whole.alias("whole"), *[F.coalesce(tap(dy, dx, "g"), F.lit(-1)).alias(f"t{3 * dy + dx + 4}") for dy in (-1, 0, 1) for dx in (-1, 0, 1)]).collect()
    padded = np.pad(data[0, :, :, 1], 1, constant_values=-1)
    assert len(told) == 90
    for p in told:
        near = padded[p["y"] : p["y"] + 3, p["x"] : p["x"] + 3].reshape(-1)
        assert [p[f"t{k}"] for k in range(9)] == near.tolist() and p["whole"] == bool((near >= 0).all())


def test_missing_pixels_are_no_neighbours(spark):
    df = spark.createDataFrame([(0, y, x, 9, 9, 9) for y in range(5) for x in range(5) if (y, x) != (1, 2)], PX)
    told = {(p["y"], p["x"]): p["r"] for p in stencil.filtered(df, "box").collect()}
    assert told[(2, 2)] == 9 and told[(3, 2)] == 81


# ---- sliding windows


@pytest.mark.parametrize(("window", "side"), [(5, 8), (40, 64), (1, 4), (12, 6)])
def test_ranks_in_windows(spark, window, side):
    data, df = raster(spark, 2, 23, 17)
    told = sliding.window_rank(df, window, "r", ("image_id",), side).collect()
    assert len(told) == 2 * 23 * 17
    k = window // 2
    for p in told:
        own = data[p["image_id"], :, :, 0]
        near = own[max(p["y"] - k, 0) : p["y"] + k + 1, max(p["x"] - k, 0) : p["x"] + k + 1]
        assert (p["below"], p["size"]) == ((near <= own[p["y"], p["x"]]).sum(), near.size)


def carried(levels, window):
    """The carried histogram pixel by pixel."""
    height, width = levels.shape
    half, bins = window // 2, np.zeros(256, int)
    np.add.at(bins, levels[:half, :window].reshape(-1), 1)
    out = {}
    for y in range(height):
        rows = slice(max(0, y - half), min(height, y + half))
        for x in range(width):
            out[(y, x)] = (bins[: levels[y, x] + 1].sum(), bins.sum())
            if x + half < width:
                np.add.at(bins, levels[rows, x + half], 1)
            if x - half >= 0:
                np.add.at(bins, levels[rows, x - half], -1)
    return out


@pytest.mark.parametrize(("window", "band"), [(6, 4), (40, 5), (8, 64), (3, 1)])
def test_carried_histograms_over_bands(spark, window, band):
    data, df = raster(spark, 2, 21, 19)
    told = sliding.carried_rank(df, window, ("image_id",), band).collect()
    assert len(told) == 2 * 21 * 19
    for i in range(2):
        levels = np.floor(0.299 * data[i, :, :, 0] + 0.587 * data[i, :, :, 1] + 0.114 * data[i, :, :, 2]).astype(int)
        want = carried(levels, window)
        assert all((p["below"], p["size"]) == want[(p["y"], p["x"])] for p in told if p["image_id"] == i)


def test_medians_and_sigma_of_all_channels_by_image(spark):
    data, df = raster(spark, 2, 7, 9)
    for p in st.median(df, 1, keys=("image_id",)).collect():
        e = np.pad(data[p["image_id"]], ((1, 1), (1, 1), (0, 0)), mode="edge")[p["y"] : p["y"] + 3, p["x"] : p["x"] + 3].reshape(9, 3)
        assert [p["r"], p["g"], p["b"]] == np.median(e, axis=0).tolist()


# ---- running sums and blocks


def test_running_sums_of_a_hot_key_spread(spark):
    rows = [(None if k % 3 == 0 else "hot", k, k % 7) for k in range(4000)] + [("cold", 5, 2), ("cold", 4, 1)]
    df = spark.createDataFrame(rows, "disk string, ord long, v long").repartition(3)
    told = blocks.running_sum(df, "v", ("ord",), ("disk",), ranges=8).collect()
    assert len(told) == len(rows)
    for key in (None, "hot", "cold"):
        own = sorted((r["ord"], r["v"], r["upto"]) for r in told if r["disk"] == key)
        assert [u for _, _, u in own] == np.cumsum([v for _, v, _ in own]).tolist()
    assert blocks.running_sum(df.limit(0), "v", ("ord",)).count() == 0


def test_chains_skip_reserved_ranges_and_end_with_the_disk(spark):
    sizes = [300, 0, 125, 126, 1, 900, 5000]
    df = spark.createDataFrame([(d, k, n) for d in range(2) for k, n in enumerate(sizes)], "disk_id long, ord long, size long")
    told = sorted(map(tuple, blocks.chains(df, "size", 125, "ord", first=4, end=30, reserved=((6, 8), (11, 11))).where("disk_id = 1").collect()), key=lambda r: (r[1], r[2]))
    free = [b for b in range(4, 80) if not 6 <= b <= 8 and b != 11]
    want, at = [], 0
    for k, n in enumerate(sizes):
        need = -(-n // 125)
        for nth in range(need):
            if free[at] < 30:
                want.append((1, k, nth, free[at], free[at + 1] if nth < need - 1 else None, min(125, n - 125 * nth)))
            at += 1
    assert told == want


def test_tracks_of_a_disk(spark):
    track, sector = blocks.track_sector(F.col("id"), blocks.ZONES_1541)
    told = spark.range(684).select("id", track.alias("t"), sector.alias("s")).orderBy("id").collect()
    want = [(t, s) for t in range(1, 36) for s in range(21 if t < 18 else 19 if t < 25 else 18 if t < 31 else 17)]
    assert [(r["t"], r["s"]) for r in told[:683]] == want and told[683]["t"] is None


def test_unique_names_of_both_forms(spark):
    df = spark.createDataFrame([(k, n) for k, n in enumerate(["a long file name", "A LONG file name", "b", "a long file name", None])], "ord long, name string")
    assert [r["unique"] for r in blocks.unique_names(df, "name", "ord").orderBy("ord").collect()] == ["a long file name", "A LONG file name_2", "b", "a long file name_3", None]
    assert [r["unique"] for r in blocks.unique_names(df, "name", "ord", separator=".", keep=13).orderBy("ord").collect()][:4] == ["a long file name", "A LONG file n.1", "b", "a long file n.2"]


# ---- text cells


def test_text_cells_by_hand(spark):
    rows = [(0, y, x, *((255, 255, 255) if y < 4 else (0, 0, 0))) for y in range(8) for x in range(8)] + [(0, y, 8 + x, 0, 0, 0) for y in range(8) for x in range(8)]
    told = {r["cx"]: r for r in text_cells.text_cells(spark.createDataFrame(rows, PX), PALETTES["cga16"], ("image_id",)).collect()}
    assert (told[0]["code"], told[0]["fg"], told[0]["bg"], told[0]["distance"]) == (223, 15, 0, 0)
    assert (told[1]["code"], told[1]["fg"], told[1]["bg"]) == (32, 15, 0)
    font = [(k, p) for k, p in enumerate((0, 0xFFFFFFFF00000000, (1 << 64) - 1))]
    told = {r["cx"]: r for r in text_cells.character_cells(spark.createDataFrame(rows, PX), C64, font).collect()}
    assert (told[0]["code"], told[0]["fg"], told[0]["bg"]) == (1, 1, 0) and (told[1]["code"], told[1]["fg"]) == (0, 1)


def test_charset_beyond_its_size_takes_the_nearest(spark):
    cells = spark.createDataFrame([(k, p) for k, p in enumerate([0, 0, 7, 1, 255, 6])], "cell long, pattern long")
    told = {r["cell"]: (r["code"], r["distance"]) for r in packing.charset(cells, "cell", 2).collect()}
    assert told == {0: (0, 0), 1: (0, 0), 2: (1, 0), 3: (0, 1), 4: (1, 5), 5: (1, 1)}
