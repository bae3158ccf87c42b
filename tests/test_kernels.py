"""Sequential kernels, encoders and disks against small models and invariants."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.functions import disks, encoders
from rasterloom.functions.palettes import BBC, PALETTES
from rasterloom.operators import color, machines, packing, sequential
from rasterloom.sources.disks import build_disks, list_disks
from rasterloom.sources.rasters import decode_image, pixels

RNG = np.random.default_rng(3)
IMAGE = RNG.integers(0, 256, (20, 30, 3)).astype(float)
COLOURS = np.array(BBC, float)


def test_diffusion_without_amount_is_nearest_match():
    plain = ((IMAGE[:, :, None] - COLOURS) ** 2).sum(axis=3).argmin(axis=2)
    assert (sequential.diffuse_array(IMAGE, COLOURS, amount=0.0) == plain).all()


def test_floyd_steinberg_by_hand():
    black_white = np.array([[0, 0, 0], [255, 255, 255]], float)
    row = np.full((1, 4, 3), 100.0)
    # 100 -> 0, error 100; 143.75 -> 255, error -111.25; 51.33 -> 0, error 51.33; 122.46 -> 0
    assert sequential.diffuse_array(row, black_white).tolist() == [[0, 1, 0, 0]]


@pytest.mark.parametrize("kernel", sequential.DIFFUSION)
def test_diffusion_keeps_the_mean(kernel):
    grey = np.full((40, 40, 3), 96.0)
    out = sequential.diffuse_array(grey, np.array([[0, 0, 0], [255, 255, 255]], float), kernel)
    assert abs(out.mean() * 255 - 96) < 16


def test_diffusion_in_cells_keeps_errors_inside():
    left = sequential.diffuse_array(IMAGE[:, :8], COLOURS, cell=(8, 8))
    assert (sequential.diffuse_array(IMAGE[:16, :16], COLOURS, cell=(8, 8))[:, :8] == left[:16]).all()


def test_hold_and_modify_row_reaches_any_colour_in_three_pixels():
    want = np.tile([[34.0, 68.0, 102.0]], (3, 1))
    _, colours = sequential.ham_row(want, np.zeros((1, 3)), 4)
    assert (colours[-1] == [34, 68, 102]).all()


def test_hold_fold_equals_the_row_kernel(spark):
    rows = [(0, y, x, *map(int, IMAGE[y, x])) for y in range(4) for x in range(12)]
    df = spark.createDataFrame(rows, "image_id long, y long, x long, r long, g long, b long")
    folded = {r["y"]: r["codes"] for r in sequential.hold_fold(df, PALETTES["cga16"]).collect()}
    for y in range(4):
        assert folded[y] == sequential.ham_row(IMAGE[y, :12], np.array(PALETTES["cga16"], float), 4)[0].tolist()


@pytest.mark.parametrize("order", ["widest", "fifo"])
def test_median_cut_boxes_cover_all_points(order):
    made = sequential.median_cut(IMAGE.reshape(-1, 3), 16, order)
    assert made.shape == (16, 3)
    assert np.allclose(sequential.median_cut(np.tile([[1.0, 2.0, 3.0]], (5, 1)), 4, order), [1, 2, 3])


def scan(image, palette, kernel, amount=1.0, whole=False):
    """Error diffusion pixel by pixel, row by row."""
    taps, total = sequential.DIFFUSION[kernel]
    work = np.trunc(image) if whole else image.astype(float).copy()
    out = np.zeros(image.shape[:2], int)
    for y in range(len(work)):
        for x in range(work.shape[1]):
            want = np.clip(work[y, x], 0, 255)
            out[y, x] = ((palette - want) ** 2).sum(axis=1).argmin()
            error = want - palette[out[y, x]]
            for dx, dy, weight in taps:
                if 0 <= x + dx < work.shape[1] and y + dy < len(work):
                    work[y + dy, x + dx] += np.trunc(error * (weight / total * amount)) if whole else error * (amount / total) * weight
    return out


@pytest.mark.parametrize("kernel", sequential.DIFFUSION)
def test_wavefronts_equal_the_scan(kernel):
    r = np.random.default_rng(5)
    for height, width in ((1, 1), (1, 9), (9, 1), (13, 17), (24, 6)):
        image = r.integers(0, 256, (height, width, 3)).astype(float)
        for whole in (False, True):
            assert (sequential.diffuse_array(image, COLOURS, kernel, 0.75, whole=whole) == scan(image, COLOURS, kernel, 0.75, whole)).all()


@pytest.mark.parametrize(("kernel", "whole", "band"), [("floyd_steinberg", False, 4), ("stucki", False, 3), ("atkinson", True, 5), ("jarvis_judice_ninke", False, 64), ("burkes", True, 1)])
def test_bands_equal_the_scan(spark, kernel, whole, band):
    images = np.random.default_rng(9).integers(0, 256, (2, 13, 11, 3)).astype(float)
    images = [images[0], images[1][:6]]
    rows = [(None if k else 7, y, x, *map(int, i[y, x])) for k, i in enumerate(images) for y in range(len(i)) for x in range(11)]
    df = spark.createDataFrame(rows, "image_id long, y long, x long, r long, g long, b long").repartition(3)
    told = sequential.diffuse_bands(df, BBC, kernel, 0.75, band=band, whole=whole).collect()
    assert len(told) == len(rows)
    for key, image in zip((7, None), images, strict=True):
        want = scan(image, COLOURS, kernel, 0.75, whole)
        assert all(p["idx"] == want[p["y"], p["x"]] for p in told if p["image_id"] == key)
    assert sequential.diffuse_bands(df.limit(0), BBC).count() == 0


def test_bands_without_pixels_and_a_short_last_line(spark):
    image = np.random.default_rng(2).integers(0, 256, (17, 7, 3)).astype(float)
    image[5:12], image[16, 1:] = 0, 0
    rows = [(y, x, *map(int, image[y, x])) for y in range(17) for x in range(7) if not 5 <= y < 12 and (y < 16 or x < 1)]
    df = spark.createDataFrame(rows, "y long, x long, r long, g long, b long")
    want = scan(image, COLOURS, "stucki")
    told = sequential.diffuse_bands(df, BBC, "stucki", keys=(), band=2).collect()
    assert {(p["y"], p["x"]): p["idx"] for p in told} == {(y, x): want[y, x] for y in range(17) for x in range(7)} and len(told) == 17 * 7


def test_jobs_do_not_grow_with_bands(spark):
    image = np.random.default_rng(4).integers(0, 256, (90, 4, 3)).astype(float)
    rows = [(0, y, x, *map(int, image[y, x])) for y in range(90) for x in range(4)]
    df = spark.createDataFrame(rows, "image_id long, y long, x long, r long, g long, b long")
    spark.sparkContext.setJobGroup("bands", "bands")
    told = sequential.diffuse_bands(df, BBC, "burkes", band=1).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("bands")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = scan(image, COLOURS, "burkes")
    assert all(p["idx"] == want[p["y"], p["x"]] for p in told) and len(told) == 360
    assert 0 < len(jobs) < 30


def test_error_stays_in_its_line_where_the_palette_changes():
    image = np.full((4, 6, 3), 100.0)
    tables = np.array([[(0, 0, 0), (255, 255, 255)], [(0, 0, 0), (200, 200, 200)]], float)
    told = sequential.diffuse_array(image, tables, slots=np.array([0, 1, 1, 0]))
    one = sequential.diffuse_array(image[:1], tables[0])
    two = sequential.diffuse_array(image[1:3], tables[1])
    assert (told[:1] == one).all() and (told[1:3] == two).all() and (told[3:] == one).all()


def test_line_palettes_with_zero_tolerance_never_keep_one(spark):
    rows = [(0, y, x, *map(int, IMAGE[y, x])) for y in range(5) for x in range(30)]
    df = spark.createDataFrame(rows, "image_id long, y long, x long, r long, g long, b long")
    assert [r["owner"] for r in sequential.line_palettes(df, 4, 0.0).orderBy("y").collect()] == [0, 1, 2, 3, 4]
    assert {r["owner"] for r in sequential.line_palettes(df, 4, 1e9).collect()} == {0}


@given(st.binary(max_size=300))
@settings(max_examples=60, deadline=None)
def test_pcx_runs_round_trip(line):
    assert encoders.pcx_unpack(encoders.pcx_line(line), len(line)) == line


@pytest.mark.parametrize("length", [1, 62, 63, 64, 126])
def test_pcx_run_lengths(length):
    assert len(encoders.pcx_line(b"\x05" * length)) == {1: 1, 62: 2, 63: 2, 64: 3, 126: 4}[length]
    assert encoders.pcx_line(b"\xc0") == b"\xc1\xc0"


SIZES = {
    "zx_hires": 6912, "c64_hires": 9002, "c64_multicolour": 10003, "msx_screen2": 13063, "msx_screen8": 54279, "amiga500_standard": 51364, "amiga1200_standard": 82756,
    "atarist_low": 32034, "atarist_medium": 32034, "atarist_high": 32034, "iigs_320": 32768, "cpc_mode0": 16512, "cpc_mode1": 16512, "coco_coco3": 32000, "coco_coco3_4": 32000, "coco_pmode1": 3072,
    "coco_pmode2": 3072, "coco_pmode3": 6144, "coco_pmode4": 6144, "atari800_gr8": 7682, "atari800_gr9": 7696, "atari800_gr10": 7689, "atari800_gr11": 7696, "atari800_gr15": 7684,
    "iigs_256": 32768, "iigs_brooks": 38400, "bbc_mode0": 20483, "bbc_mode1": 20485, "bbc_mode2": 20489, "bbc_mode4": 10243, "bbc_mode5": 10245, "msx_screen5": 27175,
}


@pytest.mark.parametrize("mode", SIZES)
def test_file_sizes(mode):
    grid, palette, data = machines.convert_array(IMAGE, machines.MODES[mode])
    assert len(data) == SIZES[mode]
    assert grid.max() < len(palette)


def test_registers_and_palettes_at_the_end_of_files():
    from rasterloom.functions.palettes import BBC as COLOURS, PALETTES

    grid, palette, data = machines.convert_array(IMAGE, machines.MODES["atari800_gr15"])
    assert [PALETTES["atari128"][(b >> 4) * 8 + (b >> 1 & 7)] for b in data[-4:]] == [tuple(c) for c in palette]
    assert data[0] == grid[0, 0] << 6 | grid[0, 1] << 4 | grid[0, 2] << 2 | grid[0, 3]
    grid, palette, data = machines.convert_array(IMAGE, machines.MODES["bbc_mode5"])
    assert data[-5] == 5 and [COLOURS[b] for b in data[-4:]] == [tuple(c) for c in palette]
    grid, palette, data = machines.convert_array(IMAGE, machines.MODES["msx_screen5"])
    assert data[:7] == b"\xfe\0\0" + (27167).to_bytes(2, "little") + b"\0\0" and data[39] == grid[0, 0] << 4 | grid[0, 1]


def test_text_screens_end_in_a_record():
    grid, _, data = machines.convert_array(IMAGE, machines.MODES["pc_ansi"])
    assert grid.shape == (50, 80) and data[-129:-121] == b"\x1aSAUCE00" and data.count(b"\xdf") == 80 * 25 and data.count(b"\r\n") == 25


def test_assets_are_written_and_failures_are_rows(spark, tmp_path):
    from rasterloom.sources.disks import write_files

    rows = spark.createDataFrame([("a.bin", bytearray(b"one")), ("b.bin", bytearray(b"two")), ("no/such/c.bin", bytearray(b"x"))], "name string, content binary")
    told = {r["name"]: r["error"] for r in write_files(rows, str(tmp_path / "out")).collect()}
    assert told["a.bin"] is None and told["b.bin"] is None and told["no/such/c.bin"]
    assert (tmp_path / "out" / "a.bin").read_bytes() == b"one"


def test_most_frequent_colours():
    image = np.array([[[250, 0, 0]] * 3 + [[0, 250, 0]] * 2 + [[3, 3, 3]]], float)
    table = np.array([(0, 0, 0), (255, 0, 0), (0, 255, 0)])
    assert machines.frequent(image, table, 2) == [(255, 0, 0), (0, 255, 0)]
    assert machines.frequent(image[:, :3], table, 3) == [(255, 0, 0), (0, 0, 0), (0, 0, 0)]


def test_brooks_size():
    assert len(encoders.brooks(np.zeros((200, 320), int), [BBC * 2] * 200)) == 38400


def test_images_decode_as_they_were_encoded(spark):
    rgb = IMAGE.astype(int)
    for data in (encoders.bmp24(rgb), encoders.png(rgb)):
        width, height, rgba = decode_image(data)
        assert (width, height) == (30, 20)
        assert (np.frombuffer(rgba, np.uint8).reshape(20, 30, 4)[..., :3] == rgb).all()
    df = pixels(spark.createDataFrame([("a", bytearray(encoders.png(rgb)))], "image_id string, content binary"))
    assert df.count() == 600


def test_a_failing_image_is_a_row_with_an_error(spark):
    df = spark.createDataFrame([("bad", 0, -5, 1.0, 1.0, 1.0), ("good", 0, 0, 1.0, 1.0, 1.0)], "image_id string, y long, x long, r double, g double, b double")
    told = {r["image_id"]: r for r in machines.convert(df, "zx_hires").collect()}
    assert told["bad"]["error"] and told["bad"]["content"] is None
    assert told["good"]["error"] is None and len(told["good"]["content"]) == 6912


FILES = [(f"F{k}.TXT", bytes([k]) * (700 * k + 1)) for k in range(9)]


@pytest.mark.parametrize("system", ["acorn_dfs", "amiga_ofs", "atari_dos", "coco_dos", "prodos", "pc_1440", "st_720", "msx_720"])
def test_disks_list_what_they_store(system):
    image, stored = disks.BUILDERS[system](FILES)
    listed = disks.LISTINGS[system](image)
    assert stored == [n for n, _ in FILES]
    assert sorted(s for _, s in listed) == [len(d) for _, d in FILES]


def test_commodore_disk_counts_blocks_and_holds_more_than_eight_files():
    image, _ = disks.commodore_1541(FILES)
    assert len(image) == 174848
    assert [b for _, b in disks.list_commodore_1541(image)] == [max(1, -(-len(d) // 254)) for _, d in FILES]


def test_cpm_extents_are_summed(spark):
    rows = [(1, 0, "BIG.BIN", bytearray(40000)), (1, 1, "SMALL.BIN", bytearray(100))]
    built = build_disks(spark.createDataFrame(rows, "disk_id long, ord long, name string, content binary"), "cpc_data")
    assert built.first()["size_bytes"] == 194816
    assert {r["name"]: r["size"] for r in list_disks(built, "cpc_data").collect()} == {"BIG.BIN": 40064, "SMALL.BIN": 128}


def test_heads_of_images_and_pasted_ones(spark, tmp_path):
    import struct as st
    import zlib

    from rasterloom.sources import rasters

    r = np.random.default_rng(6)
    grid = r.integers(0, 256, (7, 5, 4), dtype=np.uint8)
    chunk = lambda name, body: st.pack(">I", len(body)) + name + body + st.pack(">I", zlib.crc32(name + body))
    lines, above = b"", np.zeros((5, 4), int)
    for y, row in enumerate(grid.astype(int)):
        left, corner = np.vstack([np.zeros((1, 4), int), row[:-1]]), np.vstack([np.zeros((1, 4), int), above[:-1]])
        p = left + above - corner
        gaps = np.stack([abs(p - left), abs(p - above), abs(p - corner)])
        paeth = np.choose(gaps.argmin(axis=0), [left, above, corner])
        guess = [0 * row, left, above, (left + above) // 2, paeth][y % 5]
        lines += bytes([y % 5]) + ((row - guess) & 255).astype(np.uint8).tobytes()
        above = row
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", st.pack(">IIBBBBB", 5, 7, 8, 6, 0, 0, 0)) + chunk(b"pHYs", st.pack(">IIB", 5906, 5906, 1)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert rasters.decode_image(png) == (5, 7, grid.tobytes())
    bmp = encoders.bmp24(grid[..., :3].astype(int))
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.bmp").write_bytes(bmp)
    (tmp_path / "c.txt").write_bytes(b"no image")
    images = rasters.read_images(spark, str(tmp_path)).unionByName(rasters.pasted(spark, [("clip", png)]))
    heads = rasters.metadata(images).join(images, "image_id").collect()
    told = {h["name"]: (h["format"], h["width"], h["height"], h["bits_per_pixel"], h["color_space"], h["dpi"], h["has_alpha"]) for h in heads}
    assert told == {"a.png": ("PNG", 5, 7, 32, "RGB", 150, True), "clip": ("Clipboard", 5, 7, 32, "RGB", 150, True), "b.bmp": ("BMP", 5, 7, 24, "RGB", told["b.bmp"][5], False), "c.txt": ("TXT", None, None, None, None, None, None)}
    got = {(p["y"], p["x"]): (p["r"], p["g"], p["b"]) for p in rasters.pixels(images.where("name = 'b.bmp'")).collect()}
    assert got == {(y, x): tuple(int(v) for v in grid[y, x, :3]) for y in range(7) for x in range(5)}


def test_double_sided_commodore_disks():
    files = [(f"F{k}", bytes([k]) * 9000) for k in range(40)]
    for kind, size, room in (("1571", 349696, 1328), ("1581", 819200, 3160)):
        disk = disks.Commodore(kind)
        image, stored = disk.build(files)
        need = -(-9000 // 254)
        assert len(image) == size and len(stored) == min(40, -(-room // need)) and sum(b for _, b in disk.listing(image)) == min(room, 40 * need)
        chain, (track, sector) = b"", image[disk.place(disk.track, disk.first) + 3 :][:2]
        while track:
            spot = disk.place(track, sector)
            track, sector = image[spot], image[spot + 1]
            chain += image[spot + 2 : spot + 256 if track else spot + sector + 1]
        assert chain == files[0][1]


def test_second_side_takes_what_the_first_does_not():
    files = [(f"F{k}", bytes(5000)) for k in range(50)]
    image, stored = disks.acorn_double(files)
    assert len(image) == 409600 and len(stored) == 50 and len(disks.list_acorn_double(image)) == 50 and image[261] == 31 * 8


def test_full_disks_skip_or_stop():
    files = [("A.BIN", bytes(300_000)), ("B.BIN", bytes(500_000)), ("C.BIN", bytes(1000))]
    assert disks.fat12(files, "pc_720")[1] == ["A.BIN", "C.BIN"]
    assert disks.trdos(files)[1] == []
    assert disks.commodore_1541(files)[1] == ["A.BIN"]


@pytest.mark.parametrize(("name", "size"), [("commodore_1541", 174848), ("amiga_ofs", 901120), ("trdos", 655360), ("cpc_data", 194816), ("pc_1440", 1474560)])
def test_disk_sizes(name, size):
    assert len(disks.BUILDERS[name]([])[0]) == size


def test_amiga_blocks_sum_to_zero():
    image, _ = disks.amiga_ofs(FILES)
    root = image[880 * 512 : 881 * 512]
    assert sum(int.from_bytes(root[k : k + 4], "big") for k in range(0, 512, 4)) & 0xFFFFFFFF == 0


def test_directory_hash_agrees_with_the_column(spark):
    names = ["F1.TXT", "readme", "A"]
    df = spark.createDataFrame([(n,) for n in names], "name string").select(packing.name_hash(__import__("pyspark").sql.functions.col("name")).alias("h"))
    assert [r["h"] for r in df.collect()] == [disks.amiga_hash(n) for n in names]


@pytest.mark.parametrize("size", [0, 511, 512, 513, 131072, 131073, 400000])
def test_prodos_files_come_back(size):
    data = RNG.integers(0, 256, size).astype(np.uint8).tobytes()
    image, _ = disks.prodos([("ONE", b"x" * 700), ("TWO", data)])
    assert disks.extract_prodos(image, "two") == data and disks.extract_prodos(image, "three") is None


def test_atari_disk_cuts_the_last_file_short():
    image, stored = disks.atari_dos([("A.BIN", bytes(60000)), ("B.BIN", bytes(60000))])
    assert len(image) == 16 + 720 * 128 and stored == ["A.BIN", "B.BIN"]
    listed = dict(disks.list_atari_dos(image))
    assert listed["A.BIN"] == 60000 and 0 < listed["B.BIN"] < 60000


def test_basic_lines_by_hand(spark):
    from rasterloom.functions import basic

    assert len(basic.KEYWORDS) == 107
    assert basic.tokenise_line('print "To" : goto 10') == b'\xba"To":\xab10'
    assert basic.tokenise_line("HGR2:REM print it") == b"\x90:\xb2 print it"
    assert basic.tokenise_line('DATA a b,"x:y":END') == b'\x83 a b,"x:y":\x80'
    assert basic.tokenise("10 END\n20 HOME") == b"\x07\x08\x0a\x00\x80\x00\x0d\x08\x14\x00\x97\x00\x00\x00"
    df = spark.createDataFrame([("a", "10 END"), ("b", None)], "name string, text string")
    told = {r["name"]: r["content"] for r in basic.tokenise_programs(df).collect()}
    assert told == {"a": bytearray(b"\x07\x08\x0a\x00\x80\x00\x00\x00"), "b": None}
    assert basic.tokenise(basic.slideshow(["A", "B"]))[-2:] == b"\0\0"


def test_noise_is_bounded_spread_and_the_same_again(spark):
    df = spark.createDataFrame([(y, x, 128, 128, 128) for y in range(64) for x in range(64)], "y long, x long, r long, g long, b long")
    one = {(p["y"], p["x"]): (p["r"], p["g"], p["b"]) for p in color.noise_dither(df).collect()}
    again = {(p["y"], p["x"]): (p["r"], p["g"], p["b"]) for p in color.noise_dither(df.repartition(3)).collect()}
    shifts = np.array([v[0] - 128 for v in one.values()])
    assert one == again and all(r == g == b for r, g, b in one.values())  # one shift for all channels
    reach = np.abs(shifts).max()
    assert 0 < reach <= 128 and abs(shifts.mean()) < 0.05 * reach and np.histogram(shifts, 8, (-reach, reach))[0].min() > 400
    ends = spark.createDataFrame([(0, x, 0, 255, 5) for x in range(300)], "y long, x long, r long, g long, b long")
    assert all(0 <= p[c] <= 255 for p in color.noise_dither(ends).collect() for c in "rgb")
