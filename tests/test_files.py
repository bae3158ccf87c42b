"""Native files by relational operators, files as a data source, and the table function of SQL."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import basic
from rasterloom.functions.disks import amiga_ofs, prodos
from rasterloom.functions.palettes import PALETTES, ZX
from rasterloom.operators import machines, native, programs, volumes
from rasterloom.sources import assets
from rasterloom.sources.disks import build_disks

PX = "image_id long, y long, x long, r long, g long, b long"


@pytest.fixture(scope="module")
def images(spark):
    data = np.random.default_rng(2).integers(0, 256, (2, 24, 40, 3))
    data[:, :, :20] = 200  # long runs
    return spark.createDataFrame([(i, y, x, *map(int, data[i, y, x])) for i in range(2) for y in range(24) for x in range(40)], PX).repartition(3).cache()


def test_relational_files_equal_the_encoders(spark, images):
    for mode, made in (("zx_hires", native.spectrum_screen(images, ZX)), ("pc_cga", native.pcx_file(images, PALETTES["cga4_1_high"]))):
        want = {r["image_id"]: bytes(r["content"]) for r in machines.convert(images, mode).collect()}
        assert {r["image_id"]: bytes(r["content"]) for r in made.collect()} == want
        assert "Python" not in made._jdf.queryExecution().executedPlan().toString()


def test_scaling_shows_the_pixel_under_each_place(spark, images):
    own = {(p["image_id"], p["y"], p["x"]): p["r"] for p in images.collect()}
    for width, height in ((97, 50), (13, 7), (40, 24)):
        told = native.scaled(images, width, height).collect()
        assert len(told) == 2 * width * height
        assert all(p["r"] == own[p["image_id"], p["y"] * 24 // height, p["x"] * 40 // width] for p in told)


def test_machine_in_sql(spark, images):
    machines.register(spark)
    images.createOrReplaceTempView("px")
    told = {r["image_id"]: r for r in spark.sql("SELECT * FROM machine(TABLE(px) PARTITION BY (image_id), 'zx_hires')").collect()}
    want = {str(r["image_id"]): bytes(r["content"]) for r in machines.convert(images, "zx_hires").collect()}
    assert {k: bytes(r["content"]) for k, r in told.items()} == want and told["0"]["width"] == 256
    assert {r["error"] for r in spark.sql("SELECT * FROM machine(TABLE(px) PARTITION BY (image_id), 'none')").collect()} == {"no mode none"}
    assert spark.sql("SELECT * FROM machine(TABLE(SELECT * FROM px WHERE y < 0) PARTITION BY (image_id), 'zx_hires')").count() == 0


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    assets.register(spark)
    folder, flag = str(tmp_path / "out"), str(tmp_path / "failed")
    rows = spark.createDataFrame([(f"d{k % 3}/f{k}.bin", bytearray([k] * (100 * k))) for k in range(20)], "name string, content binary").repartition(4)

    @F.udf("binary")
    def fails_once(content):
        if len(content) == 1100 and not os.path.exists(flag):
            open(flag, "w").close()
            raise OSError("lost")
        return content

    failing = rows.withColumn("content", fails_once("content"))
    with pytest.raises(Exception, match="lost"):
        failing.write.format("raster_files").option("path", folder).mode("append").save()
    assert not [f for _, _, fs in os.walk(folder) for f in fs]
    failing.write.format("raster_files").option("path", folder).mode("append").save()
    there = {os.path.relpath(os.path.join(d, f), folder): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs}
    assert there == {f"d{k % 3}/f{k}.bin": 100 * k for k in range(20)} and not os.path.exists(f"{folder}/_writing")
    read = spark.read.format("raster_files").option("path", folder).option("task_bytes", 3000).load()
    assert read.rdd.getNumPartitions() > 3
    assert {(r["name"], r["format"], r["file_size"], bytes(r["content"])) for r in read.collect()} == {(f"f{k}.bin", "BIN", 100 * k, bytes([k] * (100 * k))) for k in range(20)}
    rows.limit(1).write.format("raster_files").option("path", folder).mode("overwrite").save()
    assert sum(len(fs) for _, _, fs in os.walk(folder)) == 1
    with pytest.raises(Exception, match="not a name"):
        spark.createDataFrame([("../x", bytearray(b"1"))], "name string, content binary").write.format("raster_files").option("path", folder).mode("append").save()
    assert not os.path.exists(tmp_path / "x")


def tokenised(line):
    """A line's bytes by a state machine, character by character."""
    out, rest, state = bytearray(), line, ""
    keywords = sorted(basic.KEYWORDS, key=len, reverse=True)
    quoted = False
    while rest:
        c = rest[0]
        if c == '"' or quoted or state == "REM" or state == "DATA" and c != ":":
            quoted ^= c == '"'
            out += c.encode() if c.isascii() else b""
            rest = rest[1:]
            continue
        state = ""
        word = next((w for w in keywords if rest.upper().startswith(w)), None)
        if word:
            out.append(basic.CODES[word])
            state = word if word in ("REM", "DATA") else ""
            rest = rest[len(word) :]
        else:
            out += c.encode() if c.isascii() else b""
            rest = rest[1:]
    return bytes(out)


LINES = [
    '10 PRINT "HELLO : REM no" : GOTO 10', "20 rem all of this : PRINT", '30 DATA 1,"a:b",c : HOME', '40 A$ = "open', "50 RESTORE : REM", "60 ONERRGOTO100", "no number", None, "", "  70   home ", "80 é = 1 : PRINT é",
    "90 HCOLOR= 3 : ATN(1) : SGN(2)", "65535 END", "65536 END", "100 DATA", *[f"{200 + k} {w.lower()}{k}{w}" for k, w in enumerate(basic.KEYWORDS)],
]


def test_programs_equal_a_state_machine(spark):
    df = spark.createDataFrame([(p, k, line) for p in ("x", None) for k, line in enumerate(LINES)], "program string, nth long, text string").repartition(3)
    told = {r["program"]: bytes(r["content"]) for r in programs.linked_programs(df, ("program",), "nth").collect()}
    want, at = bytearray(), basic.START
    for line in LINES:
        number = re.match(r"\s*(\d+)[ \t]*(.*?)[ \t]*$", line or "", re.DOTALL)
        if number and int(number[1]) <= 65535:
            body = tokenised(number[2])
            at += len(body) + 5
            want += at.to_bytes(2, "little") + int(number[1]).to_bytes(2, "little") + body + b"\0"
    assert told == {"x": bytes(want) + b"\0\0", None: bytes(want) + b"\0\0"}
    assert set(basic.CODES.values()) <= set(want)
    assert programs.linked_programs(df.limit(0), ("program",), "nth").count() == 0


def test_volumes_with_other_blocks_and_nothing(spark):
    empty = spark.createDataFrame([], "disk_id long, content binary")
    junk = spark.createDataFrame([(1, bytearray(600)), (2, bytearray(880 * 1024)), (None, None)], "disk_id long, content binary")
    for df in (empty, junk):
        assert volumes.amiga_listing(df).count() == volumes.prodos_files(df).count() == 0
    assert volumes.cpc_listing(empty).count() == 0


def test_prodos_files_through_index_blocks(spark):
    r = np.random.default_rng(6)
    files = [(0, k, f"F{k}.BIN", bytearray(r.bytes(n))) for k, n in enumerate((0, 1, 512, 513, 40_000, 140_000))]
    disks = build_disks(spark.createDataFrame(files, "disk_id long, ord long, name string, content binary"), "prodos")
    told = {x["name"]: bytes(x["content"]) for x in volumes.prodos_files(disks).collect()}
    assert told == {name: bytes(content) for _, _, name, content in files}


def _kept_bytes(spark):
    folder = spark.sparkContext.getCheckpointDir()
    path = folder.removeprefix("file:") if folder else None
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(path) for f in names) if path else 0


def test_amiga_listing_keeps_headers_only(spark):
    r = np.random.default_rng(8)
    files = [(k, n, f"F{n}.BIN", bytearray(r.bytes(200_000))) for k in range(2) for n in range(3)]
    disks = build_disks(spark.createDataFrame(files, "disk_id long, ord long, name string, content binary"), "amiga_ofs")
    before = _kept_bytes(spark)
    told = {(x["disk_id"], x["name"], x["size"]) for x in volumes.amiga_listing(disks).collect()}
    assert told == {(k, name, 200_000) for k, _, name, _ in files}
    assert _kept_bytes(spark) - before < 200_000


def test_pointers_in_a_circle_are_an_error(spark):
    image = bytearray(amiga_ofs([("A", b"1"), ("B", b"2")])[0])
    head = next(b for b in range(0, len(image), 512) if image[b + 3] == 2 and image[b + 432 : b + 434] == b"\1A")
    image[head + 496 : head + 500] = (head // 512).to_bytes(4, "big")
    with pytest.raises(ValueError, match="circle"):
        volumes.amiga_listing(spark.createDataFrame([(1, image)], "disk_id long, content binary"))


def test_prodos_pointers_of_zero_are_blocks_of_zeros(spark):
    r = np.random.default_rng(7)
    tree, sapling = r.bytes(140_000), r.bytes(1500)
    image = bytearray(prodos([("TREE", tree), ("SAPLING", sapling), ("EMPTY", bytes(5000))])[0])
    image[:512] = b"\1" * 512
    # The second index block of the tree and that of the sapling's blocks.
    assert image[24 * 512 : 24 * 512 + 2] == b"\x19\x1a"
    image[24 * 512 + 1] = 0
    head = 24 + 3 + 274
    assert image[head * 512] == (head + 1) & 255
    image[head * 512 : head * 512 + 512] = bytes(512)
    disks = spark.createDataFrame([(1, image)], "disk_id long, content binary")
    told = {x["name"]: bytes(x["content"]) for x in volumes.prodos_files(disks).collect()}
    assert told == {"TREE": tree[: 256 * 512] + bytes(140_000 - 256 * 512), "SAPLING": bytes(1500), "EMPTY": bytes(5000)}
