"""Whole rasters, texts and cells, with rows beyond those that a cut would keep, against brute force."""

import numpy as np
import pytest

from rasterloom.functions import basic
from rasterloom.plans import catalog

HEIGHT = 31


@pytest.fixture(scope="module")
def tall(spark, tmp_path_factory):
    """31 rows of orders and a text of two programs, beyond every cut."""
    d = str(tmp_path_factory.mktemp("whole"))
    r = np.random.default_rng(3)
    spark.createDataFrame([(k, int(r.integers(1, 900)), float(r.integers(1, 9000))) for k in range(150 * HEIGHT)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{d}/orders.parquet")
    texts = ["-" * 30 + "a b\n" + "late words " * 3, None, "", "x" * 500 + "\nend", "long line " * 9000, "::::" * 8 + "thirty characters and more of a name"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, r.uniform(-1, 1, 64).tolist()) for k in range(9)], "vec_id long, embedding array<double>").write.parquet(f"{d}/embeddings.parquet")
    return d, texts


def raster(d, spark):
    px = {(p["y"], p["x"]): (p["r"], p["g"], p["b"]) for p in catalog.orders_raster(spark, d).collect()}
    return np.array([[px[y, x] for x in range(150)] for y in range(HEIGHT)])


def test_neighbourhoods_over_the_whole_raster(spark, tall):
    a = raster(tall[0], spark)
    for reach in (1, 2):
        e = np.pad(a[:, :, 0], reach, mode="edge")
        told = catalog.QUERIES[f"median{2 * reach + 1}"](spark, tall[0]).collect()
        assert len(told) == 150 * HEIGHT
        assert all(p["r"] == np.median(e[p["y"] : p["y"] + 2 * reach + 1, p["x"] : p["x"] + 2 * reach + 1]) for p in told)
    e = np.pad(a, ((1, 1), (1, 1), (0, 0)), mode="edge")
    told = catalog.QUERIES["sigma3"](spark, tall[0]).collect()
    assert len(told) == 150 * HEIGHT
    for p in told:
        near = e[p["y"] : p["y"] + 3, p["x"] : p["x"] + 3].reshape(9, 3)
        want = near[np.abs(near - a[p["y"], p["x"]]).sum(axis=1) < 120].mean(axis=0)
        assert np.allclose([p["r"], p["g"], p["b"]], want)
    luma = a @ [299, 587, 114] // 1000
    told = catalog.QUERIES["swahe_small"](spark, tall[0]).collect()
    assert len(told) == 150 * HEIGHT
    for p in told:
        near = luma[max(p["y"] - 2, 0) : p["y"] + 3, max(p["x"] - 2, 0) : p["x"] + 3]
        assert p["new"] == (near <= luma[p["y"], p["x"]]).sum() * 255 // near.size


def test_palettes_over_the_whole_raster(spark, tall):
    a = raster(tall[0], spark)
    used = {int(k) for k in ((a[:, :, None, :] - np.array(catalog.CPC)) ** 2).sum(axis=3).argmin(axis=2).reshape(-1)}
    assert {p["idx"] for p in catalog.QUERIES["unused_colours"](spark, tall[0]).collect()} == set(range(len(catalog.CPC))) - used
    d = ((a[:, :, None, :] - np.array(catalog.TMS9918)) ** 2).sum(axis=3)
    told = catalog.QUERIES["msx_best_pair"](spark, tall[0]).collect()
    assert len(told) == HEIGHT * 19
    for p in told:
        seg = d[p["y"], 8 * p["seg"] : 8 * p["seg"] + 8]
        assert (p["err"], p["i"], p["j"]) == min((int(np.minimum(seg[:, i], seg[:, j]).sum()), i, j) for i in range(d.shape[2]) for j in range(i, d.shape[2]))


def test_whole_cells(spark, tall):
    rows = spark.read.parquet(f"{tall[0]}/embeddings.parquet").collect()
    want = {r["vec_id"]: sum(1 << (63 - k) for k, v in enumerate(r["embedding"]) if (v + 1) * 127.5 >= 128) for r in rows}
    assert {r["vec_id"]: r["pattern"] % (1 << 64) for r in catalog.QUERIES["cell_patterns"](spark, tall[0]).collect()} == want


def test_names_of_whole_texts(spark, tall):
    names = {r["doc_id"]: r["name"] for r in catalog.QUERIES["name_amiga"](spark, tall[0]).collect()}
    assert names[5] == "thirty characters and more of " and names[1] == "FILE"
    assert {r["doc_id"]: r["name"] for r in catalog.QUERIES["name_atari"](spark, tall[0]).collect()}[0] == "ABLATEWO"


def said(program):
    """The text of a program's REM lines, by its links."""
    at, out = basic.START, []
    while nxt := int.from_bytes(program[at - basic.START :][:2], "little"):
        line = program[at - basic.START + 4 : nxt - basic.START]
        assert line[:2] == bytes([basic.CODES["REM"]]) + b" " and line[-1] == 0
        out.append(line[2:-1].decode())
        at = nxt
    return out


def test_programs_of_whole_texts(spark, tall):
    d, texts = tall
    rows = sorted(map(tuple, catalog.QUERIES["basic_tokens"](spark, d).collect()))
    assert [r for r in rows if r[0] == 1] == [(1, 0, None)]
    for k, text in enumerate(texts):
        if text is not None:
            lines = [x for r in rows if r[0] == k for x in said(bytes.fromhex(r[2]))]
            assert "".join(lines) == text.replace("\n", "")
    assert sum(r[0] == 4 for r in rows) > 1
