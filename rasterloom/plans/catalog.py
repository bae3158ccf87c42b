"""The registered queries over the driver's tables, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import basic, metrics
from ..functions.palettes import BBC, C64, CPC, IIGS, PALETTES, TMS9918, VIC20, ZX, Colour
from ..functions.disks import BUILDERS, FAT12, LISTINGS
from ..operators import batch, blocks, color, machines, native, packing, programs, sequential, sliding, stencil, text_cells, volumes
from ..operators import statistics as st
from . import adaptive
from ..sources.disks import build_disks, extract_files, list_disks
from ..sources.rasters import embedding_cells, metadata, orders_raster, pixels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

R150 = """WITH px AS (SELECT o_orderkey % 150 AS x, o_orderkey // 150 AS y, CAST(floor(o_totalprice) AS BIGINT) % 256 AS r,
 (o_custkey * 7) % 256 AS g, (o_orderkey * 31 + o_custkey) % 256 AS b FROM orders)"""
E8 = """WITH e8 AS (SELECT vec_id, CAST(pos % 8 AS BIGINT) AS x, CAST(pos // 8 AS BIGINT) AS y,
 CAST(floor((CAST(embedding[pos + 1] AS DOUBLE) + 1.0::DOUBLE) * 127.5::DOUBLE) AS BIGINT) AS lum
 FROM embeddings, (SELECT range AS pos FROM range(64)))"""
BIN = "(299*r + 587*g + 114*b) // 1000"


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def on_raster(name: str, work: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    add(name, lambda spark, d: work(orders_raster(spark, d)), R150 + sql if sql else None)


def palette_sql(palette: list[Colour], name: str = "pal") -> str:
    rows = ", ".join(f"({i}::BIGINT, {r}::BIGINT, {g}::BIGINT, {b}::BIGINT)" for i, (r, g, b) in enumerate(palette))
    return f", {name}(i, pr, pg, pb) AS (VALUES {rows})"


#: The metrics written out once more, for DuckDB: a pixel as r, g, b, an entry as pr, pg, pb; lists of (pixel, entry) channels.
_DIFF = "[r - pr, g - pg, b - pb]"
_SQUARES = f"list_sum([d * d FOR d IN {_DIFF}])"
_GREY, _PGREY = "(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE)", "(pr * 0.299::DOUBLE + pg * 0.587::DOUBLE + pb * 0.114::DOUBLE)"


def _hsl_sql(p: str) -> tuple[str, str, str]:
    """Hue in degrees, saturation and lightness of 0 .. 1 of the channels with a prefix, from channels of 0 .. 1."""
    r, g, b = (f"({p}{c} / 255::DOUBLE)" for c in "rgb")
    hi, lo = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    turn = f"CASE {hi} WHEN {r} THEN ({g} - {b}) / ({hi} - {lo}) + CASE WHEN {g} < {b} THEN 6 ELSE 0 END WHEN {g} THEN ({b} - {r}) / ({hi} - {lo}) + 2 ELSE ({r} - {g}) / ({hi} - {lo}) + 4 END"
    return f"(CASE WHEN {hi} = {lo} THEN 0 ELSE ({turn}) * 60 END)", f"(CASE WHEN {hi} = {lo} THEN 0 WHEN {hi} + {lo} > 1 THEN ({hi} - {lo}) / (2 - {hi} - {lo}) ELSE ({hi} - {lo}) / ({hi} + {lo}) END)", f"(({hi} + {lo}) / 2)"


(_H, _S, _LI), (_PH, _PS, _PLI) = _hsl_sql(""), _hsl_sql("p")
_PART = lambda c: f"(CASE WHEN {_GREY} > 1 THEN {c} / {_GREY} ELSE 0 END - CASE WHEN {_PGREY} > 1 THEN p{c} / {_PGREY} ELSE 0 END)"
_UNIT = [f"power(({c} - p{c}) / 255::DOUBLE, 2)" for c in "rgb"]
_REDS = "((r + pr) / 2::DOUBLE / 255)"
_SHADE = f"(({_GREY} - {_PGREY}) / 255)"
METRIC_SQL = {
    "euclid": _SQUARES,
    "perceptive": "(2 + (r + pr) / 2::DOUBLE / 256) * power(r - pr, 2) + 4 * power(g - pg, 2) + (2 + (255 - (r + pr) / 2::DOUBLE) / 256) * power(b - pb, 2)",
    "luma_v": f"3 * abs({_GREY} - {_PGREY}) + sqrt({_SQUARES}::DOUBLE) / 10",
    "chroma_v": f"255 * sqrt(power({_PART('r')}, 2) + power({_PART('g')}, 2) + power({_PART('b')}, 2)) + abs({_GREY} - {_PGREY}) / 5",
    "hue": f"least(abs({_H} - {_PH}), 360 - abs({_H} - {_PH})) / 180 * 255 * 4 * least({_S}, {_PS}) + 255 * abs({_S} - {_PS}) + 127.5::DOUBLE * abs({_LI} - {_PLI})",
    "luma_a": f"abs({_GREY} - {_PGREY})",
    "chroma_a": f"sqrt({_SQUARES}::DOUBLE / 2) + abs((r - g) - (pr - pg)) + abs((g - b) - (pg - pb))",
    "mahalanobis_a": f"({_SQUARES} + (r - pr) * (g - pg) / 2::DOUBLE + (g - pg) * (b - pb) / 2::DOUBLE) / 4096",
    "chroma_i": "abs(sqrt((r * r + g * g + b * b)::DOUBLE) - sqrt((pr * pr + pg * pg + pb * pb)::DOUBLE))",
    "perceptive_u": f"(2 + {_REDS}) * {_UNIT[0]} + 4 * {_UNIT[1]} + (3 - {_REDS}) * {_UNIT[2]}",
    "luma_u": f"abs({_SHADE})",
    "luma_u_mixed": f"2 * abs({_SHADE}) + {' + '.join(_UNIT)}",
    "chroma_u": f"2 * sqrt(power(0.492::DOUBLE * ((b - pb) / 255::DOUBLE - {_SHADE}), 2) + power(0.877::DOUBLE * ((r - pr) / 255::DOUBLE - {_SHADE}), 2)) + abs({_SHADE}) / 2",
    "mahalanobis_u": f"2.5::DOUBLE * {_UNIT[0]} + {_UNIT[1]} + 3 * {_UNIT[2]}",
}


def nearest_sql(palette: list[Colour], metric: str = "euclid", extra: str = "") -> str:
    """px with idx, as the table m; distances to nine digits, so that equal ones are equal however they are summed."""
    told = f"round(CAST({METRIC_SQL[metric]} AS DOUBLE), 9)" if metric != "euclid" else f"CAST({METRIC_SQL[metric]} AS DOUBLE)"
    return f"{palette_sql(palette)}, m AS (SELECT x, y, any_value(r) AS r, any_value(g) AS g, any_value(b) AS b, arg_min(i, {{'d': {told}, 'i': i}}) AS idx FROM px, pal {extra} GROUP BY x, y)"


def whole(c: str) -> str:
    return f"CAST({c} AS BIGINT) AS {c}"


# Nearest-colour matching, by metric and palette.
for _metric in metrics.METRICS:
    _palette = {"u": C64, "d": VIC20}.get(_metric.rsplit("_", 1)[-1][:1], BBC) if "_u" in _metric else BBC
    on_raster(f"nearest_{_metric}", lambda px, m=_metric, p=_palette: color.nearest(px, p, m).select("x", "y", "idx"), nearest_sql(_palette, _metric) + " SELECT x, y, idx FROM m")
for _name in ("cga16", "ega64", "zx", "tms9918", "cpc", "coco3", "iigs", "cga4_1_high"):
    on_raster(f"match_{_name}", lambda px, p=PALETTES[_name]: color.nearest(px, p).select("x", "y", "idx"), nearest_sql(PALETTES[_name]) + " SELECT x, y, idx FROM m")
on_raster("match_rgb332", lambda px: color.nearest(px, PALETTES["rgb332"]).select("x", "y", "idx"), nearest_sql(PALETTES["rgb332"]) + " SELECT x, y, idx FROM m")
on_raster("vic_foreground", lambda px: color.nearest(px, VIC20[:8]).select("x", "y", "idx"), nearest_sql(VIC20[:8]) + " SELECT x, y, idx FROM m")
on_raster(
    "column_parity_palette",
    lambda px: color.nearest(px.where("x % 2 = 0"), BBC[:4]).union(color.nearest(px.where("x % 2 = 1"), BBC[4:]).withColumn("idx", F.col("idx") + 4)).select("x", "y", "idx"),
    nearest_sql(BBC, extra="WHERE i BETWEEN 4*(x%2) AND 4*(x%2)+3") + " SELECT x, y, idx FROM m",
)
for _name in color.PALETTE_RULES:
    # How often the raster shows each entry of a palette that a rule gives, where its channels are cut to the palette's bits.
    _bits = {"ega64": 2, "gime64": 2, "rgb332": 3, "v9938": 3, "ocs4096": 4}[_name]
    _cut_up = ", ".join(f"{c} // {1 << (8 - _bits)} AS {c}" for c in "rgb")
    _entry = lambda c, n=_bits: f"(p{c} // {1 << (8 - n)})"
    add(
        f"palette_{_name}",
        lambda spark, d, n=_name, b=_bits: color.palette_uses(orders_raster(spark, d), color.palette_rows(spark, n), b).select("idx", "r", "g", "b", "n"),
        R150 + palette_sql(PALETTES[_name]) + f", c AS (SELECT {_cut_up} FROM px), k AS (SELECT r, g, b, count(*) AS n FROM c GROUP BY ALL) SELECT i AS idx, pr AS r, pg AS g, pb AS b, coalesce(n, 0) AS n FROM pal LEFT JOIN k ON k.r = {_entry('r')} AND k.g = {_entry('g')} AND k.b = {_entry('b')}",
    )
on_raster("colour_lookup", lambda px: color.lookup(color.render(color.nearest(px, ZX), ZX), ZX, "found").select("x", "y", "found"), nearest_sql(ZX) + ", u AS (SELECT min(i) AS found, pr, pg, pb FROM pal GROUP BY ALL) SELECT x, y, found FROM m JOIN pal ON idx = i JOIN u USING (pr, pg, pb)")
on_raster("render_indices", lambda px: color.render(color.nearest(px, BBC), BBC).select("x", "y", "r", "g", "b"), nearest_sql(BBC) + " SELECT x, y, pr AS r, pg AS g, pb AS b FROM m JOIN pal ON idx = i")

# Scalar kernels.
_L = metrics.luma("r", "g", "b")
on_raster("luma", lambda px: px.select("x", "y", F.expr(_L).alias("luma")), f" SELECT x, y, {_L} AS luma FROM px")
on_raster("saturation", lambda px: color.saturate(px, 1.5).select("x", "y", "r", "g", "b"), " SELECT x, y, " + ", ".join(f"least(greatest({_L} + ({c} - {_L}) * 1.5::DOUBLE, 0), 255) AS {c}" for c in "rgb") + " FROM px")
on_raster("saturation_unclamped", lambda px: color.saturate(px, 1.5, clamp=False).select("x", "y", "r", "g", "b"), " SELECT x, y, " + ", ".join(f"{_L} + ({c} - {_L}) * 1.5::DOUBLE AS {c}" for c in "rgb") + " FROM px")
on_raster("gamma", lambda px: color.gamma(px, 2.0).select("x", "y", *[F.round(c, 6).alias(c) for c in "rgb"]), " SELECT x, y, " + ", ".join(f"round(pow({c} / 255.0::DOUBLE, 0.5::DOUBLE) * 255.0::DOUBLE, 6) AS {c}" for c in "rgb") + " FROM px")
on_raster("gamma_inverse", lambda px: color.gamma(px, 2.0, inverse=False).select("x", "y", *[F.round(c, 6).alias(c) for c in "rgb"]), " SELECT x, y, " + ", ".join(f"round(pow({c} / 255.0::DOUBLE, 2.0::DOUBLE) * 255.0::DOUBLE, 6) AS {c}" for c in "rgb") + " FROM px")
on_raster("rgb_to_hsl", lambda px: color.to_hsl(px).select("x", "y", "h", "s", "l"), f" SELECT x, y, {metrics.hue('r', 'g', 'b')} AS h, {metrics.saturation('r', 'g', 'b')} AS s, {metrics.lightness('r', 'g', 'b')} AS l FROM px")
on_raster("solarize", lambda px: color.solarize(px).select("x", "y", "r", "g", "b"), " SELECT x, y, " + ", ".join(f"CASE WHEN {c} > 128 THEN 255 - {c} ELSE {c} END AS {c}" for c in "rgb") + " FROM px")
on_raster("unpremultiply", lambda px: color.unpremultiply(px.withColumn("a", F.expr("(x * 7 + y) % 256"))).select("x", "y", "r", "g", "b"), " SELECT x, y, " + ", ".join(f"CASE WHEN (x*7+y) % 256 > 0 THEN least({c} * 255 // ((x*7+y) % 256), 255) ELSE {c} END AS {c}" for c in "rgb") + " FROM px")
for _grid, _text in color.QUANTISERS.items():
    on_raster(f"quantise_{_grid}", lambda px, g=_grid: color.quantise(px, g).select("x", "y", "r", "g", "b"), " SELECT x, y, " + ", ".join(f"{_text.format(c=c).replace(' div ', ' // ')} AS {c}" for c in "rgb") + " FROM px")
on_raster("quantise_332", lambda px: color.byte_332(px).select("x", "y", "code"), " SELECT x, y, (r // 32) * 32 + (g // 32) * 4 + b // 64 AS code FROM px")
on_raster("hex_colour", lambda px: px.select("x", "y", color.hex_colour().alias("hex")), " SELECT x, y, printf('#%02X%02X%02X', r, g, b) AS hex FROM px")
for _size in (2, 4, 8, 16):
    _cells = "[" + ",".join(f"{v}.0::DOUBLE" for row in color.bayer(_size) for v in row) + "]"
    _shift = f"({_cells}[(y % {_size}) * {_size} + x % {_size} + 1] / {float(_size * _size)}::DOUBLE - 0.5::DOUBLE) * 64.0::DOUBLE"
    on_raster(f"bayer{_size}", lambda px, n=_size: color.ordered_dither(px, n).select("x", "y", "r", "g", "b"), " SELECT x, y, " + ", ".join(f"least(greatest({c} + {_shift}, 0), 255) AS {c}" for c in "rgb") + " FROM px")
for _matrix, _rows in [(f"bayer16_{k}", m) for k, m in color.MATRICES_16.items() if k != "recursive"] + [(f"golden{n}", color.golden_matrix(n)) for n in (8, 16)]:
    _side = len(_rows)
    _cells = "[" + ",".join(f"{float(v)!r}::DOUBLE" for row in _rows for v in row) + "]"
    _shift = f"({_cells}[(y % {_side}) * {_side} + x % {_side} + 1] / {float(_side * _side)}::DOUBLE - 0.5::DOUBLE) * 64.0::DOUBLE"
    on_raster(f"dither_{_matrix}", lambda px, m=_rows: color.ordered_dither(px, len(m), matrix=m).select("x", "y", *[F.round(c, 9).alias(c) for c in "rgb"]), " SELECT x, y, " + ", ".join(f"round(least(greatest({c} + {_shift}, 0), 255), 9) AS {c}" for c in "rgb") + " FROM px")
on_raster("noise_dither", lambda px: color.noise_dither(px).select("x", "y", "r", "g", "b"))
on_raster("flip_horizontal", lambda px: color.flip(px, width=150).select("x", "y", "r", "g", "b"), " SELECT 149 - x AS x, y, r, g, b FROM px")
on_raster("flip_vertical", lambda px: color.flip(st.with_extent(px), height=F.col("__h")).select("x", "y", "r", "g", "b"), " SELECT x, (SELECT max(y) FROM px) - y AS y, r, g, b FROM px")
on_raster("upscale2", lambda px: color.upscale(px, 2).select(F.col("x").cast("long"), F.col("y").cast("long"), "r", "g", "b"), ", k(d) AS (VALUES (0::BIGINT), (1::BIGINT)) SELECT x*2 + k.d AS x, y*2 + j.d AS y, r, g, b FROM px, k, k AS j")
on_raster("resize_area", lambda px: color.resize(st.with_extent(px), "__w", "__h", 40, 25).select("x", "y", "r", "g", "b"), ", t AS (SELECT max(y) + 1 AS tall FROM px) SELECT x * 40 // 150 AS x, y * 25 // tall AS y, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM px, t GROUP BY 1, 2")
on_raster("merge_average", lambda px: color.merge_pairs(px).select("x", "y", "r", "g", "b"), " SELECT x // 2 AS x, y, " + ", ".join(f"CAST(sum({c}) // count(*) AS BIGINT) AS {c}" for c in "rgb") + " FROM px GROUP BY 1, 2")
on_raster("merge_brightest", lambda px: color.merge_pairs(px, "brightest").select("x", "y", "r", "g", "b"), ", t AS (SELECT *, row_number() OVER (PARTITION BY y, x // 2 ORDER BY 299*r + 587*g + 114*b DESC, x) AS n FROM px) SELECT x // 2 AS x, y, r, g, b FROM t WHERE n = 1")
on_raster("merge_weighted", lambda px: color.merge_pairs(px, "weighted").select("x", "y", *[F.round(c, 6).alias(c) for c in "rgb"]), " SELECT x // 2 AS x, y, " + ", ".join(f"round(CASE WHEN sum(299*r + 587*g + 114*b) = 0 THEN avg({c}) ELSE sum({c} * (299*r + 587*g + 114*b))::DOUBLE / sum(299*r + 587*g + 114*b) END, 6) AS {c}" for c in "rgb") + " FROM px GROUP BY 1, 2")

# Histograms and equalisation.
_CDF = f", h AS (SELECT {BIN} AS bin, count(*) AS n FROM px GROUP BY 1), c AS (SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS cdf FROM h)"
on_raster("luma_histogram", lambda px: st.histogram(st.with_bin(px)), _CDF + " SELECT bin, n FROM h")
on_raster("channel_histograms", lambda px: px.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in "rgb"])).alias("p")).select("p.*").groupBy("channel", "value").agg(F.count("*").alias("n")), " SELECT channel, value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS channel, {c} AS value FROM px" for c in "rgb") + ") GROUP BY 1, 2")
on_raster("histogram_joint", lambda px: st.joint_histograms(px).select("channel", "value", "n", F.round("share", 9).alias("share")), ", e AS (" + " UNION ALL ".join(f"SELECT '{c}' AS channel, {c} AS value FROM px" for c in "rgb") + " UNION ALL SELECT 'luma', CAST(least(floor(0.299::DOUBLE*r + 0.587::DOUBLE*g + 0.114::DOUBLE*b), 255) AS BIGINT) FROM px), c AS (SELECT channel, value, count(*) AS n FROM e GROUP BY 1, 2) SELECT k.channel, v.range AS value, coalesce(n, 0) AS n, round(coalesce(n, 0)::DOUBLE / (SELECT max(n) FROM c), 9) AS share FROM (VALUES ('r'), ('g'), ('b'), ('luma')) k(channel) CROSS JOIN range(256) v LEFT JOIN c ON c.channel = k.channel AND c.value = v.range")
on_raster("hist_cdf", lambda px: st.cdf(st.histogram(st.with_bin(px))), _CDF + " SELECT * FROM c")
_LUT = _CDF + ", t AS (SELECT min(cdf) AS lo, max(cdf) AS total FROM c), l AS (SELECT bin, CASE WHEN total = lo THEN bin ELSE (cdf - lo) * 255 // (total - lo) END AS new FROM c, t)"
on_raster("he_scale", lambda px: st.equalise(px).select("x", "y", "r", "g", "b"), _LUT + " SELECT x, y, " + ", ".join(f"CASE WHEN bin > 0 THEN least({c} * new // bin, 255) ELSE {c} END AS {c}" for c in "rgb") + f" FROM px JOIN l ON {BIN} = bin")
on_raster("he_additive", lambda px: st.equalise(px, form="additive").select("x", "y", "r", "g", "b"), _LUT + " SELECT x, y, " + ", ".join(f"greatest(least({c} + new - bin, 255), 0) AS {c}" for c in "rgb") + f" FROM px JOIN l ON {BIN} = bin")
on_raster("he_channel", lambda px: st.equalise_channel(px, "g").select("x", "y", "g"), ", h AS (SELECT g, count(*) AS n FROM px GROUP BY 1), c AS (SELECT g, CAST(sum(n) OVER (ORDER BY g) AS BIGINT) AS cdf FROM h) SELECT x, y, cdf * 255 // (SELECT max(cdf) FROM c) AS g FROM px JOIN c USING (g)")
_TILES = f""", t AS (SELECT *, {BIN} AS bin, y // 25 AS ty, x // 40 AS tx FROM px), s AS (SELECT ty, tx, greatest(CAST(floor(count(*) * 3.0::DOUBLE / 256) AS BIGINT), 1) AS lim FROM t GROUP BY 1, 2),
 n AS (SELECT ty, tx, bin, count(*) AS n FROM t GROUP BY 1, 2, 3), d AS (SELECT ty, tx, lim, bin, coalesce(n, 0) AS n FROM (SELECT s.*, range AS bin FROM s, range(256)) LEFT JOIN n USING (ty, tx, bin)),
 e AS (SELECT ty, tx, bin, CAST(least(n, lim) + sum(greatest(n - lim, 0)) OVER (PARTITION BY ty, tx) // 256 AS BIGINT) AS n FROM d), f AS (SELECT *, CAST(sum(n) OVER (PARTITION BY ty, tx ORDER BY bin) AS BIGINT) AS cdf FROM e)"""
on_raster("clahe_histogram", lambda px: st.clipped_histogram(px, 40, 25, 3.0).select("ty", "tx", "bin", "n", "cdf"), _TILES + " SELECT * FROM f")
on_raster("clahe_apply", lambda px: st.clahe(px).select("x", "y", "r", "g", "b"), _TILES + ", w AS (SELECT ty, tx, max(cdf) AS total FROM f GROUP BY 1, 2), l AS (SELECT ty, tx, bin, cdf * 255 // total AS new FROM f JOIN w USING (ty, tx)) SELECT x, y, " + ", ".join(f"CASE WHEN bin > 0 THEN least({c} * new // bin, 255) ELSE {c} END AS {c}" for c in "rgb") + " FROM t JOIN l USING (ty, tx, bin)")

_SHARED = f", s AS (SELECT *, {metrics.luma('r', 'g', 'b')} AS luma, CAST(least(greatest(floor({metrics.luma('r', 'g', 'b')}), 0), 255) AS BIGINT) AS bin FROM px)"


def _scaled_sql(new: str, dark: bool = False) -> str:
    return ", ".join(f"round(CASE WHEN luma > 0.001::DOUBLE THEN least(greatest({c} * ({new} / luma), 0), 255) ELSE {new if dark else c + '::DOUBLE'} END, 6) AS {c}" for c in "rgb")


_rounded = lambda px: px.select("x", "y", *[F.round(c, 6).alias(c) for c in "rgb"])
_SHARES = _SHARED + ", h AS (SELECT bin, count(*) AS n FROM s GROUP BY 1), c AS (SELECT bin, CAST(sum(n) OVER (ORDER BY bin) AS DOUBLE) / (SELECT count(*) FROM px) * 255.0::DOUBLE AS new FROM h)"
for _dark in (False, True):
    on_raster("he_share" + "_dark" * _dark, lambda px, d=_dark: _rounded(st.equalise_share(px, dark=d)), _SHARES + f" SELECT x, y, {_scaled_sql('new', _dark)} FROM s JOIN c USING (bin)")
_SHARED_TILES = _SHARED + """, t AS (SELECT *, y // 25 AS ty, x // 40 AS tx FROM s), z AS (SELECT ty, tx, count(*) AS size, CAST(floor(3.0::DOUBLE * count(*) / 256) AS BIGINT) AS lim FROM t GROUP BY 1, 2),
 n AS (SELECT ty, tx, bin, count(*) AS n FROM t GROUP BY 1, 2, 3), d AS (SELECT ty, tx, size, lim, bin, coalesce(n, 0) AS n FROM (SELECT z.*, range AS bin FROM z, range(256)) LEFT JOIN n USING (ty, tx, bin)),
 e AS (SELECT ty, tx, size, bin, CAST(least(n, lim) + sum(greatest(n - lim, 0)) OVER (PARTITION BY ty, tx) // 256 AS BIGINT) AS n FROM d),
 f AS (SELECT ty, tx, bin, CAST(sum(n) OVER (PARTITION BY ty, tx ORDER BY bin) AS DOUBLE) / size * 255.0::DOUBLE AS new FROM e)"""
on_raster("clahe_share", lambda px: _rounded(st.clahe_share(px)), _SHARED_TILES + f" SELECT x, y, {_scaled_sql('new')} FROM t JOIN f USING (ty, tx, bin)")
for _window in (40, 64):
    _reach = _window // 2
    on_raster(f"swahe_{_window}", lambda px, w=_window: _rounded(st.window_equalise(px, w)), _SHARED + f", k AS (SELECT y, x, bin FROM s), w AS (SELECT p.y, p.x, count(*) FILTER (q.bin <= p.bin) * 255.0::DOUBLE / count(*) AS new FROM k p JOIN k q ON q.y BETWEEN p.y - {_reach} AND p.y + {_reach} AND q.x BETWEEN p.x - {_reach} AND p.x + {_reach} GROUP BY 1, 2) SELECT x, y, {_scaled_sql('new')} FROM s JOIN w USING (y, x)")



def _carried_sql(window: int, new: str, made: str) -> str:
    """The carried histogram as sums: what the pixel's own line has brought in and taken off, and what all lines before have left."""
    half = window // 2
    return (
        _SHARED + f", z AS (SELECT max(x) + 1 AS w FROM s), own AS (SELECT p.y, p.x, sum(CASE WHEN q.bin <= p.bin THEN k ELSE 0 END) AS below, sum(k) AS size FROM (SELECT p.y, p.x, p.bin, q.bin AS qbin, CASE WHEN q.x >= {half} AND q.x < least(p.x + {half}, w) THEN 1 ELSE 0 END - CASE WHEN q.x < p.x - {half} THEN 1 ELSE 0 END AS k FROM s p, z, s q WHERE q.y >= p.y - {half} AND q.y < p.y + {half}) p, LATERAL (SELECT p.qbin AS bin) q GROUP BY 1, 2)"
        + f", line AS (SELECT y, bin, sum(CASE WHEN x >= {half} THEN 1 ELSE 0 END - CASE WHEN x < w - {half} THEN 1 ELSE 0 END) AS k FROM s, z GROUP BY 1, 2)"
        + f", lv AS (SELECT range AS bin FROM range(256)), ys AS (SELECT DISTINCT y FROM s), e AS (SELECT ys.y, lv.bin, coalesce(sum(k), 0) AS k FROM ys CROSS JOIN lv LEFT JOIN line ON line.y >= ys.y - {half} AND line.y < ys.y + {half} AND line.bin <= lv.bin GROUP BY 1, 2)"
        + f", h AS (SELECT lv.bin, count(s.y) AS n FROM lv LEFT JOIN s ON s.bin <= lv.bin AND s.y < {half} AND s.x < {window} GROUP BY 1)"
        + ", c AS (SELECT y, bin, n + coalesce(sum(k) OVER (PARTITION BY bin ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM e JOIN h USING (bin))"
        + ", r AS (SELECT s.*, (own.below + c.n)::DOUBLE AS below, (own.size + a.n)::DOUBLE AS size FROM s JOIN own USING (y, x) JOIN c ON c.y = s.y AND c.bin = s.bin JOIN c a ON a.y = s.y AND a.bin = 255)"
        + f", v AS (SELECT *, {new} AS new FROM r) SELECT x, y, " + ", ".join(f"round(least(greatest({made.format(c=c)}, 0), 255) + 0::DOUBLE, 9) AS {c}" for c in "rgb") + " FROM v"
    )


_carried = lambda px, additive: sliding.carried_equalise(px, 40, additive=additive).select("x", "y", *[F.round(F.col(c) + F.lit(0.0), 9).alias(c) for c in "rgb"])
on_raster("swahe_carried", lambda px: _carried(px, False), _carried_sql(40, "CASE WHEN size > 0 THEN below * 255 / size ELSE bin END", "CASE WHEN bin > 0 THEN {c} * (new / bin) ELSE {c}::DOUBLE END"))
on_raster("swahe_carried_additive", lambda px: _carried(px, True), _carried_sql(40, "CASE WHEN size > 0 THEN below / size * 255::DOUBLE ELSE bin / 255::DOUBLE END", "{c} + new - bin"))

# Neighbourhoods.


def _around_sql(*kernels: str, name: str = "around") -> str:
    """CTE for DuckDB: the 3x3 sums of each kernel and channel by a self join, null at the border."""
    tap = lambda kernel, c: "CASE " + " ".join(f"WHEN q.y - p.y = {j - 1} AND q.x - p.x = {i - 1} THEN {v!r}::DOUBLE * q.{c}" for j, row in enumerate(stencil.KERNELS[kernel]) for i, v in enumerate(row)) + " END"
    sums = ", ".join(f"CASE WHEN count(*) = 9 THEN sum({tap(k, c)}) END AS {k}_{c}" for k in kernels for c in "rgb")
    return f", {name} AS (SELECT p.x, p.y, any_value(p.r) AS r, any_value(p.g) AS g, any_value(p.b) AS b, {sums} FROM px p JOIN px q ON q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 GROUP BY 1, 2)"


def _made_sql(value: str, kernel: str, digits: int = 6) -> str:
    """The pixels of `around` with each channel as value (SQL text in {c}, {v}), clamped, border pixels as they are."""
    return " SELECT x, y, " + ", ".join(f"round(CASE WHEN {kernel}_{c} IS NULL THEN {c}::DOUBLE ELSE least(greatest({value.format(c=c, v=f'{kernel}_{c}')}, 0), 255) END, {digits}) AS {c}" for c in "rgb") + " FROM around"


_smooth = lambda px: px.select("x", "y", *[F.round(c, 6).alias(c) for c in "rgb"])
for _kernel in ("box", "lowpass", "sharpen", "emboss", "laplacian"):
    on_raster(f"filter_{_kernel}", lambda px, k=_kernel: _smooth(stencil.filtered(px, k)), _around_sql(_kernel) + _made_sql("{v}", _kernel))
on_raster("sharpen_strength", lambda px: _smooth(stencil.filtered(px, "sharpen", strength=0.4)), _around_sql("sharpen") + _made_sql("{c} + ({v} - {c}) * 0.4::DOUBLE", "sharpen"))
on_raster("emboss_depth", lambda px: _smooth(stencil.filtered(px, "emboss", depth=0.5, offset=128.0)), _around_sql("emboss") + _made_sql("{v} * 0.5::DOUBLE + 128.0::DOUBLE", "emboss"))
on_raster("sobel", lambda px: _smooth(stencil.sobel(px)), _around_sql("sobel_x", "sobel_y") + " SELECT x, y, " + ", ".join(f"round(CASE WHEN sobel_x_{c} IS NULL THEN {c}::DOUBLE ELSE least(greatest(({c} + sqrt(sobel_x_{c}*sobel_x_{c} + sobel_y_{c}*sobel_y_{c})) * 0.5::DOUBLE, 0), 255) END, 6) AS {c}" for c in "rgb") + " FROM around")
_MEAN = " + ".join(f"sqrt(sobel_x_{c}*sobel_x_{c} + sobel_y_{c}*sobel_y_{c})" for c in "rgb")
on_raster("edges_mean", lambda px: stencil.edges(px, 200.0).select("x", "y", "r", "g", "b"), _around_sql("sobel_x", "sobel_y") + " SELECT x, y, " + ", ".join(f"CASE WHEN sobel_x_r IS NULL THEN {c} WHEN (0.0::DOUBLE + {_MEAN}) / 3.0::DOUBLE > 200.0::DOUBLE THEN 255 ELSE 0 END AS {c}" for c in "rgb") + " FROM around")
_SEEN = ", e AS (SELECT max(y) AS bottom FROM px) {select} FROM px p, e, (SELECT range - {k} AS d FROM range({n})) a, (SELECT range - {k} AS d FROM range({n})) c JOIN px q ON q.x = greatest(least(p.x + a.d, 149), 0) AND q.y = greatest(least(p.y + c.d, e.bottom), 0) {where} GROUP BY p.x, p.y"
on_raster("swahe_small", lambda px: st.local_rank(st.with_bin(px), 2), f", s AS (SELECT x, y, {BIN} AS bin FROM px) SELECT p.y, p.x, p.bin, count(*) FILTER (q.bin <= p.bin) * 255 // count(*) AS new FROM s p, (SELECT range - 2 AS d FROM range(5)) a, (SELECT range - 2 AS d FROM range(5)) c JOIN s q ON q.x = p.x + a.d AND q.y = p.y + c.d GROUP BY 1, 2, 3")
for _reach in (1, 2, 3):
    on_raster(f"median{2 * _reach + 1}", lambda px, k=_reach: st.median(px, k).select("x", "y", "r", "g", "b"), _SEEN.format(select="SELECT p.x, p.y, quantile_disc(q.r, 0.5) AS r, quantile_disc(q.g, 0.5) AS g, quantile_disc(q.b, 0.5) AS b", k=_reach, n=2 * _reach + 1, where=""))
on_raster("sigma3", lambda px: st.sigma_filter(px, 1, 120).select("x", "y", "r", "g", "b"), _SEEN.format(select="SELECT p.x, p.y, avg(q.r) AS r, avg(q.g) AS g, avg(q.b) AS b", k=1, n=3, where="WHERE abs(q.r-p.r) + abs(q.g-p.g) + abs(q.b-p.b) < 120"))

# Palette selection and cells.
on_raster("palette_topk", lambda px: st.top_colours(color.nearest(px, BBC), 4).select("idx", "n", "rank"), nearest_sql(BBC) + ", c AS (SELECT idx, count(*) AS n FROM m GROUP BY 1) SELECT * FROM (SELECT idx, n, row_number() OVER (ORDER BY n DESC, idx) AS rank FROM c) WHERE rank <= 4")
on_raster("unused_colours", lambda px: px.sparkSession.range(len(CPC)).select(F.col("id").alias("idx")).join(color.nearest(px, CPC).select("idx").distinct(), "idx", "left_anti"), nearest_sql(CPC) + " SELECT i AS idx FROM pal WHERE i NOT IN (SELECT idx FROM m)")
on_raster("brightness_order", lambda px: st.by_brightness(px.groupBy("y").agg(F.min("r").alias("r"), F.max("g").alias("g"), F.min("b").alias("b"))).select("r", "g", "b", "place"), ", c AS (SELECT y, min(r) AS r, max(g) AS g, min(b) AS b FROM px GROUP BY 1) SELECT r, g, b, row_number() OVER (ORDER BY r + g + b, r, g, b) - 1 AS place FROM c")
on_raster("mean_background", lambda px: color.nearest(px.agg(*[F.avg(c).alias(c) for c in "rgb"]), C64).select("idx"), palette_sql(C64) + ", a AS (SELECT avg(r) AS r, avg(g) AS g, avg(b) AS b FROM px) SELECT arg_min(i, {'d': (r-pr)*(r-pr) + (g-pg)*(g-pg) + (b-pb)*(b-pb), 'i': i}) AS idx FROM a, pal")
on_raster("subsample", lambda px: px.where("(y * 150 + x) % 4 = 0").select("x", "y", "r", "g", "b"), " SELECT * FROM px WHERE (y * 150 + x) % 4 = 0")
on_raster("mean_colour", lambda px: px.agg(*[F.avg(c).alias(c) for c in "rgb"]), " SELECT avg(r) AS r, avg(g) AS g, avg(b) AS b FROM px")
on_raster("brightness_extremes", lambda px: px.agg(*[f(F.expr("y * 150 + x"), F.struct(F.expr("r + g + b"), F.expr(f"{s} (y * 150 + x)"))).alias(n) for n, f, s in (("darkest", F.min_by, "+"), ("brightest", F.max_by, "-"))]), " SELECT arg_min(y*150+x, {'v': r+g+b, 'p': y*150+x}) AS darkest, arg_max(y*150+x, {'v': r+g+b, 'p': -(y*150+x)}) AS brightest FROM px")
on_raster("darkness_background", lambda px: st.darkest_total(color.nearest(px, BBC).withColumn("cy", F.expr("y div 8")), ("cy",)), nearest_sql(BBC) + f", w AS (SELECT y // 8 AS cy, idx, CAST(sum(255 - {BIN}) AS BIGINT) AS weight FROM m GROUP BY 1, 2) SELECT cy, arg_max(idx, {{'w': weight, 'i': -idx}}) AS idx, max(weight) AS weight FROM w GROUP BY 1")
on_raster("palette_fit_error", lambda px: px.withColumn("p", color.palette_array(BBC)).select(F.expr("y"), F.expr("sqrt(cast(array_min(transform(p, q -> (r-q.pr)*(r-q.pr) + (g-q.pg)*(g-q.pg) + (b-q.pb)*(b-q.pb))) as double))").alias("d")).groupBy("y").agg(F.round(F.avg("d"), 6).alias("error")), palette_sql(BBC) + ", d AS (SELECT x, y, min((r-pr)*(r-pr) + (g-pg)*(g-pg) + (b-pb)*(b-pb)) AS d FROM px, pal GROUP BY 1, 2) SELECT y, round(avg(sqrt(d::DOUBLE)), 6) AS error FROM d GROUP BY 1")
on_raster("distinct_lines", lambda px: blocks.first_seen(px.groupBy("y").agg(F.expr("max(r) div 16").alias("k")), F.col("k"), "y").select("value", "first", "slot"), ", k AS (SELECT y, max(r) // 16 AS value FROM px GROUP BY 1), f AS (SELECT value, min(y) AS first FROM k GROUP BY 1) SELECT value, first, row_number() OVER (ORDER BY first, value) - 1 AS slot FROM f")
for _name, _palette, _w, _h, _n in (("zx", ZX, 8, 8, 2), ("c64", C64, 8, 8, 2), ("c64_multi", C64, 4, 8, 3), ("vic", VIC20, 8, 8, 4)):
    on_raster(
        f"{_name}_cell_colours",
        lambda px, p=_palette, w=_w, h=_h, n=_n: packing.cell_quantise(color.nearest(px, p), n, w, h).select("cy", "cx", F.concat_ws(",", F.col("colours").cast("array<string>")).alias("colours")),
        nearest_sql(_palette) + f", c AS (SELECT y // {_h} AS cy, x // {_w} AS cx, idx, count(*) AS n FROM m GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY cy, cx ORDER BY n DESC, idx) AS rn FROM c) SELECT cy, cx, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY rn) AS colours FROM k WHERE rn <= {_n} GROUP BY 1, 2",
    )
# Per-pixel choice among the colours of a cell; machines differ in which of two equally near colours they take.
for _name, _palette, _w, _h, _n, _last in (("zx", ZX, 8, 8, 2, False), ("c64", C64, 8, 8, 2, True), ("c64_multi", C64, 4, 8, 3, False), ("msx", TMS9918, 8, 1, 2, False)):
    on_raster(
        f"{_name}_cell_pixels",
        lambda px, p=_palette, w=_w, h=_h, n=_n, last=_last: packing.cell_choose(px, packing.cell_quantise(color.nearest(px, p), n, w, h), p, w, h, last).select("x", "y", "slot", "idx"),
        nearest_sql(_palette) + f", c AS (SELECT y // {_h} AS cy, x // {_w} AS cx, idx, count(*) AS n FROM m GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY cy, cx ORDER BY n DESC, idx) - 1 AS slot FROM c),"
        f" d AS (SELECT x, y, slot, idx, row_number() OVER (PARTITION BY x, y ORDER BY (r-pr)*(r-pr) + (g-pg)*(g-pg) + (b-pb)*(b-pb), slot {'DESC' if _last else ''}) AS rn FROM px JOIN k ON cy = y // {_h} AND cx = x // {_w} JOIN pal ON i = idx WHERE slot < {_n}) SELECT x, y, slot, idx FROM d WHERE rn = 1",
    )
_DARK = VIC20[6]
on_raster("vic_cell_foreground", lambda px: packing.contrast_cells(color.nearest(px, VIC20[:8]), _DARK, "idx").select("cy", "cx", F.coalesce("fg", F.lit(1)).alias("fg")), nearest_sql(VIC20[:8]) + f", g AS (SELECT *, abs((0.299::DOUBLE*r + 0.587::DOUBLE*g + 0.114::DOUBLE*b)/255::DOUBLE - (0.299::DOUBLE*{_DARK[0]} + 0.587::DOUBLE*{_DARK[1]} + 0.114::DOUBLE*{_DARK[2]})/255::DOUBLE) AS gap FROM m) SELECT y // 8 AS cy, x // 8 AS cx, coalesce(arg_max(idx, {{'g': gap, 'y': -y, 'x': -x}}) FILTER (gap >= 0.1::DOUBLE), 1) AS fg FROM g GROUP BY 1, 2")
on_raster("msx_best_pair", lambda px: packing.best_pair(px.withColumn("seg", F.expr("x div 8")), ("y", "seg"), TMS9918).select("y", "seg", "i", "j", "err"), palette_sql(TMS9918) + ", q AS (SELECT a.i AS i, c.i AS j, a.pr AS ar, a.pg AS ag, a.pb AS ab, c.pr AS cr, c.pg AS cg, c.pb AS cb FROM pal a JOIN pal c ON a.i <= c.i), e AS (SELECT y, x // 8 AS seg, i, j, CAST(sum(least((r-ar)*(r-ar)+(g-ag)*(g-ag)+(b-ab)*(b-ab), (r-cr)*(r-cr)+(g-cg)*(g-cg)+(b-cb)*(b-cb))) AS BIGINT) AS err FROM px, q GROUP BY 1, 2, 3, 4), n AS (SELECT *, row_number() OVER (PARTITION BY y, seg ORDER BY err, i, j) AS n FROM e) SELECT y, seg, i, j, err FROM n WHERE n = 1")

# Text modes: a glyph and two colours a cell.
_CGA = PALETTES["cga16"]
_FONT = [(k, (k * 0x0123456789ABCDEF) & 0x7FFFFFFFFFFFFFFF) for k in range(64)]


def _cell_sql(ground: str, bright: str, fg: str, glyphs: list[tuple[int, int]], palette: list[Colour]) -> str:
    """t(y, x, r, g, b, cy, cx, l) to cells: bright and ground are SQL text for what each cell takes, fg for its foreground."""
    d = "(t.r-{0}.pr)*(t.r-{0}.pr) + (t.g-{0}.pg)*(t.g-{0}.pg) + (t.b-{0}.pb)*(t.b-{0}.pb)".format
    signed = lambda bits: bits if bits < 1 << 63 else bits - (1 << 64)
    rows = ", ".join(f"({k}::BIGINT, {code}::BIGINT, ({signed(bits)})::BIGINT)" for k, (code, bits) in enumerate(glyphs))
    return (
        f"{palette_sql(palette)}, t AS (SELECT *, y // 8 AS cy, x // 8 AS cx, 0.299::DOUBLE*r + 0.587::DOUBLE*g + 0.114::DOUBLE*b AS l FROM px){ground}, c AS ({bright}), k AS ({fg})"
        f", bits AS (SELECT t.cy, t.cx, bit_or(CASE WHEN {d('f')} > {d('a')} THEN 0 WHEN y % 8 = 0 AND x % 8 = 0 THEN (-9223372036854775808)::BIGINT ELSE 1::BIGINT << (63 - (y % 8 * 8 + x % 8))::INT END) AS pattern FROM t JOIN k ON k.cy = t.cy AND k.cx = t.cx JOIN pal f ON f.i = k.fg JOIN pal a ON a.i = k.bg GROUP BY 1, 2)"
        f", g(n, code, glyph) AS (VALUES {rows}) SELECT cy, cx, arg_min(code, {{'d': bit_count(xor(pattern, glyph)), 'n': n}}) AS code, any_value(fg) AS fg, any_value(bg) AS bg, CAST(min(bit_count(xor(pattern, glyph))) AS BIGINT) AS distance FROM bits JOIN k USING (cy, cx), g GROUP BY 1, 2"
    )


_PICK = "(SELECT arg_min(i, {{'d': (c.{0}.r-pr)*(c.{0}.r-pr) + (c.{0}.g-pg)*(c.{0}.g-pg) + (c.{0}.b-pb)*(c.{0}.b-pb), 'i': i}}) FROM pal{1})"
on_raster("text_cells", lambda px: text_cells.text_cells(px, _CGA), _cell_sql("", "SELECT cy, cx, arg_max({'r': r, 'g': g, 'b': b}, {'l': l, 'y': -y, 'x': -x}) AS hi, max(l) AS top, arg_min({'r': r, 'g': g, 'b': b}, {'l': l, 'y': y, 'x': x}) AS lo FROM t GROUP BY 1, 2", f"SELECT cy, cx, CASE WHEN top > 0 THEN {_PICK.format('hi', '')} ELSE 15 END AS fg, {_PICK.format('lo', ' WHERE i < 8')} AS bg FROM c", list(text_cells.BLOCKS_437), _CGA))
on_raster("petscii_cells", lambda px: text_cells.character_cells(px, C64, _FONT), _cell_sql(", o AS (SELECT x, y, arg_min(i, {'d': (r-pr)*(r-pr) + (g-pg)*(g-pg) + (b-pb)*(b-pb), 'i': i}) AS idx, any_value(l) AS l FROM t, pal GROUP BY 1, 2), w AS (SELECT idx, CAST(sum(CAST(trunc((1 - l / 255::DOUBLE) * 255) AS BIGINT)) AS BIGINT) AS weight FROM o GROUP BY 1), u AS (SELECT arg_max(idx, {'w': weight, 'i': -idx}) AS bg FROM w), v AS (SELECT bg, 0.299::DOUBLE*pr + 0.587::DOUBLE*pg + 0.114::DOUBLE*pb AS shade FROM u JOIN pal ON i = bg)", "SELECT cy, cx, any_value(bg) AS bg, arg_max({'r': r, 'g': g, 'b': b}, {'d': abs(l - shade), 'y': -y, 'x': -x}) AS px, max(abs(l - shade)) AS far FROM t, v GROUP BY 1, 2", f"SELECT cy, cx, bg, CASE WHEN idx <> bg THEN idx WHEN bg < 8 THEN 1 ELSE 0 END AS fg FROM (SELECT *, CASE WHEN far > 0 THEN {_PICK.format('px', '')} ELSE 1 END AS idx FROM c)", _FONT, C64))

# Packing, runs, glyphs.
on_raster("pack_1bpp", lambda px: packing.pack_bits(px, "case when r > 127 then 1 else 0 end"), " SELECT y, x // 8 AS col, bit_or(CASE WHEN r > 127 THEN 1::BIGINT << (7 - x % 8)::INT ELSE 0 END) AS byte FROM px GROUP BY 1, 2")
on_raster("pack_2bpp", lambda px: packing.pack_bits(px, "r div 64", depth=2), " SELECT y, x // 4 AS col, bit_or((r // 64) << (2 * (3 - x % 4))::INT) AS byte FROM px GROUP BY 1, 2")
on_raster("pack_planes", lambda px: packing.pack_planes(color.nearest(px, BBC), "idx", 3).select("y", F.col("plane").cast("long"), "col", "byte"), nearest_sql(BBC) + " SELECT y, k.range AS plane, x // 8 AS col, bit_or(((idx >> k.range::INT) & 1) << (7 - x % 8)::INT) AS byte FROM m, range(3) k GROUP BY 1, 2, 3")
for _name, _address in packing.ADDRESSES.items():
    # The raster as screens of 32 columns and 192 lines.
    on_raster(f"address_{_name}", lambda px, a=_address: px.select(F.expr("x div 32").alias("bank"), F.expr("y div 192").alias("screen"), F.expr("x % 32").alias("col"), F.expr("y % 192").alias("y")).withColumn("address", F.expr(a)), f", c AS (SELECT x // 32 AS bank, y // 192 AS screen, x % 32 AS col, y % 192 AS y FROM px) SELECT bank, screen, col, y, {_address.replace(' div ', ' // ')} AS address FROM c")
_RUNS = nearest_sql(BBC[:2]) + ", a AS (SELECT y, x, idx, CASE WHEN lag(idx) OVER w = idx THEN 0 ELSE 1 END AS s FROM m WINDOW w AS (PARTITION BY y ORDER BY x)), r AS (SELECT *, sum(s) OVER (PARTITION BY y ORDER BY x) AS run FROM a), q AS (SELECT *, (row_number() OVER (PARTITION BY y, run ORDER BY x) - 1) // 3 AS part FROM r)"
on_raster("rle", lambda px: packing.runs(color.nearest(px, BBC[:2]), "idx", most=3).select("y", "start", "value", "length"), _RUNS + " SELECT y, min(x) AS start, any_value(idx) AS value, count(*) AS length FROM q GROUP BY y, run, part")
on_raster("pcx_runs", lambda px: packing.runs(color.nearest(px, BBC[:2]), "idx", most=3).select("y", "start", packing.pcx_bytes(F.col("length"), F.col("value")).alias("bytes")), _RUNS + " SELECT y, min(x) AS start, CASE WHEN count(*) = 1 THEN printf('%02X', any_value(idx)) ELSE printf('%02X%02X', count(*) + 192, any_value(idx)) END AS bytes FROM q GROUP BY y, run, part")
_BYTES = ", m AS (SELECT y, x, CASE WHEN r < 250 THEN 5 ELSE 128 + g // 2 END AS idx FROM px), a AS (SELECT y, x, idx, CASE WHEN lag(idx) OVER w = idx THEN 0 ELSE 1 END AS s FROM m WINDOW w AS (PARTITION BY y ORDER BY x)), r AS (SELECT *, sum(s) OVER (PARTITION BY y ORDER BY x) AS run FROM a), q AS (SELECT *, (row_number() OVER (PARTITION BY y, run ORDER BY x) - 1) // 63 AS part FROM r)"
on_raster("pcx_long_runs", lambda px: packing.runs(px.withColumn("idx", F.expr("case when r < 250 then 5 else 128 + g div 2 end")), "idx").select("y", "start", packing.pcx_bytes(F.col("length"), F.col("value")).alias("bytes")), _BYTES + " SELECT y, min(x) AS start, CASE WHEN count(*) = 1 AND any_value(idx) < 192 THEN printf('%02X', any_value(idx)) ELSE printf('%02X%02X', count(*) + 192, any_value(idx)) END AS bytes FROM q GROUP BY y, run, part")
on_raster("ansi_changes", lambda px: packing.changes(color.nearest(px, BBC).withColumn("fg", F.expr("idx div 4")).withColumn("bg", F.expr("idx % 2")), "fg", "bg").select("y", "x", "fg", "bg"), nearest_sql(BBC) + ", c AS (SELECT y, x, idx // 4 AS fg, idx % 2 AS bg FROM m), d AS (SELECT *, lag(fg) OVER w AS pf, lag(bg) OVER w AS pb FROM c WINDOW w AS (ORDER BY y, x)) SELECT y, x, fg, bg FROM d WHERE pf IS NULL OR pf <> fg OR pb <> bg")
on_raster("ansi_changes_by_image", lambda px: packing.changes(color.nearest(px, BBC).select(F.expr("y div 7").alias("image"), F.expr("y % 7").alias("y"), "x", F.expr("idx div 4").alias("fg"), F.expr("idx % 2").alias("bg")), "fg", "bg", keys=("image",)).select("image", "y", "x", "fg", "bg"), nearest_sql(BBC) + ", c AS (SELECT y // 7 AS image, y % 7 AS y, x, idx // 4 AS fg, idx % 2 AS bg FROM m), d AS (SELECT *, lag(fg) OVER w AS pf, lag(bg) OVER w AS pb FROM c WINDOW w AS (PARTITION BY image ORDER BY y, x)) SELECT image, y, x, fg, bg FROM d WHERE pf IS NULL OR pf <> fg OR pb <> bg")
_PATTERN = E8 + ", p AS (SELECT vec_id, bit_or(CASE WHEN lum <= 127 THEN 0 WHEN x = 0 AND y = 0 THEN (-9223372036854775808)::BIGINT ELSE 1::BIGINT << (63 - (y*8 + x))::INT END) AS pattern FROM e8 GROUP BY 1)"
_cells = lambda spark, d: packing.cell_patterns(embedding_cells(spark, d), "case when lum > 127 then 1 else 0 end", "vec_id")
add("emb_cell", lambda spark, d: embedding_cells(spark, d), E8 + " SELECT * FROM e8")
add("cell_patterns", _cells, _PATTERN + " SELECT * FROM p")
_GLYPHS = [(k, (k * 0x0102040810204081) & 0x7FFFFFFFFFFFFFFF) for k in range(40)]
add("nearest_glyph", lambda spark, d: packing.nearest_glyph(_cells(spark, d), _GLYPHS).select("vec_id", "code", "distance"), _PATTERN + ", g(code, bits) AS (VALUES " + ", ".join(f"({k}::BIGINT, {b}::BIGINT)" for k, b in _GLYPHS) + ") SELECT vec_id, arg_min(code, {'d': bit_count(xor(pattern, bits)), 'c': code}) AS code, CAST(min(bit_count(xor(pattern, bits))) AS BIGINT) AS distance FROM p, g GROUP BY 1")
add("glyph_dedup", lambda spark, d: blocks.first_seen(_cells(spark, d), F.col("pattern"), "vec_id").select(F.col("value").alias("pattern"), "first", "slot"), _PATTERN + ", f AS (SELECT pattern, min(vec_id) AS first FROM p GROUP BY 1) SELECT pattern, first, row_number() OVER (ORDER BY first) - 1 AS slot FROM f")
add("charset_allocation", lambda spark, d: packing.charset(_cells(spark, d), "vec_id", 256), _PATTERN + ", f AS (SELECT pattern, min(vec_id) AS first FROM p GROUP BY 1), k AS (SELECT pattern AS kept, row_number() OVER (ORDER BY first) - 1 AS code FROM f QUALIFY code < 256) SELECT vec_id, pattern, arg_min(code, {'d': bit_count(xor(pattern, kept)), 'c': code}) AS code, CAST(min(bit_count(xor(pattern, kept))) AS BIGINT) AS distance FROM p, k GROUP BY 1, 2")

# Batches: names, sizes, disks, settings.


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "lang", "n_chars")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


_UPPER = "upper(replace(text, 'ß', 'SS'))"
_BASE = f"CASE WHEN instr({_UPPER}, '.') > 0 THEN regexp_replace({_UPPER}, '\\.[^.]*$', '') ELSE {_UPPER} END"
for _system, (_drop, _length) in batch.NAME_RULES.items():
    _folded = "regexp_replace(text, '^(.|\\n)*/', '')" if _system == "amiga" else _BASE
    if _system == "bbc":
        _folded = f"CASE WHEN length({_BASE}) > 2 AND substring({_BASE}, 2, 1) = '.' THEN substring({_BASE}, 3) ELSE {_BASE} END"
    add(f"name_{_system}", lambda spark, d, s=_system: _texts(spark, d).select("doc_id", batch.clean_name(F.col("text"), s).alias("name")), f"SELECT doc_id, coalesce(substring(regexp_replace({_folded}, '{_drop}', '', 'g'), 1, {_length}), 'FILE') AS name FROM documents")
_PRODOS = f"substring(regexp_replace(coalesce({_UPPER}, ''), '[^\\p{{L}}\\p{{M}}\\p{{N}}.]', '', 'g'), 1, 15)"
add("name_prodos", lambda spark, d: _texts(spark, d).select("doc_id", batch.clean_prodos(F.col("text")).alias("name")), f"SELECT doc_id, CASE WHEN length({_PRODOS}) = 0 THEN 'UNNAMED' WHEN regexp_matches({_PRODOS}, '^\\p{{L}}') THEN {_PRODOS} ELSE substring('A' || {_PRODOS}, 1, 15) END AS name FROM documents")
_FILE = "concat_ws('.', source, text, lang)"
add("name_extension", lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", batch.clean_extension(F.concat_ws(".", "source", "text", "lang")).alias("extension")), f"SELECT doc_id, CASE WHEN instr({_FILE}, '.') > 0 THEN substring(regexp_replace(regexp_extract(upper(replace({_FILE}, 'ß', 'SS')), '\\.([^.]*)$', 1), '[^A-Z0-9]', '', 'g'), 1, 3) ELSE '' END AS extension FROM documents")
_KIND = "CASE doc_id % 5 WHEN 0 THEN 'shr' WHEN 1 THEN 'A2GS' WHEN 2 THEN '3200' WHEN 3 THEN 'bin' ELSE lang END"
add("prodos_types", lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", batch.prodos_type(F.expr(_KIND)).alias("t")).select("doc_id", "t.*"), f"SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN 193 ELSE 6 END AS type, CASE WHEN doc_id % 5 < 2 THEN 0 WHEN doc_id % 5 = 2 THEN 2 ELSE 8192 END AS aux, CASE WHEN doc_id % 5 < 3 THEN 'PIC' ELSE 'BIN' END AS extension FROM documents")
add("name_cbm_bytes", lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", batch.cbm_bytes(F.concat_ws("-", "source", "lang")).alias("bytes")), "SELECT doc_id, rpad(hex(encode(translate(substring(concat_ws('-', source, lang), 1, 16), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'))), 32, 'A0') AS bytes FROM documents")
add("file_dates", lambda spark, d: spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", batch.prodos_date(F.col("o_orderdate")).alias("prodos"), batch.amiga_days(F.col("o_orderdate").cast("date")).alias("amiga")), "SELECT o_orderkey, year(o_orderdate) % 100 * 512 + month(o_orderdate) * 32 + day(o_orderdate) AS prodos, date_diff('day', DATE '1978-01-01', CAST(o_orderdate AS DATE)) AS amiga FROM orders")
_OPTIONS = {"click": ["small", "large"], "purchase": ["large"], "view": ["small", "medium"]}
add("option_available", lambda spark, d: batch.available(spark.read.parquet(f"{d}/events.parquet").withColumn("size", F.expr("case event_id % 3 when 0 then 'small' when 1 then 'medium' else 'large' end")), _OPTIONS, "event_type", "size").select("event_id", "option"), "WITH e AS (SELECT event_id, event_type, CASE event_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS size FROM events), o(event_type, own) AS (VALUES " + ", ".join(f"('{k}', {v!r})" for k, v in _OPTIONS.items()) + ") SELECT event_id, CASE WHEN list_contains(own, size) THEN size ELSE own[1] END AS option FROM e LEFT JOIN o USING (event_type)")
add("asset_union", lambda spark, d: batch.assets(spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select("doc_id", "source", F.split("text", " ").alias("parts")), "source", "parts").select("doc_id", "asset_name", "asset"), "SELECT doc_id, CASE WHEN n > 1 THEN source || '_' || k ELSE source END AS asset_name, parts[k] AS asset FROM (SELECT doc_id, source, parts, len(parts) AS n, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT doc_id, source, string_split(text, ' ') AS parts FROM documents WHERE text IS NOT NULL))")
add("base_name", lambda spark, d: _docs(spark, d).select("doc_id", batch.base_name(F.concat_ws(".", "source", "lang")).alias("base")), "SELECT doc_id, CASE WHEN instr(concat_ws('.', source, lang), '.') > 0 THEN regexp_replace(concat_ws('.', source, lang), '\\.[^.]*$', '') ELSE concat_ws('.', source, lang) END AS base FROM documents")
add("unique_names", lambda spark, d: blocks.unique_names(_docs(spark, d), "source", "doc_id").select("doc_id", "nth", "unique"), "SELECT doc_id, nth, CASE WHEN nth = 1 THEN source ELSE source || '_' || nth END AS unique FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY upper(source) ORDER BY doc_id) AS nth FROM documents)")
add("unique_names_prodos", lambda spark, d: blocks.unique_names(_docs(spark, d), "source", "doc_id", ("lang",), ".", keep=13).select("doc_id", "nth", "unique"), "SELECT doc_id, nth, CASE WHEN nth = 1 THEN source ELSE substring(source, 1, 13) || '.' || (nth - 1) END AS unique FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY lang, upper(source) ORDER BY doc_id) AS nth FROM documents)")


def _chains_sql(unit: int, first: int, end: int, low: int, high: int, keys: str, extra: str = "") -> str:
    """Every free block in turn to the bytes of a disk's files in turn."""
    at = lambda n: f"CASE WHEN {n} + {first} >= {low} THEN {n} + {first} + {high - low + 1} ELSE {n} + {first} END"
    return (
        f"WITH f AS (SELECT {keys} AS disk, doc_id, octet_length(encode(text)) AS bytes, (octet_length(encode(text)) + {unit - 1}) // {unit} AS need FROM documents WHERE text IS NOT NULL), g AS (SELECT *, sum(need) OVER (PARTITION BY disk ORDER BY doc_id) - need AS begun FROM f)"
        f", k AS (SELECT disk, doc_id, bytes, need, CAST(begun AS BIGINT) + nth AS number, nth FROM (SELECT *, unnest(range(need)) AS nth FROM g))"
        f", b AS (SELECT disk, doc_id, nth, {at('number')} AS block, CASE WHEN nth < need - 1 THEN {at('number + 1')} END AS next, least({unit}, bytes - nth * {unit}) AS bytes FROM k) SELECT disk AS {keys.split(' ')[-1] if ' ' in keys else keys}, doc_id, nth, {extra or 'block, next'}, bytes FROM b WHERE block < {end}"
    )


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select("doc_id", "source", F.octet_length("text").cast("long").alias("size"))


def _chains_1541(spark: SparkSession, d: str) -> DataFrame:
    told = blocks.chains(_sized(spark, d), "size", 254, "doc_id", ("source",), end=683, reserved=(blocks.DIRECTORY_1541,))
    here, link = blocks.track_sector(F.col("block"), blocks.ZONES_1541), blocks.track_sector(F.col("next"), blocks.ZONES_1541)
    return told.select("source", "doc_id", "nth", here[0].alias("track"), here[1].alias("sector"), link[0].alias("next_track"), link[1].alias("next_sector"), "bytes")


add("blocks_atari", lambda spark, d: blocks.chains(_sized(spark, d), "size", 125, "doc_id", ("source",), first=4, end=720, reserved=(blocks.RESERVED_ATARI,)).select("source", "doc_id", "nth", "block", "next", "bytes"), _chains_sql(125, 4, 720, 360, 368, "source"))
# A disk's tracks written out one by one: where each begins, and how many sectors it has.
_TRACKS = "tracks AS (SELECT track, n, CAST(sum(n) OVER (ORDER BY track) - n AS BIGINT) AS low FROM (SELECT range + 1 AS track, CASE WHEN range < 17 THEN 21 WHEN range < 24 THEN 19 WHEN range < 30 THEN 18 ELSE 17 END AS n FROM range(35)))"
add("blocks_1541", _chains_1541, _chains_sql(254, 0, 683, 357, 375, "source").replace("WITH f AS", f"WITH {_TRACKS}, f AS").replace("SELECT disk AS source, doc_id, nth, block, next, bytes FROM b WHERE", "SELECT disk AS source, doc_id, nth, h.track, block - h.low AS sector, l.track AS next_track, next - l.low AS next_sector, bytes FROM b JOIN tracks h ON block >= h.low AND block < h.low + h.n LEFT JOIN tracks l ON next >= l.low AND next < l.low + l.n WHERE"))
add("name_hash", lambda spark, d: _docs(spark, d).select("doc_id", packing.name_hash(F.col("source")).alias("bucket")), "SELECT doc_id, list_reduce(list_concat([CAST(length(source) AS BIGINT)], [CAST(ord(c) AS BIGINT) FOR c IN string_split(upper(source), '')]), lambda h, c: (h * 13 + c) & 2047) % 72 AS bucket FROM documents")
add("disk_running_sum", lambda spark, d: blocks.allocate(_docs(spark, d), "n_chars", 488, "doc_id", ("source",), 24).select("doc_id", "blocks", "first_block", "end_block"), "SELECT doc_id, (n_chars + 487) // 488 AS blocks, CAST(24 + sum((n_chars + 487) // 488) OVER w - (n_chars + 487) // 488 AS BIGINT) AS first_block, CAST(24 + sum((n_chars + 487) // 488) OVER w AS BIGINT) AS end_block FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def _fit_sql(rule: str) -> str:
    """The fold over a source's files as a recursive query: what is used, how many are stored, and whether the disk has ended."""
    stored = "least(need, 664 - used)" if rule == "truncate" else "need"
    takes = f"NOT ended AND files < 144 AND {stored} <= 664 - used AND ({stored} > 0 OR need = 0)"
    return f"""WITH RECURSIVE n AS (SELECT source, doc_id, (n_chars + 253) // 254 AS need, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
 f AS (SELECT source, 0::BIGINT AS k, 0::BIGINT AS used, 0::BIGINT AS files, false AS ended, NULL::BIGINT AS ord, NULL::BIGINT AS stored, NULL::BIGINT AS first FROM (SELECT DISTINCT source FROM documents)
 UNION ALL SELECT f.source, n.k, used + CASE WHEN {takes} THEN {stored} ELSE 0 END, files + CASE WHEN {takes} THEN 1 ELSE 0 END, ended OR ({'NOT (' + takes + ')' if rule == 'stop' else 'false'}),
 CASE WHEN {takes} THEN n.doc_id END, CASE WHEN {takes} THEN {stored} END, CASE WHEN {takes} THEN used END FROM f JOIN n ON n.source IS NOT DISTINCT FROM f.source AND n.k = f.k + 1)
 SELECT source, ord, stored, first FROM f WHERE ord IS NOT NULL"""


for _rule in ("skip", "stop", "truncate"):
    add(f"disk_fit_{_rule}", lambda spark, d, r=_rule: batch.fit(_docs(spark, d), "n_chars", 254, 664, 144, "doc_id", ("source",), r).select("source", "ord", "stored", "first"), _fit_sql(_rule))
add("disk_fits", lambda spark, d: blocks.allocate(_docs(spark, d), "n_chars", 254, "doc_id", ("source",)).where("end_block <= 664").groupBy("source").agg(F.count("*").alias("files"), F.max("end_block").alias("used")), "SELECT source, count(*) AS files, CAST(max(e) AS BIGINT) AS used FROM (SELECT source, sum((n_chars + 253) // 254) OVER (PARTITION BY source ORDER BY doc_id) AS e FROM documents) WHERE e <= 664 GROUP BY 1")
add("dir_listing", lambda spark, d: _docs(spark, d).groupBy("source").agg(F.sum(F.expr("((n_chars + 127) div 128) * 128")).alias("bytes"), F.count("*").alias("extents")).orderBy(F.lower("source")), "SELECT source, CAST(sum((n_chars + 127) // 128 * 128) AS BIGINT) AS bytes, count(*) AS extents FROM documents GROUP BY 1")
add("size_text", lambda spark, d: _docs(spark, d).select("doc_id", batch.size_text(F.col("n_chars")).alias("size")), "SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%d B', n_chars) WHEN n_chars < 1048576 THEN printf('%.1f KB', floor(n_chars / 1024.0::DOUBLE * 10 + 0.5::DOUBLE) / 10) ELSE printf('%.1f MB', floor(n_chars / 1048576.0::DOUBLE * 10 + 0.5::DOUBLE) / 10) END AS size FROM documents")
add("selected_or_all", lambda spark, d: batch.selected_or_all(_docs(spark, d), _docs(spark, d).where("n_chars > 3000"), "doc_id").select("doc_id"), "SELECT doc_id FROM documents WHERE n_chars > 3000 OR NOT EXISTS (SELECT 1 FROM documents WHERE n_chars > 3000)")
add("range_select", lambda spark, d: _docs(spark, d).where(F.col("doc_id").between(10, 50)).select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id BETWEEN 10 AND 50")
add("remove_selected", lambda spark, d: _docs(spark, d).join(_docs(spark, d).where("n_chars > 3000").select("doc_id"), "doc_id", "left_anti").select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 3000)")


def _settings(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    locked = events.where("event_id % 3 = 0").select("event_id", F.when(F.col("event_id") % 2 == 0, "zx").otherwise("c64").alias("machine"), F.create_map(F.lit("mode"), F.col("event_type")).alias("settings"))
    told = batch.resolve_settings(events.select("event_id"), locked, "event_id", "zx", {"mode": "hires", "dither": "none"})
    return told.select("event_id", F.col("settings")["mode"].alias("mode"), F.col("settings")["dither"].alias("dither"))


add("settings", _settings, "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN coalesce(event_type, 'hires') ELSE 'hires' END AS mode, 'none' AS dither FROM events")
add("validate_size", lambda spark, d: batch.validate_size(_docs(spark, d).select("doc_id", (F.col("doc_id") % 3).alias("width"), (F.col("n_chars") % 2).alias("height"))).select("doc_id", "error"), "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND n_chars % 2 = 0 THEN 'emptyImage' WHEN doc_id % 3 <= 0 OR n_chars % 2 <= 0 THEN 'invalidDimensions' END AS error FROM documents")
add("batch_summary", lambda spark, d: batch.summary(_docs(spark, d).withColumn("error", F.when(F.col("n_chars") % 5 == 0, "bad")), "source", "error", "doc_id"), "WITH f AS (SELECT doc_id, source FROM documents WHERE n_chars % 5 = 0) SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM f) AS failed, (SELECT string_agg(source, ', ' ORDER BY doc_id) FROM (SELECT * FROM f ORDER BY doc_id LIMIT 3)) || CASE WHEN (SELECT count(*) FROM f) > 3 THEN ' and ' || ((SELECT count(*) FROM f) - 3) || ' more' ELSE '' END AS failures")
add("byte_checksum", lambda spark, d: _docs(spark, d).withColumn("hex", F.md5("source")).select("doc_id", packing.byte_sum("hex").alias("checksum")), "SELECT doc_id, CAST(list_sum(list_transform(range(16), lambda k: ('0x' || substring(md5(source), 2*k+1, 2))::INT)) AS BIGINT) % 65536 AS checksum FROM documents")

_WORDS = "[CAST('0x' || substring(hex, 8*k+1, 8) AS BIGINT) FOR k IN range(length(hex) // 8)]"
_HEX = "WITH h AS (SELECT doc_id, md5(source) || sha256(lang) AS hex FROM documents)"
add("block_checksum", lambda spark, d: _docs(spark, d).withColumn("hex", F.concat(F.md5("source"), F.sha2("lang", 256))).select("doc_id", packing.block_checksum("hex").alias("checksum")), f"{_HEX} SELECT doc_id, (4294967296 - CAST(list_sum({_WORDS}) AS BIGINT) % 4294967296) % 4294967296 AS checksum FROM h")
add("boot_checksum", lambda spark, d: _docs(spark, d).withColumn("hex", F.concat(F.md5("source"), F.sha2("lang", 256))).select("doc_id", packing.boot_checksum("hex").alias("checksum")), f"{_HEX} SELECT doc_id, 4294967295 - list_reduce(list_concat([0::BIGINT], {_WORDS}), lambda t, w: CASE WHEN t + w >= 4294967296 THEN t + w - 4294967296 + 1 ELSE t + w END) AS checksum FROM h")

# Sequential kernels: images are strips of ten rows, so that they are many.


def _strips(spark: SparkSession, d: str) -> DataFrame:
    return orders_raster(spark, d).withColumn("image_id", F.expr("y div 10")).withColumn("y", F.expr("y % 10"))


#: Lines of two kinds: sixteen greys, or a palette of colours.
_LINES = [[(17 * k, 17 * k, 17 * k) for k in range(16)], IIGS]
add("diffuse_lines", lambda spark, d: sequential.diffuse_lines(_strips(spark, d), _LINES, _strips(spark, d).select("image_id", "y", F.expr("cast(y div 3 % 2 as int)").alias("slot")).distinct()))
on_raster("match_lines", lambda px: color.nearest(px.where("y % 2 = 0"), _LINES[0]).unionByName(color.nearest(px.where("y % 2 = 1"), _LINES[1])).select("x", "y", "idx"), f"{palette_sql(_LINES[0], 'one')}{palette_sql(_LINES[1], 'two')}, pal AS (SELECT 0 AS slot, * FROM one UNION ALL SELECT 1, * FROM two) SELECT x, y, arg_min(i, {{'d': (r-pr)*(r-pr) + (g-pg)*(g-pg) + (b-pb)*(b-pb), 'i': i}}) AS idx FROM px JOIN pal ON slot = y % 2 GROUP BY 1, 2")
for _kernel in sequential.DIFFUSION:
    add(f"diffuse_{_kernel}", lambda spark, d, k=_kernel: sequential.diffuse(_strips(spark, d), BBC, k))
# The whole raster as one image, in bands.
add("diffuse_bands", lambda spark, d: sequential.diffuse_bands(orders_raster(spark, d).withColumn("image_id", F.lit(0)), BBC).select("y", "x", "idx"))
add("diffuse_whole", lambda spark, d: sequential.diffuse(_strips(spark, d), BBC, whole=True))
add("diffuse_cells", lambda spark, d: sequential.diffuse(_strips(spark, d), BBC, cell=(8, 8)))
def _ham_sql(palette: list[Colour], bits: int) -> str:
    """Hold-and-modify as a recursive query from left to right along all rows: of the palette's entries and of the colour
    before with one channel set, the least error wins, then the palette, red, green, blue."""
    top = (1 << bits) - 1
    step = f"(255::DOUBLE / {top}::DOUBLE)"
    level = {c: f"CAST(least(greatest(floor({c} / {step} + 0.5::DOUBLE), 0), {top}) AS BIGINT)" for c in "rgb"}
    gap = "({0}-r)*({0}-r) + ({1}-g)*({1}-g) + ({2}-b)*({2}-b)".format
    entries = "[" + ", ".join(f"{{'i': {i}::BIGINT, 'r': {r}::DOUBLE, 'g': {g}::DOUBLE, 'b': {b}::DOUBLE}}" for i, (r, g, b) in enumerate(palette)) + "]"
    tries = [f"{{'e': {gap('p.r', 'p.g', 'p.b')}, 'o': 0, 'c': p.i, 'r': p.r, 'g': p.g, 'b': p.b}}"]
    for order, (c, control) in enumerate((("r", 2), ("g", 3), ("b", 1)), 1):
        made = {k: f"{level[k]} * {step}" if k == c else f"w{k}" for k in "rgb"}
        tries.append(f"{{'e': {gap(*made.values())}, 'o': {order}, 'c': {level[c]} + {control << bits}, 'r': CAST({made['r']} AS DOUBLE), 'g': CAST({made['g']} AS DOUBLE), 'b': CAST({made['b']} AS DOUBLE)}}")
    return (
        R150.replace("WITH px", "WITH RECURSIVE px", 1)
        + f", s AS (SELECT DISTINCT y, -1::BIGINT AS x, 0::BIGINT AS code, {palette[0][0]}::DOUBLE AS wr, {palette[0][1]}::DOUBLE AS wg, {palette[0][2]}::DOUBLE AS wb FROM px), h AS (SELECT * FROM s UNION ALL SELECT y, x, best.c, best.r, best.g, best.b FROM"
        + f" (SELECT px.y, px.x, list_sort(list_concat([{tries[0]} FOR p IN {entries}], [{', '.join(tries[1:])}]))[1] AS best FROM h JOIN (SELECT x, y, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b FROM px) px ON px.y = h.y AND px.x = h.x + 1))"
    )


add("ham6", lambda spark, d: sequential.hold_and_modify(_strips(spark, d), PALETTES["cga16"]), _ham_sql(PALETTES["cga16"], 4) + " SELECT y // 10 AS image_id, y % 10 AS y, x, code FROM h WHERE x >= 0")
add("ham8", lambda spark, d: sequential.hold_and_modify(_strips(spark, d), PALETTES["ega64"], bits=6), _ham_sql(PALETTES["ega64"], 6) + " SELECT y // 10 AS image_id, y % 10 AS y, x, code FROM h WHERE x >= 0")
add("ham6_fold", lambda spark, d: sequential.hold_fold(_strips(spark, d), PALETTES["cga16"]).select("image_id", "y", F.concat_ws(",", F.col("codes").cast("array<string>")).alias("codes")), _ham_sql(PALETTES["cga16"], 4) + " SELECT y // 10 AS image_id, y % 10 AS y, string_agg(CAST(code AS VARCHAR), ',' ORDER BY x) AS codes FROM h WHERE x >= 0 GROUP BY 1, 2")
adaptive.register(add, R150)

# Native files and disks: images are strips of fifty rows.


def _images(spark: SparkSession, d: str) -> DataFrame:
    return orders_raster(spark, d).withColumn("image_id", F.expr("y div 50")).withColumn("y", F.expr("y % 50"))


for _kind in ("png", "bmp"):
    # Files and back: the pixels are those of the raster, and the head tells its size.
    _named = lambda spark, d, k=_kind: machines.previews(_strips(spark, d).withColumn("image_id", F.col("image_id").cast("string")), k)
    add(f"decode_{_kind}", lambda spark, d, f=_named: pixels(f(spark, d)).select("image_id", *[F.col(c).cast("long").alias(c) for c in ("y", "x", "r", "g", "b", "a")]), R150 + " SELECT CAST(y // 10 AS VARCHAR) AS image_id, y % 10 AS y, x, r, g, b, 255::BIGINT AS a FROM px")
    add(f"metadata_{_kind}", lambda spark, d, f=_named: metadata(f(spark, d)), R150 + f" SELECT CAST(y // 10 AS VARCHAR) AS image_id, count(DISTINCT x) AS width, count(DISTINCT y) AS height, 24::BIGINT AS bits_per_pixel, 'RGB' AS color_space, 72::BIGINT AS dpi, false AS has_alpha FROM px GROUP BY 1")
def _file_sql(width: int, height: int, palette: list[Colour], depth: int, head: str = "", tail: str = "") -> str:
    """A file of packed rows between fixed bytes, for sizes no smaller than an image's: each place shows the pixel under it."""
    per = 8 // depth
    return (
        R150 + f", im AS (SELECT y // 50 AS image_id, max(y % 50) + 1 AS tall FROM px GROUP BY 1), t AS (SELECT im.image_id, ty, tx, r, g, b FROM im, (SELECT range AS ty FROM range({height})), (SELECT range AS tx FROM range({width})) JOIN px ON px.y = im.image_id * 50 + ty * tall // {height} AND px.x = tx * 150 // {width})"
        + palette_sql(palette)
        + f", m AS (SELECT image_id, ty, tx, arg_min(i, {{'d': (r-pr)*(r-pr) + (g-pg)*(g-pg) + (b-pb)*(b-pb), 'i': i}}) AS idx FROM t, pal GROUP BY 1, 2, 3), y AS (SELECT image_id, ty, tx // {per} AS col, CAST(sum(idx << ({depth} * ({per} - 1 - tx % {per}))::INT) AS BIGINT) AS byte FROM m GROUP BY 1, 2, 3)"
        + f", f AS (SELECT image_id, '{head}' || string_agg(printf('%02X', byte), '' ORDER BY ty, col) || '{tail}' AS hex FROM y GROUP BY 1) SELECT image_id, {width} AS width, {height} AS height, CAST(length(hex) // 2 AS INTEGER) AS size, md5(unhex(hex)) AS digest, CAST(NULL AS VARCHAR) AS error FROM f"
    )


def _chosen_sql(width: int, height: int, table: list[Colour], n: int, depth: int, tail: str, mode: str = "", head: str = "", spread: bool = False) -> str:
    """A file in the image's n most frequent colours of a table, with a part for each of them (SQL text in k, r, g, b) before
    or after the rows. spread: the bits of a pixel lie apart in the byte, and bytes come character by character."""
    per = 8 // depth
    place = f"+ {per} * b.range " if spread else f"+ b.range + {depth - 1} * ({per} - 1 - tx % {per}) "
    order = "ty // 8, col, ty % 8" if spread else "ty, col"
    own = f"(SELECT string_agg(printf('%02X', {tail}), '' ORDER BY slot) FROM best WHERE best.image_id = f.image_id)"
    parts = (f"'{head}' || {own} || body" if head else f"body || '{mode}' || {own}")
    return (
        R150 + f", im AS (SELECT y // 50 AS image_id, max(y % 50) + 1 AS tall FROM px GROUP BY 1), t AS (SELECT im.image_id, ty, tx, r, g, b FROM im, (SELECT range AS ty FROM range({height})), (SELECT range AS tx FROM range({width})) JOIN px ON px.y = im.image_id * 50 + ty * tall // {height} AND px.x = tx * 150 // {width})"
        + palette_sql(table)
        + ", u AS (SELECT image_id, r, g, b, count(*) AS n FROM t GROUP BY ALL), v AS (SELECT image_id, r, g, b, any_value(n) AS n, arg_min(i, {'d': (r-pr)*(r-pr) + (g-pg)*(g-pg) + (b-pb)*(b-pb), 'i': i}) AS k FROM u, pal GROUP BY 1, 2, 3, 4)"
        + f", best AS (SELECT image_id, k, row_number() OVER (PARTITION BY image_id ORDER BY sum(n) DESC, k) - 1 AS slot FROM v GROUP BY image_id, k QUALIFY slot < {n})"
        + ", m AS (SELECT t.image_id, ty, tx, arg_min(slot, {'d': (r-pr)*(r-pr) + (g-pg)*(g-pg) + (b-pb)*(b-pb), 'i': slot}) AS idx FROM t JOIN best USING (image_id) JOIN pal ON i = k GROUP BY 1, 2, 3)"
        + f", y AS (SELECT image_id, ty, tx // {per} AS col, CAST(sum((idx >> b.range::INT & 1) << ({per} - 1 - tx % {per} {place})::INT) AS BIGINT) AS byte FROM m, range({depth}) b GROUP BY 1, 2, 3)"
        + f", f AS (SELECT image_id, string_agg(printf('%02X', byte), '' ORDER BY {order}) AS body FROM y GROUP BY 1), h AS (SELECT image_id, {parts} AS hex FROM f) SELECT image_id, {width} AS width, {height} AS height, CAST(length(hex) // 2 AS INTEGER) AS size, md5(unhex(hex)) AS digest, CAST(NULL AS VARCHAR) AS error FROM h"
    )


_word = lambda c: (c[0] + 8) // 17 << 8 | (c[1] + 8) // 17 << 4 | (c[2] + 8) // 17
_FILES_SQL = {
    "coco_pmode4": _file_sql(256, 192, [(0, 0, 0), (255, 255, 255)], 1),
    "coco_coco3": _file_sql(320, 200, PALETTES["coco3"], 4),
    "coco_coco3_4": _file_sql(640, 200, PALETTES["coco3"][:4], 2),
    "msx_screen8": _file_sql(256, 212, PALETTES["rgb332"], 8, "FE0000FFD30000"),
    "iigs_320": _file_sql(320, 200, IIGS, 4, tail="00" * 256 + "".join(f"{_word(c) & 255:02X}{_word(c) >> 8:02X}" for c in IIGS) + "00" * 480),
    "atarist_high": _file_sql(640, 400, [(255, 255, 255), (0, 0, 0)], 1, "00020777" + "0000" * 15),
}
def _cells_sql(width: int, height: int, palette: list[Colour], lines: int, file: str, bits_order: str, cell_byte: str, cells_order: str) -> str:
    """A file of two colours a cell of eight by `lines`: bits are set for the commoner one. file: SQL text in bits and cells."""
    return (
        R150 + f", im AS (SELECT y // 50 AS image_id, max(y % 50) + 1 AS tall FROM px GROUP BY 1), t AS (SELECT im.image_id, ty, tx, r, g, b FROM im, (SELECT range AS ty FROM range({height})), (SELECT range AS tx FROM range({width})) JOIN px ON px.y = im.image_id * 50 + ty * tall // {height} AND px.x = tx * 150 // {width})"
        + palette_sql(palette)
        + f", m AS (SELECT image_id, ty, tx, arg_min(i, {{'d': (r-pr)*(r-pr) + (g-pg)*(g-pg) + (b-pb)*(b-pb), 'i': i}}) AS idx FROM t, pal GROUP BY 1, 2, 3)"
        + f", c AS (SELECT image_id, ty // {lines} AS cy, tx // 8 AS cx, idx, row_number() OVER (PARTITION BY image_id, cy, cx ORDER BY count(*) DESC, idx) - 1 AS slot FROM m GROUP BY 1, 2, 3, 4 QUALIFY slot < 2)"
        + ", k AS (SELECT image_id, cy, cx, max(CASE WHEN slot = 0 THEN idx END) AS one, coalesce(max(CASE WHEN slot = 1 THEN idx END), max(CASE WHEN slot = 0 THEN idx END)) AS two FROM c GROUP BY 1, 2, 3)"
        + f", p AS (SELECT t.image_id, ty, tx, arg_min(slot, {{'d': (r-pr)*(r-pr) + (g-pg)*(g-pg) + (b-pb)*(b-pb), 's': slot}}) AS slot FROM t JOIN c ON c.image_id = t.image_id AND cy = ty // {lines} AND cx = tx // 8 JOIN pal ON i = idx GROUP BY 1, 2, 3)"
        + ", y AS (SELECT image_id, ty, tx // 8 AS col, CAST(sum((1 - slot) << (7 - tx % 8)::INT) AS BIGINT) AS byte FROM p GROUP BY 1, 2, 3)"
        + f", f AS (SELECT image_id, string_agg(printf('%02X', byte), '' ORDER BY {bits_order}) AS bits FROM y GROUP BY 1), a AS (SELECT image_id, string_agg(printf('%02X', {cell_byte}), '' ORDER BY {cells_order}) AS cells FROM k GROUP BY 1)"
        + f", h AS (SELECT image_id, {file} AS hex FROM f JOIN a USING (image_id)) SELECT image_id, {width} AS width, {height} AS height, CAST(length(hex) // 2 AS INTEGER) AS size, md5(unhex(hex)) AS digest, CAST(NULL AS VARCHAR) AS error FROM h"
    )


_FILES_SQL["zx_hires"] = _cells_sql(256, 192, ZX, 8, "bits || cells", "ty // 64, ty % 8, ty // 8 % 8, col", "(one >> 1) | ((two >> 1) << 3) | (((one | two) & 1) << 6)", "cy, cx")
_FILES_SQL["c64_hires"] = _cells_sql(320, 200, C64, 8, "'0020' || bits || cells", "ty // 8, col, ty % 8", "(one << 4) | two", "cy, cx")
_FILES_SQL["msx_screen2"] = _cells_sql(256, 192, TMS9918, 1, f"'FE0000FF370000' || bits || cells || '{bytes(range(256)).hex().upper() * 3}'", "ty // 8, col, ty % 8", "(one << 4) | two", "cy // 8, cx, cy % 8")
for _mode, _size, _n, _depth in ((0, 640, 2, 1), (1, 320, 4, 2), (2, 160, 8, 4), (4, 320, 2, 1), (5, 160, 4, 2)):
    _FILES_SQL[f"bbc_mode{_mode}"] = _chosen_sql(_size, 256, BBC, _n, _depth, "k", f"{_mode:02X}", spread=True)
for _mode, _size, _n, _depth in ((8, 320, 2, 1), (15, 160, 4, 2)):
    _FILES_SQL[f"atari800_gr{_mode}"] = _chosen_sql(_size, 192, PALETTES["atari128"], _n, _depth, "k // 8 * 16 + k % 8 * 2")
_FILES_SQL["msx_screen5"] = _chosen_sql(256, 212, PALETTES["v9938"], 16, 4, "k", head="FE00001F6A0000").replace("printf('%02X', k)", "printf('%02X%02X', k // 64 * 16 + k % 8, k // 8 % 8)")
# Native files without Python: whole screens, and runs put together in their order.
_told = lambda files, width, height: files.select("image_id", F.lit(width).alias("width"), F.lit(height).alias("height"), F.length("content").alias("size"), F.md5("content").alias("digest"))
add("screen_zx", lambda spark, d: _told(native.spectrum_screen(_images(spark, d), ZX), 256, 192), _FILES_SQL["zx_hires"].replace(", CAST(NULL AS VARCHAR) AS error", ""))
_PCX = _file_sql(320, 200, PALETTES["cga4_1_high"], 2).split(", f AS (SELECT image_id, '")[0]
add(
    "file_pcx_cga",
    lambda spark, d: _told(native.pcx_file(_images(spark, d), PALETTES["cga4_1_high"]), 320, 200),
    _PCX + ", a AS (SELECT *, CASE WHEN lag(byte) OVER w = byte THEN 0 ELSE 1 END AS s FROM y WINDOW w AS (PARTITION BY image_id, ty ORDER BY col)), u AS (SELECT *, sum(s) OVER (PARTITION BY image_id, ty ORDER BY col) AS run FROM a), q AS (SELECT *, (row_number() OVER (PARTITION BY image_id, ty, run ORDER BY col) - 1) // 63 AS part FROM u)"
    " , e AS (SELECT image_id, ty, min(col) AS start, CASE WHEN count(*) = 1 AND any_value(byte) < 192 THEN printf('%02X', any_value(byte)) ELSE printf('%02X%02X', count(*) + 192, any_value(byte)) END AS hex FROM q GROUP BY image_id, ty, run, part)"
    f", h AS (SELECT image_id, '0A050102000000003F01C70048004800{''.join(f'{v:02X}' for c in PALETTES['cga4_1_high'] for v in c)}{'00' * 36}000150000100{'00' * 58}' || string_agg(hex, '' ORDER BY ty, start) AS hex FROM e GROUP BY 1) SELECT image_id, 320 AS width, 200 AS height, CAST(length(hex) // 2 AS INTEGER) AS size, md5(unhex(hex)) AS digest FROM h",
)
for _mode in machines.MODES:
    add(f"convert_{_mode}", lambda spark, d, m=_mode: machines.convert(_images(spark, d), m).select("image_id", "width", "height", F.length("content").alias("size"), F.md5("content").alias("digest"), "error"), _FILES_SQL.get(_mode))


def _files(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null")
    name = F.concat(F.lit("F"), F.col("doc_id"), F.lit(".TXT"))
    return docs.select(F.expr("doc_id div 20").alias("disk_id"), F.col("doc_id").alias("ord"), name.alias("name"), F.encode("text", "UTF-8").alias("content"))


for _system in BUILDERS:
    add(f"disk_{_system}", lambda spark, d, s=_system: build_disks(_files(spark, d), s).select("disk_id", "system", "size_bytes", "files", F.md5("content").alias("digest")))
# Which files a disk stores, as SQL: `need` of each, summed in order; what does not fit ends the disk or is cut short.
_DISK_FILES = "f AS (SELECT doc_id // 20 AS disk_id, doc_id AS ord, 'F' || doc_id || '.TXT' AS name, octet_length(encode(text)) AS bytes, md5(text) AS digest FROM documents WHERE text IS NOT NULL)"


def _stored_sql(need: str, first: int, room: int, most: int, bad: str = "false") -> str:
    """g: the stored files of disks that end with the first file that does not fit."""
    return f"WITH {_DISK_FILES}, n AS (SELECT *, {need} AS need FROM f), c AS (SELECT *, {first} + sum(need) OVER w AS upto, row_number() OVER w AS k, bool_or({bad}) OVER w AS ended FROM n WINDOW w AS (PARTITION BY disk_id ORDER BY ord)), g AS (SELECT * FROM c WHERE upto <= {room} AND k <= {most} AND NOT ended)"


_PRODOS_NEED = "greatest(1, (bytes + 511) // 512) + CASE WHEN bytes <= 512 THEN 0 ELSE ((bytes + 511) // 512 + 255) // 256 END + CASE WHEN bytes > 131072 THEN 1 ELSE 0 END"
_LISTED = {
    "acorn_dfs": _stored_sql("(bytes + 255) // 256", 2, 800, 31) + " SELECT disk_id, substring(name, 1, 7) AS name, bytes AS size FROM g",
    "trdos": _stored_sql("(bytes + 255) // 256", 16, 2560, 128, "(bytes + 255) // 256 > 255") + " SELECT disk_id, rtrim(substring(name, 1, 8)) AS name, bytes % 65536 AS size FROM g",
    "prodos": _stored_sql(_PRODOS_NEED, 24, 1600, 51) + " SELECT disk_id, name, bytes AS size FROM g",
}
_LISTED["coco_dos"] = _stored_sql("greatest(1, (bytes + 2303) // 2304)", 0, 68, 72) + " SELECT disk_id, name, bytes AS size FROM g"
_LISTED["amiga_ofs"] = _stored_sql("(bytes + 487) // 488 + greatest(1, ((bytes + 487) // 488 + 71) // 72)", 0, 1756, 1 << 30) + " SELECT disk_id, name, bytes AS size FROM g"
_LISTED["cpc_data"] = _stored_sql("(bytes + 1023) // 1024", 2, 180, 64, "sum(greatest(1, ((bytes + 1023) // 1024 + 15) // 16)) OVER (PARTITION BY disk_id ORDER BY ord) > 64").replace("bool_or(sum", "(sum").replace(" > 64) OVER w AS ended", " > 64) AS ended") + " SELECT disk_id, name, (bytes + 127) // 128 * 128 AS size FROM g"
_LISTED["atari_dos"] = f"WITH {_DISK_FILES}, n AS (SELECT *, greatest(1, (bytes + 124) // 125) AS need FROM f), c AS (SELECT *, CAST(sum(need) OVER w AS BIGINT) - need AS before, row_number() OVER w AS k FROM n WINDOW w AS (PARTITION BY disk_id ORDER BY ord)) SELECT disk_id, name, least(bytes, (707 - before) * 125) AS size FROM c WHERE before < 707 AND k <= 64"
_SIDE = "sum((bytes + 255) // 256) OVER w <= 798 AND row_number() OVER w <= 31 AS fits"
_LISTED["acorn_double"] = f"WITH {_DISK_FILES}, a AS (SELECT *, {_SIDE} FROM f WINDOW w AS (PARTITION BY disk_id ORDER BY ord)), b AS (SELECT disk_id, ord, name, bytes, {_SIDE} FROM a WHERE NOT fits WINDOW w AS (PARTITION BY disk_id ORDER BY ord)) SELECT disk_id, substring(name, 1, 7) AS name, bytes AS size FROM (SELECT disk_id, name, bytes FROM a WHERE fits UNION ALL SELECT disk_id, name, bytes FROM b WHERE fits)"
for _system, (_sectors, _cluster, _roots, _, _fat, _, _) in FAT12.items():
    # A file that does not fit is skipped and the next one tried: a recursive query along each disk's files.
    _room = (_sectors * 512 - (1 + 2 * _fat) * 512 - _roots * 32) // (_cluster * 512)
    _takes = f"files + 2 <= {_roots} AND used + need <= {_room}"
    _LISTED[_system] = f"""WITH RECURSIVE {_DISK_FILES}, n AS (SELECT *, (bytes + {_cluster * 512 - 1}) // {_cluster * 512} AS need, row_number() OVER (PARTITION BY disk_id ORDER BY ord) AS k FROM f),
 s AS (SELECT disk_id, 0::BIGINT AS k, 0::BIGINT AS used, 0::BIGINT AS files, NULL::VARCHAR AS name, NULL::BIGINT AS size FROM (SELECT DISTINCT disk_id FROM n) UNION ALL
 SELECT s.disk_id, n.k, used + CASE WHEN {_takes} THEN need ELSE 0 END, files + CASE WHEN {_takes} THEN 1 ELSE 0 END, CASE WHEN {_takes} THEN n.name END, bytes FROM s JOIN n ON n.disk_id = s.disk_id AND n.k = s.k + 1)
 SELECT disk_id, name, size FROM s WHERE name IS NOT NULL"""
for _system, _blocks, _most in (("commodore_1541", 664, 144), ("commodore_1571", 1328, 144), ("commodore_1581", 3160, 296)):
    _LISTED[_system] = f"WITH {_DISK_FILES}, n AS (SELECT *, greatest(1, (bytes + 253) // 254) AS need FROM f), c AS (SELECT *, CAST(sum(need) OVER w AS BIGINT) - need AS before, row_number() OVER w AS k FROM n WINDOW w AS (PARTITION BY disk_id ORDER BY ord)) SELECT disk_id, substring(name, 1, 16) AS name, least(need, {_blocks} - before) AS size FROM c WHERE before < {_blocks} AND k <= {_most}"
for _system in LISTINGS:
    add(f"listing_{_system}", lambda spark, d, s=_system: list_disks(build_disks(_files(spark, d), s), s), _LISTED.get(_system))
_MANY = E8 + ", p AS (SELECT vec_id % 3 AS image, vec_id, bit_or(CASE WHEN lum <= 127 THEN 0 WHEN x = 0 AND y = 0 THEN (-9223372036854775808)::BIGINT ELSE 1::BIGINT << (63 - (y*8 + x))::INT END) AS pattern FROM e8 GROUP BY 1, 2)"
add("charset_by_image", lambda spark, d: packing.charset(_cells(spark, d).withColumn("image", F.expr("vec_id % 3")), "vec_id", 64, keys=("image",)), _MANY + ", f AS (SELECT image, pattern, min(vec_id) AS first FROM p GROUP BY 1, 2), k AS (SELECT image, pattern AS kept, row_number() OVER (PARTITION BY image ORDER BY first) - 1 AS code FROM f QUALIFY code < 64) SELECT image, vec_id, pattern, arg_min(code, {'d': bit_count(xor(pattern, kept)), 'c': code}) AS code, CAST(min(bit_count(xor(pattern, kept))) AS BIGINT) AS distance FROM p JOIN k USING (image) GROUP BY 1, 2, 3")
add("extract_prodos", lambda spark, d: extract_files(build_disks(_files(spark, d), "prodos")).select("disk_id", "name", F.octet_length("content").cast("long").alias("bytes"), F.md5("content").alias("digest")), _stored_sql(_PRODOS_NEED, 24, 1600, 51) + " SELECT disk_id, name, bytes, digest FROM g")
# Programs of statements made from the orders: every keyword in turn, with strings, remarks and data.
_KEYWORDS = "[" + ", ".join("'" + w + "'" for w in basic.KEYWORDS) + "]"
_LINE = "{n} || ' ' || {a} || ' ' || {p} || ' : ' || lower({b}) || '(\"' || {c} || ' x' || {p} || CASE WHEN {n} % 5 = 0 THEN '' ELSE '\"' END || ', B%' || {c}"


def _statements(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    word = lambda at: F.element_at(F.split(F.lit(" ".join(basic.KEYWORDS)), " "), (F.expr(at) % len(basic.KEYWORDS) + 1).cast("int"))
    told = orders.select(F.expr("o_orderkey div 500").alias("program"), F.expr("o_orderkey % 500").alias("nth"), word("o_orderkey").alias("a"), word("o_custkey").alias("b"), word("o_orderkey * 7 + o_custkey").alias("c"), F.expr("cast(floor(o_totalprice) as bigint)").alias("p"))
    return told.withColumn("n", F.col("nth") + 1).withColumn("text", F.expr(_LINE.format(n="n", a="a", b="b", c="c", p="p")))


_CODES = "map([" + ", ".join("'" + w + "'" for w in basic.CODES) + "], [" + ", ".join(f"'{c:02X}'" for c in basic.CODES.values()) + "])"
_TOKEN = f"CASE WHEN starts_with(t, '\"') THEN hex(encode(t)) WHEN starts_with(upper(t), 'REM') THEN '{basic.CODES['REM']:02X}' || hex(encode(substring(t, 4))) WHEN starts_with(upper(t), 'DATA') THEN '{basic.CODES['DATA']:02X}' || hex(encode(substring(t, 5))) ELSE coalesce({_CODES}[upper(t)], hex(encode(t))) END"
_WORD_SQL = "printf('%02X%02X', {0} % 256, {0} // 256)".format
add(
    "basic_programs",
    lambda spark, d: programs.linked_programs(_statements(spark, d), ("program",), "nth").select("program", F.length("content").alias("size"), F.md5("content").alias("digest")),
    f"WITH k AS (SELECT {_KEYWORDS} AS kw), o AS (SELECT o_orderkey // 500 AS program, o_orderkey % 500 + 1 AS n, kw[CAST(o_orderkey % {len(basic.KEYWORDS)} + 1 AS INT)] AS a, kw[CAST(o_custkey % {len(basic.KEYWORDS)} + 1 AS INT)] AS b, kw[CAST((o_orderkey * 7 + o_custkey) % {len(basic.KEYWORDS)} + 1 AS INT)] AS c, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders, k)"
    f", l AS (SELECT program, n, regexp_replace({_LINE.format(n='n', a='a', b='b', c='c', p='p')}, '^[0-9]+ *', '') AS body FROM o), h AS (SELECT program, n, array_to_string([{_TOKEN} FOR t IN regexp_extract_all(body, '{programs.PARTS}')], '') AS hex FROM l)"
    f", u AS (SELECT *, CAST({basic.START} + sum(length(hex) // 2 + 5) OVER (PARTITION BY program ORDER BY n) AS BIGINT) AS upto FROM h), g AS (SELECT program, string_agg({_WORD_SQL('upto')} || {_WORD_SQL('n')} || hex || '00', '' ORDER BY n) || '0000' AS hex FROM u GROUP BY 1) SELECT program, CAST(length(hex) // 2 AS INTEGER) AS size, md5(unhex(hex)) AS digest FROM g",
)
# The same read as relations.
add("volume_amiga_ofs", lambda spark, d: volumes.amiga_listing(build_disks(_files(spark, d), "amiga_ofs")).select("disk_id", "name", "size"), _LISTED["amiga_ofs"])
add("volume_cpc_data", lambda spark, d: volumes.cpc_listing(build_disks(_files(spark, d), "cpc_data")), _LISTED["cpc_data"])
add("volume_prodos", lambda spark, d: volumes.prodos_files(build_disks(_files(spark, d), "prodos")).select("disk_id", "name", F.octet_length("content").cast("long").alias("bytes"), F.md5("content").alias("digest")), _stored_sql(_PRODOS_NEED, 24, 1600, 51) + " SELECT disk_id, name, bytes, digest FROM g")
add("basic_tokens", lambda spark, d: basic.remark_programs(_texts(spark, d), "doc_id").select("doc_id", "part", F.hex("content").alias("program")))
