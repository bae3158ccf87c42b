"""Queries on palettes that are computed per image or line, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adaptive, blocks, color
from ..sources.rasters import orders_raster

Add = Callable[..., None]


def strips(spark: SparkSession, d: str) -> DataFrame:
    """The raster as images of ten lines."""
    return orders_raster(spark, d).withColumn("image_id", F.expr("y div 10")).withColumn("y", F.expr("y % 10"))


def cut_sql(rows: str, keys: str, colours: int, order: str, name: str) -> str:
    """CTEs for DuckDB: `name`(keys, idx, r, g, b), the means of the boxes of rows(keys, r, g, b), each pixel going down its path."""
    spans = ", ".join(f"max({c}) OVER b - min({c}) OVER b AS s{c}" for c in "rgb")
    axis = "CASE WHEN sr >= sg AND sr >= sb THEN {0} WHEN sg >= sb THEN {1} ELSE {2} END".format
    by = "greatest(sr, sg, sb) DESC, path" if order == "widest" else "length(path), path"
    place = "path" if order == "widest" else "length(path), path"
    on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM o.{k}" for k in keys.split(", "))
    return f"""{name}_t AS (SELECT {keys}, '' AS path, r, g, b FROM {rows} UNION ALL
 SELECT {keys}, path || CASE WHEN place <= size // 2 THEN '0' ELSE '1' END, r, g, b FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, path ORDER BY {axis('r', 'g', 'b')}, {axis('g', 'r', 'r')}, {axis('b', 'b', 'g')}) AS place
 FROM (SELECT *, {spans}, count(*) OVER b AS size FROM {name}_t WINDOW b AS (PARTITION BY {keys}, path)) WHERE size > 1 AND length(path) < {colours - 1})),
 {name}_b AS (SELECT {keys}, path, count(*) AS size, max(r) - min(r) AS sr, max(g) - min(g) AS sg, max(b) - min(b) AS sb, sum(r)::DOUBLE / count(*) AS r, sum(g)::DOUBLE / count(*) AS g, sum(b)::DOUBLE / count(*) AS b FROM {name}_t GROUP BY {keys}, path),
 {name}_o AS (SELECT *, size > 1 AND row_number() OVER (PARTITION BY {keys}, size > 1 ORDER BY {by}) < {colours} AS taken FROM {name}_b),
 {name} AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY {place}) - 1 AS idx, r, g, b FROM {name}_o o WHERE NOT taken AND (path = '' OR EXISTS (SELECT 1 FROM {name}_o a WHERE {on} AND a.path = left(o.path, -1) AND a.taken)))"""


_GAP = "(p.r-e.r)*(p.r-e.r) + (p.g-e.g)*(p.g-e.g) + (p.b-e.b)*(p.b-e.b)"
_rounded = lambda *columns: [F.round(c, 6).alias(c) for c in columns]


def _frequent_sql(rows: str, keys: str, colours: int, name: str) -> str:
    return f"{name} AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, r, g, b) - 1 AS idx, r, g, b FROM {rows} GROUP BY {keys}, r, g, b QUALIFY idx < {colours})"


def _match_sql(keys: str, pal: str, by: str = "image_id, y, x") -> str:
    return f" SELECT {by}, arg_min(idx, {{'d': CAST({_GAP} AS DOUBLE), 'i': idx}}) AS idx FROM im p JOIN {pal} e USING ({keys}) GROUP BY {by}"


def _grid(px: DataFrame) -> DataFrame:
    return color.quantise(px, "twelve_bit")


def register(add: Add, r150: str) -> None:
    im = r150.replace("WITH px", "WITH RECURSIVE px", 1) + ", im AS (SELECT y // 10 AS image_id, y % 10 AS y, x, r, g, b FROM px), "
    grid = "gr AS (SELECT image_id, y, x, " + ", ".join(f"least(({c} + 8) // 17, 15) * 17 AS {c}" for c in "rgb") + " FROM im), "

    # The palette of an image's most frequent colours; one image of 256 colours, without keys to share it out by.
    def image_palette(spark: SparkSession, d: str) -> DataFrame:
        px = strips(spark, d)
        return adaptive.nearest_in(px, adaptive.frequent_palette(_grid(px), 16)).select("image_id", "y", "x", "idx")

    add("match_image_palette", image_palette, im + grid + _frequent_sql("gr", "image_id", 16, "pal") + _match_sql("image_id", "pal"))

    def large_palette(spark: SparkSession, d: str) -> DataFrame:
        px = orders_raster(spark, d).withColumn("one", F.lit(1))
        return adaptive.nearest_in(px, adaptive.frequent_palette(_grid(px), 256, ("one",)), ("one",)).select("y", "x", "idx")

    add("match_palette_256", large_palette, r150 + ", im AS (SELECT 1 AS one, * FROM px), gr AS (SELECT one, " + ", ".join(f"least(({c} + 8) // 17, 15) * 17 AS {c}" for c in "rgb") + " FROM im), " + _frequent_sql("gr", "one", 256, "pal") + _match_sql("one", "pal", "y, x"))

    # Lines have slots, and slots have palettes.
    def line_slots(spark: SparkSession, d: str) -> DataFrame:
        px = strips(spark, d)
        slots = px.select("image_id", "y", F.expr("y * 7 % 3").alias("slot")).distinct()
        own = adaptive.frequent_palette(_grid(px).join(slots, ["image_id", "y"]), 8, ("image_id", "slot"))
        return adaptive.nearest_by_line(px, slots, own).select("image_id", "y", "x", "slot", "idx")

    add("match_line_slots", line_slots, im.replace("y % 10 AS y, x", "y % 10 AS y, y % 10 * 7 % 3 AS slot, x") + grid.replace("SELECT image_id", "SELECT image_id, slot") + _frequent_sql("gr", "image_id, slot", 8, "pal") + _match_sql("image_id, slot", "pal", "image_id, y, x, slot"))

    # Median cut by rounds, and matching to what it makes.
    for order in ("widest", "fifo"):
        add(f"median_cut_{order}", lambda spark, d, o=order: adaptive.median_cut(strips(spark, d), 16, o).select("image_id", "idx", *_rounded("r", "g", "b")), im + cut_sql("im", "image_id", 16, order, "pal") + " SELECT image_id, idx, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM pal")

    def cut_match(spark: SparkSession, d: str) -> DataFrame:
        px = strips(spark, d)
        return adaptive.nearest_in(px, adaptive.median_cut(px, 16)).select("image_id", "y", "x", "idx")

    add("match_median_cut", cut_match, im + cut_sql("im", "image_id", 16, "widest", "pal") + _match_sql("image_id", "pal"))

    # A line keeps the palette before it while that fits; palettes of one key share a slot.
    def reused(spark: SparkSession, d: str, tolerance: float) -> tuple[DataFrame, DataFrame, DataFrame]:
        px = strips(spark, d)
        palettes = adaptive.median_cut(px, 16, "fifo", ("image_id", "y"))
        return px, palettes, adaptive.reuse_palettes(px, palettes, tolerance)

    add("line_palette_reuse", lambda spark, d: reused(spark, d, 12.0)[2].select("image_id", "y", "owner", *_rounded("error")), im + _reuse_sql(12.0) + " SELECT image_id, y, owner, round(error, 6) AS error FROM walk")

    def slots(spark: SparkSession, d: str, most: int) -> DataFrame:
        _, palettes, owners = reused(spark, d, 40.0)
        return adaptive.palette_slots(owners, palettes, most).select("image_id", "y", "owner", "slot", "slot_owner")

    add("palette_slots", lambda spark, d: slots(spark, d, 16), im + _reuse_sql(40.0) + _slots_sql(16))
    add("palette_slots_full", lambda spark, d: slots(spark, d, 4), im + _reuse_sql(40.0) + _slots_sql(4))

    def slot_pixels(spark: SparkSession, d: str) -> DataFrame:
        """Each pixel as the nearest entry of its line's palette, and that as the nearest entry of its slot's palette."""
        px, palettes, owners = reused(spark, d, 40.0)
        shown = adaptive.palette_slots(owners, palettes, 4)
        by_line = palettes.withColumnRenamed("y", "slot")
        own = adaptive.nearest_by_line(px, owners.select("image_id", "y", F.col("owner").alias("slot")), by_line)
        colours = own.select("image_id", "y", "x", "slot", "idx").join(by_line, ["image_id", "slot", "idx"]).select("image_id", "y", "x", "r", "g", "b")
        return adaptive.nearest_by_line(colours, shown.select("image_id", "y", F.col("slot_owner").alias("slot")), by_line).select("image_id", "y", "x", "idx")

    add("slot_pixels", slot_pixels, im + _reuse_sql(40.0) + ", " + _slots_sql(4).replace(" SELECT", "shown AS (SELECT", 1).rstrip() + "), own AS (SELECT image_id, p.y, x, arg_min({'r': e.r, 'g': e.g, 'b': e.b}, {'d': " + _GAP + ", 'i': idx}) AS c FROM im p JOIN walk w USING (image_id, y) JOIN pal e USING (image_id) WHERE e.y = w.owner GROUP BY ALL), q AS (SELECT image_id, y, x, c.r AS r, c.g AS g, c.b AS b FROM own) SELECT image_id, p.y, x, arg_min(idx, {'d': " + _GAP + ", 'i': idx}) AS idx FROM q p JOIN shown w USING (image_id, y) JOIN pal e USING (image_id) WHERE e.y = w.slot_owner GROUP BY ALL")

    # Which palettes an image has, by first sight.
    def distinct(spark: SparkSession, d: str) -> DataFrame:
        own = adaptive.frequent_palette(color.quantise(strips(spark, d).withColumns({c: F.expr(f"{c} div 128 * 128") for c in "rgb"}), "twelve_bit"), 2, ("image_id", "y"))
        keyed = own.groupBy("image_id", "y").agg(adaptive.palette_key(F.sort_array(F.collect_list(F.struct("idx", "r", "g", "b")))).alias("key"))
        return blocks.first_seen(keyed, F.col("key"), "y", ("image_id",)).select("image_id", "value", "first", "slot")

    add("distinct_palettes", distinct, im + "gr AS (SELECT image_id, y, x, " + ", ".join(f"least(({c} // 128 * 128 + 8) // 17, 15) * 17 AS {c}" for c in "rgb") + " FROM im), " + _frequent_sql("gr", "image_id, y", 2, "pal") + ", k AS (SELECT image_id, y, string_agg(r || ',' || g || ',' || b, '|' ORDER BY idx) AS value FROM pal GROUP BY 1, 2), f AS (SELECT image_id, value, min(y) AS first FROM k GROUP BY 1, 2) SELECT image_id, value, first, row_number() OVER (PARTITION BY image_id ORDER BY first, value) - 1 AS slot FROM f")


def _reuse_sql(tolerance: float) -> str:
    """CTEs up to walk(image_id, y, owner, error): a recursive walk down the lines of all images."""
    lines = "lp AS (SELECT image_id, y, list({'r': r, 'g': g, 'b': b}) AS px FROM im GROUP BY 1, 2), le AS (SELECT image_id, y, list({'r': r, 'g': g, 'b': b} ORDER BY idx) AS own FROM pal GROUP BY 1, 2), ln AS (SELECT * FROM lp JOIN le USING (image_id, y))"
    fit = "list_avg([sqrt(list_min([" + _GAP + " FOR e IN {0}])) FOR p IN {1}])"
    step = f"SELECT ln.image_id, ln.y, CASE WHEN keep THEN owner ELSE ln.y END AS owner, CASE WHEN keep THEN fit ELSE {fit.format('ln.own', 'ln.px')} END AS error, CASE WHEN keep THEN held ELSE ln.own END AS held"
    return (
        cut_sql("im", "image_id, y", 16, "fifo", "pal")
        + f", {lines}, walk AS (SELECT image_id, y, y AS owner, {fit.format('own', 'px')} AS error, own AS held FROM ln WHERE y = 0 UNION ALL {step} FROM (SELECT w.image_id, w.owner, w.held, n.y AS next, {fit.format('w.held', 'n.px')} AS fit, fit <= {tolerance!r}::DOUBLE AS keep FROM walk w JOIN ln n ON n.image_id = w.image_id AND n.y = w.y + 1) s JOIN ln ON ln.image_id = s.image_id AND ln.y = s.next)"
    )


def _slots_sql(most: int) -> str:
    return (
        " SELECT image_id, y, owner, CASE WHEN slots > " + str(most) + " THEN run ELSE slot END AS slot, CASE WHEN slots > " + str(most) + " THEN run_owner ELSE slot_owner END AS slot_owner FROM (SELECT l.*, s.slot, s.slot_owner, s.slots, m.owner AS run_owner FROM"
        + f" (SELECT *, least(y // greatest(height // {most}, 1), {most - 1}) AS run, (run * greatest(height // {most}, 1) + CASE WHEN run = {most - 1} THEN height ELSE (run + 1) * greatest(height // {most}, 1) END) // 2 AS middle FROM (SELECT w.image_id, w.y, w.owner, k.key, count(*) OVER (PARTITION BY w.image_id) AS height FROM walk w JOIN (SELECT image_id, y AS owner, string_agg(CAST(floor(r) AS BIGINT) || ',' || CAST(floor(g) AS BIGINT) || ',' || CAST(floor(b) AS BIGINT), '|' ORDER BY idx) AS key FROM pal GROUP BY 1, 2) k USING (image_id, owner))) l"
        + " JOIN (SELECT image_id, key, arg_min(owner, y) AS slot_owner, row_number() OVER (PARTITION BY image_id ORDER BY min(y)) - 1 AS slot, count(*) OVER (PARTITION BY image_id) AS slots FROM (SELECT w.image_id, w.y, w.owner, k.key FROM walk w JOIN (SELECT image_id, y AS owner, string_agg(CAST(floor(r) AS BIGINT) || ',' || CAST(floor(g) AS BIGINT) || ',' || CAST(floor(b) AS BIGINT), '|' ORDER BY idx) AS key FROM pal GROUP BY 1, 2) k USING (image_id, owner)) GROUP BY 1, 2) s USING (image_id, key) JOIN walk m ON m.image_id = l.image_id AND m.y = l.middle)"
    )
