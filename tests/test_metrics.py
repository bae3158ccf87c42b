"""Nearest colours by other metrics than the squared distance: ties go to the lowest index however distances are summed."""

import duckdb
import pytest

from rasterloom.functions.palettes import BBC, C64
from rasterloom.operators import color
from rasterloom.plans import catalog

#: Colours with two entries equally near, of which sums of fractions took the wrong one.
TIES = {
    "chroma_u": [(49, 25, 41), (77, 87, 122), (88, 88, 88), (103, 79, 95)],
    "luma_a": [(0, 204, 68), (2, 250, 148), (3, 117, 186), (6, 138, 70)],
    "luma_u": [(0, 116, 246), (3, 137, 130), (3, 233, 104), (5, 159, 116)],
    "luma_u_mixed": [(12, 100, 225), (25, 97, 216), (51, 91, 198), (90, 82, 171)],
    "mahalanobis_u": [(0, 11, 70), (0, 14, 69), (2, 18, 66), (4, 19, 64)],
    "perceptive_u": [(72, 100, 84), (80, 90, 92), (80, 98, 80), (84, 85, 96)],
}


@pytest.mark.parametrize("metric", TIES)
def test_ties_go_as_in_sql(spark, metric):
    palette = C64 if "_u" in metric else BBC
    rows = [(x, 0, *c) for x, c in enumerate([*TIES[metric], *palette])]
    told = color.nearest(spark.createDataFrame(rows, "x long, y long, r long, g long, b long"), palette, metric).orderBy("x").collect()
    px = ", ".join(f"({', '.join(f'{v}::BIGINT' for v in row)})" for row in rows)
    want = duckdb.sql(f"WITH px(x, y, r, g, b) AS (VALUES {px}){catalog.nearest_sql(palette, metric)} SELECT x, idx FROM m ORDER BY x").fetchall()
    assert [(p["x"], p["idx"]) for p in told] == want
