"""Pairs of lines count where they meet first, and most are told apart by their boxes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from linework import queries
from linework.functions import geometry as geo
from linework.operators import grid

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("neighbourhood, bound", [("plus", 2000), ("full", 2000), ("plus", 7)])
def test_each_pair_once_however_wide(spark, monkeypatch, neighbourhood, bound):
    monkeypatch.setattr(grid, "CELL_LINES", bound)
    rng, rows = random.Random(8), []
    for i in range(150):
        x, y, reach = rng.randrange(-50, 300), rng.randrange(-50, 300), rng.choice((3, 12, 30, 200))
        rows.append((i % 2, i, x, y, x + rng.randrange(-reach, reach), y + rng.randrange(-reach, reach)))
    df = spark.createDataFrame(rows, "image_id long, line_id long, x1 long, y1 long, x2 long, y2 long")
    cells = {}
    for r in grid.lines_to_cells(df, 10).collect():
        cells.setdefault((r["image_id"], r["line_id"]), set()).add((r["cell_r"], r["cell_c"]))
    centres = {k: {(r + a, c + b) for r, c in v for a, b in grid.NEIGHBOURHOODS[neighbourhood]} & {p for o, q in cells.items() if o[0] == k[0] for p in q} for k, v in cells.items()}
    spans = [max(max(p[k] for p in v) - min(p[k] for p in v) for k in (0, 1)) for v in centres.values() if v]
    assert min(spans) < grid.SPAN <= max(spans)
    want = sorted((i, a, b, b - a) for i, a in centres for j, b in centres if i == j and a < b and centres[i, a] & centres[j, b])
    got = grid.grid_candidates(df, 10, neighbourhood, out={"gap": lambda a, b: F.col(f"{b}.line_id") - F.col(f"{a}.line_id")})
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("name", ["c10_grid_candidates", "g2_same_component", "h_lines", "h_points"])
def test_pairs_are_not_dealt(spark, name):
    """Candidates are neither made distinct nor joined with what is asked of them."""
    plan = queries.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") + plan.count("ShuffledHashJoin") == 1
    assert not re.search("Exchange hashpartitioning[^\\n]*(src|dst)|HashAggregate", plan)


def test_boxes_tell_most_pairs_apart(spark):
    rng = random.Random(3)
    point = lambda: (rng.randrange(30), rng.randrange(30))
    rows = [(*point(), *point(), *point(), *point()) for _ in range(3000)]
    df = spark.createDataFrame(rows, "ax1 long, ay1 long, ax2 long, ay2 long, bx1 long, by1 long, bx2 long, by2 long")
    a, b = (tuple(F.col(f"{s}{c}") for c in ("x1", "y1", "x2", "y2")) for s in "ab")
    rule = geo.end_near_segment(a, b, 3)

    def apart(x, y, s):
        dx, dy = s[2] - s[0], s[3] - s[1]
        n = dx * dx + dy * dy
        t = (x - s[0]) * dx + (y - s[1]) * dy
        if 0 < t < n:
            return ((x - s[0]) * dy - (y - s[1]) * dx) ** 2 < 9 * n
        return min((x - s[0]) ** 2 + (y - s[1]) ** 2, (x - s[2]) ** 2 + (y - s[3]) ** 2) < 9

    want = [apart(*r[:2], r[4:]) or apart(*r[2:4], r[4:]) or apart(*r[4:6], r[:4]) or apart(*r[6:], r[:4]) for r in rows]
    assert [r[0] for r in df.select(rule).collect()] == want and 300 < sum(want) < 2700
    boxes = [r[0] for r in df.select(geo.boxes_near(a, b, 3)).collect()]
    assert all(near for near, met in zip(boxes, want) if met)
    # The rule stands there once, not for each end, which keeps the join's code short.
    assert df.select(rule)._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") <= 2
