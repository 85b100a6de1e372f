"""Strokes in one pass over tiles against the operators on tables, and what is dealt and written for it."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from linework import queries
from linework.operators import chords, components, links, runs, strokes
from linework.operators.components import written
from linework.params import Params
from linework.plans import lines
from linework.schema import TILE

DIR = "/root/testdata/sf0.001"


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and [a.schema[c].dataType for c in cols] == [b.schema[c].dataType for c in cols]
    assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


@pytest.fixture(scope="module")
def drawing(spark):
    """Random drawings of dense and thin ink in three colours and near-white, some coordinates negative."""
    rng, rows = random.Random(4), {}
    for image in range(4):
        for _ in range(220):
            r, c, dr, dc = rng.randrange(-9, 50), rng.randrange(-9, 50), rng.randrange(2), rng.randrange(2)
            for k in range(rng.randrange(1, 14)):
                rows[image, r + dr * k, c + dc * k] = rng.choice((255, 255, 65280, 0xFFFFFF - image)) if k == 0 else rows[image, r, c]
    df = spark.createDataFrame([(*k, v) for k, v in rows.items()], "image_id long, row long, col long, rgb int")
    return written(runs.assign_tiles(df, 16).repartition(3), "drawing")


@pytest.mark.parametrize("chunk, block", [(1 << 18, 1 << 18), (40, 6)])
def test_as_on_tables(spark, drawing, monkeypatch, chunk, block):
    monkeypatch.setattr(strokes, "CHUNK_PIXELS", chunk)
    monkeypatch.setattr(strokes, "BLOCK_ENDS", block)
    monkeypatch.setattr(chords, "SMALL", 8)
    known = written(runs.extract_elines(drawing), "known")
    same(strokes.elines(drawing), known)
    cut = written(links.trim_overlaps(known), "cut")
    same(strokes.elines(drawing, trimmed=True), cut)
    same(strokes.stroke_links(drawing, 1), links.link_endpoints(cut, TILE, "eline_id", 1))
    linked = written(links.with_ends(links.link_endpoints(cut, TILE, "eline_id", 1), cut, TILE, "eline_id"), "linked")
    found = strokes.stroke_links(drawing, 1, attributes=True)
    same(links.same_stroke_edges(found), links.same_stroke_edges(linked))
    same(links.mixed_stroke_edges(found), links.mixed_stroke_edges(linked))
    same(strokes.leftover_hits(drawing, 3), links.leftover_hits(known.where("volume <= 3"), known.where("volume > 3").withColumnRenamed("eline_id", "line_id")))
    same(strokes.stroke_pixels(drawing), runs.lines_to_pixels(known))
    edge = runs.contour_pixels(runs.nonwhite(drawing))
    same(strokes.residue(drawing, 3), runs.residue_pixels(edge, known.where("volume > 2")))
    # Detection step by step on tables.
    params = Params(tile=16, long_run=4, leftover_volume=2)
    first = written(lines.components_of(cut, links.same_stroke_edges(linked), TILE, "eline_id"), "first")
    long, rest = lines.split_by_size(first, params.long_run)
    gone = lambda df, c: df.join(long.select(*TILE, F.col("eline_id").alias(c)), [*TILE, c], "left_anti")
    second = written(lines.components_of(rest, links.mixed_stroke_edges(gone(gone(linked, "src"), "dst")), TILE, "eline_id"), "second")
    alone = second.where((F.col("size") == 1) & (F.col("volume") <= params.leftover_volume)).drop("component", "size")
    groups = long.drop("size").withColumn("pass", F.lit(1)).unionByName(second.where((F.col("size") > 1) | (F.col("volume") > params.leftover_volume)).drop("size").withColumn("pass", F.lit(2)))
    of = F.dense_rank().over(Window.partitionBy(*TILE).orderBy("pass", "component")).cast("long") - 1
    groups = groups.withColumn("line_id", of)
    made = written(lines.chords_of(groups, TILE, "line_id"), "made")
    joined, edges = links.attach_leftovers(alone, made)
    merged = written(lines.components_of(made, edges, TILE, "line_id").withColumnRenamed("component", "final").drop("size"), "merged")
    final = merged.select(*TILE, "line_id", "final")
    extra = alone.join(joined, [*TILE, "eline_id"]).join(final, [*TILE, "line_id"]).select(*TILE, "final", "rgb", "x1", "y1", "x2", "y2")
    whole = lines.chords_of(merged.select(*TILE, "final", "rgb", "x1", "y1", "x2", "y2").unionByName(extra), TILE, "final")
    got = lines.detect_in_tiles(drawing, params)
    same(got.lines, whole.withColumnRenamed("final", "line_id"))
    to = lambda df: df.join(final, [*TILE, "line_id"], "left").select(*TILE, "eline_id", F.col("final").alias("line_id"))
    same(got.groups.drop("pass"), to(groups))
    same(got.leftovers, to(alone.select(*TILE, "eline_id").join(joined, [*TILE, "eline_id"], "left")))
    assert joined.count() and edges.count() and long.count()


def test_places(spark, drawing):
    found = lines.number_lines(strokes.placed(drawing, 3, None), 16).collect()
    moved = lines.untile_lines(runs.extract_elines(drawing), 16).collect()
    want = []
    for image in {r["image_id"] for r in moved}:
        own = sorted((r["tile_r"], r["tile_c"], r["x1"], r["y1"], r["x2"], r["y2"], r["rgb"]) for r in moved if r["image_id"] == image)
        want += [(image, k, *v[2:]) for k, v in enumerate(own) if (v[4] - v[2]) ** 2 + (v[5] - v[3]) ** 2 > 9]
    assert sorted(map(tuple, found)) == sorted(want)


def test_near_ends_are_dealt_by_cells(spark):
    rng = random.Random(2)
    items = [(1, i, *(rng.randrange(-20, 20) for _ in range(4))) for i in range(60)]
    df = spark.createDataFrame(items, "image_id long, line_id long, x1 long, y1 long, x2 long, y2 long")
    for eps in (0, 1, 3):
        own = {}
        for _, i, *p in items:
            for at in (tuple(p[:2]), tuple(p[2:])):
                own[at] = max(own.get(at, i), i)
        want = sorted((i, o) for _, i, *p in items for x, y in (p[:2], p[2:]) for (u, v), o in own.items() if abs(x - u) <= eps and abs(y - v) <= eps)
        owners = links.endpoint_owner(df, ["image_id"], "line_id")
        got = links.near_owners(df, owners, ["image_id"], "line_id", eps)
        assert sorted((r["line_id"], r["owner"]) for r in got.collect()) == want
    # An end of its own has four rows at most, whatever the distance.
    plan = links.near_owners(df, owners, ["image_id"], "line_id", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sequence(") == 2


NAMES = "c3_trim_overlaps c4_link_endpoints c5_same_stroke_edges c6_mixed_stroke_edges c7_leftover_hits d5_volume_histogram h9_same_orientation j2_detect_lines_in_tiles j2_strokes_of_lines a6_lines_to_pixels b3_untile_lines b6_drop_short_lines u3_residue_pixels u2_all_runs b8_thin_mask"


@pytest.mark.parametrize("name", NAMES.split())
def test_drawings_are_dealt_once(spark, name):
    """Only order lines are dealt, by image; neither pixels nor strokes are dealt or written."""
    before = len(components._tables)
    plan = queries.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall("Exchange [^\\n]*", plan)
    assert dealt and all("REPARTITION_BY_NUM" in x or "volume" in x and "ENSURE" in x for x in dealt), dealt
    assert len(components._tables) == before


def test_links_of_other_edges():
    assert components.least_labels(4, np.array([1]), np.array([3]), np.array([0, 1, 1, 3])).tolist() == [0, 1, 1, 1]
