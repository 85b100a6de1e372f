"""Hand cases and brute force for the drawing operators."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linework.functions import geometry as geo
from linework.operators import grid, links, runs
from linework.operators.chords import hull_of, longest_chord
from linework.operators.components import connected_components
from linework.operators.scoring import exact_split
from linework.params import Params
from linework.plans.connect import connect_pairs, detect_connect
from linework.plans.jobs import classify_folder, detect_cached
from linework.plans.lines import concat_lines, detect_lines
from linework.sources.images import images_to_pixels, read_images, weights

LINES = "image_id long, line_id long, x1 long, y1 long, x2 long, y2 long, rgb int"


def lines(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], LINES)


def edges(df):
    return {(r["src"], r["dst"]) for r in df.collect()}


def brute_near(a, b, eps):
    def d2(p, s):
        (x1, y1), (x2, y2) = s
        dx, dy = x2 - x1, y2 - y1
        n = dx * dx + dy * dy
        t = 0 if n == 0 else max(0, min(1, ((p[0] - x1) * dx + (p[1] - y1) * dy) / n))
        return (p[0] - x1 - t * dx) ** 2 + (p[1] - y1 - t * dy) ** 2

    A, B = ((a[0], a[1]), (a[2], a[3])), ((b[0], b[1]), (b[2], b[3]))
    return any(d2(p, B) < eps * eps - 1e-9 for p in A) or any(d2(p, A) < eps * eps - 1e-9 for p in B)


def test_connect_against_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(120):
        x, y = rng.randrange(0, 60), rng.randrange(0, 60)
        rows.append((x, y, x + rng.randrange(-9, 10), y + rng.randrange(-9, 10), rng.choice([255, 65280])))
    rows = [tuple(max(v, 0) for v in r[:4]) + r[4:] for r in rows]
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if rows[i][4] == rows[j][4] and brute_near(rows[i], rows[j], 3)}
    got = edges(connect_pairs(lines(spark, rows), Params(grid=10), neighbourhood="full"))
    assert got == want


def test_diagonal_gap_needs_the_full_neighbourhood(spark):
    rows = [(5, 5, 9, 9, 255), (10, 10, 15, 15, 255), (30, 30, 31, 31, 65280)]
    df = lines(spark, rows)
    assert edges(connect_pairs(df, Params(grid=10, connect_eps=2))) == set()
    assert edges(connect_pairs(df, Params(grid=10, connect_eps=2), neighbourhood="full")) == {(0, 1)}


def test_switches(spark):
    df = lines(spark, [(0, 5, 10, 5, 255), (5, 0, 5, 10, 255)])
    p = Params(grid=100, connect_eps=2)
    assert edges(connect_pairs(df, p)) == set()
    assert edges(connect_pairs(df, p, crossing=True)) == {(0, 1)}
    with pytest.raises(ValueError):
        connect_pairs(df, p, ends=False, middles=True)


def test_no_nested_loop_join(spark):
    df = lines(spark, [(0, 0, 9, 9, 255)])
    plan = connect_pairs(df)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def walk(x1, y1, x2, y2, g, nx, ny):
    """Cells from the crossings sorted by exact share of the way, rows first on ties."""
    from fractions import Fraction

    i0, j0, i1, j1 = (max(0, min(v // g, n - 1)) for v, n in ((x1, nx), (y1, ny), (x2, nx), (y2, ny)))
    sx, sy = (1 if i1 >= i0 else -1), (1 if j1 >= j0 else -1)
    events = [(Fraction(abs((i0 + (sx > 0) + sx * k) * g - x1), abs(x2 - x1)), 1) for k in range(abs(i1 - i0))]
    events += [(Fraction(abs((j0 + (sy > 0) + sy * k) * g - y1), abs(y2 - y1)), 0) for k in range(abs(j1 - j0))]
    cells, i, j = {(j0, i0)}, i0, j0
    for _, column in sorted(events):
        i, j = (i + sx, j) if column else (i, j + sy)
        cells.add((j, i))
    return cells


def test_cells_against_a_walk(spark):
    rng = random.Random(5)
    rows = [tuple(rng.randrange(0, 41) for _ in range(4)) + (255,) for _ in range(200)] + [(12, 28, 20, 24, 255), (0, 0, 40, 40, 255), (7, 7, 7, 7, 255)]
    df = lines(spark, rows)
    shape = grid.grid_shape(df, 4).first()
    got = {}
    for r in grid.lines_to_cells(df, 4).collect():
        got.setdefault(r["line_id"], set()).add((r["cell_r"], r["cell_c"]))
    for i, r in enumerate(rows):
        assert got[i] == walk(*r[:4], 4, shape["grid_x"], shape["grid_y"]), r


def test_long_chain_and_star(spark):
    pairs = [(i, i + 1) for i in range(1000)] + [(2000, 2000 + i) for i in range(1, 50)] + [(5, 5), (None, 7)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert {found[i] for i in range(1001)} == {0} and {found[2000 + i] for i in range(50)} == {2000} and len(found) == 1051
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_chord_against_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pts = rng.integers(0, 12, (rng.integers(1, 20), 2))
        best = min((-int(((a - b) ** 2).sum()), *sorted([tuple(map(int, a)), tuple(map(int, b))])) for a in pts for b in pts)
        x1, y1, x2, y2, d2 = longest_chord(pts)
        assert (-d2, (x1, y1), (x2, y2)) == best
    assert len(hull_of(np.array([[0, 0], [2, 0], [1, 0], [2, 2], [0, 2], [1, 1]]))) == 4


def pixel_rows(spark, cells, rgb=255):
    return spark.createDataFrame([(1, r, c, rgb) for r, c in sorted(cells)], "image_id long, row long, col long, rgb int")


def test_runs_cover_the_ink_once(spark):
    rng = random.Random(7)
    cells = {(rng.randrange(20), rng.randrange(20)) for _ in range(150)}
    ink = runs.assign_tiles(pixel_rows(spark, cells), 64)
    for found in (runs.horizontal_runs(ink), runs.vertical_runs(ink)):
        covered = [(r, c) for x in found.collect() for r in range(x["r1"], x["r2"] + 1) for c in range(x["c1"], x["c2"] + 1)]
        assert sorted(covered) == sorted(cells)


def test_contour_of_a_block(spark):
    cells = {(r, c) for r in range(5) for c in range(5)}
    got = {(r["row"], r["col"]) for r in runs.contour_pixels(runs.assign_tiles(pixel_rows(spark, cells), 64)).collect()}
    assert got == {x for x in cells if 0 in x or 4 in x}


def test_staircase_becomes_one_line(spark):
    cells = {(i, i) for i in range(12)}
    got = detect_lines(pixel_rows(spark, cells), Params(tile=64)).collect()
    assert [(r["x1"], r["y1"], r["x2"], r["y2"]) for r in got] == [(0, 0, 11, 11)]


def test_line_across_a_tile_border_is_merged(spark):
    got = detect_lines(pixel_rows(spark, {(3, c) for c in range(40)}), Params(tile=32)).collect()
    assert [(r["x1"], r["y1"], r["x2"], r["y2"]) for r in got] == [(0, 3, 39, 3)]


def test_parallel_lines_stay_apart(spark):
    rows = [(5, 0, 5, 20, 255), (6, 22, 6, 40, 255), (5, 22, 5, 40, 255)]
    got = {(r["x1"], r["y1"], r["x2"], r["y2"]) for r in concat_lines(lines(spark, rows)).collect()}
    assert (6, 22, 6, 40) in got and (5, 0, 5, 40) in got


def test_leftovers_with_one_and_more_hits(spark):
    tile = "image_id long, tile_r long, tile_c long"
    known = spark.createDataFrame([(1, 0, 0, 0, 0, 0, 5, 5, 255), (1, 0, 0, 1, 9, 9, 15, 15, 255)], f"{tile}, line_id long, x1 long, y1 long, x2 long, y2 long, rgb int")
    alone = spark.createDataFrame([(1, 0, 0, 0, 16, 16, 18, 18, 255), (1, 0, 0, 1, 6, 6, 8, 8, 255), (1, 0, 0, 2, 30, 30, 31, 30, 255), (1, 0, 0, 3, 16, 15, 16, 15, 255)], f"{tile}, eline_id long, x1 long, y1 long, x2 long, y2 long, rgb int")
    joined, pairs = links.attach_leftovers(alone, known)
    assert {(r["eline_id"], r["line_id"]) for r in joined.collect()} == {(0, 1)}
    assert {frozenset((r["src"], r["dst"])) for r in pairs.collect()} == {frozenset((0, 1))}


def test_zero_length_and_vertical(spark):
    row = spark.range(1)
    v = lambda *c: tuple(F.lit(x) for x in c)
    got = row.select(geo.point_segment_distance(F.lit(3), F.lit(4), v(0, 0, 0, 0)).alias("d"), geo.segments_cross(v(5, 0, 5, 10), v(0, 5, 10, 5)).alias("c"), geo.slope(v(1, 1, 1, 9)).alias("s"), geo.angle_between(v(0, 0, 0, 5), v(0, 0, 5, 0)).alias("a")).first()
    assert got["d"] == 5.0 and got["c"] and got["s"] == float("inf") and abs(got["a"] - 90) < 1e-6


def test_exact_split(spark):
    for n in (0, 1, 7, 1003):
        assert exact_split(spark.range(n), "id").where("training").count() == n * 8 // 10


def png(path, pixels):
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[r].tobytes() for r in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_to_pixels_and_classes(spark, tmp_path):
    white = np.full((8, 8, 3), 255, dtype=np.uint8)
    drawn = white.copy()
    drawn[2, 3] = (255, 0, 0)
    png(tmp_path / "a" / "one.png", drawn)
    png(tmp_path / "b" / "two.png", white)
    found = read_images(spark, str(tmp_path))
    pixels = images_to_pixels(found.where("path LIKE '%one.png'").withColumn("image_id", F.lit(4))).collect()
    assert [(r["row"], r["col"], r["rgb"]) for r in pixels] == [(2, 3, 255)]  # the first channel is blue
    scored, counts = classify_folder(spark, str(tmp_path), lambda x: np.stack([x.mean(axis=1), -x.mean(axis=1)], axis=1), size=4)
    assert {(r["class_name"], r["label"]) for r in scored.collect()} == {("a", 0), ("b", 1)}
    assert [(r["label"], r["n"]) for r in counts.collect()] == [(0, 1), (1, 1)]
    assert np.allclose(weights(8, 4).sum(axis=1), 1)


def test_cached_detection_computes_once(spark, tmp_path):
    pixels = pixel_rows(spark, {(3, c) for c in range(20)})
    ask = spark.createDataFrame([("one", 1, False)], "key string, image_id long, forced boolean")
    first = detect_cached(ask, pixels, str(tmp_path), Params(tile=64))
    assert first[0].count() == 1 and first[1].count() == 1 and first[2].count() == 1
    assert detect_cached(ask, pixels, str(tmp_path), Params(tile=64))[2].count() == 0
    assert detect_cached(ask.withColumn("forced", F.lit(True)), pixels, str(tmp_path), Params(tile=64))[2].count() == 1


def test_groups_do_not_depend_on_ids(spark):
    rows = [(0, 0, 10, 0, 255), (10, 1, 20, 1, 255), (40, 40, 50, 50, 255), (0, 30, 5, 30, 0)]
    sets = []
    for order in (rows, rows[::-1]):
        groups: dict = {}
        for r in detect_connect(lines(spark, order), Params(grid=10)).collect():
            groups.setdefault(r["component"], set()).add((r["x1"], r["y1"]))
        sets.append(sorted(map(sorted, groups.values())))
    assert sets[0] == sets[1] and len(sets[0]) == 2


def test_stream_computes_each_drawing_once(spark, tmp_path):
    from linework.sources.catalog import read_lines
    from linework.streaming.incremental import detect_stream

    source, folder, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for _ in range(2):
        pixel_rows(spark, {(3, c) for c in range(20)}).coalesce(1).write.mode("append").parquet(source)
        detect_stream(spark, source, folder, state, Params(tile=64)).awaitTermination()
    assert read_lines(spark, folder, "line", "image_id long, x1 long, x2 long").count() == 1


def test_files_with_crops_are_computed_once(spark, tmp_path):
    from linework.plans.jobs import detect_files
    from linework.fixtures import write_images

    rows = [(7, 3, c, 255) for c in range(20)] + [(7, r, 30, 65280) for r in range(5, 25)] + [(8, 2, c, 255) for c in range(9)]
    write_images(spark.createDataFrame(rows, "image_id long, row long, col long, rgb int"), f"file://{tmp_path}/in", 32, 40)
    ask = "path string, r0 int, r1 int, c0 int, c1 int, forced boolean"
    path = f"file://{tmp_path}/in/7.png"
    whole, crop = (path, None, None, None, None, False), (path, 0, 20, 25, 40, False)
    lines, groups, todo = detect_files(spark.createDataFrame([whole, crop], ask), f"{tmp_path}/out", Params(tile=64))
    got = sorted((r["key"], r["x1"], r["y1"], r["x2"], r["y2"], r["rgb"]) for r in lines.collect())
    assert todo.count() == 2 and groups.count() == 3
    assert got == [("7.png((0, 20), (25, 40))", 5, 5, 5, 19, 65280), ("7.png(None, None)", 0, 3, 19, 3, 255), ("7.png(None, None)", 30, 5, 30, 24, 65280)]
    again = detect_files(spark.createDataFrame([whole, crop, (f"file://{tmp_path}/in/8.png", 20, 30, None, None, False)], ask), f"{tmp_path}/out", Params(tile=64))
    assert again[2].count() == 1 and again[0].count() == 3  # the new crop is empty
    last = detect_files(spark.createDataFrame([whole[:5] + (True,), (f"file://{tmp_path}/in/8.png", 20, 30, None, None, False)], ask), f"{tmp_path}/out", Params(tile=64))
    assert last[2].count() == 1 and last[0].count() == 2  # forced, and replaced


def test_one_exchange_from_tiles_to_runs(spark):
    df = spark.createDataFrame([(1, 0, 0, 255)], "image_id long, row long, col long, rgb int")
    plan = runs.horizontal_runs(runs.contour_pixels(runs.assign_tiles(df, 8).repartition("image_id", "tile_r", "tile_c")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def random_tile_pixels(spark, seed):
    rng = random.Random(seed)
    cells = {(i, r, c): rng.choice((255, 65280)) for i in (1, 2) for r in range(14) for c in range(14) if rng.random() < 0.6}
    return cells, spark.createDataFrame([(*k, v) for k, v in cells.items()], "image_id long, row long, col long, rgb int")


def test_runs_in_one_pass_are_those_of_both_ways(spark):
    _, df = random_tile_pixels(spark, 5)
    ink = runs.assign_tiles(df, 8).repartition("image_id", "tile_r", "tile_c")
    one, two = runs.runs_of(ink), runs.all_runs(runs.horizontal_runs(ink), runs.vertical_runs(ink))
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.select(*one.columns).collect()))
    assert runs.runs_of(ink.where("rgb < 0")).count() == 0


def test_strokes_are_not_joined_by_broadcast(spark):
    _, df = random_tile_pixels(spark, 6)
    elines = runs.extract_elines(runs.assign_tiles(df, 8))
    for made in (elines, links.trim_overlaps(elines), runs.thin_mask(df), links.link_endpoints(elines, ["image_id", "tile_r", "tile_c"], "eline_id", 1)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_closing_against_brute_force(spark):
    cells, df = random_tile_pixels(spark, 7)
    want = set()
    for i in (1, 2):
        ink = {(r, c) for k, r, c in cells if k == i}
        rows, cols = [r for r, _ in ink], [c for _, c in ink]
        box = {(r, c) for r in range(min(rows), max(rows) + 1) for c in range(min(cols), max(cols) + 1)}
        around = lambda p: {(p[0] + dr, p[1] + dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)} & box  # noqa: B023, E731
        wide = {q for p in ink for q in around(p)}
        want |= {(i, *p) for p in box - ink if around(p) <= wide}
    assert {tuple(r) for r in runs.thin_mask(df.select("image_id", "row", "col")).collect()} == want and want
    assert runs.thin_mask(df.select("image_id", "row", "col").limit(0)).count() == 0
