"""Skew: hubs, long chains, narrow keys, over-full cells, each with the answers of the plain way."""

import random
import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from linework import fixtures
from linework.operators import chords, components, grid, links, runs, scoring
from linework.operators.components import connected_components
from linework.operators.ranks import ranked
from linework.operators.scoring import exact_split, score_images
from linework.params import DEFAULTS, Params
from linework.plans.connect import connect_pairs, detect_pairs
from linework.plans.jobs import detect_cached, evaluate
from linework.schema import TILE
from linework.sources import catalog
from linework.streaming.incremental import detect_file_batch, detect_image_stream
from tests.test_drawing import LINES, brute_near, edges


def lines(spark, rows):
    return spark.createDataFrame(rows, LINES)


def brute_classes(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("merged", [0, 40, 100_000])
def test_components_by_contraction(spark, monkeypatch, merged):
    monkeypatch.setattr(components, "MERGED_EDGES", merged)
    rng = random.Random(merged)
    chain = list(range(600))
    rng.shuffle(chain)
    pairs = list(zip(chain, chain[1:])) + [(5000, 1000 + i) for i in range(700)] + [(rng.randrange(9000, 9300), rng.randrange(9000, 9300)) for _ in range(150)]
    pairs = [(a, b) for a, b in pairs if a != b] * 2
    rng.shuffle(pairs)
    want = brute_classes(pairs)
    df = spark.createDataFrame([*pairs, (3, 3), (None, 4)], "src long, dst long")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == want
    # Structs are ordered by their fields, the first one first.
    key = lambda c: F.struct(F.format_string("k%04d", F.lit(9999) - F.col(c)).alias("a"), F.col(c).alias("b"))
    got = {r["node"]["b"]: r["component"]["b"] for r in connected_components(df.where("src IS NOT NULL").select(key("src").alias("src"), key("dst").alias("dst"))).collect()}
    most = {}
    for n, c in want.items():
        most[c] = max(most.get(c, n), n)
    assert got == {n: most[c] for n, c in want.items()}


def test_a_large_star_and_chain_leave_few_links(spark):
    n = 200_000
    star = spark.range(n).select(F.lit(10_000_000).cast("long").alias("src"), F.col("id").alias("dst"))
    chain = spark.range(n).select((F.col("id") + 1_000_000).alias("src"), (F.col("id") + 1_000_001).alias("dst"))
    edges = star.unionByName(chain).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).repartitionByRange(8, "u", "v")
    forest = components._forest(edges).cache()
    several = forest.groupBy("node").count().where("count > 1")
    assert several.count() <= 8  # a hub or border node for each task
    assert forest.groupBy("piece").count().agg(F.max("count")).first()[0] <= n / 2
    found = connected_components(star.unionByName(chain))
    assert {tuple(r) for r in found.groupBy("component").count().collect()} == {(0, n + 1), (1_000_000, n + 1)}


def test_ranks_of_narrow_and_wide_keys(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.xxhash64("id")).otherwise(F.col("id") % 7).alias("key"), "id")
    key, tie = zip(*sorted((r["key"], r["id"]) for r in rows.collect()))
    got = ranked(rows, [F.col("key"), F.col("id")]).orderBy("rank").collect()
    assert [(r["key"], r["id"], r["rank"]) for r in got] == [(k, i, n + 1) for n, (k, i) in enumerate(zip(key, tie))]
    # 90 % of the rows have seven keys, a third of all ties in everything: no range has much more than its share.
    ties = rows.select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("key")).alias("key"))
    placed = ranked(ties, [F.col("key")], partitions=8)
    assert [r["rank"] for r in placed.orderBy("rank").collect()] == list(range(1, 20_001))
    largest = ties.withColumn("t", F.monotonically_increasing_id()).repartitionByRange(8, "key", "t").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 20_000 / 8 * 2
    by = ranked(rows.withColumn("half", F.when(F.col("id") % 2 == 0, F.lit("a"))), [F.col("key"), F.col("id")], ("half",)).collect()
    for half in ("a", None):
        own = sorted((r["rank"], r["key"], r["id"]) for r in by if r["half"] == half)
        assert [r[0] for r in own] == list(range(1, 10_001)) and [r[1:] for r in own] == sorted(r[1:] for r in own)
    assert ranked(rows.limit(0), [F.col("key")]).count() == 0


def test_metrics_on_hashed_ids(spark):
    rows = [(i, [float(i % 3), 1.0, 0.5], i % 3) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, logits array<double>, label int").withColumn("image_id", F.xxhash64("id"))
    got = evaluate(df, 16).first()
    order = [r["id"] for r in df.orderBy("image_id").collect()]
    loss = [np.log(np.exp(rows[i][1]).sum()) - rows[i][1][rows[i][2]] for i in order]
    assert got["n"] == 100 and abs(got["loss"] - np.mean([np.mean(loss[k : k + 16]) for k in range(0, 100, 16)])) < 1e-9
    assert abs(float(got["accuracy"]) - np.mean([int(np.argmax(r[1])) == r[2] for r in rows]) * 100) < 1e-9


def test_exact_split_of_repeated_keys(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit(7)).otherwise(F.col("id")).alias("id"), F.lit("x").alias("place__")).unionByName(spark.range(3).select(F.lit(None).cast("long").alias("id"), F.lit("x").alias("place__")))
    got = exact_split(df, "id")
    assert got.columns == ["id", "place__", "training"] and got.where("training").count() == 3003 * 8 // 10 and got.count() == 3003


@pytest.mark.parametrize("bound", [3, 40])
@pytest.mark.parametrize("neighbourhood", ["plus", "full"])
def test_dense_cells_have_the_same_pairs(spark, monkeypatch, bound, neighbourhood):
    rng = random.Random(bound)
    rows = []
    for i in range(160):
        x, y = (rng.randrange(60), rng.randrange(60)) if i % 4 else (rng.randrange(400), rng.randrange(400))
        n = rng.choice([0, 3, 9, 200 if i % 9 == 0 else 5])
        rows.append((i % 2, i, x, y, x + rng.choice([-1, 0, 1]) * n, max(0, y + rng.choice([-1, 0, 1]) * n), rng.choice([255, 65280])))
    rows = [(*r[:4], max(0, r[4]), *r[5:]) for r in rows]
    df, params = lines(spark, rows), replace(DEFAULTS, grid=64)
    want, cand = edges(connect_pairs(df, params, neighbourhood=neighbourhood)), edges(grid.grid_candidates(df, 64, neighbourhood))
    monkeypatch.setattr(grid, "CELL_LINES", bound)
    assert edges(connect_pairs(df, params, neighbourhood=neighbourhood)) == want and len(want) > 30
    assert edges(grid.grid_candidates(df, 64, neighbourhood)) == cand


def test_a_cell_of_very_many_lines_is_spread(spark):
    n = 20_000
    at = spark.range(n).select(F.lit(1).cast("long").alias("image_id"), F.col("id").alias("line_id"), (F.pmod(F.xxhash64("id"), F.lit(990))).alias("x1"), (F.pmod(F.xxhash64(F.col("id") + 1), F.lit(990))).alias("y1"), F.lit(255).alias("rgb"))
    df = at.select("image_id", "line_id", "x1", "y1", (F.col("x1") + 2).alias("x2"), (F.col("y1") + 1).alias("y2"), "rgb")
    cells = grid.lines_to_cells(df, 1000 // grid.FINER)
    assert cells.groupBy("cell_r", "cell_c").count().agg(F.max("count")).first()[0] < grid.CELL_LINES / 4
    found = connect_pairs(df)
    assert found.where("src >= dst").isEmpty()
    few = {(r["src"], r["dst"]) for r in found.where("src < 40").collect()}
    pos = {r["line_id"]: r for r in df.collect()}
    assert few == {(i, j) for i in range(40) for j in range(i + 1, n) if brute_near(tuple(pos[i][c] for c in ("x1", "y1", "x2", "y2")), tuple(pos[j][c] for c in ("x1", "y1", "x2", "y2")), 3)}


def test_one_line_across_ten_thousand_cells(spark):
    df = lines(spark, [(1, 0, 0, 0, 99_999, 33_333, 255), (1, 1, 99_999, 33_333, 0, 0, 255), (1, 2, 7, 5, 7, 50_000, 255)])
    got = {r["line_id"]: r["count"] for r in grid.lines_to_cells(df, 10).groupBy("line_id").count().collect()}
    assert got[2] == 5000 and got[0] == 9999 + 3333 + 1 and abs(got[1] - got[0]) <= 3334


def test_hull_of_a_very_wide_group(spark):
    n = 400_000
    at = spark.range(n).select(F.lit(1).alias("g"), ((F.col("id") * 7919) % 160_000 - 80_000).alias("x"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("h"))
    # A wide lens: its height falls with the square of the distance from the middle.
    points = at.select("g", "x", F.expr("(80000L * 80000L - x * x) div 100000 * (h - 500) div 500").alias("y"))
    columns = chords._columns(points, ["g"])
    assert columns.select(F.size("columns")).first()[0] * 24 < 1 << 20
    got = chords.hull_chord(points.unionByName(spark.createDataFrame([(2, 5, 5), (2, 9, 9)], "g int, x long, y long")), ["g"]).orderBy("g").collect()
    own = np.array(points.groupBy("x").agg(F.min("y"), F.max("y")).collect(), dtype=np.int64)
    want = chords.longest_chord(np.concatenate([own[:, [0, 1]], own[:, [0, 2]]]))
    assert tuple(got[0])[1:] == want and tuple(got[1]) == (2, 5, 5, 9, 9, 32)


def test_a_model_is_loaded_once_per_worker(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "loads")

    def load():
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda x: np.stack([x.sum(axis=1), -x.sum(axis=1)], axis=1)

    monkeypatch.setattr(scoring, "SCORE_BYTES", 100)
    df = spark.range(200).select(F.col("id").alias("image_id"), F.array(F.col("id").cast("double") - 99.5, F.lit(0.0)).alias("values")).repartition(24)
    got = {r["image_id"]: (r["label"], r["score"]) for r in score_images(df, load=load).collect()}
    assert got == {i: (int(i < 99.5), abs(i - 99.5)) for i in range(200)}
    loads = open(log).read().split()
    assert len(loads) == len(set(loads)) < 24
    weights = np.arange(2.0)
    assert score_images(df, lambda x: np.stack([x @ weights, x @ weights + 1], axis=1)).where("label = 1").count() == 200


def test_results_are_pruned_and_compacted(spark, tmp_path, monkeypatch):
    folder, schema = str(tmp_path / "out"), "image_id long, x1 long"
    rows = lambda low, high, x: spark.range(low, high).select(F.format_string("k%d", "id").alias("key"), F.col("id").alias("image_id"), F.lit(x).cast("long").alias("x1"))
    for x in range(4):
        catalog.write_lines(rows(0, 100, x), folder, "line")
    catalog.write_lines(rows(90, 120, 9).limit(0), folder, "line", rows(90, 100, 0))  # computed again, without any line
    want = {(f"k{i}", i, 3) for i in range(90)}
    read = lambda keys=None: {(r["key"], r["image_id"], r["x1"]) for r in catalog.read_lines(spark, folder, "line", schema, keys).collect()}
    size = lambda: spark.read.parquet(catalog.current_folder(spark, folder, "line")).count()
    two = rows(5, 7, 0)
    assert read() == want and read(two) == {("k5", 5, 3), ("k6", 6, 3)} and size() == 400
    found = catalog.read_lines(spark, folder, "line", schema, two)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "slot" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(found.inputFiles()) >= 1 and len({f.split("slot=")[1].split("/")[0] for f in found.inputFiles() if "slot=" in f}) <= 64
    with monkeypatch.context() as m:
        m.setattr(catalog, "name_current", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            catalog.compact_lines(spark, folder, "line", schema)
    assert read() == want and size() == 400
    catalog.compact_lines(spark, folder, "line", schema)
    assert read() == want and size() == 90 and len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("line")]) == 1
    catalog.write_lines(rows(0, 10, 7), folder, "line")
    assert read(two) == {("k5", 5, 7), ("k6", 6, 7)} and len(read()) == 90


def test_a_stream_of_image_files(spark, tmp_path):
    source, folder, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    draw = lambda i, n: fixtures.write_images(spark.createDataFrame([(i, 3, c, 255) for c in range(n)], "image_id long, row long, col long, rgb int"), f"file://{source}", 32, 40)
    versions = lambda: sorted((r["key"], r["kind"]) for r in spark.read.parquet(f"{folder}/catalog").collect())
    draw(7, 20)
    run = lambda at: detect_image_stream(spark, source, folder, at, Params(tile=64)).awaitTermination()
    run(state)
    draw(8, 9)
    run(state)
    assert versions() == [(f"{i}.png(None, None)", k) for i in (7, 8) for k in ("connect", "line")]
    assert {(r["key"], r["x1"], r["x2"]) for r in catalog.read_lines(spark, folder, "line", "x1 long, x2 long").collect()} == {("7.png(None, None)", 0, 19), ("8.png(None, None)", 0, 8)}
    # A batch that is replayed, as after a crash before its commit, adds nothing, be it recorded or not.
    batch = spark.createDataFrame([(f"file://{source}/8.png",), (f"file://{source}/7.png",)], "path string")
    for number in (1, 17):
        detect_file_batch(batch, number, folder, Params(tile=64))
    assert len(versions()) == 4


def test_a_python_predicate(spark):
    @F.pandas_udf("boolean")
    def alike(a, b):
        return (a - b).abs() <= 3

    rng = random.Random(6)
    rows = [(1, i, rng.randrange(90), rng.randrange(90), rng.randrange(90), rng.randrange(90), 255) for i in range(60)]
    found = detect_pairs(lines(spark, rows), lambda a, b: alike(F.col(f"{a}.x1"), F.col(f"{b}.x1")), replace(DEFAULTS, grid=1000))
    assert edges(found) == {(i, j) for i in range(60) for j in range(i + 1, 60) if abs(rows[i][2] - rows[j][2]) <= 3}


def test_cached_detection_leaves_no_tables(spark, tmp_path):
    pixels = spark.createDataFrame([(1, 3, c, 255) for c in range(20)], "image_id long, row long, col long, rgb int")
    before = len(components._tables)
    got = detect_cached(spark.createDataFrame([("one", 1, False)], "key string, image_id long, forced boolean"), pixels, str(tmp_path), Params(tile=64))
    assert len(components._tables) == before + 1 and [d.count() for d in got] == [1, 1, 1]


def test_one_exchange_of_pixels_and_one_of_strokes(spark):
    px = runs.assign_tiles(spark.createDataFrame([(1, 0, 0, 255)], "image_id long, row long, col long, rgb int"), 8)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    with components.co_partitioned(spark):
        strokes = plan(runs.extract_elines(px))
        assert len(set(re.findall("Exchange hashpartitioning[^\\n]*?plan_id=([0-9]+)", strokes))) - strokes.count("ReusedExchange") <= 2
        assert "row#" not in "".join(re.findall("Exchange hashpartitioning\\(([^)]*)", strokes))
        known = components.written(runs.extract_elines(px), "strokes")
        for df in (links.trim_overlaps(known), links.link_endpoints(known, TILE, "eline_id", 1)):
            keys = re.findall("Exchange hashpartitioning\\(([^)]*?), [0-9]+\\)", plan(df))
            assert keys and all("x" not in k.replace("hashpartitioning", "") for k in keys), keys
    assert "." in plan(px)
