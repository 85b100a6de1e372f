"""Registered queries of the raster drawing operators and their DuckDB SQL.

Lines come from fixtures.segments, pixels from fixtures.pixels in tiles of 32, so
that the small drawings have several tiles.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linework import fixtures
from linework.fixtures import DUCK_PIX, DUCK_SEG
from linework.functions import geometry as geo
from linework.operators import chords, grid, links, runs, scoring, strokes
from linework.operators.components import shared_dir, written
from linework.params import DEFAULTS
from linework.plans import connect, jobs, lines
from linework.schema import TILE
from linework.sources import catalog, images

QUERIES: dict = {}
ORACLES: dict = {}
TILE_SIZE, GRID, EPS = 32, 1000, 3
PARAMS = replace(DEFAULTS, tile=TILE_SIZE)
T = "image_id, tile_r, tile_c"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seg(spark, d):
    return connect.with_rgb(fixtures.segments(spark, d))


def colored(spark, d):
    return connect.drop_black_lines(seg(spark, d))


def tiles(spark, d):
    return runs.assign_tiles(fixtures.pixels(spark, d), TILE_SIZE)


def contour(spark, d):
    # The drawings are dealt by image.
    return runs.contour_pixels(tiles(spark, d))


def elines(spark, d):
    return strokes.elines(tiles(spark, d))


# Building blocks of the SQL side, each with what it needs before it.
SEG = f"WITH RECURSIVE {DUCK_SEG}, lines AS (SELECT *, r * 65536 + g * 256 + b AS rgb FROM seg), col AS (SELECT * FROM lines WHERE rgb <> 0)"
PIX = f"WITH {DUCK_PIX}, px AS (SELECT image_id, row // {TILE_SIZE} AS tile_r, col // {TILE_SIZE} AS tile_c, row % {TILE_SIZE} AS row, col % {TILE_SIZE} AS col, rgb FROM pix)"
CT = f"""{PIX}, nb AS (SELECT {", ".join("p." + c for c in (*TILE, "row", "col"))}, count(q.rgb) AS k FROM px p CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dr, dc)
  LEFT JOIN px q ON q.image_id = p.image_id AND q.tile_r = p.tile_r AND q.tile_c = p.tile_c AND q.row = p.row + o.dr AND q.col = p.col + o.dc AND q.rgb = p.rgb GROUP BY ALL),
ct AS (SELECT px.* FROM px JOIN nb USING ({T}, row, col) WHERE k < 4)"""
RUNS = f"""{CT}, hr AS (SELECT {T}, row AS r1, min(col) AS c1, row AS r2, max(col) AS c2, rgb FROM (SELECT *, col - row_number() OVER (PARTITION BY {T}, row, rgb ORDER BY col) AS isl FROM ct) GROUP BY {T}, row, rgb, isl),
vr AS (SELECT {T}, min(row) AS r1, col AS c1, max(row) AS r2, col AS c2, rgb FROM (SELECT *, row - row_number() OVER (PARTITION BY {T}, col, rgb ORDER BY row) AS isl FROM ct) GROUP BY {T}, col, rgb, isl),
dots AS (SELECT * FROM hr WHERE c1 = c2 INTERSECT SELECT * FROM vr WHERE r1 = r2),
runs AS (SELECT *, 0 AS rank FROM vr WHERE r1 < r2 UNION ALL SELECT *, 1 FROM hr WHERE c1 < c2 UNION ALL SELECT *, 2 FROM dots)"""
TOUCH = f"""{RUNS}, corner AS (SELECT *, unnest([{{'row': r1 - 1, 'col': c1 - 1, 'pos': true}}, {{'row': r2 + 1, 'col': c2 + 1, 'pos': true}}, {{'row': r2 + 1, 'col': c1 - 1, 'pos': false}}, {{'row': r1 - 1, 'col': c2 + 1, 'pos': false}}]) AS k FROM runs),
touched AS (SELECT r.{", r.".join(TILE)}, r1, c1, r2, c2, r.rgb, rank, coalesce(bool_or(q.rgb IS NOT NULL AND k.pos), false) AS dir_pos, coalesce(bool_or(q.rgb IS NOT NULL AND NOT k.pos), false) AS dir_neg
  FROM corner r LEFT JOIN ct q ON q.image_id = r.image_id AND q.tile_r = r.tile_r AND q.tile_c = r.tile_c AND q.row = k.row AND q.col = k.col AND q.rgb = r.rgb GROUP BY ALL)"""
ELINES = f"""{TOUCH}, copies AS (SELECT *, unnest(CASE WHEN dir_pos AND dir_neg THEN [0, 1] ELSE [-1] END) AS copy FROM touched),
el AS (SELECT {T}, row_number() OVER (PARTITION BY {T} ORDER BY rank, CASE WHEN rank = 0 THEN c1 ELSE r1 END, CASE WHEN rank = 0 THEN r1 ELSE c1 END, copy) - 1 AS eline_id,
  CASE WHEN r1 = r2 AND c1 = c2 THEN 'dot' ELSE 'line' END AS kind, c1 AS x1, r1 AS y1, c2 AS x2, r2 AS y2, c2 - c1 AS k1, r2 - r1 AS k2, rgb, greatest(c2 - c1, r2 - r1) + 1 AS volume,
  CASE WHEN copy = 1 THEN false ELSE dir_pos END AS dir_pos, CASE WHEN copy = 0 THEN false ELSE dir_neg END AS dir_neg FROM copies)"""
ELINE = ", ".join(runs.ELINE)
INNER = f"""inner_px AS (SELECT DISTINCT {T}, CASE WHEN y1 = y2 THEN y1 ELSE y1 + p END AS row, CASE WHEN x1 = x2 THEN x1 ELSE x1 + p END AS col FROM (SELECT *, unnest(range(1, volume - 1)) AS p FROM el WHERE volume > 2))"""
TRIMMED = f"""{ELINES}, {INNER}, hit AS (SELECT el.*, CASE WHEN a.row IS NOT NULL THEN 1 WHEN b.row IS NOT NULL THEN 2 ELSE 0 END AS m FROM el
  LEFT JOIN inner_px a ON a.image_id = el.image_id AND a.tile_r = el.tile_r AND a.tile_c = el.tile_c AND a.row = y1 AND a.col = x1
  LEFT JOIN inner_px b ON b.image_id = el.image_id AND b.tile_r = el.tile_r AND b.tile_c = el.tile_c AND b.row = y2 AND b.col = x2),
tr AS (SELECT {T}, eline_id, kind, CASE WHEN m = 1 AND x1 <> x2 THEN x1 + 1 ELSE x1 END AS x1, CASE WHEN m = 1 AND x1 = x2 AND y1 <> y2 THEN y1 + 1 ELSE y1 END AS y1,
  CASE WHEN m > 0 AND kind = 'dot' THEN x2 - 1 WHEN m = 2 AND x1 <> x2 THEN x2 - 1 ELSE x2 END AS x2, CASE WHEN m = 2 AND x1 = x2 AND y1 <> y2 THEN y2 - 1 ELSE y2 END AS y2, k1, k2, rgb, volume, dir_pos, dir_neg FROM hit)"""
LINKED = f"""{TRIMMED}, ends AS (SELECT {T}, eline_id, x1 AS x, y1 AS y FROM tr UNION ALL SELECT {T}, eline_id, x2, y2 FROM tr), own AS (SELECT {T}, x, y, max(eline_id) AS dst FROM ends GROUP BY {T}, x, y),
lk AS (SELECT DISTINCT e.{", e.".join(TILE)}, eline_id AS src, dst FROM (SELECT *, unnest([-1, 0, 1]) AS dx FROM ends) e CROSS JOIN (VALUES (-1), (0), (1)) o(dy) JOIN own ON own.image_id = e.image_id AND own.tile_r = e.tile_r AND own.tile_c = e.tile_c AND own.x = e.x + e.dx AND own.y = e.y + dy WHERE eline_id <> dst),
attr AS (SELECT lk.*, a.volume AS va, b.volume AS vb, a.rgb AS ca, b.rgb AS cb, a.dir_pos = b.dir_pos AND a.dir_neg = b.dir_neg AS dirs, a.k1 + b.k2 <> 0 AND b.k1 + a.k2 <> 0 AS turned
  FROM lk JOIN tr a ON a.image_id = lk.image_id AND a.tile_r = lk.tile_r AND a.tile_c = lk.tile_c AND a.eline_id = src JOIN tr b ON b.image_id = lk.image_id AND b.tile_r = lk.tile_r AND b.tile_c = lk.tile_c AND b.eline_id = dst)"""


def scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def linked(spark, d):
    return strokes.stroke_links(tiles(spark, d), 1, attributes=True)


# Cells: a walk from crossing to crossing in SQL would be slow, so crossings are counted as in the operator, but by join instead of arrays.
CELLS = f"""{SEG}, ext AS (SELECT image_id, min(least(x1, x2)) AS min_x, min(least(y1, y2)) AS min_y, max(greatest(x1, x2)) AS max_x, max(greatest(y1, y2)) AS max_y FROM col GROUP BY image_id),
shp AS (SELECT image_id, CAST(ceil(max_x / {GRID}.0) AS BIGINT) AS nx, CAST(ceil(max_y / {GRID}.0) AS BIGINT) AS ny FROM ext),
e0 AS (SELECT col.*, greatest(least(x1 // {GRID}, nx - 1), 0) AS i0, greatest(least(x2 // {GRID}, nx - 1), 0) AS i1, greatest(least(y1 // {GRID}, ny - 1), 0) AS j0, greatest(least(y2 // {GRID}, ny - 1), 0) AS j1, abs(x2 - x1) AS adx, abs(y2 - y1) AS ady FROM col JOIN shp USING (image_id)),
ax AS (SELECT image_id, line_id, k, abs((i0 + CASE WHEN i1 >= i0 THEN 1 + k ELSE -k END) * {GRID} - x1) AS xa FROM (SELECT *, unnest(range(abs(i1 - i0))) AS k FROM e0)),
ay AS (SELECT image_id, line_id, k, abs((j0 + CASE WHEN j1 >= j0 THEN 1 + k ELSE -k END) * {GRID} - y1) AS yb FROM (SELECT *, unnest(range(abs(j1 - j0))) AS k FROM e0)),
cells AS (SELECT image_id, j0 AS cell_r, i0 AS cell_c, line_id FROM e0
  UNION SELECT e0.image_id, j0 + CASE WHEN j1 >= j0 THEN 1 ELSE -1 END * (SELECT count(*) FROM ay WHERE ay.image_id = e0.image_id AND ay.line_id = e0.line_id AND yb * adx <= xa * ady), i0 + CASE WHEN i1 >= i0 THEN 1 ELSE -1 END * (ax.k + 1), e0.line_id FROM e0 JOIN ax USING (image_id, line_id)
  UNION SELECT e0.image_id, j0 + CASE WHEN j1 >= j0 THEN 1 ELSE -1 END * (ay.k + 1), i0 + CASE WHEN i1 >= i0 THEN 1 ELSE -1 END * (SELECT count(*) FROM ax WHERE ax.image_id = e0.image_id AND ax.line_id = e0.line_id AND xa * ady < yb * adx), e0.line_id FROM e0 JOIN ay USING (image_id, line_id))"""
PAIRS = f"""{CELLS}, ctr AS (SELECT DISTINCT c.image_id, cell_r + dr AS cr, cell_c + dc AS cc, line_id FROM cells c CROSS JOIN (VALUES (0, 0), (0, -1), (1, 0), (0, 1), (-1, 0)) o(dr, dc)),
occ AS (SELECT DISTINCT image_id, cell_r AS cr, cell_c AS cc FROM cells), here AS (SELECT ctr.* FROM ctr SEMI JOIN occ USING (image_id, cr, cc)),
cand AS (SELECT DISTINCT a.image_id, a.line_id AS src, b.line_id AS dst FROM here a JOIN here b USING (image_id, cr, cc) WHERE a.line_id < b.line_id),
both_l AS (SELECT cand.*, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, a.rgb AS argb, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2, b.rgb AS brgb FROM cand JOIN col a ON a.image_id = cand.image_id AND a.line_id = src JOIN col b ON b.image_id = cand.image_id AND b.line_id = dst)"""


def _end_near(px: str, py: str, s: str) -> str:
    """SQL: the point is nearer than EPS to the segment s, without division."""
    dx, dy = f"({s}x2 - {s}x1)", f"({s}y2 - {s}y1)"
    t, n, c = f"(({px} - {s}x1) * {dx} + ({py} - {s}y1) * {dy})", f"({dx} * {dx} + {dy} * {dy})", f"(({px} - {s}x1) * {dy} - ({py} - {s}y1) * {dx})"
    ends = f"least(({px} - {s}x1) ** 2 + ({py} - {s}y1) ** 2, ({px} - {s}x2) ** 2 + ({py} - {s}y2) ** 2)"
    return f"CASE WHEN {t} > 0 AND {t} < {n} THEN {c} * {c} < {EPS * EPS} * {n} ELSE {ends} < {EPS * EPS} END"


NEAR = " OR ".join(f"({_end_near(*p)})" for p in (("ax1", "ay1", "b"), ("ax2", "ay2", "b"), ("bx1", "by1", "a"), ("bx2", "by2", "a")))
EDGES = f"{PAIRS}, edges AS (SELECT image_id, src, dst FROM both_l WHERE argb = brgb AND ({NEAR}))"
COMPONENTS = f"""{EDGES}, sym AS (SELECT image_id, src AS u, dst AS v FROM edges UNION SELECT image_id, dst, src FROM edges),
reach(image_id, x, y) AS (SELECT image_id, line_id, line_id FROM col UNION SELECT r.image_id, r.x, s.v FROM reach r JOIN sym s ON s.image_id = r.image_id AND s.u = r.y),
comp AS (SELECT image_id, x AS line_id, min(y) AS component FROM reach GROUP BY image_id, x)"""


# Sources and sinks


@query("""WITH f AS (SELECT 'root/' || event_type || '/' || event_id || '.png' AS path, event_type AS class_name FROM events)
SELECT path, class_name, CAST(dense_rank() OVER (ORDER BY class_name) - 1 AS INT) AS label FROM f""")
def a3_label_from_path(spark, d):
    files = read(spark, d, "events").select(F.concat(F.lit("root/"), "event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit(".png")).alias("path"))
    return images.label_from_path(files).select("path", "class_name", "label")


@query(f"{SEG} SELECT image_id, line_id, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1, CAST(x2 AS INT) AS x2, CAST(y2 AS INT) AS y2, CAST(r AS INT) AS r, CAST(g AS INT) AS g, CAST(b AS INT) AS b FROM lines")
def a4_lines_round_trip(spark, d):
    one = F.struct(*[F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2", "r", "g", "b")])
    rows = seg(spark, d).select("image_id", "line_id", catalog.lines_to_json(F.array(one)).alias("json"))
    return rows.select("image_id", "line_id", F.explode(catalog.lines_from_json(F.col("json"))).alias("l")).select("image_id", "line_id", "l.*")


@query(f"{SEG} SELECT image_id, line_id, x1, y1, x2, y2, rgb, 'image-' || image_id AS key FROM lines")
def a4_lines_through_files(spark, d):
    folder = scratch(spark, "lines")
    rows = seg(spark, d).select("image_id", "line_id", "x1", "y1", "x2", "y2", "rgb", F.concat(F.lit("image-"), F.col("image_id").cast("string")).alias("key"))
    catalog.write_lines(rows, folder, "line")
    return catalog.read_lines(spark, folder, "line", jobs.LINE_COLUMNS)


#: Height and width of the drawings as image files.
SIDE = 128


def drawings(spark, d):
    """The drawings as image files, read back."""
    folder = scratch(spark, "png")
    fixtures.write_images(fixtures.pixels(spark, d), folder, SIDE, SIDE)
    return images.read_images(spark, folder).withColumn("image_id", F.regexp_extract("path", "([0-9]+)[.]png$", 1).cast("long"))


@query(f"{PIX} SELECT DISTINCT image_id, {SIDE} AS height, {SIDE} AS width, 3 AS channels, {3 * SIDE * SIDE}::BIGINT AS n_bytes FROM pix")
def a1_read_images(spark, d):
    return drawings(spark, d).select("image_id", "height", "width", "channels", F.octet_length("data").cast("long").alias("n_bytes"))


@query(f"{PIX} SELECT * FROM pix")
def a2_images_to_pixels(spark, d):
    return images.images_to_pixels(drawings(spark, d))


@query("""SELECT doc_id, source || '_' || doc_id || '.png' || '(' || CASE WHEN doc_id % 2 = 0 THEN 'None' ELSE '(0, ' || n_chars || ')' END || ', ' || CASE WHEN doc_id % 2 = 0 THEN 'None' ELSE '(5, ' || n_chars || ')' END || ')' AS key FROM documents""")
def a5_catalog_key(spark, d):
    crop = lambda c: F.when(F.col("doc_id") % 2 != 0, c)
    path = F.concat(F.lit("/drawings/"), "source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".png"))
    end = F.col("n_chars")
    return read(spark, d, "documents").select("doc_id", catalog.catalog_key(path, crop(F.lit(0)), crop(end), crop(F.lit(5)), crop(end)).alias("key"))


@query(f"{ELINES} SELECT {T}, CASE WHEN y1 = y2 THEN y1 ELSE y1 + p END AS row, CASE WHEN x1 = x2 THEN x1 ELSE x1 + p END AS col FROM (SELECT *, unnest(range(volume)) AS p FROM el)")
def a6_lines_to_pixels(spark, d):
    return strokes.stroke_pixels(tiles(spark, d))


# Projections, filters, predicates


@query(f"{PIX} SELECT image_id, row - 10 AS row, col - 20 AS col, rgb FROM pix WHERE row >= 10 AND row < 60 AND col >= 20 AND col < 70")
def b1_crop_roi(spark, d):
    return runs.crop_roi(fixtures.pixels(spark, d), 10, 60, 20, 70)


@query(f"{PIX} SELECT * FROM px")
def b2_assign_tiles(spark, d):
    return tiles(spark, d)


@query(f"{ELINES} SELECT {T}, eline_id, x1 + tile_c * 32 AS x1, y1 + tile_r * 32 AS y1, x2 + tile_c * 32 AS x2, y2 + tile_r * 32 AS y2 FROM el")
def b3_untile_lines(spark, d):
    return lines.untile_lines(elines(spark, d).select(*TILE, "eline_id", "x1", "y1", "x2", "y2"), TILE_SIZE)


@query("SELECT l_orderkey, l_linenumber, c FROM (SELECT l_orderkey, l_linenumber, CAST((252 + l_partkey % 4) * 65536 + (252 + l_suppkey % 4) * 256 + 255 AS INT) AS c FROM lineitem) WHERE (c >> 16) + ((c >> 8) & 255) + (c & 255) <= 762")
def b4_nonwhite(spark, d):
    c = ((252 + F.col("l_partkey") % 4) * 65536 + (252 + F.col("l_suppkey") % 4) * 256 + 255).cast("int")
    return runs.nonwhite(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c.alias("rgb"))).withColumnRenamed("rgb", "c")


@query("SELECT l_orderkey, l_linenumber, c FROM (SELECT l_orderkey, l_linenumber, CAST((l_partkey * 97 + l_suppkey * 31) % 256 * 65536 + (200 + l_suppkey % 56) * 256 + 255 AS INT) AS c FROM lineitem) WHERE 114 * (c >> 16) + 587 * ((c >> 8) & 255) + 299 * (c & 255) < 245500")
def b5_ink_mask(spark, d):
    c = ((F.col("l_partkey") * 97 + F.col("l_suppkey") * 31) % 256 * 65536 + (200 + F.col("l_suppkey") % 56) * 256 + 255).cast("int")
    return runs.ink_mask(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c.alias("rgb"))).withColumnRenamed("rgb", "c")


@query(f"{ELINES} SELECT {ELINE} FROM el WHERE (x2 - x1) ** 2 + (y2 - y1) ** 2 > 9")
def b6_drop_short_lines(spark, d):
    return links.drop_short_lines(elines(spark, d))


@query(f"{SEG} SELECT * FROM col")
def b7_drop_black_lines(spark, d):
    return colored(spark, d)


@query(f"""{PIX}, box AS (SELECT image_id, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM pix GROUP BY image_id), o AS (SELECT * FROM (VALUES (-1), (0), (1)) a(dr), (VALUES (-1), (0), (1)) b(dc)),
wide AS (SELECT DISTINCT image_id, row + dr AS row, col + dc AS col FROM pix JOIN box USING (image_id), o WHERE row + dr BETWEEN r0 AND r1 AND col + dc BETWEEN c0 AND c1),
held AS (SELECT w.image_id, row + dr AS row, col + dc AS col, count(*) AS n FROM wide w, o GROUP BY ALL)
SELECT image_id, row, col FROM held JOIN box USING (image_id) WHERE row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1 AND n = (least(row + 1, r1) - greatest(row - 1, r0) + 1) * (least(col + 1, c1) - greatest(col - 1, c0) + 1)
EXCEPT SELECT image_id, row, col FROM pix""")
def b8_thin_mask(spark, d):
    return runs.thin_mask(fixtures.pixels(spark, d).select("image_id", "row", "col"))


# Joins


#: Filled squares of up to five pixels, so that many pixels lie inside.
SQUARES = """SELECT image_id, row, col, max(rgb) AS rgb FROM (SELECT CAST(floor(ok / 16) AS BIGINT) AS image_id, CAST((sk * 11 + q * 5 + ln * 17) % 84 + i AS BIGINT) AS row, CAST((pk * 7 + ln * 13) % 84 + j AS BIGINT) AS col,
  CASE rf WHEN 'A' THEN 16711680 WHEN 'N' THEN 65280 ELSE 255 END AS rgb FROM {steps}) GROUP BY image_id, row, col"""
DUCK_SQUARES = SQUARES.format(steps="(SELECT *, unnest(range(CAST(q % 5 + 1 AS BIGINT))) AS j FROM (SELECT *, unnest(range(CAST(q % 5 + 1 AS BIGINT))) AS i FROM base))")


@query(f"""WITH {fixtures.DUCK_BASE}, pix AS ({DUCK_SQUARES}), px AS (SELECT image_id, row // {TILE_SIZE} AS tile_r, col // {TILE_SIZE} AS tile_c, row % {TILE_SIZE} AS row, col % {TILE_SIZE} AS col, rgb FROM pix),
inside AS (SELECT {T}, row, col, rgb FROM (SELECT {T}, row + dr AS row, col + dc AS col, rgb FROM px, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dr, dc)) GROUP BY ALL HAVING count(*) = 4)
SELECT * FROM px ANTI JOIN inside USING ({T}, row, col, rgb)""")
def c1_contour_pixels(spark, d):
    return runs.contour_pixels(runs.assign_tiles(fixtures.base_query(spark, d, SQUARES.replace("{steps}", "(SELECT *, explode(sequence(0, CAST(q % 5 AS INT))) AS j FROM (SELECT *, explode(sequence(0, CAST(q % 5 AS INT))) AS i FROM base))")), TILE_SIZE).repartition(*TILE))


@query(f"{TOUCH} SELECT {T}, r1, c1, r2, c2, rgb, dir_pos, dir_neg FROM touched")
def c2_diagonal_touch(spark, d):
    edge = contour(spark, d)
    return runs.diagonal_touch(runs.runs_of(edge), edge).drop("rank")


@query(f"{TRIMMED} SELECT {ELINE} FROM tr")
def c3_trim_overlaps(spark, d):
    return strokes.elines(tiles(spark, d), trimmed=True)


@query(f"{LINKED} SELECT {T}, src, dst FROM lk")
def c4_link_endpoints(spark, d):
    return strokes.stroke_links(tiles(spark, d), 1)


@query(f"{LINKED} SELECT {T}, src, dst FROM attr WHERE va BETWEEN 1 AND 5 AND va = vb AND ca = cb AND dirs AND (va = 1 OR turned)")
def c5_same_stroke_edges(spark, d):
    return links.same_stroke_edges(linked(spark, d))


@query(f"{LINKED} SELECT {T}, src, dst FROM attr WHERE abs(va - vb) <= 1 AND ca = cb AND dirs AND (va = 1 OR turned)")
def c6_mixed_stroke_edges(spark, d):
    return links.mixed_stroke_edges(linked(spark, d))


@query(f"""{ELINES}, big AS (SELECT {T}, eline_id AS line_id, x1, y1, x2, y2, rgb FROM el WHERE volume > 3), small AS (SELECT * FROM el WHERE volume <= 3),
own AS (SELECT {T}, x, y, max(line_id) AS line_id FROM (SELECT {T}, line_id, x1 AS x, y1 AS y FROM big UNION ALL SELECT {T}, line_id, x2, y2 FROM big) GROUP BY {T}, x, y),
ends AS (SELECT {T}, eline_id, rgb, x1 AS x, y1 AS y FROM small UNION ALL SELECT {T}, eline_id, rgb, x2, y2 FROM small)
SELECT e.{", e.".join(TILE)}, eline_id, own.line_id, count(*) AS times FROM (SELECT *, unnest([-1, 0, 1]) AS dx FROM ends) e CROSS JOIN (VALUES (-1), (0), (1)) o(dy)
JOIN own ON own.image_id = e.image_id AND own.tile_r = e.tile_r AND own.tile_c = e.tile_c AND own.x = e.x + e.dx AND own.y = e.y + dy
JOIN big b ON b.image_id = e.image_id AND b.tile_r = e.tile_r AND b.tile_c = e.tile_c AND b.line_id = own.line_id AND b.rgb = e.rgb GROUP BY ALL""")
def c7_leftover_hits(spark, d):
    return strokes.leftover_hits(tiles(spark, d), 3)


#: For each order line two dashes of one slope or nearly, and between or beside them a leftover that meets one of them, both, or none.
DASHES = """SELECT CAST(ok AS BIGINT) AS image_id, CAST(0 AS BIGINT) AS tile_r, CAST(0 AS BIGINT) AS tile_c, CAST(2 * ln AS BIGINT) AS line_id, CAST(pk % 7 AS BIGINT) AS x1, CAST(60 * ln AS BIGINT) AS y1,
  CAST(pk % 7 + 5 AS BIGINT) AS x2, CAST(60 * ln + 5 + sk % 4 AS BIGINT) AS y2, CASE WHEN rf = 'A' THEN 255 ELSE 65280 END AS rgb FROM base
UNION ALL SELECT CAST(ok AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(2 * ln + 1 AS BIGINT), CAST(pk % 7 + 7 AS BIGINT), CAST(60 * ln + 7 + sk % 4 AS BIGINT), CAST(pk % 7 + 12 AS BIGINT), CAST(60 * ln + 12 + sk % 4 + q % 6 AS BIGINT), CASE WHEN rf = 'R' THEN 65280 WHEN rf = 'A' THEN 255 ELSE 65280 END FROM base"""
LEFT = """SELECT CAST(ok AS BIGINT) AS image_id, CAST(0 AS BIGINT) AS tile_r, CAST(0 AS BIGINT) AS tile_c, CAST(ln AS BIGINT) AS eline_id, CAST(pk % 7 + CASE q % 3 WHEN 0 THEN 6 WHEN 1 THEN 13 ELSE 30 END AS BIGINT) AS x1, CAST(60 * ln + sk % 4 + CASE q % 3 WHEN 0 THEN 6 WHEN 1 THEN 12 + q % 6 ELSE 30 END AS BIGINT) AS y1,
  CAST(pk % 7 + CASE q % 3 WHEN 0 THEN 6 WHEN 1 THEN 15 ELSE 31 END AS BIGINT) AS x2, CAST(60 * ln + sk % 4 + CASE q % 3 WHEN 0 THEN 6 WHEN 1 THEN 12 + q % 6 ELSE 30 END AS BIGINT) AS y2, CASE WHEN rf = 'A' THEN 255 ELSE 65280 END AS rgb FROM base"""
SLOPE = "CASE WHEN {0}x1 = {0}x2 THEN 'inf'::DOUBLE ELSE ({0}y2 - {0}y1)::DOUBLE / ({0}x2 - {0}x1) END"
ANGLE = """CASE WHEN m1 * m2 = -1 THEN 90.0::DOUBLE ELSE degrees(atan(abs((m1 - m2) / (1 + m1 * m2)))) END"""
APART = "(least(ax1, ax2) > greatest(bx1, bx2) OR greatest(ax1, ax2) < least(bx1, bx2) OR least(ay1, ay2) > greatest(by1, by2) OR greatest(ay1, ay2) < least(by1, by2))"


TS = ", ".join("{0}." + c for c in TILE)


def on(a: str, b: str, keys=TILE) -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)


def reach_sql(name: str, nodes: str, node: str, edges: str, keys=TILE) -> str:
    """SQL: name (keys, node, component) of the nodes linked by edges (keys, src, dst); the recursion gathers all that a node reaches."""
    k = ", ".join(keys)
    return f"""{name}_sym AS (SELECT {k}, src AS u, dst AS v FROM {edges} UNION SELECT {k}, dst, src FROM {edges}),
{name}_reach({k}, x, y) AS (SELECT {k}, {node}, {node} FROM {nodes} UNION SELECT {", ".join("r." + c for c in keys)}, r.x, s.v FROM {name}_reach r JOIN {name}_sym s ON {on("r", "s", keys)} AND s.u = r.y),
{name} AS (SELECT {k}, x AS {node}, min(y) AS component FROM {name}_reach GROUP BY {k}, x)"""


def chord_sql(name: str, points: str, group: str, keys=TILE) -> str:
    """SQL: name (keys, group, rgb, x1, y1, x2, y2), the points (keys, group, rgb, x, y) of a group farthest apart."""
    k = ", ".join("a." + c for c in keys)
    return f"""{name} AS (SELECT {k}, a.{group}, a.rgb, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM {points} a JOIN {points} b ON {on("a", "b", keys)} AND a.{group} = b.{group} AND a.rgb = b.rgb AND (a.x, a.y) <= (b.x, b.y)
  QUALIFY row_number() OVER (PARTITION BY {k}, a.{group}, a.rgb ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) DESC, a.x, a.y, b.x, b.y) = 1)"""


def points_sql(rows: str, columns: str) -> str:
    return f"SELECT {columns}, x1 AS x, y1 AS y FROM {rows} UNION SELECT {columns}, x2, y2 FROM {rows}"


def attach_sql(alone: str, known: str) -> str:
    """SQL: hits, joined and links of leftovers (alone) at the ends of lines (known, with line_id)."""
    return f"""k_own AS (SELECT {T}, x, y, max(line_id) AS line_id FROM ({points_sql(known, T + ", line_id")}) GROUP BY {T}, x, y),
a_ends AS (SELECT {T}, eline_id, rgb, x1 AS x, y1 AS y FROM {alone} UNION ALL SELECT {T}, eline_id, rgb, x2, y2 FROM {alone}),
hits AS (SELECT {TS.format("e")}, eline_id, o.line_id, count(*) AS times FROM (SELECT *, unnest([-1, 0, 1]) AS dx FROM a_ends) e CROSS JOIN (VALUES (-1), (0), (1)) d(dy)
  JOIN k_own o ON {on("o", "e")} AND o.x = e.x + e.dx AND o.y = e.y + dy JOIN {known} k ON {on("k", "e")} AND k.line_id = o.line_id AND k.rgb = e.rgb GROUP BY ALL),
totals AS (SELECT {T}, eline_id, sum(times) AS total FROM hits GROUP BY {T}, eline_id),
joined AS (SELECT {T}, eline_id, line_id FROM hits JOIN totals USING ({T}, eline_id) WHERE total = 1),
met AS (SELECT DISTINCT {TS.format("a")}, a.line_id AS src, b.line_id AS dst FROM hits a JOIN hits b ON {on("a", "b")} AND a.eline_id = b.eline_id AND a.line_id <> b.line_id),
turns AS (SELECT m.*, {CHORD.format("a", "b")} AS s1, {CHORD.format("b", "a")} AS s2, a.x1 AS px, a.y1 AS py, b.x1 AS qx, b.y1 AS qy FROM met m JOIN {known} a ON {on("a", "m")} AND a.line_id = src JOIN {known} b ON {on("b", "m")} AND b.line_id = dst),
a_links AS (SELECT {T}, src, dst FROM turns WHERE NOT isinf(s1) AND NOT isinf(s2) AND abs(s1 - s2) < 1 AND abs((py - s1 * px) - (qy - s2 * qx)) < 1 AND abs(s1) BETWEEN 1 AND 999)"""


#: Slope from the first end of one to the second end of the other.
CHORD = "CASE WHEN {0}.x1 = {1}.x2 THEN 'inf'::DOUBLE ELSE ({1}.y2 - {0}.y1)::DOUBLE / ({1}.x2 - {0}.x1) END"


def merging_sql(moved: str) -> str:
    """SQL: lines, those of moved (tile, x1, y1, x2, y2, rgb in coordinates of the image) numbered and longer than 3, and merges (image_id, src, dst)."""
    return f"""lines AS (SELECT * FROM (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY tile_r, tile_c, x1, y1, x2, y2, rgb) - 1 AS line_id, x1, y1, x2, y2, rgb FROM {moved}) WHERE (x2 - x1) ** 2 + (y2 - y1) ** 2 > 9),
m_ends AS (SELECT image_id, line_id, x1 AS x, y1 AS y FROM lines UNION ALL SELECT image_id, line_id, x2, y2 FROM lines), m_own AS (SELECT image_id, x, y, max(line_id) AS dst FROM m_ends GROUP BY ALL),
m_lk AS (SELECT DISTINCT e.image_id, line_id AS src, dst FROM (SELECT *, unnest(range(-3, 4)) AS dx FROM m_ends) e CROSS JOIN (SELECT unnest(range(-3, 4)) AS dy) o JOIN m_own ON m_own.image_id = e.image_id AND m_own.x = e.x + e.dx AND m_own.y = e.y + dy WHERE line_id <> dst),
p AS (SELECT k.*, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, a.rgb AS ca, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2, b.rgb AS cb FROM m_lk k JOIN lines a ON a.image_id = k.image_id AND a.line_id = src JOIN lines b ON b.image_id = k.image_id AND b.line_id = dst),
s AS (SELECT *, {SLOPE.format("a")} AS sa, {SLOPE.format("b")} AS sb FROM p), m AS (SELECT *, CASE WHEN isinf(sa) THEN 99999999999 ELSE sa END AS m1, CASE WHEN isinf(sb) THEN 99999999999 ELSE sb END AS m2 FROM s),
merges AS (SELECT image_id, src, dst FROM m WHERE ca = cb AND {ANGLE} < 1 AND {APART} AND CASE WHEN isinf(sa) THEN ax1 = bx1 WHEN sa = 0 THEN ay1 = by1 ELSE true END)"""


def merged_sql(moved: str) -> str:
    """SQL: merging_sql(), and merged (image_id, line_id, rgb, x1, y1, x2, y2), the lines that merges make."""
    return f"""{merging_sql(moved)}, {reach_sql("of", "lines", "line_id", "merges", ["image_id"])},
of_pt AS ({points_sql("(SELECT l.image_id, component AS line_id, rgb, x1, y1, x2, y2 FROM lines l JOIN of USING (image_id, line_id))", "image_id, line_id, rgb")}), {chord_sql("merged", "of_pt", "line_id", ["image_id"])}"""


def moved_sql(rows: str) -> str:
    return f"moved AS (SELECT image_id, tile_r, tile_c, x1 + tile_c * {TILE_SIZE} AS x1, y1 + tile_r * {TILE_SIZE} AS y1, x2 + tile_c * {TILE_SIZE} AS x2, y2 + tile_r * {TILE_SIZE} AS y2, rgb FROM {rows})"


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


#: Detection in tiles: two passes of linking, chords, leftovers, and chords again.
IN_TILES = f"""{recursive(LINKED)}, e1 AS (SELECT {T}, src, dst FROM attr WHERE va BETWEEN 1 AND 5 AND va = vb AND ca = cb AND dirs AND (va = 1 OR turned)),
{reach_sql("c1", "tr", "eline_id", "e1")}, z1 AS (SELECT *, count(*) OVER (PARTITION BY {T}, component) AS size FROM c1), taken AS (SELECT * FROM z1 WHERE size >= {PARAMS.long_run}), rest AS (SELECT * FROM z1 WHERE size < {PARAMS.long_run}),
e2 AS (SELECT {TS.format("a")}, src, dst FROM attr a JOIN rest x ON {on("x", "a")} AND x.eline_id = src JOIN rest y ON {on("y", "a")} AND y.eline_id = dst WHERE abs(va - vb) <= 1 AND ca = cb AND dirs AND (va = 1 OR turned)),
{reach_sql("c2", "rest", "eline_id", "e2")}, z2 AS (SELECT c2.*, volume, count(*) OVER (PARTITION BY {T}, component) AS size FROM c2 JOIN tr USING ({T}, eline_id)),
alone AS (SELECT tr.* FROM tr JOIN z2 USING ({T}, eline_id) WHERE size = 1 AND z2.volume <= {PARAMS.leftover_volume}),
grp AS (SELECT {T}, eline_id, component, 1 AS pass FROM taken UNION ALL SELECT {T}, eline_id, component, 2 FROM z2 WHERE size > 1 OR volume > {PARAMS.leftover_volume}),
num AS (SELECT tr.*, dense_rank() OVER (PARTITION BY {T} ORDER BY pass, component) - 1 AS line_id FROM grp JOIN tr USING ({T}, eline_id)),
num_pt AS ({points_sql("num", T + ", line_id, rgb")}), {chord_sql("chords", "num_pt", "line_id")}, {attach_sql("alone", "chords")}, {reach_sql("c3", "chords", "line_id", "a_links")},
final_pt AS ({points_sql(f"(SELECT {TS.format('c')}, component AS line_id, rgb, x1, y1, x2, y2 FROM chords c JOIN c3 USING ({T}, line_id))", T + ", line_id, rgb")}
  UNION {points_sql(f"(SELECT {TS.format('a')}, component AS line_id, rgb, x1, y1, x2, y2 FROM alone a JOIN joined USING ({T}, eline_id) JOIN c3 USING ({T}, line_id))", T + ", line_id, rgb")}),
{chord_sql("found", "final_pt", "line_id")}"""
DETECTED = f"{IN_TILES}, {moved_sql('found')}, {merged_sql('moved')}"

#: Strokes in coordinates of the image, numbered: those cut by a tile border go on in each other.
STROKES = f"{recursive(ELINES)}, {moved_sql('el')}"
MERGES = f"{STROKES}, {merging_sql('moved')}"


@query(f"""WITH {fixtures.DUCK_BASE}, dashes AS ({DASHES}), remains AS ({LEFT}), {attach_sql("remains", "dashes")}
SELECT {T}, 'joined' AS kind, eline_id AS a, line_id AS b FROM joined UNION ALL SELECT {T}, 'linked', src, dst FROM a_links""")
def c7_attach_leftovers(spark, d):
    joined, pairs = links.attach_leftovers(fixtures.base_query(spark, d, LEFT), fixtures.base_query(spark, d, DASHES))
    joined = joined.select(*TILE, F.lit("joined").alias("kind"), F.col("eline_id").alias("a"), F.col("line_id").alias("b"))
    return joined.unionByName(pairs.select(*TILE, F.lit("linked").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))


def stroke_lines(spark, d):
    return written(lines.number_lines(strokes.placed(tiles(spark, d), lines.SHORT, None), TILE_SIZE), "numbered")


@query(f"{MERGES} SELECT * FROM merges")
def c8_collinear_merge_edges(spark, d):
    return links.collinear_merge_edges(links.drop_short_lines(stroke_lines(spark, d)))


@query(f"{STROKES}, {merged_sql('moved')} SELECT image_id, line_id, rgb, x1, y1, x2, y2 FROM merged")
def j3_concat_lines(spark, d):
    return lines.concat_lines(stroke_lines(spark, d))


@query(f"{CELLS} SELECT image_id, cell_r, cell_c, line_id FROM cells")
def c9_lines_to_cells(spark, d):
    return grid.lines_to_cells(colored(spark, d), GRID)


@query(f"{PAIRS} SELECT * FROM cand")
def c10_grid_candidates(spark, d):
    return grid.grid_candidates(colored(spark, d), GRID)


@query(f"{EDGES} SELECT * FROM edges")
def c11_connect_pairs(spark, d):
    return connect.connect_pairs(colored(spark, d))


@query(f"{PAIRS} SELECT image_id, src, dst FROM both_l WHERE ax1 = bx1 AND argb <> brgb")
def c12_pair_join(spark, d):
    return grid.pair_join(colored(spark, d), GRID, lambda a, b: (F.col(f"{a}.x1") == F.col(f"{b}.x1")) & (F.col(f"{a}.rgb") != F.col(f"{b}.rgb")))


@query(f"{PAIRS} SELECT image_id, src, dst, EXISTS (SELECT 1 FROM cells a JOIN cells b USING (image_id, cell_r, cell_c) WHERE a.image_id = c.image_id AND a.line_id = src AND b.line_id = dst) AS overlap FROM cand c")
def c13_cells_overlap(spark, d):
    own = colored(spark, d)
    of = grid.lines_to_cells(own, GRID).groupBy("image_id", "line_id").agg(F.collect_list(F.struct("cell_r", "cell_c")).alias("cells"))
    a, b = (of.select("image_id", F.col("line_id").alias(n), F.col("cells").alias(f"{n}_cells")) for n in ("src", "dst"))
    pairs = grid.grid_candidates(own, GRID).join(a, ["image_id", "src"]).join(b, ["image_id", "dst"])
    return pairs.select("image_id", "src", "dst", grid.cells_overlap(F.col("src_cells"), F.col("dst_cells")).alias("overlap"))


def requests(spark, d):
    return read(spark, d, "documents").select(F.concat("source", F.lit("_"), F.col("doc_id").cast("string")).alias("key"), (F.col("n_chars") % 10 == 0).alias("forced"), (F.col("n_chars") % 2 == 0).alias("done"))


REQUESTS = "WITH q AS (SELECT source || '_' || doc_id AS key, n_chars % 10 = 0 AS forced, n_chars % 2 = 0 AS done FROM documents)"


@query(f"{REQUESTS} SELECT key, forced FROM q WHERE forced OR key NOT IN (SELECT key FROM q WHERE done)")
def c14_missing_work(spark, d):
    asked = requests(spark, d)
    return catalog.missing_work(asked.select("key", "forced"), asked.where("done").select("key"))


@query(f"{REQUESTS} SELECT key, forced FROM q WHERE NOT forced AND key IN (SELECT key FROM q WHERE done)")
def c15_reuse_results(spark, d):
    asked = requests(spark, d)
    return catalog.reuse_results(asked.select("key", "forced"), asked.where("done").select("key"))


# Aggregations


@query(f"{CELLS} SELECT * FROM ext")
def d1_extent(spark, d):
    return grid.extent(colored(spark, d))


@query(f"{CELLS} SELECT image_id, nx AS grid_x, ny AS grid_y FROM shp")
def d2_grid_shape(spark, d):
    return grid.grid_shape(colored(spark, d), GRID)


@query(f"{CELLS} SELECT image_id, cell_r, cell_c, list(line_id ORDER BY line_id) AS lines, count(*) AS n FROM cells GROUP BY image_id, cell_r, cell_c")
def d3_cell_index(spark, d):
    return grid.cell_index(grid.lines_to_cells(colored(spark, d), GRID))


@query(f"""{RUNS}, spans AS (SELECT *, unnest(range(greatest(r2 - r1, c2 - c1) + 1)) AS p FROM hr), c AS (SELECT s.{", s.".join(TILE)}, r1, c1, r2, c2, px.rgb, count(*) AS n, min(p) AS f FROM spans s JOIN px ON px.image_id = s.image_id AND px.tile_r = s.tile_r AND px.tile_c = s.tile_c AND px.row = r1 AND px.col = c1 + p GROUP BY ALL)
SELECT {T}, r1, c1, r2, c2, arg_max(rgb, n * 1000 - f) AS rgb FROM c GROUP BY ALL""")
def d4_dominant_color(spark, d):
    return runs.dominant_color(runs.horizontal_runs(contour(spark, d)), tiles(spark, d))


@query(f"{ELINES} SELECT image_id, volume, count(*) AS n FROM el GROUP BY image_id, volume")
def d5_volume_histogram(spark, d):
    return runs.volume_histogram(elines(spark, d))


@query(f"{SEG} SELECT image_id, x, y, max(line_id) AS owner FROM (SELECT image_id, line_id, x1 AS x, y1 AS y FROM lines UNION ALL SELECT image_id, line_id, x2, y2 FROM lines) GROUP BY image_id, x, y")
def d6_endpoint_owner(spark, d):
    return links.endpoint_owner(seg(spark, d), ["image_id"], "line_id")


@query(f"{COMPONENTS}, z AS (SELECT *, count(*) OVER (PARTITION BY image_id, component) AS size FROM comp) SELECT image_id, line_id, size >= 3 AS long FROM z")
def d7_split_by_size(spark, d):
    grouped = connect.detect_connect(seg(spark, d), neighbourhood="plus")
    sized = grouped.join(connect.component_sizes(grouped).withColumnRenamed("n", "size"), ["image_id", "component"])
    long, rest = lines.split_by_size(sized, 3)
    return long.select("image_id", "line_id", F.lit(True).alias("long")).unionByName(rest.select("image_id", "line_id", F.lit(False).alias("long")))


@query(f"""{SEG}, p AS (SELECT DISTINCT image_id, rgb, x, y FROM (SELECT image_id, rgb, x1 AS x, y1 AS y FROM lines UNION ALL SELECT image_id, rgb, x2, y2 FROM lines)),
d AS (SELECT a.image_id, a.rgb, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p a JOIN p b ON a.image_id = b.image_id AND a.rgb = b.rgb AND (a.x, a.y) <= (b.x, b.y))
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY image_id, rgb ORDER BY d2 DESC, x1, y1, x2, y2) = 1""")
def d8_hull_chord(spark, d):
    return chords.hull_chord(links.end_points(seg(spark, d), ["image_id", "rgb"], "line_id").select("image_id", "rgb", "x", "y"), ["image_id", "rgb"])


@query(f"""{SEG}, p AS (SELECT DISTINCT image_id, rgb, x, y FROM (SELECT image_id, rgb, x1 AS x, y1 AS y FROM lines UNION ALL SELECT image_id, rgb, x2, y2 FROM lines)),
e AS (SELECT a.image_id, a.rgb, a.x, a.y, b.x AS next_x, b.y AS next_y FROM p a JOIN p b ON a.image_id = b.image_id AND a.rgb = b.rgb AND (a.x, a.y) <> (b.x, b.y)),
c AS (SELECT e.*, (next_x - e.x) * (p.y - e.y) - (next_y - e.y) * (p.x - e.x) AS side, (p.x - e.x) * (p.x - next_x) + (p.y - e.y) * (p.y - next_y) AS between FROM e JOIN p ON p.image_id = e.image_id AND p.rgb = e.rgb)
SELECT image_id, rgb, x, y, next_x, next_y FROM c GROUP BY ALL HAVING bool_and(side > 0 OR side = 0 AND between <= 0)
UNION ALL SELECT image_id, rgb, min(x), min(y), min(x), min(y) FROM p GROUP BY image_id, rgb HAVING count(*) = 1""")
def d9_hull(spark, d):
    found = chords.hull(links.end_points(seg(spark, d), ["image_id", "rgb"], "line_id").select("image_id", "rgb", "x", "y"), ["image_id", "rgb"])
    edges = F.expr("transform(vertices, (v, i) -> struct(v.x AS x, v.y AS y, vertices[(i + 1) % size(vertices)].x AS next_x, vertices[(i + 1) % size(vertices)].y AS next_y))")
    return found.select("image_id", "rgb", F.explode(edges).alias("e")).select("image_id", "rgb", "e.*")


@query(f"{COMPONENTS} SELECT image_id, component, count(*) AS n, list(line_id ORDER BY line_id) AS lines FROM comp GROUP BY image_id, component")
def d10_group_members(spark, d):
    return connect.group_members(connect.detect_connect(seg(spark, d)))


@query(f"{COMPONENTS} SELECT image_id, u AS node, list(v ORDER BY v) AS neighbours, count(*) AS degree FROM sym GROUP BY image_id, u")
def d11_neighbor_lists(spark, d):
    return connect.neighbor_lists(connect.connect_pairs(colored(spark, d)))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def d12_class_counts(spark, d):
    return scoring.class_counts(read(spark, d, "embeddings"))


LOGITS = """WITH v AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), w AS (SELECT label AS class, dim, avg(v) AS w FROM v GROUP BY ALL),
lg AS (SELECT v.vec_id, any_value(v.label) AS label, class, sum(v.v * w.w) AS logit FROM v JOIN w USING (dim) GROUP BY v.vec_id, class),
ls AS (SELECT vec_id, any_value(label) AS label, list(logit ORDER BY class) AS logits FROM lg GROUP BY vec_id)"""


def class_weights(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("label").alias("class"), F.posexplode("embedding").alias("dim", "v")).groupBy("class", "dim").agg(F.avg(F.col("v").cast("double")).alias("w"))


def logits(spark, d):
    vectors = read(spark, d, "embeddings")
    values = vectors.select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("dim", "v")).select("image_id", "dim", F.col("v").cast("double").alias("value"))
    scored = scoring.collect_logits(scoring.linear_head(values, class_weights(vectors)))
    return scored.join(vectors.select(F.col("vec_id").alias("image_id"), "label"), "image_id")


CE = "ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) + list_max(logits) - logits[label + 1]"


@query(f"""{LOGITS}, b AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 16 AS batch, {CE} AS loss, list_position(logits, list_max(logits)) - 1 = label AS ok FROM ls), p AS (SELECT batch, avg(loss) AS loss, sum(ok::INT) AS k, count(*) AS n FROM b GROUP BY batch)
SELECT round(avg(loss), 4) AS loss, round(sum(k) * 100.0::DOUBLE / sum(n), 4) AS accuracy, CAST(sum(n) AS BIGINT) AS n FROM p""")
def d13_classification_metrics(spark, d):
    return scoring.classification_metrics(logits(spark, d)).select(F.round("loss", 4).alias("loss"), F.round(F.col("accuracy").cast("double"), 4).alias("accuracy"), "n")


# Windows


@query(f"{RUNS} SELECT * FROM hr")
def w1_horizontal_runs(spark, d):
    return runs.horizontal_runs(contour(spark, d))


@query(f"{RUNS} SELECT * FROM vr")
def w2_vertical_runs(spark, d):
    return runs.vertical_runs(contour(spark, d))


@query("""WITH b AS (SELECT user_id % 5 AS epoch, event_id // 50 AS batch_id, sum((event_type = 'click')::INT)::BIGINT AS "right", count(*) AS n FROM events GROUP BY ALL)
SELECT *, round(sum("right") OVER w * 100.0::DOUBLE / sum(n) OVER w, 4) AS accuracy FROM b WINDOW w AS (PARTITION BY epoch ORDER BY batch_id)""")
def w3_running_accuracy(spark, d):
    rows = read(spark, d, "events").groupBy((F.col("user_id") % 5).alias("epoch"), F.expr("event_id div 50").alias("batch_id"))
    per = rows.agg(F.sum((F.col("event_type") == "click").cast("long")).alias("right"), F.count("*").alias("n"))
    return scoring.running_accuracy(per).withColumn("accuracy", F.round(F.col("accuracy").cast("double"), 4))


@query("SELECT event_id, row_number() OVER (ORDER BY md5('split-1:' || event_id), event_id) <= (count(*) OVER ()) * 8 // 10 AS training FROM events")
def w4_exact_split(spark, d):
    return scoring.exact_split(read(spark, d, "events").select("event_id"), "event_id")


@query(f"{ELINES} SELECT {T}, eline_id, kind, x1, y1, x2, y2 FROM el")
def w5_number_elines(spark, d):
    return elines(spark, d).select(*TILE, "eline_id", "kind", "x1", "y1", "x2", "y2")


# Sort, limit, top-k


@query(f"{SEG} SELECT image_id, line_id, x1, y1, x2, y2 FROM lines QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY line_id) <= 6")
def s2_preview(spark, d):
    w = Window.partitionBy("image_id").orderBy("line_id")
    return seg(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 6").select("image_id", "line_id", "x1", "y1", "x2", "y2")


@query(f"{LOGITS} SELECT vec_id AS image_id, CAST(list_position(logits, list_max(logits)) - 1 AS INT) AS prediction, round(list_max(logits), 4) AS score FROM ls")
def s3_top1(spark, d):
    return scoring.top1(logits(spark, d)).select("image_id", "prediction", F.round("score", 4).alias("score"))


# Sets


@query(f"{RUNS} SELECT * FROM dots")
def u1_isolated_dots(spark, d):
    edge = contour(spark, d)
    return runs.isolated_dots(runs.horizontal_runs(edge), runs.vertical_runs(edge))


@query(f"{RUNS} SELECT * FROM runs")
def u2_all_runs(spark, d):
    return runs.runs_of(contour(spark, d))


@query(f"""{ELINES} SELECT * FROM ct ANTI JOIN (SELECT {T}, CASE WHEN y1 = y2 THEN y1 ELSE y1 + p END AS row, CASE WHEN x1 = x2 THEN x1 ELSE x1 + p END AS col FROM (SELECT *, unnest(range(volume)) AS p FROM el WHERE volume > 2)) USING ({T}, row, col)""")
def u3_residue_pixels(spark, d):
    return strokes.residue(tiles(spark, d), 3)


# Graph


@query(f"{COMPONENTS} SELECT image_id, line_id AS node, component FROM comp WHERE (image_id, line_id) IN (SELECT (image_id, u) FROM sym)")
def g1_connected_components(spark, d):
    return connect.line_components(connect.connect_pairs(colored(spark, d)))


@query(f"{COMPONENTS} SELECT image_id, src, dst, a.component = b.component AS connected FROM cand JOIN comp a USING (image_id) JOIN comp b USING (image_id) WHERE a.line_id = src AND b.line_id = dst")
def g2_same_component(spark, d):
    # A line without links has its own component, so the lines have all that the pairs are asked for.
    grouped = connect.detect_connect(seg(spark, d))
    return grid.grid_candidates(grouped, GRID, out={"connected": lambda a, b: F.col(f"{a}.component") == F.col(f"{b}.component")})


@query(f"{COMPONENTS} SELECT image_id, component, count(*) AS n FROM comp GROUP BY image_id, component")
def g3_component_sizes(spark, d):
    return connect.component_sizes(connect.detect_connect(seg(spark, d)))


# Scalar functions, on pairs of lines that share a cell neighbourhood


def line_pairs(spark, d, **out):
    return grid.grid_candidates(colored(spark, d), GRID, out={c: lambda a, b, of=of: of(geo.segment(a), geo.segment(b)) for c, of in out.items()})


@query(f"""{PAIRS}, s AS (SELECT *, {SLOPE.format("a")} AS sa, {SLOPE.format("b")} AS sb FROM both_l), m AS (SELECT *, CASE WHEN isinf(sa) THEN 99999999999 ELSE sa END AS m1, CASE WHEN isinf(sb) THEN 99999999999 ELSE sb END AS m2 FROM s)
SELECT image_id, src, dst, round(sa, 4) AS slope, round(CASE WHEN isinf(sa) THEN sa ELSE ay1 - sa * ax1 END, 4) AS intercept, round({ANGLE}, 4) AS angle, NOT {APART} AS overlap, round(sqrt(((ax2 - ax1) ** 2 + (ay2 - ay1) ** 2)::DOUBLE), 4) AS length,
  (ax2 - ax1) * (by1 - ay1) - (ay2 - ay1) * (bx1 - ax1) AS cross_product FROM m""")
def h_lines(spark, d):
    return line_pairs(
        spark, d, slope=lambda a, b: F.round(geo.slope(a), 4), intercept=lambda a, b: F.round(geo.intercept(a), 4), angle=lambda a, b: F.round(geo.angle_between(a, b), 4),
        overlap=geo.boxes_overlap, length=lambda a, b: F.round(geo.length(a), 4), cross_product=lambda a, b: geo.cross_product(a[0], a[1], a[2], a[3], b[0], b[1]),
    )


@query(f"""{PAIRS}, t AS (SELECT *, (bx2 - bx1)::DOUBLE AS dx, (by2 - by1)::DOUBLE AS dy FROM both_l), u AS (SELECT *, least(greatest(coalesce(((ax1 - bx1) * dx + (ay1 - by1) * dy) / nullif(dx * dx + dy * dy, 0), 0), 0), 1) AS t FROM t),
x AS (SELECT *, (ax1 - ax2) * (by1 - by2) - (bx1 - bx2) * (ay1 - ay2) AS den FROM u)
SELECT image_id, src, dst, round(sqrt((ax1 - (bx1 + t * dx)) ** 2 + (ay1 - (by1 + t * dy)) ** 2), 4) AS distance,
  den <> 0 AND sign((ax2 - ax1) * (by1 - ay1) - (ay2 - ay1) * (bx1 - ax1)) * sign((ax2 - ax1) * (by2 - ay1) - (ay2 - ay1) * (bx2 - ax1)) <= 0
  AND sign((bx2 - bx1) * (ay1 - by1) - (by2 - by1) * (ax1 - bx1)) * sign((bx2 - bx1) * (ay2 - by1) - (by2 - by1) * (ax2 - bx1)) <= 0 AS crossing FROM x""")
def h_points(spark, d):
    return line_pairs(spark, d, distance=lambda a, b: F.round(geo.point_segment_distance(a[0], a[1], b), 4), crossing=geo.segments_cross)


@query(f"{LINKED} SELECT {T}, src, dst, turned FROM attr")
def h9_same_orientation(spark, d):
    return linked(spark, d).select(*TILE, "src", "dst", geo.same_orientation(F.col("a.k1"), F.col("a.k2"), F.col("b.k1"), F.col("b.k2")).alias("turned"))


@query(f"{RUNS} SELECT {T}, r1, c1, r2, c2, rgb, c2 - c1 AS k1, r2 - r1 AS k2, greatest(c2 - c1, r2 - r1) + 1 AS volume, CASE WHEN r1 = r2 AND c1 = c2 THEN 'dot' ELSE 'line' END AS kind FROM runs")
def h10_run_attributes(spark, d):
    edge = contour(spark, d)
    found = runs.run_attributes(runs.runs_of(edge))
    return found.select(*TILE, "r1", "c1", "r2", "c2", "rgb", "k1", "k2", "volume", "kind")


CHANNELS = "ch AS (SELECT image_id, row, col, unnest([0, 1, 2]) AS channel, unnest([rgb >> 16, (rgb >> 8) & 255, rgb & 255]) AS v FROM pix)"


def channel_values(spark, d):
    a, b, c = runs.channels(F.col("rgb"))
    return fixtures.pixels(spark, d).select("image_id", "row", "col", F.posexplode(F.array(a, b, c)).alias("channel", "v"))


@query(f"{PIX}, {CHANNELS} SELECT image_id, row, col, CAST(channel AS INT) AS channel, round((v / 255.0::DOUBLE - ([0.485, 0.456, 0.406])[channel + 1]::DOUBLE) / ([0.229, 0.224, 0.225])[channel + 1]::DOUBLE, 4) AS value FROM ch")
def h11_to_unit_normalize(spark, d):
    return channel_values(spark, d).select("image_id", "row", "col", "channel", F.round(images.to_unit_normalize(F.col("v"), F.col("channel")), 4).alias("value"))


@query(f"{CELLS} SELECT image_id, line_id, i0, j0, i1, j1 FROM e0")
def h12_clamp_to_grid(spark, d):
    rows = colored(spark, d)
    rows = rows.join(grid.grid_shape(rows, GRID), "image_id")
    at = lambda v, n, out: grid.cell_of(F.col(v), F.col(n), GRID).alias(out)
    return rows.select("image_id", "line_id", at("x1", "grid_x", "i0"), at("y1", "grid_y", "j0"), at("x2", "grid_x", "i1"), at("y2", "grid_y", "j1"))


@query(f"{LOGITS} SELECT vec_id AS image_id, round({CE}, 4) AS loss, round(exp(logits[1] - list_max(logits)) / list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))), 4) AS first FROM ls")
def h13_softmax_cross_entropy(spark, d):
    rows = logits(spark, d)
    return rows.select("image_id", F.round(scoring.cross_entropy(F.col("logits"), F.col("label")), 4).alias("loss"), F.round(scoring.softmax(F.col("logits"))[0], 4).alias("first"))


# Image classification


@query(f"{PIX} SELECT image_id, (row // 16) * 8 + col // 16 AS patch_id, list(rgb ORDER BY row % 16 * 16 + col % 16) AS values FROM pix GROUP BY ALL")
def m1_patchify(spark, d):
    return images.patchify(fixtures.pixels(spark, d).withColumnRenamed("rgb", "v"), 128)


@query("WITH v AS (SELECT label AS image_id, unnest(embedding) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS dim FROM embeddings) SELECT CAST(image_id AS BIGINT) AS image_id, dim, round(avg(v::DOUBLE), 4) AS value FROM v GROUP BY ALL")
def m2_mean_pool(spark, d):
    tokens = read(spark, d, "embeddings").select(F.col("label").cast("long").alias("image_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return scoring.mean_pool(tokens).withColumn("value", F.round("value", 4))


@query("""WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), w AS (SELECT label AS class, dim, avg(v) AS w FROM v GROUP BY ALL),
n AS (SELECT vec_id, dim, (v - avg(v) OVER (PARTITION BY vec_id)) / sqrt(var_pop(v) OVER (PARTITION BY vec_id) + 1e-5) AS v FROM v)
SELECT vec_id AS image_id, CAST(class AS INT) AS class, round(sum(n.v * w.w), 3) + 0.0 AS logit FROM n JOIN w USING (dim) GROUP BY ALL""")
def m3_linear_head(spark, d):
    vectors = read(spark, d, "embeddings")
    values = vectors.select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("dim", "v")).select("image_id", "dim", F.col("v").cast("double").alias("value"))
    scored = scoring.linear_head(scoring.layer_norm(values), class_weights(vectors))
    return scored.select("image_id", F.col("class").cast("int").alias("class"), F.round("logit", 3).alias("logit"))


#: Scaled by 16 each way, a value is the mean of the four pixels in the middle of its square.
SMALL = f"""{PIX}, dark AS (SELECT image_id, row // 16 AS r, col // 16 AS c, sum(255 - (rgb >> 16)) AS d0, sum(255 - ((rgb >> 8) & 255)) AS d1, sum(255 - (rgb & 255)) AS d2 FROM pix WHERE row % 16 IN (7, 8) AND col % 16 IN (7, 8) GROUP BY ALL),
grid AS (SELECT image_id, i.r, j.c, channel FROM (SELECT DISTINCT image_id FROM pix), (SELECT unnest(range(8)) AS r) i, (SELECT unnest(range(8)) AS c) j, (SELECT unnest(range(3)) AS channel) k),
small AS (SELECT image_id, ((r * 8 + c) * 3 + channel)::INT AS place, 255 - coalesce(CASE channel WHEN 0 THEN d0 WHEN 1 THEN d1 ELSE d2 END, 0)::DOUBLE / 4 AS value FROM grid LEFT JOIN dark USING (image_id, r, c))"""


@query(f"{SMALL} SELECT * FROM small")
def m4_resize_images(spark, d):
    return images.resize_images(drawings(spark, d), SIDE // 16, whole_numbers=False).select("image_id", F.posexplode(F.col("values").cast("array<double>")).alias("place", "value"))


def light_and_dark(values):
    """Logits of two classes: how much light an image has, and how much is missing."""
    light = values.astype("float64").sum(axis=1)
    return np.stack([light, 255.0 * values.shape[1] - light], axis=1)


@query(f"{SMALL}, light AS (SELECT image_id, sum(value) AS v FROM small GROUP BY image_id) SELECT image_id, CASE WHEN v >= 48960 - v THEN 0 ELSE 1 END AS label, greatest(v, 48960 - v) AS score FROM light")
def m5_score_images(spark, d):
    scored = scoring.score_images(images.resize_images(drawings(spark, d), SIDE // 16, whole_numbers=False), light_and_dark)
    return scored.select("image_id", F.col("label").cast("int").alias("label"), "score")


@query(f"""{LOGITS}, b AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS batch, {CE} AS loss, list_position(logits, list_max(logits)) - 1 = label AS ok FROM ls), p AS (SELECT batch, avg(loss) AS loss, sum(ok::INT) AS k, count(*) AS n FROM b GROUP BY batch)
SELECT round(avg(loss), 4) AS loss, round(sum(k) * 100.0::DOUBLE / sum(n), 4) AS accuracy, CAST(sum(n) AS BIGINT) AS n FROM p""")
def m6_evaluate(spark, d):
    return jobs.evaluate(logits(spark, d), batch=32).select(F.round("loss", 4).alias("loss"), F.round(F.col("accuracy").cast("double"), 4).alias("accuracy"), "n")


# Jobs


@query(f"{ELINES} SELECT {ELINE} FROM el")
def extract_elines(spark, d):
    return elines(spark, d)


@query(f"{IN_TILES} SELECT {T}, rgb, x1, y1, x2, y2 FROM found")
def j2_detect_lines_in_tiles(spark, d):
    return lines.detect_lines_in_tiles(tiles(spark, d), PARAMS)


@query(f"""{IN_TILES}, in_groups AS (SELECT {TS.format("n")}, n.eline_id, n.line_id, p.pass FROM num n JOIN grp p ON {on("n", "p")} AND n.eline_id = p.eline_id),
left_over AS (SELECT {TS.format("a")}, a.eline_id, j.line_id FROM alone a LEFT JOIN joined j ON {on("a", "j")} AND a.eline_id = j.eline_id)
SELECT {TS.format("g")}, eline_id, pass, component AS line_id FROM in_groups g JOIN c3 ON {on("g", "c3")} AND g.line_id = c3.line_id
UNION ALL SELECT {TS.format("g")}, eline_id, 0, component FROM left_over g LEFT JOIN c3 ON {on("g", "c3")} AND g.line_id = c3.line_id""")
def j2_strokes_of_lines(spark, d):
    """Which strokes each line in a tile is made of: by the pass that grouped them, or 0 for leftovers, with the line that they joined or null."""
    return lines.detect_in_tiles(tiles(spark, d), PARAMS).members


@query(f"{DETECTED} SELECT image_id, line_id, rgb, x1, y1, x2, y2 FROM merged")
def detect_lines(spark, d):
    return lines.detect_lines(fixtures.pixels(spark, d), PARAMS)


@query(f"""{DETECTED}, beside AS (SELECT a.image_id, a.line_id AS src, b.line_id AS dst, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2 FROM merged a JOIN merged b ON a.image_id = b.image_id AND a.rgb = b.rgb AND a.line_id < b.line_id),
touching AS (SELECT image_id, src, dst FROM beside WHERE {NEAR}), {reach_sql("grouped", "merged", "line_id", "touching", ["image_id"])}
SELECT image_id || '.png(None, None)' AS key, line_id, x1, y1, x2, y2, rgb, component, 0 AS computed FROM merged JOIN grouped USING (image_id, line_id)""")
def j7_detect_files(spark, d):
    """Lines and groups of image files, as a second call finds them that has nothing left to compute."""
    files = drawings(spark, d).select("path", *[F.lit(None).cast("int").alias(c) for c in ("r0", "r1", "c0", "c1")], F.lit(False).alias("forced"))
    folder = scratch(spark, "results")
    jobs.detect_files(files, folder, PARAMS)
    _, groups, todo = jobs.detect_files(files, folder, PARAMS)
    return groups.select("key", "line_id", "x1", "y1", "x2", "y2", "rgb", "component", F.lit(todo.count()).cast("int").alias("computed"))


#: Sums of the normalised values of each channel.
SUMS = f"{SMALL}, v AS (SELECT image_id, (place % 3)::INT AS channel, sum((round_even(value, 0) / 255.0::DOUBLE - ([0.485, 0.456, 0.406])[place % 3 + 1]::DOUBLE) / ([0.229, 0.224, 0.225])[place % 3 + 1]::DOUBLE) AS v FROM small GROUP BY ALL)"


def class_folders(spark, d):
    """The drawings as image files in three folders."""
    folder, pixels = scratch(spark, "classes"), fixtures.pixels(spark, d)
    for k in range(3):
        fixtures.write_images(pixels.where(F.col("image_id") % 3 == k), f"{folder}/class-{k}", SIDE, SIDE)
    return folder


@query(f"""{SUMS}, l AS (SELECT image_id, list(v ORDER BY channel) AS logits, (image_id % 3)::INT AS label FROM v GROUP BY image_id), e AS (SELECT {CE} AS loss, list_position(logits, list_max(logits)) - 1 = label AS ok FROM l)
SELECT round(avg(loss), 4) AS loss, round(sum(ok::INT) * 100.0::DOUBLE / count(*), 4) AS accuracy, count(*) AS n FROM e""")
def m6_evaluate_folder(spark, d):
    """Loss and accuracy over a folder of classes, all images in one batch."""
    found = jobs.evaluate_folder(spark, class_folders(spark, d), channel_sums, SIDE // 16, batch=1 << 40)
    return found.select(F.round("loss", 4).alias("loss"), F.round(F.col("accuracy").cast("double"), 4).alias("accuracy"), "n")


def channel_sums(values):
    """Logits of three classes: the sum of each channel."""
    return values.astype("float64").reshape(len(values), -1, 3).sum(axis=1)


@query(f"""{SUMS}, best AS (SELECT image_id, arg_max(channel, v) AS prediction, max(v) AS score FROM v GROUP BY image_id), n AS (SELECT count(*) AS n FROM best)
SELECT image_id, 'class-' || image_id % 3 AS class_name, (image_id % 3)::INT AS label, prediction, round(score, 4) AS score, n * 8 // 10 AS n_training FROM best, n""")
def j8_classify_folder(spark, d):
    """Classes, split and scores of a folder with a folder for each class."""
    found, _ = jobs.classify_folder(spark, class_folders(spark, d), channel_sums, SIDE // 16)
    found = written(found, "classified")
    image = F.regexp_extract("path", "([0-9]+)[.]png$", 1).cast("long")
    return found.select(image.alias("image_id"), "class_name", "label", F.col("prediction").cast("int").alias("prediction"), F.round("score", 4).alias("score"), F.lit(found.where("training").count()).cast("long").alias("n_training"))


@query(f"{COMPONENTS} SELECT image_id, line_id, x1, y1, x2, y2, rgb, component FROM comp JOIN col USING (image_id, line_id)")
def detect_connect(spark, d):
    return connect.detect_connect(seg(spark, d)).select("image_id", "line_id", "x1", "y1", "x2", "y2", "rgb", "component")


@query(f"{PAIRS} SELECT image_id, src, dst FROM both_l WHERE {NEAR}")
def detect_pairs(spark, d):
    return connect.detect_pairs(colored(spark, d), lambda a, b: geo.connected(geo.segment(a), geo.segment(b), EPS))


@query(f"{LOGITS}, p AS (SELECT vec_id, label, list_position(logits, list_max(logits)) - 1 AS p FROM ls) SELECT CAST(label AS INT) AS label, count(*) AS n, CAST(sum((p = label)::INT) AS BIGINT) AS correct FROM p GROUP BY label")
def evaluate_by_label(spark, d):
    rows = scoring.top1(logits(spark, d))
    return rows.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"), F.sum((F.col("prediction") == F.col("label")).cast("long")).alias("correct"))
