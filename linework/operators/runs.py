"""From ink pixels to strokes: contours, same-colour runs, and their attributes, tile by tile.

Windows and groups are all keyed by (image_id, tile_r, tile_c) and more, so after
one repartition by tile they add no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.schema import TILE


def channels(rgb: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(rgb, 16).bitwiseAND(255), F.shiftright(rgb, 8).bitwiseAND(255), rgb.bitwiseAND(255)


def nonwhite(pixels: DataFrame) -> DataFrame:
    """Pixels whose channels add up to 762 at most."""
    a, b, c = channels(F.col("rgb"))
    return pixels.where(a + b + c <= 762)


def is_ink(rgb: Column) -> Column:
    """Grey value of 245 at most; the first channel weighs 0.114."""
    a, b, c = channels(rgb)
    return 114 * a + 587 * b + 299 * c < 245500


def ink_mask(pixels: DataFrame) -> DataFrame:
    return pixels.where(is_ink(F.col("rgb")))


def assign_tiles(pixels: DataFrame, tile: int) -> DataFrame:
    """Tile numbers, and row and col within the tile."""
    whole = lambda c: F.floor(F.col(c) / F.lit(tile)).cast("long")
    return pixels.select("image_id", whole("row").alias("tile_r"), whole("col").alias("tile_c"), (F.col("row") % tile).alias("row"), (F.col("col") % tile).alias("col"), "rgb")


def crop_roi(pixels: DataFrame, r0: int | None = None, r1: int | None = None, c0: int | None = None, c1: int | None = None) -> DataFrame:
    """Rows r0 to r1 - 1 and columns c0 to c1 - 1, counted from 0 again; None is no limit."""
    for c, low, high in (("row", r0, r1), ("col", c0, c1)):
        if low is not None:
            pixels = pixels.where(F.col(c) >= low)
        if high is not None:
            pixels = pixels.where(F.col(c) < high)
    return pixels.withColumns({"row": F.col("row") - (r0 or 0), "col": F.col("col") - (c0 or 0)})


def contour_pixels(pixels: DataFrame) -> DataFrame:
    """Pixels with a neighbour (up, down, left, right) that is absent or of another colour."""
    row, col = Window.partitionBy(*TILE, "row").orderBy("col"), Window.partitionBy(*TILE, "col").orderBy("row")

    def same(w, c: str, step: int) -> Column:
        return F.coalesce((F.lag(c, step).over(w) == F.col(c) - step) & (F.lag("rgb", step).over(w) == F.col("rgb")), F.lit(False))

    marked = pixels.withColumn("h__", same(row, "col", 1) & same(row, "col", -1)).withColumn("v__", same(col, "row", 1) & same(col, "row", -1))
    return marked.where(~(F.col("h__") & F.col("v__"))).drop("h__", "v__")


def _runs(pixels: DataFrame, fixed: str, along: str) -> DataFrame:
    w = Window.partitionBy(*TILE, fixed, "rgb").orderBy(along)
    islands = pixels.withColumn("island", F.col(along) - F.row_number().over(w))
    return islands.groupBy(*TILE, fixed, "rgb", "island").agg(F.min(along).alias("a"), F.max(along).alias("b"))


def horizontal_runs(pixels: DataFrame) -> DataFrame:
    """(tile, r1, c1, r2, c2, rgb): longest runs of one colour along a row, single pixels included."""
    return _runs(pixels, "row", "col").select(*TILE, F.col("row").alias("r1"), F.col("a").alias("c1"), F.col("row").alias("r2"), F.col("b").alias("c2"), "rgb")


def vertical_runs(pixels: DataFrame) -> DataFrame:
    return _runs(pixels, "col", "row").select(*TILE, F.col("a").alias("r1"), F.col("col").alias("c1"), F.col("b").alias("r2"), F.col("col").alias("c2"), "rgb")


def isolated_dots(horizontal: DataFrame, vertical: DataFrame) -> DataFrame:
    """Runs of one pixel in both directions."""
    single = "r1 = r2 AND c1 = c2"
    return horizontal.where(single).intersect(vertical.where(single))


def all_runs(horizontal: DataFrame, vertical: DataFrame) -> DataFrame:
    """Vertical and horizontal runs of two pixels or more, and isolated dots; rank is 0, 1 or 2."""
    long = "NOT (r1 = r2 AND c1 = c2)"
    parts = [vertical.where(long), horizontal.where(long), isolated_dots(horizontal, vertical)]
    parts = [p.withColumn("rank", F.lit(k)) for k, p in enumerate(parts)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def runs_of(pixels: DataFrame) -> DataFrame:
    """all_runs of the pixels' horizontal and vertical runs, from one pass over the pixels.

    A pixel stands in its column and in its row; a run of one pixel in both is met twice.
    """
    ways = F.expr("explode(array(struct(0 AS rank, col AS fixed, row AS along), struct(1 AS rank, row AS fixed, col AS along)))")
    stood = pixels.select(*TILE, "rgb", ways.alias("w__")).select(*TILE, "rgb", "w__.*")
    islands = stood.withColumn("island", F.col("along") - F.row_number().over(Window.partitionBy(*TILE, "rank", "fixed", "rgb").orderBy("along")))
    found = islands.groupBy(*TILE, "rank", "fixed", "rgb", "island").agg(F.min("along").alias("a"), F.max("along").alias("b"))
    at = lambda end: (F.expr(f"CASE WHEN rank = 0 THEN {end} ELSE fixed END"), F.expr(f"CASE WHEN rank = 0 THEN fixed ELSE {end} END"))
    (r1, c1), (r2, c2) = at("a"), at("b")
    found = found.select(*TILE, r1.alias("r1"), c1.alias("c1"), r2.alias("r2"), c2.alias("c2"), "rgb", "rank")
    met = found.groupBy(*TILE, "r1", "c1", "r2", "c2", "rgb").agg(F.count("*").alias("n"), F.min("rank").alias("rank"))
    long = "NOT (r1 = r2 AND c1 = c2)"
    return met.where(f"{long} OR n = 2").select(*TILE, "r1", "c1", "r2", "c2", "rgb", F.expr(f"CASE WHEN {long} THEN rank ELSE 2 END").alias("rank"))


def dominant_color(runs: DataFrame, pixels: DataFrame) -> DataFrame:
    """runs (r1, c1, r2, c2) with the most frequent colour of their pixels, the first met of equals."""
    cells = runs.withColumn("p__", F.explode(F.expr("sequence(0L, greatest(r2 - r1, c2 - c1))")))
    cells = cells.withColumns({"row": F.expr("r1 + least(p__, r2 - r1)"), "col": F.expr("c1 + least(p__, c2 - c1)")})
    counted = cells.join(pixels.select(*TILE, "row", "col", F.col("rgb").alias("p_rgb")), [*TILE, "row", "col"])
    counted = counted.groupBy(*TILE, "r1", "c1", "r2", "c2", "p_rgb").agg(F.count("*").alias("n"), F.min("p__").alias("first"))
    return counted.groupBy(*TILE, "r1", "c1", "r2", "c2").agg(F.max_by("p_rgb", F.struct("n", -F.col("first"))).alias("rgb"))


def run_attributes(runs: DataFrame) -> DataFrame:
    """Ends as x = col and y = row, k1 = dx, k2 = dy, volume in pixels, and kind."""
    out = runs.withColumns({"x1": F.col("c1"), "y1": F.col("r1"), "x2": F.col("c2"), "y2": F.col("r2"), "k1": F.expr("c2 - c1"), "k2": F.expr("r2 - r1")})
    return out.withColumns({"volume": F.expr("greatest(abs(k1), abs(k2)) + 1"), "kind": F.expr("CASE WHEN k1 = 0 AND k2 = 0 THEN 'dot' ELSE 'line' END")})


def diagonal_touch(runs: DataFrame, contour: DataFrame) -> DataFrame:
    """runs with dir_pos and dir_neg: whether a pixel of the colour touches a corner on the falling or the rising diagonal."""
    corners = F.expr("array(struct(r1 - 1 AS row, c1 - 1 AS col, true AS pos), struct(r2 + 1 AS row, c2 + 1 AS col, true AS pos), struct(r2 + 1 AS row, c1 - 1 AS col, false AS pos), struct(r1 - 1 AS row, c2 + 1 AS col, false AS pos))")
    own = [*TILE, "r1", "c1", "r2", "c2", "rgb", "rank"]
    spread = runs.select(*own, F.explode(corners).alias("k")).select(*own, F.col("k.row").alias("row"), F.col("k.col").alias("col"), F.col("k.pos").alias("pos"))
    # Merge joins here and below: what a plan expects of exploded rows is too little to broadcast by.
    hits = spread.join(contour.select(*TILE, "row", "col", "rgb", F.lit(True).alias("hit")).hint("merge"), [*TILE, "row", "col", "rgb"], "left")
    touch = lambda side: F.coalesce(F.bool_or(F.col("hit") & (F.col("pos") == F.lit(side))), F.lit(False))
    return hits.groupBy(*own).agg(touch(True).alias("dir_pos"), touch(False).alias("dir_neg"))


def split_both_ways(runs: DataFrame) -> DataFrame:
    """A run with both diagonal flags becomes two runs of one each."""
    copies = F.when(F.col("dir_pos") & F.col("dir_neg"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(-1)))
    out = runs.withColumn("copy", F.explode(copies))
    return out.withColumns({"dir_pos": F.when(F.col("copy") == 1, F.lit(False)).otherwise(F.col("dir_pos")), "dir_neg": F.when(F.col("copy") == 0, F.lit(False)).otherwise(F.col("dir_neg"))})


def number_elines(runs: DataFrame) -> DataFrame:
    """eline_id within the tile: vertical runs by (col, row), horizontal ones by (row, col), dots by (row, col), the dir_pos copy first."""
    major, minor = F.expr("CASE WHEN rank = 0 THEN c1 ELSE r1 END"), F.expr("CASE WHEN rank = 0 THEN r1 ELSE c1 END")
    return runs.withColumn("eline_id", F.row_number().over(Window.partitionBy(*TILE).orderBy("rank", major, minor, "copy")).cast("long") - 1)


ELINE = [*TILE, "eline_id", "kind", "x1", "y1", "x2", "y2", "k1", "k2", "rgb", "volume", "dir_pos", "dir_neg"]


def extract_elines(pixels: DataFrame) -> DataFrame:
    """Strokes of tiled pixels (image_id, tile_r, tile_c, row, col, rgb)."""
    contour = contour_pixels(nonwhite(pixels).repartition(*TILE))
    ink = ink_mask(contour)
    return number_elines(split_both_ways(run_attributes(diagonal_touch(runs_of(ink), contour)))).select(*ELINE)


def lines_to_pixels(elines: DataFrame, interior: bool = False) -> DataFrame:
    """(tile, row, col) of axis-aligned strokes; interior leaves the ends out and strokes of two pixels or fewer altogether."""
    n = F.expr("greatest(abs(x2 - x1), abs(y2 - y1))")
    steps = F.when(n > 1, F.sequence(F.lit(1).cast("long"), n - 1)) if interior else F.sequence(F.lit(0).cast("long"), n)
    rows = elines.where("x1 = x2 OR y1 = y2").withColumn("p__", F.explode(steps))
    return rows.select(*TILE, F.expr("least(y1, y2) + CASE WHEN y1 = y2 THEN 0 ELSE p__ END").alias("row"), F.expr("least(x1, x2) + CASE WHEN x1 = x2 THEN 0 ELSE p__ END").alias("col"))


def residue_pixels(contour: DataFrame, elines: DataFrame) -> DataFrame:
    """Contour pixels that no stroke covers."""
    return contour.join(lines_to_pixels(elines).distinct().hint("merge"), [*TILE, "row", "col"], "left_anti")


def volume_histogram(elines: DataFrame) -> DataFrame:
    return elines.groupBy("image_id", "volume").agg(F.count("*").alias("n"))


def thin_mask(ink: DataFrame) -> DataFrame:
    """Pixels that a 3 x 3 closing of the ink adds; ink is (image_id, row, col) and the image is the box of its ink.

    Dilation spreads each pixel to its nine neighbours in the image; erosion
    keeps a pixel whose neighbours in the image are all set.  Pixels keep whether
    they are ink themselves, so the ink is read once and once for the boxes.
    """
    box = ink.groupBy("image_id").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    near = F.expr(f"explode(array({', '.join(f'struct({dr} AS dr, {dc} AS dc)' for dr in (-1, 0, 1) for dc in (-1, 0, 1))}))")
    limits = ["r0", "r1", "c0", "c1"]

    def spread(df: DataFrame) -> DataFrame:
        """Each pixel's set neighbours by their number n; own: whether it is ink."""
        out = df.select("image_id", "row", "col", "own", *limits, near.alias("o"))
        out = out.select("image_id", F.expr("row + o.dr").alias("row"), F.expr("col + o.dc").alias("col"), F.expr("own AND o.dr = 0 AND o.dc = 0").alias("own"), *limits)
        out = out.where("row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1")
        return out.groupBy("image_id", "row", "col").agg(F.count("*").alias("n"), F.bool_or("own").alias("own"), *[F.min(c).alias(c) for c in limits])

    held = spread(spread(ink.join(box.hint("merge"), "image_id").withColumn("own", F.lit(True))))
    expected = "(least(row + 1, r1) - greatest(row - 1, r0) + 1) * (least(col + 1, c1) - greatest(col - 1, c0) + 1)"
    return held.where(f"n = {expected} AND NOT own").select("image_id", "row", "col")
