"""Grid cells of segments and the candidate pairs that share a cell neighbourhood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.operators.components import written

NEIGHBOURHOODS = {
    "plus": [(0, 0), (0, -1), (1, 0), (0, 1), (-1, 0)],
    "full": [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)],
}


def extent(lines: DataFrame) -> DataFrame:
    """Least and greatest coordinates per image."""
    low, high = F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2"))
    return lines.groupBy("image_id").agg(low.alias("min_x"), F.min(F.least("y1", "y2")).alias("min_y"), high.alias("max_x"), F.max(F.greatest("y1", "y2")).alias("max_y"))


def grid_shape(lines: DataFrame, grid: int) -> DataFrame:
    """Cells per axis and image."""
    up = lambda c: F.ceil(F.col(c) / F.lit(grid)).cast("long")
    return extent(lines).select("image_id", up("max_x").alias("grid_x"), up("max_y").alias("grid_y"))


def cell_of(v: Column, cells: Column, grid: int) -> Column:
    """The cell of a coordinate, limited to the grid."""
    return F.greatest(F.least(F.floor(v / F.lit(grid)), cells - 1), F.lit(0)).cast("long")


def lines_to_cells(lines: DataFrame, grid: int) -> DataFrame:
    """(image_id, cell_r, cell_c, line_id): the cells that a segment runs through.

    The cells are the first one and one for each grid line crossed.  Crossing k
    of a vertical grid line lies at a share a_k / |dx| of the way and crossing m
    of a horizontal one at b_m / |dy|; the cell after a crossing counts the
    crossings of the other axis before it, a tie going to the row first.  As a_k and
    b_m grow by one cell each time, that count is a whole division, so a line costs as
    much as it has cells.
    """
    rows = lines.join(grid_shape(lines, grid), "image_id")
    rows = rows.withColumns({k: cell_of(F.col(v), F.col(n), grid) for k, v, n in (("i0", "x1", "grid_x"), ("i1", "x2", "grid_x"), ("j0", "y1", "grid_y"), ("j1", "y2", "grid_y"))})
    rows = rows.withColumns({"adx": F.expr("abs(x2 - x1)"), "ady": F.expr("abs(y2 - y1)"), "sx": F.expr("CASE WHEN i1 >= i0 THEN 1L ELSE -1L END"), "sy": F.expr("CASE WHEN j1 >= j0 THEN 1L ELSE -1L END")})
    rows = rows.withColumns({"nx": F.expr("abs(i1 - i0)"), "ny": F.expr("abs(j1 - j0)"), "a0": F.expr(f"abs((i0 + CASE WHEN sx > 0 THEN 1 ELSE 0 END) * {grid} - x1)"), "b0": F.expr(f"abs((j0 + CASE WHEN sy > 0 THEN 1 ELSE 0 END) * {grid} - y1)")})
    before_x = f"greatest(0L, least(ny, ((a0 + k * {grid}) * ady - b0 * adx + {grid} * adx) div ({grid} * adx)))"
    before_y = f"greatest(0L, least(nx, ((b0 + m * {grid}) * adx - a0 * ady + {grid} * ady - 1) div ({grid} * ady)))"
    over_x = f"CASE WHEN nx = 0 THEN array() ELSE transform(sequence(0L, nx - 1), k -> struct(i0 + sx * (k + 1) AS i, j0 + sy * {before_x} AS j)) END"
    over_y = f"CASE WHEN ny = 0 THEN array() ELSE transform(sequence(0L, ny - 1), m -> struct(i0 + sx * {before_y} AS i, j0 + sy * (m + 1) AS j)) END"
    rows = rows.withColumn("cell", F.explode(F.expr(f"array_distinct(concat(array(struct(i0 AS i, j0 AS j)), {over_x}, {over_y}))")))
    return rows.select("image_id", F.col("cell.j").alias("cell_r"), F.col("cell.i").alias("cell_c"), "line_id")


def cell_index(cells: DataFrame) -> DataFrame:
    """Lines of each cell and their number."""
    return cells.groupBy("image_id", "cell_r", "cell_c").agg(F.sort_array(F.collect_list("line_id")).alias("lines"), F.count("*").alias("n"))


def cells_overlap(a: Column, b: Column) -> Column:
    """Whether two arrays of cells have one in common."""
    return F.arrays_overlap(a, b)


def line_centres(cells: DataFrame, neighbourhood: str = "plus") -> DataFrame:
    """(image_id, cr, cc, line_id): the occupied cells in whose neighbourhood a line is."""
    offsets = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in NEIGHBOURHOODS[neighbourhood]])
    spread = cells.withColumn("o", F.explode(offsets)).select("image_id", (F.col("cell_r") + F.col("o.dr")).alias("cr"), (F.col("cell_c") + F.col("o.dc")).alias("cc"), "line_id")
    occupied = cells.select("image_id", F.col("cell_r").alias("cr"), F.col("cell_c").alias("cc")).distinct()
    return spread.distinct().join(occupied, ["image_id", "cr", "cc"], "left_semi")


#: A cell of more lines is compared by several tasks, and by finer cells where the pattern has a reach.
CELL_LINES = 2_000
#: Finer cells are so many times narrower, but no narrower than the reach.
FINER = 16


def _side(rows: DataFrame, keys: list[str], blocks: DataFrame | None, own: str, other: str) -> DataFrame:
    """rows dealt for one side of a join of cells with themselves: a row is in one of the blocks of its cell and meets each of the other side's."""
    if blocks is None:
        return rows.withColumns({own: F.lit(0), other: F.lit(0)})
    dealt = rows.join(blocks.hint("merge"), keys, "left").withColumn("k__", F.coalesce("k__", F.lit(1)))
    return dealt.withColumns({own: F.pmod(F.xxhash64("line_id"), F.col("k__")).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col("k__") - 1))}).drop("k__")


def _blocks(rows: DataFrame, keys: list[str], bound: int) -> DataFrame | None:
    """(keys, k__): how many blocks the cells of more than bound lines are cut in; None without such cells."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n__")).where(F.col("n__") > bound)
    full = written(counted.select(*keys, F.ceil(F.col("n__") / F.lit(bound)).cast("int").alias("k__")), "full-cells")
    return None if full.isEmpty() else full


def _met(left: DataFrame, right: DataFrame, keys: list[str], blocks: DataFrame | None, pattern, out: dict) -> DataFrame:
    """(image_id, src, dst, out), src < dst, of rows of a shared cell for which pattern holds, as often as they meet; each pair of blocks of a cell is a key of its own."""
    a, b = _side(left, keys, blocks, "ca", "cb").alias("a"), _side(right, keys, blocks, "cb", "ca").alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*keys, "ca", "cb")]
    pairs = a.join(b, [*on, F.col("a.line_id") < F.col("b.line_id")]).where(pattern("a", "b"))
    return pairs.select(F.col("a.image_id").alias("image_id"), F.col("a.line_id").alias("src"), F.col("b.line_id").alias("dst"), *[of("a", "b").alias(c) for c, of in out.items()])


def _meeting(left: DataFrame, right: DataFrame, keys: list[str], blocks: DataFrame | None, pattern) -> DataFrame:
    """_met(), each pair once."""
    return _met(left, right, keys, blocks, pattern, {}).distinct()


#: Lines whose centres are in a square of so many cells tell by a mask where they meet first.
SPAN = 5


def _earlier(centres: DataFrame) -> DataFrame:
    """centres (image_id, cr, cc, line_id) with earlier__, a bit for each of the line's centres before this one by place, and wide__: whether the line's do not fit in SPAN.

    Two lines that are not wide share a centre before this one if their masks have a bit in common.
    """
    own = Window.partitionBy("image_id", "line_id")
    wide = " OR ".join(f"max({c}) OVER w - min({c}) OVER w >= {SPAN}" for c in ("cr", "cc")).replace("OVER w", "OVER (PARTITION BY image_id, line_id)")
    rows = centres.withColumn("wide__", F.expr(wide)).withColumn("all__", F.when(~F.col("wide__"), F.collect_list(F.struct("cr", "cc")).over(own)))
    bit = f"shiftleft(1L, CAST((cr - o.cr) * {2 * SPAN - 1} + o.cc - cc + {SPAN - 1} AS INT))"
    before = "o.cr < cr OR o.cr = cr AND o.cc < cc"
    return rows.withColumn("earlier__", F.expr(f"aggregate(all__, 0L, (m, o) -> CASE WHEN {before} THEN m | {bit} ELSE m END)")).drop("all__")


def _each_once(keyed: DataFrame, keys: list[str], blocks: DataFrame | None, pattern, out: dict) -> DataFrame:
    """_met() of rows with themselves, each pair once: where the two meet first, or by distinct pairs where a line is wide."""
    first = lambda a, b: (F.col(f"{a}.earlier__").bitwiseAND(F.col(f"{b}.earlier__")) == 0) & pattern(a, b)
    wide, narrow = keyed.where("wide__"), keyed.where("NOT wide__")
    found = _met(narrow, narrow, keys, blocks, first, out)
    if wide.isEmpty():
        return found
    more = [_met(*sides, keys, blocks, pattern, out) for sides in ((wide, keyed), (narrow, wide))]
    return found.unionByName(more[0].unionByName(more[1]).distinct())


def _close_pairs(lines: DataFrame, side: int, pattern, equal: tuple[str, ...]) -> DataFrame:
    """Pairs for which pattern holds among lines no farther apart than side: they run through the same or neighbouring cells of that side."""
    cells = written(lines_to_cells(lines, side).join(lines, ["image_id", "line_id"]), "fine-cells")
    near = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in NEIGHBOURHOODS["full"]])
    around = cells.withColumn("o__", F.explode(near)).withColumns({"cell_r": F.col("cell_r") + F.col("o__.dr"), "cell_c": F.col("cell_c") + F.col("o__.dc")}).drop("o__").distinct()
    keys = ["image_id", "cell_r", "cell_c", *equal]
    return _meeting(cells, around, keys, _blocks(around, keys, CELL_LINES), pattern)


def pair_join(lines: DataFrame, grid: int, pattern, neighbourhood: str = "plus", equal: tuple[str, ...] = (), reach: int | None = None, out: dict | None = None) -> DataFrame:
    """(image_id, src, dst) with src < dst: pairs sharing a cell neighbourhood for which pattern holds.

    pattern takes the aliases of the two sides and returns a Column.  Columns in
    equal must be the same on both sides and are part of the join key.  A pair that meets in
    several cells counts where it meets first; only pairs of lines through many cells
    are made distinct.  out has further columns by name, functions of the two aliases as
    pattern is (without a reach only).

    Cells of more than CELL_LINES lines have other ways with the same outcome.  With a
    reach, the most that lines can be apart where pattern holds, their lines are
    compared by finer cells, and a pair counts if both share such a cell's
    neighbourhood.  Without one, and where finer cells are too full as well, a cell's
    lines are cut in blocks, and each two blocks are a key of their own.
    """
    if reach is not None and out:
        raise ValueError("columns of pairs need a join without reach")
    out = out or {}
    centres = _earlier(line_centres(lines_to_cells(lines, grid), neighbourhood))
    keyed = written(centres.join(lines, ["image_id", "line_id"]), "centres")
    keys = ["image_id", "cr", "cc", *equal]
    full = _blocks(keyed, keys, CELL_LINES)
    if full is None or reach is None:
        return _each_once(keyed, keys, full, pattern, out)
    light = keyed.join(full.hint("merge"), keys, "left_anti")
    dense = written(keyed.join(full.drop("k__").hint("merge"), keys), "dense")
    close = _close_pairs(dense.select(*lines.columns).distinct(), max(reach, grid // FINER), pattern, equal)
    of = lambda c: dense.select("image_id", "cr", "cc", F.col("line_id").alias(c))
    shared = close.join(of("src"), ["image_id", "src"]).join(of("dst"), ["image_id", "dst", "cr", "cc"], "left_semi").select("image_id", "src", "dst")
    return _meeting(light, light, keys, None, pattern).unionByName(shared).distinct()


def grid_candidates(lines: DataFrame, grid: int, neighbourhood: str = "plus", out: dict | None = None) -> DataFrame:
    """All pairs of lines that share a cell neighbourhood; out as for pair_join()."""
    return pair_join(lines, grid, lambda a, b: F.lit(True), neighbourhood, out=out)
