"""Connected groups of line segments."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.functions.geometry import connected, segment
from linework.operators.components import connected_components
from linework.operators.grid import pair_join
from linework.params import DEFAULTS, Params


def with_rgb(lines: DataFrame) -> DataFrame:
    return lines if "rgb" in lines.columns else lines.withColumn("rgb", F.expr("r * 65536 + g * 256 + b"))


def drop_black_lines(lines: DataFrame) -> DataFrame:
    """Lines of any colour but black: frames and notes in black link nearly everything."""
    return lines.where(F.col("rgb") != 0) if "rgb" in lines.columns else lines.where("NOT (r = 0 AND g = 0 AND b = 0)")


def connect_pairs(lines: DataFrame, params: Params = DEFAULTS, ends: bool = True, middles: bool = True, crossing: bool = False, colour: bool = True, neighbourhood: str = "plus") -> DataFrame:
    """(image_id, src, dst): pairs of lines that connect."""
    rule = lambda a, b: connected(segment(a), segment(b), params.connect_eps, ends, middles, crossing)
    return pair_join(with_rgb(lines), params.grid, rule, neighbourhood, ("rgb",) if colour else (), max(1, math.ceil(params.connect_eps)))


def line_components(edges: DataFrame) -> DataFrame:
    """(image_id, node, component) of edges (image_id, src, dst)."""
    ends = edges.select(F.struct("image_id", F.col("src").alias("n")).alias("src"), F.struct("image_id", F.col("dst").alias("n")).alias("dst"))
    found = connected_components(ends)
    return found.select("node.image_id", F.col("node.n").alias("node"), F.col("component.n").alias("component"))


def with_components(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """lines with component, the least line_id that links lead to; a line without links is its own."""
    found = line_components(edges).withColumnRenamed("node", "line_id")
    return lines.join(found, ["image_id", "line_id"], "left").withColumn("component", F.coalesce("component", "line_id"))


def detect_connect(lines: DataFrame, params: Params = DEFAULTS, drop_black: bool = True, neighbourhood: str = "plus") -> DataFrame:
    """lines with component: same colour, and an end nearer than eps to the other segment."""
    lines = drop_black_lines(lines) if drop_black else lines
    return with_components(lines, connect_pairs(lines, params, neighbourhood=neighbourhood))


def group_members(grouped: DataFrame) -> DataFrame:
    """(image_id, component, n, lines): the members of each group in the order of their ids."""
    return grouped.groupBy("image_id", "component").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("line_id")).alias("lines"))


def detect_pairs(lines: DataFrame, pattern, params: Params = DEFAULTS, neighbourhood: str = "plus", reach: int | None = None) -> DataFrame:
    """Pairs for which the caller's pattern holds; reach as for pair_join()."""
    return pair_join(lines, params.grid, pattern, neighbourhood, reach=reach)


def neighbor_lists(edges: DataFrame) -> DataFrame:
    """(image_id, node, neighbours, degree), links taken both ways."""
    both = edges.select("image_id", F.col("src").alias("node"), F.col("dst").alias("other"))
    both = both.unionByName(edges.select("image_id", F.col("dst").alias("node"), F.col("src").alias("other"))).distinct()
    return both.groupBy("image_id", "node").agg(F.sort_array(F.collect_list("other")).alias("neighbours"), F.count("*").alias("degree"))


def same_component(pairs: DataFrame, grouped: DataFrame) -> DataFrame:
    """pairs (image_id, src, dst) with connected: whether both are in one component."""
    of = grouped.select("image_id", "line_id", "component")
    a = of.select("image_id", F.col("line_id").alias("src"), F.col("component").alias("ca"))
    b = of.select("image_id", F.col("line_id").alias("dst"), F.col("component").alias("cb"))
    return pairs.join(a, ["image_id", "src"]).join(b, ["image_id", "dst"]).withColumn("connected", F.col("ca") == F.col("cb")).drop("ca", "cb")


def component_sizes(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("image_id", "component").agg(F.count("*").alias("n"))
