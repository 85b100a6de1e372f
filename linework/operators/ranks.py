"""Exact ranks of rows, whatever the distribution of what they are ordered by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.operators.components import written

#: monotonically_increasing_id() has the partition above these bits and the row within it below.
ROW_BITS = 33


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of df has (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def ranked(rows: DataFrame, order: list[Column], keys: tuple[str, ...] = (), out: str = "rank", partitions: int | None = None) -> DataFrame:
    """rows with out: 1, 2, 3 and so on in order, among the rows equal in keys (null keys are equal).

    The rows are cut into ranges of (keys, order) at quantiles that Spark samples, so
    ranges are of like size even if most rows lie in a narrow span of values, and no
    task holds a whole key.  Rows that tie in everything are interchangeable; they are
    cut by the place they were read at, so not even they must fit in one task.  What
    precedes a range is a sum over the ranges of its key.  Rows are written before they
    are dealt, as sampling reads them a second time, and after, which fixes their places.
    """
    part, at, tie, first, before = free_names(rows, "part__", "at__", "tie__", "first__", "before__")
    count = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(rows, "to-rank").withColumn(tie, F.monotonically_increasing_id())
    place = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(count, *keys, *order, tie).sortWithinPartitions(*keys, *order, tie).drop(tie).withColumn(at, place)
    dealt = written(dealt, "ranges").withColumns({part: F.shiftright(at, ROW_BITS), at: F.col(at).bitwiseAND(F.lit((1 << ROW_BITS) - 1))})
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    spans = dealt.groupBy(*keys, part).agg(F.min(at).alias(first), F.count("*").alias(before))
    spans = spans.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    if keys:
        a, b = dealt.alias("a"), spans.alias("b")
        same = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in (*keys, part)]
        placed = a.join(b, same).select("a.*", f"b.{first}", f"b.{before}")
    else:
        # A row for each range, of which there are `partitions`.
        placed = dealt.join(F.broadcast(spans), part)
    return placed.withColumn(out, F.col(at) - F.col(first) + F.col(before) + 1).drop(part, at, first, before)
