"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linework.operators.components import shared_dir, written  # noqa: F401
from linework.sources.files import local_fs  # noqa: F401

#: A run of characters that are neither the blank nor \t \n \v \f \r.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch of rows between the JVM and a Python worker.  Spark's own bound, 64 MB, is held several times over by each task and stays with its worker.
BATCH_BYTES = 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on batches of this session have BATCH_BYTES or one row more at most, unless the session has a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or with underscores until no column of df has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def hidden(df: DataFrame) -> list[Column]:
    """The columns of df under the names in__0, in__1 and so on, which no column added to them can clash with."""
    return [F.col(f"`{c}`").alias(f"in__{i}") for i, c in enumerate(df.columns)]


def hidden_name(df: DataFrame, column: str) -> str:
    """The name that hidden() gives a column."""
    return f"in__{[c.lower() for c in df.columns].index(column.lower())}"


def shown(columns: list[str], replaced: tuple[str, ...] = ()) -> list[Column]:
    """The columns that hidden() renamed, by their own names, without those replaced (in any case)."""
    gone = {c.lower() for c in replaced}
    return [F.col(f"in__{i}").alias(c) for i, c in enumerate(columns) if c.lower() not in gone]


def running_sum(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, value: Column, out: str, total: str, per_key: DataFrame | None = None) -> DataFrame:
    """Adds out, the sum of value over the rows of the same keys that come earlier in order, and total, the sum over all rows of the keys.

    keys are columns without nulls.  bucket is a value that never falls along
    order.  Sums by (keys, bucket) are summed up first, so that a window holds
    the rows of one bucket, and a hot key is spread over as many tasks as it has
    buckets.  The columns of per_key, a row per keys, come along with the sums: joined
    to the rows by keys alone, a hot key would be one task.
    """
    b, v, before = (free_name(df, x) for x in ("bucket__", "value__", "before__"))
    df = df.withColumns({b: bucket, v: value})
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, b).agg(F.sum(v).alias(before))
    sums = sums.select(*keys, b, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before), F.sum(before).over(whole).alias(total))
    if per_key is not None:
        sums = sums.join(per_key, keys)
    own = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(sums, [*keys, b])
    return joined.withColumn(out, F.col(before) + F.coalesce(F.sum(v).over(own), F.lit(0))).drop(b, v, before)


#: A key of more than HOT_ROWS rows and more than one in HOT_KEYS of all rows is joined by a broadcast, so there are fewer than HOT_KEYS of them, whatever the table's size.
HOT_ROWS, HOT_KEYS = 50_000, 4096


def hot_bound(per_key: DataFrame, count: str, least: int | None = None) -> int:
    """The rows beyond which a key is hot."""
    return max(HOT_ROWS if least is None else least, (per_key.agg(F.sum(count)).first()[0] or 0) // HOT_KEYS)


def join_counted(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str, spread: str) -> DataFrame:
    """rows left-joined with per_key, which has a row per keys and in count how many of rows have them.

    Hot keys are joined by broadcast and their rows, dealt by the column spread, pass
    through the shuffle join of the others, so that no task gets all rows of a key, nor
    more than a HOT_KEYSth of the table for one.  per_key is read thrice, so it is
    written first.
    """
    per_key = written(per_key, "counted")
    values = F.struct(*[c for c in per_key.columns if c not in (*keys, count)])
    most = hot_bound(per_key, count)
    hot = per_key.where(F.col(count) > most).select(*keys, values.alias("hot__"))
    cold = per_key.where(F.col(count) <= most).select(*keys, F.lit(0).cast("long").alias("deal__"), values.alias("cold__"))
    dealt = rows.join(F.broadcast(hot), keys, "left")
    dealt = dealt.withColumn("deal__", F.when(F.col("hot__").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 40))).cast("long"))
    out = dealt.join(cold.hint("merge"), [*keys, "deal__"], "left").withColumn("hot__", F.coalesce("hot__", "cold__"))
    return out.select(*rows.columns, "hot__.*")


def crc(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
