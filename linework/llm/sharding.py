"""Operator 5: shards that all match the mixture of sources, by proportional stratified interleaving.

Rows are put in a seeded random order within their source; the row of rank r
(from 0) among n gets the fractional rank (r + u) / n, u being a seeded number in
[0, 1) of the source, so that sources of few rows do not all meet in the middle.
All rows are sorted by fractional rank, which spreads each source evenly over the
whole order, and the order is cut in shards whose row counts differ by one at
most.  Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.llm.common import crc, hidden, running_sum, shown, table

SHARDS = 40
SEED = "interleave-1"
#: Rows of one window, on average: the ranges of the sort keys that are counted first grow with the table.
WINDOW_ROWS = 20_000


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, source: str = "source", key: str = "doc_id", checksum: str | None = None, copy: str | None = None) -> DataFrame:
    """docs with shard (0 to shards - 1) and slot (from 0, without gaps in a shard).

    A null source is a source of its own, sorted last.  Rows with the same key
    are told apart by the checksum of their text (checksum names a column that has
    it already) and by copy, a column that numbers repeated rows, where given; rows
    equal in all are interchangeable and lie next to each other.  A null key or text
    counts as an empty one.  No rows give no rows; with fewer rows than shards some
    shards stay empty.  Columns of docs keep their values; columns of docs called
    shard or slot (in any case) are replaced.
    """
    text = F.col(f"`{checksum}`") if checksum else crc(F.col("text"))
    number = F.col(f"`{copy}`").cast("string") if copy else F.lit("0")
    src = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("~"))
    rows = docs.select(
        *hidden(docs),
        src.alias("src__"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), text.cast("string"), number)).alias("h__"),
        (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), src)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))).alias("u__"),
        F.col(key).alias("key__"),
        text.alias("crc__"),
    )
    windows = docs.count() // WINDOW_ROWS + 1
    digits = max(2, math.ceil(math.log(windows, 16)) + 1)
    within = running_sum(rows, ["src__"], [F.col("h__"), F.col("key__"), F.col("crc__")], F.substring("h__", 1, digits), F.lit(1), "rank__", "of__")
    within = within.withColumn("share__", (F.col("rank__") + F.col("u__")) / F.col("of__")).withColumn("all__", F.lit(0))
    order = [F.col(c) for c in ("share__", "src__", "h__", "key__", "crc__")]
    placed = running_sum(within, ["all__"], order, F.floor(F.col("share__") * (16 * windows)), F.lit(1), "at__", "rows__")
    placed = placed.withColumn("shard__", F.expr(f"at__ * {shards} div rows__"))
    placed = placed.withColumn("slot__", F.expr(f"at__ - (shard__ * rows__ + {shards - 1}) div {shards}"))
    return placed.select(*shown(docs.columns, ("shard", "slot")), F.col("shard__").cast("int").alias("shard"), F.col("slot__").alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 16
    slim = docs.select("doc_id", "source", size.alias("size"), crc(F.col("text")).alias("text_crc32"))
    out = interleave(slim, checksum="text_crc32")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


#: crc32 bit by bit would be slow, so the table of 256 remainders is built by a recursion first.
OP5_SQL = f"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
remainders AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8),
docs AS (SELECT doc_id, source, encode(coalesce(text, '')) AS b FROM documents),
crcs AS (SELECT doc_id, source, octet_length(b) + 16 AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(b), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM docs, remainders),
hashed AS (SELECT *, coalesce('=' || source, '~') AS src, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || text_crc32 || ':0') AS h FROM crcs),
ranked AS (SELECT *, ((row_number() OVER (PARTITION BY src ORDER BY h, doc_id, text_crc32) - 1)::DOUBLE + ('0x' || md5('{SEED}:' || src)[:8])::BIGINT::DOUBLE / 4294967296::DOUBLE) / count(*) OVER (PARTITION BY src)::DOUBLE AS share FROM hashed),
placed AS (SELECT *, row_number() OVER (ORDER BY share, src, h, doc_id, text_crc32) - 1 AS pos, count(*) OVER () AS n FROM ranked)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (pos * {SHARDS} // n)::INT AS shard,
  pos - ((pos * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INT AS grown_shard, source FROM placed
"""
