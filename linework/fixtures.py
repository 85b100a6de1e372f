"""Line segments, ink pixels and image files derived from lineitem, for queries and tests."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.operators.components import written
from linework.sources.files import local_fs

_BASE = """SELECT l_orderkey AS ok, l_linenumber AS ln, min(l_partkey) AS pk, min(l_suppkey) AS sk, min(CAST(l_quantity AS INT)) AS q, min(l_returnflag) AS rf
  FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""

SEGMENTS = """SELECT CAST(floor(ok / 32) AS BIGINT) AS image_id, CAST(ok * 8 + ln AS BIGINT) AS line_id,
  CAST((pk * 7 + ln * 13) % 16 * 250 AS BIGINT) AS x1, CAST((sk * 11 + q * 5) % 16 * 250 AS BIGINT) AS y1,
  CAST((pk * 7 + ln * 13) % 16 * 250 + CASE ln % 4 WHEN 0 THEN q * 10 WHEN 1 THEN 0 WHEN 2 THEN q * 10 ELSE q * 6 END AS BIGINT) AS x2,
  CAST((sk * 11 + q * 5) % 16 * 250 + CASE ln % 4 WHEN 0 THEN 0 WHEN 1 THEN q * 10 WHEN 2 THEN q * 10 ELSE q * 3 END AS BIGINT) AS y2,
  CASE WHEN q % 5 = 0 THEN 0 WHEN rf = 'A' THEN 255 ELSE 0 END AS r, CASE WHEN q % 5 = 0 THEN 0 WHEN rf = 'N' THEN 255 ELSE 0 END AS g,
  CASE WHEN q % 5 = 0 THEN 0 WHEN rf = 'R' THEN 255 ELSE 0 END AS b FROM base"""

_STROKES = """SELECT CAST(floor(ok / 16) AS BIGINT) AS image_id, CAST((sk * 11 + q * 5 + ln * 17) % 84 + CASE ln % 4 WHEN 0 THEN 0 ELSE i END AS BIGINT) AS row,
  CAST((pk * 7 + ln * 13) % 84 + CASE ln % 4 WHEN 0 THEN i WHEN 1 THEN 0 WHEN 2 THEN i ELSE 2 * i + j END AS BIGINT) AS col,
  CASE rf WHEN 'A' THEN 16711680 WHEN 'N' THEN 65280 ELSE 255 END AS rgb FROM {steps} WHERE j = 0 OR ln % 4 = 3"""
PIXELS = "SELECT image_id, row, col, max(rgb) AS rgb FROM (" + _STROKES + ") GROUP BY image_id, row, col"
_SPARK_STEPS = "(SELECT *, explode(sequence(0, 1)) AS j FROM (SELECT *, explode(sequence(0, CAST(q % 12 AS INT))) AS i FROM base))"
_DUCK_STEPS = "(SELECT *, unnest(range(2)) AS j FROM (SELECT *, unnest(range(CAST(q % 12 + 1 AS BIGINT))) AS i FROM base))"

#: The same tables as DuckDB common table expressions.
DUCK_BASE = "base AS (" + _BASE.format(lineitem="lineitem") + ")"
DUCK_SEG = "base AS (" + _BASE.format(lineitem="lineitem") + "), seg AS (" + SEGMENTS + ")"
DUCK_PIX = "base AS (" + _BASE.format(lineitem="lineitem") + "), pix AS (" + PIXELS.format(steps=_DUCK_STEPS) + ")"


def base_query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over base: ok, ln, pk, sk, q and rf of each order line."""
    return spark.sql("WITH base AS (" + _BASE + ") " + sql, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


#: Bytes of the table for each partition of order lines; strokes of up to 24 pixels come of one.
PART_BYTES = 4 << 20


def by_image(spark: SparkSession, sf_dir: str, orders: int, sql: str) -> DataFrame:
    """A query over {base}: the rows of base with img, the image of so many orders, dealt by it.

    What is keyed by image_id (from img) and more needs no other exchange.
    """
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    size = int(lineitem._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    rows = lineitem.selectExpr(f"CAST(floor(l_orderkey / {orders}) AS BIGINT) AS img", "l_orderkey AS ok", "l_linenumber AS ln", "l_partkey AS pk", "l_suppkey AS sk", "CAST(l_quantity AS INT) AS q", "l_returnflag AS rf")
    base = rows.repartition(parts, "img").groupBy("img", "ok", "ln").agg(*[F.min(c).alias(c) for c in ("pk", "sk", "q", "rf")])
    of_image = sql.replace(f"CAST(floor(ok / {orders}) AS BIGINT) AS image_id", "img AS image_id").replace("FROM base", "FROM {base}")
    return spark.sql(of_image, base=base)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, line_id, x1, y1, x2, y2, r, g, b."""
    return by_image(spark, sf_dir, 32, SEGMENTS)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, row, col, rgb."""
    return by_image(spark, sf_dir, 16, PIXELS.replace("{steps}", _SPARK_STEPS))


def write_images(pixels: DataFrame, folder: str, height: int, width: int) -> DataFrame:
    """Writes an RGB PNG per image_id of pixels (image_id, row, col, rgb) on white, and returns (image_id, path).

    The high byte of rgb is blue, as images_to_pixels() has it.  A file appears whole
    under its name; a task that runs again writes the same bytes.
    """
    drawn = pixels.groupBy("image_id").agg(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("row", "col", "rgb")])).alias("p"))
    drawn = drawn.select("image_id", "p.row", "p.col", "p.rgb")

    def piece(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    def run(batches):
        fs, base = local_fs(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            ids, names = batch.column(0).to_pylist(), []
            for i, image in enumerate(ids):
                row, col, rgb = (batch.column(k)[i].values.to_numpy() for k in (1, 2, 3))
                grid = np.full((height, width, 3), 255, dtype=np.uint8)
                grid[row, col] = np.stack([rgb & 255, rgb >> 8 & 255, rgb >> 16 & 255], axis=1)
                lines = np.concatenate([np.zeros((height, 1), np.uint8), grid.reshape(height, -1)], axis=1).tobytes()
                data = b"\x89PNG\r\n\x1a\n" + piece(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + piece(b"IDAT", zlib.compress(lines, 1)) + piece(b"IEND", b"")
                hidden = f"{base}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(hidden, compression=None) as out:
                    out.write(data)
                fs.move(hidden, f"{base}/{image}.png")
                names.append(f"{folder}/{image}.png")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string())], names=["image_id", "path"])

    return written(drawn.mapInArrow(run, "image_id long, path string"), "images")
