"""Detection of drawings as they arrive, each computed once: a file stream of pixels, or one of image files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.params import DEFAULTS, Params
from linework.plans.jobs import detect_cached, detect_files
from linework.schema import PIXELS
from linework.sources.catalog import exists


def detect_stream(spark: SparkSession, source: str, folder: str, checkpoint: str, params: Params = DEFAULTS):
    """Starts a query over Parquet files of pixels; a batch has whole drawings, and drawings recorded before are not computed again."""

    def batch(rows: DataFrame, _: int) -> None:
        requests = rows.select("image_id").distinct().select(F.concat(F.lit("image-"), F.col("image_id").cast("string")).alias("key"), "image_id", F.lit(False).alias("forced"))
        detect_cached(requests, rows, folder, params)

    stream = spark.readStream.schema(PIXELS).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def detect_file_batch(rows: DataFrame, number: int, folder: str, params: Params = DEFAULTS) -> None:
    """The drawings of a batch of image files (path), whole; a batch recorded in folder is not looked at again.

    A batch that stopped half-way is done again: what it recorded is kept, the rest is
    computed.  So no drawing gets a second version.
    """
    spark, done = rows.sparkSession, f"{folder}/batches"
    if exists(spark, done) and not spark.read.schema("batch long").parquet(done).where(F.col("batch") == number).isEmpty():
        return
    none = [F.lit(None).cast("int").alias(c) for c in ("r0", "r1", "c0", "c1")]
    detect_files(rows.select("path", *none, F.lit(False).alias("forced")).distinct(), folder, params)
    spark.createDataFrame([(number,)], "batch long").coalesce(1).write.mode("append").parquet(done)


def detect_image_stream(spark: SparkSession, source: str, folder: str, checkpoint: str, params: Params = DEFAULTS, pattern: str = "*.png"):
    """Starts a query over the image files that appear in source: lines and groups of each, recorded in folder under its name."""

    def batch(rows: DataFrame, number: int) -> None:
        detect_file_batch(rows, number, folder, params)

    schema = "path string, modificationTime timestamp, length long, content binary"
    # Only the names are taken from the stream; detection reads the files that have work to do.
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(source).select("path")
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
