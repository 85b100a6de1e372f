"""Operator 6: mixes sources to target weights along a time-varying curriculum.

Each source has a target in words.  Its weight over training time t in [0, 1]
is a straight line, start at t = 0 and 2 - start at t = 1, so its cumulative
demand is the target times A(t) = start t + (1 - start) t^2.  Documents of a
source lie one after the other in a seeded order, as often as the target needs;
the words up to a document divided by the target is the demand that it meets,
and inverting A gives its training position.  The mixed corpus is range-sorted
by position.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linework.llm.common import WORD_PATTERN, crc, hidden, running_sum, shown, table, written

#: Weights of the sources in the order of their names (code points, null last), over and over.
WEIGHTS = (5, 2, 1)
#: All targets together, as a share of all words.
BUDGET = 1.5
#: No target is above so many times its source's words.
REPEATS = 2
#: Weight of a source at t = 0, by its place in WEIGHTS; 1 is a constant weight.
STARTS = (1.5, 1.0, 0.5)
SEED = "mixing-1"


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """sizes (src__, source_size; a row per source) with target and start.

    Targets are in proportion to the weights, but at most repeats times the
    source's size; what is cut off goes to the others by weight.  Sources in the
    order of cap / weight are at their cap as long as the level that the rest
    would get is not below cap / weight.  Windows hold a row per source, all in one
    task: meant for up to some ten million sources.
    """
    names = Window.partitionBy("all__").orderBy(F.col("src__"))
    rows = sizes.withColumn("all__", F.lit(0)).withColumn("place", (F.row_number().over(names) - 1) % len(weights))
    pick = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), (F.col("place") + 1).cast("int"))
    rows = rows.withColumns({"weight": pick(weights), "start": pick(STARTS), "cap": (F.col("source_size") * repeats).cast("double")})
    everything = Window.partitionBy("all__")
    rows = rows.withColumn("due", F.sum("source_size").over(everything) * F.lit(float(budget)))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = everything.orderBy("ratio", "src__")
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.col("due") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(on))
    rows = rows.withColumn("line", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything))
    free = (F.col("ratio") > F.col("level")) & F.col("line").isNotNull()
    return rows.select("src__", "source_size", F.when(free, F.col("line") * F.col("weight")).otherwise(F.col("cap")).alias("target"), "start")


MIXED = ("size", "source_size", "target", "taken", "passes")
#: Rows of one window, on average.
WINDOW_ROWS = 20_000


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def mix(docs: DataFrame, cut: str = "word", source: str = "source", key: str = "doc_id", text: str = "text", seed: str = SEED, counted: tuple[str, str] | None = None) -> DataFrame:
    """docs with size, source_size, target, taken (words) and passes: an array of (pass, words, position), position being in [0, 1).

    cut says how the last pass ends: "word" takes a part of the last document, so
    that the words taken of a source equal its rounded target; "document" takes
    whole documents, those whose middle lies before the target.  A null or blank
    text has size 0, is never taken, and has no passes; so has a source of such
    texts alone, whose target is 0.  A null source is a source of its own.  Rows with
    equal keys are ordered by the text's checksum; rows equal in both are
    interchangeable.  No rows give no rows.  Columns of docs called like the results
    (in any case) are replaced, all others keep their values.  counted names two
    columns of docs that have the size and the checksum already.
    """
    size, check = (F.col(f"`{c}`") for c in counted) if counted else (word_count(text), crc(F.col(text)))
    rows = docs.select(
        *hidden(docs),
        size.alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("~")).alias("src__"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("h__"),
        F.col(key).alias("key__"),
        check.alias("crc__"),
    )
    sizes = rows.groupBy("src__").agg(F.sum("size").alias("source_size"))
    digits = max(2, math.ceil(math.log(docs.count() // WINDOW_ROWS + 1, 16)) + 1)
    placed = running_sum(rows, ["src__"], [F.col("h__"), F.col("key__"), F.col("crc__")], F.substring("h__", 1, digits), F.col("size"), "from__", "total__", targets(sizes)).drop("total__")
    first, goal = F.col("from__"), F.round("target").cast("long")

    def words(k: int):
        begin = first + F.col("source_size") * k
        if cut == "word":
            return F.greatest(F.lit(0), F.least(F.col("size"), goal - begin))
        return F.when((F.col("size") > 0) & (2 * begin + F.col("size") <= 2 * F.col("target")), F.col("size")).otherwise(F.lit(0))

    def position(k: int):
        demand = F.coalesce(F.least(F.try_divide((first + F.col("source_size") * k).cast("double"), F.col("target")), F.lit(1.0)), F.lit(1.0))
        a, b = F.col("start"), 1 - F.col("start")
        return F.when(b == 0, demand).otherwise(F.try_divide(F.sqrt(F.greatest(a * a + 4 * b * demand, F.lit(0.0))) - a, 2 * b))

    passes = [F.struct(F.lit(k).alias("pass"), words(k).alias("words"), position(k).alias("position")) for k in range(REPEATS)]
    out = placed.withColumn("passes", F.filter(F.array(*passes), lambda p: p["words"] > 0))
    out = out.withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda total, p: total + p["words"]))
    return out.select(*shown(docs.columns, MIXED), *MIXED)


def training_order(mixed: DataFrame) -> DataFrame:
    """A row per pass of a document of mix(), with pass, words and position, range-sorted by position.

    Ties in position keep no order.  Columns of mixed called pass, words or
    position (in any case) are replaced; passes goes.
    """
    rows = mixed.select(*hidden(mixed), F.explode("passes").alias("one__"))
    rows = rows.select(*shown(mixed.columns, ("passes", "pass", "words", "position")), "one__.pass", "one__.words", "one__.position")
    return rows.repartitionByRange("position").sortWithinPartitions("position")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, summed up from the mixed corpus: the passes in training order, which hold a document's row in place of its text."""
    docs = table(spark, sf_dir, "documents")
    # Words are counted once; the texts take no part in what follows.  row tells documents of equal keys apart.
    slim = written(docs.select("doc_id", "source", word_count().alias("n"), crc(F.col("text")).alias("crc"), F.monotonically_increasing_id().alias("row")), "sizes")
    mixed = written(mix(slim, counted=("n", "crc")), "mixed")
    order = written(training_order(mixed.select("row", "passes")), "order")
    found = order.groupBy("row").agg(F.sum("words").alias("taken"), F.round(F.min("position"), 6).alias("first_position"))
    # A document that is in no pass comes back with nothing taken.
    return mixed.drop("taken").join(found, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_position")


OP6_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce('=' || source, '~') AS src, coalesce(len(regexp_extract_all(text, '{WORD_PATTERN}')), 0)::BIGINT AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
named AS (SELECT src, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY src) - 1) % 3 AS place FROM docs GROUP BY src),
weighted AS (SELECT *, ([5.0, 2.0, 1.0])[place + 1]::DOUBLE AS weight, ([1.5, 1.0, 0.5])[place + 1]::DOUBLE AS start, (2 * source_size)::DOUBLE AS cap,
    (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS due FROM named),
levels AS (SELECT *, cap / weight AS ratio, (due - coalesce(sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
lined AS (SELECT *, max(CASE WHEN ratio > level THEN level END) OVER () AS line FROM levels),
goals AS (SELECT src, source_size, start, CASE WHEN ratio > level THEN line * weight ELSE cap END AS target FROM lined),
placed AS (SELECT d.*, g.source_size, g.target, g.start,
    (sum(size) OVER (PARTITION BY src ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS begin FROM docs d JOIN goals g USING (src)),
cuts AS (SELECT *, greatest(0, least(size, round(target)::BIGINT - begin)) AS w0, greatest(0, least(size, round(target)::BIGINT - begin - source_size)) AS w1,
    least(begin / target, 1.0) AS d0, least((begin + source_size) / target, 1.0) AS d1 FROM placed)
SELECT doc_id, size, source_size, target, (w0 + w1)::BIGINT AS taken,
  CASE WHEN w0 = 0 AND w1 = 0 THEN NULL ELSE round(CASE WHEN start = 1 THEN CASE WHEN w0 > 0 THEN d0 ELSE d1 END
    ELSE (sqrt(greatest(start * start + 4 * (1 - start) * CASE WHEN w0 > 0 THEN d0 ELSE d1 END, 0)) - start) / (2 * (1 - start)) END + 0.0, 6) END AS first_position
FROM cuts
"""
