"""A training corpus from raw documents: quality, near duplicates, benchmark, mixture, shards.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame.  All but the last return the columns of documents, whatever their
names, and keep their values.  Between stages the rows are written as Parquet and
read again.  Stages that hand texts to Python workers bound the session's batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linework.llm.common import bounded_batches, crc, free_name, hidden, hidden_name, shown, table, written
from linework.llm.decontaminate import contamination, is_contaminated
from linework.llm.jaccard import similarity_classes
from linework.llm.mixing import mix, training_order
from linework.llm.quality import fit_chain, label_lines
from linework.llm.sharding import interleave

#: The field of the first stage and the decoding are not expressible in SQL.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are mostly boilerplate go.

    A null or blank text fails the base rules; equal rows have one fate; without
    labels every line is content.  No rows give no rows.
    """
    bounded_batches(spark)
    chain = fit_chain(docs, table(spark, sf_dir, "labels"))
    return label_lines(docs.select(*hidden(docs)), chain, text=hidden_name(docs, "text")).where("kept").select(*shown(docs.columns))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by a Jaccard similarity of 0.8 or more of five-word shingles the least doc_id stays.

    Of rows equal in doc_id and text one stays; rows without doc_id come last in
    that order, and of a class of such rows alone that of the least hash stays.
    Blank and null texts are in no class and stay.  No rows give no rows.
    """
    bounded_batches(spark)
    classes = similarity_classes(docs, k=5, num=80)
    # A row of a class and its text have one print, so each class keeps the print of its least row.
    order = F.struct(F.col("id").isNull(), "id", "print")
    first = classes.where("class IS NOT NULL").groupBy("class").agg(F.min(order).alias("first")).select(F.col("first.print").alias("print"))
    marked = docs.withColumn(free_name(docs, "print__"), F.xxhash64("doc_id", "text"))
    name = marked.columns[-1]
    kept = marked.join(first.select(F.col("print").alias(name)).hint("merge"), name, "left_semi").dropDuplicates([name])
    blank = docs.where("text IS NULL OR NOT text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    return kept.select(*docs.columns).unionByName(blank)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go.

    A null or blank text is clean; equal rows have one fate; without items all stay.
    """
    bounded_batches(spark)
    found = contamination(docs.select(*hidden(docs)), table(spark, sf_dir, "benchmark"), text=hidden_name(docs, "text"))
    return found.where(~is_contaminated()).select(*shown(docs.columns))


def mixing_to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per pass of a document that the mixture takes, in training order; whole documents only.

    A document without words is in no pass.  Rows of one document are equal, as only
    the columns of docs are returned.  No rows give no rows.
    """
    source, key, text = (hidden_name(docs, c) for c in ("source", "doc_id", "text"))
    return training_order(mix(docs.select(*hidden(docs)), "document", source, key, text)).select(*shown(docs.columns))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with text_crc32, shard and slot: the shards of the corpus, texts included.

    Equal rows (the passes of a document) are numbered, so that each gets a place of
    its own in the order.  Places are found without the texts, which are dealt once.
    Columns of docs called like the results are replaced.  No rows give no rows.
    """
    added = ("text_crc32", "shard", "slot")
    rows = docs.select(*hidden(docs), crc(F.col("text")).alias("text_crc32"), F.xxhash64(*docs.columns).alias("row"), "doc_id", "source")
    same = ["row", "text_crc32"]
    slim = rows.select(*same, "doc_id", "source")
    slim = slim.withColumn("copy", F.row_number().over(Window.partitionBy(*same).orderBy("doc_id")))
    placed = interleave(slim, checksum="text_crc32", copy="copy").groupBy(*same).agg(F.collect_list(F.struct("shard", "slot")).alias("places"))
    texts = rows.drop("doc_id", "source").dropDuplicates(same).join(placed, same)
    out = texts.select(*shown(docs.columns, added), "text_crc32", F.explode("places").alias("place"))
    return out.select(*[c for c in out.columns if c != "place"], "place.shard", "place.slot")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_to_target_weights),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
