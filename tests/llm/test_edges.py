"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for each operator and stage."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linework.llm import decontaminate, jaccard, licenses, mixing, quality, repeats, sharding, toxicity, urlfilter, warc

LONG = " ".join(f"w{i % 977}" for i in range(120_000))
TEXTS = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (None, None, None), (None, "a b c d e f", None), (None, "a b c d e f", None), (2, "", "s"), (3, LONG, "t"), (3, " \n\t", "blank"), (4, None, "blank"), (5, "é" * 40, "t")]
CLASH = ["start", "target", "source_size", "h__", "src__", "crc__", "from__", "pass", "words", "position", "doc", "print", "gone", "key", "key__0", "sha1", "node", "class", "block", "found", "in__0", "in__1", "copy", "row", "share__", "deal__", "hot__", "n__", "first__", "maybe", "copies", "SHARD", "Licenses", "runs", "host"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(TEXTS)], "doc_id long, text string, source string, tag int")
    return df.withColumns({c: F.concat(F.lit(f"{c}-"), "tag") for c in CLASH}).repartition(2)


def page(df):
    return df.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumn("url", F.when(F.col("page_id") == 3, F.concat(F.lit("http://x.com/"), "html")).otherwise(F.lit("http://spam-farm.example.net/q")))


def scorer(df):
    return toxicity.fit_scorer(df, df.sparkSession.createDataFrame([(1, 1), (3, 0), (None, 1), (5, None), (5, 0)], "doc_id long, toxic int"))


OPERATORS = {
    "quality": (lambda df: quality.label_lines(df, quality.fit([], [])), ()),
    "warc": (lambda df: warc.marked(page(df)), ("sha1",)),
    "licenses": (licenses.find_licenses, ("licenses",)),
    "sharding": (lambda df: sharding.interleave(df, 3), ("shard",)),
    "mixing": (mixing.mix, ("target", "source_size")),
    "urlfilter": (lambda df: urlfilter.judge(page(df), urlfilter.rule_table(df.sparkSession)), ("host",)),
    "toxicity": (lambda df: toxicity.score_texts(df, scorer(df)), ()),
    "decontaminate": (lambda df: decontaminate.contamination(df, df.sparkSession.createDataFrame([("i", "b c d"), (None, None)], "item_id string, text string")), ("runs",)),
    "repeats": (lambda df: repeats.remove_repeats(df, 40), ()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_takes_odd_rows_and_names(odd, name):
    operate, replaced = OPERATORS[name]
    got = operate(odd).collect()
    assert sorted(r["tag"] for r in got) == list(range(len(TEXTS)))
    for r in got:
        assert all(r[c] == f"{c}-{r['tag']}" for c in CLASH if c.lower() not in replaced)
    assert operate(odd.limit(0)).count() == 0


def test_jaccard_odd_rows(odd):
    got = sorted(((r["id"], r["n_shingles"], r["component"]) for r in jaccard.similarity_classes(odd).collect()), key=repr)
    same = [(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 2, 1)]
    assert got == sorted([*same, (None, 0, None), (2, 0, 2), (3, got_long(), 3), (3, 0, 3), (4, 0, 4), (5, 1, 5)], key=repr)
    assert jaccard.similarity_classes(odd.limit(0)).count() == 0


def got_long():
    w = LONG.split()
    return len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})


def test_null_keys_alone_and_other_key_types(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), ("x", "q r s t u"), ("y", "q r s t u")], "doc_id string, text string")
    assert sorted((r["id"] or "", r["component"]) for r in jaccard.similarity_classes(df).collect()) == [("", None), ("", None), ("x", "x"), ("y", "x")]


def test_band_recall_at_the_threshold():
    rng = random.Random(5)
    met = 0
    for _ in range(60):
        base = [rng.getrandbits(64) for _ in range(190)]
        a, b = sorted(base), sorted(base[:180] + [rng.getrandbits(64) for _ in range(10)])  # similarity 0.9
        tokens = np.array(a + b, dtype=np.uint64)
        keys = jaccard.band_keys(tokens, np.array([0, len(a), len(a) + len(b)]), jaccard.bands_for(0.9), jaccard.BAND_ROWS)
        met += (keys[0] == keys[1]).any()
    assert met == 60


def test_warc_null_key_reads_back_as_null(spark, tmp_path):
    rows = [(None, "http://a/", "p"), (1, "http://b/", "p"), (2, "http://c/", "p"), (None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    sql = sorted(con.sql(f"SELECT page_id, payload_bytes, record_type, refers_to FROM ({warc.OP2_SQL})").fetchall(), key=repr)
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.op2_warc(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(None, 1, "revisit", 2), (1, 1, "revisit", 2), (2, 1, "response", None), (None, 0, "response", None)], key=repr) == sql


def test_training_order_of_odd_rows(odd):
    mixed = mixing.mix(odd, cut="document")
    got = mixing.training_order(mixed).collect()
    assert [r["position"] for r in got] == sorted(r["position"] for r in got) and all(0 <= r["position"] <= 1 for r in got)
    assert sum(r["words"] for r in got) == mixed.agg(F.sum("taken")).first()[0]
    blank = {r["source"]: r for r in mixed.collect()}["blank"]
    assert (blank["source_size"], blank["target"], blank["taken"]) == (0, 0.0, 0)


def test_sources_of_one_row_are_spread(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.col("id").cast("string").alias("source"))
    got = sharding.interleave(df, 8).where("doc_id < 800").groupBy("shard").count().collect()
    assert len(got) == 8 and max(r["count"] for r in got) < 150


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([("i", " ".join(f"b{k}" for k in range(20))), (None, None)], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def documents(odd):
    good = ". ".join(" ".join(f"v{i}x{j}" for i in range(9)) for j in range(9))
    spark = odd.sparkSession
    more = [(i, f"{good} {i % 2} {i % 2}", "s", 100 + i) for i in (10, 11, 12, 12)] + [(13, " ".join(f"b{k}" for k in range(20)) + " " + " ".join(f"y{k}" for k in range(60)), "t", 114)]
    df = spark.createDataFrame(more, "doc_id long, text string, source string, tag int").withColumns({c: F.concat(F.lit(f"{c}-"), "tag") for c in CLASH})
    return odd.unionByName(df).withColumns({c: F.lit(c) for c in ("size", "kept", "n_words", "n_hit", "passes", "print__", "text_crc", "places")})


@pytest.mark.parametrize("k", range(5))
def test_stage_takes_odd_rows_and_names(spark, documents, tables, k):
    _, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, documents, tables)
    got = out.collect()
    for r in got:
        assert all(r[c] == f"{c}-{r['tag']}" for c in CLASH if k < 4 or c.lower() != "shard") and r["size"] == "size" and r["kept"] == "kept"
    assert k == 4 or out.columns == documents.columns
    tags = sorted(r["tag"] for r in got)
    if k == 0:
        assert set(tags) >= {110, 111, 112, 114} and not set(tags) & {0, 2, 5, 7, 8}
    if k == 1:
        assert len([t for t in tags if t in (0, 1, 3, 4)]) == 1 and {2, 5, 6, 7, 8, 9, 114} <= set(tags) and len([t for t in tags if 110 <= t <= 112]) == 1
    if k == 2:
        assert 114 not in tags and len(tags) == len(TEXTS) + 4
    if k == 3:
        assert max(tags.count(t) for t in set(tags)) <= 2 * max(1, documents.where("tag = 112").count()) and not set(tags) & {2, 5, 7, 8}
    if k == 4:
        assert tags == sorted(r["tag"] for r in documents.collect()) and sorted(r["slot"] for r in got if r["shard"] == got[0]["shard"])[0] == 0
        assert {r["text"] for r in got if r["tag"] == 6} == {LONG}
    assert stage(spark, documents.limit(0), tables).count() == 0


def test_copies_of_a_document_are_placed_apart(spark):
    base = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), (F.col("id") % 3).cast("string").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    out = corpus_pipeline.sharding(spark, base.unionByName(base), "").collect()
    of = {}
    for r in out:
        of.setdefault(r["doc_id"], []).append(r["shard"])
    assert len(out) == 800 and all(len(v) == 2 for v in of.values()) and sum(len(set(v)) == 1 for v in of.values()) < 40
