"""The mixing query's rows come from the range-sorted corpus; the pipeline hands texts to Python workers in bounded batches."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linework.llm import common, decontaminate, jaccard, mixing, quality


def test_mixing_query_is_summed_from_the_training_order(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(k, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["a", "b", "b", "b", None])) for k in range(600)]
    rows += [(7, "w w w", "a"), (7, "w w w", "a"), (None, "w w", "b"), (None, "w w", "b"), (None, None, "b"), (8, "", "blank")]
    at = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{at}/documents.parquet")
    tables, plain = {}, mixing.written
    monkeypatch.setattr(mixing, "written", lambda df, name: tables.setdefault(name, plain(df, name)))
    got = mixing.op6_mixing(spark, at).collect()
    assert len(got) == len(rows)

    # Each file of the corpus is sorted, and no two files overlap.
    order = [(r["file"], r["position"]) for r in tables["order"].select(F.input_file_name().alias("file"), "position").collect()]
    files = {}
    for file, position in order:
        files.setdefault(file, []).append(position)
    ranges = sorted((v[0], v[-1]) for v in files.values())
    assert all(v == sorted(v) for v in files.values()) and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
    passes = tables["order"].groupBy("row").count().where("count = 2").count()
    assert passes > 0 and tables["order"].agg(F.sum("words")).first()[0] == sum(r["taken"] for r in got)
    assert any(r["taken"] > r["size"] for r in got) and all((r["first_position"] is None) == (r["taken"] == 0) for r in got)

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
    key = lambda r: (r[0] is None, r[0] or 0, *[x or 0 for x in r[1:]])
    sql = sorted((r[:6] for r in con.sql(mixing.OP6_SQL).fetchall()), key=key)
    assert [r[:3] + r[4:] for r in sql] == [r[:3] + r[4:] for r in sorted((tuple(r) for r in got), key=key)]


@pytest.mark.parametrize("stage, module", [(corpus_pipeline.quality_rules, quality), (corpus_pipeline.ngram_jaccard_join, jaccard), (corpus_pipeline.benchmark_decontamination, decontaminate)])
def test_pipeline_texts_come_in_bounded_batches(spark, tmp_path, monkeypatch, stage, module):
    rng = random.Random(9)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(1200)) for _ in range(500)]
    at, log = str(tmp_path), str(tmp_path / "batches")
    spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([("1", texts[0][:400])], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(500)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    plain = module.blocks

    def watched(batches, *rest):
        def seen():
            for batch in batches:
                with open(log, "a") as f:
                    f.write(f"{batch.nbytes}\n")
                yield batch

        return plain(seen(), *rest)

    monkeypatch.setattr(module, "blocks", watched)
    out = stage(spark, spark.read.parquet(f"{at}/documents.parquet"), at).collect()
    sizes = [int(x) for x in open(log)]
    assert len(out) <= 500 and max(sizes) <= common.BATCH_BYTES + 2 * max(map(len, texts)) and sum(sizes) >= sum(map(len, texts))


def test_a_bound_that_the_session_has_stays(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, "123456")
    common.bounded_batches(spark)
    assert spark.conf.get(name) == "123456"
    spark.conf.unset(name)
