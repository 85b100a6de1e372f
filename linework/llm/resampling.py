"""Operator 11: importance resampling towards a target distribution.

Texts become hashed word and word-pair features.  The log ratio of a bucket's
smoothed share in the target texts to that in the raw texts is its gain, and the
mean gain of a document's features its weight.  Adding Gumbel noise seeded by the
document's id and taking the highest sums draws documents without replacement,
with odds that follow their weights.

Features are made with Arrow kernels over batches: the lower-cased texts are split,
flattened and dictionary-encoded; word pairs are pairs of neighbouring dictionary
indices, so a checksum is computed once for each different pair of a batch, and the
gains of a document are taken by index and summed by segment.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.llm.common import table
from linework.llm.textkernel import blocks
from linework.operators.ranks import ranked

BUCKETS = 10_000
#: Documents of fewer words are not drawn.
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: What separates words once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Gains are whole thousandths.
SCALE = 1000


class Features:
    """Features of a block of texts: row and bucket of each, words first, and the words and features per row."""

    def __init__(self, texts: pa.Array, buckets: int = BUCKETS):
        rows = len(texts)
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        pieces = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=SEPARATORS)
        words, row = pc.list_flatten(pieces), pc.list_parent_indices(pieces)
        full = pc.not_equal(pc.binary_length(words), 0)
        coded = words.filter(full).dictionary_encode()
        row = row.filter(full).to_numpy(zero_copy_only=False).astype(np.int64)
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        spelled = [w.encode() for w in coded.dictionary.to_pylist()]
        single = np.array([zlib.crc32(w) % buckets for w in spelled], dtype=np.int64)
        # The index shifted by one is the next word; a pair must lie within one row.
        near = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
        pairs, which = np.unique(index[near] * max(1, len(spelled)) + index[near + 1], return_inverse=True)
        begun = [zlib.crc32(b" ", zlib.crc32(w)) for w in spelled]
        left, right = np.divmod(pairs, max(1, len(spelled)))
        double = np.array([zlib.crc32(spelled[b], begun[a]) % buckets for a, b in zip(left.tolist(), right.tolist())], dtype=np.int64)
        self.row = np.concatenate([row, row[near]])
        self.bucket = np.concatenate([single[index] if len(index) else index, double[which] if len(near) else near])
        self.n_words = np.bincount(row, minlength=rows)
        self.n_features = np.bincount(self.row, minlength=rows)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all texts; each task adds up its own rows first, and the driver gets a number per bucket."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for part, _, _ in blocks(batches, "text"):
            total += np.bincount(Features(part.column(0), buckets).bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    found = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in found.collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of shares) per bucket, one feature added to each bucket of both sides."""
    s, t = raw.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.array([math.floor(SCALE * math.log(r)) for r in ratio.tolist()], dtype=np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, text: str = "text") -> DataFrame:
    """docs with n_words, n_features and weight, the floored mean gain of a document's features (none: 0).

    A null text has no words.  Columns of docs called like the results (in any case) are
    replaced, all others keep their values; equal rows get equal results.
    """
    added = ("n_words", "n_features", "weight")
    names = [c for c in docs.columns if c.lower() not in added]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])

    def run(batches):
        for part, _, _ in blocks(batches, text):
            found = Features(part.column(part.schema.get_field_index(text)), len(gains))
            # Each row's features are one segment once sorted by row.
            order = np.argsort(found.row, kind="stable")
            sums = np.concatenate([[0], np.cumsum(gains[found.bucket[order]])])
            ends = np.concatenate([[0], np.cumsum(found.n_features)])
            total = sums[ends[1:]] - sums[ends[:-1]]
            weight = total // np.maximum(found.n_features, 1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found.n_words.astype(np.int64)), pa.array(found.n_features.astype(np.int64)), pa.array(weight)], names=[*names, *added])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], "n_words long, n_features long, weight long"])
    return rows.mapInArrow(run, schema)


def with_score(weighed: DataFrame, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """weighed with score: weight plus Gumbel noise that the seed and the key fix; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return weighed.withColumn("score", F.col("weight") + F.floor(-SCALE * F.log(-F.log(share))).cast("long"))


def draw(scored: DataFrame, key: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """scored (key, n_words, score and more) with rank: 1, 2, 3 and so on for the drawn documents, null for the others.

    Of the documents of min_words words or more, floor(percent / 100) of them are
    drawn, those of the highest scores; ties go to the smaller key, null keys last.
    """
    able = F.col("n_words") >= min_words
    placed = ranked(scored, [F.when(able, 0).otherwise(1), F.desc("score"), F.asc_nulls_last(key)], out="place__")
    goal = placed.where(able).count() * percent // 100
    return placed.withColumn("rank", F.when(F.col("place__") <= goal, F.col("place__"))).drop("place__")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of each document of docs, drawn towards the texts of target.

    No documents give no rows; without target texts all weights come from the raw
    shares alone.  Documents of one key are drawn each by its own text.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    gains = bucket_gains(bucket_counts(rows), bucket_counts(target, text))
    slim = weigh(rows, gains).select("key", "n_words", "n_features", "weight")
    return draw(with_score(slim, "key", seed), "key", percent, min_words).withColumnRenamed("key", key)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: The table of 256 remainders of crc32 is built by a recursion; each different feature has its bucket found once.
OP11_SQL = f"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
remainders AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8),
texts AS (SELECT true AS own, doc_id, text FROM documents UNION ALL SELECT false, row_number() OVER (), text FROM benchmark),
worded AS (SELECT own, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
made AS (SELECT own, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM worded),
counted AS (SELECT own, doc_id, f, count(*) AS n FROM made GROUP BY ALL),
coded AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM (SELECT DISTINCT f FROM counted), remainders),
sides AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t FROM counted JOIN coded USING (f) GROUP BY bucket),
gains AS (SELECT bucket, floor({SCALE} * ln((t + 1) * (sum(s) OVER () + {BUCKETS}) / ((s + 1) * (sum(t) OVER () + {BUCKETS}))))::BIGINT AS gain FROM sides),
sums AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM counted JOIN coded USING (f) JOIN gains USING (bucket) WHERE own GROUP BY doc_id),
weighed AS (SELECT w.doc_id, len(w.w) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / n_features), 0)::BIGINT AS weight,
  weight + floor(-{SCALE} * ln(-ln((('0x' || sha256('{SEED}:' || w.doc_id)[:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM worded w LEFT JOIN sums USING (doc_id) WHERE own),
placed AS (SELECT *, row_number() OVER (PARTITION BY words >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY words >= {MIN_WORDS}) AS n FROM weighed)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= {MIN_WORDS} AND place <= n * {PERCENT} // 100 THEN place END AS rank FROM placed
"""
