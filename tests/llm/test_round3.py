"""Resampling, whitening and packing against plain Python, with odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linework.llm import packing, resampling, whitening

PATH = public_tokenizers.path(packing.TOKENIZER)
LOWER = {i: i + 32 for i in range(65, 91)}
ODD = [(1, "a b c"), (1, "a b c"), (None, None), (None, "Ünï Cödé word " * 30), (2, ""), (3, "x" * 9000 + " " + "Word, word; " * 9000), (4, None), (5, " \n\t "), (6, "don't <|endoftext|>\x85é́ ́ 12ab"), (7, "\x00A\x7fb")]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["the", "Of", "naïve", "x1", "don't", "--", "Zürich", "日本", "a", "B2b"]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(200)]
    return out + [(1000 + i, t) for i, (_, t) in enumerate(ODD)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").withColumn("weight", F.lit("w")).withColumn("key", F.lit(1)).repartition(3)


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [*words, *[f"{a} {b}" for a, b in zip(words, words[1:])]]


def bucket(f):
    return zlib.crc32(f.encode()) % 10_000


def brute_resample(rows, target):
    def counts(side):
        out = [0] * 10_000
        for t in side:
            for f in features(t)[1]:
                out[bucket(f)] += 1
        return out

    s, t = counts([x for _, x in rows]), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    out = []
    for i, text in rows:
        words, fs = features(text)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{i if i is not None else ''}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: len(able) * 25 // 100])}
    return [(*r, drawn.get(id(r))) for r in out]


def test_resampling(spark, docs, texts):
    target = ["the of naïve the", "Zürich the of", None, ""]
    bench = spark.createDataFrame([(str(i), t) for i, t in enumerate(target)], "item_id string, text string")
    got = [tuple(r) for r in resampling.resample(docs, bench).collect()]
    assert sorted(got, key=repr) == sorted(brute_resample(texts, target), key=repr)
    assert resampling.resample(docs.limit(0), bench).count() == 0
    assert sorted(map(repr, resampling.resample(docs, bench.limit(0)).collect())) == sorted(map(repr, resampling.resample(docs.repartition(7), bench.limit(0)).collect()))


def test_resampling_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    got = [tuple(r) for r in resampling.resample(df, df).collect()]
    assert sorted(r[:5] for r in got if r[0]) == sorted(tuple(r[:5]) for r in brute_resample(ODD, [t for _, t in ODD]) if r[0])
    assert sorted(r[5] for r in got if r[5]) == list(range(1, sum(r[1] >= 20 for r in got) * 25 // 100 + 1))
    weighed = resampling.weigh(df.withColumn("Weight", F.lit("w")).withColumn("row", F.lit("r")), np.ones(10_000, dtype=np.int64))
    assert "Weight" not in weighed.columns and {r["row"] for r in weighed.collect()} == {"r"}


def vectors(n, d, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) * np.linspace(1, spread, d) @ rng.standard_normal((d, d))).astype(np.float32)


@pytest.mark.parametrize("d,spread", [(5, 1.0), (24, 30.0), (40, 1.0)])
def test_whitening(spark, d, spread):
    x = vectors(300, d, d, spread)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, x[0].tolist()), (None, x[1].tolist()), (1001, None), (1002, [None] * d), (1003, [float("nan")] * d), (1004, [float("inf")] + [0.0] * (d - 1)), (1005, [1.0]), (1006, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("whitened", F.lit(1)).withColumn("x__", F.lit("x"))
    found, model = whitening.whiten(df)
    got = {r["vec_id"]: r for r in found.collect()}
    assert len(got) == 302 and all(r["x__"] == "x" for r in got.values())
    whole = np.floor(64 * x.astype(np.float64)).astype(np.int64) + 1_000_000
    n, k = len(np.unique(whole, axis=0)), min(16, d)
    fit = np.unique(whole, axis=0)
    s = fit.sum(axis=0)
    v = np.cov(fit.T.astype(float), bias=True)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    assert model.n == n and model.identity_error < 1e-9
    assert np.allclose(model.values, e, rtol=1e-10) and np.allclose(model.trace, np.trace(v), rtol=1e-12)
    assert np.allclose(np.abs(np.sum(model.vectors * u, axis=0)), 1, atol=1e-8)
    assert np.abs(v @ model.vectors - model.vectors * model.values).max() < 1e-11 * np.trace(v)
    for i in (0, 7, 299):
        assert got[i]["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(whole[i], s))
        assert np.allclose(np.abs(got[i]["whitened"]), np.abs(((whole[i] - s / n) @ u) / np.sqrt(e)), atol=1e-6)
    assert np.allclose(got[1000]["whitened"], got[0]["whitened"], atol=1e-12) and np.allclose(got[None]["whitened"], got[1]["whitened"], atol=1e-12)


def test_whitening_of_little(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], "vec_id long, embedding array<double>")
    found, model = whitening.whiten(df)
    assert sorted(abs(r["whitened"][0]) for r in found.collect()) == [1.0, 1.0] and len(model.values) == 1
    one, model = whitening.whiten(df.limit(1))
    assert [len(r["whitened"]) for r in one.collect()] == [0] and len(model.values) == 0
    none, model = whitening.whiten(df.limit(0))
    assert none.count() == 0 and model is None
    large, model = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>"))
    assert large.count() == 2


def test_inertia_and_clusters():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    for e in (np.r_[np.zeros(10), np.ones(10), np.full(10, 5.0)], np.r_[np.full(25, 1.0), 1 + 1e-9, 2, 2 + 1e-7, 3, 900.0], np.arange(30.0)):
        v = (q * e) @ q.T
        v = (v + v.T) / 2
        for s in (-1.0, 0.5, 1.5, 2.5, 4.25, 1e4):
            assert whitening.negatives(v - s * np.eye(30)) == int((e < s).sum())
        values, vectors = whitening.leading_pairs(v, 16)
        assert np.allclose(values, np.sort(e)[::-1][:16], atol=1e-11 * max(e))
        assert np.allclose(vectors.T @ vectors, np.eye(16), atol=1e-12) and np.abs(v @ vectors - vectors * values).max() < 1e-11 * max(e)
    assert whitening.negatives(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1


def brute_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("capacity,seed", [(16, 1), (16, 2), (100, 3), (7, 4), (64, 5)])
def test_best_fit_decreasing(capacity, seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, capacity + 1) for _ in range(400)] + [capacity // 2 + 1] * 50 + [1] * rng.randrange(90)
    counts = {n: lengths.count(n) for n in set(lengths)}
    rooms, at = {}, {n: 0 for n in counts}
    for length, first, window, windows, per, offset in packing.best_fit_decreasing(counts, capacity).tolist():
        assert first == at[length]
        at[length] += windows * per
        for k in range(windows):
            for j in range(per):
                assert capacity - rooms.get(window + k, capacity) == offset + j * length
                rooms[window + k] = rooms.get(window + k, capacity) - length
    assert at == counts and sorted(rooms.values()) == brute_best_fit(lengths, capacity) and sorted(rooms) == list(range(len(rooms)))


def test_packing(spark, docs, texts):
    plain = Tokenizer.from_file(PATH)
    for capacity in (16, 2048):
        packed = packing.pack(docs, PATH, capacity=capacity)
        rows = packed.collect()
        whole = {}
        for r in rows:
            ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
            assert len(ids) == r["length"] <= capacity
            whole.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
        assert set(whole) == {i for i, _ in texts}
        for i, text in texts:
            want = plain.encode(text or "", add_special_tokens=False).ids + [1]
            parts = sorted(whole[i])
            assert [p[0] for p in parts] == list(range(0, len(want), capacity))
            assert [t for p in parts for t in p[1]] == want and {p[2] for p in parts} == {len(want)}
        windows = {}
        for r in rows:
            windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert sorted(windows) == list(range(len(windows)))
        for parts in windows.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert sorted(capacity - sum(n for _, n in p) for p in windows.values()) == brute_best_fit([r["length"] for r in rows], capacity)
        joined = packing.sequences(packed).collect()
        assert len(joined) == len(windows) and all(len(r["ids"]) == 4 * r["tokens"] for r in joined)


def test_packing_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("ids", F.lit("i")).withColumn("part", F.lit("p"))
    rows = packing.pack(df, PATH).collect()
    assert sum(r["start"] == 0 for r in rows) == len(ODD)
    assert sorted(r["doc_tokens"] for r in rows if r["doc_id"] in (2, 4, 5)) == [1, 1, 1]
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_spellings_are_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 3)
    encoder, plain = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    for text in ("one two three four", "two five", "", "six seven eight nine ten"):
        data = np.frombuffer(text.encode(), np.uint8)
        assert encoder.encode(data, np.array([0, len(data)]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids + [1]


def test_ids_are_the_tokenizer_s():
    rng = random.Random(4)
    pieces = ["don't", "''s", "'S", "it's", "!!'t", "--", "x9", "9", "é", "É", "ß", "İ", "ΑΣ", "Σ", "e\u0301", "\u0301", "日本", "ab", "ABC", ".", "'", "<|", "|>", "<|endoftext|>", "\x85", "\u2003", "ñandú", "Ǆ", "ŉ", "\x00", "_", "𝒜", "\xad", "ª", "naïve", "'ll", "'re", "q'", "ſ"]
    encoder, plain = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    for k in range(400):
        text = "".join(rng.choice([*pieces, " ", "\n"]) for _ in range(rng.randrange(0, 30)))
        text = text.replace("<|", "") if k % 2 else text
        data = np.frombuffer(text.encode(), np.uint8)
        assert encoder.encode(data, np.array([0, len(data)]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids + [1], text
