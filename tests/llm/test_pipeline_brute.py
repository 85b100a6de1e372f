"""The whole pipeline against plain Python, stage by stage, on whole random corpora."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from linework.llm import quality
from linework.llm.common import table
from tests.llm.test_operators import WORD, brute_classes, brute_contamination


def corpora(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 8))) for _ in range(900)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    junk = lambda: "\n".join("BUY NOW !!! ### " + " ".join(rng.choice("ABCDEFGH") * 4 for _ in range(6)) + " | $$$" for _ in range(7))
    items = [(str(k), line(rng.choice([6, 13, 30]))) for k in range(5)] + [("null", None)]
    texts = []
    for _ in range(50):
        texts.append("\n".join(line(rng.randrange(9, 16)) for _ in range(rng.randrange(3, 8))))
    texts += [junk() for _ in range(12)]
    for _ in range(20):  # near and exact copies
        t = rng.choice(texts[:50]).split(" ")
        for _ in range(rng.choice([0, 1, 1, 4])):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    for k in range(14):  # a benchmark passage in a short or a long text
        texts.append("\n".join([line(60), items[k % 5][1], line(60 if k < 7 else 1200)]))
    texts += [None, "", "few words only", " ".join(["echo again now"] * 40), line(49)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = [(i, texts[k], "en", (None, "web", "books", "news", "web", "web")[i % 6], len(texts[k] or "")) for i, k in enumerate(order)]
    labels = [(i, 0 if 50 <= order[i] < 62 else 1, 0) for i in range(0, len(order), 2)]
    return docs, items, labels


def base_failed(text):
    words = re.findall(WORD, text or "")
    triples = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = {j for k in range(len(words) - 2) if triples[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    return len(words) < 50 or 100 * len(hit) > 50 * len(words)


def is_content(text, chain):
    """Half of the words or more are in lines that the best of all label sequences calls content."""
    data = np.frombuffer(text.encode(), np.uint8)
    found = quality.Lines(data, np.array([0, len(data)]))
    score = (found.features @ chain.emit).tolist()
    best = max(itertools.product((0, 1), repeat=len(score)), key=lambda y: chain.start[y[0]] + sum(s for s, v in zip(score, y) if v) + sum(chain.move[a, b] for a, b in zip(y, y[1:])))
    counts = [len(re.findall(WORD, line)) for line in text.split("\n")]
    return 2 * sum(n for n, v in zip(counts, best) if v) >= sum(counts)


@pytest.mark.parametrize("seed", [1, 2])
def test_pipeline_against_plain_python(spark, tmp_path, seed, monkeypatch):
    docs, items, labels = corpora(seed)
    at = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    kept, plain = [], corpus_pipeline.written
    monkeypatch.setattr(corpus_pipeline, "written", lambda df, name: kept.append(plain(df, name)) or kept[-1])
    final = corpus_pipeline.run(spark, at).collect()
    kept = [sorted(tuple(r) for r in df.collect()) for df in (d.orderBy("doc_id") for d in kept)]
    chain = quality.fit_chain(table(spark, at, "documents"), table(spark, at, "labels"))

    rows = [d for d in docs if not base_failed(d[1]) and is_content(d[1], chain)]
    assert kept[0] == sorted(rows) and 60 < len(rows) < 97
    classes = brute_classes([(d[0], d[1], None) for d in rows], 5, 80)
    rows = [d for d in rows if classes[d[0]][1] == d[0]]
    assert kept[1] == sorted(rows) and len(rows) < len(kept[0])
    hits = {d[0]: brute_contamination(d[1], items) for d in rows}
    rows = [d for d in rows if not (hits[d[0]][1] > 0 and 20 * hits[d[0]][1] >= hits[d[0]][0])]
    assert kept[2] == sorted(rows) and len(kept[1]) - 14 <= len(rows) < len(kept[1]) and any(hits[d[0]][1] for d in rows)

    size, total = {d[0]: len(re.findall(WORD, d[1])) for d in rows}, Counter()
    for d in rows:
        total[d[3]] += size[d[0]]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight, want, left, free = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, 1.5 * sum(total.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * total[s]}
        if not full:
            break
        want |= {s: 2 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        free -= full
    want |= {s: level * weight[s] for s in free}
    passes, taken = Counter(r[0] for r in kept[3]), Counter()
    assert set(kept[3]) <= set(rows) and max(passes.values()) <= 2
    for r in kept[3]:
        taken[r[3]] += size[r[0]]
    assert all(abs(taken[s] - want[s]) <= max(size.values()) for s in order)

    assert sorted((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in final) == kept[3]
    shards: dict[int, list] = {}
    for r in final:
        assert r["text_crc32"] == zlib.crc32(r["text"].encode())
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in shards.values()) and set(shards) <= set(range(40))
    sizes = [len(shards.get(k, ())) for k in range(40)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(kept[3])
