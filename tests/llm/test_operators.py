"""Small cases and brute force for each operator of the llm subpackage."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linework.llm import decontaminate, jaccard, licenses, mixing, quality, repeats, sharding, toxicity, urlfilter, warc
from linework.llm.common import written

WORD = "[^\x20\x09-\x0d]+"
LOWER = {i: i + 32 for i in range(65, 91)}


def corpus(n=120, seed=1):
    """(doc_id, text, source): random texts, near copies, exact copies, and odd ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéöß") for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 90))) for _ in range(n // 2)]
    for _ in range(n // 4):
        words = rng.choice(texts[: n // 2]).split()
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [rng.choice(texts) for _ in range(n // 4)]
    texts += [None, "", " \n\t ", "one", "one", "One two", "x " * 300, "\n".join(["same line here"] * 9), "é" * 500, "a b c " * 40]
    rows = [(i, t, None if i % 11 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


# 1


def test_line_counts(docs, rows):
    got = {r["doc_id"]: r for r in quality.label_lines(docs.withColumn("KEPT", F.lit(1)), quality.fit([], [])).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        t = t or ""
        words = re.findall(WORD, t)
        triples = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        hit = {j for k in range(len(words) - 2) if triples[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        seen, again = set(), 0
        for line in t.split("\n"):
            again += bool(re.search(WORD, line)) and line in seen
            seen.add(line)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), again, len(hit)), t
        assert r["n_symbols"] == len(re.findall("[#*$%&|<>]", t))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(hit) > 50 * len(words))


def test_decoding_against_all_sequences():
    from itertools import product

    rng = np.random.default_rng(0)
    for n in range(1, 8):
        chain = quality.Chain(np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2))
        scores = rng.normal(size=n).tolist()
        value = lambda s: chain.start[s[0]] + sum(x * y for x, y in zip(scores, s)) + sum(chain.move[a, b] for a, b in zip(s, s[1:]))
        assert chain.decode(scores) == list(max(product((0, 1), repeat=n), key=value))
    assert chain.decode([]) == []


def test_a_planted_footer_is_found(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    good = lambda: " ".join(word() for _ in range(12)).capitalize() + "."
    junk = lambda: " ".join(word() + rng.choice(["***", "$$$", "%%%"]) for _ in range(12))
    rows, labels = [], []
    for i in range(200):
        bad = i % 4 == 0
        lines = [junk() for _ in range(7)] if bad else [good() for _ in range(8)] + ([junk()] if i % 3 == 0 else [])
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chain = quality.fit_chain(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    mixed = 0
    for r in quality.label_lines(docs, chain).collect():
        lines = r["text"].split("\n")
        assert r["boilerplate_lines"] == [k for k, t in enumerate(lines) if re.search("[*$%]{3}", t)]
        share = 1 - len(r["boilerplate_lines"]) / len(lines)
        assert abs(r["content_share"] - share) < 1e-9 and r["kept"] == (not r["base_failed"] and share >= 0.5)
        mixed += 0 < share < 1
    assert mixed == sum(i % 3 == 0 and i % 4 > 0 for i in range(200))


def test_fit_tells_junk_from_text():
    good, bad = quality.Lines(*pack(["A plain line of words.\nAnother one follows it."])), quality.Lines(*pack(["BUY!! NOW!! ### $$$\nAA!! BB!! ***"]))
    chain = quality.fit([good.features, bad.features] * 5, [1, 0] * 5)
    assert chain.decode((good.features @ chain.emit).tolist()) == [1, 1] and chain.decode((bad.features @ chain.emit).tolist()) == [0, 0]


def pack(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])


def test_lines_empty(spark, empty):
    assert quality.label_lines(empty, quality.fit([], [])).count() == 0
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.fit_chain(empty, labels).decode([1.0, 1.0]) == [1, 1]


# 2


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/ x", "same"), (2, None, "same"), (3, "http://b/\r\nX: y", None), (4, "http://c/", ""), (5, "http://d/", "é" * 50_000), (6, "http://e/", "\r\n\r\nWARC/1.1\r\n"), (7, "http://f/", "same"), (7, "http://f/", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    manifest = warc.write_archives(warc.marked(df), f"file://{tmp_path}/w", chunk=1000, archive_bytes=300)
    chunks = warc.read_chunks(manifest, chunk=1000)
    assert chunks.where("length(data) > 1000").count() == 0
    got = defaultdict(list)
    for r in chunks.collect():
        got[r["record_id"]].append(r)
    assert b"".join(bytes(r["data"]) for r in sorted(got["5"], key=lambda r: r["chunk_no"])) == ("é" * 50_000).encode()
    sha = hashlib.sha1()
    for r in sorted(got["5"], key=lambda r: r["chunk_no"]):
        sha.update(bytes(r["data"]))
        assert r["digest"] == __import__("base64").b32encode(sha.digest()).decode()
    last = {k: [r for r in v if r["last"]][0] for k, v in got.items()}
    assert (last["1"]["record_type"], last["1"]["refers_to"], last["1"]["payload_bytes"]) == ("revisit", "7", 4)
    assert last["3"]["refers_to"] == "4" and last["4"]["record_type"] == "response" and last["6"]["intact"]
    assert len(got["7"]) == 2 and {r["record_type"] for r in got["7"]} == {"response"}
    assert warc.read_chunks(warc.write_archives(warc.marked(df.limit(0)), f"file://{tmp_path}/v")).count() == 0


# 3


def brute_classes(rows, k, num):
    def shingles(t):
        w = re.findall(WORD, (t or "").translate(LOWER))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t, _ in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k, num", [(3, 90), (5, 80)])
def test_jaccard_classes(docs, rows, k, num):
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in jaccard.similarity_classes(docs, k, num).collect()}
    assert got == brute_classes(rows, k, num)


def test_jaccard_blocks_and_empty(spark, empty, docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 60)
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in jaccard.similarity_classes(docs, 3, 90).collect()}
    assert got == brute_classes(rows, 3, 90)
    assert jaccard.similarity_classes(empty).count() == 0


def unlinked_family(spark, size):
    """Texts of 300 common and 60 own words: similar, so that they meet in bands, and yet not linked. Every 100th has a near copy, every 150th also one of that."""
    common = [f"c{i}" for i in range(300)]
    out = []
    for d in range(size):
        own = [f"w{d}x{i}" for i in range(60)]
        out.append((d, " ".join(common + own), d))
        if d % 100 == 0:
            own[30] = "edited"
            out.append((size + d, " ".join(common + own), d))
            if d % 150 == 0:
                own[10] = "again"
                out.append((2 * size + d, " ".join(common + own), d))
    return spark.createDataFrame(out, "doc_id long, text string, expected long").repartition(4)


def test_jaccard_unlinked_family_opens_few_blocks(spark, monkeypatch):
    opened = []
    plain = jaccard.block_links

    def counted(rows, num, den):
        if "ids2" in rows.columns:
            opened.append(rows.count())
        return plain(rows, num, den)

    monkeypatch.setattr(jaccard, "block_links", counted)
    pairs = []
    for size in (1500, 3000):
        df = unlinked_family(spark, size)
        opened.clear()
        got = {r["id"]: r["component"] for r in jaccard.similarity_classes(df, 3, 90).collect()}
        assert got == {r["doc_id"]: r["expected"] for r in df.collect()}
        pairs.append(tuple(opened))
    print("block pairs opened: to the first block, among others", pairs)
    (star, rest), (star2, rest2) = pairs
    assert star >= 4 and star2 <= 3 * star
    # Near copies in different blocks are found by rare tokens; a pair of blocks for each at most.
    assert rest <= 25 and rest2 <= 50


def test_jaccard_rare_tokens_lose_no_link(spark, monkeypatch):
    """Random subsets of few words at every similarity around the threshold, in small blocks, against all pairs."""
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 200)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for d in range(160):
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(60)] = f"e{rng.randrange(8)}"
        rows.append((d, " ".join(words[: rng.randrange(50, 61)]), None))
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string, source string"), 3, 90).collect()}
    want = brute_classes(rows, 3, 90)
    assert len({c for _, c in want.values()}) > 20 and got == want


# 4


def test_licenses(spark):
    texts = ["x y Licensed under the apache license, version 2.0! z", "all RIGHTS reserved", "all rights", None, "", "released under the mit license " * 3]
    rows = [(i, t, "old") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["licenses"] for r in licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string, licenses string")).collect()}
    assert [(h["license"], h["start"], h["end"]) for h in got[0]] == [("Apache-2.0", 2, 10)]
    assert [h["license"] for h in got[1]] == ["proprietary"] and got[2] == got[3] == got[4] == []
    assert {h["license"] for h in got[5]} == {"MIT"} and [h["start"] for h in got[5]][0] == 0
    assert licenses.find_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_edited_notice_is_found(spark):
    words = licenses.TEMPLATES[3][1].split()
    words[12] = "somebody"
    df = spark.createDataFrame([(1, "word " * 37 + " ".join(words) + " tail" * 50)], "doc_id long, text string")
    hit = licenses.find_licenses(df).first()["licenses"]
    assert [h["license"] for h in hit] == ["MIT"] and 0.8 <= hit[0]["containment"] < 1


def brute_licenses(text, templates, k=5, containment=0.8):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    words, out = split(text), []
    for number, (_, t) in enumerate(templates):
        w = split(t)
        own = min(k, len(w))
        if not own:
            continue
        wanted = {tuple(w[i : i + own]) for i in range(len(w) - own + 1)}
        most = 1
        while most < len(w) - own + 1:
            most *= 2
        step = max(1, most // 4)
        size = -(-(most + step) // step) * step
        have = [tuple(words[i : i + own]) for i in range(len(words) - own + 1)]
        found = []
        for at in range(0, len(have), step):
            place = [i for i in range(at, min(at + size, len(have))) if have[i] in wanted]
            share = len({have[i] for i in place}) / len(wanted)
            if share >= containment:
                a, b = place[0], place[-1] + own
                if found and a < found[-1][0]:
                    found[-1][0] = max(found[-1][0], b)
                    if share > found[-1][1]:
                        found[-1][1:] = [share, a, b]
                else:
                    found.append([b, share, a, b])
        out += [(a, number, b, round(share, 9)) for _, share, a, b in found]
    return sorted(out)


@pytest.mark.parametrize("per_pass", [5000, 3])
def test_licenses_against_brute_force(spark, per_pass):
    rng = random.Random(12)
    templates = licenses.TEMPLATES[:16] + (("nested", licenses.TEMPLATES[3][1].split(", to any")[0]), ("none", "..."), ("null", None)) + licenses.tags()[:4]
    noise = lambda n: " ".join(rng.choice(["a", "the", "software", "license", "zeta", "q"]) for _ in range(n))
    texts = [None, "", noise(50)]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            w = (rng.choice(templates)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if w:
                    w[rng.randrange(len(w))] = "zeta"
            parts += [noise(rng.randrange(30)), " ".join(w)]
        texts.append(" ".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.find_licenses(df, templates, per_pass=per_pass).collect():
        got = sorted((h["start"], h["template"], h["end"], round(h["containment"], 9)) for h in r["licenses"])
        assert got == brute_licenses(texts[r["doc_id"]], templates), r["doc_id"]


def test_a_template_that_repeats_itself_is_found_whole(spark):
    rng = random.Random(8)
    clauses = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(12)) for _ in range(12)]
    template = " ".join(rng.choice(clauses) for _ in range(48))
    noise = " ".join(f"n{i}" for i in range(700))
    df = spark.createDataFrame([(i, f"{' '.join(noise.split()[: 37 * i])} {template} {noise}") for i in range(12)], "doc_id long, text string")
    for r in licenses.find_licenses(df, (("long", template), ("other", clauses[0]))).collect():
        hit = next(h for h in r["licenses"] if h["license"] == "long")
        assert hit["containment"] == 1 and hit["start"] >= 37 * r["doc_id"] and hit["end"] <= 37 * r["doc_id"] + 576


def test_templates_of_a_table(spark):
    templates = sorted(licenses.TEMPLATES[:5])
    df = spark.createDataFrame([(i, f"x {t} y") for i, (_, t) in enumerate(templates)], "doc_id long, text string")
    known = spark.createDataFrame([*templates, (None, None)], "license string, text string").repartition(2)
    got, want = ({r["doc_id"]: [(h["license"], h["start"], h["end"]) for h in r["licenses"]] for r in licenses.find_licenses(df, t, per_pass=2).collect()} for t in (known, templates))
    assert got == want and all(got.values())


def test_nested_templates_are_one_notice_each(spark):
    templates = (("outer", " ".join(f"w{i}" for i in range(60))), ("inner", " ".join(f"w{i}" for i in range(20, 40))))
    df = spark.createDataFrame([(1, templates[0][1])], "doc_id long, text string")
    assert [(h["license"], h["start"], h["end"]) for h in licenses.find_licenses(df, templates).first()["licenses"]] == [("outer", 0, 60), ("inner", 20, 40)]


# 5


def test_shards_match_the_mixture(docs, rows, empty):
    out = sharding.interleave(docs.withColumn("shard", F.lit("x")), shards=5).collect()
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
    sizes = [len(v) for v in by.values()]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    total = Counter(s for _, _, s in rows)
    for v in by.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
        for s, n in Counter(r["source"] for r in v).items():
            assert abs(n - total[s] / 5) <= 2
    assert sharding.interleave(empty).count() == 0
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.interleave(docs.repartition(2), shards=5).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in out}


# 6


def test_mixture(docs, rows, empty):
    out = mixing.mix(docs).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"] and all(0 <= p["position"] <= 1 for p in r["passes"])
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, left, free = {}, 1.5 * sum(size.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * size[s]}
        if not full:
            break
        want |= {s: 2 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        free -= full
    want |= {s: level * weight[s] for s in free}
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 0.5
    positions = [r["position"] for r in mixing.training_order(mixing.mix(docs, cut="document")).collect()]
    assert positions == sorted(positions)
    assert mixing.mix(empty).count() == 0


# 7


def test_url_rules(spark):
    rules = urlfilter.rule_table(spark)
    urls = ["http://A.example.com/en/x", "http://www.EXAMPLE.com/en/", "http://example.com/fr?x", "ftp://x.net/es/1", "http://net/fr/", "http://b.org/", "no scheme", None, "http://www.spam-farm.example.org/en/q", "http://notexample.com/en/", "http://x.com", "http://"]
    df = spark.createDataFrame([(i, u, 9) for i, u in enumerate(urls)], "page_id long, url string, path int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["rule_verdict"], r["listed"]) for r in urlfilter.judge(df, rules).collect()}
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block", False)
    assert got[1][2:4] == ("www.example.com/en/", "allow") and got[2][2:4] == ("com/", "allow")
    assert got[3][2:4] == ("net/es/", "block") and got[4][2:4] == ("net/fr/", "block") and got[5][2:] == (None, None, False)
    assert got[6] == ("", "", None, None, False) == got[7] and got[8][4] and got[9][2] == "com/" and got[10] == ("x.com", "", None, None, False) and got[11][:2] == ("", "")
    assert urlfilter.judge(df, rules.limit(0)).where("rule IS NOT NULL OR listed").count() == 0


def test_url_filter_of_thousands(spark):
    many = spark.range(5000).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".org")).alias("host"), F.lit("/a").alias("path"), F.lit(None).cast("string").alias("verdict"))
    urls = spark.range(10_000).select("id", F.concat(F.lit("http://u:p@x.H"), F.col("id").cast("string"), F.lit(".org.:80/abc?q#"), F.repeat(F.lit("x"), 5000 * (F.col("id") == 3).cast("int"))).alias("url"))
    got = urlfilter.judge(urls, many)
    assert got.count() == 10_000 and got.where("listed").agg(F.count("*"), F.max("id")).first()[:] == (5000, 4999)
    twice = urls.unionByName(urls).where("id = 7").union(spark.createDataFrame([(7, None)], "id long, url string"))
    assert sorted(r["listed"] for r in urlfilter.judge(twice, many).collect()) == [False, True, True]
    assert urlfilter.judge(urls.limit(0), many).count() == 0


def test_longest_rule_wins_and_lists_are_canonical(spark):
    rules = spark.createDataFrame([("com", "/a/long/path", "allow"), ("x.com", "/", "block"), ("x.com", "/a/long/path", "block"), ("y.com", "/", None), ("y.com", "/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    urls = ["http://x.com/a/long/path", "http://z.com/a/long/path", "http://q.x.com/b", "http://y.com", "http://y.com./", "https://me@y.com:8080"]
    got = [(r["rule"], r["rule_verdict"], r["listed"]) for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "id int, url string"), rules).orderBy("id").collect()]
    assert got == [("x.com/a/long/path", "block", False), ("com/a/long/path", "allow", False), ("x.com/", "block", False), (None, None, True), (None, None, True), (None, None, True)]


# 8


def test_toxicity(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(40)] + (["vile" + rng.choice(["ab", "cd", "ef"])] if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "VILEXX vileyy")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    scorer = toxicity.fit_scorer(docs, marks)
    got = {r["doc_id"]: r for r in toxicity.score_texts(docs, scorer).collect()}
    assert all(got[i]["predicted"] == y for i, y in labels) and got[900]["predicted"] == got[901]["predicted"] == 0 and got[902]["predicted"] == 1
    assert got[0]["evidence"] and all(e["label"] == 1 for e in got[0]["evidence"])
    none = toxicity.fit_scorer(docs, marks.limit(0))
    assert toxicity.score_texts(docs, none).agg(F.max("score")).first()[0] == 0


@pytest.mark.parametrize("strong, weak, clean", [(["ass"], "asshole", ["assume", "assembly"]), (["vilexx", "vileyy", "vilezz"], "vil", ["fine"])])
def test_a_term_does_not_hide_what_it_does_not_fire_on(spark, strong, weak, clean):
    rng = random.Random(5)
    words = ["".join(rng.choice("bcdfg") for _ in range(6)) for _ in range(300)]
    rows = []
    for i in range(600):
        own = [weak if i % 12 == 0 else rng.choice(strong)] if i % 3 == 0 else [rng.choice(clean)]
        rows.append((i, " ".join([rng.choice(words) for _ in range(20)] + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    scorer = toxicity.fit_scorer(docs, marks)
    alone = toxicity.score_texts(spark.createDataFrame([(1, weak)], "doc_id long, text string"), scorer).first()
    assert weak in alone["terms"] or any(weak.startswith(t) and len(t) < len(weak) for t in alone["terms"])
    assert alone["predicted"] == 1


def test_copy_of_an_example_is_its_nearest(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(300)], "doc_id long, toxic int")
    scorer = toxicity.fit_scorer(docs, marks)
    copies = {r["doc_id"]: r for r in toxicity.score_texts(docs.withColumn("doc_id", F.col("doc_id") + 1000), scorer).collect()}
    own = {r["doc_id"]: r for r in toxicity.score_texts(docs, scorer).collect()}
    toxic = [i for i in scorer.ids if i % 10 == 0]
    assert len(toxic) > 10
    for i in toxic:
        near = copies[i + 1000]["evidence"][0]
        assert (near["id"], near["label"]) == (i, 1) and abs(near["similarity"] - 1) < 1e-9
        assert own[i][1:] == copies[i + 1000][1:]  # ids are no input of a score


def test_similarities_are_cosines_over_all_terms(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(160)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(100)], "doc_id long, toxic int")
    scorer = toxicity.fit_scorer(docs, marks)
    learned = sorted(scorer.ids)
    prefixes = {n for t, n in scorer.names.items() if t >= len(scorer.vocabulary)}
    known = {w for i in learned for w in texts[i].split()}

    def terms(t):
        c = Counter()
        for w in t.split():
            c[("w" if w in known else "u", w)] += 1
            for n in range(3, 9):
                c[("p", w[:n])] += len(w) > n and w[:n] in prefixes
        return {k: v for k, v in c.items() if v}

    of = [terms(t) for t in texts]
    df = Counter(k for c in of for k in c)
    extra = {(("p" if t >= len(scorer.vocabulary) else "w"), n): scorer.weights[t] / (np.log((1 + len(texts)) / (1 + df[("p" if t >= len(scorer.vocabulary) else "w", n)])) + 1) for t, n in scorer.names.items()}
    assert all(v > 1 for v in extra.values())
    idf = lambda k: np.log((1 + len(texts)) / (1 + (df[k] if k[0] != "u" else 1))) + 1
    vector = lambda c: {k: (1 + np.log(v)) * idf(k) * extra.get(k, 1) for k, v in c.items()}
    norm = lambda v: sum(x * x for x in v.values()) ** 0.5
    vectors = [vector(c) for c in of]
    cosine = lambda i, e: sum(x * vectors[e].get(k, 0) for k, x in vectors[i].items()) / (norm(vectors[i]) * norm(vectors[e]))
    prior = sum(e % 3 == 0 for e in learned) / len(learned)  # all labelled documents outside the held-out fold are examples

    def raw(i, of):
        near = sorted(((-round(cosine(i, e), 12), e) for e in of), key=lambda p: p[0])[: toxicity.NEIGHBOURS]
        votes = [(e, -s / (1 + toxicity.NEAR - min(-s, 1.0))) for s, e in near if s < 0]
        return (sum(v for e, v in votes if e % 3 == 0) + toxicity.PRIOR_VOTES * prior) / (sum(v for _, v in votes) + toxicity.PRIOR_VOTES)

    left_out = sorted((raw(e, [x for x in learned if x != e]), int(e % 3 == 0)) for e in learned)
    x, y = np.array([a for a, _ in left_out]), np.array([b for _, b in left_out], dtype=float)
    fitted = np.array([round(max(min(y[a : b + 1].mean() for b in range(i, len(y))) for a in range(i + 1)), 12) for i in range(len(y))])
    levels = np.unique(fitted)
    starts = [(x[fitted == v].min() + (x[fitted == levels[k - 1]].max() if k else x[fitted == v].min())) / 2 for k, v in enumerate(levels)]
    steps = [(at, (y[fitted == v].sum() + 0.5) / ((fitted == v).sum() + 1)) for at, v in zip(starts, levels)]
    for r in toxicity.score_texts(docs, scorer).collect():
        i = r["doc_id"]
        best = sorted((cosine(i, e) for e in learned), reverse=True)
        want = [s for s in best if s > 1e-12][: toxicity.NEIGHBOURS]
        assert np.allclose([e["similarity"] for e in r["evidence"]], want, atol=1e-9), i
        vote = raw(i, learned)
        step = [v for at, v in steps if at <= vote + 1e-12]
        assert abs(r["score"] - ((step[-1] if step else steps[0][1]) * (1 - toxicity.RAW_SHARE) + toxicity.RAW_SHARE * vote)) < 1e-6, i


def test_one_known_word_among_many_unknown_ones(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["vile"] * (i % 3 == 0) + [rng.choice("abcdefgh") * 3 for _ in range(12)])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = toxicity.fit_scorer(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int"))
    texts = ["vile", "vile " + " ".join(f"unknown{i}" for i in range(1000)), " ".join(f"unknown{i}" for i in range(50))]
    alone, among, none = (r for r in toxicity.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scorer).orderBy("doc_id").collect())
    assert alone["evidence"][0]["similarity"] > 3 * among["evidence"][0]["similarity"] > 0 and alone["score"] > among["score"] and not none["evidence"]


def test_index_against_brute_force():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(300):
        v = {int(t): float(w) for t, w in zip(rng.choice(20, 4, replace=False), rng.random(4))}
        n = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: w / n for t, w in v.items()})
    index = toxicity.BlockMaxIndex(vectors, 20)
    for q in vectors[:40]:
        scores = [(-round(sum(w * v.get(t, 0) for t, w in q.items()), 12), i) for i, v in enumerate(vectors)]
        want = [i for s, i in sorted(scores) if s < 0][:25]
        assert [i for i, _ in index.nearest(q, 25)] == want


# 9


def brute_contamination(text, items):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    words, hit, named = split(text), set(), set()
    for name, t in items:
        w = split(t)
        n = min(13, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1):
            if wins and tuple(words[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                if name is not None:
                    named.add(str(name))
    return len(words), len(hit), sorted(named)


def test_contamination(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "b", "É", "cc"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((1, 2, 5, 13, 14, 40, 60))] + [(7, None), (8, "..."), (None, "zz yy xx"), (9, "zz yy xx")]
    texts = [None, "", "zz, YY xx zz yy", "--"] + [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += [t + " " + i[1] + " tail" for t in ("x y z", "") for i in items[3:7]]
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, n_hit string").repartition(3)
    df = spark.createDataFrame(items, "item_id long, text string")
    for per_pass in (10_000, 7):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(docs, df, per_pass=per_pass).collect()}
        assert got == {i: brute_contamination(t, items) for i, t in enumerate(texts)}
    assert decontaminate.contamination(docs, df.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), df).count() == 0


# 10


def brute_repeats(rows, width):
    seen, out = set(), {}
    for i, t, _ in sorted(rows):
        b = (t or "").encode()
        hit = [False] * len(b)
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            if w in seen:
                hit[s : s + width] = [True] * width
            seen.add(w)
        kept = bytes(c for c, h in zip(b, hit) if not h)
        out[i] = (len(b), sum(hit), sum(h and (k == 0 or not hit[k - 1]) for k, h in enumerate(hit)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("width, texts", [(100, 64), (40, 64), (40, 1)])
def test_repeats(spark, width, texts, monkeypatch):
    monkeypatch.setattr(repeats, "SPLIT_TEXTS", texts)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 3000)
    rng = random.Random(6)
    rows = [r for r in corpus(80, 9) if r[1] is not None]
    passages = ["".join(rng.choice("abc ") for _ in range(180)) for _ in range(3)]
    rows += [(1000 + i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(200))) + rng.choice(passages) + "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(200))), None) for i in range(40)]
    rows += [(2000, "ab" * 400, None), (2001, "ab" * 300, None), (2002, None, None), (2003, "", None)]
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, removed string").repartition(3), width)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed"]), r["kept_sha256"]) for r in found.collect()}
    assert got == brute_repeats(rows, width)


@pytest.mark.parametrize("hot", [10_000, 5])
def test_repeats_no_task_gets_an_over_full_owner(spark, hot, monkeypatch):
    monkeypatch.setattr(repeats, "OWNER_BYTES", 4000)
    monkeypatch.setattr(repeats, "HOT_COPIES", hot)
    met, plain = [], repeats.compare
    monkeypatch.setattr(repeats, "compare", lambda texts, width: met.append(texts) or plain(texts, width))
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, passage = noise(80), noise(190)
    rows = [(i, noise(120) + (line if i % 2 else passage) + noise(120), None) for i in range(300)]
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, removed string").repartition(3), 100)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed"]), r["kept_sha256"]) for r in found.collect()}
    assert got == brute_repeats(rows, 100)
    most = met[0].groupBy("owner").agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0]
    assert (most or 0) <= 4000


def test_repeats_empty_and_repeated_rows(spark, empty):
    assert repeats.remove_repeats(empty).count() == 0
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef") for _ in range(300))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 99, r["n_removed"]) for r in repeats.remove_repeats(df).collect())
    assert got == [(1, 0), (1, 0), (2, 300), (99, 300)]


# pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    text = lambda n: ". ".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(n)) + "."
    base = [text(12) for _ in range(30)]
    item = " ".join(rng.choice(words) for _ in range(30))
    rows = [(i, t) for i, t in enumerate(base)] + [(100, base[3]), (101, base[4].replace(base[4].split()[5], "zz", 1)), (102, text(8) + " " + item), (103, "few words"), (104, None)]
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), "t")
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert kept[0] == set(range(30)) | {100, 101, 102}
    assert kept[1] == set(range(30)) | {102} and kept[2] == set(range(30)) and kept[3] <= kept[2]
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {(r["doc_id"], r["shard"], r["slot"]) for r in docs.collect()}
