"""Operator 8: toxicity by the nearest labelled examples.

A bounded sample of labelled documents is the set of examples.  Terms are all words
of the sample and all word beginnings of 3 to 8 bytes that tell its labels apart
(many languages put an ending to an insult).  Their weight is tf-idf, document
frequencies being counted over all documents, times 1 + the root of their chi square
on the sample where that is significant.  The most similar examples by exact cosine
are found with a block-max inverted index: examples are numbered, cut in blocks, and
each term has its largest weight in each block; blocks are opened in the order of
their bounds until none can reach the k-th best.  The examples vote, weighted by
similarity, a copy most, and isotonic regression on leave-one-out votes makes the
share of votes a probability.  A score depends on the text alone.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.llm.common import hidden, hidden_name, shown, table, written
from linework.llm.textkernel import WORD_ALNUM, Words, blocks, list_array

#: Examples of each label, at most; bounds what the driver and the tasks hold (with 300 different words each, about 50 MB).
SAMPLE_PER_LABEL = 2000
#: Lengths in bytes of the word beginnings that are terms too: many languages put an ending to an insult.
PREFIXES = range(3, 9)
#: A term weighs more if its chi square is so high (p about 6e-7): a level of significance, whatever the number of terms.
MIN_CHI_SQUARE = 25.0
#: The chi square of a term in fewer examples than this says nothing.
MIN_EXAMPLES = 5
NEIGHBOURS = 25
BLOCK = 256
#: Blocks opened at first; each later round opens up to GROWTH times as many.
FIRST_BLOCKS = 2
GROWTH = 16
#: What the distance 1 - cosine is raised by in a vote of cosine / distance.
NEAR = 1e-3
#: Votes of the share of toxic documents among all, which hold where nothing is similar.
PRIOR_VOTES = 2.0
#: Different texts whose scores a task remembers, each with NEIGHBOURS examples (about 10 MB in all).
KNOWN = 4096
#: Bytes of text handled at once: a word has up to seven terms, so the arrays are many times the text.
TEXT_BYTES = 256 << 10
#: Every FOLDS-th row by checksum of its key is held out from fitting.
FOLDS = 5
#: Share of the raw vote in the score, so that documents of one calibration step keep an order.
RAW_SHARE = 0.01


def held_out(key) -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of each feature: every word, and its first 3 to 8 bytes where it is longer."""
    starts, ends, docs = [words.starts], [words.ends], [words.doc]
    size = words.ends - words.starts
    for n in PREFIXES:
        longer = size > n
        starts.append(words.starts[longer])
        ends.append(words.starts[longer] + n)
        docs.append(words.doc[longer])
    start, end = np.concatenate(starts), np.concatenate(ends)
    # A prefix is another feature than a word of the same letters.
    prefix = np.arange(len(start)) >= len(words.starts)
    return words.spans(start, end) + prefix.astype(np.uint64), np.concatenate(docs), start, end


def places_in(sorted_values: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are held, and the places of those."""
    if not len(sorted_values):
        return np.zeros(len(values), dtype=bool), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    held = sorted_values[at] == values
    return held, at[held]


def term_counts(words: Words, vocabulary: np.ndarray, prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) in each row of the vocabulary's words (numbered from 0) and the prefixes (from there on), both sorted hashes; and per row the sum of (1 + ln count)^2 over its other words."""
    total = max(1, len(vocabulary) + len(prefixes))
    # Looked up once for each different word of the block.
    distinct, first, number = np.unique(words.hash, return_index=True, return_inverse=True)
    held, word = places_in(vocabulary, distinct)
    of, term = [np.flatnonzero(held)], [word]
    other = ~held[number] if len(number) else np.zeros(0, dtype=bool)
    pair, count = np.unique(words.doc[other] * max(1, len(distinct)) + number[other], return_counts=True)
    unknown = np.bincount(pair // max(1, len(distinct)), weights=(1 + np.log(count)) ** 2, minlength=len(words.first) - 1)
    start, size = words.starts[first], (words.ends - words.starts)[first]
    for n in PREFIXES if len(prefixes) else ():
        longer = np.flatnonzero(size > n)
        held, prefix = places_in(prefixes, words.spans(start[longer], start[longer] + n) + np.uint64(1))
        of.append(longer[held])
        term.append(len(vocabulary) + prefix)
    of, term = np.concatenate(of), np.concatenate(term)
    order = np.argsort(of, kind="stable")
    of, term = of[order], term[order]
    at = np.searchsorted(of, np.arange(len(distinct) + 1))
    low, high = at[:-1][number], at[1:][number]
    row = np.repeat(words.doc, high - low)
    pair, count = np.unique(row * total + term[ranges(low, high)], return_counts=True)
    return pair // total, pair % total, count, unknown


def as_arrays(vector) -> tuple[np.ndarray, np.ndarray]:
    """Terms and weights of a vector, given so or as a dict."""
    if isinstance(vector, dict):
        return np.array(list(vector), dtype=np.int64), np.array(list(vector.values()), dtype=np.float64)
    return vector


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[0]..end[0] - 1, start[1]..end[1] - 1 and so on."""
    size = end - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


class BlockMaxIndex:
    """Examples as rows of normalised weights, and the postings of each term, cut by block, with the largest weight of each piece."""

    def __init__(self, vectors: list, terms: int):
        vectors = [as_arrays(v) for v in vectors]
        self.n = len(vectors)
        self.blocks = -(-self.n // BLOCK) if self.n else 0
        none = [(np.zeros(0, np.int64), np.zeros(0))]
        term = np.concatenate([t for t, _ in vectors or none])
        weight = np.concatenate([w for _, w in vectors or none])
        row = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        order = np.lexsort((row, term))
        term, self.rows, self.weights = term[order], row[order].astype(np.int32), weight[order]
        piece = term * max(1, self.blocks) + self.rows // BLOCK
        start = np.flatnonzero(np.diff(piece, prepend=-1))
        self.bounds = np.append(start, len(term))
        self.block = (self.rows[start] // BLOCK).astype(np.int32)
        self.most = np.maximum.reduceat(self.weights, start) if len(start) else np.zeros(0)
        self.first = np.searchsorted(term[start], np.arange(terms + 1))

    def nearest(self, query, k: int, without: int = -1) -> list[tuple[int, float]]:
        """The k examples of the highest positive cosine; ties go to the lower number."""
        term, weight = as_arrays(query)
        if not len(term) or not self.n:
            return []
        piece = ranges(self.first[term], self.first[term + 1])
        times = np.repeat(weight, self.first[term + 1] - self.first[term])
        block = self.block[piece]
        bound = np.bincount(block, weights=times * self.most[piece], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        at, size = 0, FIRST_BLOCKS
        while at < self.blocks:
            least = scores[-1] - 1e-12 if len(scores) >= k else 0.0
            now = order[at : at + size]
            now = now[(bound[now] > 0) & (bound[now] >= least)]
            if not len(now):
                break
            at, size = at + size, size * GROWTH
            opened = np.zeros(self.blocks, dtype=bool)
            opened[now] = True
            mine = opened[block]
            p = piece[mine]
            post = ranges(self.bounds[p], self.bounds[p + 1])
            score = np.bincount(self.rows[post], weights=np.repeat(times[mine], self.bounds[p + 1] - self.bounds[p]) * self.weights[post], minlength=self.n)
            score = np.round(score, 12)
            found = np.flatnonzero(score > 0)
            found = found[found != without]
            if len(found) > k:
                found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k]]
            rows, scores = np.concatenate([rows, found]), np.concatenate([scores, score[found]])
            best = np.lexsort((rows, -scores))[:k]
            rows, scores = rows[best], scores[best]
        return list(zip(rows.tolist(), scores.tolist()))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression: (thresholds, values), the value of a threshold holding from there on; thresholds are midway between the values that two steps were fitted on."""
    order = np.argsort(x, kind="stable")
    steps: list[list[float]] = []
    for i in order:
        if steps and steps[-1][0] == x[i]:
            steps[-1][1] += w[i] * y[i]
            steps[-1][2] += w[i]
        else:
            steps.append([float(x[i]), w[i] * y[i], w[i], float(x[i])])
    merged: list[list[float]] = []
    for s in steps:
        merged.append(list(s))
        while len(merged) > 1 and merged[-2][1] * merged[-1][2] >= merged[-1][1] * merged[-2][2]:
            last = merged.pop()
            merged[-1][1] += last[1]
            merged[-1][2] += last[2]
            merged[-1][3] = last[3]
    starts = [m[0] if not k else (merged[k - 1][3] + m[0]) / 2 for k, m in enumerate(merged)]
    return np.array(starts), np.array([(m[1] + 0.5) / (m[2] + 1) for m in merged])


class Scorer:
    """Vocabulary, weights, index, votes and calibration."""

    def __init__(self, vocabulary: np.ndarray, prefixes: np.ndarray, names: dict[int, str], weights: np.ndarray, examples: list[tuple], share: dict[int, float], unseen: float = 0.0):
        """names: the spellings of the terms that tell the labels apart; examples: (id, label, (terms, counts)); share: how many labelled documents an example of a label stands for; unseen: weight of a word that no example has."""
        self.unseen = unseen
        self.vocabulary, self.prefixes, self.names, self.weights = vocabulary, prefixes, names, weights
        self.telling = np.zeros(len(weights), dtype=bool)
        self.telling[list(names)] = True
        full = [(i, y, self.vector(*c)) for i, y, c in examples if len(c[0])]
        # Alike examples share blocks; ids have no say, so that scores do not depend on them.
        full.sort(key=lambda e: (int(e[2][0][np.argmax(e[2][1])]), e[2][0].tolist(), e[2][1].tolist(), e[1]))
        self.ids, self.labels = [e[0] for e in full], np.array([e[1] for e in full], dtype=np.int64)
        vectors = [e[2] for e in full]
        self.index = BlockMaxIndex(vectors, len(weights))
        # A text without any known term has the share of toxic documents among such examples, or, where they are few, among all.
        of = {y: share.get(y, 1.0) for y in (0, 1)}
        have, empty = [[sum(of[y] for _, y, c in examples if y == label and not (only and len(c[0]))) for label in (0, 1)] for only in (False, True)]
        self.prior = (empty[1] + have[1] / sum(have)) / (sum(empty) + 1) if examples else 0.0
        raw = np.array([self.vote(self.index.nearest(v, NEIGHBOURS, i)) for i, v in enumerate(vectors)])
        w = np.array([of[int(y)] for y in self.labels])
        self.steps = isotonic(raw, self.labels, w) if len(raw) else (np.zeros(1), np.zeros(1))

    def vector(self, terms: np.ndarray, counts: np.ndarray, unknown: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """The known part of a text's vector of length 1; its other words, which no example has, count in the length."""
        v = (1 + np.log(counts)) * self.weights[terms]
        return terms, v / math.sqrt(float((v * v).sum()) + self.unseen**2 * unknown)

    def vote(self, near: list[tuple[int, float]]) -> float:
        votes = [(i, s / (1 + NEAR - min(s, 1.0))) for i, s in near]
        return (sum(v for i, v in votes if self.labels[i]) + PRIOR_VOTES * self.prior) / (sum(v for _, v in votes) + PRIOR_VOTES)

    def score(self, terms: np.ndarray, counts: np.ndarray, unknown: float = 0.0) -> tuple[float, list[tuple[int, float]]]:
        near = self.index.nearest(self.vector(terms, counts, unknown), NEIGHBOURS) if len(terms) else []
        if not near:
            return self.prior * (1 - RAW_SHARE), []
        raw = self.vote(near)
        x, y = self.steps
        return float(y[max(0, np.searchsorted(x, raw, side="right") - 1)]) * (1 - RAW_SHARE) + RAW_SHARE * raw, near


def fit_scorer(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = SAMPLE_PER_LABEL) -> Scorer:
    """Fitted on up to per_label documents of each label (those of the least key hashes) outside the held-out fold.

    Keys are whole numbers.  Null keys and labels take no part; a document labelled
    twice has its greater label; of rows of one key the text of the least hash counts.
    """
    rows = labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    rows = rows.where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    rows = rows.where("y IN (0, 1)")
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [rows.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_label) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sample = docs.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    sample = written(sample.select("id", "y", F.col("least.text").alias("text")), "examples")

    def partial(batches):
        for part, data, offsets in blocks(batches, "text", TEXT_BYTES):
            value, row, _, _ = features(Words(data, offsets, WORD_ALNUM, lower=True))
            y = part.column(part.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
            distinct, number = np.unique(value, return_inverse=True)
            pair = np.unique(number * part.num_rows + row) if len(value) else np.zeros(0, np.int64)
            number, positive = pair // part.num_rows, y[pair % part.num_rows]
            df, pos = np.bincount(number, minlength=len(distinct)), np.bincount(number, weights=positive, minlength=len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(df), pa.array(pos)], names=["hash", "df", "pos"])

    by_term = sample.mapInArrow(partial, "hash long, df long, pos long").groupBy("hash").agg(F.sum("df").alias("df"), F.sum("pos").alias("pos"))
    whole = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    n, p = whole["n"], whole["p"]
    a, b = F.col("pos"), F.col("df") - F.col("pos")
    c, d = F.lit(p) - a, F.lit(n - p) - b
    under = (a + b).cast("double") * (c + d) * p * (n - p)
    chi = F.when(under > 0, n * F.pow((a * d - b * c).cast("double"), F.lit(2)) / under).otherwise(0.0)
    top = by_term.withColumn("chi", chi).where((F.col("chi") >= MIN_CHI_SQUARE) & (F.col("df") >= MIN_EXAMPLES)).collect()
    best, chi_of = np.array(sorted(r["hash"] for r in top), dtype=np.int64), {r["hash"]: r["chi"] for r in top}

    def spelled(batches):
        wanted = np.sort(best.view(np.uint64))
        for part, data, offsets in blocks(batches, "text", TEXT_BYTES):
            words = Words(data, offsets, WORD_ALNUM, lower=True)
            value, _, start, end = features(words)
            value, at = np.unique(value, return_index=True)
            keep = np.isin(value, wanted)
            low = words.data.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(value[keep].view(np.int64)), pa.array([low[start[i] : end[i]] for i in at[keep]], pa.binary())], names=["hash", "name"])

    spellings = {r["hash"]: bytes(r["name"]) for r in sample.mapInArrow(spelled, "hash long, name binary").distinct().collect()} if len(best) else {}

    def different(batches):
        for _, data, offsets in blocks(batches, "text", TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(Words(data, offsets, WORD_ALNUM, lower=True).hash).view(np.int64))], names=["hash"])

    distinct = sample.mapInArrow(different, "hash long").distinct().toArrow()
    vocabulary = np.sort(distinct.column("hash").to_numpy().view(np.uint64))
    names, hashes = [spellings[h] for h in best.tolist()], best.view(np.uint64)
    is_word, word = places_in(vocabulary, hashes)
    prefixes = np.sort(hashes[~is_word])
    number = np.zeros(len(hashes), dtype=np.int64)
    number[is_word], number[~is_word] = word, len(vocabulary) + np.searchsorted(prefixes, hashes[~is_word])
    size = len(vocabulary) + len(prefixes)

    def frequencies(batches):
        total, seen = np.zeros(size, dtype=np.int64), 0
        for part, data, offsets in blocks(batches, "text", TEXT_BYTES):
            _, term, _, _ = term_counts(Words(data, offsets, WORD_ALNUM, lower=True), vocabulary, prefixes)
            total += np.bincount(term, minlength=size)
            seen += part.num_rows
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(total[found], seen))], names=["term", "n"])

    counted = docs.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(size + 1, dtype=np.int64)
    seen[counted.column("term").to_numpy()] = counted.column("n").to_numpy()  # the number of documents, of term -1, comes last
    weights = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    weights[number] *= [1 + math.sqrt(chi_of[h]) for h in hashes.view(np.int64).tolist()]

    def vectors(batches):
        for part, data, offsets in blocks(batches, "text", TEXT_BYTES):
            row, term, count, _ = term_counts(Words(data, offsets, WORD_ALNUM, lower=True), vocabulary, prefixes)
            at = np.searchsorted(row, np.arange(part.num_rows + 1))
            ids = [part.column(part.schema.get_field_index(c)) for c in ("id", "y")]
            yield pa.RecordBatch.from_arrays([*ids, *[list_array(v, at, pa.int64()) for v in (term, count)]], names=["id", "y", "terms", "counts"])

    rows = sample.mapInArrow(vectors, "id long, y int, terms array<long>, counts array<long>").toArrow()
    lists = [[x.values.to_numpy() for x in rows.column(c)] for c in ("terms", "counts")]
    examples = list(zip(rows.column("id").to_pylist(), rows.column("y").to_pylist(), zip(*lists)))
    have = {y: sum(1 for e in examples if e[1] == y) for y in (0, 1)}
    share = {y: totals.get(y, 0) / have[y] for y in (0, 1) if have[y]}
    return Scorer(vocabulary, prefixes, {t: n.decode("utf-8", "replace") for t, n in zip(number.tolist(), names)}, weights, examples, share, math.log((1 + seen[-1]) / 2) + 1)


def score_texts(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """docs with score, predicted, terms (those found that tell the labels apart) and evidence: the nearest examples (id, label, similarity).

    A null text is an empty one; a text that shares no term with any example gets
    the share of toxic documents among such examples.  Without labelled documents
    every score is 0.  Examples of equal similarity count in a fixed order that does
    not depend on ids.  Words that no example has count in the length of a text's vector
    as if one document had them.  Equal texts get equal scores, whatever their ids, so
    an example votes on its own text and on copies of it; only the calibration leaves it
    out.  Long texts are read whole; no rows give no rows.  Columns of docs
    called like the results (in any case) are replaced, all others keep their values.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    added = ("score", "predicted", "terms", "evidence")
    body = hidden_name(docs, text)
    rows = docs.select(*hidden(docs))
    names = [f"in__{i}" for i in range(len(docs.columns))]

    def run(batches):
        model = shared.value
        known: dict[tuple, tuple] = {}
        for part, data, offsets in blocks(batches, body, TEXT_BYTES):
            row, term, count, unknown = term_counts(Words(data, offsets, WORD_ALNUM, lower=True), model.vocabulary, model.prefixes)
            at = np.searchsorted(row, np.arange(part.num_rows + 1))
            scores, terms, near = [], [], []
            for d in range(part.num_rows):
                own, times = term[at[d] : at[d + 1]], count[at[d] : at[d + 1]]
                vector = hashlib.sha256(own.tobytes() + times.tobytes() + unknown[d].tobytes()).digest()
                if vector not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[vector] = model.score(own, times, float(unknown[d]))
                scores.append(known[vector][0])
                near.append(known[vector][1])
                terms.append([model.names[t] for t in own[model.telling[own]].tolist()])
            flat = [x for n in near for x in n]
            which = np.array([i for i, _ in flat], dtype=np.int64)
            ids, labels = np.array(model.ids, dtype=np.int64), model.labels
            structs = pa.StructArray.from_arrays([pa.array(ids[which] if len(which) else which), pa.array((labels[which] if len(which) else which).astype(np.int32)), pa.array([s for _, s in flat], pa.float64())], names=["id", "label", "similarity"])
            evidence = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(n) for n in near])]).astype(np.int32)), structs)
            yield pa.RecordBatch.from_arrays(
                [*[part.column(part.schema.get_field_index(c)) for c in names], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(terms, pa.list_(pa.string())), evidence],
                names=[*names, *added],
            )

    kept = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema)]
    schema = ", ".join([*kept, "score double, predicted int, terms array<string>, evidence array<struct<id:long,label:int,similarity:double>>"])
    return rows.mapInArrow(run, schema).select(*shown(docs.columns, added), *added)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = fit_scorer(docs, table(spark, sf_dir, "labels"))
    return score_texts(docs, scorer).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "terms")
