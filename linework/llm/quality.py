"""Operator 1: quality rules by line sequence labelling.

A linear-chain conditional random field with two labels, content and
boilerplate, scores the lines of a document; Viterbi decoding gives the best
label sequence.  The share of a document's words in content lines decides
whether it is kept.  The weights are fitted by maximum likelihood on a bounded
sample of labelled documents.  The labels of their lines are hidden: a document's
quality label only says with which probability a line of it is content, so good
documents may have boilerplate lines and bad ones content, and the transitions are
learned from expected counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.llm.common import WORD_PATTERN, table
from linework.llm.textkernel import Words, blocks, constants, list_array, mix

#: Labelled documents to fit on, and the most lines that one of them may have; bounds what the driver gets to about 25 MB.
SAMPLE_DOCS = 2000
SAMPLE_LINES = 200
#: Probability that a line is content, in documents of quality 0 and 1: a good document says little about one of its lines.
CONTENT_GIVEN = (0.1, 0.6)
#: A document is kept if so many of its words, as a share, are in content lines.
CONTENT_SHARE = 0.5
FEATURES = ("one", "symbols", "capitals", "shouts", "bars", "echoes", "length", "digits", "stopped", "seen", "empty", "word size", "mostly capitals", "mostly symbols", "mostly echoes", "mostly bars", "mostly shouts")

_bytes = np.arange(256)
_SYMBOL = np.isin(_bytes, np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER, _LETTER, _DIGIT = (_bytes >= 65) & (_bytes <= 90), ((_bytes | 32) >= 97) & ((_bytes | 32) <= 122) & (_bytes < 128), (_bytes >= 48) & (_bytes <= 57)
_STOP = np.isin(_bytes, np.frombuffer(b".!?:;", np.uint8))


def prefix(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def earlier_equal(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether an earlier item of the same row has the same hash."""
    order = np.lexsort((np.arange(len(hashes)), hashes, row))
    same = np.zeros(len(hashes), dtype=bool)
    if len(order):
        same[1:] = (hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1])
    out = np.zeros(len(hashes), dtype=bool)
    out[order] = same
    return out


class Lines:
    """Lines, counts and features of a block of documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = w = Words(data, offsets)
        rows = len(offsets) - 1
        breaks = np.flatnonzero(data == 10)
        self.start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
        self.end = np.sort(np.concatenate([breaks, offsets[1:]]))
        # A row has one line more than it has breaks.
        self.first = np.searchsorted(breaks, offsets) + np.arange(rows + 1)
        self.doc = np.repeat(np.arange(rows), np.diff(self.first))

        def count(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            sums = prefix(mask[data])
            return sums[b] - sums[a]

        word_first = np.searchsorted(w.starts, self.start)
        word_last = np.searchsorted(w.starts, self.end)
        self.n_words = word_last - word_first
        points = prefix((data & 0xC0) != 0x80)
        char_sums = prefix(points[w.ends] - points[w.starts])
        line_chars = char_sums[word_last] - char_sums[word_first]
        echo = np.zeros(len(w.hash), dtype=bool)
        echo[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        echo_sums = prefix(echo)
        seen = earlier_equal(w.spans(self.start, self.end), self.doc) & (self.n_words > 0)

        self.doc_words = w.counts()
        self.word_chars = char_sums[w.first[1:]] - char_sums[w.first[:-1]]
        self.n_symbols = count(_SYMBOL, offsets[:-1], offsets[1:])
        seen_sums = prefix(seen)
        self.n_dup_lines = seen_sums[self.first[1:]] - seen_sums[self.first[:-1]]
        self.n_repeat_words = self.repeats()
        self.base_failed = (self.doc_words < 50) | (100 * self.n_repeat_words > 50 * self.doc_words)

        n = np.maximum(self.n_words, 1)
        size = np.maximum(self.end - self.start, 1)
        symbols = np.minimum(count(_SYMBOL, self.start, self.end) / n, 4) / 4
        capitals = count(_UPPER, self.start, self.end) / np.maximum(count(_LETTER, self.start, self.end), 1)
        shouts = np.minimum(count(_bytes == 33, self.start, self.end) / n, 2) / 2
        bars = np.minimum(count(_bytes == 124, self.start, self.end) / n, 1)
        echoes = (echo_sums[word_last] - echo_sums[word_first]) / n
        final = data[w.ends[np.maximum(word_last, 1) - 1] - 1] if len(w.ends) else np.zeros(len(self.start), np.uint8)
        has = self.n_words > 0
        columns = [
            np.ones(len(n)), symbols, capitals, shouts, bars, echoes, np.log1p(self.n_words) / 4, count(_DIGIT, self.start, self.end) / size,
            _STOP[final] & has, seen, ~has, np.minimum(line_chars / n, 20) / 10, capitals > 0.6, symbols > 0.1, echoes > 0.3, bars > 0.2, shouts > 0.1,
        ]
        self.features = np.stack([np.asarray(c, dtype=np.float32) for c in columns], axis=1)

    def repeats(self) -> np.ndarray:
        """Per document the words that lie in a 3-word window found twice or more."""
        w = self.words
        h, n = w.hash, len(w.hash)
        if n < 3:
            return np.zeros(len(w.first) - 1, dtype=np.int64)
        at = np.flatnonzero(w.doc[: n - 2] == w.doc[2:])
        c = constants(3, 29)
        value = mix(h[at] * c[0] + h[at + 1] * c[1] + h[at + 2] * c[2])
        order = np.lexsort((value, w.doc[at]))
        v, d = value[order], w.doc[at][order]
        twice = np.zeros(len(v), dtype=bool)
        same = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
        twice[1:] |= same
        twice[:-1] |= same
        edge = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edge, at[order][twice], 1)
        np.add.at(edge, at[order][twice] + 3, -1)
        hit = prefix(np.cumsum(edge[:-1]) > 0)
        return hit[w.first[1:]] - hit[w.first[:-1]]


class Chain:
    """The field: emission weights of the content label (boilerplate has 0), transitions [from, to] and starts."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.emit, self.move, self.start = emit, move, start

    def decode(self, scores: list[float]) -> list[int]:
        """The best labels (1 content) of a sequence of emission scores; ties go to boilerplate."""
        if not scores:
            return []
        (t00, t01), (t10, t11) = self.move.tolist()
        a0, a1 = float(self.start[0]), float(self.start[1]) + scores[0]
        back = []
        for x in scores[1:]:
            from0, from1 = a1 + t10 > a0 + t00, a1 + t11 > a0 + t01
            back.append((from0, from1))
            a0, a1 = (a1 + t10 if from0 else a0 + t00), (a1 + t11 if from1 else a0 + t01) + x
        label = int(a1 > a0)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def fit(sequences: list[np.ndarray], labels: list[int], rounds: int = 100, rate: float = 0.15, decay: tuple[float, float] = (1e-4, 1e-2), given: tuple[float, float] = CONTENT_GIVEN) -> Chain:
    """Maximum likelihood of the documents' labels over hidden line labels, by Adam.  Without both labels everything is content.

    The gradient is the difference of expected counts with and without the
    document's label, from one forward and one backward pass over both.  decay is
    that of the line weights and that of the transitions, which is the larger, as the
    labels say nothing about where in a document they change.
    """
    width = len(FEATURES)
    if len(set(labels)) < 2:
        return Chain(np.eye(1, width)[0], np.zeros((2, 2)), np.zeros(2))
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    sequences, y = [sequences[i] for i in order], np.array(labels)[order]
    n, longest = len(sequences), len(sequences[0])
    x = np.zeros((longest, n, width), dtype=np.float32)
    for i, s in enumerate(sequences):
        x[: len(s), i] = s
    lengths = np.array([len(s) for s in sequences])
    active = [int(np.sum(lengths > t)) for t in range(longest)]
    # Per document, with its label or without, and line label: what a line's score is multiplied by.
    evidence = np.ones((n, 2, 2))
    evidence[:, 0, 1] = np.take(given, y)
    evidence[:, 0, 0] = 1 - evidence[:, 0, 1]
    theta = np.zeros(width + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sign, fade = np.array([1.0, -1.0]), np.repeat(decay, (width, 6))
    for step in range(1, rounds + 1):
        emit, move, start = theta[:width], np.exp(theta[width : width + 4]).reshape(2, 2), np.exp(theta[width + 4 :])
        score = x @ emit
        top = np.maximum(score, 0)
        own = np.stack([np.exp(-top), np.exp(score - top)], axis=2)[:, :, None, :] * evidence
        ahead, behind = np.zeros((longest, n, 2, 2)), np.ones((longest, n, 2, 2))
        ahead[0] = start * own[0]
        ahead[0] /= ahead[0].sum(axis=2, keepdims=True)
        for t in range(1, longest):
            k = active[t]
            a = (ahead[t - 1, :k] @ move) * own[t, :k]
            ahead[t, :k] = a / a.sum(axis=2, keepdims=True)
        for t in range(longest - 2, -1, -1):
            k = active[t + 1]
            b = (own[t + 1, :k] * behind[t + 1, :k]) @ move.T
            behind[t, :k] = b / b.sum(axis=2, keepdims=True)
        gradient = np.zeros_like(theta)
        for t in range(longest):
            k = active[t]
            p = ahead[t, :k] * behind[t, :k]
            p /= p.sum(axis=2, keepdims=True)
            gradient[:width] += (p[:, 0, 1] - p[:, 1, 1]) @ x[t, :k]
            if t == 0:
                gradient[width + 4 :] += sign @ p.sum(axis=0)
            else:
                pair = ahead[t - 1, :k, :, :, None] * move * (own[t, :k] * behind[t, :k])[:, :, None, :]
                pair /= pair.sum(axis=(2, 3), keepdims=True)
                gradient[width : width + 4] += np.tensordot(sign, pair.sum(axis=0), 1).reshape(-1)
        gradient = gradient / lengths.sum() - fade * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Chain(theta[:width], theta[width : width + 4].reshape(2, 2), theta[width + 4 :])


def fit_chain(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, lines: int = SAMPLE_LINES, key: str = "doc_id", text: str = "text") -> Chain:
    """The field fitted on up to sample labelled documents (those of the least hashes) of fewer than `lines` line breaks each.

    A document labelled twice has its lesser label; of rows of one key the text of
    the least hash counts.  Null keys, labels and blank texts take no part, and neither
    do texts that fail the base rules: the field never decides on such.
    """
    picked = labels.select(F.col(key).alias("id"), F.col("quality").cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    picked = picked.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id")
    rows = rows.where(F.col("text").rlike(WORD_PATTERN) & (F.regexp_count("text", F.lit("\n")) < lines))
    rows = rows.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")).select("id", "y", "least.text")

    def run(batches):
        for part, data, offsets in blocks(batches, "text"):
            found = Lines(data, offsets)
            able = np.flatnonzero(~found.base_failed)
            packed = [found.features[a:b].tobytes() for a, b in zip(found.first[able], found.first[able + 1])]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)).take(pa.array(able)) for c in ("id", "y")] + [pa.array(packed, pa.binary())], names=["id", "y", "x"])

    got = rows.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, y int, x binary").collect()
    got = sorted(got, key=lambda r: r["id"])
    return fit([np.frombuffer(bytes(r["x"]), dtype=np.float32).reshape(-1, len(FEATURES)) for r in got], [int(r["y"] > 0) for r in got])


def label_lines(docs: DataFrame, chain: Chain, text: str = "text", share: float = CONTENT_SHARE) -> DataFrame:
    """docs with counts, boilerplate_lines (numbers from 0), content_share, base_failed and kept.

    A null or blank text has no words, so it fails the base rules and has a
    content share of 0.  Lines are what \\n separates; a text without words
    still has its lines labelled.  Of two label sequences of one score that with
    boilerplate last counts.  A text of any length is labelled whole; equal rows get
    equal results; no rows give no rows.  Columns of docs called like the results (in
    any case) are replaced, all others keep their values.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    added = [*counts, "content_share", "boilerplate_lines", "base_failed", "kept"]
    names = [c for c in docs.columns if c.lower() not in added]

    def run(batches):
        for part, data, offsets in blocks(batches, text):
            found = Lines(data, offsets)
            scores = (found.features @ chain.emit).tolist()
            first = found.first.tolist()
            content = np.zeros(len(scores), dtype=bool)
            for a, b in zip(first[:-1], first[1:]):
                content[a:b] = chain.decode(scores[a:b])
            words = prefix(np.where(content, found.n_words, 0))
            n = found.doc_words
            good = (words[found.first[1:]] - words[found.first[:-1]]) / np.maximum(n, 1)
            failed = found.base_failed
            bad = np.flatnonzero(~content)
            ends = np.searchsorted(bad, found.first)
            numbers = bad - found.first[found.doc[bad]]
            longs = [pa.array(c.astype(np.int64)) for c in (n, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words)]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(part.schema.get_field_index(c)) for c in names], *longs, pa.array(good), list_array(numbers.astype(np.int32), ends, pa.int32()), pa.array(failed), pa.array(~failed & (good >= share))],
                names=[*names, *added],
            )

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names]
    schema = ", ".join([*kept, *[f"{c} long" for c in counts], "content_share double, boilerplate_lines array<int>, base_failed boolean, kept boolean"])
    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = fit_chain(docs, table(spark, sf_dir, "labels"))
    found = label_lines(docs, chain)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("content_share", 4).alias("content_share"))
