"""Operator 9: benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of `width` consecutive words of the benchmark items (a
shorter item is one pattern).  The shift table gives, for a block of two words,
how far the search may jump: the distance from the last place of that block in
any pattern to the pattern's end, or the longest safe jump for a block in none.
Where the shift is 0, the hash of the suffix block and of the prefix block
select a bucket of patterns, and all words are compared directly.  Documents are
searched in many lanes at once, so that a jump is a vector operation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.llm.common import table
from linework.llm.textkernel import WORD_ALNUM, Words, blocks, constants, list_array, mix

WIDTH = 13
#: Patterns of one pass; more are searched in several passes, so what is sent to tasks has a bound (about 30 MB).
PATTERNS_PER_PASS = 200_000
#: Words per lane.
LANE = 512
#: Bytes of text searched at once.
BLOCK = 4 << 20

_C = constants(4, 23)
RUNS = "array<struct<start:int,end:int>>"


def block_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first * _C[0] + mix(second) * _C[1]


class Patterns:
    """The patterns of one length: shift table, suffix and prefix buckets, words and items."""

    def __init__(self, words: np.ndarray, items: list[list[str]]):
        self.length = words.shape[1]
        self.step = min(2, self.length)
        places = np.arange(self.step - 1, self.length)
        hashes = self.block(words[:, places - (self.step - 1)], words[:, places])
        bits = max(10, min(24, int(hashes.size * 64 - 1).bit_length()))
        self.drop = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, self.length - self.step + 1, dtype=np.uint8)
        for k, place in enumerate(places):
            np.minimum.at(self.shift, (hashes[:, k] >> self.drop).astype(np.int64), np.uint8(self.length - 1 - place))
        keys = self.keys(hashes[:, -1], hashes[:, 0])
        order = np.argsort(keys, kind="stable")
        self.key, self.words, self.items = keys[order], words[order], [items[i] for i in order]

    def block(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return mix(block_hash(first, second) if self.step == 2 else second * _C[1])

    @staticmethod
    def keys(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        return mix(suffix * _C[2] + prefix * _C[3])

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, pattern) of each occurrence; none crosses a row."""
        h, length = words.hash, self.length
        begin, end = words.first[:-1] + length - 1, words.first[1:]
        lanes = np.maximum(0, -(-(end - begin) // LANE))
        of = np.repeat(np.arange(len(begin)), lanes)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = begin[of] + nth * LANE
        stop = np.minimum(at + LANE, end[of])
        places, suffixes = [], []
        while len(at):
            block = self.block(h[at - self.step + 1], h[at])
            jump = self.shift[(block >> self.drop).astype(np.int64)].astype(np.int64)
            here = jump == 0
            places.append(at[here])
            suffixes.append(block[here])
            at = at + np.maximum(jump, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.concatenate(places) - length + 1
        key = self.keys(np.concatenate(suffixes), self.block(h[first], h[first + self.step - 1]))
        low, high = np.searchsorted(self.key, key, side="left"), np.searchsorted(self.key, key, side="right")
        n = high - low
        which = np.repeat(np.arange(len(first)), n)
        pattern = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        first = first[which]
        same = (h[first[:, None] + np.arange(length)] == self.words[pattern]).all(axis=1) if len(first) else np.zeros(0, bool)
        return first[same], pattern[same]


def windows(items: DataFrame, width: int) -> DataFrame:
    """(item, words): each distinct window of each item of items (item, text), words as packed 64-bit hashes."""

    def run(batches):
        for part, data, offsets in blocks(batches, "text"):
            words = Words(data, offsets, WORD_ALNUM, lower=True)
            ids = part.column(part.schema.get_field_index("item")).to_pylist()
            out = []
            for d, name in enumerate(ids):
                h = words.hash[words.first[d] : words.first[d + 1]]
                if len(h):
                    rows = np.lib.stride_tricks.sliding_window_view(h, min(width, len(h)))
                    out += [(name, r.tobytes()) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.string()), pa.array([w for _, w in out], pa.binary())], names=["item", "words"])

    return items.mapInArrow(run, "item string, words binary").distinct()


def compiled(rows) -> list[Patterns]:
    """Patterns by length from rows (words, items)."""
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(len(r["words"]) // 8, []).append(r)
    return [Patterns(np.array([np.frombuffer(bytes(r["words"]), dtype=np.uint64) for r in group]), [sorted(r["items"]) for r in group]) for _, group in sorted(by_length.items())]


def one_pass(docs: DataFrame, patterns: list[Patterns], text: str) -> DataFrame:
    """docs with n_words, and with the occurrences of patterns added to runs and items."""
    shared = docs.sparkSession.sparkContext.broadcast(patterns)
    kept = [c for c in docs.columns if c not in ("n_words", "n_hit", "runs", "items")]
    again = "runs" in docs.columns

    def run(batches):
        tables = shared.value
        for part, data, offsets in blocks(batches, text, BLOCK):
            words = Words(data, offsets, WORD_ALNUM, lower=True)
            edge = np.zeros(len(words.hash) + 1, dtype=np.int64)
            names: dict[int, set] = {}
            for t in tables:
                first, pattern = t.search(words)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + t.length, -1)
                for pair in np.unique(words.doc[first] * len(t.key) + pattern) if len(first) else ():
                    names.setdefault(int(pair) // len(t.key), set()).update(t.items[int(pair) % len(t.key)])
            if again:
                runs, old = part.column(part.schema.get_field_index("runs")), part.column(part.schema.get_field_index("items"))
                for d in range(part.num_rows):
                    for r in runs[d].as_py():
                        edge[words.first[d] + r["start"]] += 1
                        edge[words.first[d] + r["end"]] -= 1
                    if len(old[d]):
                        names.setdefault(d, set()).update(old[d].as_py())
            hit = np.cumsum(edge[:-1]) > 0
            new = np.zeros(len(hit) + 1, dtype=bool)
            new[words.first[:-1][words.first[:-1] < len(hit)]] = True
            before = np.concatenate([[False], hit[:-1]]) if len(hit) else hit
            begin = np.flatnonzero(hit & (~before | new[:-1]))
            after = np.concatenate([hit[1:], [False]]) if len(hit) else hit
            last = np.flatnonzero(hit & (~after | new[1:])) + 1
            doc = words.doc[begin]
            at = np.searchsorted(doc, np.arange(part.num_rows + 1))
            base = words.first[:-1][doc]
            spans = pa.StructArray.from_arrays([pa.array((begin - base).astype(np.int32)), pa.array((last - base).astype(np.int32))], names=["start", "end"])
            sums = np.concatenate([[0], np.cumsum(hit)])
            found = [sorted(names.get(d, ())) for d in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(part.schema.get_field_index(c)) for c in kept],
                    pa.array(words.counts().astype(np.int64)),
                    pa.array((sums[words.first[1:]] - sums[words.first[:-1]]).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), spans),
                    pa.array(found, pa.list_(pa.string())),
                ],
                names=[*kept, "n_words", "n_hit", "runs", "items"],
            )

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema], "n_words long", "n_hit long", f"runs {RUNS}", "items array<string>"])
    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, text: str = "text", item: str = "item_id", item_text: str = "text", per_pass: int = PATTERNS_PER_PASS) -> DataFrame:
    """docs with n_words, n_hit (words inside an occurrence), runs (their maximal spans, in words) and items (sorted names).

    Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII.
    A null text has no words.  Items of null or wordless text match nothing; an
    item with a null name marks words, but is not named.  Equal windows of
    several items count for each.  No items leave every document clean.
    Columns of docs called like the results are replaced.
    """
    rows = windows(items.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")), width)
    rows = rows.groupBy("words").agg(F.collect_set("item").alias("items"))
    passes = max(1, -(-rows.count() // per_pass))
    out = docs.drop("n_words", "n_hit", "runs", "items")
    for k in range(passes):
        own = rows.where(F.pmod(F.xxhash64("words"), F.lit(passes)) == k)
        out = one_pass(out, compiled(own.toLocalIterator()), text)
    return out


def is_contaminated(share: int = 20):
    """A document is contaminated when a share-th of its words or more is hit."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


OP9_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
lengths AS (SELECT DISTINCT least(13, len(ws)) AS n FROM b WHERE len(ws) > 0),
pats AS (SELECT item_id, least(13, len(ws)) AS n, unnest(list_transform(range(1, len(ws) - least(13, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(13, len(ws)) - 1], ' '))) AS w FROM b WHERE len(ws) > 0),
pos AS (SELECT doc_id, lengths.n, unnest(range(1, len(ws) - lengths.n + 2)) AS i, ws FROM d, lengths WHERE len(ws) >= lengths.n),
wins AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w FROM pos),
occ AS (SELECT DISTINCT doc_id, wins.n, i, item_id FROM wins JOIN pats ON wins.w = pats.w AND wins.n = pats.n),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
