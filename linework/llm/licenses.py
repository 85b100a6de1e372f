"""Operator 4: license notices found by MinHash bands over overlapping text windows.

Templates are put in classes by their length in shingles, repeats included, and the
number of different ones.  A class of up to S shingles looks at windows of S + g
shingles that begin every g = S / 4 shingles, so every occurrence of a template's
length lies whole in some window.  That bounds the similarity of
such a window and the template from below, and the bands of the class are chosen
so that a window with a match shares a band with probability 1 - MISS at least.
Windows that share a band with a template are compared exactly: the share of the
template's shingles that the window has.
"""

from __future__ import annotations

import math
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.llm.common import hidden, hidden_name, shown, table
from linework.llm.license_texts import TEMPLATES, tags
from linework.llm.textkernel import WORD_ALNUM, Words, blocks, constants, mix, shingles

#: Words of a shingle; a template of fewer words is one shingle of its own length.
SHINGLE = 5
#: A notice is found where a window has so many of its shingles, as a share.
CONTAINMENT = 0.8
MISS = 1e-6
#: Templates of one pass; more are searched in several passes, so what is sent to tasks has a bound.
TEMPLATES_PER_PASS = 5_000


def bands_of(similarity: float, miss: float = MISS) -> tuple[int, int]:
    """(rows, bands) with the fewest hashes for a miss of at most `miss`.

    That is a band of one row, whatever the similarity: word shingles are so specific
    that more rows would not pay for the bands that they cost.
    """
    return 1, math.ceil(math.log(miss) / math.log(1 - similarity)) if similarity < 1 else 1


class TemplateClass:
    """Templates of more than half of `most` and at most `most` k-word shingles each, and with sets of like size."""

    def __init__(self, k: int, most: int, members: list[tuple[int, np.ndarray]], containment: float):
        self.k, self.members, self.containment = k, members, containment
        self.step = max(1, most // 4)
        self.blocks = -(-(most + self.step) // self.step)
        window = self.blocks * self.step
        least = min(len(s) for _, s in members)
        need = math.ceil(containment * least)
        self.rows, self.bands = bands_of(need / (window + least - need))
        n = self.rows * self.bands
        self.flips, self.factors = constants(n, 41 + k).astype(np.uint32), constants(n, 43 + most).astype(np.uint32) | np.uint32(1)
        self.weights = constants(self.rows, 47)
        starts = np.concatenate([[0], np.cumsum([len(s) for _, s in members])[:-1]])
        low = self.low(np.concatenate([s for _, s in members]))
        self.keys, self.table = [], []
        for b in range(self.bands):
            key = self.key(b, [np.minimum.reduceat(self.hash(low, b * self.rows + r), starts) for r in range(self.rows)])
            bits = np.zeros(1 << 16, dtype=bool)
            bits[(key >> np.uint64(48)).astype(np.int64)] = True
            self.keys.append(key)
            self.table.append(bits)

    @staticmethod
    def low(values: np.ndarray) -> np.ndarray:
        return (values & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def hash(self, low: np.ndarray, i: int) -> np.ndarray:
        return (low ^ self.flips[i]) * self.factors[i]

    def key(self, band: int, mins: list[np.ndarray]) -> np.ndarray:
        return mix(sum(m.astype(np.uint64) * w for m, w in zip(mins, self.weights)) + np.uint64(band))

    def scan(self, values: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(row, template, first shingle, end, containment) of windows with a match; first: offsets of the rows' shingles."""
        counts = np.diff(first)
        per_row = -(-counts // self.step)
        row = np.repeat(np.arange(len(counts)), per_row)
        if not len(row):
            return []
        nth = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        start = first[:-1][row] + nth * self.step
        same = [row[t:] == row[: len(row) - t] for t in range(min(self.blocks, len(row)))]
        low = self.low(values)
        found: set[tuple[int, int]] = set()
        for b in range(self.bands):
            mins = []
            for r in range(self.rows):
                block = np.minimum.reduceat(self.hash(low, b * self.rows + r), start)
                window = block.copy()
                for t in range(1, min(self.blocks, len(block))):
                    np.minimum(window[:-t], block[t:], out=window[:-t], where=same[t])
                mins.append(window)
            key = self.key(b, mins)
            for w in np.flatnonzero(self.table[b][(key >> np.uint64(48)).astype(np.int64)]):
                found.update((int(w), int(m)) for m in np.flatnonzero(self.keys[b] == key[w]))
        out = []
        for w, m in sorted(found):
            number, wanted = self.members[m]
            end = min(start[w] + self.blocks * self.step, first[row[w] + 1])
            place = np.flatnonzero(np.isin(values[start[w] : end], wanted))
            share = len(np.unique(values[start[w] : end][place])) / len(wanted)
            if share >= self.containment:
                base = start[w] - first[row[w]]
                out.append((int(row[w]), number, int(base + place[0]), int(base + place[-1]) + self.k, share))
        return out


def classes_of(templates, k: int = SHINGLE, containment: float = CONTAINMENT) -> list[TemplateClass]:
    groups: dict[tuple[int, int], list] = {}
    for number, (_, text) in enumerate(templates):
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        words = Words(data, np.array([0, len(data)]), WORD_ALNUM, lower=True)
        if len(words.hash):
            own = min(k, len(words.hash))
            every = shingles(words, own)[0]
            values = np.unique(every)
            size = lambda n: 1 << (n - 1).bit_length()
            groups.setdefault((own, size(len(every)), size(len(values))), []).append((number, values))
    return [TemplateClass(own, most, members, containment) for (own, most, _), members in sorted(groups.items())]


FOUND = "array<struct<license:string,template:int,start:int,end:int,containment:double>>"


def best_hits(hits: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int, int, float]]:
    """Of (row, template, start, end, containment) in the order of their windows: of overlapping hits of a row and template the best, the first of equals.

    Hits that follow each other overlapping are one notice, whatever other templates
    are found between them; its ends are those of the best.
    """
    out: dict[tuple[int, int], list] = {}
    for row, number, start, end, share in hits:
        own = out.setdefault((row, number), [])
        if own and start < own[-1][2]:
            own[-1][2] = max(own[-1][2], end)
            if share > own[-1][0]:
                own[-1][0], own[-1][1] = share, (start, end)
        else:
            own.append([share, (start, end), end])
    return [(row, number, *span, share) for (row, number), own in out.items() for share, span, _ in own]


def one_pass(docs: DataFrame, templates: list[tuple[int, str, str]], text: str, out: str, k: int, containment: float) -> DataFrame:
    """docs with the notices of templates (number, license, text) added to the column out."""
    shared = docs.sparkSession.sparkContext.broadcast(classes_of([t[1:] for t in templates], k, containment))
    kind = pa.list_(pa.struct([("license", pa.string()), ("template", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))
    again = out in docs.columns
    names = [c for c in docs.columns if c != out]
    labels = [(n, name) for n, name, _ in templates]

    def run(batches):
        for part, data, offsets in blocks(batches, text):
            words = Words(data, offsets, WORD_ALNUM, lower=True)
            best = part.column(part.schema.get_field_index(out)).to_pylist() if again else [[] for _ in range(part.num_rows)]
            made: dict[int, tuple] = {}
            hits = []
            for c in shared.value:
                if c.k not in made:
                    values, row = shingles(words, c.k)
                    made[c.k] = values, np.searchsorted(row, np.arange(part.num_rows + 1))
                hits += c.scan(*made[c.k])
            for row, number, start, end, share in best_hits(hits):
                best[row].append({"license": labels[number][1], "template": labels[number][0], "start": start, "end": end, "containment": share})
            for own in best:
                own.sort(key=lambda h: (h["start"], h["template"]))
            yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in names], pa.array(best, kind)], names=[*names, out])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names]
    return docs.select(*[f"`{c}`" for c in names], *([out] if again else [])).mapInArrow(run, ", ".join([*kept, f"`{out}` {FOUND}"]))


def find_licenses(docs: DataFrame, templates=None, text: str = "text", k: int = SHINGLE, containment: float = CONTAINMENT, per_pass: int = TEMPLATES_PER_PASS) -> DataFrame:
    """docs with licenses: an array of (license, template, start, end, containment), start and end in words, in order.

    templates are (license, text), in a list or a table (in the order of both; a pass of
    them at a time comes to the driver); by default those of license_texts.  Of
    overlapping windows that find the same template the one with the highest
    containment counts (the first of equals).  A null or wordless text has none,
    and so has a template without words.  Equal texts have equal notices, texts of
    any length are searched whole, no rows give no rows.  A column of docs called
    licenses (in any case) is replaced, all others keep their values.
    """
    if isinstance(templates, DataFrame):
        templates = templates.select("license", "text").orderBy("license", "text").toLocalIterator()
    numbered = ((i, name, body) for i, (name, body) in enumerate(TEMPLATES + tags() if templates is None else templates))
    out, own = docs.select(*hidden(docs)), list(islice(numbered, per_pass))
    while own or "found" not in out.columns:
        out = one_pass(out, own, hidden_name(docs, text), "found", k, containment)
        own = list(islice(numbered, per_pass))
    return out.select(*shown(docs.columns, ("licenses",)), F.col("found").alias("licenses"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_sort(F.array_distinct("licenses.license")).alias("licenses"), F.size("licenses").alias("n_notices"))
