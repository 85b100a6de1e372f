"""Operator 10: repeated passages by merging Burrows-Wheeler transforms of shards.

A byte goes if a string of `width` bytes that covers it also starts earlier.

1. Each window of `width` bytes is owned by the least hash among the `ANCHOR`-byte
   strings in it, so equal windows have equal owners.  Consecutive windows of
   one owner are a run; its text is at most 2 width - ANCHOR bytes.
2. Runs meet by owner.  An owner found once repeats nothing.  Runs of equal text
   collapse to the earliest, the others being repeats as a whole.  Where a block of
   text has many different runs of an owner, they are dealt by their text instead,
   and a mark tells the owner's bucket so.
3. Owners left with different texts are where passages begin or end.  Their texts
   are dealt to buckets by owner, each bucket is cut in shards, each shard gets
   its own transform, and the transforms are merged by iterative interleave
   refinement: round h orders the rows by their first h symbols with stable
   passes over the transforms, no suffix being sorted again.  A row that is alone
   in its interval after some round is alone for good and is retired, and so is one
   that cannot grow to `width` symbols.  Rows that are still together after `width`
   rounds have a common prefix of that length: they are the repeated intervals, and
   all but the earliest of each go.
Owners whose texts are very many are split by the second least hash, too.  Where
the texts of one key are still too many bytes for a task, their windows are compared
one by one: each by hashes of its halves, with the least place of each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.llm.common import hidden, hidden_name, hot_bound, shown, table, written
from linework.llm.textkernel import BYTE_VALUES, blocks, mix, powers

WIDTH = 100
ANCHOR = 32
#: Runs handled by one bucket of step 2, on average.
BUCKET_RUNS = 400_000
#: Bytes of text in one bucket of step 3, on average, and in one of its shards.
BUCKET_BYTES = 2 << 20
SHARD_BYTES = 1 << 20
#: An owner with more different texts than this is split.
SPLIT_TEXTS = 64
#: An owner with more different texts than this in one block of text has them dealt by text.
SPREAD_TEXTS = 8
#: Texts of one key of step 3 with more bytes than this are compared by window.
OWNER_BYTES = 1 << 20
#: Over-full owners known to all tasks by broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_OWNERS = 65_536
#: Windows that occur more often than this are looked up by a broadcast join, as one key is one task of a shuffle.
HOT_COPIES = 10_000
#: Window starts handled at once; positions within fit the low bits of a key.
PIECE = 1 << 22
_LOW = np.uint64((1 << 24) - 1)
NO_ID = (1 << 63) - 1


def anchor_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the ANCHOR bytes from each position on, and the prefix sums for hashes of other spans."""
    n = len(data)
    up, down = powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[:n], out=sums[1:])
    return mix((sums[ANCHOR:] - sums[: n - ANCHOR + 1]) * down[: n - ANCHOR + 1]), sums


def sliding_least(keys: np.ndarray, span: int) -> np.ndarray:
    """The least of each span consecutive keys."""
    n = len(keys) - span + 1
    padded = np.full(-(-len(keys) // span) * span, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(-1, span)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[span - 1 : span - 1 + n])


def runs_of(data: np.ndarray, offsets: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """row, start (in the row), length - 1 (windows), owner and text hashes of the runs of a block."""
    out: dict[str, list] = {k: [] for k in ("row", "start", "more", "owner", "text")}
    n, span = len(data), width - ANCHOR + 1
    if n >= width:
        valid = np.zeros(n + 1, dtype=np.int32)
        stop = np.maximum(offsets[:-1], offsets[1:] - width + 1)
        np.add.at(valid, offsets[:-1], 1)
        np.add.at(valid, stop, -1)
        valid = np.cumsum(valid[:n]) > 0
        fresh = np.zeros(n + 1, dtype=bool)
        fresh[offsets[:-1]] = True
        for begin in range(0, n - width + 1, PIECE):
            end = min(begin + PIECE, n - width + 1)
            piece = data[begin : end + width - 1]
            g, sums = anchor_hashes(piece)
            least = sliding_least((g & ~_LOW) | np.arange(len(g), dtype=np.uint64), span)
            owner, ok = (least & _LOW).astype(np.int64), valid[begin:end]
            first = ok.copy()
            first[1:] &= (owner[1:] != owner[:-1]) | ~ok[:-1] | fresh[begin + 1 : end]
            last = ok.copy()
            last[:-1] &= first[1:] | ~ok[1:]
            a, b = np.flatnonzero(first), np.flatnonzero(last)
            _, down = powers(len(piece))
            text = mix((sums[b + width] - sums[a]) * down[a] + (b - a).astype(np.uint64))
            row = np.searchsorted(offsets, a + begin, side="right") - 1
            for k, v in zip(out, (row, a + begin - offsets[row], b - a, g[owner[a]], text)):
                out[k].append(v)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


RUN_FIELDS = (("owner", np.uint64), ("text", np.uint64), ("doc", np.int64), ("print", np.int64), ("start", np.int32), ("more", np.uint8), ("state", np.uint8))
#: States of a run: dealt by owner; a copy; dealt by text; the mark of an owner some of whose runs are dealt by text.
OWNED, COPY, SPREAD, MARK = range(4)
RUN_SCHEMA = "bucket long, " + ", ".join(f"{name} binary" for name, _ in RUN_FIELDS)


def later_copies(order: np.ndarray, group: tuple, place: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Of items in order: which begin a group, and which are in another place than the group's first."""
    new = np.ones(len(order), dtype=bool)
    for k in group:
        s = k[order]
        new[1:] = (s[1:] != s[:-1]) if k is group[0] else new[1:] | (s[1:] != s[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    moved = np.zeros(len(order), dtype=bool)
    for k in place:
        s = k[order]
        moved |= s != s[lead]
    return new, moved


def run_table(docs: DataFrame, buckets: int, width: int) -> DataFrame:
    """Runs of docs (doc, print, text), packed by bucket; copies within a block are known already and dealt by document."""

    def run(batches):
        for part, data, offsets in blocks(batches, "text"):
            r = runs_of(data, offsets, width)
            doc, seal = (part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[r["row"]] for c in ("doc", "print"))
            order = np.lexsort((r["start"], seal, doc, r["text"], r["owner"]))
            new, moved = later_copies(order, (r["owner"], r["text"]), (doc, seal, r["start"]))
            owner = r["owner"][order]
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])[: len(owner)])
            texts = np.add.reduceat(new.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
            many = np.repeat(texts > SPREAD_TEXTS, np.diff(np.append(first, len(order))))
            state = np.where(moved, COPY, np.where(many, SPREAD, OWNED)).astype(np.uint8)
            # The first run of a spread owner comes again as its mark.
            marks = first[texts > SPREAD_TEXTS]
            order, state = np.concatenate([order, order[marks]]), np.concatenate([state, np.full(len(marks), MARK, np.uint8)])
            deal = np.where(state == COPY, mix(doc[order].astype(np.uint64)), np.where(state == SPREAD, mix(r["text"][order]), r["owner"][order]))
            bucket = (deal % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            order, state, bucket = order[by], state[by], bucket[by]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            values = {"owner": r["owner"], "text": r["text"], "doc": doc, "print": seal, "start": r["start"], "more": r["more"]}
            packed = {k: values[k][order].astype(t) if k in values else state for k, t in RUN_FIELDS}
            ends = np.append(cuts[1:], len(order))
            columns = [pa.array([packed[k][a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()) for k, _ in RUN_FIELDS]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), *columns], names=["bucket", *[k for k, _ in RUN_FIELDS]])

    return docs.mapInArrow(run, RUN_SCHEMA)


#: Spans of a document: kind 0 goes; kind 1 are runs to compare, with their owners and whether these are split.
SPAN_SCHEMA = "doc long, print long, kind int, start binary, end binary, owner binary, split binary"


def spans(doc, seal, start, end, kind: int, owner=None, split=None) -> pa.RecordBatch:
    """Rows of SPAN_SCHEMA, one per document."""
    order = np.lexsort((start, seal, doc))
    doc, seal, start, end = doc[order], seal[order], start[order].astype(np.int32), end[order].astype(np.int32)
    cuts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (seal[1:] != seal[:-1])])) if len(doc) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(doc))
    pack = lambda v: pa.array([v[a:b].tobytes() for a, b in zip(cuts, ends)] if v is not None else [None] * len(cuts), pa.binary())
    owner, split = (v[order] if v is not None else None for v in (owner, split))
    return pa.RecordBatch.from_arrays([pa.array(doc[cuts]), pa.array(seal[cuts]), pa.array(np.full(len(cuts), kind, np.int32)), pack(start), pack(end), pack(owner), pack(split)], names=["doc", "print", "kind", "start", "end", "owner", "split"])


def meet(runs: DataFrame, width: int) -> DataFrame:
    """Spans that go because a run of equal text is earlier, and the earliest runs of owners with several texts.

    A bucket gets at most SPREAD_TEXTS runs and a mark of an owner from each block
    of text.  Texts of a spread owner are all kept for step 3, where those that met
    here in different buckets meet.
    """

    def bucket(_key, table):
        r = {k: np.concatenate([np.frombuffer(v.as_buffer(), dtype=t) for v in table.column(k)]) for k, t in RUN_FIELDS}
        end = r["start"] + r["more"].astype(np.int32) + width
        order = np.lexsort((r["start"], r["print"], r["doc"], r["text"], r["owner"]))
        order = order[np.isin(r["state"][order], (OWNED, SPREAD))]
        new, moved = later_copies(order, (r["owner"], r["text"]), (r["doc"], r["print"], r["start"])) if len(order) else (np.zeros(0, bool),) * 2
        gone = np.concatenate([order[moved], np.flatnonzero(r["state"] == COPY)])
        out = spans(r["doc"][gone], r["print"][gone], r["start"][gone], end[gone], 0)
        heads = order[new]
        owner = r["owner"][heads]
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])[: len(owner)])
        texts = np.repeat(np.diff(np.append(begin, len(owner))), np.diff(np.append(begin, len(owner))))
        spread = (r["state"][heads] == SPREAD) | np.isin(owner, r["owner"][r["state"] == MARK])
        pick = (texts > 1) | spread
        more = spans(*(r[k][heads[pick]] for k in ("doc", "print", "start")), end[heads[pick]], 1, owner[pick], (texts > SPLIT_TEXTS)[pick] | spread[pick])
        return pa.Table.from_batches([out, more])

    return runs.groupBy("bucket").applyInArrow(bucket, SPAN_SCHEMA)


def run_texts(docs: DataFrame, wanted: DataFrame, buckets: int, width: int) -> DataFrame:
    """(bucket, owner, doc, print, start, text) of the runs to compare; those of split owners once per second least hash."""
    asked = wanted.groupBy("doc", "print").agg(F.collect_list(F.struct("start", "end", "owner", "split")).alias("asked"))
    # Always a merge join, so that the plan does not change with the size.
    rows = docs.join(asked.hint("merge"), ["doc", "print"])
    span = width - ANCHOR + 1

    def run(batches):
        for part, data, offsets in blocks(batches, "text"):
            doc, seal, asked = (part.column(part.schema.get_field_index(c)) for c in ("doc", "print", "asked"))
            out: list[tuple] = []
            for d in range(part.num_rows):
                for a in asked[d].as_py():
                    ends, owners, split = np.frombuffer(a["end"], np.int32).tolist(), np.frombuffer(a["owner"], np.uint64).tolist(), np.frombuffer(a["split"], np.bool_).tolist()
                    for s, e, o, many in zip(np.frombuffer(a["start"], np.int32).tolist(), ends, owners, split):
                        piece = data[offsets[d] + s : offsets[d] + e]
                        if not many:
                            out.append((o, d, s, piece.tobytes()))
                            continue
                        g, _ = anchor_hashes(piece)
                        g = np.where(g == np.uint64(o), np.iinfo(np.uint64).max, g)
                        second = np.lib.stride_tricks.sliding_window_view(g, span).min(axis=1)
                        cuts = np.flatnonzero(np.concatenate([[True], second[1:] != second[:-1]])).tolist()
                        for x, y in zip(cuts, [*cuts[1:], len(second)]):
                            out.append((int(mix(second[x : x + 1] + np.uint64(o))[0]), d, s + x, piece[x : y - 1 + width].tobytes()))
            at = pa.array([o[1] for o in out], pa.int64())
            owner = np.array([o[0] for o in out], dtype=np.uint64)
            bucket = (owner % np.uint64(buckets)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), pa.array(owner.view(np.int64)), doc.take(at), seal.take(at), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.binary())],
                names=["bucket", "owner", "doc", "print", "start", "text"],
            )

    return rows.select("doc", "print", "text", "asked").mapInArrow(run, "bucket long, owner long, doc long, print long, start int, text binary")


class Transform:
    """Burrows-Wheeler transform of a shard of strings, each ended by a terminator (symbol 0; bytes are 1 to 256).

    symbols[i] precedes suffix i in the sorted order, and before[i] is the row of the
    suffix that begins with it.
    """

    def __init__(self, texts: list[bytes], depth: int):
        sizes = np.array([len(t) + 1 for t in texts])
        stop = np.repeat(np.cumsum(sizes), sizes)  # end of the string of each position
        symbols = np.zeros(int(sizes.sum()), dtype=np.int64)
        inside = np.ones(len(symbols), dtype=bool)
        inside[np.cumsum(sizes) - 1] = False
        symbols[inside] = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64) + 1
        # The first order is by seven symbols of nine bits; then the reach of those still together doubles.
        n, step, at = len(symbols), 7, np.arange(len(symbols))
        key = np.zeros(n, dtype=np.int64)
        for k in range(step):
            key = (key << 9) | np.where(at + k < stop, symbols[np.minimum(at + k, n - 1)], 0)
        order = np.argsort(key)
        new = np.ones(n, dtype=bool)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, at, 0))
        while step < depth:
            # Rows alone in their interval keep their place; the others are ordered by what follows.
            alone = new & np.append(new[1:], True)
            rows = np.flatnonzero(~alone)
            if not len(rows):
                break
            here = order[rows]
            ahead = np.where(here + step < stop[here], rank[np.minimum(here + step, n - 1)] + 1, 0)
            by = np.argsort(rank[here] * (n + 2) + ahead)
            here, ahead = here[by], ahead[by]
            order[rows] = here
            new[rows] = np.concatenate([[True], (rank[here][1:] != rank[here][:-1]) | (ahead[1:] != ahead[:-1])])
            rank[here] = rows[np.maximum.accumulate(np.where(new[rows], np.arange(len(rows)), 0))]
            step *= 2
        # Suffixes that agree in depth symbols or to their ends keep any order.
        self.order = order
        self.symbols = np.concatenate([[0], symbols[:-1]])[order].astype(np.uint16)
        row = np.empty(n, dtype=np.int32)
        row[order] = at
        self.before = row[order - 1]
        self.string = np.repeat(np.arange(len(texts)), sizes)[order]
        self.place = (at - np.repeat(np.cumsum(sizes) - sizes, sizes))[order]


def merge(shards: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(interval, shard, row) of the repeated intervals of the merged transform: rows of one interval share their first depth symbols.

    The interleave holds the rows in the order of their first h symbols, cut in
    intervals of equal ones.  A round reads the shards' transforms in that order and
    places the rows before stably by symbol, which orders one symbol more; an
    interval ends where the symbols or the intervals of the round before differ.
    Rows alone in their interval are retired.  The first interleave has the suffixes
    with depth symbols before them, as no others grow to that length.
    """
    base = np.concatenate([[0], np.cumsum([len(s.symbols) for s in shards])])
    symbols = np.concatenate([s.symbols for s in shards])
    if symbols.max(initial=0) < 256:  # UTF-8 has no byte of 255, so eight bits do, and a pass by symbol is cheap
        symbols = symbols.astype(np.uint8)
    before = np.concatenate([s.before + b for s, b in zip(shards, base)]).astype(np.int32)
    rows = np.flatnonzero(np.concatenate([s.place for s in shards]) >= depth).astype(np.int32)
    interval = np.zeros(len(rows), dtype=np.int32)
    for _ in range(depth):
        if not len(rows):
            break
        lead = symbols[rows]
        order = np.argsort(lead, kind="stable")
        lead, held = lead[order], interval[order]
        new = np.ones(len(order) + 1, dtype=bool)
        new[1:-1] = (lead[1:] != lead[:-1]) | (held[1:] != held[:-1])
        together = ~(new[:-1] & new[1:])
        rows = before[rows[order[together]]]
        interval = np.cumsum(new[:-1][together], dtype=np.int32)
    shard = np.searchsorted(base, rows, side="right") - 1
    return interval, shard, rows - base[shard]


def repeated_windows(texts: list[bytes], width: int, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(interval, text, place) of the windows whose width bytes occur more than once in the texts."""
    shards, numbers, now, size = [], [], [], 0
    for i, t in enumerate(texts):
        now.append(i)
        size += len(t) + 1
        if size >= shard_bytes or i == len(texts) - 1:
            shards.append(Transform([texts[j] for j in now], width))
            numbers.append(np.array(now))
            now, size = [], 0
    interval, shard, row = merge(shards, width)
    text, place = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    for k, s in enumerate(shards):
        own = shard == k
        text[own], place[own] = numbers[k][s.string[row[own]]], s.place[row[own]]
    return interval, text, place


def window_spans(d, s, a, width: int) -> pa.RecordBatch:
    """The windows from a on as spans that go, those that follow each other as one."""
    order = np.lexsort((a, s, d))
    d, s, a = d[order], s[order], a[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (a[1:] > a[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a))[: len(first)] - 1
    return spans(d[first], s[first], a[first], a[last] + width, 0)


def compare(texts: DataFrame, width: int) -> DataFrame:
    """Spans that go: windows of the texts that an earlier window equals."""

    def bucket(_key, table):
        owner, doc, seal, start = (table.column(c).to_numpy() for c in ("owner", "doc", "print", "start"))
        content = table.column("text").to_pylist()
        # Parts of split owners meet here for the first time: equal texts collapse, owners of one text drop out.
        codes: dict[bytes, int] = {}
        code = np.array([codes.setdefault(t, len(codes)) for t in content], dtype=np.int64)
        size = np.array([len(t) for t in content], dtype=np.int32)
        order = np.lexsort((start, seal, doc, code))
        new, moved = later_copies(order, (code,), (doc, seal, start))
        gone = order[moved]
        copies = spans(doc[gone], seal[gone], start[gone], start[gone] + size[gone], 0)
        heads = order[new]
        _, of, count = np.unique(owner[heads], return_inverse=True, return_counts=True)
        heads = heads[count[of] > 1]
        doc, seal, start, content = doc[heads], seal[heads], start[heads], [content[i] for i in heads]
        if not content:
            return pa.Table.from_batches([copies])
        interval, text, place = repeated_windows(content, width)
        at = start[text] + place
        order = np.lexsort((at, seal[text], doc[text], interval))
        _, moved = later_copies(order, (interval,), (doc[text], seal[text], at))
        gone = order[moved]
        return pa.Table.from_batches([copies, window_spans(doc[text][gone], seal[text][gone], at[gone], width)])

    return texts.groupBy("bucket").applyInArrow(bucket, SPAN_SCHEMA)


def compare_windows(texts: DataFrame, width: int) -> DataFrame:
    """compare() by the windows themselves, dealt by the hashes of their halves, however many texts have one key."""
    half = width // 2

    def cut(batches):
        for part, data, offsets in blocks(batches, "text"):
            n = len(data)
            up, down = powers(n)
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(BYTE_VALUES[data] * up[:n], out=sums[1:])
            many = np.maximum(np.diff(offsets) - width + 1, 0)
            row = np.repeat(np.arange(part.num_rows), many)
            place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            at = offsets[row] + place
            left, right = mix((sums[at + half] - sums[at]) * down[at]), mix((sums[at + width] - sums[at + half]) * down[at + half])
            doc, seal, start = (part.column(part.schema.get_field_index(c)).to_numpy()[row] for c in ("doc", "print", "start"))
            yield pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(right.view(np.int64)), pa.array(doc), pa.array(seal), pa.array((start + place).astype(np.int32))], names=["left", "right", "doc", "print", "at"])

    windows = texts.select("doc", "print", "start", "text").mapInArrow(cut, "left long, right long, doc long, print long, at int")
    place = F.struct("doc", "print", "at")
    least = windows.groupBy("left", "right").agg(F.min(place).alias("least"), F.count("*").alias("n"))
    least = written(least.where("n > 1"), "windows")
    # Few enough to broadcast, whatever the number of windows (see hot_bound).
    most = hot_bound(least, "n", HOT_COPIES)
    hot, cold = least.where(F.col("n") > most), least.where(F.col("n") <= most)
    dealt = windows.join(F.broadcast(hot.drop("n")), ["left", "right"], "left")
    rest = dealt.where("least IS NULL").drop("least").join(cold.drop("n").hint("merge"), ["left", "right"])
    gone = dealt.where("least IS NOT NULL").unionByName(rest).where(place != F.col("least")).select("doc", "print", "at")

    def join_up(batches):
        for part in batches:
            yield window_spans(*(part.column(part.schema.get_field_index(c)).to_numpy() for c in ("doc", "print", "at")), width)

    return gone.mapInArrow(join_up, SPAN_SCHEMA)


def remove_repeats(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_bytes, n_removed, removed (maximal spans of bytes) and kept_sha256 of the bytes that stay.

    Bytes are those of UTF-8; a null text is empty, and a text shorter than width
    stays whole.  Documents are ordered by key (a whole number), a null key last, and
    rows of equal keys by a hash of their text; rows equal in both are one document
    and get the same result.  No rows give no rows.  Columns of docs called like the
    results (in any case) are replaced, all others keep their values.
    """
    added = ("n_bytes", "n_removed", "removed", "kept_sha256")
    rows = docs.select(*hidden(docs), F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("print"), F.col(text).alias("text"))
    slim = rows.select("doc", "print", "text")
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(total * 2 // (width - ANCHOR + 2) // BUCKET_RUNS) + 1
    met = written(meet(run_table(slim, buckets, width), width), "spans")
    wanted = met.where("kind = 1")
    size = wanted.agg(F.sum(F.octet_length("start") / 4)).first()[0] or 0
    texts = run_texts(slim, wanted, int(size * (2 * width - ANCHOR) // BUCKET_BYTES) + 1, width)
    texts = written(texts, "texts")
    full = written(texts.groupBy("owner").agg(F.sum(F.octet_length("text")).alias("bytes")).where(F.col("bytes") > OWNER_BYTES).select("owner"), "full")
    owners = full.count()
    # Their number grows with the text, so they are broadcast only up to a bound.
    full = F.broadcast(full) if owners <= BROADCAST_OWNERS else full.hint("merge")
    found = compare(texts.join(full, "owner", "left_anti"), width)
    if owners:
        found = found.unionByName(compare_windows(texts.join(full, "owner", "left_semi"), width))
    gone = met.where("kind = 0").select("doc", "print", "start", "end").unionByName(found.select("doc", "print", "start", "end"))
    gone = gone.groupBy("doc", "print").agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    body, columns = hidden_name(docs, text), [f"in__{i}" for i in range(len(docs.columns))]
    joined = rows.drop("text").join(gone.hint("merge"), ["doc", "print"], "left").select(*columns, "gone")

    def run(batches):
        for part, data, offsets in blocks(batches, body):
            gone = part.column(part.schema.get_field_index("gone"))
            removed, count, digests = [], [], []
            for d in range(part.num_rows):
                own = data[offsets[d] : offsets[d + 1]]
                edge = np.zeros(len(own) + 1, dtype=np.int32)
                for g in gone[d].as_py() or ():
                    np.add.at(edge, np.frombuffer(g["start"], np.int32), 1)
                    np.add.at(edge, np.frombuffer(g["end"], np.int32), -1)
                hit = np.cumsum(edge) > 0
                turn = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0))
                removed.append([{"start": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2])])
                count.append(int(hit.sum()))
                digests.append(hashlib.sha256(own[~hit[:-1]].tobytes()).hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(part.schema.get_field_index(c)) for c in columns], pa.array(np.diff(offsets)), pa.array(count, pa.int64()), pa.array(removed, kind), pa.array(digests, pa.string())],
                names=[*columns, *added],
            )

    fields = [f"{c} {joined.schema[c].dataType.simpleString()}" for c in columns]
    out = joined.mapInArrow(run, ", ".join([*fields, "n_bytes long, n_removed long, removed array<struct<start:int,end:int>>, kept_sha256 string"]))
    return out.select(*shown(docs.columns, added), *added)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
