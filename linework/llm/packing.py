"""Operator 13: packing documents into sequences by best-fit decreasing.

Documents become token ids; those longer than a sequence are first cut into full
windows.  What is left is packed longest first, each piece into the open window with
the least room that holds it; a segment tree indexed by remaining capacity finds it.

Pieces of one length are interchangeable, so the whole corpus' packing follows from
how many pieces each length has: at most one number per length, whatever the corpus'
size.  Best-fit decreasing over these numbers gives moves (so many pieces of a
length, a range of windows, an offset), and each piece finds its place by its rank
among the pieces of its length.  Ranks come from counts by task, so neither a length
nor the corpus is ever held by one task.
"""

from __future__ import annotations

import bisect
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linework.llm.common import table, written
from linework.llm.textkernel import WORD_NON_BLANK, blocks

CAPACITY = 2048
#: Id that ends a document.
END = 1
TOKENIZER = "word_bpe_49k.json"
#: Spellings whose ids a worker keeps; beyond, it starts anew.
CACHE = 1_000_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_bytes = np.arange(256)
_LETTER = ((_bytes | 32) >= 97) & ((_bytes | 32) <= 122) & (_bytes < 128)
_MARK = (_bytes < 128) & WORD_NON_BLANK & ~_LETTER
#: Letters up to here have neither combining marks nor special rules of case.
_LATIN = "\u0250"
#: The characters by which byte-level vocabularies spell bytes: printable ones themselves, the others from 256 on.
_printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLED = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_printable)))}


class Encoder:
    """Ids of blocks of texts, each spelling encoded once, for a tokenizer that splits at blanks and between letters, digits and marks, with contractions as 's apart.

    Texts are cut at blanks and between ASCII letters and marks, but for the letters
    behind an apostrophe.  Pieces of Latin letters alone are one word to the tokenizer
    and go to its model directly.
    """

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, new: pa.Array) -> None:
        full = tokenizer(self.path)
        model, found, rest = full.model.tokenize, [], []
        for k, s in enumerate(new.to_pylist()):
            if s.isalpha() and s.isascii():
                found.append([t.id for t in model(s.lower())])
            elif s.isalpha() and max(s) < _LATIN and "\u0130" not in s:
                found.append([t.id for t in model(s.lower().encode().decode("latin-1").translate(_SPELLED))])
            else:
                rest.append((k, s))
                found.append(None)
        for (k, _), e in zip(rest, full.encode_batch([s for _, s in rest], add_special_tokens=False)):
            found[k] = e.ids
        self.known = pa.concat_arrays([self.known, new])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), dtype=np.int64)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(ids) for ids in found])])

    def codes(self, spellings: pa.Array) -> np.ndarray:
        """The numbers of spellings, new ones learnt."""
        held = pc.index_in(spellings, value_set=self.known)
        code = held.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(code < 0)
        if len(new):
            code[new] = len(self.known) + np.arange(len(new))
            self.learn(spellings.take(pa.array(new)))
        return code

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, each with end at its end, and the rows' offsets."""
        rows = len(offsets) - 1
        if len(self.known) > CACHE:
            self.clear()
        inside = WORD_NON_BLANK[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        if b"<|" not in data.tobytes():  # such may begin a special token
            letter, mark = _LETTER[data], _MARK[data]
            begin[1:] |= (letter[:-1] & mark[1:]) | (mark[:-1] & (data[:-1] != 39) & letter[1:])
        edges = offsets[:-1][offsets[:-1] < len(data)]
        begin[edges] = inside[edges]
        starts = np.flatnonzero(begin)
        begins = np.searchsorted(starts, offsets)
        # Without the blanks the pieces follow each other, as Arrow has strings.
        at = np.append(np.cumsum(inside)[starts] - 1, np.count_nonzero(inside)).astype(np.int64)
        spelled = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(data[inside])).dictionary_encode()
        code = self.codes(spelled.dictionary)[spelled.indices.to_numpy(zero_copy_only=False)] if len(starts) else np.zeros(0, np.int64)
        # Each row has its end as one more item behind its pieces.
        first, size = self.ends[code], np.diff(self.ends)[code] if len(code) else np.zeros(0, np.int64)
        first = np.insert(first, begins[1:], -1)
        size = np.insert(size, begins[1:], 1)
        begun = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(first - begun[:-1], size) + np.arange(begun[-1])
        closing = begun[begins[1:] + np.arange(rows)]
        place[closing] = 0
        ids = self.flat[place] if len(self.flat) else np.zeros(len(place), np.int64)
        ids[closing] = end
        return ids, np.concatenate([[0], closing + 1])


def cut(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(key, start, length, doc_tokens, ids, part, nth): the pieces of each document's ids, full windows first, written.

    ids are little-endian unsigned numbers of 2 bytes.  A null or empty text has the
    closing id alone; a text of any length is cut whole; rows of one key are cut each
    by itself.  part is the task that cut the piece and nth its number among that
    task's pieces of its length.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        encoder, part = Encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch, data, offsets in blocks(batches, "text"):
            ids, first = encoder.encode(data, offsets, end)
            if len(ids) and int(ids.max()) > 0xFFFF:
                raise ValueError("ids of more than 2 bytes")
            tokens = np.diff(first)
            pieces = -(-tokens // capacity)
            doc = np.repeat(np.arange(len(tokens)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(tokens[doc] - start, capacity)
            order = np.argsort(length, kind="stable")
            among = np.arange(len(length)) - np.searchsorted(length[order], length[order])
            nth = np.empty(len(length), dtype=np.int64)
            nth[order] = seen[length[order]] + among
            seen += np.bincount(length, minlength=capacity + 1)
            limits = np.append(first[doc] + start, len(ids))
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(limits * 2), pa.py_buffer(ids.astype("<u2"))]).cast(pa.binary())
            columns = [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(tokens[doc]), packed, pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "length", "doc_tokens", "ids", "part", "nth"])

    kind = rows.schema["key"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"key {kind}, start long, length long, doc_tokens long, ids binary, part int, nth long"), "pieces")


class Rooms:
    """Open windows by remaining capacity: ranges of window numbers, and a segment tree that says which capacities have any."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def mark(self, room: int) -> None:
        k = room + self.size
        self.any[k] = bool(self.ranges[room])
        while k > 1:
            k //= 2
            self.any[k] = self.any[2 * k] or self.any[2 * k + 1]

    def add(self, room: int, first: int, n: int) -> None:
        own = self.ranges[room]
        # Ranges that go on in each other become one.
        i = bisect.bisect(own, (first, n))
        if i and sum(own[i - 1]) == first:
            first, n = own[i - 1][0], own[i - 1][1] + n
            del own[i - 1]
            i -= 1
        if i < len(own) and own[i][0] == first + n:
            n += own[i][1]
            del own[i]
        own.insert(i, (first, n))
        self.mark(room)

    def take(self, room: int) -> tuple[int, int]:
        out = self.ranges[room].pop(0)
        self.mark(room)
        return out

    def tightest(self, least: int) -> int | None:
        """The least remaining capacity of at least `least` that a window has."""
        k = least + self.size
        if self.any[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.any[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.any[2 * k] else 2 * k + 1
                return k - self.size
            k //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Moves (length, first rank, first window, windows, pieces per window, offset) of counts[length] pieces of each length.

    The outcome is that of placing the pieces one by one, longest first, into the
    tightest window: after a piece goes into a window, that window is the tightest for
    the next of the length while it has room, so windows of one room are filled in turn.
    """
    rooms, opened, moves = Rooms(capacity), 0, []
    for length in sorted(counts, reverse=True):
        first, left = 0, counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                room = capacity
                at, n = opened, -(-left // (capacity // length))
                opened += n
            else:
                at, n = rooms.take(room)
            per = room // length
            full = min(n, left // per)
            for windows, pieces in ((full, per), (1, left - full * per if full < n else 0)):
                if windows and pieces:
                    moves.append((length, first, at, windows, pieces, capacity - room))
                    rooms.add(room - pieces * length, at, windows)
                    first, left, at, n = first + windows * pieces, left - windows * pieces, at + windows, n - windows
            if n:
                rooms.add(room, at, n)
    return np.array(moves, dtype=np.int64).reshape(-1, 6)


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(key, start, length, doc_tokens, ids, sequence_id, offset) of each piece of each document.

    ids are little-endian unsigned numbers of 4 bytes.  No documents give no rows;
    which of two pieces of one length gets which place depends on how Spark deals the
    rows to tasks, the windows' filling does not.  The moves go to all tasks: their
    number follows from how lengths are distributed, of which there are `capacity`.
    """
    pieces = cut(docs, path, key, text, capacity, end)
    counts = pieces.groupBy("length", "part").agg((F.max("nth") + 1).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    moves = best_fit_decreasing(total, capacity)
    moves = moves[np.lexsort((moves[:, 1], moves[:, 0]))]
    # Length and rank as one number, so that one search finds a piece's move.
    sought = (moves[:, 0] << 48) + moves[:, 1]

    def run(batches):
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            length, rank = get("length").to_numpy(), get("nth").to_numpy() + get("before").to_numpy()
            move = moves[np.searchsorted(sought, (length << 48) + rank, side="right") - 1]
            window, slot = np.divmod(rank - move[:, 1], move[:, 4])
            ids = get("ids")
            buffers = ids.buffers()
            ends = np.frombuffer(buffers[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
            wide = np.frombuffer(buffers[2], "<u2")[ends[0] // 2 : ends[-1] // 2].astype("<u4")
            grown = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((2 * (ends - ends[0])).astype(np.int32)), pa.py_buffer(wide)])
            yield pa.RecordBatch.from_arrays([*[get(c) for c in ("key", "start", "length", "doc_tokens")], grown, pa.array(move[:, 2] + window), pa.array(move[:, 5] + slot * length)], names=["key", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"])

    placed = pieces.join(before.hint("merge"), ["length", "part"])
    kind = pieces.schema["key"].dataType.simpleString()
    out = placed.mapInArrow(run, f"key {kind}, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long")
    return out.withColumnRenamed("key", key)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, tokens): the pieces of pack() put together; ids as there."""
    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("tokens"))
    return grouped.select("sequence_id", F.aggregate("p.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"), "tokens")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
