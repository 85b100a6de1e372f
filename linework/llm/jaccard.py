"""Operator 3: n-gram Jaccard join by a token-group matrix.

1. A document's set is its distinct shingles of k words, as 64-bit hashes.
   Documents with equal sets are one set from here on.
2. Sets that share a MinHash band are put in groups; a group is cut in blocks of
   bounded total size, like sets in one block.  The number of bands is such that a
   pair at the threshold shares none with a probability under MISS, were the hashes
   (multiply-shift of mixed 64-bit tokens) fully random.
3. A row of the matrix is a block with its members and the union of their
   tokens.  A query set is compared with a block only if the block's union holds
   at least threshold * |set| of its tokens; a block is opened for the sets that
   pass this bound and for no others, and an open block gives exact
   intersections.
4. Blocks are compared within and with the block of their group's least set.
5. Sets of bands that are not known to be linked by then are bounded by the union of
   all of them: a set with fewer than threshold * |set| tokens that any other has
   links with none.  Of the others, two can link only if they share one of their
   rarest tokens, so only pairs of blocks with such a token in common are opened.
   Texts that are similar and yet not linked, however many, differ in rare tokens
   and open none.  All links go to connected components.
Tasks see one or two blocks at a time, so a group of any size is spread over
many tasks, and only spanning links leave a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.llm.common import join_counted, table, written
from linework.llm.textkernel import Words, binary_array, blocks, constants, distinct_by_row, list_array, mix, shingles
from linework.operators.components import connected_components

#: Probability that a pair at the threshold meets in no band.
MISS = 1e-12
BAND_ROWS = 6
#: Tokens of a block's members together, but for one set larger than this.
BLOCK_TOKENS = 1 << 16


def bands_for(threshold: float, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    """Bands of so many rows that a pair at the threshold shares none with probability miss at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of unsigned 64-bit values by segment, modulo 2**64."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def band_keys(tokens: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(non-empty sets, bands) MinHash band keys."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    flips, factors = constants(bands * rows, 11), constants(bands * rows, 13)
    keys = np.empty((len(starts), bands), dtype=np.uint64)
    weights = constants(rows, 17)
    wide, work = np.empty_like(tokens), np.empty(len(tokens), dtype=np.uint32)
    high = work.view() if not len(tokens) else wide.view(np.uint32)[1::2]
    for b in range(bands):
        key = np.full(len(starts), b + 1, dtype=np.uint64)
        for r in range(rows):
            np.bitwise_xor(tokens, flips[b * rows + r], out=wide)
            np.multiply(wide, factors[b * rows + r], out=wide)
            np.copyto(work, high)  # the upper half of each product
            key += np.minimum.reduceat(work, starts).astype(np.uint64) * weights[r] if len(starts) else np.uint64(0)
        keys[:, b] = mix(key)
    return keys


def signatures(docs: DataFrame, k: int, bands: int, rows: int, lower: bool) -> DataFrame:
    """(id, print, n, node, bands) of each row of docs (id, print, text): set size, a 64-bit hash of the set, and its band keys."""

    def run(batches):
        for part, data, offsets in blocks(batches, "text"):
            values, row = shingles(Words(data, offsets, lower=lower), k)
            tokens, at = distinct_by_row(values, row, part.num_rows)
            full = np.diff(at) > 0
            keys = band_keys(tokens, at, bands, rows)
            ends = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))])
            node = mix(segment_sums(mix(tokens + np.uint64(1)), at) ^ mix(segment_sums(mix(tokens ^ np.uint64(0x5BD1E995A5A5A5A5)), at) + np.diff(at).astype(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(part.schema.get_field_index(c)) for c in ("id", "print")],
                    pa.array(np.diff(at).astype(np.int64)),
                    pa.array(node.view(np.int64)),
                    list_array(keys.reshape(-1).view(np.int64), ends, pa.int64()),
                ],
                names=["id", "print", "n", "node", "bands"],
            )

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, print long, n long, node long, bands array<long>")


def token_sets(docs: DataFrame, k: int, lower: bool) -> DataFrame:
    """docs (id, text, block) as (block, id, tokens): the sorted distinct 64-bit shingles."""

    def run(batches):
        for part, data, offsets in blocks(batches, "text"):
            values, row = shingles(Words(data, offsets, lower=lower), k)
            tokens, at = distinct_by_row(values, row, part.num_rows)
            pick = [part.column(part.schema.get_field_index(c)) for c in ("block", "id")]
            yield pa.RecordBatch.from_arrays([*pick, binary_array(tokens, at)], names=["block", "id", "tokens"])

    return docs.mapInArrow(run, "block long, id long, tokens binary")


class Block:
    """Members of a block: ids, sizes, the offsets of their tokens, and the inverted rows (token, member) sorted by token."""

    def __init__(self, ids: list, tokens: list):
        sets = [np.frombuffer(t, dtype=np.uint64) for t in tokens]
        self.ids = np.array(ids, dtype=np.int64)
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(self.tokens, kind="stable")
        self.sorted = self.tokens[order]
        self.member = np.repeat(np.arange(len(sets)), self.sizes)[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = self.sorted[1:] != self.sorted[:-1]
        self.begin = np.flatnonzero(new)
        self.union = self.sorted[new]
        self.count = np.diff(np.append(self.begin, len(order)))

    def bounds(self, queries: Block, own: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each token of the queries its place in the union, or -1 where no (other, if own) member has it; and how many of each query's tokens have one."""
        at = np.searchsorted(self.union, queries.tokens)
        at[at == len(self.union)] = 0
        held = (self.union[at] == queries.tokens) & (self.count[at] > own) if len(self.union) else np.zeros(len(at), bool)
        at = np.where(held, at, -1)
        sums = np.concatenate([[0], np.cumsum(held)])
        return at, sums[queries.offsets[1:]] - sums[queries.offsets[:-1]]

    def intersections(self, at: np.ndarray) -> np.ndarray:
        """Opens the block: how many of a query's tokens (places in the union) each member has."""
        at = at[at >= 0]
        n = self.count[at]
        total = int(n.sum())
        places = np.repeat(self.begin[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        return np.bincount(self.member[places], minlength=len(self.ids))


def links(queries: Block, block: Block, num: int, den: int, own: bool) -> list[tuple[int, int]]:
    """Spanning links (id, id) of the pairs of a query and a member with den * intersection >= num * union; within a block, from each linked member to the least of its class."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    at, bound = block.bounds(queries, own)
    out = []
    for q in np.flatnonzero(den * bound >= num * queries.sizes):
        shared = block.intersections(at[queries.offsets[q] : queries.offsets[q + 1]])
        good = den * shared >= num * (queries.sizes[q] + block.sizes - shared)
        if own:
            good[: q + 1] = False
        a = int(queries.ids[q])
        for m in np.flatnonzero(good):
            b = int(block.ids[m])
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((a, b))
    return [(int(x), root(int(x))) for x in queries.ids if root(int(x)) != x] if own else out


def block_links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links (src, dst) of rows (ids, tokens) within a block, or of rows (ids, tokens, ids2, tokens2) between two."""
    two = "ids2" in rows.columns

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                a = Block(cell["ids"], cell["tokens"])
                if two:
                    b = Block(cell["ids2"], cell["tokens2"])
                    found = links(a, b, num, den, False)
                else:
                    found = links(a, a, num, den, True)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["src", "dst"])

    return rows.mapInArrow(run, "src long, dst long")


def shared_bands(pairs: DataFrame) -> DataFrame:
    """pairs (band, id) whose band has several ids, with leader, the least id of the band.

    A band of many ids is cut by a hash of the id before its least id is taken, and
    joined by broadcast (join_counted), so that no task gets a whole band.
    """
    cut = pairs.groupBy("band", F.pmod("id", F.lit(64)).alias("cut")).agg(F.count("*").alias("n"), F.min("id").alias("leader"))
    meeting = cut.groupBy("band").agg(F.sum("n").alias("n"), F.min("leader").alias("leader")).where("n > 1")
    return join_counted(pairs, meeting, ["band"], "n", "id").where("leader IS NOT NULL")


def chosen_tokens(rows: DataFrame) -> DataFrame:
    """rows (ids, tokens, chosen) as (id, n, token): each token of the chosen ids' sets, and the set's size."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, tokens, chosen = (batch.column(k)[i].as_py() for k in range(3))
                chosen = set(chosen)
                for one, held in zip(ids, tokens):
                    if one in chosen:
                        values = np.frombuffer(held, dtype=np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), one)), pa.array(np.full(len(values), len(values))), pa.array(values)], names=["id", "n", "token"])

    return rows.mapInArrow(run, "id long, n long, token long")


def open_cells(sets: DataFrame, grouped: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (block, block2) of blocks that hold sets (id, block, known) which can link and are of different known classes.

    Two sets that link share at least need = num / den of the larger one's tokens, so
    with all tokens in one order (how many of the sets have them, then the token) they
    have a common token among the first n - need + 1 of each.  Tokens of one set alone
    come first and are no set's common token.
    """
    chosen = sets.groupBy("block").agg(F.collect_list("id").alias("chosen"))
    tokens = written(chosen_tokens(grouped.join(chosen.hint("merge"), "block").select("ids", "tokens", "chosen")), "open")
    held = tokens.groupBy("token").agg(F.count("*").alias("n_sets")).where("n_sets > 1").withColumn("held", F.col("n_sets"))
    common = join_counted(tokens, held, ["token"], "n_sets", "id").where("held IS NOT NULL")
    common = common.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("common"))
    first = F.expr(f"size(common) + 1 - cast((n * {num} + {den - 1}) div {den} as int)")
    rare = common.withColumn("first", first).where("first > 0").select("id", F.explode(F.slice("common", 1, F.col("first"))).alias("rare"))
    # One row per block and token, however many sets of the block have it.
    marks = rare.select("id", F.col("rare.token").alias("token")).join(sets.hint("merge"), "id").groupBy("token", "block").agg(F.min("known").alias("low"), F.max("known").alias("high"))
    marks = written(marks, "marks")
    meet = F.expr("a.token = b.token AND a.block < b.block AND least(a.low, b.low) <> greatest(a.high, b.high)")
    return marks.alias("a").join(marks.alias("b").hint("merge"), meet).select(F.col("a.block").alias("block"), F.col("b.block").alias("block2")).distinct()


def similarity_classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, lower: bool = True, key: str = "doc_id", text: str = "text", rows: int = BAND_ROWS) -> DataFrame:
    """(id, print, n_shingles, class, component) of each row of docs.

    Two documents link when den * |A & B| >= num * |A | B|.  class is the same for
    rows that links lead to each other, and null for null and blank texts, which
    have an empty set and link with nothing; component is the least id of the
    class, its own id for an empty set.  id is the key, of any orderable type; a null
    key is no candidate for component, so a class of such rows alone has a null one.
    A text of fewer than k words has its whole word sequence as its one shingle.
    Rows of equal keys are documents of their own; rows equal in key and text, which
    have the same print (a hash of both), are in one class unless empty.  Other
    columns of docs take no part.  No rows give no rows.  A set is known by a 64-bit
    hash of its shingles, so among 10^9 different sets two share one with a
    probability of about 3 %.
    """
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    docs = docs.withColumn("print", F.xxhash64("id", "text"))
    bands = bands_for(num / den, rows)
    signed = written(signatures(docs, k, bands, rows, lower), "signatures")
    sets = signed.where("n > 0").groupBy("node").agg(F.min(F.struct("print", "bands")).alias("rep"), F.min("id").alias("least"), F.max("n").alias("n"), F.count("*").alias("copies"))
    sets = written(sets.select("node", "least", "n", "copies", F.col("rep.print").alias("print"), F.col("rep.bands").alias("bands")), "sets")
    shared = written(shared_bands(sets.select(F.col("node").alias("id"), F.explode("bands").alias("band"))), "meeting")
    members = shared.groupBy("id").agg(F.min("leader").alias("group"))
    members = members.join(sets.select(F.col("node").alias("id"), "n", "print", F.element_at("bands", 1).alias("near")), "id")
    sizes = members.groupBy("group").agg(F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS)).alias("blocks"))
    # Sets alike in their first band fall in one block as far as blocks of even size allow: half of the spread is left to the set itself.
    number = F.pmod(F.xxhash64("near") + F.pmod("id", F.greatest(F.lit(1), F.floor(F.col("blocks") / 2))), F.col("blocks"))
    # Narrow rows: where one group has most of them, adaptive execution splits the join.
    members = written(members.join(sizes.hint("merge"), "group").select("id", "print", "group", F.xxhash64("group", number).alias("block"), F.when(F.col("id") == F.col("group"), F.xxhash64("group", number)).alias("first")), "members")
    # Always a merge join: a broadcast of the members would be right for small inputs only.
    texts = docs.select("print", "text").join(members.select("print", "id", "block").hint("merge"), "print")
    held = token_sets(texts.select("block", "id", "text"), k, lower).where(F.length("tokens") > 0)
    grouped = written(held.groupBy("block").agg(F.collect_set(F.struct("id", "tokens")).alias("m")).select("block", F.col("m.id").alias("ids"), F.col("m.tokens").alias("tokens")), "blocks")
    right = grouped.select(F.col("block").alias("block2"), F.col("ids").alias("ids2"), F.col("tokens").alias("tokens2"))
    inside = written(block_links(grouped.where(F.size("ids") > 1).select("ids", "tokens"), num, den), "inside")
    of_group = members.groupBy("group", "block").agg(F.max("first").alias("first"))
    stars = of_group.join(of_group.where("first IS NOT NULL").select("group", F.col("first").alias("block2")), "group").where("block <> block2").select("block", "block2")
    outward = written(block_links(stars.join(grouped, "block").join(right, "block2").select("ids", "tokens", "ids2", "tokens2"), num, den), "outward")
    early = inside.unionByName(outward)
    # What a set is known to be linked to so far: the least set of its class in the first block, or else in its own.
    root = lambda c: inside.select(F.col("src").alias(c), F.col("dst").alias(f"{c}_root"))
    up = outward.join(root("src"), "src", "left").join(root("dst"), "dst", "left")
    up = up.groupBy(F.coalesce("src_root", "src").alias("root")).agg(F.min(F.coalesce("dst_root", "dst")).alias("up"))
    settled = members.select("id", "block").join(root("id"), "id", "left").withColumn("root", F.coalesce("id_root", "id"))
    settled = written(settled.join(up, "root", "left").select("id", "block", F.coalesce("up", "root").alias("known")), "settled")
    touching = shared.select("band", "id").join(settled, "id")
    several = touching.groupBy("band").agg(F.count("*").alias("n"), F.min("known").alias("low"), F.max("known").alias("high"), F.min("block").alias("least"), F.max("block").alias("most"))
    several = several.where("low <> high AND least <> most").select("band", "n", F.lit(True).alias("several"))
    open_sets = written(join_counted(touching, several, ["band"], "n", "id").where("several").select("id", "block", "known").distinct(), "unsettled")
    cells = open_cells(open_sets, grouped, num, den)
    cells = cells.join(stars.select(F.least("block", "block2").alias("block"), F.greatest("block", "block2").alias("block2")), ["block", "block2"], "left_anti")
    across = block_links(cells.join(grouped, "block").join(right, "block2").select("ids", "tokens", "ids2", "tokens2"), num, den)
    found = connected_components(early.unionByName(across)).withColumnRenamed("component", "class")
    classes = sets.select("node", "least", "copies").join(found, "node", "left").withColumn("class", F.coalesce("class", "node"))
    # The least id of a class is taken over its sets; a set that links to no other has its own.
    linked = classes.groupBy("class").agg(F.min("least").alias("component"), F.count("*").alias("n_sets")).where("n_sets > 1")
    classes = classes.join(linked.hint("merge"), "class", "left")
    classes = classes.select("node", "copies", "class", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component")).alias("component"))
    full = join_counted(signed.where("n > 0").select("id", "print", "n", "node"), classes, ["node"], "copies", "print")
    full = full.select("id", "print", F.col("n").alias("n_shingles"), "class", "component")
    return full.unionByName(signed.where("n = 0").select("id", "print", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("class"), F.col("id").alias("component")))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity_classes(table(spark, sf_dir, "documents"), k=3, num=90)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


OP3_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, sym.b FROM r JOIN sym ON r.y = sym.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) USING (doc_id)
"""
