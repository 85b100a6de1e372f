"""Connected components of an edge table: contraction within partitions, then large-star / small-star (Kiveris et al. 2014)."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or a new local one where a local session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


#: Tables written so far by this driver, in order.
_tables: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _tables.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def co_partitioned(spark: SparkSession):
    """Joins planned inside take rows that lie together by some of the join's keys as they are, if both sides do.

    So what was dealt by tile once is joined by tile and pixel without being dealt
    again.  Only for keys of which none can have most of the rows.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def temporary_tables(spark: SparkSession):
    """Tables that written() makes inside go at the end; for jobs whose outcome is stored elsewhere by then."""
    first = len(_tables)
    try:
        yield
    finally:
        gone = _tables[first:]
        del _tables[first:]
        for path in gone:
            remove(spark, path)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.where("v > u").join(least, "u")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _round(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The edges as a written table, and their number and checksum, taken while they are written."""
    seen = Observation()
    out = written(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")), name)
    return out, (seen.get["n"], seen.get["s"])


#: Edges whose forest a task makes at once, and up to so many links between forests are merged in one task.
CHUNK_EDGES = 1 << 20
MERGED_EDGES = 100_000


def numbered(nodes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each node, in the order of the nodes, and the place of the first node of each number; a struct is ordered by its fields."""
    leaves, code = [nodes], None
    while any(pa.types.is_struct(x.type) for x in leaves):
        leaves = [y for x in leaves for y in (x.flatten() if pa.types.is_struct(x.type) else [x])]
    for leaf in leaves:
        coded = leaf.dictionary_encode(null_encoding="encode")
        order = np.empty(len(coded.dictionary), dtype=np.int64)
        order[pc.sort_indices(coded.dictionary, null_placement="at_start").to_numpy()] = np.arange(len(order))
        own = order[coded.indices.to_numpy(zero_copy_only=False)]
        code = own if code is None else np.unique(code * len(order) + own, return_inverse=True)[1]
    _, first, number = np.unique(code, return_index=True, return_inverse=True)
    return number, first


def _forest(edges: DataFrame) -> DataFrame:
    """(node, root, piece) of edges (u, v): each partition's edges as stars, a row for each of its nodes; root is the least node of its star, piece the partition (and chunk)."""

    def stars(batches):
        part, held, size, chunk = TaskContext.get().partitionId(), [], 0, 0

        def closed():
            table = pa.Table.from_batches(held).combine_chunks()
            nodes = pa.concat_arrays([c for k in range(2) for c in table.column(k).chunks])
            number, first = numbered(nodes)
            n = len(number) // 2
            label = least_labels(len(first), number[:n], number[n:])
            piece = pa.array(np.full(len(first), (part << 32) + chunk))
            return pa.RecordBatch.from_arrays([nodes.take(pa.array(first)), nodes.take(pa.array(first[label])), piece], names=["node", "root", "piece"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= CHUNK_EDGES:
                yield closed()
                held, size, chunk = [], 0, chunk + 1
        if held:
            yield closed()

    kind = edges.schema["u"].dataType.simpleString()
    return edges.select("u", "v").mapInArrow(stars, f"node {kind}, root {kind}, piece long")


def _rounds(edges: DataFrame, max_rounds: int) -> DataFrame:
    """(node, component) of distinct edges (u, v), u > v, by alternating stars."""
    now, before = _round(edges, "edges")
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        now, after = _round(_small_star(_large_star(now)), "stars")
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) of each node that has an edge to another; component is the least node.

    src and dst share any orderable type (a struct, too).  Null ends and loops
    are ignored, edges may repeat, and their direction does not matter.  A node
    linked to nothing is not in the result.

    Edges are dealt by ranges of (src, dst), which splits the edges of a hub, and each
    task replaces its edges by a forest.  What is left are links between the roots of
    nodes that several forests have: a star of any size leaves a link for each task, a
    chain of neighbouring ids one for each border.  Up to MERGED_EDGES of them are
    merged in one task, more are contracted again while that helps, and the rest settles in
    rounds that grow with the logarithm of the longest chain.  Each step is written.
    """
    now = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v")
    return _contracted(written(now, "edges"), max_rounds, None)


def _contracted(edges: DataFrame, max_rounds: int, before: int | None) -> DataFrame:
    """(node, component) of written edges (u, v) without loops; before: how many links the last contraction started from."""
    count = edges.count()
    if count <= MERGED_EDGES:
        return written(_forest(edges.repartition(1)).select("node", F.col("root").alias("component")), "merged")
    if before is not None and count * 2 > before:
        return _rounds(edges.distinct(), max_rounds)
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    forest = written(_forest(edges.repartitionByRange(parts, "u", "v")), "forest")
    # A node's least root stands for it; its other roots are linked with that one.
    least = written(forest.groupBy("node").agg(F.min("root").alias("root"), F.count("*").alias("n")), "roots")
    several = least.where("n > 1").select("node", F.col("root").alias("v"))
    links = forest.select("node", F.col("root").alias("u")).join(several.hint("merge"), "node").where("u <> v").select("u", "v").distinct()
    found = _contracted(written(links, "links"), max_rounds, count).withColumnRenamed("node", "root")
    joined = least.join(found.hint("merge"), "root", "left")
    return joined.select("node", F.coalesce("component", "root").alias("component"))


def least_labels(nodes: int, u: np.ndarray, v: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The least node of the component of each of the nodes 0 to nodes - 1, with links u to v; label is what other links gave before."""
    label = np.arange(nodes) if label is None else label.copy()
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def local_components(edges: DataFrame, keys: list[str], chunk: int = CHUNK_EDGES) -> DataFrame:
    """(keys, node, component) like connected_components, for edges (keys, src, dst) whose groups have a bounded number of nodes.

    All keys and ids are long.  Edges stream through a task sorted by group; whenever
    `chunk` of them are held, they are replaced by stars and finished groups leave.  So a
    task holds a chunk and the nodes of one group (a tile of 2048 x 2048 pixels at most:
    about 300 MB where each pixel is a stroke), and no row holds a group.
    """
    width = len(keys)
    dealt = edges.where("src <> dst").select(*keys, "src", "dst").repartition(*keys).sortWithinPartitions(*keys)

    def stars(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes (keys, id) of edge rows, sorted, and the number of each one's least."""
        both = np.concatenate([rows[:, : width + 1], np.delete(rows, width, axis=1)])
        order = np.lexsort(both.T[::-1])
        both = both[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (both[1:] != both[:-1]).any(axis=1)
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        return both[new], least_labels(int(new.sum()), number[: len(rows)], number[len(rows) :])

    def result(node: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array(node[:, k]) for k in range(width + 1)], pa.array(least)], names=[*keys, "node", "component"])

    def run(batches):
        held, size, limit = [], 0, chunk
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
            size += batch.num_rows
            if size >= limit:
                node, label = stars(np.concatenate(held))
                least = node[label, width]
                open_ = (node[:, :width] == held[-1][-1, :width]).all(axis=1)
                yield result(node[~open_], least[~open_])
                kept = open_ & (node[:, width] != least)
                held = [np.column_stack([node[kept], least[kept]])]
                size, limit = len(held[0]), chunk + 2 * len(held[0])
        if size:
            node, label = stars(np.concatenate(held))
            yield result(node, node[label, width])

    return dealt.mapInArrow(run, ", ".join(f"{k} long" for k in (*keys, "node", "component")))
