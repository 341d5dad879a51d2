"""Distributed union-find: connected components of an edge table."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .arrow_text import mix


def _folder(spark: SparkSession) -> str:
    """The folder for checkpoints, from spark.checkpoint.dir.

    Where none is set, a local session gets a folder of its own; on a cluster
    a local folder would not be shared, so that is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="leafmill-checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint."""
    _folder(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame, *by: str) -> tuple[DataFrame, str]:
    """Cuts the lineage by a Parquet table in the folder for checkpoints, and its path, for `discard`.

    For tables that are read several times in parts (a part for each value of
    the columns `by`), and for texts, which a checkpoint does not compress.
    """
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of `store` that nothing reads any more; Spark's cleaner knows checkpoints only."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose lineage is cut.

    Its cleaner acts on what the driver's JVM collects as garbage, which a
    large heap can put off until long after a step of many shuffles has ended.
    The heap also gives back what it grew by for the plans and task binaries of
    these steps, so a run of many small jobs does not fill the driver's memory.
    Frames that Python no longer holds go first, as they keep their plans'
    shuffles, and so does the last step's end until all have been told of it.
    """
    gc.collect()
    time.sleep(0.2)
    spark.sparkContext._jvm.System.gc()


def n_rows(df: DataFrame) -> int:
    """The number of rows, summed from one number a partition: a job without a shuffle, for settled tables."""

    def run(batches):
        yield pa.RecordBatch.from_pydict({"n": [sum(batch.num_rows for batch in batches)]})

    return sum(r.n for r in df.select(F.lit(1).alias("n")).mapInArrow(run, "n long").collect())


ROWS_PER_TASK = 50_000


def least_of_trees(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v), and the least node of each one's component."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = np.split(ends.reshape(-1), 2)
    least = np.arange(len(nodes))
    while len(a):
        low = np.minimum(a, b)
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        while ((up := least[least]) != least).any():
            least = up
        a, b = least[a], least[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[least]


def _edges(batches) -> np.ndarray:
    """Rows of two numbers, as one array."""
    parts = [np.column_stack([c.to_numpy() for c in batch.columns]) for batch in batches]
    return np.concatenate(parts) if parts else np.empty((0, 2), np.int64)


def _contract(batches):
    """(node, root) of the components that one task's edges make, roots included."""
    edges = _edges(batches)
    if len(edges):
        nodes, roots = least_of_trees(edges[:, 0], edges[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])


def _order(level: int):
    """Of nodes their places in an order of this level's own, and of places the nodes."""
    scale = int(mix(np.full(1, level + 1, np.uint64))[0]) | 1
    back = pow(scale, -1, 1 << 64)
    times = lambda x, by: (np.ascontiguousarray(x).view(np.uint64) * np.uint64(by)).view(np.int64)
    return lambda x: times(x, scale), lambda x: times(x, back)


def _contract_at(level: int):
    """As `_contract`, with the node that comes first in the level's order for a root."""
    place, node = _order(level)

    def run(batches):
        edges = place(_edges(batches))
        if len(edges):
            yield pa.RecordBatch.from_arrays([pa.array(node(x)) for x in least_of_trees(edges[:, 0], edges[:, 1])], names=["node", "root"])

    return run


def _meet(level: int):
    """From (node, root) rows of several tasks, all of a node: one root for each node, and edges (higher) between roots that a node has."""
    place, node = _order(level)

    def run(batches):
        rows = place(_edges(batches))
        if not len(rows):
            return
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        starts = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
        first = np.repeat(rows[starts, 1], np.diff(np.append(starts, len(rows))))
        apart = rows[:, 1] != first
        parts = [(False, rows[starts, 0], rows[starts, 1])]
        if apart.any():
            a, b = least_of_trees(rows[apart, 1], first[apart])
            parts.append((True, a[a != b], b[a != b]))
        for higher, a, b in parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), higher)), pa.array(node(a)), pa.array(node(b))], names=["higher", "a", "b"])

    return run


def _joined(links: DataFrame, tasks: int, level: int, max_levels: int) -> DataFrame:
    """(node, root) for each node of links, root being one node of its component."""
    if tasks == 1:
        return settle(links.coalesce(1).mapInArrow(_contract, "node long, root long"))
    if level == max_levels:
        raise RuntimeError(f"components did not settle in {max_levels} levels")
    stars = links.coalesce(tasks).mapInArrow(_contract_at(level), "node long, root long")
    met = settle(stars.repartition(tasks, "node").mapInArrow(_meet(level), "higher boolean, a long, b long"))
    higher = settle(met.where("higher").select("a", "b").distinct())
    tops = _joined(higher, _tasks(higher), level + 1, max_levels).select(F.col("node").alias("b"), "root")
    return settle(met.where("not higher").join(tops, "b", "left").select(F.col("a").alias("node"), F.coalesce("root", "b").alias("root")))


def _tasks(links: DataFrame) -> int:
    return max(1, -(-n_rows(links) // ROWS_PER_TASK))


def components(edges: DataFrame, max_levels: int = 60) -> DataFrame:
    """(node, root) for each node of edges(a, b); root is the least node of its component.

    Each task joins its own edges to stars, by a union-find over arrays. Where
    there are several tasks, a node gets one of the roots that its tasks gave
    it, and what is left are edges between roots: again a table of edges, of
    fewer nodes, until one task holds it. A level has an order of nodes of its
    own, from which it takes roots, so that on chains too a part of the nodes
    goes at each. A node comes from a task once, so no key is frequent. Null
    ends and self-links are ignored; an empty edge table gives an empty result.

    Tables of a level have a task for every ROWS_PER_TASK edges. So small ones
    do not end as many tiny files in each of the levels' shuffles, and those of
    one task need no level: Spark's driver holds a thread, a plan and its
    updates for each exchange.
    """
    links = settle(
        edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct()
    )
    tasks = _tasks(links)
    roots = _joined(links, tasks, 0, max_levels)
    if tasks == 1:
        return roots
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    return settle(roots.join(least, "root").select("node", F.col("least").alias("root")))
