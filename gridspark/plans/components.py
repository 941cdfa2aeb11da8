"""Connected components of an edge table, by contraction in rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pointer jumps within a round; each halves the depth of the trees that the round's choices make.
JUMPS = 2


def smallest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the nodes 0 to n - 1 the smallest node that it reaches along the edges (a, b)."""
    top = np.arange(n)
    while len(a):
        low = np.minimum(a, b)
        np.minimum.at(top, a, low)
        np.minimum.at(top, b, low)
        while not np.array_equal(top, top[top]):
            top = top[top]
        a, b = top[a], top[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return top


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition, as edges from each of its nodes to the smallest node that it reaches within."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    top = smallest_reached(len(nodes), at[: len(a)], at[len(a) :])
    part = np.full(len(nodes), TaskContext.get().partitionId(), np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[top]), pa.array(part)], names=["node", "up", "part"])


def connected_components(edges: DataFrame, written: Callable[[DataFrame, str], DataFrame], joined: Callable[..., DataFrame] = DataFrame.join) -> DataFrame:
    """(node, label) of all nodes of edges (a, b): label is the smallest node of the node's component.

    In each round the edges are dealt by a hash of both ends, so that a node of many edges lies in many partitions, and
    every partition, of the size that Spark's shuffle settings give it, replaces its own by stars. If there was one partition that is the answer. Otherwise every node points to its
    smallest neighbour, pointers are shortened, the edges contracted along them, and the next round begins. A node
    gets one row in each step, whatever its degree: neighbours meet as a minimum, which is combined before the
    shuffle. `written` stores a table and reads it again; `joined` joins two tables by a column.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    labels = None
    while True:
        stars = written(edges.repartition("a", "b").mapInArrow(_stars, "node long, up long, part int"), "stars")
        parts = stars.select("part").distinct().limit(2).count()
        if parts < 2:
            up = stars.select("node", "up")
        else:
            far = stars.filter("node <> up")
            both = far.select(F.col("node").alias("a"), F.col("up").alias("b")).unionByName(far.select(F.col("up").alias("a"), F.col("node").alias("b")))
            up = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
            up = written(up, "pointers")
            for _ in range(JUMPS):
                above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
                up = joined(up, above, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
            up = written(up, "pointers")
        if labels is None:
            labels = up.withColumnRenamed("up", "label")
        else:
            labels = joined(labels, up.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        if parts < 2:
            return labels
        labels = written(labels, "labels")
        a, b = up.select(F.col("node").alias("a"), F.col("up").alias("_a")), up.select(F.col("node").alias("b"), F.col("up").alias("_b"))
        pairs = joined(joined(far.select(F.col("node").alias("a"), F.col("up").alias("b")), a, "a"), b, "b").filter("_a <> _b")
        edges = written(pairs.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "contracted")
        if edges.isEmpty():
            return labels
