"""Connected components of a graph given by its edges, by large-star and small-star rounds.

Edges are contracted within each task first, where they are made and once dealt by node (a task passes on a forest of what it
read). A round then links each node's larger neighbours, and after that its smaller ones, to the smallest of them; it stops when
each node has one edge, to its root. Hubs, of which there are few, get their minimum from a broadcast of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrel.llm import common

EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])
#: Edges that a task contracts at once.
AT_ONCE = 500_000
#: Nodes with more than this share of all edge ends are hubs.
HOT_SHARE = 1 / 400


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that these edges reach) for all nodes but the smallest ones."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        before = root.copy()
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while not np.array_equal(again := root[root], root):
            root = again
        if np.array_equal(before, root):
            break
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


class Contraction:
    """Edges gathered in a task, passed on as a forest of each AT_ONCE of them."""

    def __init__(self):
        self.u, self.v, self.n = [], [], 0

    def add(self, u: np.ndarray, v: np.ndarray):
        """Takes edges; yields a batch whenever there are enough."""
        self.u.append(u)
        self.v.append(v)
        self.n += len(u)
        if self.n > AT_ONCE:
            yield from self.rest()

    def rest(self):
        if self.n:
            a, b = forest(np.concatenate(self.u), np.concatenate(self.v))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=EDGE)
        self.u, self.v, self.n = [], [], 0


def contracted(edges: DataFrame) -> DataFrame:
    def run(batches):
        held = Contraction()
        for batch in batches:
            yield from held.add(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield from held.rest()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Adds m, by u. least: u, m, degree, with degrees that sum up to `total` at most. Nodes of a degree above HOT_SHARE of it, which
    are fewer than 1 / HOT_SHARE, are broadcast, so that no task reads all edges of a hub; the others are joined by u."""
    most = max(1000, int(total * HOT_SHARE))
    hubs = F.broadcast(least.where(F.col("degree") > most).select("u", F.col("m").alias("hub_m")))
    marked = edges.join(hubs, "u", "left")
    usual = marked.where("hub_m IS NULL").select("u", "v").join(least.where(F.col("degree") <= most).select("u", "m"), "u")
    return usual.unionByName(marked.where("hub_m IS NOT NULL").select("u", "v", F.col("hub_m").alias("m")))


def is_star(edges: DataFrame) -> bool:
    """Whether each node has one edge to its root, or is a root."""
    child = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root"))
    ends = child.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 OR (up > 0 AND root > 0)").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """edges: u, v (long), contracted in their tasks already. Returns node, root for each node with an edge, root the smallest node of
    its component."""
    # with all edges of a node in one task a node keeps one edge from there
    now = common.cut(contracted(edges.repartition("u")))
    while not is_star(now):
        total = 2 * now.count()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
        large = with_least(both.where("v > u"), least, total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = with_least(large, least, total).select(F.explode(pairs).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        now = common.cut(small)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
