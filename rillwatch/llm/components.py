"""Connected components of an edge table."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rounds

TASK_EDGES = 500_000
_EDGES = "a bigint, b bigint"


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges and the smallest node each can reach: hooking and pointer jumping."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[left], root[right]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one task to one edge per node, to the smallest node it reaches within the task."""
    some = list(batches)
    if not some:
        return
    a, b = (np.concatenate([x.column(n).to_numpy() for x in some]) for n in ("a", "b"))
    nodes, roots = local_components(a, b)
    keep = nodes != roots
    yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], ["a", "b"])


def connected_components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """node and component (its smallest reachable node) of every node on an edge with two ends.

    Edges are dealt into tasks of about ``task_edges`` and contracted there. If that took more than one
    task, large-star and small-star rounds bring every node to its component's smallest node; each round
    is stored, so a lost executor costs one round, and its table goes with the next. A node with very many edges is split by the skew join.
    """
    rounds = Rounds()
    known = rounds.store(edges.select("a", "b").where("a <> b"), "all-edges")
    tasks = 1 + known.count() // task_edges
    edges = rounds.store(known.repartition(tasks).mapInArrow(_contract, _EDGES), "edges")
    before = None
    while tasks > 1:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low"))
        least = least.select("a", F.least("a", "low").alias("low"))
        large = (
            both.join(least, "a")
            .where((F.col("b") > F.col("a")) & (F.col("b") != F.col("low")))
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .distinct()
        )
        large = rounds.store(large, "large-star-edges")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        # a node's own edge to the smallest comes from its row with that neighbour
        joined = large.join(least, "a")
        small = (
            joined.select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(joined.select("a", F.col("low").alias("b")))
            .where("a <> b")
            .distinct()
        )
        edges = rounds.store(small, "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
