"""Connected components of an edge table: by alternating large-star and small-star steps, or, of few edges, in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotweave.llm.storage import Scratch, materialise


#: So many edges at most are joined in one task (16 MB of them); more go through rounds of joins.
LOCAL_EDGES = 1_000_000


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges of one task, by halving the ways to the smallest node."""
    held = list(batches)
    if not held:
        return
    edges = np.stack([np.concatenate([np.asarray(b.column(c)) for b in held]) for c in ("u", "v")])
    nodes, at = np.unique(edges, return_inverse=True)
    u, v = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        a, b = root[u], root[v]
        low = np.minimum(a, b)
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(root, a[apart], low[apart])
        np.minimum.at(root, b[apart], low[apart])
        while True:
            above = root[root]
            if np.array_equal(above, root):
                break
            root = above
    for start in range(0, len(nodes), 10_000):
        part = slice(start, start + 10_000)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[root[part]])], ["node", "component"])


def connected_components(edges: DataFrame, max_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node.

    Up to ``local_edges`` distinct edges are joined in one task of an executor.  Beyond, each step hangs neighbours on the
    smallest node in sight, until every component is a star on its smallest node.  A round is two map-side combined minimums and two equi-joins on pairs of longs; it is written to the shared scratch
    folder, and only its row count and a checksum come to the driver.  The minimums of the first step are written before
    they are joined, so that the edges of a hub can be split.  The result is a table of its own there.
    """
    with Scratch(edges.sparkSession) as scratch:
        e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        e = scratch.table(e, "cc-0")
        if e.count() <= local_edges:
            return materialise(e.coalesce(1).mapInArrow(_join, "node long, component long"), "components")
        last = None
        for k in range(max_rounds):
            # large star: every larger neighbour of u hangs on the smallest of u and its neighbours
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"cc-low-{k}")
            large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
            # small star: u and its smaller neighbours hang on the smallest of them
            down = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
            after = scratch.table(small.distinct(), f"cc-{k + 1}")
            scratch.drop(e, low)
            e = after
            now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == last:
                break
            last = now
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
            e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        )
        return materialise(out, "components")
