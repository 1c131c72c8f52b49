"""Connected components of an edge table, by alternating large and small stars, all in the cluster.

Vertices are non-null longs. Each round is aggregates with map-side partial minima and joins whose hot side adaptive
execution can split; each round's edges are written to the shared folder. Rounds end when the edges stay the same.
A graph of at most SMALL edges (a few MB) is solved by the driver instead: a chain of many small rounds leaves the driver
with a record of each of their stages and tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SMALL = 200_000


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of a graph, and for each one the smallest that it reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    lab = np.arange(len(nodes))
    while len(a):
        x, y = lab[a], lab[b]
        np.minimum.at(lab, np.maximum(x, y), np.minimum(x, y))
        while True:
            flat = lab[lab]
            if (flat == lab).all():
                break
            lab = flat
        left = lab[a] != lab[b]
        a, b = a[left], b[left]
    return nodes, nodes[lab]


def components(edges: DataFrame, scratch: Scratch, small: int = SMALL) -> DataFrame:
    """edges (u, v) -> (node, component): the smallest vertex reachable. Vertices without edges don't appear."""
    edges = scratch.keep(
        edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    seen = _mark(edges)
    if 0 < seen[0] <= small:
        table = edges.toArrow()
        node, component = roots(*(table[c].to_numpy() for c in ("u", "v")))
        scratch.drop(edges)
        return scratch.keep(edges.sparkSession.createDataFrame(pa.table({"node": node, "component": component})), "components")
    while seen[0]:
        # Large star: every larger neighbour of a vertex points to the least of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = edges.join(least, "v").select("u", F.col("m").alias("v")).distinct()
        # Small star: a vertex and its smaller neighbours point to the least of them.
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        after = scratch.keep(small.where("u <> v").distinct(), "edges")
        now = _mark(after)
        scratch.drop(edges)
        edges = after
        if now == seen:
            break
        seen = now
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
