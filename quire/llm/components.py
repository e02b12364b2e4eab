"""Connected components of an edge table, without collecting edges or labels to the driver.

Edges are first contracted within partitions by union-find. What is left is solved in one task where it has at most
SMALL edges, a size that one task holds; otherwise by rounds of large-star and small-star, each written to the shared
folder, until the edges no longer change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut

SMALL = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    n = len(a)
    for x, y in zip(at[:n].tolist(), at[n:].tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    for x in range(len(parent)):
        parent[x] = parent[parent[x]]
    return nodes, nodes[np.array(parent, dtype=np.int64)] if len(nodes) else nodes


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for x in batches:
        a, b = np.concatenate([a, x.column(0).to_numpy()]), np.concatenate([b, x.column(1).to_numpy()])
        if len(a) > 500_000:
            a, b = roots(a, b)
            a, b = a[a != b], b[a != b]
    node, root = roots(a, b)
    keep = node != root
    yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """edges: two long columns. Returns node and component (its least node) for every node that is not its own least."""
    a, b = edges.columns
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    local = cut(edges.mapInArrow(contract, "a long, b long"), "cc-local")
    if local.count() <= SMALL:
        return cut(local.repartition(1).mapInArrow(contract, "a long, b long"), "cc").toDF("node", "component")
    before = None
    while True:
        both = local.union(local.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        local = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct(), "cc-round")
        now = local.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return local.toDF("node", "component")
        before = now
