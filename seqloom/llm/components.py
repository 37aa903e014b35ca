"""Connected components of an edge table."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Up to so many edges one task finds the components; more take rounds of large and small stars.
LOCAL_EDGES = 250_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or smaller) neighbours to its smallest one. Edges have u > v."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.withColumnRenamed("m", "v")).distinct()


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = root(u), root(v)
            parent[max(u, v)] = min(u, v)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "component"])


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of all nodes of edges (a, b); component is the smallest node reachable.

    Edges may repeat or link a node with itself; rows with a null end are ignored. Nodes that
    only link with themselves are not returned.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.save(now, f"{name}-0")
    if now.count() <= LOCAL_EDGES:
        return scratch.save(now.repartition(1).mapInArrow(_union_find, "node long, component long"), f"{name}-nodes")
    before, i = None, 0
    while (state := _state(now)) != before:
        before, i = state, i + 1
        now = scratch.save(_star(_star(now, True), False), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
