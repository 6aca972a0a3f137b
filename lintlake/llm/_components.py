"""Connected components of an undirected graph whose edges stay distributed."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lintlake.llm._store import keep

MAX_ROUNDS = 60  # rounds grow with the logarithm of the longest path; this many never occur


def _contract(batches):
    """Stars with the same components as the edges of one partition."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for at in range(0, len(nodes), 50_000):
        part = nodes[at:at + 50_000]
        yield pa.RecordBatch.from_pydict({
            "u": pa.array(part, pa.int64()), "v": pa.array([find(x) for x in part], pa.int64()),
        })


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(low, "u").where(F.col("v") > F.col("u"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where(F.col("v") != F.col("m"))
    return low.select("u", F.col("m").alias("v")).unionByName(
        moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge and no root has any: then nothing is left to move."""
    ends = F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")),
    )).alias("e")
    nodes = edges.select(ends).select("e.*").groupBy("node").agg(
        F.sum("up").alias("up"), F.max("root").alias("root")
    )
    return nodes.where("up > 1 or up = 1 and root = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge other than the root itself; the root is the
    smallest node of the component. `edges` has two long columns, in any order and repeated at will.

    Each round joins edges with the smallest neighbour of a node, once for larger and once for
    smaller neighbours, so a node with very many edges is a join key that adaptive execution splits
    and never a list. Frames stay linear in the edges.
    """
    a, b = edges.columns
    stars = edges.where(F.col(a) != F.col(b)).mapInArrow(_contract, "u long, v long").distinct()
    state = keep(stars, "edges")
    for _ in range(MAX_ROUNDS):
        if _settled(state):
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = keep(_small_star(_large_star(state)).distinct(), "edges")
    raise RuntimeError("components did not settle")
