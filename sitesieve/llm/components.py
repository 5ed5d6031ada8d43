"""Connected components of a large edge table, by alternating star contraction.

Every round hangs the larger neighbours of a vertex on its smallest neighbour, then the smaller ones; the
edges end as stars around the smallest vertex of each component. Edges of one task are joined before. Rounds are cut by written tables; nothing
is collected. A vertex with very many edges is no hot task: its smallest neighbour is a partial aggregate
and the join back is one that adaptive execution can split.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .base import ROWS_OF_FILE, cut_few


# Vertices that a task remembers before it begins anew.
MOST_VERTICES = 500_000


def _roots(batches):
    """(v, root): the smallest vertex that a task's edges reach from `v`, for every vertex of them, once per `MOST_VERTICES`."""
    parent: dict[int, int] = {}

    def top(v: int) -> int:
        while (up := parent.setdefault(v, v)) != v:
            parent[v] = v = parent[up]
        return v

    def told():
        names = list(parent)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(map(top, names), pa.int64())], ["v", "root"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > MOST_VERTICES:
            yield told()
            parent.clear()
    yield told()


def nearer_roots(edges: DataFrame) -> DataFrame:
    """(v, root): for every vertex of `edges` a vertex it can reach, in one shuffle; equal roots are connected.

    Connected vertices may keep different roots, where only edges of different tasks connect them.
    """
    a, b = edges.columns
    plain = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b"))
    return plain.mapInArrow(_roots, "v bigint, root bigint").groupBy("v").agg(F.min("root").alias("root"))


def _hang(edges: DataFrame, larger: bool) -> DataFrame:
    """Edges (a, b) after a large-star (`larger`) or small-star step."""
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        root = both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = both.filter("b > a").join(root, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        root = down.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        own = root.select(F.col("k").alias("a"), F.col("m").alias("b"))
        joined = down.join(root, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)
    # a large-star step makes no more rows than there were, and a small-star step follows
    hung = joined.filter("a <> b")
    return hung if larger else hung.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, component): for every vertex of `edges` (two integer columns) the smallest vertex it can reach."""
    a, b = edges.columns
    plain = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).filter("a <> b")
    # what a task can join alone is joined before the first round
    state = cut_lineage(plain.mapInArrow(_roots, "a bigint, b bigint").filter("a <> b"))
    known, n = None, state.count()
    while True:
        # a round makes no more than one row besides of each
        state = cut_few(_hang(_hang(state, True), False), 2 * n, 10 * ROWS_OF_FILE)
        sign = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (sign["n"], sign["s"]) == known:
            break
        known = (sign["n"], sign["s"])
        n = sign["n"]
    leaves = state.select(F.col("a").alias("v"), F.col("b").alias("component"))
    return leaves.unionByName(state.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct())
