"""Connected components of a large, sparse graph by minimum labels, with durable rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.session import durable

MOST_ROUNDS = 40
FEW = 400_000  # edges up to this number, counted first, are settled by one task


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges of a task by union-find."""
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    if kind is not None:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([root(x) for x in up], kind)], names=["node", "component"])


def _signature(edges: DataFrame) -> tuple:
    """Number of edges and two sums over their hashes: equal for equal sets, and never in practice for others."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its least node.

    Each round, large stars then small stars: every node is joined to the least
    node it knows, so paths halve and a hub never gathers more than its own
    neighbours' labels, pre-aggregated before the shuffle.  Loops and repeated
    edges do no harm; without edges the result is empty.  A graph of few edges
    comes out the same from one task.
    """
    now = durable(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = _signature(now)
    if seen[0] <= FEW:
        kind = dict(now.dtypes)["a"]
        return now.coalesce(1).mapInArrow(_settled, f"node {kind}, component {kind}")
    for _ in range(MOST_ROUNDS):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("low").alias("a"), F.col("v").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: of each node's smaller neighbours, all point to the least
        low2 = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low2, "b").select(F.col("low").alias("x"), "a", "b")
        after = small.select(F.col("x").alias("a"), F.col("b")).unionByName(small.where("a <> x").select(F.col("x").alias("a"), F.col("a").alias("b"))).distinct()
        now = durable(after)
        seen, before = _signature(now), seen
        if seen == before:
            roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
