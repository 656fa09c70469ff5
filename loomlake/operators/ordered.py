"""Global order statistics over sorted, counted runs.

A *run* is (group, value, how often).  Runs are range-partitioned over the
whole cluster by (group, value), so that a group holding a third of all rows
spreads over a third of the partitions; equal values were merged before, with
partial aggregation on the map side.  Every run then learns the number of rows
before it in its group from two prefix sums: one over the partitions of its
group (a table of partitions x groups touched), one inside its own partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.session import durable

RUNS_PER_PARTITION = 50_000


def same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Null-safe equality on ``columns``."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def ranged_runs(runs: DataFrame, groups: list[str], value: str, partitions: int | None = None) -> DataFrame:
    """Runs in global order, with the partition they lie in as ``_pid``; written once.

    The cut is needed: a range partitioning recomputed after the loss of an
    executor may draw other borders, and the offsets would no longer fit.
    """
    runs = durable(runs)  # also read to count it and to draw the borders
    n = partitions or max(1, -(-runs.count() // RUNS_PER_PARTITION))
    return durable(runs.repartitionByRange(n, *groups, value).withColumn("_pid", F.spark_partition_id()))


def with_positions(ranged: DataFrame, groups: list[str], value: str, counts: list[str]) -> DataFrame:
    """Add for each count column c: ``c_upto`` (rows at or below, in the group) and ``c_all`` (rows of the group)."""
    per = ranged.groupBy("_pid", *groups).agg(*[F.sum(c).alias(c) for c in counts])
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = per.select(
        F.col("_pid").alias("_opid"),
        *[F.col(g).alias(f"_o_{g}") for g in groups],
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_off_{c}") for c in counts],
        *[F.sum(c).over(whole).alias(f"{c}_all") for c in counts],
    )
    cond = ranged["_pid"] == offsets["_opid"]
    for g in groups:
        cond = cond & ranged[g].eqNullSafe(offsets[f"_o_{g}"])
    inside = Window.partitionBy("_pid", *groups).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(offsets, cond)
    for c in counts:
        joined = joined.withColumn(f"{c}_upto", F.sum(c).over(inside) + F.col(f"_off_{c}"))
    return joined.drop("_opid", *[f"_o_{g}" for g in groups], *[f"_off_{c}" for c in counts])


def quantiles(positioned: DataFrame, groups: list[str], value: str, count: str, wanted: dict[str, float]) -> DataFrame:
    """Exact quantiles per group by linear interpolation of neighbouring order statistics.

    The position of quantile q among n values is (n - 1) q.  Each run that covers
    one of the two ranks beside it hands over its value; all other runs are
    dropped before anything is gathered.
    """
    n = F.col(f"{count}_all")
    first, last = F.col(f"{count}_upto") - F.col(count), F.col(f"{count}_upto") - 1
    picks = []
    for name, q in wanted.items():
        at = (n - 1) * F.lit(float(q))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.when(rank.between(first, last), F.col(value)).alias(f"_{name}_{side}"))
    hits = positioned.select(*groups, n.alias("_n"), *picks)
    hits = hits.where(F.greatest(*[F.col(p).isNotNull() for p in hits.columns if p.startswith("_") and p != "_n"]))
    gathered = hits.groupBy(*groups).agg(
        F.max("_n").alias("n"), *[F.max(c).alias(c) for c in hits.columns if c not in (*groups, "_n")]
    )
    out = []
    for name, q in wanted.items():
        at = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return gathered.select(*groups, "n", *out)
