"""Exact percentiles per group by a full distributed sort with per-partition counts.

The state of a load is its counted runs (group, value, n).  States of separate
loads, days or partitions combine by adding the counts of equal runs; the error
of a percentile taken from any combination is 0, as no value is ever summarised.
The sort, the offsets of each group in each partition, and the interpolation of
the two neighbouring order statistics are in ``loomlake.operators.ordered``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.operators.ordered import quantiles, ranged_runs, with_positions

WANTED = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def load_state(records: DataFrame, group: str, value: str, load: str = "load_id") -> DataFrame:
    """(load_id, group, value, n); null, NaN and infinite values are left out, a null group is a group."""
    v = F.col(value)
    return (
        records.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        .groupBy(F.col(load).alias("load_id"), F.col(group).alias("grp"), (v + F.lit(0.0)).alias("value"))
        .agg(F.count("*").alias("n"))
    )


def combine(state: DataFrame, keep: list[str]) -> DataFrame:
    """Add up states over everything but ``keep``."""
    return state.groupBy(*keep, "value").agg(F.sum("n").alias("n"))


def exact_percentiles(runs: DataFrame, groups: list[str], wanted: dict[str, float] | None = None) -> DataFrame:
    """(groups, n, one column per percentile) from counted runs (groups, value, n)."""
    return quantiles(with_positions(ranged_runs(runs, groups, "value"), groups, "value", ["n"]), groups, "value", "n", wanted or WANTED)
