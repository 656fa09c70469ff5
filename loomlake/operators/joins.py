"""Joins that hold up when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.01
MOST_BROADCAST = 100_000  # rows of the one side for all hot keys together; beyond it the join is an ordinary one


def hot_values(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Values that may hold ``share`` of the rows or more: a superset of at most 2 / share values, in one pass without a shuffle."""
    found = df.select(F.col(key).alias("k")).where(F.col("k").isNotNull()).freqItems(["k"], share).collect()
    return [k for k in (found[0][0] or []) if k is not None] if found else []


def skewed_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", probe: DataFrame | None = None) -> DataFrame:
    """Join ``many`` to ``one``; ``how`` is inner or left.

    Hot keys are looked for in ``probe``, a cheap scan with the same keys under the
    same name; without one in ``many`` itself, which is then computed twice.  Rows of hot keys meet a broadcast of the few rows of ``one`` with those keys,
    whose number is checked; all others go through an ordinary shuffle.
    """
    hot = hot_values(many if probe is None else probe, key)
    if not hot or one.where(F.col(key).isin(hot)).limit(MOST_BROADCAST + 1).count() > MOST_BROADCAST:
        return many.join(one, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = many.where(~is_hot).join(one, key, how)
    warm = many.where(is_hot).join(F.broadcast(one.where(F.col(key).isin(hot))), key, how)
    return cold.unionByName(warm)
