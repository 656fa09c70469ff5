"""Exact radius joins of names by metric-space partitioning.

Names meet only inside a block (a clinic, a date of birth, ...).  A block of n
different names has ceil(sqrt(n) / 4) pivots: every name belongs to the cell of
its nearest pivot, and is replicated to each pivot p with
d(x, p) <= d(x, nearest) + 2r.  By the triangle inequality, of two names within
radius r the one's home cell then holds the other.  Inside a cell the Levenshtein
distance, a true metric, is computed for each home name against each name there.
A block has about n sqrt(n) / 4 distances to pivots, and one rule at every size.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_count(n: Column) -> Column:
    return F.ceil(F.sqrt(n) / 4)


def cells(names: DataFrame, radius: int) -> DataFrame:
    """(block, name, cell, home): each distinct (block, name) in its home cell, and in those it is replicated to."""
    each = names.select("block", "name").where(F.col("block").isNotNull() & F.col("name").isNotNull()).distinct()
    return placed(each, radius)


def placed(each: DataFrame, radius: int) -> DataFrame:
    """The rows of ``each`` (block, name, ...) with their cells; a name and block may stand in several rows."""
    several = each.groupBy("block").agg(F.count("*").alias("n")).where(pivot_count(F.col("n")) > 1)
    pivots = each.join(several.withColumnRenamed("n", "_n"), "block").where(F.pmod(F.xxhash64("name"), F.col("_n")) < pivot_count(F.col("_n"))).select("block", F.col("name").alias("pivot"))
    held = pivots.groupBy("block").agg(F.collect_set("pivot").alias("pivots"))  # about sqrt(n) / 4 of a block's n names
    away = F.transform("pivots", lambda p: F.struct(F.levenshtein(F.col("name"), p).alias("d"), p.alias("p")))
    far = each.join(held, "block", "left").withColumn("ps", away)
    nearest = F.array_min("ps")
    at = far.select(*each.columns, F.explode_outer(F.filter("ps", lambda x: x["d"] <= nearest["d"] + 2 * radius)).alias("x"), nearest["p"].alias("own"))
    return at.select(*each.columns, F.coalesce("x.p", F.lit("")).alias("cell"), F.coalesce(F.col("x.p") == F.col("own"), F.lit(True)).alias("home"))


def radius_join(records: DataFrame, radius: int, roles: tuple[tuple[str, str], ...] = (("", ""),), traits: tuple[str, ...] = (), fit: Callable[[str, str], Column] | None = None) -> DataFrame:
    """(a, b) with a < b: ids of records that share a block and have names at most ``radius`` apart there.

    ``records`` has (block, name, id); a record may have several names and blocks.
    With ``roles`` there is a column of that name, and only names of these pairs of
    roles meet.  ``fit(x, y)`` is a further condition on the columns ``traits`` of both
    sides, named with the prefixes ``x`` and ``y``.  First the different names of a
    block meet, then the records of those that are near.  Null blocks and names join
    nothing; repeated rows do no harm.
    """
    if roles == (("", ""),):
        records = records.withColumn("role", F.lit(""))
    records = records.select("block", "name", "role", "id", *traits).where(F.col("block").isNotNull() & F.col("name").isNotNull())
    records = records.withColumn("block", F.xxhash64("block"))  # short keys; blocks that fell together would only give more candidates
    at = placed(records.groupBy("block", "name", "role").agg((F.count("*") > 1).alias("several")), radius)
    side = lambda p: at.select("block", "cell", *[F.col(c).alias(f"{p}_{c}") for c in ("name", "role", "several", "home")])
    x, y = side("x").where("x_home").where(F.col("x_role").isin([a for a, _ in roles])), side("y").where(F.col("y_role").isin([b for _, b in roles]))
    allowed = [(F.col("x_role") == a) & (F.col("y_role") == b) & ((F.col("x_name") < F.col("y_name")) | (F.col("x_name") == F.col("y_name")) & F.col("x_several") if a == b else F.lit(True)) for a, b in roles]
    near = x.join(y, ["block", "cell"]).where(reduce(Column.__or__, allowed)).where(F.levenshtein("x_name", "y_name", radius) >= 0).select("block", "x_name", "x_role", "y_name", "y_role").distinct()
    of = lambda p: records.select("block", F.col("name").alias(f"{p}_name"), F.col("role").alias(f"{p}_role"), F.col("id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in traits])
    both = near.join(of("x"), ["block", "x_name", "x_role"]).join(of("y"), ["block", "y_name", "y_role"]).where("x_id <> y_id")
    if fit is not None:
        both = both.where(fit("x", "y"))
    return both.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()
