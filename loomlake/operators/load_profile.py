"""Changes between the loads of a table: nulls, ranges, patterns, distributions.

Row counts and nulls per load come from the Parquet footers (``footers``); only
row groups that hold several loads are opened for them.  Coded columns are counted
by the dictionaries of their chunks.  Amounts, of which no footer tells how many
lie beyond a limit, are scanned once, as counted runs (column, load, value), and
their figures come from the runs: the median and the range limit, the shares, and
the exact Kolmogorov-Smirnov distance of one load from all others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.operators.footers import coded_counts, column_profile, load_nulls
from loomlake.operators.ordered import quantiles, ranged_runs, with_positions
from loomlake.session import durable
from loomlake.sources.tables import table

NULL_RATE, RANGE_SHARE, PATTERN_SHARE, DISTANCE, TIMES_MEDIAN = 0.10, 0.05, 0.20, 0.30, 50


@dataclass(frozen=True)
class Watched:
    table: str
    amounts: tuple[str, ...] = ()
    coded: tuple[str, ...] = ()  # columns held against canonical_values


CLINIC = (Watched("visits", ("bill_amount",)), Watched("billing", ("copay_amount",), ("payment_status",)))


def null_rates(spark: SparkSession, folder: str, watched: tuple[Watched, ...] = CLINIC) -> DataFrame:
    """(table_name, column_name, load_id, rows, nulls, share, usual): usual is the median of the loads' shares."""
    out = None
    for w in watched:
        part = load_nulls(spark, f"{folder}/{w.table}.parquet", "load_id", [*w.amounts, *w.coded]).withColumn("table_name", F.lit(w.table))
        out = part if out is None else out.unionByName(part)
    whole = Window.partitionBy("table_name", "column_name")
    return out.withColumn("share", F.col("nulls") / F.col("rows")).withColumn("usual", F.percentile("share", 0.5).over(whole))


def amount_runs(spark: SparkSession, folder: str, watched: tuple[Watched, ...]) -> DataFrame:
    """Counted runs of all amounts: (table_name, column_name, load_id, kind, value, n); kind is finite, nan or infinite."""
    out = None
    for w in watched:
        for c in w.amounts:
            v = F.col(c)
            kind = F.when(F.isnan(v), "nan").when(F.abs(v) == float("inf"), "infinite").otherwise("finite")
            part = (
                table(spark, folder, w.table)
                .where(v.isNotNull())
                .select(F.lit(w.table).alias("table_name"), F.lit(c).alias("column_name"), "load_id", kind.alias("kind"), F.when(kind == "finite", v + F.lit(0.0)).alias("value"))
                .groupBy("table_name", "column_name", "load_id", "kind", "value")
                .agg(F.count("*").alias("n"))
            )
            out = part if out is None else out.unionByName(part)
    return out


KEY = ["table_name", "column_name"]


def amount_findings(spark: SparkSession, folder: str, watched: tuple[Watched, ...]) -> DataFrame:
    """``range`` and ``distribution`` figures: (table_name, column_name, load_id, finding, figure, exceeds)."""
    runs = durable(amount_runs(spark, folder, watched))
    total = ranged_runs(runs.where("kind = 'finite'").groupBy(*KEY, "value").agg(F.sum("n").alias("n")), KEY, "value")
    median = quantiles(with_positions(total, KEY, "value", ["n"]), KEY, "value", "n", {"median": 0.5})
    limits = durable(median.select(*KEY, "median"))  # one row per watched column
    judged = runs.join(F.broadcast(limits), KEY, "left").withColumn(
        "out", (F.col("kind") != "finite") | (F.col("value") < 0) | (F.col("value") > TIMES_MEDIAN * F.col("median"))
    )
    share = (
        judged.groupBy(*KEY, "load_id")
        .agg((F.sum(F.when(F.col("out"), F.col("n")).otherwise(0)) / F.sum("n")).alias("figure"))
        .select(*KEY, "load_id", F.lit("range").alias("finding"), "figure", (F.col("figure") > RANGE_SHARE).alias("exceeds"))
    )
    kept = judged.where(~F.col("out")).select(*KEY, "load_id", "value", "n")
    # rows at and below each value: over all loads, and in each load
    everything = ranged_runs(kept.groupBy(*KEY, "value").agg(F.sum("n").alias("t")), KEY, "value")
    placed = with_positions(everything, KEY, "value", ["t"]).select(*KEY, "value", "t", "t_upto", "t_all")
    own = with_positions(ranged_runs(kept, [*KEY, "load_id"], "value"), [*KEY, "load_id"], "value", ["n"])
    both = own.join(placed, [*KEY, "value"])
    rest_all = F.col("t_all") - F.col("n_all")
    at = F.col("n_upto") / F.col("n_all") - (F.col("t_upto") - F.col("n_upto")) / F.nullif(rest_all, F.lit(0))
    under = (F.col("n_upto") - F.col("n")) / F.col("n_all") - (F.col("t_upto") - F.col("t") - (F.col("n_upto") - F.col("n"))) / F.nullif(rest_all, F.lit(0))
    # between two of its own values a load's curve is flat and the other rises: the distance is greatest at, or just before, one of them
    ks = both.groupBy(*KEY, "load_id").agg(F.max(F.greatest(F.abs(at), F.abs(under))).alias("figure"))
    return share.unionByName(ks.select(*KEY, "load_id", F.lit("distribution").alias("finding"), "figure", (F.col("figure") > DISTANCE).alias("exceeds")))


def coded_findings(spark: SparkSession, folder: str, watched: tuple[Watched, ...]) -> DataFrame:
    """``pattern`` and ``distribution`` figures of coded columns, same columns as ``amount_findings``."""
    out = None
    listed = table(spark, folder, "canonical_values").select(F.col("field_name"), F.col("canonical_value").alias("entry")).distinct()
    for w in watched:
        for c in w.coded:
            # the list is a fixed table of entries; the counts are (load, value)
            counts = coded_counts(spark, f"{folder}/{w.table}.parquet", "load_id", c)
            mine = listed.where(F.col("field_name") == c)
            counts = durable(counts.join(mine, counts["value"] == mine["entry"], "left").select("load_id", "value", "n", F.col("entry").isNotNull().alias("listed")))
            base = (F.lit(w.table).alias("table_name"), F.lit(c).alias("column_name"))
            pattern = (
                counts.groupBy("load_id")
                .agg((F.sum(F.when(F.col("listed"), 0).otherwise(F.col("n"))) / F.sum("n")).alias("figure"))
                .select(*base, "load_id", F.lit("pattern").alias("finding"), "figure", (F.col("figure") > PATTERN_SHARE).alias("exceeds"))
            )
            good = counts.where("listed")
            loads = good.groupBy("load_id").agg(F.sum("n").alias("load_n"))
            entries = good.groupBy("value").agg(F.sum("n").alias("entry_n"))
            all_n = F.lit(good.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
            here = good.select("load_id", "value", "n").join(loads, "load_id").join(entries, "value")
            rest = F.nullif(all_n - F.col("load_n"), F.lit(0))
            part = F.abs(F.col("n") / F.col("load_n") - (F.col("entry_n") - F.col("n")) / rest)
            # an entry that a load lacks differs by its whole share in the other loads
            lacking = (all_n - F.sum("entry_n")) / F.max(rest)
            tv = here.groupBy("load_id").agg(((F.sum(part) + lacking) / 2).alias("figure")).select(*base, "load_id", F.lit("distribution").alias("finding"), "figure", (F.col("figure") > DISTANCE).alias("exceeds"))
            both = pattern.unionByName(tv)
            out = both if out is None else out.unionByName(both)
    return out


def load_figures(spark: SparkSession, folder: str, watched: tuple[Watched, ...] = CLINIC) -> DataFrame:
    """Every figure of every load: (table_name, column_name, load_id, finding, figure, exceeds).

    A load whose values are all null has no range, pattern or distribution figure;
    a single load has no distribution figure (null), as there are no others.
    """
    rates = null_rates(spark, folder, watched).select(
        *KEY, "load_id", F.lit("null_rate").alias("finding"), F.col("share").alias("figure"), (F.abs(F.col("share") - F.col("usual")) > NULL_RATE).alias("exceeds")
    )
    out = rates.unionByName(amount_findings(spark, folder, watched))
    coded = coded_findings(spark, folder, watched)
    return out if coded is None else out.unionByName(coded)


def load_findings(spark: SparkSession, folder: str, watched: tuple[Watched, ...] = CLINIC) -> DataFrame:
    """(table_name, column_name, load_id, finding): the figures beyond their limits."""
    return load_figures(spark, folder, watched).where("exceeds").select(*KEY, F.col("load_id").cast("int").alias("load_id"), "finding")


PROFILED = {
    "visits": ["visit_id", "patient_id", "visit_date", "department", "diagnosis", "doctor_name", "treatment", "bill_amount", "status", "clinic_id", "load_id"],
    "billing": ["billing_id", "visit_id", "patient_id", "procedure_code", "insurance_covered", "copay_amount", "payment_status", "billing_date", "load_id"],
    "patients": ["patient_id", "first_name", "last_name", "dob", "gender", "blood_type", "phone", "address", "insurance_provider", "load_id"],
}


def table_profiles(spark: SparkSession, folder: str, tables: dict[str, list[str]] | None = None) -> DataFrame:
    """``column_profile`` of each table, with table_name."""
    out = None
    for name, columns in (tables or PROFILED).items():
        part = column_profile(spark, f"{folder}/{name}.parquet", columns).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
