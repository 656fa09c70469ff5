"""The core's pN_ queries: profile of loads (2), rolling totals (4), orphan references (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.operators import load_profile, orphans, rolling
from loomlake.sources.tables import first_delivery, table

P2_TABLES = ("visits", "billing", "patients")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return load_profile.load_findings(spark, folder)


def p2_load_figures(spark: SparkSession, folder: str) -> DataFrame:
    d = load_profile.load_figures(spark, folder)
    return d.select("table_name", "column_name", F.col("load_id").cast("int").alias("load_id"), "finding", F.round("figure", 6).alias("figure"))


def p2_column_profile(spark: SparkSession, folder: str) -> DataFrame:
    d = load_profile.table_profiles(spark, folder)
    return d.select("table_name", "column_name", "n_rows", "n_nulls", "n_distinct", "lo", "hi")


def _visit_days(visits: DataFrame) -> DataFrame:
    return rolling.daily(visits, "patient_id", "visit_date", "bill_amount")


def p4_rolling_totals(spark: SparkSession, folder: str) -> DataFrame:
    visits = first_delivery(table(spark, folder, "visits"), "visit_id", ["patient_id", "visit_date", "bill_amount"])
    return rolling.trailing_totals(_visit_days(visits)).withColumnsRenamed({"entity": "patient_id", "day": "visit_day"})


def _corrected(spark: SparkSession, folder: str) -> DataFrame:
    """Trees of all loads but the last, corrected by the last."""
    visits = first_delivery(table(spark, folder, "visits"), "visit_id", ["patient_id", "visit_date", "bill_amount"])
    last = F.lit(table(spark, folder, "visits").agg(F.max("load_id")).first()[0]).cast("int")
    trees = rolling.segment_trees(_visit_days(visits.where(F.col("load_id") < last)))
    return rolling.apply_corrections(trees, _visit_days(visits.where(F.col("load_id") == last)))


def p4_corrected_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The totals answered from the corrected trees."""
    return rolling.trailing_from_trees(_corrected(spark, folder)).withColumnsRenamed({"entity": "patient_id", "day": "visit_day"})


def p4_corrected_trees(spark: SparkSession, folder: str) -> DataFrame:
    """The root of each corrected tree."""
    return _corrected(spark, folder).select(
        F.col("entity").alias("patient_id"), "shard", (F.round(F.element_at("sums", -1), 2) + F.lit(0.0)).alias("total"), F.element_at("counts", -1).cast("long").alias("n_amounts")
    )


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_references(spark, folder)


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_report(spark, folder)


QUERIES = {
    "p2_found": p2_found,
    "p2_load_figures": p2_load_figures,
    "p2_column_profile": p2_column_profile,
    "p4_rolling_totals": p4_rolling_totals,
    "p4_corrected_totals": p4_corrected_totals,
    "p4_corrected_trees": p4_corrected_trees,
    "p7_found": p7_found,
    "p7_report": p7_report,
}
