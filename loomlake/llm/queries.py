"""The pN_ queries of the llm problems: name -> callable(spark, folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.llm import addresses, canonical, packing, percentiles, same_names, stuffing, tokenizing
from loomlake.sources.tables import first_delivery, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_names.name_pairs(table(spark, folder, "visits"), table(spark, folder, "patients"))


def p1_doctors(spark: SparkSession, folder: str) -> DataFrame:
    """One row per spelling that names a doctor, with its group."""
    return same_names.doctor_groups(table(spark, folder, "visits"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    listed = canonical.reference_list(table(spark, folder, "canonical_values"))
    listed = [x for x in listed if x[0] in ("insurance_provider", "department", "diagnosis")]
    visits = table(spark, folder, "visits")
    values = table(spark, folder, "patients").select(F.lit("insurance_provider").alias("field_name"), F.col("patient_id").alias("record_key"), F.col("insurance_provider").alias("value"))
    for field in ("department", "diagnosis"):
        values = values.unionByName(visits.select(F.lit(field).alias("field_name"), F.col("visit_id").alias("record_key"), F.col(field).alias("value")))
    return canonical.mapped(values, listed).distinct()


def p3_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Report of values that denote no entry: how many records of each field."""
    found = p3_found(spark, folder)
    return found.groupBy("field_name").agg(F.count("*").alias("n_cases"), F.count_if(F.col("canonical_id") == canonical.NONE).alias("n_unmatched"))


def _load_state(spark: SparkSession, folder: str) -> DataFrame:
    records = first_delivery(table(spark, folder, "visits"), "visit_id", ["department", "bill_amount"])
    return percentiles.load_state(records, "department", "bill_amount")


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Per department as written, over all loads' states combined; the error is 0 by construction."""
    runs = percentiles.combine(_load_state(spark, folder), ["grp"])
    out = percentiles.exact_percentiles(runs, ["grp"])
    return out.select(F.col("grp").alias("department"), F.col("n").alias("n_amounts"), *[F.round(c, 4).alias(c) for c in percentiles.WANTED], F.lit(0.0).alias("max_error"))


def p5_load_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Per load and department: the states before they are combined."""
    out = percentiles.exact_percentiles(_load_state(spark, folder), ["load_id", "grp"])
    return out.select("load_id", F.col("grp").alias("department"), F.col("n").alias("n_amounts"), *[F.round(c, 4).alias(c) for c in percentiles.WANTED])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return addresses.same_place_pairs(table(spark, folder, "patients"))


def p6_places(spark: SparkSession, folder: str) -> DataFrame:
    """One row per patient record with a place: its class and how many patients live there."""
    p = addresses.places(table(spark, folder, "patients"))
    sizes = p.groupBy("place").agg(F.count("*").alias("n_patients"))
    return p.join(sizes, "place")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizing.token_ids(table(spark, folder, "documents"))


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Ids back to text; null and empty texts both come back empty."""
    return tokenizing.decoded(p8_ids(spark, folder))


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(tokenizing.token_counts(table(spark, folder, "documents")))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _placed(spark, folder)


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(_placed(spark, folder))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.stuffed(table(spark, folder, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_doctors": p1_doctors,
    "p3_found": p3_found,
    "p3_unmatched": p3_unmatched,
    "p5_percentiles": p5_percentiles,
    "p5_load_percentiles": p5_load_percentiles,
    "p6_found": p6_found,
    "p6_places": p6_places,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p9_containers": p9_containers,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
}
