"""The semantic model: measures over dimensions, and the graph of its artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from loomlake.functions.expressions import contains_ignoring_spaces, finite, ratio
from loomlake.plans.specs import DASHBOARDS, DATASETS, REFRESHES, REPORTS, TILES, Measure

UNKNOWN = "Unknown"


def measure_column(m: Measure, df: DataFrame) -> Column:
    """The aggregate of a measure.  Sums and averages leave out null, NaN and infinite values; a distinct count counts null as one more value."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    val = lambda c: finite(F.col(c)) if isinstance(kinds[c], DoubleType | FloatType) else F.col(c)
    if m.aggregate == "count":
        return F.count("*")
    if m.aggregate == "avg":
        return F.avg(val(m.columns[0]))
    if m.aggregate == "sum":
        return F.sum(val(m.columns[0]))
    if m.aggregate == "distinct":
        c = F.col(m.columns[0])
        return F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))
    if m.aggregate == "count_where":
        return F.count_if(F.col(m.columns[0]) == m.value)
    if m.aggregate == "ratio":
        a, b = m.columns
        return ratio(F.sum(val(a)), F.sum(val(b)))
    raise ValueError(f"unknown aggregate {m.aggregate}")


def measure_name(m: Measure) -> str:
    return m.name.lower().replace(" ", "_")


def measured(df: DataFrame, measures: tuple[Measure, ...], by: list[str], how: str = "group") -> DataFrame:
    """All measures over the dimensions; ``how`` is group, rollup or cube, the last two with the grouping id as ``level``."""
    aggs = [measure_column(m, df).alias(measure_name(m)) for m in measures]
    if how == "group":
        return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    grouped = df.rollup(*by) if how == "rollup" else df.cube(*by)
    return grouped.agg(F.grouping_id().cast("long").alias("level"), *aggs)


def artifact_frames(spark: SparkSession) -> dict[str, DataFrame]:
    """The artifacts as small frames: datasets, measures, reports, dashboards, tiles, refreshes."""
    measures = [(d.id, d.name, d.table, i, m.name, m.text, ",".join(m.columns)) for d in DATASETS for i, m in enumerate(d.measures)]
    return {
        "datasets": spark.createDataFrame([(d.id, d.name, d.table, d.silver) for d in DATASETS], "dataset_id string, dataset string, bi_table string, silver string"),
        "measures": spark.createDataFrame(measures, "dataset_id string, dataset string, bi_table string, measure_ordinal int, measure string, expression string, depends_on string"),
        "reports": spark.createDataFrame(list(REPORTS), "report_id string, report string, report_dataset_id string"),
        "dashboards": spark.createDataFrame(list(DASHBOARDS), "dashboard_id string, dashboard string"),
        "tiles": spark.createDataFrame(list(TILES), "tile_id string, tile string, dashboard_id string, report_id string, dataset_id string"),
        "refreshes": spark.createDataFrame(list(REFRESHES), "dataset_id string, kind string, started string, ended string, status string, request_id string"),
    }


def tile_measures(tiles: DataFrame, measures: DataFrame) -> DataFrame:
    """(tile_id, tile, measure): the first measure of the tile's dataset whose name the title contains, spaces and case aside; else null."""
    m = measures.select(F.col("dataset_id").alias("_d"), "measure", "measure_ordinal")
    j = tiles.join(F.broadcast(m), (tiles["dataset_id"] == m["_d"]) & contains_ignoring_spaces(F.col("tile"), F.col("measure")), "left")
    first = F.row_number().over(Window.partitionBy("tile_id").orderBy("measure_ordinal"))
    return j.withColumn("_r", first).where("_r = 1").select("tile_id", "tile", "measure")


def hierarchy(a: dict[str, DataFrame]) -> DataFrame:
    """Per dashboard: its tiles in order, and the reports, datasets and tables behind them, sorted and distinct.

    A tile whose report or dataset is not there counts under Unknown; a dashboard
    without tiles has empty lists.
    """
    t = a["tiles"].join(F.broadcast(a["reports"]), "report_id", "left").join(F.broadcast(a["datasets"]), "dataset_id", "left")
    j = a["dashboards"].join(t, "dashboard_id", "left")
    there = F.col("tile_id").isNotNull()
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(there, F.coalesce(F.col(c), F.lit(UNKNOWN))))), ", ")
    tiles = F.transform(F.array_sort(F.collect_list(F.when(there, F.struct("tile_id", "tile")))), lambda x: x["tile"])
    return j.groupBy("dashboard_id", "dashboard").agg(
        F.count("tile_id").alias("n_tiles"), F.array_join(tiles, ", ").alias("tiles"), joined("report").alias("reports"), joined("dataset").alias("datasets"), joined("bi_table").alias("bi_tables")
    )


def tile_graph(a: dict[str, DataFrame]) -> DataFrame:
    """(dashboard, tile, report, dataset, bi_table, measure), one row per tile, with Unknown for missing ends."""
    m = tile_measures(a["tiles"], a["measures"]).select("tile_id", "measure")
    j = a["tiles"].join(F.broadcast(a["dashboards"]), "dashboard_id", "left").join(F.broadcast(a["reports"]), "report_id", "left").join(F.broadcast(a["datasets"]), "dataset_id", "left").join(F.broadcast(m), "tile_id", "left")
    return j.select("tile_id", *[F.coalesce(F.col(c), F.lit(UNKNOWN)).alias(c) for c in ("dashboard", "tile", "report", "dataset", "bi_table")], "measure")


def rename_map(dataset_id: str, names: dict[str, str]) -> dict[str, str]:
    """Gold column to business name of one dataset; of two names for one column the last wins."""
    d = next((x for x in DATASETS if x.id == dataset_id), None)
    if d is None:
        raise LookupError(f"no dataset {dataset_id}")
    return {names[c.column]: c.name for c in d.columns}


def newest(history: DataFrame, key: str, order: list[Column], top: int = 10) -> DataFrame:
    """The newest ``top`` rows per key; a negative number is refused."""
    if top < 0:
        raise ValueError("top must not be negative")
    return history.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= top).drop("_r")


def found(df: DataFrame, column: str, value: str) -> DataFrame:
    """The rows with this id; LookupError where there is none."""
    rows = df.where(F.col(column) == value)
    if rows.limit(1).count() == 0:
        raise LookupError(f"no {column} {value}")
    return rows
