"""Column lineage: from specs, from view texts, and from analysed plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.operators.medallion import name_map
from loomlake.plans.specs import DATASETS, SILVER, TableSpec

MISSING = "N/A"


def bronze_to_silver(spark: SparkSession, specs: tuple[TableSpec, ...] = SILVER) -> DataFrame:
    """One row per source column of each silver column, in the order of the specs."""
    physical = {(lt, lc): (st, sc) for st, sc, _, _, lt, lc in name_map(specs)}
    rows, k = [], 0
    for s in specs:
        for c in s.columns:
            for t, source in c.sources:
                st, sc = physical[(s.name, c.name)]
                rows.append((k, f"bronze_{t}", source, st, sc, c.kind, c.expression))
                k += 1
    return spark.createDataFrame(rows, "ordinal int, source_table string, source_column string, target_table string, target_column string, transformation_type string, expression string")


def silver_to_gold(spark: SparkSession, specs: tuple[TableSpec, ...] = SILVER) -> DataFrame:
    return spark.createDataFrame([(st, sc, gv, gc) for st, sc, gv, gc, _, _ in name_map(specs)], "silver_table string, silver_column string, gold_view string, gold_column string")


def joined(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Source file to gold column: edges with their gold columns, N/A where a silver column has none."""
    m = mapping.withColumnsRenamed({"silver_table": "target_table", "silver_column": "target_column"})
    stem = F.regexp_replace("source_table", "^(.*?)bronze_", "$1")
    return edges.join(F.broadcast(m), ["target_table", "target_column"], "left").select(
        "ordinal",
        F.concat(stem, F.lit(".csv")).alias("source_file"),
        F.col("source_column"),
        F.col("source_table").alias("bronze_table"),
        F.col("source_column").alias("bronze_column"),
        F.col("target_table").alias("silver_table"),
        F.col("target_column").alias("silver_column"),
        F.coalesce("gold_view", F.lit(MISSING)).alias("gold_view"),
        F.coalesce("gold_column", F.lit(MISSING)).alias("gold_column"),
        "transformation_type",
        "expression",
    )


def by_target(edges: DataFrame) -> DataFrame:
    """Edges per target table: how many, and their source columns in order."""
    one = F.struct("ordinal", F.concat("source_table", F.lit("."), "source_column").alias("s"))
    return edges.groupBy("target_table").agg(
        F.count("*").alias("n_edges"), F.count_distinct("target_column").alias("n_columns"), F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]), ",").alias("source_columns")
    )


def bi_columns(spark: SparkSession) -> DataFrame:
    """The semantic model's columns with the gold columns they show."""
    gold = {(lt, lc): (gv, gc) for _, _, gv, gc, lt, lc in name_map(SILVER)}
    rows, k = [], 0
    for d in DATASETS:
        for c in d.columns:
            rows.append((k, d.name, d.table, c.name, c.kind, *gold[(d.silver, c.column)]))
            k += 1
    return spark.createDataFrame(rows, "bi_ordinal int, dataset string, bi_table string, bi_column string, bi_type string, gold_view string, gold_column string")


def end_to_end(columns: DataFrame, lineage: DataFrame) -> DataFrame:
    """Each semantic column back to its source file; of several sources the last wins, ``?`` marks an unknown hop in the chain."""
    last = Window.partitionBy("gold_view", "gold_column").orderBy(F.desc("ordinal"))
    known = lineage.where(~((F.col("gold_view") == MISSING) & (F.col("gold_column") == MISSING))).withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "ordinal")
    j = columns.join(F.broadcast(known), ["gold_view", "gold_column"], "left")
    hop = lambda a, b: F.concat(F.coalesce(F.col(a), F.lit("?")), F.lit("."), F.coalesce(F.col(b), F.lit("?")))
    chain = F.concat_ws(" -> ", hop("bi_table", "bi_column"), hop("gold_view", "gold_column"), hop("silver_table", "silver_column"), hop("bronze_table", "bronze_column"), hop("source_file", "source_column"))
    kept = [F.coalesce(F.col(c), F.lit(MISSING)).alias(c) for c in ("silver_table", "silver_column", "bronze_table", "bronze_column", "source_file", "source_column", "transformation_type")]
    return j.select("bi_ordinal", "bi_table", "bi_column", "gold_view", "gold_column", *kept, chain.alias("chain"))


def parsed_views(definitions: DataFrame) -> DataFrame:
    """(view_name, source_table, source_column, view_column) from rename-only view texts (view_name, ddl); null texts are skipped."""
    ddl = F.col("ddl")
    body = F.regexp_extract(ddl, r"(?is)\bselect\s+(.*?)\s+from\s", 1)
    item = F.explode(F.split(body, r"\s*,\s*"))
    return (
        definitions.where(ddl.isNotNull())
        .select("view_name", F.regexp_extract(ddl, r"(?is)\sfrom\s+([A-Za-z0-9_]+)", 1).alias("source_table"), item.alias("item"))
        .where("source_table <> ''")
        .select("view_name", "source_table", F.regexp_extract("item", r"(?i)^(\S+)\s+as\s+(\S+)$", 1).alias("source_column"), F.regexp_extract("item", r"(?i)^(\S+)\s+as\s+(\S+)$", 2).alias("view_column"))
        .where("source_column <> ''")
    )


def plan_lineage(df: DataFrame) -> dict[str, set[str]]:
    """Source columns of each output column, read off the analysed plan (classic sessions).

    Aliases are followed through projections and identity casts to the
    attributes of the scans; names are those the scans give.
    """
    plan = df._jdf.queryExecution().analyzed()
    made: dict[int, list[int]] = {}
    names: dict[int, str] = {}

    def scala(seq):
        it = seq.iterator()
        while it.hasNext():
            yield it.next()

    def walk(node) -> None:
        if node.nodeName() in ("Project", "Aggregate"):
            exprs = node.projectList() if node.nodeName() == "Project" else node.aggregateExpressions()
            for e in scala(exprs):
                if e.getClass().getSimpleName() == "Alias":
                    made[e.exprId().id()] = [a.exprId().id() for a in scala(e.references().toSeq())]
        for a in scala(node.output()):
            names.setdefault(a.exprId().id(), a.name())
        for child in scala(node.children()):
            walk(child)

    walk(plan)

    def roots(i: int) -> set[int]:
        return {i} if i not in made else {r for j in made[i] for r in roots(j)}

    return {a.name(): {names.get(r, "?") for r in roots(a.exprId().id())} for a in scala(plan.output())}
