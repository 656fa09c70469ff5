"""The whole catalog as tables of one database: bronze, silver, gold, quality, lineage, dictionary, ontology, artifacts, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.operators import catalog, lineage, medallion, quality, semantic
from loomlake.plans import reference_queries as Q
from loomlake.plans.specs import RAW_KEYS, SILVER


def run(spark: SparkSession, folder: str, database: str) -> dict[str, str]:
    """Build everything from the raw tables in ``folder``; (step, name of what was written or the error).

    A table that cannot be profiled is reported and does not stop the others; any
    other failure stops the run.  A second run replaces all tables.
    """
    spark.sql(f"create database if not exists `{database}`")
    done: dict[str, str] = {}

    def write(name: str, df: DataFrame) -> DataFrame:
        medallion.replace_table(df, f"`{database}`.`{name}`")
        done[name] = f"{database}.{name}"
        return spark.table(f"`{database}`.`{name}`")

    tables = {f"bronze_{t}": write(f"bronze_{t}", medallion.cleaned(Q.raw(spark, folder, t))) for t in RAW_KEYS}
    for spec in SILVER:
        names = [x for x in medallion.name_map(SILVER) if x[4] == spec.name]
        built = medallion.silver(spec, {t: tables[f"bronze_{t}"] for t in RAW_KEYS})
        at, view = names[0][0], names[0][2]
        tables[at] = write(at, built.withColumnsRenamed({lc: sc for _, sc, _, _, _, lc in names}))
        columns = ", ".join(f"{sc} as {gc}" for _, sc, _, gc, _, _ in names)
        spark.sql(f"create or replace view `{database}`.`{view}` as select {columns} from `{database}`.`{at}`")
        done[view] = f"{database}.{view}"
        tables[view] = spark.table(f"`{database}`.`{view}`")
    suites, errors = quality.profiled_tables(tables)
    if suites is not None:
        write("data_quality", suites)
    done |= {f"data_quality of {t}": e for t, e in errors.items()}
    edges = write("_column_lineage", lineage.bronze_to_silver(spark))  # read back: what was written is what is told
    rows = write("lineage", lineage.joined(edges, lineage.silver_to_gold(spark)))
    write("data_dictionary", Q._dictionary(spark, folder))
    columns, keys, links = Q._links(spark, folder)
    write("ontology_entities", catalog.entities(columns, keys, rows))
    write("ontology_relationships", catalog.relationship_keys(Q._bronze_links(links), rows))
    for name, df in semantic.artifact_frames(spark).items():
        write(f"pbi_{name}", df)
    write("pbi_lineage", lineage.end_to_end(lineage.bi_columns(spark), rows))
    write("catalog_documents", Q._catalog_docs(spark, folder))
    return done
