"""Catalog documents: texts and ids from templates, and their upsert by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlake.functions.expressions import id_text


def _doc(df: DataFrame, collection: str, kind: str, key: F.Column, text: F.Column, **meta: F.Column) -> DataFrame:
    pairs = [x for k, v in {"type": F.lit(kind), **meta}.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(F.lit(collection).alias("collection"), key.alias("id"), text.alias("document"), F.create_map(*pairs).alias("metadata"))


def parts(*labelled: tuple[str, F.Column]) -> F.Column:
    """``Label: value | Label: value``; a null value is written as nothing."""
    out = []
    for i, (label, c) in enumerate(labelled):
        out += [F.lit(f"{' | ' if i else ''}{label}: "), F.coalesce(c.cast("string"), F.lit(""))]
    return F.concat(*out)


def dictionary_documents(d: DataFrame) -> DataFrame:
    """One per row of the data dictionary; statistics go into the metadata only."""
    c = F.col
    text = parts(("Description", c("description")), ("Original Name", c("original_name")), ("Column", c("column_name")), ("Table", c("table_name")), ("Layer", c("layer")), ("Type", c("data_type")))
    return _doc(d, "data_dictionary", "data_dictionary", id_text(F.lit("dict"), c("layer"), c("table_name"), c("column_name")), text, layer=c("layer"), table=c("table_name"), column=c("column_name"), original_name=c("original_name"), null_pct=c("null_pct"), unique_count=c("unique_count"), sample_values=F.array_join(c("sample_values"), ", "))


def layer_rank(layer: F.Column) -> F.Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("bronze", 0, "silver", 1, "gold", 2)]), layer), F.lit(3))


def concept_documents(d: DataFrame) -> DataFrame:
    """One per original name: where it appears, layer by layer, with the description of its first appearance."""
    d = d.withColumn("_k", layer_rank(F.col("layer"))).withColumn("_path", F.concat_ws(".", "layer", "table_name", "column_name"))
    g = d.groupBy("original_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_path"))), lambda x: x["_path"]), " -> ").alias("path"),
        F.count_distinct("layer").alias("layers"),
        F.min(F.struct("_k", "_path", "description")).alias("f"),
    )
    text = parts(("Concept", F.col("original_name")), ("Description", F.col("f.description")), ("Appears across layers", F.col("path")))
    return _doc(g, "data_dictionary", "concept", id_text(F.lit("concept"), F.col("original_name")), text, original_name=F.col("original_name"), layer_count=F.col("layers"))


def entity_documents(e: DataFrame) -> DataFrame:
    c = F.col
    text = parts(("Entity", c("entity")), ("Description", c("description")), ("Source", c("source_file")), ("Primary Key", c("primary_key")), ("Attributes", c("attributes")), ("Silver Table", c("silver_table")), ("Gold View", c("gold_view")))
    return _doc(e, "ontology", "entity", id_text(F.lit("entity"), c("entity")), text, entity=c("entity"))


def relationship_documents(r: DataFrame) -> DataFrame:
    c = F.col
    name = F.concat_ws(" to ", "parent", "child")
    na = lambda x: F.coalesce(c(x), F.lit("N/A"))
    text = F.concat(
        parts(("Relationship", name), ("Type", c("relationship_type"))), F.lit(" | From: "), c("parent"), F.lit(" -> To: "), c("child"), F.lit(" | Bronze Join: "),
        F.concat_ws(".", "parent", "column_name"), F.lit(" = "), F.concat_ws(".", "child", "column_name"), F.lit(" | Silver Join: "), na("from_silver"), F.lit(" = "), na("to_silver"), F.lit(" | Gold Join: "), na("from_gold"), F.lit(" = "), na("to_gold"),
    )
    return _doc(r, "ontology", "relationship", id_text(F.lit("rel"), name, c("column_name")), text, relationship=name)


def lineage_documents(l: DataFrame) -> DataFrame:
    c = F.col
    k = F.row_number().over(Window.partitionBy("silver_table").orderBy("ordinal")) - 1
    hop = lambda label, a, b: F.concat(F.lit(f"{label}: "), c(a), F.lit("."), c(b))
    text = F.concat(
        F.lit("Column Lineage: "), c("source_column"), F.lit(" | "), F.concat_ws(" -> ", hop("Source", "source_file", "source_column"), hop("Bronze", "bronze_table", "bronze_column"), hop("Silver", "silver_table", "silver_column"), hop("Gold", "gold_view", "gold_column")),
        F.lit(" | "), parts(("Transformation", c("transformation_type")), ("Expression", c("expression"))),
    )
    return _doc(l.withColumn("_k", k), "lineage", "lineage", id_text(F.lit("lineage"), c("silver_table"), c("_k").cast("string"), c("source_column")), text, source_column=c("source_column"), silver_column=c("silver_column"), gold_column=c("gold_column"))


def chain_documents(e: DataFrame) -> DataFrame:
    c = F.col
    text = parts(("End-to-End Lineage", c("bi_column")), ("Chain", c("chain")), ("Transformation", c("transformation_type")))
    return _doc(e, "pbi_lineage", "pbi_end_to_end", id_text(F.lit("pbi_e2e"), c("bi_table"), c("bi_column")), text, pbi_column=c("bi_column"), pbi_table=c("bi_table"), gold_column=c("gold_column"), bronze_column=c("bronze_column"), source_column=c("source_column"))


def column_lineage_documents(b: DataFrame) -> DataFrame:
    """Each semantic column with the gold column it shows."""
    c = F.col
    text = parts(("PBI Column Lineage", c("bi_column")), ("PBI", F.concat_ws(".", "bi_table", "bi_column")), ("Dataset", c("dataset")), ("Gold", F.concat_ws(".", "gold_view", "gold_column")), ("DataType", c("bi_type")))
    return _doc(b, "pbi_lineage", "pbi_column_lineage", id_text(F.lit("pbi_lineage"), c("bi_table"), c("bi_column")), text, pbi_column=c("bi_column"), pbi_table=c("bi_table"), gold_view=c("gold_view"), gold_column=c("gold_column"))


def column_documents(b: DataFrame) -> DataFrame:
    c = F.col
    text = parts(("PBI Column", c("bi_column")), ("Table", c("bi_table")), ("Dataset", c("dataset")), ("Type", c("bi_type")), ("Gold", F.concat_ws(".", "gold_view", "gold_column")))
    return _doc(b, "pbi_catalog", "pbi_column", id_text(F.lit("pbi_col"), c("bi_table"), c("bi_column")), text, pbi_column=c("bi_column"), pbi_table=c("bi_table"), gold_view=c("gold_view"), gold_column=c("gold_column"))


def measure_documents(m: DataFrame) -> DataFrame:
    c = F.col
    text = parts(("PBI Measure", c("measure")), ("Table", c("bi_table")), ("Dataset", c("dataset")), ("Expression", c("expression")), ("Depends on columns", c("depends_on")))
    return _doc(m, "pbi_catalog", "pbi_measure", id_text(F.lit("pbi_measure"), c("bi_table"), c("measure")), text, measure_name=c("measure"), pbi_table=c("bi_table"))


def report_documents(t: DataFrame) -> DataFrame:
    """One per report that a tile shows; its first tile counts."""
    first = F.row_number().over(Window.partitionBy("report").orderBy("tile_id"))
    one = t.withColumn("_r", first).where("_r = 1")
    return _doc(one, "pbi_catalog", "pbi_report", id_text(F.lit("pbi_report"), F.col("report")), parts(("PBI Report", F.col("report")), ("Dataset", F.col("dataset"))), report_name=F.col("report"))


def dashboard_documents(h: DataFrame) -> DataFrame:
    c = F.col
    listing = _doc(h, "pbi_catalog", "pbi_dashboard", id_text(F.lit("pbi_dashboard"), c("dashboard")), parts(("PBI Dashboard", c("dashboard")), ("Tiles", c("tiles")), ("Reports", c("reports"))), dashboard_name=c("dashboard"), tile_count=c("n_tiles"))
    text = F.concat(F.lit("PBI Artifact Hierarchy: Dashboard '"), c("dashboard"), F.lit("' -> contains Tiles -> linked to Reports: "), c("reports"), F.lit(" -> Reports use Datasets: "), c("datasets"))
    return listing.unionByName(_doc(h, "pbi_catalog", "pbi_artifact_relationship", id_text(F.lit("pbi_rel"), c("dashboard")), text, dashboard_name=c("dashboard")))


def summary_document(dictionary: DataFrame, entities: DataFrame, relationships: DataFrame, lineage: DataFrame, hierarchy: DataFrame, measures: DataFrame, columns: DataFrame, chains: DataFrame) -> DataFrame:
    """One document on the whole catalog: how many of what there is, and its names, counted from the frames themselves."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    n = lambda df, *aggs: df.agg(F.count("*").cast("string").alias("n"), *aggs)
    layers = dictionary.groupBy("layer").agg(F.count("*").alias("n"), names("table_name").alias("t"), F.count_distinct("table_name").alias("k")).withColumn("_k", layer_rank(F.col("layer")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.concat(F.initcap("layer"), F.lit(" ("), F.col("k").cast("string"), F.lit(" tables: "), F.col("t"), F.lit(")")).alias("x")))), lambda x: x["x"]), ", ")
    facts = [
        layers.agg(F.concat(F.lit("Data Dictionary: "), F.sum("k").cast("string"), F.lit(" tables, "), F.sum("n").cast("string"), F.lit(" columns: "), listed).alias("x")),
        n(entities, names("entity").alias("t")).select(F.concat(F.lit("Ontology: "), "n", F.lit(" entities ("), "t", F.lit(")")).alias("x")),
        n(relationships).select(F.concat(F.lit("Relationships: "), "n").alias("x")),
        n(lineage).select(F.concat(F.lit("Lineage: "), "n", F.lit(" columns from source to gold")).alias("x")),
        hierarchy.agg(F.concat(F.lit("Power BI: "), F.count("*").cast("string"), F.lit(" dashboards ("), names("dashboard"), F.lit(") with "), F.coalesce(F.sum("n_tiles"), F.lit(0)).cast("string"), F.lit(" tiles")).alias("x")),
        n(measures, names("measure").alias("t")).select(F.concat(F.lit("Measures: "), "n", F.lit(" ("), "t", F.lit(")")).alias("x")),
        n(columns).select(F.concat(F.lit("Column mappings: "), "n").alias("x")),
        n(chains).select(F.concat(F.lit("End-to-End Lineage: "), "n", F.lit(" chains")).alias("x")),
    ]
    every = None
    for k, f in enumerate(facts):
        f = f.select(F.lit(k).alias("k"), "x")
        every = f if every is None else every.unionByName(f)
    text = every.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda x: x["x"]), " | ").alias("t"))
    return _doc(text, "data_dictionary", "catalog_summary", F.lit("catalog_summary"), F.concat(F.lit("CATALOG SUMMARY | "), F.col("t")))


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key is not in it."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
