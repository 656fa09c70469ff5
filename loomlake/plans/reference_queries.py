"""One query per operator family of the catalog engine; all run over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.functions import expressions as X
from loomlake.operators import ask, catalog, documents, evaluation, lineage, medallion, profile, quality, retrieval, semantic
from loomlake.plans.specs import CLINICAL, DATASETS, FINANCIAL, RAW_KEYS, SILVER
from loomlake.session import checkpoint_dir, durable
from loomlake.sources import stores
from loomlake.sources.tables import table
from loomlake.streaming import events as streams

COUNTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "patients", "visits", "billing", "deleted_records", "canonical_values")
# Fixed inputs of the scalar queries.
QUESTIONS = (
    (1, "What is patient_id in the Clinical table?"), (2, "Trace bill_amount end-to-end, please."), (3, "List all dashboards and reports"), (4, "why is Out Of Pocket so high"), (5, "How many measures? copay, revenue"),
    (6, "the a an is"), (7, ""), (8, "compare FullName with `first_name` 42 times"), (9, "Give me an overview of the catalog"), (10, "department"),
)
ANSWERS = ((1, "See [1] and [2].", 3), (2, "As in [4][4] and [0].", 3), (3, "No source.", 3), (4, "[2] [10] [2]", 9), (5, "", 0))
SCORES = ((1, [0.9, 0.8, 0.7, 0.1]), (2, [0.5, 0.3]), (3, [0.1, 0.2, 0.3, 0.9]), (4, []), (5, [0.61]))
VIEW_TEXTS = (
    ("gold_vw_a", "CREATE VIEW gold_vw_a AS SELECT col_1 AS dim_1, col_2 AS dim_2 FROM silver_tbl_x"),
    ("gold_vw_b", "create view gold_vw_b as\nselect k as key_1\nfrom silver_tbl_y"),
    ("gold_vw_c", None),
)


def raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return medallion.bronze(spark, folder, name, RAW_KEYS[name])


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Whole numbers that may be null as doubles, the one form in which clients agree on them."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


# ---------------------------------------------------------------- medallion


def bronze_scan_rowcounts(spark, folder):
    out = None
    for t in COUNTED:
        part = table(spark, folder, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


def bronze_clean_patients(spark, folder):
    return medallion.cleaned(raw(spark, folder, "patients").drop("load_id", "loaded_at"))


def bronze_csv_roundtrip(spark, folder):
    at = scratch(spark)
    table(spark, folder, "supplier").write.option("header", True).csv(f"{at}/supplier.csv")
    return stores.csv_folder(spark, at, {"supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"})["bronze_supplier"]


def _bronze(spark, folder, spec):
    need = medallion.needed_columns(spec)
    return {t: medallion.bronze(spark, folder, t, RAW_KEYS[t], cols) for t, cols in need.items()}


def _silver(spark, folder, spec):
    return medallion.silver(spec, _bronze(spark, folder, spec), {t: table(spark, folder, t) for t in RAW_KEYS})


def silver_clinical(spark, folder):
    return plain(_silver(spark, folder, CLINICAL), "age")


def silver_financial(spark, folder):
    return _silver(spark, folder, FINANCIAL)


GOLD_NAMES = {s.name: {lc: gc for _, _, _, gc, lt, lc in medallion.name_map(SILVER) if lt == s.name} for s in SILVER}


def gold_rename_view(spark, folder):
    view = medallion.physical("gold", CLINICAL.name)
    medallion.gold(silver_clinical(spark, folder), GOLD_NAMES[CLINICAL.name], view)
    return spark.table(view)


def push_rename_passthrough(spark, folder):
    """Business names for the gold columns; one column without a name keeps its own."""
    names = semantic.rename_map("financial", GOLD_NAMES[FINANCIAL.name])
    names.pop(GOLD_NAMES[FINANCIAL.name]["billing_date"])
    return medallion.renamed(medallion.gold(silver_financial(spark, folder), GOLD_NAMES[FINANCIAL.name]), names)


def strip_internal_columns(spark, folder):
    return lineage.bi_columns(spark).drop("gold_view", "gold_column", "bi_ordinal")


# ---------------------------------------------------------------- measures


def _rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def bi_clinical_measures(spark, folder):
    return _rounded(semantic.measured(silver_clinical(spark, folder), DATASETS[0].measures, ["gender"]))


def bi_financial_measures(spark, folder):
    return _rounded(semantic.measured(silver_financial(spark, folder), DATASETS[1].measures, ["payment_status"]), 2)


def bi_financial_totals(spark, folder):
    return _rounded(semantic.measured(silver_financial(spark, folder), DATASETS[1].measures, []), 2)


def bi_measures_rollup(spark, folder):
    return _rounded(semantic.measured(silver_clinical(spark, folder), DATASETS[0].measures, ["department", "status"], "rollup"))


def bi_measures_cube(spark, folder):
    return _rounded(semantic.measured(silver_clinical(spark, folder), DATASETS[0].measures, ["gender", "blood_type"], "cube"))


# ---------------------------------------------------------------- profile, expectations


def _visits(spark, folder):
    return raw(spark, folder, "visits").drop("loaded_at")


def _profiled(df):
    return plain(profile.profile(df), "min_length", "max_length")


def profile_visits(spark, folder):
    return _profiled(_visits(spark, folder))


def profile_orders(spark, folder):
    return _profiled(table(spark, folder, "orders").drop("o_orderdate"))


def profile_customer(spark, folder):
    return _profiled(table(spark, folder, "customer"))


def profile_samples(spark, folder):
    s = profile.samples(raw(spark, folder, "patients").drop("loaded_at", "load_id"), ["patient_id"])
    return s.select("column_name", F.array_join("sample_values", "|").alias("sample_values"))


def dq_suite_visits(spark, folder):
    return quality.expectations(_visits(spark, folder)).select("expectation_type", "column_name", "success")


def dq_summary(spark, folder):
    return quality.summary(quality.expectations(_visits(spark, folder)))


def dq_checked_load(spark, folder):
    """A suite with limits, held against the visits."""
    suite = spark.createDataFrame(
        [
            ("row_count", None, 1.0, 1e12, None), ("not_null", "visit_id", None, None, None), ("not_null", "department", None, None, None), ("unique", "visit_id", None, None, None),
            ("unique", "patient_id", None, None, None), ("between", "bill_amount", 0.0, 1e9, None), ("between", "load_id", 1.0, 18.0, None),
            ("in_set", "status", None, None, ["Completed", "In Progress", "Cancelled", "No Show"]), ("in_set", "clinic_id", None, None, [f"C{i:05d}" for i in range(1, 2000)]),
        ],
        "expectation_type string, column_name string, lo double, hi double, allowed array<string>",
    )
    return quality.checked(_visits(spark, folder), suite)


# ---------------------------------------------------------------- catalog


def _raw_tables(spark, folder):
    return {t: table(spark, folder, t) for t in ("patients", "visits", "billing", "orders", "customer", "lineitem")}


def catalog_columns(spark, folder):
    return catalog.inventory(spark, _raw_tables(spark, folder)).select("table_name", "column_name", F.col("ordinal").cast("long").alias("ordinal"), "data_type")


def catalog_tables_like(spark, folder):
    return catalog.like_tables(catalog.inventory(spark, _raw_tables(spark, folder)), "%I_ITS")


def catalog_schemas(spark, folder):
    return catalog.schemas(catalog.inventory(spark, _raw_tables(spark, folder)))


def catalog_view_registry(spark, folder):
    """Views found in the session's catalog by a pattern, after registering three."""
    for t in ("patients", "visits", "billing"):
        table(spark, folder, t).createOrReplaceTempView(f"loom_{t}")
    found = stores.tables_like(spark, "LOOM_%")
    return spark.createDataFrame([(t, len(stores.columns_of(spark, t))) for t in found if t in ("loom_patients", "loom_visits", "loom_billing")], "view_name string, n_columns long")


def _all_profiles(spark, folder):
    out = None
    for t in ("patients", "visits", "billing"):
        df = raw(spark, folder, t).drop("loaded_at", "load_id")
        order = {c: i for i, c in enumerate(df.columns)}
        part = profile.profile(df).withColumn("table_name", F.lit(t)).withColumn("ordinal", F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("column_name")))
        out = part if out is None else out.unionByName(part)
    return durable(out)


def dictionary_descriptions(spark, folder):
    given = spark.createDataFrame([("patients", "dob", "Date of birth"), ("visits", "status", "")], "table_name string, column_name string, description string")
    return catalog.described(_all_profiles(spark, folder), given).select("table_name", "column_name", "description")


def dictionary_originals(spark, folder):
    d = catalog.originals(lineage.bronze_to_silver(spark), lineage.silver_to_gold(spark))
    return d.select("column_name", F.array_join("sources", ",").alias("sources"), "expression", "original_name")


def pk_detection(spark, folder):
    return catalog.primary_keys(_all_profiles(spark, folder))


def _links(spark, folder, p=None):
    p = _all_profiles(spark, folder) if p is None else p
    keys = catalog.primary_keys(p)
    return p.select("table_name", "column_name", "ordinal"), keys, catalog.relationships(p.select("table_name", "column_name"), keys)


def fk_detection(spark, folder):
    return _links(spark, folder)[2]


def _bronze_links(links):
    return links.withColumn("parent", F.concat(F.lit("bronze_"), "parent")).withColumn("child", F.concat(F.lit("bronze_"), "child"))


def _lineage(spark):
    return lineage.joined(lineage.bronze_to_silver(spark), lineage.silver_to_gold(spark))


def ontology_join_keys(spark, folder):
    return catalog.relationship_keys(_bronze_links(_links(spark, folder)[2]), _lineage(spark))


def ontology_entities(spark, folder):
    columns, keys, _ = _links(spark, folder)
    return catalog.entities(columns, keys, _lineage(spark))


# ---------------------------------------------------------------- lineage


def lineage_b2s(spark, folder):
    return lineage.bronze_to_silver(spark)


def lineage_joined(spark, folder):
    return _lineage(spark)


def lineage_by_target(spark, folder):
    return lineage.by_target(lineage.bronze_to_silver(spark))


def lineage_e2e(spark, folder):
    return lineage.end_to_end(lineage.bi_columns(spark), _lineage(spark))


def view_lineage_parse(spark, folder):
    return lineage.parsed_views(spark.createDataFrame(list(VIEW_TEXTS), "view_name string, ddl string"))


def plan_lineage(spark, folder):
    """Lineage read off the analysed plan of a silver projection: (output, source)."""
    src = table(spark, folder, "customer")
    df = src.select(F.concat("c_name", F.lit(" "), "c_mktsegment").alias("label"), (F.col("c_acctbal") * 2).alias("twice"), F.col("c_custkey").alias("key"))
    found = lineage.plan_lineage(df)
    return spark.createDataFrame([(o, s) for o, ss in found.items() for s in sorted(ss)], "output string, source string")


# ---------------------------------------------------------------- artifacts and documents


def tile_measure_match(spark, folder):
    a = semantic.artifact_frames(spark)
    return semantic.tile_measures(a["tiles"], a["measures"])


def artifact_hierarchy(spark, folder):
    return semantic.hierarchy(semantic.artifact_frames(spark))


def artifact_tiles(spark, folder):
    return semantic.tile_graph(semantic.artifact_frames(spark))


def refresh_history(spark, folder):
    """The last refresh of each dataset, and the one before."""
    return semantic.newest(semantic.artifact_frames(spark)["refreshes"], "dataset_id", [F.desc("started"), F.desc("request_id")], 2).select("dataset_id", "request_id", "status")


def refresh_history_top(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return semantic.newest(orders, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


def _layer_profiles(spark, folder, p=None):
    """Profiles of every column of the three layers; gold has those of silver under its own names."""
    out = (_all_profiles(spark, folder) if p is None else p).withColumn("layer", F.lit("bronze")).withColumn("table_name", F.concat(F.lit("bronze_"), "table_name"))
    for spec in SILVER:
        names = {lc: (st, sc) for st, sc, _, _, lt, lc in medallion.name_map(SILVER) if lt == spec.name}
        df = _silver(spark, folder, spec)
        order = F.create_map(*[F.lit(x) for i, c in enumerate(df.columns) for x in (names[c][1], i)])
        p = profile.profile(df.withColumnsRenamed({c: names[c][1] for c in df.columns})).withColumn("layer", F.lit("silver")).withColumn("table_name", F.lit(names[df.columns[0]][0]))
        out = out.unionByName(p.withColumn("ordinal", F.element_at(order, F.col("column_name"))))
    out = durable(out)
    return out.unionByName(catalog.carried(out, lineage.silver_to_gold(spark)))


def _dictionary(spark, folder, p=None):
    return durable(catalog.dictionary(_layer_profiles(spark, folder, p), catalog.originals(lineage.bronze_to_silver(spark), lineage.silver_to_gold(spark))))


def dictionary_full(spark, folder):
    d = _dictionary(spark, folder).withColumn("source_columns", F.array_join("source_columns", ",")).drop("ordinal", "sample_values")
    return d


def concept_documents(spark, folder):
    return documents.concept_documents(_dictionary(spark, folder)).select("id", "document")


def _catalog_docs(spark, folder):
    a = semantic.artifact_frames(spark)
    p = _all_profiles(spark, folder)
    rows, l, cols = _dictionary(spark, folder, p), _lineage(spark), lineage.bi_columns(spark)
    columns, keys, links = _links(spark, folder, p)
    entities, related, chains, shown = catalog.entities(columns, keys, l), catalog.relationship_keys(_bronze_links(links), l), lineage.end_to_end(cols, l), semantic.hierarchy(a)
    docs = documents.dictionary_documents(rows)
    for part in (
        documents.concept_documents(rows), documents.entity_documents(entities), documents.relationship_documents(related), documents.lineage_documents(l), documents.column_lineage_documents(cols),
        documents.chain_documents(chains), documents.column_documents(cols), documents.measure_documents(a["measures"]), documents.report_documents(semantic.tile_graph(a)), documents.dashboard_documents(shown),
        documents.summary_document(rows, entities, related, l, shown, a["measures"], cols, chains),
    ):
        docs = docs.unionByName(part)
    return docs


def catalog_documents(spark, folder):
    d = _catalog_docs(spark, folder)
    return d.select("collection", "id", "document", F.element_at("metadata", "type").alias("type"))


def catalog_summary_counts(spark, folder):
    d = _catalog_docs(spark, folder)
    return d.groupBy("collection", F.element_at("metadata", "type").alias("type")).agg(F.count("*").alias("n_documents"))


def upsert_documents(spark, folder):
    """German documents replaced by a newer text, and one that is new; all others stay."""
    old = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    new = table(spark, folder, "documents").where("lang = 'de'").select("doc_id", F.lit("replaced").alias("text"))
    return documents.upserted(old, new.unionByName(spark.createDataFrame([(-1, "added")], "doc_id long, text string")), ["doc_id"])


def dedup_prefix_100(spark, folder):
    """The first document of each 100-character beginning; null texts are no documents."""
    d = table(spark, folder, "documents").where("text is not null")
    return d.groupBy(F.substring("text", 1, 100).alias("prefix")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


# ---------------------------------------------------------------- retrieval


def _questions(spark):
    return spark.createDataFrame(list(QUESTIONS), "query_id long, question string")


def tokenize_questions(spark, folder):
    return retrieval.tokens(_questions(spark))


def tokenize_documents(spark, folder):
    """The same over every post."""
    return retrieval.tokens(table(spark, folder, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question")))


def keyword_lookup(spark, folder):
    """Tokens of asking posts (ids divisible by 100) against an inverted index of all posts' tags; the ten best per post."""
    docs = table(spark, folder, "documents")
    toks = durable(retrieval.tokens(docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))))
    index = docs.where("tags is not null").select(F.col("doc_id").alias("item_id"), F.posexplode(F.split("tags", r"\|")).alias("pos", "value"))
    hits = index.join(toks, index["value"] == toks["token"]).groupBy("query_id", "item_id").agg(F.round(F.sum(1.0 / (F.col("pos") + 1)), 4).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    return hits.withColumn("rank", rank.cast("long")).where("rank <= 10")


def catalog_keyword_hits(spark, folder):
    return retrieval.keyword_hits(retrieval.tokens(_questions(spark)), _catalog_docs(spark, folder)).select("query_id", "collection", "id", "score")


def _vectors(spark, folder):
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").cast("string").alias("collection"), "embedding")
    return e.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "embedding"), e


def knn_cosine_topk(spark, folder):
    return retrieval.knn(*_vectors(spark, folder))


def _ranked(spark, folder):
    near = knn_cosine_topk(spark, folder).select("query_id", F.concat_ws(":", "collection", F.col("item_id").cast("string")).alias("chunk"), "collection", "item_id", "score", "rank")
    return durable(near)


def _keyword_like(near):
    """Stand-in keyword hits: retrieved vectors whose id is a multiple of 7."""
    return near.where("item_id % 7 = 0").select("query_id", "chunk", F.lit(0.95).alias("score"))


def _fused(spark, folder):
    near = _ranked(spark, folder)
    return retrieval.fused(near.select("query_id", "chunk", "rank"), _keyword_like(near))


def rrf_fusion(spark, folder):
    return _fused(spark, folder)


def feedback_boost(spark, folder):
    near = _ranked(spark, folder)
    good = near.where("item_id % 11 = 0").select("query_id", "chunk")
    return retrieval.boosted(retrieval.fused(near.select("query_id", "chunk", "rank"), _keyword_like(near)), good)


def threshold_fallback(spark, folder):
    return retrieval.passed(_fused(spark, folder)).select("query_id", "chunk", "rrf_score")


def _with_meta(spark, folder):
    m = F.create_map(F.lit("type"), F.lit("vector"), F.lit("table"), (F.substring_index("chunk", ":", -1).cast("long") % 5).cast("string"))
    return _fused(spark, folder).withColumn("collection", F.substring_index("chunk", ":", 1)).withColumn("metadata", m)


def mmr_select(spark, folder):
    return retrieval.selected(_with_meta(spark, folder), coverage=False)


def collection_coverage(spark, folder):
    return retrieval.selected(_with_meta(spark, folder))


def missing_collections(spark, folder):
    """Labels that none of a query's passed results has."""
    f = retrieval.passed(_fused(spark, folder)).withColumn("collection", F.substring_index("chunk", ":", 1))
    labels = table(spark, folder, "embeddings").select(F.col("label").cast("string")).distinct().limit(retrieval.MOST_COLLECTIONS + 1).collect()
    return retrieval.missing_collections(f, [r[0] for r in labels if r[0] is not None])


def catalog_retrieval(spark, folder):
    return retrieval.retrieve(_questions(spark).where("question <> ''"), _catalog_docs(spark, folder))


def catalog_contexts(spark, folder):
    docs = durable(_catalog_docs(spark, folder))
    return retrieval.contexts(retrieval.retrieve(_questions(spark).where("question <> ''"), docs), docs)


def route_questions(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", X.route(F.col("text")).alias("route"))
    return d


def route_fixed_questions(spark, folder):
    return _questions(spark).select("query_id", X.route(F.col("question")).alias("route"))


def verify_citations(spark, folder):
    d = spark.createDataFrame(list(ANSWERS), "answer_id long, answer string, chunks int")
    bad = X.invalid_citations(F.col("answer"), F.col("chunks"))
    return d.select("answer_id", (F.size(bad) == 0).alias("valid"), F.array_join(bad.cast("array<string>"), ",").alias("invalid"))


def cited_numbers(spark, folder):
    """Bracketed numbers in all posts: how many different ones each has."""
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.size(X.cited_numbers(F.col("text"))).cast("long").alias("n_cited"))


def assess_quality(spark, folder):
    return spark.createDataFrame(list(SCORES), "query_id long, scores array<double>").select("query_id", X.quality_band(F.col("scores")).alias("quality"))


REPLIES = ((1, '```json\n{"a": "x", "b": "2"}\n```'), (2, 'Sure: {"a": "y"} done'), (3, "no object"), (4, None))


def fenced_json(spark, folder):
    """Descriptions parsed out of answers."""
    m = X.fenced_json(F.col("reply"))
    return spark.createDataFrame(list(REPLIES), "reply_id long, reply string").select("reply_id", F.element_at(m, "a").alias("a"), F.element_at(m, "b").alias("b"))


def mapping_keys(spark, folder):
    """Keys of the form source_to_target, cut at the first _to_."""
    d = lineage.bronze_to_silver(spark).select(F.concat_ws("_to_", "source_table", "target_table").alias("mapping")).distinct()
    parts = X.split_once(F.col("mapping"), "_to_")
    return d.select("mapping", parts[0].alias("source"), parts[1].alias("target"))


def strip_nested_fields(spark, folder):
    """A dataset's columns as an array of structs, without the internal field; the elements come out flat."""
    nested = lineage.bi_columns(spark).groupBy("dataset").agg(F.collect_list(F.struct("bi_column", "bi_type", "gold_column")).alias("columns"), F.first("gold_view").alias("gold_view"))
    return X.without_fields(nested, ("gold_view", "gold_column")).select("dataset", F.explode("columns").alias("c")).select("dataset", "c.*")


def ask_catalog(spark, folder):
    """Answers to the fixed questions, from the catalog alone, through the log."""
    answers = durable(ask.answered(_questions(spark).where("question <> ''"), durable(_catalog_docs(spark, folder))))
    at = scratch(spark)
    ask.logged(answers, at)
    log = stores.read_log(spark, at, "query_id long, log_id string, quality string, citations_valid boolean")
    return answers.select("query_id", "route", F.size("chunk_ids").alias("n_chunks")).join(log, "query_id")


def feedback_chunks(spark, folder):
    """Chunks that helped with a question like the one asked."""
    at = scratch(spark)
    ask.record_feedback(spark, at, "q1", "where does the bill amount come from", ["lineage:bill", "pbi_catalog:bill"], True)
    ask.record_feedback(spark, at, "q2", "which departments are there", ["data_dictionary:department"], False)
    ask.record_feedback(spark, at, "q3", "who treats the patients", ["data_dictionary:doctor"], True)
    said = durable(ask.approved(spark, at))
    asked = spark.createDataFrame([(1, "where does bill amount come from"), (2, "which departments are there")], "query_id long, question string")
    near = retrieval.knn(retrieval.hashed_vectors(asked, "query_id", "question"), retrieval.hashed_vectors(said, "item_id", "question").withColumn("collection", F.lit("feedback")), retrieval.FEEDBACK_TOP)
    return retrieval.helpful_chunks(near, said)


def collection_counts(spark, folder):
    """Documents by collection, written, then one collection written again."""
    at = scratch(spark)
    docs = durable(_catalog_docs(spark, folder).select("collection", "id", "document"))
    stores.replace_collections(docs, at)
    stores.replace_collections(docs.where("collection = 'ontology'"), at)
    return stores.collection_counts(spark, at)


# ---------------------------------------------------------------- evaluation


def _cases(spark, folder):
    """Posts as cases: the language is the domain; expected and found collections from tags and source."""
    d = table(spark, folder, "documents")
    expected = F.split(F.coalesce("tags", F.lit("")), r"\|")
    expected = F.filter(expected, lambda x: x != "")
    got = F.slice(expected, 1, 2)
    rec = evaluation.recall(expected, got)
    faith = evaluation.faithfulness(F.col("text"), F.col("score"), F.col("is_accepted"))
    rel = evaluation.parsed_score((F.col("score") / 10.0).cast("string"))
    return d.select("doc_id", F.col("lang").alias("domain"), (F.coalesce("n_chars", F.lit(0)) % 3 / 2.0).alias("context_precision"), rec.alias("context_recall"), faith.alias("faithfulness"), rel.alias("answer_relevancy"))


def eval_context_recall(spark, folder):
    return _cases(spark, folder).select("doc_id", F.round("context_recall", 6).alias("context_recall"))


def eval_context_precision(spark, folder):
    j = table(spark, folder, "documents").where("question_id is not null").select(F.col("question_id").alias("case_id"), (F.col("score") > 0).alias("relevant"))
    p = evaluation.precision(j)
    return p.select("case_id", F.round("context_precision", 6).alias("context_precision"))


def eval_averages(spark, folder):
    return evaluation.averages(_cases(spark, folder))


def eval_domain_breakdown(spark, folder):
    return evaluation.by_domain(_cases(spark, folder))


def eval_judged_answers(spark, folder):
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", evaluation.says_yes(F.col("text")).alias("yes"), evaluation.says_grounded(F.col("text")).alias("grounded"))
    return d


CASES = (
    (0, "What does bill_amount mean and where does it come from?", "bill amount of visits, bronze visits bill_amount", ["data_dictionary", "lineage"], "dictionary"),
    (1, "Trace OutOfPocket end-to-end", "bill_amount minus insurance_covered from visits and billing", ["pbi_lineage"], "lineage"),
    (2, "Which dashboards show revenue?", "Board Room shows Total Revenue", ["pbi_catalog"], "bi"), (3, "How are Patient and Visit related?", "patient_id joins patients to visits", ["ontology"], None),
    (4, "Give me an overview of the catalog", "tables columns entities relationships dashboards measures", [], "overview"),
)


def evaluation_run(spark, folder):
    """Fixed cases through retrieval, answer and the judge by words."""
    cases = spark.createDataFrame(list(CASES), "case_id long, " + evaluation.CASES)
    out = evaluation.evaluated(cases, durable(_catalog_docs(spark, folder)))
    return out.select("case_id", "domain", *evaluation.METRICS, "chunks_retrieved", F.array_join("collections_hit", ",").alias("collections_hit"), "citations_valid", "route")


def retrieval_sources(spark, folder):
    """How many of each question's chunks came by meaning and how many by words."""
    docs = durable(retrieval.keyed(_catalog_docs(spark, folder)))
    asked = _questions(spark).where("question <> ''")
    near, hits = (durable(d) for d in retrieval.candidates(asked, docs))
    return retrieval.sources(retrieval.retrieve(asked, docs.drop("item_id", "chunk")), near, hits)


# ---------------------------------------------------------------- logs, pushes, streams


def feedback_retention(spark, folder):
    e = table(spark, folder, "events").where("event_type is not null")
    return semantic.newest(e, "user_id", [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")


def feedback_last_100(spark, folder):
    """The last hundred events: the retention of a log."""
    return table(spark, folder, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id")


def jsonl_log_roundtrip(spark, folder):
    at = scratch(spark)
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type", F.round("value", 4).alias("value"))
    stores.append_log(e.where("event_id % 2 = 0"), at)
    stores.append_log(e.where("event_id % 2 = 1"), at)
    return stores.read_log(spark, at, "event_id long, user_id long, event_type string, value double")


def push_append_counts(spark, folder):
    """Two batches pushed, the second one twice: counts per dataset and table."""
    at = scratch(spark)
    known = spark.createDataFrame([(d.id, d.table) for d in DATASETS], "dataset_id string, table_name string")
    rows = lambda t, d, k: table(spark, folder, t).select(F.lit(d.id).alias("dataset_id"), F.lit(d.table).alias("table_name"), F.to_json(F.struct(k)).alias("row"))
    stores.push_rows(rows("nation", DATASETS[0], "n_name"), known, at, "a")
    for _ in range(2):
        stores.push_rows(rows("supplier", DATASETS[1], "s_name"), known, at, "b")
    return stores.push_counts(stores.pushed_rows(spark, at))


def _stream(spark, folder):
    schema = table(spark, folder, "events").schema
    return streams.folder_stream(spark, f"{folder}/events.parquet*", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _streamed(spark, stream, mode="complete"):
    at = scratch(spark)
    name = f"{at}/out"
    streams.run_available(stream, lambda df, i: df.write.mode("overwrite" if mode == "complete" else "append").parquet(name), f"{at}/state", mode)
    return spark.read.parquet(name)


def stream_events_tumbling(spark, folder):
    out = _streamed(spark, streams.windowed(_stream(spark, folder), "ts", "event_type", "value", "1 day"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n_events", "total")


def stream_events_sliding(spark, folder):
    """Two-day windows that begin every day."""
    out = _streamed(spark, streams.windowed(_stream(spark, folder), "ts", "event_type", "value", "2 days", "1 day"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n_events", "total")


def stream_events_sessions(spark, folder):
    """Sessions of each user, closed by six hours without an event."""
    out = _streamed(spark, streams.sessions(_stream(spark, folder), "ts", "user_id", "6 hours"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", stamp("session_start"), stamp("session_end"), "n_events")


def stream_bronze_append(spark, folder):
    at = scratch(spark)
    streams.to_folder(_stream(spark, folder).select("event_id", "user_id"), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out")


QUERIES = {
    f.__name__: f
    for f in (
        bronze_scan_rowcounts, bronze_clean_patients, bronze_csv_roundtrip, silver_clinical, silver_financial, gold_rename_view, push_rename_passthrough, strip_internal_columns,
        bi_clinical_measures, bi_financial_measures, bi_financial_totals, bi_measures_rollup, bi_measures_cube, profile_visits, profile_orders, profile_customer, profile_samples,
        dq_suite_visits, dq_summary, dq_checked_load, catalog_columns, catalog_tables_like, catalog_schemas, catalog_view_registry, dictionary_descriptions, dictionary_originals, pk_detection, fk_detection,
        ontology_join_keys, ontology_entities, lineage_b2s, lineage_joined, lineage_by_target, lineage_e2e, view_lineage_parse, plan_lineage, tile_measure_match, artifact_hierarchy, artifact_tiles,
        refresh_history, refresh_history_top, dictionary_full, concept_documents, catalog_documents, catalog_summary_counts, upsert_documents, dedup_prefix_100, tokenize_questions, tokenize_documents, keyword_lookup, catalog_keyword_hits,
        knn_cosine_topk, rrf_fusion, feedback_boost, threshold_fallback, mmr_select, collection_coverage, missing_collections, catalog_retrieval, catalog_contexts, route_questions, route_fixed_questions,
        verify_citations, cited_numbers, assess_quality, eval_context_recall, eval_context_precision, eval_averages, eval_domain_breakdown, eval_judged_answers, evaluation_run, retrieval_sources, feedback_retention, feedback_last_100,
        jsonl_log_roundtrip, push_append_counts, fenced_json, mapping_keys, strip_nested_fields, ask_catalog, feedback_chunks, collection_counts, stream_events_tumbling, stream_events_sliding, stream_events_sessions, stream_bronze_append,
    )
}
