"""SQL for the data dictionary and the catalog's documents, text for text."""

from __future__ import annotations

from loomlake.operators.medallion import name_map
from loomlake.operators.retrieval import PROBES, TYPE_WORDS
from loomlake.plans import reference_oracle as R
from loomlake.plans.reference_oracle import BI, CLINICAL_SQL, FINANCIAL_SQL, LINEAGE, profile_sql, values
from loomlake.plans.specs import DATASETS, REFRESHES, SILVER

_LOGICAL = [(lt, lc, k, st, sc, gv, gc) for s in SILVER for k, (st, sc, gv, gc, lt, lc) in enumerate(x for x in name_map(SILVER) if x[4] == s.name)]
_KINDS = {"age": "int64", "bill_amount": "float64", "insurance_covered": "float64", "copay_amount": "float64", "out_of_pocket": "float64"}
_SILVER_PROFILES = " union all ".join(
    f"select '{s.name}' as lt, * from ({profile_sql(f'({sql})', {c.name: _KINDS.get(c.name, 'object') for c in s.columns})})" for s, sql in zip(SILVER, (CLINICAL_SQL, FINANCIAL_SQL), strict=True)
)
_FACTS = "data_type, n_rows, null_pct, unique_count, min_value, max_value"
_TEXT = f"""concat_ws('. ', {R._TITLE.format(c='original_name')},
  case when data_type in ('int64', 'float64') and min_value is not null then 'Range: ' || cast(cast(round(min_value, 2) as decimal(18,2)) as varchar) || '-' || cast(cast(round(max_value, 2) as decimal(18,2)) as varchar) end,
  case when n_rows > 0 and unique_count = n_rows then 'Unique per row' when unique_count > 0 then unique_count || ' distinct values' end,
  case when null_pct > 0 then cast(cast(null_pct as decimal(18,2)) as varchar) || '% null' end)"""
DICTIONARY = f"""{R._KEYS}, {LINEAGE}, logical as (select * from {values(_LOGICAL, 'lt, column_name, ordinal, st, sc, gv, gc')}),
named as (select target_column as c, arg_min(source_column, ordinal) as original_name, string_agg(source_column, ',' order by ordinal) as source_columns, arg_min(expression, ordinal) as expression from edges group by 1),
silver as (select l.*, n.original_name, n.source_columns, n.expression, {_FACTS} from ({_SILVER_PROFILES}) p join logical l using (lt, column_name) join named n on n.c = l.sc),
facts as (
  select 0 as k, 'bronze' as layer, 'bronze_' || table_name as table_name, column_name, column_name as original_name, column_name as source_columns, column_name as expression, {_FACTS} from profs
  union all select 1, 'silver', st, sc, original_name, source_columns, expression, {_FACTS} from silver union all select 2, 'gold', gv, gc, original_name, source_columns, expression, {_FACTS} from silver),
dict as (select *, {_TEXT} as description from facts)"""
_SPACED = "replace({x}, ' ', '_')"
_CONCEPTS = """select 'concept_' || original_name as id, 'Concept: ' || original_name || ' | Description: ' || arg_min(description, k || layer || '.' || table_name || '.' || column_name) || ' | Appears across layers: ' ||
  string_agg(layer || '.' || table_name || '.' || column_name, ' -> ' order by k, layer || '.' || table_name || '.' || column_name) as document from dict group by original_name"""
_MEASURES = "measures as (select * from " + values([(d.id, d.name, d.table, m.name, m.text, ",".join(m.columns)) for d in DATASETS for m in d.measures], "dataset_id, dataset, bi_table, measure, expression, depends_on") + ")"
_ENTITIES = "entity as (" + R.ORACLE["ontology_entities"].replace(f"with {R._KEYS}, {LINEAGE}, ", "with ") + ")"
_RELATED = "related as (" + R.ORACLE["ontology_join_keys"].replace(f"with {R._KEYS}, {LINEAGE}, ", "with ") + ")"
_CHAINS = "chains as (" + R.ORACLE["lineage_e2e"].replace(f"with {LINEAGE}, {BI}, ", "with ") + ")"
_SHOWN = "shown as (" + R.ORACLE["artifact_hierarchy"].replace(f"with {R._TILES}, {R._REPORTS}, {R._DATASETS}, {R._DASH}\n", "") + ")"
_JOINED = "list_sort(list(distinct {c}))"
_SUMMARY = """select 'CATALOG SUMMARY | ' || concat_ws(' | ',
  (select 'Data Dictionary: ' || sum(t) || ' tables, ' || sum(n) || ' columns: ' || string_agg(upper(layer[1]) || layer[2:] || ' (' || t || ' tables: ' || names || ')', ', ' order by k)
   from (select k, layer, count(*) as n, count(distinct table_name) as t, array_to_string(list_sort(list(distinct table_name)), ', ') as names from dict group by 1, 2)),
  (select 'Ontology: ' || count(*) || ' entities (' || array_to_string(list_sort(list(entity)), ', ') || ')' from entity), (select 'Relationships: ' || count(*) from related),
  (select 'Lineage: ' || count(*) || ' columns from source to gold' from lin),
  (select 'Power BI: ' || count(*) || ' dashboards (' || array_to_string(list_sort(list(dashboard)), ', ') || ') with ' || sum(n_tiles) || ' tiles' from shown),
  (select 'Measures: ' || count(*) || ' (' || array_to_string(list_sort(list(measure)), ', ') || ')' from measures), (select 'Column mappings: ' || count(*) from bi), (select 'End-to-End Lineage: ' || count(*) || ' chains' from chains))"""
DOCUMENTS = f"""{DICTIONARY}, {BI}, {R._TILES}, {_MEASURES}, {R._REPORTS}, {R._DATASETS}, {R._DASH}, {_ENTITIES}, {_RELATED}, {_CHAINS}, {_SHOWN},
docs as (
  select 'data_dictionary' as collection, 'data_dictionary' as type, 'dict_' || layer || '_' || table_name || '_' || column_name as id,
    'Description: ' || description || ' | Original Name: ' || original_name || ' | Column: ' || column_name || ' | Table: ' || table_name || ' | Layer: ' || layer || ' | Type: ' || data_type as document from dict
  union all select 'data_dictionary', 'concept', id, document from ({_CONCEPTS})
  union all select 'data_dictionary', 'catalog_summary', 'catalog_summary', * from ({_SUMMARY})
  union all select 'ontology', 'entity', 'entity_' || entity, 'Entity: ' || entity || ' | Description: ' || description || ' | Source: ' || source_file || ' | Primary Key: ' || primary_key || ' | Attributes: ' || attributes ||
    ' | Silver Table: ' || silver_table || ' | Gold View: ' || gold_view from entity
  union all select 'ontology', 'relationship', {_SPACED.format(x="'rel_' || parent || ' to ' || child || '_' || column_name")}, 'Relationship: ' || parent || ' to ' || child || ' | Type: ' || relationship_type || ' | From: ' || parent || ' -> To: ' || child ||
    ' | Bronze Join: ' || parent || '.' || column_name || ' = ' || child || '.' || column_name || ' | Silver Join: ' || coalesce(from_silver, 'N/A') || ' = ' || coalesce(to_silver, 'N/A') || ' | Gold Join: ' || coalesce(from_gold, 'N/A') || ' = ' || coalesce(to_gold, 'N/A') from related
  union all select 'lineage', 'lineage', 'lineage_' || silver_table || '_' || (row_number() over (partition by silver_table order by ordinal) - 1) || '_' || source_column,
    'Column Lineage: ' || source_column || ' | Source: ' || source_file || '.' || source_column || ' -> Bronze: ' || bronze_table || '.' || bronze_column || ' -> Silver: ' || silver_table || '.' || silver_column || ' -> Gold: ' || gold_view || '.' || gold_column ||
    ' | Transformation: ' || transformation_type || ' | Expression: ' || expression from lin
  union all select 'pbi_lineage', 'pbi_column_lineage', 'pbi_lineage_' || bi_table || '_' || bi_column, 'PBI Column Lineage: ' || bi_column || ' | PBI: ' || bi_table || '.' || bi_column || ' | Dataset: ' || dataset || ' | Gold: ' || gold_view || '.' || gold_column || ' | DataType: ' || bi_type from bi
  union all select 'pbi_lineage', 'pbi_end_to_end', 'pbi_e2e_' || bi_table || '_' || bi_column, 'End-to-End Lineage: ' || bi_column || ' | Chain: ' || chain || ' | Transformation: ' || transformation_type from chains
  union all select 'pbi_catalog', 'pbi_column', 'pbi_col_' || bi_table || '_' || bi_column, 'PBI Column: ' || bi_column || ' | Table: ' || bi_table || ' | Dataset: ' || dataset || ' | Type: ' || bi_type || ' | Gold: ' || gold_view || '.' || gold_column from bi
  union all select 'pbi_catalog', 'pbi_measure', {_SPACED.format(x="'pbi_measure_' || bi_table || '_' || measure")}, 'PBI Measure: ' || measure || ' | Table: ' || bi_table || ' | Dataset: ' || dataset || ' | Expression: ' || expression || ' | Depends on columns: ' || depends_on from measures
  union all select 'pbi_catalog', 'pbi_report', {_SPACED.format(x="'pbi_report_' || report")}, 'PBI Report: ' || report || ' | Dataset: ' || dataset
    from (select report, arg_min(d.dataset, t.tile_id) as dataset from tiles t join reports r using (report_id) join datasets d using (dataset_id) group by 1)
  union all select 'pbi_catalog', 'pbi_dashboard', {_SPACED.format(x="'pbi_dashboard_' || dashboard")}, 'PBI Dashboard: ' || dashboard || ' | Tiles: ' || tiles || ' | Reports: ' || reports from shown
  union all select 'pbi_catalog', 'pbi_artifact_relationship', {_SPACED.format(x="'pbi_rel_' || dashboard")},
    'PBI Artifact Hierarchy: Dashboard ''' || dashboard || ''' -> contains Tiles -> linked to Reports: ' || reports || ' -> Reports use Datasets: ' || datasets from shown)"""

_LAST = f"select *, row_number() over (partition by dataset_id order by started desc, request_id desc) as r from {values(REFRESHES, 'dataset_id, kind, started, ended, status, request_id')}"
# what a document can be found by: (id, field, value), written apart from the documents' metadata
_FOUND_BY = """by_field as (
  select 'data_dictionary' as collection, 'dict_' || layer || '_' || table_name || '_' || column_name as id, unnest(['column', 'original_name']) as field, unnest([column_name, original_name]) as value from dict
  union all select distinct 'data_dictionary', 'concept_' || original_name, 'original_name', original_name from dict
  union all select 'lineage', 'lineage_' || silver_table || '_' || k || '_' || source_column, unnest(['source_column', 'silver_column', 'gold_column']), unnest([source_column, silver_column, gold_column])
    from (select *, row_number() over (partition by silver_table order by ordinal) - 1 as k from lin)
  union all select 'ontology', 'entity_' || entity, 'entity', entity from entity
  union all select 'pbi_lineage', 'pbi_lineage_' || bi_table || '_' || bi_column, unnest(['pbi_column', 'gold_column']), unnest([bi_column, gold_column]) from bi
  union all select 'pbi_lineage', 'pbi_e2e_' || bi_table || '_' || bi_column, unnest(['pbi_column', 'gold_column', 'bronze_column', 'source_column']), unnest([bi_column, gold_column, bronze_column, source_column]) from chains
  union all select 'pbi_catalog', 'pbi_col_' || bi_table || '_' || bi_column, 'pbi_column', bi_column from bi
  union all select 'pbi_catalog', replace('pbi_measure_' || bi_table || '_' || measure, ' ', '_'), 'measure_name', measure from measures
  union all select distinct 'pbi_catalog', replace('pbi_report_' || report, ' ', '_'), 'report_name', report from tiles join reports using (report_id)
  union all select 'pbi_catalog', unnest([replace('pbi_dashboard_' || dashboard, ' ', '_'), replace('pbi_rel_' || dashboard, ' ', '_')]), 'dashboard_name', dashboard from shown)"""
_HITS = f"""{DOCUMENTS}, {R._QUESTIONS}, {R.tokens_sql('questions')}, {_FOUND_BY},
probe as (select * from {values(PROBES, 'collection, field, score')}), words as (select * from {values([(w, c, k, x) for ws, c, k, x in TYPE_WORDS for w in ws.split()], 'word, collection, type, score')}),
hits as (
  select t.query_id, d.collection, d.id, d.document, p.score from toks t join by_field b on b.value = t.token or b.field = 'entity' and b.value = upper(t.token[1]) || lower(t.token[2:])
    join probe p using (collection, field) join docs d using (collection, id)
  union all select t.query_id, d.collection, d.id, d.document, w.score from toks t join words w on w.word = lower(t.token) join docs d using (collection, type))
select query_id, collection, id, cast(score as double) as score from (select *, row_number() over (partition by query_id, document[1:100] order by score desc, collection, id) as r from hits) where r = 1"""
ORACLE = {
    "catalog_keyword_hits": f"with {_HITS}",
    "dictionary_full": f"with {DICTIONARY} select layer, table_name, column_name, original_name, source_columns, expression, data_type, description, null_pct, unique_count from dict",
    "concept_documents": f"with {DICTIONARY} {_CONCEPTS}",
    "catalog_documents": f"with {DOCUMENTS} select collection, id, document, type from docs",
    "catalog_summary_counts": f"with {DOCUMENTS} select collection, type, count(*) as n_documents from docs group by 1, 2",
    "collection_counts": f"with {DOCUMENTS} select collection, count(*) as n_documents from docs group by 1",
    "refresh_history": f"select dataset_id, request_id, status from ({_LAST}) where r <= 2",
}
