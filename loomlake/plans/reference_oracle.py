"""SQL for the catalog's queries: written apart from the Spark plans, from the same fixed inputs."""

from __future__ import annotations

from loomlake.functions.expressions import DEEP_PHRASES, FAST_PHRASES, NA_TOKENS, STOP_WORDS
from loomlake.operators.medallion import name_map
from loomlake.plans.reference_queries import ANSWERS, COUNTED, GOLD_NAMES, QUESTIONS, REPLIES, SCORES, VIEW_TEXTS
from loomlake.plans.specs import AS_OF, CLINICAL, DASHBOARDS, DATASETS, FINANCIAL, RAW_KEYS, REPORTS, SILVER, TILES


def q(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, int | float):
        return str(x)
    if isinstance(x, list):
        return "[" + ", ".join(map(q, x)) + "]"
    return "'" + str(x).replace("'", "''") + "'"


def values(rows, names: str) -> str:
    return "(values " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + f") as t({names})"


def first(table: str, columns: str = "* exclude (rn)") -> str:
    """A table with each record once: its first delivery; rows without a key all stay."""
    key = RAW_KEYS[table]
    return f"(select {columns} from (select *, row_number() over (partition by {key} order by load_id, loaded_at) as rn from {table}) where rn = 1 or {key} is null)"


NA = ", ".join(map(q, NA_TOKENS))
_PATIENTS = ("patient_id", "first_name", "last_name", "dob", "gender", "blood_type", "phone", "address", "insurance_provider")
_AGE = f"cast(trunc((date '{AS_OF}' - try_cast(p.dob as date)) / 365.25) as double)"
CLINICAL_SQL = f"""select p.patient_id, p.first_name || ' ' || p.last_name as full_name,
  case when regexp_full_match(p.dob, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then {_AGE} end as age,
  p.gender, p.blood_type, v.visit_date, v.department, v.diagnosis, v.doctor_name, v.treatment, v.status
from {first('visits')} v join {first('patients')} p on v.patient_id = p.patient_id"""
FINANCIAL_SQL = f"""select v.visit_id, v.patient_id, v.department, b.procedure_code, v.bill_amount, b.insurance_covered, v.bill_amount - b.insurance_covered as out_of_pocket,
  b.copay_amount, p.insurance_provider, b.payment_status, b.billing_date
from {first('billing')} b join {first('visits')} v on b.visit_id = v.visit_id join {first('patients')} p on v.patient_id = p.patient_id"""

_CLINICAL_MEASURES = """count(*) as patient_count, round(avg(age), 4) as avg_patient_age,
  count(distinct department) + max(case when department is null then 1 else 0 end) as unique_departments, count(*) filter (where status = 'Completed') as active_visits"""


def _fin(c: str) -> str:
    return f"case when isfinite({c}) then {c} end"


_FINANCIAL_MEASURES = f"""round(sum({_fin('bill_amount')}), 2) as total_revenue, round(avg({_fin('copay_amount')}), 2) as avg_copay,
  round(sum({_fin('insurance_covered')}) / nullif(sum({_fin('bill_amount')}), 0), 2) as insurance_coverage_rate,
  round(sum({_fin('out_of_pocket')}), 2) as total_out_of_pocket, count(*) filter (where payment_status = 'Paid') as paid_claims"""

NUMERIC = {"bill_amount": "float64", "load_id": "int64", "insurance_covered": "float64", "copay_amount": "float64"}


def profile_sql(source: str, columns: dict[str, str]) -> str:
    """One select per column: the reference form of a profile."""
    parts = []
    for c, kind in columns.items():
        num = kind in ("int64", "float64")
        here = f"case when isnan({c}) then null else {c} end" if kind == "float64" else c
        x = f"case when isfinite({c}) then {c} end" if kind == "float64" else c
        parts.append(
            f"""select '{c}' as column_name, '{kind}' as data_type, count(*) as n_rows, count(*) - count({here}) as null_count,
  round(100.0 * (count(*) - count({here})) / count(*), 2) as null_pct, count(distinct {here}) as unique_count,
  {f'cast(min({x}) as double)' if num else 'cast(null as double)'} as min_value, {f'cast(max({x}) as double)' if num else 'cast(null as double)'} as max_value,
  {f'round(avg({x}), 2)' if num else 'cast(null as double)'} as mean_value,
  {'cast(null as double)' if num else f'cast(min(length({c})) as double)'} as min_length, {'cast(null as double)' if num else f'cast(max(length({c})) as double)'} as max_length from src"""
        )
    return f"with src as (select * from {source}) " + " union all ".join(parts)


_VISITS = {c: NUMERIC.get(c, "object") for c in ("visit_id", "patient_id", "visit_date", "department", "diagnosis", "doctor_name", "treatment", "bill_amount", "status", "clinic_id", "load_id")}
_BILLING = {c: NUMERIC.get(c, "object") for c in ("billing_id", "visit_id", "patient_id", "procedure_code", "insurance_covered", "copay_amount", "payment_status", "billing_date")}
_PAT = {c: "object" for c in _PATIENTS}
VISIT_PROFILE = profile_sql(first("visits"), _VISITS)
_SUITE = f"""prof as ({VISIT_PROFILE}),
suite as (
  select 'row_count' as expectation_type, cast(null as varchar) as column_name, true as success from (select max(n_rows) as n from prof) where n is not null
  union all select 'not_null', column_name, null_count = 0 from prof where null_pct = 0
  union all select 'unique', column_name, true from prof where unique_count = n_rows
  union all select 'between', column_name, true from prof where min_value is not null
  union all select 'in_set', column_name, true from prof where unique_count between 1 and 10)"""

CATALOG = {
    "patients": {**_PAT, "load_id": "int64", "loaded_at": "datetime64[ns]"},
    "visits": {**_VISITS, "loaded_at": "datetime64[ns]"},
    "billing": {**_BILLING, "load_id": "int64", "loaded_at": "datetime64[ns]"},
}
_KINDS = """case when data_type = 'VARCHAR' then 'object' when data_type in ('BIGINT', 'INTEGER') then 'int64' when data_type = 'DOUBLE' then 'float64' when data_type like 'TIMESTAMP%' then 'datetime64[ns]' else 'object' end"""
_COLUMNS = f"""cols as (select table_name, column_name, cast(ordinal_position - 1 as bigint) as ordinal, {_KINDS} as data_type from information_schema.columns
  where table_name in ('patients', 'visits', 'billing', 'orders', 'customer', 'lineitem'))"""


def _all_profiles() -> str:
    parts = []
    for t, cols in (("patients", _PAT), ("visits", {k: v for k, v in _VISITS.items() if k != "load_id"}), ("billing", _BILLING)):
        order = values([(c, i) for i, c in enumerate(cols)], "column_name, ordinal")
        parts.append(f"select '{t}' as table_name, p.*, o.ordinal from ({profile_sql(first(t), cols)}) p join (select * from {order}) o using (column_name)")
    return "profs as (" + " union all ".join(parts) + ")"


_TITLE = "array_to_string(list_transform(string_split(replace({c}, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_DESCRIBED = f"""with {_all_profiles()}, given as (select * from {values([('patients', 'dob', 'Date of birth'), ('visits', 'status', '')], 'table_name, column_name, description')})
select p.table_name, p.column_name, coalesce(nullif(g.description, ''), concat_ws('. ', {_TITLE.format(c='p.column_name')},
  case when data_type in ('int64', 'float64') and min_value is not null then 'Range: ' || cast(cast(round(min_value, 2) as decimal(18,2)) as varchar) || '-' || cast(cast(round(max_value, 2) as decimal(18,2)) as varchar) end,
  case when n_rows > 0 and unique_count = n_rows then 'Unique per row' when unique_count > 0 then unique_count || ' distinct values' end,
  case when null_pct > 0 then cast(cast(null_pct as decimal(18,2)) as varchar) || '% null' end)) as description
from profs p left join given g using (table_name, column_name)"""

_KEYS = f"""{_all_profiles()}, ranked as (
  select table_name, column_name, case when ends_with(column_name, '_id') and unique_count = n_rows then 1
    when column_name = regexp_replace(table_name, 's+$', '') || '_id' or column_name = 'id' then 2 when ordinal = 0 then 3 end as k, ordinal from profs),
keys as (select table_name, column_name as primary_key from (select *, row_number() over (partition by table_name order by k, ordinal) as r from ranked where k is not null) where r = 1),
links as (
  select s.parent, p.table_name as child, p.column_name from profs p join keys k using (table_name)
  join (select column_name, max(case when column_name = primary_key then table_name end) as parent, count(*) as n from profs join keys using (table_name) group by 1) s using (column_name)
  where s.n >= 2 and s.parent is not null and p.column_name <> k.primary_key)"""

_PHYSICAL = {(lt, lc): (st, sc, gv, gc) for st, sc, gv, gc, lt, lc in name_map(SILVER)}
_EDGES, _k = [], 0
for _s in SILVER:
    for _c in _s.columns:
        for _t, _x in _c.sources:
            _EDGES.append((len(_EDGES), f"bronze_{_t}", _x, *_PHYSICAL[(_s.name, _c.name)][:2], _c.kind, _c.expression))
EDGES = f"edges as (select * from {values(_EDGES, 'ordinal, source_table, source_column, target_table, target_column, transformation_type, expression')})"
MAPPING = f"mapping as (select * from {values([tuple(v) for v in _PHYSICAL.values()], 'silver_table, silver_column, gold_view, gold_column')})"
LINEAGE = f"""{EDGES}, {MAPPING}, lin as (
  select ordinal, replace(source_table, 'bronze_', '') || '.csv' as source_file, source_column, source_table as bronze_table, source_column as bronze_column,
    target_table as silver_table, target_column as silver_column, coalesce(gold_view, 'N/A') as gold_view, coalesce(gold_column, 'N/A') as gold_column, transformation_type, expression
  from edges left join mapping on silver_table = target_table and silver_column = target_column)"""
_BI = []
for _d in DATASETS:
    for _b in _d.columns:
        _BI.append((len(_BI), _d.name, _d.table, _b.name, _b.kind, *_PHYSICAL[(_d.silver, _b.column)][2:]))
BI = f"bi as (select * from {values(_BI, 'bi_ordinal, dataset, bi_table, bi_column, bi_type, gold_view, gold_column')})"
_TILES = f"tiles as (select * from {values(TILES, 'tile_id, tile, dashboard_id, report_id, dataset_id')})"
_MEASURES = "measures as (select * from " + values([(d.id, d.name, d.table, i, m.name) for d in DATASETS for i, m in enumerate(d.measures)], "dataset_id, dataset, bi_table, measure_ordinal, measure") + ")"
_REPORTS = f"reports as (select * from {values(REPORTS, 'report_id, report, rds')})"
_DATASETS = "datasets as (select * from " + values([(d.id, d.name, d.table) for d in DATASETS], "dataset_id, dataset, bi_table") + ")"
_DASH = f"dashboards as (select * from {values(DASHBOARDS, 'dashboard_id, dashboard')})"
_MATCH = """matched as (select tile_id, tile, measure from (
  select t.*, m.measure, row_number() over (partition by t.tile_id order by m.measure_ordinal) as r
  from tiles t left join measures m on t.dataset_id = m.dataset_id and contains(lower(replace(t.tile, ' ', '')), lower(replace(m.measure, ' ', '')))) where r = 1)"""

_STOP = ", ".join(map(q, STOP_WORDS))


def tokens_sql(source: str) -> str:
    """(query_id, token) of a source with (query_id, question)."""
    return f"""raw as (select query_id, trim(unnest(regexp_split_to_array(trim(regexp_replace(question, '[,?.]', ' ', 'g')), '[ \\t\\r\\n]+')), '''"`()[]{{}}!@#$%^&*') as t from {source} where question is not null),
kept as (select query_id, t from raw where length(t) > 1 and not regexp_full_match(t, '\\p{{Nd}}+') and lower(t) not in ({_STOP})),
toks as (select distinct query_id, token from (select query_id, t as token from kept union all select query_id, lower(t) from kept))"""


_QUESTIONS = f"questions as (select * from {values(QUESTIONS, 'query_id, question')})"
_ASKING = "asking as (select doc_id as query_id, text as question from documents where doc_id % 100 = 0)"
_KNN = """near as (select * from (
  select query_id, collection, item_id, score, row_number() over (partition by query_id, collection order by score desc, item_id) - 1 as rank from (
    select a.vec_id as query_id, cast(b.label as varchar) as collection, b.vec_id as item_id,
      round(greatest(0.0, coalesce(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 0.0)), 4) as score
    from embeddings a, embeddings b where a.vec_id % 100 = 0)) where rank < 7),
lists as (select query_id, collection || ':' || item_id as chunk, item_id, rank from near),
fused as (select query_id, chunk, round(sum(s), 4) as rrf_score from (
  select query_id, chunk, 1.0 / (61 + rank) as s from lists union all select query_id, chunk, 0.95 from lists where item_id % 7 = 0) group by 1, 2)"""
_PASSED = """passed as (select query_id, chunk, rrf_score from (
  select *, max(case when rrf_score >= 0.15 then 1 else 0 end) over (partition by query_id) as anyone, row_number() over (partition by query_id order by rrf_score desc, chunk) as n from fused)
  where rrf_score >= 0.15 or (anyone = 0 and n <= 3))"""


def _any(column: str, phrases) -> str:
    return "(" + " or ".join(f"contains({column}, {q(p)})" for p in phrases) + ")"


def route_sql(column: str) -> str:
    c = f"lower({column})"
    return f"case when {column} is null then null when {_any(c, DEEP_PHRASES)} then 'deep' when {_any(c, FAST_PHRASES)} then 'fast' else 'deep' end"


_CASES = """cases as (select doc_id, lang as domain, (coalesce(n_chars, 0) % 3) / 2.0 as context_precision,
  case when coalesce(tags, '') = '' then 1.0 else least(len(e), 2) * 1.0 / len(e) end as raw_recall, e,
  case when coalesce(score, 0) <= 0 or coalesce(length(text), 0) = 0 then 0.0 when is_accepted then 1.0 else 0.0 end as faithfulness,
  greatest(0.0, least(1.0, coalesce(score / 10.0, 0.5))) as answer_relevancy
  from (select *, list_filter(string_split(coalesce(tags, ''), '|'), lambda x: x <> '') as e from documents)),
scored as (select *, case when len(e) = 0 then 1.0 else len(list_filter(e, lambda x: list_contains(e[1:2], x))) * 1.0 / len(e) end as context_recall from cases)"""
_METRICS = ("context_precision", "context_recall", "faithfulness", "answer_relevancy")

ORACLE = {
    "bronze_scan_rowcounts": " union all ".join(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in COUNTED),
    "bronze_clean_patients": "select " + ", ".join(f"case when {c} not in ({NA}) then {c} end as {c}" for c in _PATIENTS) + f" from {first('patients')}",
    "bronze_csv_roundtrip": "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier",
    "silver_clinical": CLINICAL_SQL,
    "silver_financial": FINANCIAL_SQL,
    "gold_rename_view": "select " + ", ".join(f"{lc} as {gc}" for lc, gc in GOLD_NAMES[CLINICAL.name].items()) + f" from ({CLINICAL_SQL})",
    "push_rename_passthrough": "select " + ", ".join(f"{c.column} as {c.name if c.column != 'billing_date' else GOLD_NAMES[FINANCIAL.name]['billing_date']}" for c in DATASETS[1].columns) + f" from ({FINANCIAL_SQL})",
    "strip_internal_columns": f"with {BI} select dataset, bi_table, bi_column, bi_type from bi",
    "bi_clinical_measures": f"select gender, {_CLINICAL_MEASURES} from ({CLINICAL_SQL}) group by gender",
    "bi_financial_measures": f"select payment_status, {_FINANCIAL_MEASURES} from ({FINANCIAL_SQL}) group by payment_status",
    "bi_financial_totals": f"select {_FINANCIAL_MEASURES} from ({FINANCIAL_SQL})",
    "bi_measures_rollup": f"select department, status, cast(grouping_id(department, status) as bigint) as level, {_CLINICAL_MEASURES} from ({CLINICAL_SQL}) group by rollup (department, status)",
    "bi_measures_cube": f"select gender, blood_type, cast(grouping_id(gender, blood_type) as bigint) as level, {_CLINICAL_MEASURES} from ({CLINICAL_SQL}) group by cube (gender, blood_type)",
    "profile_visits": VISIT_PROFILE,
    "profile_orders": profile_sql("orders", {"o_orderkey": "int64", "o_custkey": "int64", "o_orderstatus": "object", "o_totalprice": "float64", "o_orderpriority": "object"}),
    "profile_customer": profile_sql("customer", {"c_custkey": "int64", "c_name": "object", "c_nationkey": "int64", "c_acctbal": "float64", "c_mktsegment": "object"}),
    "profile_samples": f"with src as (select * from {first('patients')}) " + " union all ".join(
        f"select '{c}' as column_name, string_agg(v, '|' order by k) as sample_values from (select {c} as v, patient_id as k from src where {c} is not null order by patient_id limit 3)" for c in _PATIENTS
    ),
    "dq_suite_visits": f"with {_SUITE} select expectation_type, column_name, success from suite",
    "dq_summary": f"with {_SUITE} select bool_and(success) as success, count(*) as expectations, count(*) filter (where success) as successful, count(*) filter (where not success) as failed from suite",
    "dq_checked_load": f"""with v as (select * from {first('visits')})
select 'row_count' as expectation_type, cast(null as varchar) as column_name, count(*) between 1 and 1e12 as success from v
union all select 'not_null', 'visit_id', count(*) = count(visit_id) from v union all select 'not_null', 'department', count(*) = count(department) from v
union all select 'unique', 'visit_id', count(visit_id) = count(distinct visit_id) from v union all select 'unique', 'patient_id', count(patient_id) = count(distinct patient_id) from v
union all select 'between', 'bill_amount', count(*) filter (where isfinite(bill_amount) and bill_amount not between 0 and 1e9) = 0 from v
union all select 'between', 'load_id', count(*) filter (where load_id not between 1 and 18) = 0 from v
union all select 'in_set', 'status', count(*) filter (where status not in ('Completed', 'In Progress', 'Cancelled', 'No Show')) = 0 from v
union all select 'in_set', 'clinic_id', count(*) filter (where clinic_id not in ({', '.join(q(f'C{i:05d}') for i in range(1, 2000))})) = 0 from v""",
    "catalog_columns": f"with {_COLUMNS} select table_name, column_name, ordinal, data_type from cols",
    "catalog_tables_like": f"with {_COLUMNS} select distinct table_name from cols where table_name ilike '%I_ITS'",
    "catalog_schemas": f"with {_COLUMNS} select table_name, count(*) as n_columns, string_agg(column_name, ',' order by ordinal) as column_list from cols group by table_name",
    "catalog_view_registry": f"with {_COLUMNS} select 'loom_' || table_name as view_name, count(*) as n_columns from cols where table_name in ('patients', 'visits', 'billing') group by table_name",
    "dictionary_descriptions": _DESCRIBED,
    "dictionary_originals": f"""with {EDGES}, {MAPPING}, named as (
  select target_column as column_name, string_agg(source_column, ',' order by ordinal) as sources, arg_min(expression, ordinal) as expression, arg_min(source_column, ordinal) as original_name from edges group by 1)
select * from named union all select gold_column, sources, expression, original_name from mapping join named on silver_column = column_name""",
    "pk_detection": f"with {_KEYS} select table_name, primary_key from keys",
    "fk_detection": f"with {_KEYS} select parent, child, column_name from links",
    "ontology_join_keys": f"""with {_KEYS}, {LINEAGE}, firsts as (select * from (select *, row_number() over (partition by bronze_table, bronze_column order by ordinal) as r from lin) where r = 1),
j as (select 'bronze_' || l.parent as parent, 'bronze_' || l.child as child, l.column_name, a.silver_table || '.' || a.silver_column as fs, b.silver_table || '.' || b.silver_column as ts,
    a.gold_view || '.' || a.gold_column as fg, b.gold_view || '.' || b.gold_column as tg
  from links l left join firsts a on a.bronze_table = 'bronze_' || l.parent and a.bronze_column = l.column_name left join firsts b on b.bronze_table = 'bronze_' || l.child and b.bronze_column = l.column_name)
select parent, child, column_name, 'one_to_many' as relationship_type, case when fs is not null and ts is not null then fs end as from_silver, case when fs is not null and ts is not null then ts end as to_silver,
  case when fs is not null and ts is not null then fg end as from_gold, case when fs is not null and ts is not null then tg end as to_gold from j""",
    "ontology_entities": f"""with {_KEYS}, {LINEAGE}, firsts as (select * from (select *, row_number() over (partition by bronze_table, bronze_column order by ordinal) as r from lin) where r = 1),
attrs as (select p.table_name, string_agg(p.column_name, ', ' order by p.ordinal) as attributes from profs p join keys k using (table_name) where p.column_name <> k.primary_key group by 1)
select regexp_replace(upper(k.table_name[1]) || k.table_name[2:], 's+$', '') as entity, k.table_name || '.csv' as source_file, k.primary_key, coalesce(attributes, '') as attributes,
  regexp_replace(upper(k.table_name[1]) || k.table_name[2:], 's+$', '') || ' records with ' || array_to_string(string_split(coalesce(attributes, ''), ', ')[1:10], ', ') ||
    case when len(string_split(coalesce(attributes, ''), ', ')) > 10 then ' and ' || (len(string_split(attributes, ', ')) - 10) || ' more' else '' end as description,
  coalesce(f.silver_table, 'N/A') as silver_table, coalesce(f.gold_view, 'N/A') as gold_view
from keys k left join attrs using (table_name) left join firsts f on f.bronze_table = 'bronze_' || k.table_name and f.bronze_column = k.primary_key""",
    "lineage_b2s": f"with {EDGES} select * from edges",
    "lineage_joined": f"with {LINEAGE} select * from lin",
    "lineage_by_target": f"with {EDGES} select target_table, count(*) as n_edges, count(distinct target_column) as n_columns, string_agg(source_table || '.' || source_column, ',' order by ordinal) as source_columns from edges group by 1",
    "lineage_e2e": f"""with {LINEAGE}, {BI}, known as (select * exclude (r) from (select *, row_number() over (partition by gold_view, gold_column order by ordinal desc) as r from lin where not (gold_view = 'N/A' and gold_column = 'N/A')) where r = 1)
select b.bi_ordinal, b.bi_table, b.bi_column, b.gold_view, b.gold_column, coalesce(k.silver_table, 'N/A') as silver_table, coalesce(k.silver_column, 'N/A') as silver_column,
  coalesce(k.bronze_table, 'N/A') as bronze_table, coalesce(k.bronze_column, 'N/A') as bronze_column, coalesce(k.source_file, 'N/A') as source_file, coalesce(k.source_column, 'N/A') as source_column, coalesce(k.transformation_type, 'N/A') as transformation_type,
  b.bi_table || '.' || b.bi_column || ' -> ' || b.gold_view || '.' || b.gold_column || ' -> ' || coalesce(k.silver_table, '?') || '.' || coalesce(k.silver_column, '?') || ' -> ' || coalesce(k.bronze_table, '?') || '.' || coalesce(k.bronze_column, '?') || ' -> ' || coalesce(k.source_file, '?') || '.' || coalesce(k.source_column, '?') as chain
from bi b left join known k using (gold_view, gold_column)""",
    "view_lineage_parse": f"""with d as (select * from {values(VIEW_TEXTS, 'view_name, ddl')}), items as (
  select view_name, regexp_extract(ddl, '(?is)\\sfrom\\s+([A-Za-z0-9_]+)', 1) as source_table, unnest(regexp_split_to_array(regexp_extract(ddl, '(?is)\\bselect\\s+(.*?)\\s+from\\s', 1), '\\s*,\\s*')) as item from d where ddl is not null)
select view_name, source_table, regexp_extract(item, '(?i)^(\\S+)\\s+as\\s+(\\S+)$', 1) as source_column, regexp_extract(item, '(?i)^(\\S+)\\s+as\\s+(\\S+)$', 2) as view_column from items""",
    "plan_lineage": f"select * from {values([('label', 'c_name'), ('label', 'c_mktsegment'), ('twice', 'c_acctbal'), ('key', 'c_custkey')], 'output, source')}",
    "tile_measure_match": f"with {_TILES}, {_MEASURES}, {_MATCH} select tile_id, tile, measure from matched",
    "artifact_hierarchy": f"""with {_TILES}, {_REPORTS}, {_DATASETS}, {_DASH}
select d.dashboard_id, d.dashboard, count(t.tile_id) as n_tiles, string_agg(t.tile, ', ' order by t.tile_id) as tiles,
  array_to_string(list_sort(list(distinct r.report)), ', ') as reports, array_to_string(list_sort(list(distinct s.dataset)), ', ') as datasets, array_to_string(list_sort(list(distinct s.bi_table)), ', ') as bi_tables
from dashboards d left join tiles t using (dashboard_id) left join reports r using (report_id) left join datasets s using (dataset_id) group by 1, 2""",
    "artifact_tiles": f"""with {_TILES}, {_MEASURES}, {_REPORTS}, {_DATASETS}, {_DASH}, {_MATCH}
select t.tile_id, coalesce(d.dashboard, 'Unknown') as dashboard, t.tile, coalesce(r.report, 'Unknown') as report, coalesce(s.dataset, 'Unknown') as dataset, coalesce(s.bi_table, 'Unknown') as bi_table, m.measure
from tiles t left join dashboards d using (dashboard_id) left join reports r using (report_id) left join datasets s using (dataset_id) left join matched m on m.tile_id = t.tile_id""",
    "refresh_history_top": "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r <= 3",
    "upsert_documents": "select doc_id, case when lang = 'de' then 'replaced' else coalesce(text, '') end as text from documents union all select -1, 'added'",
    "dedup_prefix_100": "select min(doc_id) as doc_id from documents where text is not null group by substring(text, 1, 100)",
    "tokenize_questions": f"with {_QUESTIONS}, {tokens_sql('questions')} select query_id, token from toks",
    "tokenize_documents": f"with posts as (select doc_id as query_id, text as question from documents), {tokens_sql('posts')} select query_id, token from toks",
    "keyword_lookup": f"""with {_ASKING}, {tokens_sql('asking')}, tag as (select doc_id as item_id, unnest(string_split(tags, '|')) as value, generate_subscripts(string_split(tags, '|'), 1) as pos from documents where tags is not null),
hits as (select query_id, item_id, round(sum(1.0 / pos), 4) as score from tag join toks on value = token group by 1, 2)
select * from (select query_id, item_id, score, row_number() over (partition by query_id order by score desc, item_id) as rank from hits) where rank <= 10""",
    "knn_cosine_topk": f"with {_KNN} select query_id, collection, item_id, score, rank from near",
    "rrf_fusion": f"with {_KNN} select query_id, chunk, rrf_score from fused",
    "feedback_boost": f"""with {_KNN}, good as (select distinct query_id, chunk from lists where item_id % 11 = 0)
select f.query_id, f.chunk, round(f.rrf_score + case when g.chunk is not null then 0.5 else 0.0 end, 4) as rrf_score, g.chunk is not null as feedback_boosted from fused f left join good g using (query_id, chunk)""",
    "threshold_fallback": f"with {_KNN}, {_PASSED} select query_id, chunk, rrf_score from passed",
    "missing_collections": f"""with {_KNN}, {_PASSED} select query_id, collection from (select distinct query_id from passed), (select distinct cast(label as varchar) as collection from embeddings)
except select query_id, split_part(chunk, ':', 1) from passed""",
    "route_questions": f"select doc_id, {route_sql('text')} as route from documents",
    "route_fixed_questions": f"with {_QUESTIONS} select query_id, {route_sql('question')} as route from questions",
    "verify_citations": f"""with a as (select * from {values(ANSWERS, 'answer_id, answer, chunks')}), c as (select answer_id, chunks, list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: cast(x as int)))) as ns from a),
b as (select answer_id, list_filter(ns, lambda n: n < 1 or n > chunks) as bad from c)
select answer_id, len(bad) = 0 as valid, array_to_string(bad, ',') as invalid from b""",
    "cited_numbers": "select doc_id, len(list_distinct(list_transform(regexp_extract_all(text, '\\[(\\d+)\\]', 1), lambda x: coalesce(cast(try_cast(x as int) as varchar), 'none')))) as n_cited from documents where text is not null",
    "assess_quality": f"""with s as (select * from {values(SCORES, 'query_id, scores')}) select query_id, case when coalesce(len(scores), 0) = 0 then 'NONE' when list_avg(scores[1:3]) > 0.6 then 'HIGH' when list_avg(scores[1:3]) > 0.3 then 'MEDIUM' else 'LOW' end as quality from s""",
    "eval_context_recall": f"with {_CASES} select doc_id, round(context_recall, 6) as context_recall from scored",
    "eval_context_precision": "select question_id as case_id, round(coalesce(avg(case when score > 0 then 1.0 when score <= 0 then 0.0 end), 0.0), 6) as context_precision from documents where question_id is not null group by 1",
    "eval_averages": f"with {_CASES} select count(*) as n_cases, " + ", ".join(f"coalesce(round(avg({m}), 2), 0.0) as {m}" for m in _METRICS) + " from scored",
    "eval_domain_breakdown": f"with {_CASES} select coalesce(domain, 'unknown') as domain, count(*) as n_cases, " + ", ".join(f"round(avg(round({m}, 2)), 4) as {m}" for m in _METRICS) + " from scored group by 1",
    "eval_judged_answers": "select doc_id, contains(upper(text), 'YES') as yes, contains(upper(text), 'GROUNDED') as grounded from documents where text is not null",
    "feedback_retention": "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events where event_type is not null) where r <= 20",
    "feedback_last_100": "select event_id from events order by ts desc, event_id desc limit 100",
    "jsonl_log_roundtrip": "select event_id, user_id, event_type, round(value, 4) as value from events",
    "push_append_counts": "select 'clinical' as dataset_id, 'PatientClinical' as table_name, count(*) as n_rows from nation union all select 'financial', 'FinancialRecords', count(*) from supplier",
    "stream_events_sliding": """select strftime(d, '%Y-%m-%d') as day, event_type, count(*) as n_events, round(sum(value), 2) as total
from (select unnest([cast(ts as date), cast(ts as date) - 1]) as d, event_type, value from events) group by 1, 2""",
    "stream_events_sessions": """with marked as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as first from events),
numbered as (select user_id, ts, sum(first) over (partition by user_id order by ts rows unbounded preceding) as s from marked)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, strftime(max(ts) + interval 6 hours, '%Y-%m-%d %H:%M:%S') as session_end, count(*) as n_events from numbered group by user_id, s""",
    "stream_events_tumbling": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n_events, round(sum(value), 2) as total from events group by 1, 2",
    "fenced_json": f"""with r as (select * from {values(REPLIES, 'reply_id, reply')}), j as (select reply_id, nullif(regexp_extract(replace(replace(reply, '```json', ''), '```', ''), '(?s)(\\{{.*\\}})', 1), '') as t from r)
select reply_id, json_extract_string(t, '$.a') as a, json_extract_string(t, '$.b') as b from j""",
    "mapping_keys": f"with {EDGES} select distinct source_table || '_to_' || target_table as mapping, source_table as source, target_table as target from edges",
    "strip_nested_fields": f"with {BI} select dataset, bi_column, bi_type from bi",
    "feedback_chunks": "select 1 as query_id, unnest(['lineage:bill', 'pbi_catalog:bill']) as chunk",
    "stream_bronze_append": "select event_id, user_id from events",
}
