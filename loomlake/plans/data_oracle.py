"""SQL for the core's pN_ queries."""

from __future__ import annotations

_FIRST = """first_visits as (
  select * exclude (rn) from (select *, row_number() over (partition by visit_id order by load_id, loaded_at) as rn from visits) where rn = 1)"""

_DAYS = f"""{_FIRST}, days as (
  select patient_id, try_cast(visit_date as date) as d,
         coalesce(sum(bill_amount) filter (where isfinite(bill_amount)), 0.0) as s, count(bill_amount) filter (where isfinite(bill_amount)) as n
  from first_visits
  where patient_id is not null and regexp_full_match(visit_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and try_cast(visit_date as date) is not null
  group by 1, 2)"""

P4 = f"""with {_DAYS}, grid as (
  select patient_id, unnest(generate_series(min(d)::timestamp, max(d)::timestamp, interval 1 day))::date as d from days group by patient_id),
filled as (select g.patient_id, g.d, coalesce(s, 0.0) as s, coalesce(n, 0) as n from grid g left join days using (patient_id, d)),
w as (select patient_id, d,
  sum(s) over w7 as s7, sum(n) over w7 as n7, sum(s) over w30 as s30, sum(n) over w30 as n30 from filled
  window w7 as (partition by patient_id order by d rows between 6 preceding and current row),
         w30 as (partition by patient_id order by d rows between 29 preceding and current row))
select patient_id, strftime(d, '%Y-%m-%d') as visit_day,
  case when n7 > 0 then round(s7, 2) else 0.0 end as total_7, case when n7 > 0 then round(s7, 2) / n7 end as avg_7,
  case when n30 > 0 then round(s30, 2) else 0.0 end as total_30, case when n30 > 0 then round(s30, 2) / n30 end as avg_30
from w"""

P4_TREES = f"""with {_DAYS}
select patient_id, cast(floor((d - date '1970-01-01') / 64.0) as int) as shard, round(sum(s), 2) as total, cast(sum(n) as bigint) as n_amounts
from days group by 1, 2"""

_REFS = """refs as (
  select 'visits' as table_name, visit_id as record_key, 'patient_id' as field_name, 'patients' as parent, patient_id as ref, loaded_at from visits where patient_id is not null
  union all select 'billing', billing_id, 'visit_id', 'visits', visit_id, loaded_at from billing where visit_id is not null
  union all select 'billing', billing_id, 'patient_id', 'patients', patient_id, loaded_at from billing where patient_id is not null),
parents as (
  select parent, k, min(first_loaded) as first_loaded, max(deleted_at) as deleted_at from (
    select 'patients' as parent, upper(trim(patient_id)) as k, loaded_at as first_loaded, cast(null as timestamp) as deleted_at from patients where patient_id is not null
    union all select 'visits', upper(trim(visit_id)), loaded_at, null from visits where visit_id is not null
    union all select table_name, upper(trim(record_key)), null, deleted_at from deleted_records where record_key is not null) group by 1, 2),
classed as (
  select r.*, case when first_loaded is null and deleted_at is not null then 'deleted' when first_loaded is null then 'missing'
    when first_loaded > loaded_at then 'late' when deleted_at >= first_loaded and deleted_at < loaded_at then 'expired' else 'ok' end as status
  from refs r left join parents p on p.parent = r.parent and p.k = upper(trim(r.ref)))"""

P7 = f"with {_REFS} select distinct table_name, record_key, field_name from classed where status in ('missing', 'deleted')"

P7_REPORT = f"""with {_REFS}, once as (
  select table_name, field_name, record_key, min(struct_pack(l := loaded_at, s := status)) as f from classed where status <> 'ok' group by 1, 2, 3)
select table_name, field_name, strftime(f.l, '%Y-%m') as load_month, f.s as status, count(*) as n_references from once group by 1, 2, 3, 4"""

_FIGURES = """amounts as (
  select 'visits' as table_name, 'bill_amount' as column_name, load_id, bill_amount as v from visits
  union all select 'billing', 'copay_amount', load_id, copay_amount from billing),
med as (select table_name, column_name, median(v) as m from amounts where v is not null and isfinite(v) group by 1, 2),
judged as (select a.*, not isfinite(v) or v < 0 or v > 50 * m as bad from amounts a join med using (table_name, column_name) where v is not null),
rates as (
  select table_name, column_name, load_id, avg(case when v is null then 1 else 0 end) as f from amounts group by 1, 2, 3
  union all select 'billing', 'payment_status', load_id, avg(case when payment_status is null then 1 else 0 end) from billing group by load_id),
ranges as (select table_name, column_name, load_id, avg(case when bad then 1 else 0 end) as f from judged group by 1, 2, 3),
kept as (select table_name, column_name, load_id, v, count(*) as n from judged where not bad group by 1, 2, 3, 4),
loads as (select table_name, column_name, load_id, sum(n) as ln from kept group by 1, 2, 3),
totals as (select table_name, column_name, v, sum(n) as n from kept group by 1, 2, 3),
cum as (select table_name, column_name, v, sum(n) over (partition by table_name, column_name order by v) as c, sum(n) over (partition by table_name, column_name) as t from totals),
grid as (select l.table_name, l.column_name, l.load_id, l.ln, c.v, c.c, c.t from loads l join cum c using (table_name, column_name)),
curves as (
  select g.*, sum(coalesce(k.n, 0)) over (partition by g.table_name, g.column_name, g.load_id order by g.v) as own
  from grid g left join kept k on k.table_name = g.table_name and k.column_name = g.column_name and k.load_id = g.load_id and k.v = g.v),
ks as (select table_name, column_name, load_id, max(abs(own / ln - (c - own) / nullif(t - ln, 0))) as f from curves group by 1, 2, 3),
entries as (select canonical_value as e from canonical_values where field_name = 'payment_status'),
statuses as (select load_id, payment_status as s, payment_status in (select e from entries) as ok from billing where payment_status is not null),
patterns as (select load_id, avg(case when ok then 0 else 1 end) as f from statuses group by 1),
listed as (select load_id, s, count(*) as n from statuses where ok group by 1, 2),
tv as (
  select l.load_id, sum(abs(coalesce(x.n, 0) / l.ln - (e.en - coalesce(x.n, 0)) / nullif(e.t - l.ln, 0))) / 2 as f
  from (select load_id, sum(n) as ln from listed group by 1) l
  cross join (select s, sum(n) as en, sum(sum(n)) over () as t from listed group by 1) e
  left join listed x on x.load_id = l.load_id and x.s = e.s group by 1),
figures as (
  select table_name, column_name, load_id, 'null_rate' as finding, f, abs(f - median(f) over (partition by table_name, column_name)) > 0.10 as exceeds from rates
  union all select table_name, column_name, load_id, 'range', f, f > 0.05 from ranges
  union all select table_name, column_name, load_id, 'distribution', f, f > 0.30 from ks
  union all select 'billing', 'payment_status', load_id, 'pattern', f, f > 0.20 from patterns
  union all select 'billing', 'payment_status', load_id, 'distribution', f, f > 0.30 from tv)"""

P2 = f"with {_FIGURES} select table_name, column_name, load_id, finding from figures where exceeds"
P2_FIGURES = f"with {_FIGURES} select table_name, column_name, load_id, finding, round(f, 6) as figure from figures"


def _profile_sql() -> str:
    from loomlake.operators.load_profile import PROFILED

    floats = {"bill_amount", "insurance_covered", "copay_amount"}
    parts = []
    for t, columns in PROFILED.items():
        for c in columns:
            x = f"case when isfinite({c}) then {c} end" if c in floats else c
            parts.append(
                f"select '{t}' as table_name, '{c}' as column_name, count(*) as n_rows, count(*) - count({c}) as n_nulls, count(distinct {c}) as n_distinct, "
                f"cast(min({x}) as varchar) as lo, cast(max({x}) as varchar) as hi from {t}"
            )
    return " union all ".join(parts)


ORACLE = {
    "p2_found": P2,
    "p2_load_figures": P2_FIGURES,
    "p2_column_profile": _profile_sql(),
    "p4_rolling_totals": P4,
    "p4_corrected_totals": P4,
    "p4_corrected_trees": P4_TREES,
    "p7_found": P7,
    "p7_report": P7_REPORT,
}
