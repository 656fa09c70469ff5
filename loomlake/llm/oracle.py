"""SQL for those of the llm queries that SQL can express."""

from __future__ import annotations

_AMOUNTS = """first_visits as (
  select * exclude (rn) from (select *, row_number() over (partition by visit_id order by load_id, loaded_at) as rn from visits) where rn = 1),
amounts as (select load_id, department, bill_amount as v from first_visits where bill_amount is not null and isfinite(bill_amount))"""

_QUANTILES = ", ".join(f"round(quantile_cont(v, {q}), 4) as {n}" for n, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)))

ORACLE = {
    "p5_percentiles": f"with {_AMOUNTS} select department, count(*) as n_amounts, {_QUANTILES}, cast(0.0 as double) as max_error from amounts group by department",
    "p5_load_percentiles": f"with {_AMOUNTS} select load_id, department, count(*) as n_amounts, {_QUANTILES} from amounts group by load_id, department",
    "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
