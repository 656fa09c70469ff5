"""The core's problem operators against plain Python on small tables."""

import math
import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import numpy as np
import pytest

from loomlake.operators import footers, load_profile, orphans, rolling
from loomlake.operators.ordered import quantiles, ranged_runs, with_positions
from loomlake.plans import data_queries as Q


def rows(df):
    return [tuple(r) for r in df.collect()]


# ------------------------------------------------------------ rolling totals


def brute_rolling(visits):
    once = {}
    for v in visits:
        once.setdefault(v["visit_id"], v)
    days, sums = defaultdict(list), defaultdict(list)
    for v in once.values():
        try:
            d = datetime.strptime(v["visit_date"] or "", "%Y-%m-%d").date()
        except ValueError:
            continue
        if v["patient_id"] is None or len(v["visit_date"]) != 10:
            continue
        days[v["patient_id"]].append(d)
        a = v["bill_amount"]
        if a is not None and math.isfinite(a):
            sums[v["patient_id"], d].append(a)
    out = set()
    for p, ds in days.items():
        d = min(ds)
        while d <= max(ds):
            cells = []
            for w in (7, 30):
                got = [a for k in range(w) for a in sums.get((p, d - timedelta(days=k)), [])]
                cells += [round(sum(got), 2) if got else 0.0, round(round(sum(got), 2) / len(got), 6) if got else None]
            out.add((p, d.isoformat(), *cells))
            d += timedelta(days=1)
    return out


def some_visits(n=300, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        d = date(2023, 1, 1) + timedelta(days=rng.randrange(200))
        out.append(
            {
                "visit_id": f"V{i:04d}",
                "patient_id": rng.choice(["A", "B", "C", "", " x", None]),
                "visit_date": rng.choice([d.isoformat()] * 8 + ["2023-02-30", "2023/01/05", "2023-1-5", "", None]),
                "bill_amount": rng.choice([round(rng.uniform(-50, 500), 2)] * 6 + [None, float("nan"), float("inf"), 0.0]),
                "load_id": rng.randrange(1, 6),
            }
        )
    return out + [dict(v, load_id=6) for v in out[:20]]


def test_rolling_matches_brute_force(spark, folder):
    visits = some_visits()
    at = folder(visits=visits)
    got = {(p, d, a, None if b is None else round(b, 6), c, None if e is None else round(e, 6)) for p, d, a, b, c, e in rows(Q.p4_rolling_totals(spark, at))}
    assert got == brute_rolling(visits)


def test_rolling_empty_and_all_bad(spark, folder):
    assert rows(Q.p4_rolling_totals(spark, folder())) == []
    assert rows(Q.p4_rolling_totals(spark, folder(visits=[{"visit_id": "1", "patient_id": "A", "visit_date": "x"}, {"visit_id": None}]))) == []


def test_totals_of_corrected_trees_equal_a_rebuild(spark, folder):
    rng = random.Random(11)
    dates = [str(date(2020, 1, 1) + timedelta(days=rng.randrange(400) * rng.choice((1, 1, 5)))) for _ in range(300)]
    visits = [{"visit_id": f"V{i}", "patient_id": f"P{rng.randrange(9)}", "visit_date": d, "bill_amount": rng.choice((None, 1.25, -3.0, float("nan"), 7.1)), "load_id": rng.randrange(1, 4)} for i, d in enumerate(dates)]
    at = folder(visits=visits)
    want = sorted(rows(Q.p4_rolling_totals(spark, at)), key=str)
    assert sorted(rows(Q.p4_corrected_totals(spark, at)), key=str) == want and len(want) > 3000
    days = Q._visit_days(Q.table(spark, at, "visits"))
    assert sorted(rows(rolling.trailing_from_trees(rolling.segment_trees(days))), key=str) == want
    assert rows(rolling.trailing_from_trees(rolling.segment_trees(days.limit(0)))) == []


def test_rolling_span_of_centuries(spark, folder):
    at = folder(visits=[{"visit_id": str(i), "patient_id": "A", "visit_date": d, "bill_amount": 1.0} for i, d in enumerate(("1600-01-01", "2023-01-01"))])
    assert Q.p4_rolling_totals(spark, at).count() == (date(2023, 1, 1) - date(1600, 1, 1)).days + 1


def test_corrected_trees_equal_trees_built_anew(spark, folder):
    visits = some_visits(seed=2)
    at = folder(visits=visits)
    whole = rolling.segment_trees(Q._visit_days(Q.first_delivery(Q.table(spark, at, "visits"), "visit_id", ["patient_id", "visit_date", "bill_amount"])))
    fresh = {(r["entity"], r["shard"]): (round(r["sums"][-1], 2), r["counts"][-1]) for r in whole.collect()}
    got = {(p, s): (t, n) for p, s, t, n in rows(Q.p4_corrected_trees(spark, at))}
    assert got == {k: (v[0] + 0.0, v[1]) for k, v in fresh.items()}


def test_canonical_nodes_tile_the_range():
    for lo in range(0, 64, 5):
        for hi in range(lo, 64, 7):
            covered = sorted(i for level, k in rolling.canonical_nodes(lo, hi) for i in range(k << level, (k + 1) << level))
            assert covered == list(range(lo, hi + 1))
            assert len(rolling.canonical_nodes(lo, hi)) <= 12


def test_only_ancestors_change():
    leaves = np.random.default_rng(0).random((64, 1))
    before = rolling.flat_tree(rolling.build_levels(leaves))[0]
    leaves[17, 0] += 5
    after = rolling.flat_tree(rolling.build_levels(leaves))[0]
    assert sorted(np.flatnonzero(before != after)) == sorted(rolling.ancestors(17))


# ------------------------------------------------------------ orphan references


def test_orphans(spark, folder):
    at = folder(
        patients=[{"patient_id": "P1"}, {"patient_id": "p2", "load_id": 5}, {"patient_id": None}],
        visits=[
            {"visit_id": "V1", "patient_id": " p1 "},
            {"visit_id": "V2", "patient_id": "P2", "load_id": 2},
            {"visit_id": "V3", "patient_id": "GONE"},
            {"visit_id": "V3", "patient_id": "GONE", "load_id": 4},
            {"visit_id": "V4", "patient_id": None},
            {"visit_id": "V5", "patient_id": ""},
            {"visit_id": None, "patient_id": "P1"},
        ],
        billing=[{"billing_id": "B1", "visit_id": "v1", "patient_id": "P9"}, {"billing_id": "B2", "visit_id": "V9", "patient_id": "P1"}],
        deleted_records=[{"table_name": "patients", "record_key": "gone", "deleted_at": datetime(2023, 1, 5)}, {"table_name": "patients", "record_key": None}],
    )
    assert set(rows(Q.p7_found(spark, at))) == {("visits", "V3", "patient_id"), ("visits", "V5", "patient_id"), ("billing", "B1", "patient_id"), ("billing", "B2", "visit_id")}
    status = {(r["record_key"], r["field_name"]): r["status"] for r in orphans.classified(spark, at).collect() if r["load_id"] != 4}
    assert status["V3", "patient_id"] == "deleted" and status["V5", "patient_id"] == "missing"
    assert status["V2", "patient_id"] == "late" and status["V1", "patient_id"] == "ok"
    report = {(t, f, m, s): n for t, f, m, s, n in rows(Q.p7_report(spark, at))}
    assert report["visits", "patient_id", "2023-01", "deleted"] == 1


def test_orphans_with_a_hot_key_and_empty_tables(spark, folder):
    assert rows(Q.p7_found(spark, folder())) == []
    visits = [{"visit_id": f"V{i}", "patient_id": "WALKIN" if i % 3 else f"P{i}"} for i in range(600)]
    found = set(rows(Q.p7_found(spark, folder(visits=visits, patients=[{"patient_id": "P0"}]))))
    assert found == {("visits", v["visit_id"], "patient_id") for v in visits if v["patient_id"] != "P0"}
    assert "WALKIN" in orphans.hot_keys(spark.createDataFrame([(v["patient_id"],) for v in visits], "rkey string"))


# ------------------------------------------------------------ load profile


CANON = [{"field_name": "payment_status", "canonical_id": f"PAY-{i}", "canonical_value": v} for i, v in enumerate(("Paid", "Pending", "Denied"))]


def load_tables(seed=3):
    rng = random.Random(seed)
    visits, billing = [], []
    for load in range(1, 9):
        for i in range(120):
            a = round(rng.lognormvariate(5, 0.5), 2)
            if load == 2 and rng.random() < 0.5:
                a = None
            if load == 3 and rng.random() < 0.3:
                a = rng.choice([float("nan"), float("-inf"), -5.0, 1e9])
            if load == 4:
                a = None if a is None else a * 4
            visits.append({"visit_id": f"V{load}-{i}", "bill_amount": a, "load_id": load})
            s = rng.choice(["Paid"] * 6 + ["Pending", "Denied"])
            if load == 5 and rng.random() < 0.6:
                s = rng.choice(["paid", "PAID ", "x"])
            if load == 6:
                s = "Denied"
            if load == 7 and rng.random() < 0.4:
                s = None
            billing.append({"billing_id": f"B{load}-{i}", "payment_status": s, "copay_amount": 20.0, "load_id": load})
    return visits, billing


def test_findings_of_planted_loads(spark, folder):
    visits, billing = load_tables()
    at = folder(visits=visits, billing=billing, canonical_values=CANON)
    assert set(rows(Q.p2_found(spark, at))) == {
        ("visits", "bill_amount", 2, "null_rate"), ("visits", "bill_amount", 3, "range"), ("visits", "bill_amount", 4, "distribution"),
        ("billing", "payment_status", 5, "pattern"), ("billing", "payment_status", 6, "distribution"), ("billing", "payment_status", 7, "null_rate"),
    }


def test_distribution_distance_matches_brute_force(spark, folder):
    visits, billing = load_tables(seed=9)
    at = folder(visits=visits, billing=billing, canonical_values=CANON)
    values = [(v["load_id"], v["bill_amount"]) for v in visits if v["bill_amount"] is not None]
    median = float(np.median([a for _, a in values if math.isfinite(a)]))
    good = [(l, a) for l, a in values if math.isfinite(a) and 0 <= a <= 50 * median]
    got = {l: f for t, c, l, k, f, _ in rows(load_profile.load_figures(spark, at)) if c == "bill_amount" and k == "distribution"}
    for load in range(1, 9):
        own, rest = np.sort([a for l, a in good if l == load]), np.sort([a for l, a in good if l != load])
        points = np.unique(np.concatenate([own, rest]))
        gap = np.abs(np.searchsorted(own, points, "right") / len(own) - np.searchsorted(rest, points, "right") / len(rest)).max()
        assert got[load] == pytest.approx(gap, abs=1e-12)


def test_profile_of_empty_and_null_tables(spark, folder):
    assert rows(Q.p2_found(spark, folder())) == []
    at = folder(visits=[{"visit_id": "1"}, {"visit_id": "2"}])
    assert rows(Q.p2_found(spark, at)) == []
    p = {(t, c): r for t, c, *r in rows(Q.p2_column_profile(spark, at))}
    assert p["visits", "bill_amount"][:3] == [2, 2, 0] and p["visits", "visit_id"][:3] == [2, 0, 2]


def test_only_insufficient_chunks_are_read(spark, tmp_path):
    """A table written load by load: footers answer nulls and the ranges of whole numbers and texts, dictionaries the distinct values; floats and chunks without statistics are read."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    for load in (1, 2, 3):
        n = 100 * load
        t = pa.table({
            "load_id": pa.array([load] * n, pa.int32()), "k": pa.array([i if i % 7 else None for i in range(-5, n - 5)], pa.int64()),
            "s": pa.array([f"v{i % 9}" if i % 4 else None for i in range(n)], pa.string()), "x": pa.array([float("nan") if i == 3 else i / 2 for i in range(n)], pa.float64()),
        })
        pq.write_table(t, tmp_path / f"{load}.parquet", row_group_size=50, write_statistics=load != 3 or ["load_id", "s", "x"])
    at = str(tmp_path)
    nulls = {(l, c): (n, z, f) for l, c, n, z, f in rows(footers.load_nulls(spark, at, "load_id", ["k", "s"]))}
    assert all(nulls[l, c][2] == (0 if (l, c) == (3, "k") else 100 * l) for l in (1, 2, 3) for c in ("k", "s")) and nulls[3, "s"][:2] == (300, 75)
    p = {r["column_name"]: r for r in footers.column_profile(spark, at, ["load_id", "k", "s", "x"], distinct=False).collect()}
    assert {c: p[c]["chunks_read"] for c in p} == {"load_id": 0, "k": 6, "s": 0, "x": 12} and p["k"]["chunks"] == 12
    assert (p["k"]["lo"], p["k"]["hi"], p["k"]["n_nulls"]) == ("-5", "293", 14 + 28 + 43) and (p["s"]["lo"], p["s"]["hi"]) == ("v0", "v8") and (p["x"]["lo"], p["x"]["hi"]) == ("0.0", "149.5")
    full = {r["column_name"]: r["n_distinct"] for r in footers.column_profile(spark, at, ["load_id", "k", "s", "x"]).collect()}
    assert full == {"load_id": 3, "k": len({i for i in range(-5, 295) if i % 7}), "s": 9, "x": 300}
    counts = {(l, v): n for l, v, n in rows(footers.coded_counts(spark, at, "load_id", "s"))}
    assert sum(counts.values()) == 600 - 150 and counts[1, "v1"] == sum(1 for i in range(100) if i % 4 and i % 9 == 1)


# ------------------------------------------------------------ ordered runs


def test_quantiles_of_skewed_groups(spark):
    rng = np.random.default_rng(4)
    data = [("hot", float(x)) for x in rng.integers(0, 50, 3000)] + [(g, float(rng.normal())) for g in ("a", "b", None) for _ in range(37)] + [("one", 5.0)]
    runs = spark.createDataFrame(data, "g string, value double").groupBy("g", "value").count().withColumnRenamed("count", "n")
    wanted = {"q0": 0.0, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    got = {r["g"]: r for r in quantiles(with_positions(ranged_runs(runs, ["g"], "value", 7), ["g"], "value", ["n"]), ["g"], "value", "n", wanted).collect()}
    for g in ("hot", "a", "b", None, "one"):
        own = [v for k, v in data if k == g]
        assert got[g]["n"] == len(own)
        for name, q in wanted.items():
            assert got[g][name] == pytest.approx(float(np.quantile(own, q)), abs=1e-9)
