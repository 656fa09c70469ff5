"""Variant spellings of one doctor, and records of one patient.

Both link records whose surnames lie within a radius of each other, by
``metric_join``: doctors inside their clinic, patients inside each piece of
evidence they share (date of birth, phone, place), there also where the fields
of one are swapped.  Every linked pair is then
judged; groups are the connected components of the accepted pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.llm.addresses import places
from loomlake.llm.edits import osa
from loomlake.llm.graph import components
from loomlake.llm.metric_join import radius_join
from loomlake.llm.names import Name, family_distance, family_keys, given_groups, read_doctor, read_person, same_given
from loomlake.session import durable

_YEAR_FIRST = regex.compile(r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})")
_YEAR_LAST = regex.compile(r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})")
_NO_DIGIT = regex.compile(r"\D")

DOCTOR_RADIUS = 4  # two edits on either side
PATIENT_RADIUS = 4
SHORT = 2  # a surname of so many letters is found by the given name too; that of a doctor is never misspelt

# ---------------------------------------------------------------- doctors

_READ = "id long, clinic_id string, text string, given string, family string, suffix string, keys array<string>"


def _doctors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i, c, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            n = read_doctor(t)
            if n is not None and n.family:
                out.append((i, c, t, n.given, n.family, n.suffix, family_keys(n.family)))
        cols = list(zip(*out, strict=True)) if out else [[] for _ in range(7)]
        kinds = [pa.int64()] + [pa.string()] * 5 + [pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["id", "clinic_id", "text", "given", "family", "suffix", "keys"])


def _judged_doctors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that may be one doctor: (a, b, d, link); link is full (both given names), part (one has only an initial or none) or loose (both)."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            d = family_distance(r["a_family"], r["b_family"], 4)
            ga, gb = r["a_given"] or "", r["b_given"] or ""
            fa, fb = len(ga) > 1, len(gb) > 1
            if r["a_suffix"] != r["b_suffix"] and r["a_suffix"] and r["b_suffix"]:
                continue
            if d and min(len(r["a_family"]), len(r["b_family"])) <= SHORT:
                continue
            if fa and fb:
                ok = same_given(ga, gb) == 2 and d <= (3 if ga == gb else 2)
                kind = "full"
            elif fa or fb:
                ok = d <= 2 and (not ga or not gb or same_given(ga, gb) >= 1)
                kind = "part"
            else:
                ok = d <= 2 and (not ga or not gb or ga[0] == gb[0])
                kind = "loose"
            if ok:
                out.append((r["a"], r["b"], d, kind, fa))
        cols = list(zip(*out, strict=True)) if out else [[] for _ in range(5)]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["a", "b", "d", "link", "a_full"])


def doctor_groups(visits: DataFrame) -> DataFrame:
    """(clinic_id, text, grp): spellings that name a doctor, with the doctor's group in that clinic.

    Null clinics, null names and texts that name nobody are in no group.  A
    spelling with only an initial or a surname joins the one nearest doctor; where
    two doctors are equally near, it stays alone.
    """
    texts = (
        visits.where(F.col("clinic_id").isNotNull() & F.col("doctor_name").isNotNull())
        .select("clinic_id", F.col("doctor_name").alias("text"))
        .distinct()
        .select(F.xxhash64("clinic_id", "text").alias("id"), "clinic_id", "text")
    )
    known = durable(texts.mapInArrow(_doctors, _READ))
    keyed = known.select(F.col("clinic_id").alias("block"), F.explode("keys").alias("name"), "id")
    near = radius_join(keyed, DOCTOR_RADIUS)
    side = lambda s: known.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("given", "family", "suffix")])
    links = durable(near.join(side("a"), "a").join(side("b"), "b").mapInArrow(_judged_doctors, "a long, b long, d int, link string, a_full boolean"))
    full = components(links.where("link = 'full'").select("a", "b"))
    entity = known.where(F.length("given") > 1).select("id").join(full.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("entity"))
    part = links.where("link = 'part'").select(F.when(F.col("a_full"), F.col("a")).otherwise(F.col("b")).alias("id"), F.when(F.col("a_full"), F.col("b")).otherwise(F.col("a")).alias("short"), "d")
    choice = part.join(entity, "id").groupBy("short", "entity").agg(F.min("d").alias("d"))
    best = choice.groupBy("short").agg(F.min("d").alias("low"))
    only = choice.join(best, "short").where("d = low").groupBy("short").agg(F.min("entity").alias("entity"), F.count("*").alias("n")).where("n = 1")
    attached = only.select(F.col("short").alias("id"), "entity")
    # short spellings near no full one, among themselves
    touched = choice.select(F.col("short").alias("id")).distinct()
    alone = known.where(F.length("given") <= 1).select("id").join(touched, "id", "left_anti")
    loose = links.where("link = 'loose'").join(alone.select(F.col("id").alias("a")), "a", "left_semi").join(alone.select(F.col("id").alias("b")), "b", "left_semi")
    rest = components(loose.select("a", "b")).select(F.col("node").alias("id"), F.col("component").alias("entity"))
    groups = entity.unionByName(attached).unionByName(rest)
    return known.select("id", "clinic_id", "text").join(groups, "id").select("clinic_id", "text", F.col("entity").alias("grp"))


# ---------------------------------------------------------------- patients

# Dates that stand for an unknown date of birth, and are nobody's.
NO_DATES = frozenset(("19000101", "99991231", "00010101", "11111111", "18991231"))


def birth(text: str | None) -> str | None:
    """yyyymmdd of a date of birth; null where it is none."""
    if not text:
        return None
    t = text.strip()
    m = _YEAR_FIRST.fullmatch(t)
    if m:
        y, mo, d = m.groups()
    else:
        m = _YEAR_LAST.fullmatch(t)
        if not m:
            return None
        mo, d, y = m.groups()
        if int(mo) > 12:
            mo, d = d, mo
    key = f"{int(y):04d}{int(mo):02d}{int(d):02d}"
    if not (1890 <= int(y) <= 2100 and 1 <= int(mo) <= 12 and 1 <= int(d) <= 31) or key in NO_DATES:
        return None
    return key


def digits(text: str | None) -> str | None:
    """Digits of a phone number; null for placeholders of one repeated digit and for short ones."""
    d = _NO_DIGIT.sub("", text or "")
    return d if len(d) >= 7 and len(set(d)) > 2 and d not in ("1234567890", "0123456789") else None


def compared(a: dict, b: dict) -> bool:
    """Whether two records, with their names at hand, are one person."""
    na, nb = a["name"], b["name"]
    if na.suffix and nb.suffix and na.suffix != nb.suffix:
        return False
    fd = family_distance(na.family, nb.family, 4) if na.family and nb.family else None
    given = same_given(na.given, nb.given) if na.given and nb.given else None
    if na.family and nb.family and na.given and nb.given and (fd > 2 or given == 0):  # fields swapped on one side
        if osa(na.family, nb.given, 2) <= 2 and osa(na.given, nb.family, 2) <= 2:
            fd, given = 0, 2
    da, db = a["dob"], b["dob"]
    if da is None or db is None:
        dob = "missing"
    elif da == db:
        dob = "same"
    elif da[:4] == db[:4] and da[4:6] == db[6:] and da[6:] == db[4:6]:
        dob = "near"
    else:
        wrong = sum(x != y for x, y in zip(da, db, strict=True))
        dob = "near" if wrong == 1 or osa(da, db, 1) <= 1 else "off" if da[:4] == db[:4] or wrong <= 2 else "other"
    phone = None if a["phone"] is None or b["phone"] is None else a["phone"] == b["phone"] or osa(a["phone"], b["phone"], 1) <= 1
    place = None if a["place"] is None or b["place"] is None else a["place"] == b["place"]
    blood = None if not a["blood"] or not b["blood"] else a["blood"] == b["blood"]
    gender = None if a["gender"] is None or b["gender"] is None else a["gender"] == b["gender"]
    if blood is False and not (dob == "same" and phone and place and given == 2):
        return False
    contact = (phone is True) + (place is True)
    if fd is None or given is None:  # a part of a name is missing
        known = fd if fd is not None else 0
        return dob == "same" and blood is True and known <= 2 and given != 0 and contact >= 1 and (phone is True or gender is not False)
    if fd > 4 or given == 0:
        return False
    if fd > 2:
        return dob == "same" and blood is True and contact >= 1 and given == 2
    if given == 1:
        if dob == "same":
            return contact >= 1 or blood is True or gender is True
        return dob in ("near", "missing") and phone is True and (blood is True or place is True)
    if dob == "same":
        return gender is not False or contact >= 1 or blood is True
    if dob == "near":
        return contact >= 1 and (blood is True or phone is True)
    if dob == "missing":
        return phone is True or (place is True and phone is None and blood is True and gender is not False)
    if dob == "off":
        return phone is True and (blood is True or place is True) and gender is not False
    return contact == 2 and blood is True and gender is not False


#: What a record is found by: its surname; its given name, in a field of its own or in the other's; its given name alone, where it has no surname to be found by.
FAMILY, GIVEN, ALONE = "f", "g", "a"
ROLES = ((FAMILY, FAMILY), (FAMILY, GIVEN), (ALONE, GIVEN))


def may_be_one(x: str, y: str) -> Column:
    """Whether two records' further names allow what ``compared`` accepts: given names alike, or both fields swapped."""
    c = lambda p, n: F.col(f"{p}_{n}")
    gx, gy = c(x, "other"), c(y, "other")
    edits = F.when(F.least(F.length(gx), F.length(gy)) >= 6, 4).otherwise(2)  # two swapped letters are two edits here
    alike = (gx == "") | (gy == "") | ((F.least(F.length(gx), F.length(gy)) == 1) & (F.substring(gx, 1, 1) == F.substring(gy, 1, 1))) | F.arrays_overlap(c(x, "forms"), c(y, "forms")) | (F.levenshtein(gx, gy) <= edits)
    role = lambda a, b: (c(x, "role") == a) & (c(y, "role") == b)
    return role(FAMILY, FAMILY) & alike | role(FAMILY, GIVEN) & (gx != "") & (gy != "") & (F.levenshtein(gx, gy) <= 4) | role(ALONE, GIVEN)


_FIELDS = ("first_name", "last_name", "dob", "gender", "blood_type", "phone")
_PARSED = ("given", "family", "suffix", "born", "digits", "sex", "blood")
_PEOPLE = "patient_id string, place long, " + ", ".join(f"{c} string" for c in _PARSED) + ", blocks array<string>, keys array<struct<role: string, name: string, other: string>>, forms array<int>"
_KEY = pa.struct([("role", pa.string()), ("name", pa.string()), ("other", pa.string())])


def _people(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record read once: its name, its evidence, the blocks it belongs to and the names it is to be found by."""
    kinds = [pa.string(), pa.int64(), *[pa.string()] * len(_PARSED), pa.list_(pa.string()), pa.list_(_KEY), pa.list_(pa.int32())]
    names = ["patient_id", "place", *_PARSED, "blocks", "keys", "forms"]
    for b in batches:
        rows = []
        cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("patient_id", "place", *_FIELDS)]
        for i, place, first, last, dob, gender, blood, phone in zip(*cols, strict=True):
            n = read_person(first, last)
            if n is None:
                continue
            born, tel = birth(dob), digits(phone)
            families = family_keys(n.family)
            keys = [{"role": FAMILY, "name": w, "other": n.given} for w in families]
            if n.given:
                keys += [{"role": GIVEN, "name": n.given, "other": w} for w in families or [""]]
                if all(len(w) <= SHORT for w in families):
                    keys.append({"role": ALONE, "name": n.given, "other": ""})
            blocks = [k + v for k, v in (("d", born), ("p", tel), ("a", None if place is None else str(place))) if v]
            sex = (gender or "").strip().lower()[:1]
            rows.append((i, place, n.given, n.family, n.suffix, born, tel, sex if sex in ("m", "f") else None, (blood or "").strip().upper() or None, blocks, keys, given_groups(n.given) or None))
        out = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(out, kinds, strict=True)], names=names)


def _judged_patients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def side(b: pa.RecordBatch, s: str) -> list[dict]:
        cols = [b.column(b.schema.get_field_index(f"{s}_{c}")).to_pylist() for c in (*_PARSED, "place")]
        return [
            {"name": Name(g, f, x), "dob": d, "phone": t, "gender": m, "blood": bl, "place": pl} for g, f, x, d, t, m, bl, pl in zip(*cols, strict=True)
        ]

    for b in batches:
        mask = pa.array([compared(x, y) for x, y in zip(side(b, "a"), side(b, "b"), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)).filter(mask) for c in ("a", "b")], names=["a", "b"])


def one_per_patient(patients: DataFrame) -> DataFrame:
    """Records by patient_id, with the place of the address; repeats of a record have the same values."""
    first = patients.where(F.col("patient_id").isNotNull()).groupBy("patient_id").agg(F.min(F.struct(*_FIELDS)).alias("r")).select("patient_id", "r.*")
    at = places(patients).groupBy("patient_id").agg(F.min("place").alias("place"))
    return first.join(at, "patient_id", "left")


def patient_groups(patients: DataFrame) -> DataFrame:
    """(patient_id, grp): records that share a person with another record."""
    people = durable(one_per_patient(patients).select("patient_id", "place", *_FIELDS).mapInArrow(_people, _PEOPLE))
    blocks = people.select(F.col("patient_id").alias("id"), F.explode("blocks").alias("block"), "keys", "forms")
    records = blocks.select("block", F.explode("keys").alias("k"), "id", "forms").select("block", "k.name", "id", "k.role", "k.other", "forms")
    near = radius_join(records, PATIENT_RADIUS, ROLES, ("other", "forms"), may_be_one)
    side = lambda s: people.select(F.col("patient_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in (*_PARSED, "place")])
    links = near.join(side("a"), "a").join(side("b"), "b").mapInArrow(_judged_patients, "a string, b string")
    return components(links).select(F.col("node").alias("patient_id"), F.col("component").alias("grp"))


def pairs_of(groups: DataFrame, key: str, by: list[str]) -> DataFrame:
    """(by[:-1], key_a, key_b) for every two members of a group, smaller key first in UTF-8 byte order."""
    a = groups.select(*by, F.col(key).alias("key_a"))
    b = groups.select(*by, F.col(key).alias("key_b"))
    return a.join(b, by).where("key_a < key_b").drop(by[-1]).distinct()


def name_pairs(visits: DataFrame, patients: DataFrame) -> DataFrame:
    """(kind, clinic_id, key_a, key_b): spellings of one doctor in a clinic, and patient records of one person."""
    d = pairs_of(doctor_groups(visits), "text", ["clinic_id", "grp"]).select(F.lit("doctor").alias("kind"), "clinic_id", "key_a", "key_b")
    p = pairs_of(patient_groups(patients), "patient_id", ["grp"]).select(F.lit("patient").alias("kind"), F.lit("").alias("clinic_id"), "key_a", "key_b")
    return d.unionByName(p)
