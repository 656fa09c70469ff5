"""Postal addresses of one place written differently.

Addresses are read into parts (number, direction, street name, street type,
unit, town, postal code) in whatever order they stand.  Towns are learnt from
the data: the spelling that most rows give a postal code.  Equal readings are
counted first; what is left are the different readings, which meet by number,
unit and town.  There candidates come from MinHash bands over q-gram shingles of
the street's name and tokens of name and direction; each candidate pair is
verified by an affine-gap alignment of the whole addresses' tokens, whose
substitution costs include the abbreviation dictionaries and the evidence that
two near names are different streets, and whose gaps are parts left out.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlake.llm.edits import osa
from loomlake.llm.memory import remembered
from loomlake.session import durable

_POSTAL = regex.compile(r"(?<!\d)\d{6}(?!\d)")
_POSTAL_CUT = regex.compile(r"(?<!\d)\d{3}[-\s]\d{3}(?=\s*(?:$|[,;\n]|-))")
_POSTAL_ANYWHERE = regex.compile(r"(?<!\d)\d{3}[-\s]\d{3}(?!\d)")
_NO_DIGIT = regex.compile(r"\D")

LONG = 500  # town words of more characters are compared by three of their pieces
BANDS, ROWS = 56, 2  # of two MinHash values each: of pairs with three shingles in ten in common 99.5 % meet
NAME_EDITS = 2
ALIGNED = 1.0  # a costlier alignment is none
GAP_OPEN, GAP_EXTEND = 0.6, 0.3  # a part left out; two names that are both left out cost more than ALIGNED
OTHER = 2.0  # two different numbers, units, directions or types; two names that are streets of their own
EDIT = 0.15  # of a name or town word
RARE = 0.15  # a misspelling has less than this share of the rows of the commonest name near it
COMMON = 0.34  # at one edit, twice as sure a sign, less than this share
HOUSE_STYLE = 0.15  # share of the rows of one type, with or without a unit, that are written in one way

# Street types, directions, town prefixes and unit words with their abbreviations.
TYPES = {
    "street": ("st", "str"), "road": ("rd",), "avenue": ("ave", "av", "aven", "avn"), "drive": ("dr", "drv"), "lane": ("ln", "la"),
    "boulevard": ("blvd", "boul", "blv"), "terrace": ("ter", "terr"), "court": ("ct", "crt"), "square": ("sq", "sqr"), "place": ("pl", "plc"),
    "parkway": ("pkwy", "pky", "pkway"), "way": ("wy",), "close": ("cl",), "crescent": ("cres", "cr"), "highway": ("hwy",), "circle": ("cir",),
    "alley": ("aly",), "trail": ("trl",), "row": (), "grove": ("grv",), "hill": (), "gardens": ("gdns",), "walk": (),
}
DIRECTIONS = {"n": ("north",), "s": ("south",), "e": ("east",), "w": ("west",)}
PREFIXES = {"north": ("n", "nth"), "south": ("s", "sth"), "east": ("e",), "west": ("w",), "fort": ("ft",), "saint": ("st", "ste"), "mount": ("mt", "mnt"), "port": ("pt",), "new": (), "old": (), "great": ("gt",), "lake": ("lk",)}
UNITS = ("apt", "apartment", "unit", "suite", "ste", "flat", "room", "rm")
_TYPE = {a: t for t, others in TYPES.items() for a in (t, *others)}
_DIRECTION = {a: d for d, others in DIRECTIONS.items() for a in (d, *others)}
_PREFIX = {a: p for p, others in PREFIXES.items() for a in (p, *others)}

_OPEN_NOTE = r"\bc/o\s+\w+|\bring\s+twice\b|\battn?:?\s+\w+"
_NOTE, _OPEN_NOTE = regex.compile(r"\([^)]*\)|" + _OPEN_NOTE), regex.compile(_OPEN_NOTE)
_BLANKS = regex.compile(r"\s{3,}")
_MARKS = regex.compile(r"\p{M}{20,}")
_BOX = regex.compile(r"\bp\.?\s*o\.?\s*box\b|\bpost\s*(?:office\s*)?box\b|\bpmb\b")
_UNIT = regex.compile(r"(?:\b(?:" + "|".join(UNITS) + r")\b\.?\s*#?\s*|#\s*)([0-9]+\s?[a-z]?|[a-z])\b")
_UNIT_FUZZY = regex.compile(r"\b([a-z]{6,11})\.?\s+([0-9]+[a-z]?)\b")
_NUMBER_WORD = regex.compile(r"\b(?:no|nr|num|number)\b\.?\s*(?=\d)|№\s*")
_PART = regex.compile(r"[,;|\n\r\t]+|\s[-–—]\s|\s/\s")
_WORD = regex.compile(r"[0-9]+[a-z]?|[\p{L}][\p{L}'’0-9]*")


def folded(text: str) -> str:
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKD", text).casefold()
    return "".join(ch for ch in t if not unicodedata.combining(ch)).replace("ø", "o").replace("ß", "ss")


def near_key(word: str, table: dict[str, str], least: int = 4) -> str | None:
    """The dictionary's entry for a word, exact or, for longer words, one edit away."""
    if word in table:
        return table[word]
    return _NEARS[id(table)](word) if len(word) >= least else None


def _nears(table: dict[str, str], least: int):
    def near(word: str) -> str | None:
        return next((v for k, v in table.items() if len(k) >= least and osa(word, k, 1) <= 1), None)

    return remembered(50_000)(near)


_NEARS = {id(t): _nears(t, least) for t, least in ((_TYPE, 5), (_DIRECTION, 4), (_PREFIX, 4))}


def _two_blanks(m: regex.Match) -> str:
    """Two stand for any more: the patterns ask for none, one or some, and for breaks between parts."""
    return next((2 * x for x in "\n\t\r" if x in m.group()), "  ")


def read(text: str | None) -> tuple[str, str, str, str, str, str, str] | None:
    """(number, direction, name, type, unit, town words, postal code); null where the text names no place.

    Number, street name and one of town and postal code must be there.  A text
    of any length is read whole, in linear time.
    """
    if not text or not text.strip():
        return None
    t = _BLANKS.sub(_two_blanks, folded(_MARKS.sub("", text)))
    if _BOX.search(t):
        return None
    closed = t.rfind(")") + 1  # beyond it no bracket closes
    t = _NOTE.sub(" ", t[:closed]) + _OPEN_NOTE.sub(" ", t[closed:])
    unit = ""
    m = _UNIT.search(t)
    if m:
        unit = m.group(1).replace(" ", "")
        t = t[: m.start()] + " , " + t[m.end() :]
    else:
        for m in _UNIT_FUZZY.finditer(t):
            if osa(m.group(1), "apartment", 2) <= 2:
                unit = m.group(2)
                t = t[: m.start()] + " , " + t[m.end() :]
                break
    t = _NUMBER_WORD.sub(" ", t)
    postal = ""
    m = _POSTAL.search(t) or _POSTAL_CUT.search(t) or _POSTAL_ANYWHERE.search(t)
    if m:
        postal = _NO_DIGIT.sub("", m.group())
        t = t[: m.start()] + " , " + t[m.end() :]
    parts = [_WORD.findall(p) for p in _PART.split(t)]
    parts = [p for p in parts if p]
    where = None
    for i, p in enumerate(parts):
        for j, w in enumerate(p):
            if w[0].isdigit():
                if w[-1].isalpha() and not unit and where is not None:
                    unit = w
                elif where is None:
                    where = (i, j)
    if where is None:
        return None
    i, j = where
    number = parts[i][j]
    left = [w for w in parts[i][:j] if not w[0].isdigit()]
    right = [w for w in parts[i][j + 1 :] if not w[0].isdigit()]
    others = [[w for w in p if not w[0].isdigit()] for k, p in enumerate(parts) if k != i]
    if not left and not right:  # the number stands alone: the street is in the next part, or in the one before
        after = [p for k, p in enumerate(parts) if k > i and any(not w[0].isdigit() for w in p)]
        before = [p for k, p in enumerate(parts) if k < i and any(not w[0].isdigit() for w in p)]
        if after:
            right = [w for w in after[0] if not w[0].isdigit()]
            others = [[w for w in p if not w[0].isdigit()] for p in before + after[1:]]
        elif before:
            left = [w for w in before[-1] if not w[0].isdigit()]
            others = [[w for w in p if not w[0].isdigit()] for p in before[:-1]]
        else:
            return None
    first = bool(right)
    if left and right:
        typed = lambda ws: any(near_key(w, _TYPE, 5) for w in ws[1:])
        if typed(left) and not typed(right) or _PREFIX.get(right[0]) in ("fort", "saint", "mount", "port") and not typed(right):
            first = False
        elif not typed(right) and not typed(left):
            first = _PREFIX.get(left[0]) in ("fort", "saint", "mount", "port") or len(left) == 1 and len(right) > 1
    words = right if first else left
    direction = name = kind = ""
    rest: list[str] = []
    if first:
        k = 0
        if len(words) > 1 and near_key(words[0], _DIRECTION):
            direction = near_key(words[0], _DIRECTION) or ""
            k = 1
        name = words[k]
        k += 1
        if k < len(words) and (d := _DIRECTION.get(words[k])) and not direction and k + 1 == len(words):
            direction, k = d, k + 1
        if k < len(words) and (x := near_key(words[k], _TYPE, 5)):
            kind, k = x, k + 1
        rest, behind = words[k:], left
    else:
        k = len(words)
        if k > 1 and (d := near_key(words[k - 1], _DIRECTION)):
            direction, k = d, k - 1
        if k > 1 and (x := near_key(words[k - 1], _TYPE, 5)):
            kind, k = x, k - 1
        name, k = words[k - 1], k - 1
        if k > 0 and not direction and (d := near_key(words[k - 1], _DIRECTION)):
            direction, k = d, k - 1
        rest, behind = right, words[:k]
    if rest and not direction and (d := near_key(rest[0], _DIRECTION)) and (len(rest) == 1 or rest[1] in _PREFIX):
        direction, rest = d, rest[1:]
    rest = behind + rest
    town = [w for p in others for w in p] + rest
    if len(town) > 1:
        p = near_key(town[0], _PREFIX)
        town = [p, *town[1:]] if p else town
    if not name or len(name) < 2 or not (town or postal):
        return None
    return number, direction, name, kind, unit, " ".join(town), postal


def grams(word: str) -> set[str]:
    padded = f"^{word}$"
    return {padded[i : i + 2] for i in range(len(padded) - 1)} | {padded[i : i + 3] for i in range(len(padded) - 2)}


_MUL = np.array([[(0x9E3779B1 * (2 * b + 1)) & 0xFFFFFFFF | 1] for b in range(BANDS * ROWS)], np.uint64)
_ADD = np.array([[(0x85EBCA6B * (b + 1)) & 0xFFFFFFFF] for b in range(BANDS * ROWS)], np.uint64)
_MASK = np.uint64(0xFFFFFFFF)


@remembered(50_000)
def _least(shingles: str) -> np.ndarray:
    s = np.array([zlib.crc32(x.encode()) for x in shingles.split("\0")], np.uint64)
    return (((s * _MUL + _ADD) & _MASK) ^ (s >> np.uint64(7))).min(axis=1)


def band_keys(direction: str, name: str) -> list[tuple[int, int, int]]:
    """MinHash of the shingles (the name's q-grams, name and direction as tokens), ROWS values per band."""
    least = np.minimum(_least("\0".join(sorted(grams(name) | {f"={name}"}))), _least(f">{direction}")).reshape(BANDS, ROWS).tolist()
    return [(b, x, y) for b, (x, y) in enumerate(least)]


def token_cost(a: str, b: str) -> float:
    """0 for equal words and abbreviations of each other, OTHER for two numbers, types or directions, else a cost that grows with the edits."""
    if a == b:
        return 0.0
    for table in (_TYPE, _DIRECTION, _PREFIX):
        if a in table and b in table:
            return 0.0 if table[a] == table[b] else OTHER
    if a[0].isdigit() or b[0].isdigit():
        return OTHER
    most = NAME_EDITS if min(len(a), len(b)) > 4 else 1
    return min(OTHER, EDIT * osa(a, b, most)) if osa(a, b, most) <= most else OTHER


def own_streets(a: Reading, b: Reading, edits: int) -> bool:
    """Whether two near names are different streets: both also stand at other houses, and in rows compare with the commonest name near them."""
    least = COMMON if edits == 1 else RARE
    return all(x.elsewhere and x.name_rows >= least * max(x.near_rows, y.name_rows) for x, y in ((a, b), (b, a)))


def aligned_cost(a: list[str], b: list[str], cost=token_cost) -> float:
    """Least cost of a token alignment with affine gaps, per token of the longer address."""
    big = 1e9
    n, m = len(a), len(b)
    match = [[big] * (m + 1) for _ in range(n + 1)]
    gap_a = [[big] * (m + 1) for _ in range(n + 1)]
    gap_b = [[big] * (m + 1) for _ in range(n + 1)]
    match[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                gap_a[i][j] = min(min(match[i - 1][j], gap_b[i - 1][j]) + GAP_OPEN, gap_a[i - 1][j] + GAP_EXTEND)
            if j:
                gap_b[i][j] = min(min(match[i][j - 1], gap_a[i][j - 1]) + GAP_OPEN, gap_b[i][j - 1] + GAP_EXTEND)
            if i and j:
                before = min(match[i - 1][j - 1], gap_a[i - 1][j - 1], gap_b[i - 1][j - 1])
                if before < big:
                    match[i][j] = before + cost(a[i - 1], b[j - 1])
    return min(match[n][m], gap_a[n][m], gap_b[n][m]) / max(n, m, 1)


class Reading:
    """One way in which addresses of a block (number, unit, town) are read, with what is known of its street's name."""

    __slots__ = ("direction", "name", "kind", "alone", "usual", "name_rows", "near_rows", "elsewhere", "form")

    def __init__(self, direction: str, name: str, kind: str, alone: bool = True, usual: bool = False, name_rows: int = 1, near_rows: int = 1, elsewhere: bool = False, form: int = 0) -> None:
        self.direction, self.name, self.kind, self.alone, self.usual = direction, name, kind, alone, usual
        self.name_rows, self.near_rows, self.elsewhere, self.form = name_rows, near_rows, elsewhere, form

    def tokens(self) -> list[str]:
        return [w for w in (self.direction, self.name) if w]


def alignment(a: Reading, b: Reading) -> float:
    """Cost between two readings of one block; number, unit and town are equal there and align at no cost, and types are told apart afterwards."""
    if a.direction and b.direction and a.direction != b.direction:
        return OTHER  # before the names are compared: both would have to be left out

    def cost(x: str, y: str) -> float:
        c = token_cost(x, y)
        if 0 < c < OTHER and {x, y} == {a.name, b.name} and own_streets(a, b, osa(x, y, NAME_EDITS)):
            return OTHER
        return c

    x, y = a.tokens(), b.tokens()
    return aligned_cost(x, y, cost) * max(len(x), len(y))


_STYLE = regex.compile(r"\d+|\p{L}+")


@remembered(100_000)
def _styled(word: str) -> str:
    if word[0].isdigit():
        return "9"
    if (w := word.casefold()) in _TYPE or w in _DIRECTION or w in _PREFIX and w not in PREFIXES or w in UNITS:
        return word
    return "A" if word.isupper() else "a" if word.islower() else "Aa"


def style(text: str) -> str:
    """How an address is written: its signs, its letter case and the spelling of its dictionary words, without its names and numbers."""
    return _STYLE.sub(lambda m: _styled(m.group()), text) if len(text) <= 200 else ""


PARTS = ("number", "direction", "name", "kind", "unit", "town_words", "postal", "style")


def parsed(rows: DataFrame) -> DataFrame:
    """(patient_id, parts) of each row; texts that name no place are left out."""
    names = ["patient_id", *PARTS]
    kinds = ", ".join(f"{n} {'long' if n == 'style' else 'string'}" for n in names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = remembered(50_000)(read)
        for b in batches:
            rows = [(i, *r, zlib.crc32(style(t).encode())) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (r := memory(t)) is not None]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if n == "style" else pa.string()) for n, c in zip(names, cols, strict=True)], names=names)

    return rows.select("patient_id", "address").where("patient_id is not null and address is not null").mapInArrow(work, kinds)


def known_towns(seen: DataFrame) -> DataFrame:
    """(postal, town): the spelling most addresses give a postal code; ties go to the first by letters."""
    best = F.row_number().over(Window.partitionBy("postal").orderBy(F.desc("n"), "town_words"))
    return seen.where("postal <> '' and town_words <> ''").withColumn("_r", best).where("_r = 1").select("postal", F.col("town_words").alias("town"))


def _cuts(c: str) -> F.Column:
    """A text and all its forms with one letter less."""
    return F.array_distinct(F.concat(F.array(F.col(c)), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.length(c))))))


def _pieces(c: str, shift: int) -> F.Column:
    """Hashes of the first and last 150 characters and of 100 in the middle, these also up to ``shift`` further left and right."""
    middle = [F.xxhash64(F.lit("m"), F.substring(c, 200 + i, 100)) for i in range(-shift, shift + 1)]
    return F.array_distinct(F.array(F.xxhash64(F.lit("b"), F.substring(c, 1, 150)), F.xxhash64(F.lit("e"), F.substring(c, -150, 150)), *middle))


def town_keys(seen: DataFrame) -> DataFrame:
    """(key, town) for postal codes (key p...) and for misspelt towns without one (key t...): forms with one letter less meet in a join."""
    towns = known_towns(seen)
    names = towns.select("town").distinct()
    lost = seen.where("postal = ''").select("town_words").distinct().join(names, F.col("town_words") == F.col("town"), "left_anti")
    meet = lost.where(F.length("town_words") <= LONG).withColumn("k", F.explode(_cuts("town_words"))).join(names.where(F.length("town") <= LONG + 1).withColumn("k", F.explode(_cuts("town"))), "k")
    # longer ones: two letters cut, one on either side, leave the beginning, the end or, moved by one, the middle
    long = lost.where(F.length("town_words") > LONG).withColumn("k", F.explode(_pieces("town_words", 0)))
    far = long.join(names.where(F.length("town") >= LONG).withColumn("k", F.explode(_pieces("town", 1))), "k")
    near = meet.select("town_words", "town").unionByName(far.select("town_words", "town")).withColumn("d", F.levenshtein("town_words", "town", 2)).where("d >= 0")
    best = near.groupBy("town_words").agg(F.min(F.struct("d", "town")).alias("b"))
    return towns.select(F.concat(F.lit("p"), "postal").alias("key"), "town").unionByName(best.select(F.concat(F.lit("t"), "town_words").alias("key"), "b.town"))


def with_town(forms: DataFrame) -> DataFrame:
    """Add ``town``: by postal code, else by the town's words, exact or misspelt."""
    seen = durable(forms.groupBy("postal", "town_words").agg(F.count("*").alias("n")))
    key = F.when(F.col("postal") != "", F.concat(F.lit("p"), "postal")).otherwise(F.concat(F.lit("t"), "town_words"))
    own = F.when(F.col("postal") != "", F.col("postal")).otherwise(F.col("town_words"))
    return forms.withColumn("key", key).join(town_keys(seen), "key", "left").withColumn("town", F.coalesce("town", own)).drop("key")


def known_names(nodes: DataFrame) -> DataFrame:
    """(name, name_rows, near_rows, elsewhere): rows of a street name, rows of the commonest name with a form in common that lacks a letter, and whether it stands at several houses."""
    house = F.xxhash64("number", "town")
    names = nodes.groupBy("name").agg(F.sum("rows").alias("name_rows"), (F.min(house) != F.max(house)).alias("elsewhere"))
    keyed = names.select("*", F.explode(F.when(F.length("name") <= LONG, _cuts("name")).otherwise(F.array("name"))).alias("k"))
    top = keyed.withColumn("top", F.max("name_rows").over(Window.partitionBy("k")))
    return top.groupBy("name").agg(F.max("name_rows").alias("name_rows"), F.max("top").alias("near_rows"), F.max("elsewhere").alias("elsewhere"))


def usual_styles(forms: DataFrame) -> DataFrame:
    """(style, usual) of addresses without a direction: the ways in which a good part of the addresses of one type is written."""
    seen = forms.where("direction = ''").groupBy("kind", (F.col("unit") != "").alias("flat"), "style").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("kind", "flat"))
    return seen.where("kind <> ''").withColumn("whole", whole).where(F.col("n") >= HOUSE_STYLE * F.col("whole")).select("style", F.lit(True).alias("usual")).distinct()


class Sets:
    """Disjoint sets by their least members' roots."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def candidates(block: list[Reading]) -> set[tuple[int, int]]:
    """Pairs of readings that share a band."""
    buckets: dict[tuple[int, int, int], list[int]] = {}
    for i, r in enumerate(block):
        for k in band_keys(r.direction, r.name):
            buckets.setdefault(k, []).append(i)
    return {(x, y) for at in buckets.values() if len(at) > 1 for n, x in enumerate(at) for y in at[n + 1 :]}


def told_apart(block: list[Reading]) -> list[tuple[int, int, str]]:
    """(form, street, type) for the readings of one block; the street is numbered by its first reading.

    Readings with one direction, or none, are one street where they align.  One
    that leaves out the direction, is of a single patient and is not written in the
    usual style belongs to the one street with a direction that it aligns with; else
    it is a street of its own.  One that leaves out the type belongs to the one type
    of its street; where there are several, it stays alone.
    """
    if len(block) == 1:
        return [(block[0].form, 0, block[0].kind)]
    block = sorted(block, key=lambda r: (r.name, r.direction, r.kind))
    each: dict[tuple[str, str], list[Reading]] = {}
    for r in block:
        each.setdefault((r.direction, r.name), []).append(r)
    heads = [rs[0] for rs in each.values()]
    sets = Sets(len(heads))
    left_out: dict[int, set[int]] = {}
    for i, j in candidates(heads) if len(heads) > 1 else ():
        if alignment(heads[i], heads[j]) <= ALIGNED:
            if heads[i].direction == heads[j].direction:
                sets.join(i, j)
            else:
                bare, full = (i, j) if not heads[i].direction else (j, i)
                left_out.setdefault(bare, set()).add(full)
    members: dict[int, list[int]] = {}
    for i in range(len(heads)):
        members.setdefault(sets.root(i), []).append(i)
    groups = list(each.values())
    street = {i: sets.root(i) for i in range(len(heads))}
    for root, inside in members.items():
        if heads[root].direction:
            continue
        of = [r for i in inside for r in groups[i]]
        full = {sets.root(j) for i in inside for j in left_out.get(i, ())}
        if len(full) == 1 and len(of) == 1 and of[0].alone and not of[0].usual:
            for i in inside:
                street[i] = next(iter(full))
    kinds: dict[int, set[str]] = {}
    for i, rs in enumerate(groups):
        kinds.setdefault(street[i], set()).update(r.kind for r in rs if r.kind)
    out = []
    for i, rs in enumerate(groups):
        known = kinds[street[i]]
        out += [(r.form, street[i], r.kind or ("" if not known else next(iter(known)) if len(known) == 1 else "?")) for r in rs]
    return out


_NODE = ("block", "direction", "name", "kind", "alone", "usual", "name_rows", "near_rows", "elsewhere", "form")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(form, block, street, type), block by block; the rows come sorted by block."""
    now, block, out = None, [], []

    def done() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["form", "block", "street", "kind"])

    for b in batches:
        for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in _NODE), strict=True):
            if row[0] != now:
                out += [(f, now, s, k) for f, s, k in told_apart(block)]
                now, block = row[0], []
            block.append(Reading(*row[1:]))
        yield done()
        out = []
    out = [(f, now, s, k) for f, s, k in told_apart(block)]
    yield done()


def places(patients: DataFrame) -> DataFrame:
    """(patient_id, place): records whose address names a place, with the class of the place.

    Addresses that are null, blank, a post box, or without number, street, or
    town and postal code, are in no class.  What is sent to one task together are
    the different readings of the streets of one house number, unit and town,
    never the rows.
    """
    forms = durable(parsed(patients.select("patient_id", "address")))
    told = durable(with_town(forms).withColumn("block", F.xxhash64("number", "unit", "town")).withColumn("form", F.xxhash64("block", "direction", "name", "kind")))
    nodes = told.groupBy("form", "block", "number", "town", "direction", "name", "kind").agg(
        F.count("*").alias("rows"), F.min("style").alias("style"), (F.min(F.xxhash64("patient_id")) == F.max(F.xxhash64("patient_id"))).alias("alone")
    )
    nodes = durable(nodes.join(usual_styles(told), "style", "left").withColumn("usual", F.coalesce("usual", F.lit(False))))
    known = nodes.join(known_names(nodes), "name").select(*_NODE)
    at = known.repartition("block").sortWithinPartitions("block").mapInArrow(_places, "form long, block long, street long, kind string")
    of_form = at.select("form", F.xxhash64("block", "street", "kind").alias("place"))
    return told.select("patient_id", "form").join(of_form, "form").select("patient_id", "place").distinct()


def same_place_pairs(patients: DataFrame) -> DataFrame:
    """(patient_id_a, patient_id_b) for every two patient_ids with an address of one place."""
    p = durable(places(patients))
    a = p.select(F.col("patient_id").alias("patient_id_a"), "place")
    b = p.select(F.col("patient_id").alias("patient_id_b"), "place")
    return a.join(b, "place").where("patient_id_a < patient_id_b").select("patient_id_a", "patient_id_b").distinct()
