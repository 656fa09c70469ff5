"""Reading typed person names, and comparing their parts."""

from __future__ import annotations

import unicodedata

import regex

from loomlake.llm.edits import osa
from loomlake.llm.memory import remembered

_WORD = regex.compile(r"[\p{L}\p{N}$@'’]+")
_LETTER = regex.compile(r"\p{L}")
_PARENTHESIS = regex.compile(r"\([^)]*\)")
_CREDENTIALS = regex.compile(r",?\s*\b(?:m\.\s?d|ph\.\s?d|d\.\s?o|r\.\s?n|f\.?a\.?c\.?s|md|phd)\b\.?\s*$", regex.IGNORECASE)
_ROLE = regex.compile(r"\s/\s*\w+\s*$|\bfor\s+dr\.?\s+on\s+call\b|\s-\s.*$", regex.IGNORECASE)
_DOUBLE = regex.compile(r"([\p{L}\d]{3,})-([\p{L}\d]{3,})")
_DOTS = regex.compile(r"[._]")

# Titles, degrees and other words that are no part of a name.
TITLES = frozenset(
    """dr doctor prof professor mr mrs ms miss mx sir dame fr sr md do facs facp frcs frcp mbbs phd dds rn np pa attending locum resident
    consultant for on call the""".split()
)
PARTICLES = frozenset(("al", "da", "de", "di", "do", "du", "el", "la", "le", "lo", "st", "te"))
SUFFIXES = frozenset(("jr", "junior", "ii", "iii", "iv"))
# Texts that stand where a name should, and name nobody.
NOBODY = frozenset(("", "na", "none", "null", "nil", "tbd", "tba", "tbc", "unknown", "resident", "see chart", "on call", "oncall", "baby", "staff", "various", "locum", "attending", "test", "x", "xxx", "dr", "doctor", "unassigned", "not given", "pending"))
# Forms of one given name (short forms, pet names, other transliterations).
GIVEN_FORMS = (
    "alexander alex alec xander sandy sasha aleksander alexandre lex", "aleksandr sasha alex aleksander sanya",
    "alexandra alex sandra sasha lexi aleksandra alix sandy",
    "amelie amelia amy milly", "anita ann annie ana nita", "benjamin ben benny benji", "bjorn bjoern", "boris borya",
    "carla carly", "charles charlie chuck chas carl chaz", "christine chris chrissy tina christina kristine christy",
    "christopher chris kit topher kris christoph", "concepcion concha conchita", "daniel dan danny", "deborah deb debbie debra debby", "diego dieguito",
    "dmitri dmitry dima dimitri mitya dmitriy", "dolores lola lolita", "dorothy dot dottie dolly dora", "edward ed eddie ted ned teddy",
    "ekaterina katya yekaterina katia catherine katerina", "yekaterina katya ekaterina katia", "elena lena helen helena yelena",
    "elizabeth liz beth eliza betty lizzie libby bess betsy lisa", "esra ezra", "farid fareed ferid", "fatou fatoumata fatima", "frances fran frannie francie fanny",
    "francis frank fran francie", "francisco paco pancho frank cisco kiko curro", "frederick fred freddie freddy rick fritz", "gabriel gabe gabi",
    "gerald gerry jerry", "giovanni gianni nino vanni", "giuseppe beppe peppe pino peppino", "goran gogo", "greta gretel gretchen margareta", "gregory greg gregg",
    "guadalupe lupe lupita", "gunther guenther gunter guenter", "hana hanna hannah", "henry hank harry hal", "hiro hiroshi", "ignacio nacho iggy", "imran emran",
    "ingrid inge inga", "isabella bella izzy isabel isa", "jacqueline jackie jacky jacquie", "jamal jamaal gamal", "james jim jimmy jamie jem", "jeffrey jeff geoff geoffrey", "jennifer jen jenny jenn jenna",
    "johannes hannes hans johan jan johann", "jonathan jon jonny nathan johnny jonathon john", "jose pepe joseito", "joseph joe joey jo", "josephine jo josie josefine fifi", "joshua josh",
    "judith judy jude jody", "katherine kate kathy katie kat kitty kit catherine kathryn kath", "kenneth ken kenny", "lars lasse", "lawrence larry laurie laurence", "leonard leo len lenny",
    "lucia lucy lucie luz", "marek mark", "margaret maggie meg peggy marge greta margie megan daisy", "maria mary mia marie mariya maryam", "matthew matt matty mathew", "michael mike mick mickey micky mikey", "mikhail misha michail mihail mikhael",
    "nadia nadya nadja", "nathaniel nate nat nathan", "nicholas nick nicky nico nicolas nikolas", "noor nur nour", "olga olya", "omar umar omer", "pamela pam pammy", "patricia pat patty tricia trish patsy", "patrick pat paddy rick",
    "peter pete petey petr pyotr", "philip phil pip phillip", "priya pria", "quentin quin quincy", "rebecca becca becky bex", "renee rene", "richard rick dick rich richie ricky", "robert bob rob bobby robbie bert",
    "ronald ron ronnie ronny", "rosa rose rosie rosita", "samantha sam sammy", "samuel sam sammy", "soren soeren", "stefan stephan steffen stevan", "stephanie steph stephie steffi stefanie", "stephen steve steven stevie stephan steph",
    "susan sue susie suzy suzie sukie susanna", "tariq tarik tareq", "teresa terry tess tessa theresa tere", "theodore ted theo teddy", "thomas tom tommy", "timothy tim timmy", "valerie val", "veronica ronnie vera roni nica", "victoria vicky tori vicki vic",
    "vikram vik vicky", "vincent vince vinny vinnie vin", "walter walt wally wat", "wilhelmina mina wilma billie minnie willa", "william bill will billy liam willy willie", "xenia ksenia ksenya xena", "yusuf yousef yusef yousuf youssef", "zachary zach zack zac zak",
    "zainab zaynab zeinab zeynep", "zoe zoey zoi", "jiro jirou", "kavya kavia", "kofi coffie", "mei may", "uma ooma", "chidi chidiebere", "adaeze ada", "duc duk", "bao baobao",
)
@remembered(200_000)
def plain(word: str) -> str:
    """Letters without marks; digits put for letters are letters again."""
    w = word.replace("ø", "o").replace("Ø", "o").replace("ß", "ss").replace("æ", "ae").replace("ł", "l")
    w = "".join(ch for ch in unicodedata.normalize("NFKD", w).casefold() if not unicodedata.combining(ch))
    if any(ch.isalpha() for ch in w):
        w = w.translate(str.maketrans("01345$@", "oleasas"))
    return w


#: Given names without other forms, and the forms as ``plain`` writes them.
SINGLE = ("wanda", "kavya", "adaeze", "chidi", "uma", "mei", "bao", "duc", "omar", "olga", "jiro", "kofi", "anita", "rosa", "fatou", "imran")
GROUPS = tuple(tuple(dict.fromkeys(plain(w) for w in line.split())) for line in GIVEN_FORMS)
_FORMS: dict[str, set[int]] = {}
for _k, _group in enumerate(GROUPS):
    for _w in _group:
        _FORMS.setdefault(_w, set()).add(_k)
for _k, _w in enumerate(SINGLE, len(GROUPS)):
    _FORMS.setdefault(_w, set()).add(_k)
FULL = frozenset((*(g[0] for g in GROUPS), *SINGLE))


def words(text: str | None) -> list[str]:
    return [plain(w) for w in _WORD.findall(text or "") if _LETTER.search(w)]


def _shorter(word: str) -> list[str]:
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]


#: Full given names by each of their forms with one letter less: what is one edit away shares such a form.
_NEAR: dict[str, set[str]] = {}
for _w in FULL:
    for _s in _shorter(_w):
        _NEAR.setdefault(_s, set()).add(_w)


@remembered(200_000)
def given_like(word: str) -> bool:
    """A known given name or form of one, or one edit from a full one."""
    if word in _FORMS:
        return True
    return 4 <= len(word) <= 30 and any(osa(word, f, 1) <= 1 for s in _shorter(word) for f in _NEAR.get(s, ()))


_NEAR_FORMS: dict[str, set[tuple[str, int]]] = {}
for _k, _group in enumerate(GROUPS):
    for _w in _group:
        if len(_w) >= 4:
            for _s in _shorter(_w):
                _NEAR_FORMS.setdefault(_s, set()).add((_w, _k))


@remembered(200_000)
def given_groups(word: str) -> list[int]:
    """The names of which a given name is a form, or one edit from a form of four letters or more: two names have one in common wherever ``same_given`` goes by forms."""
    found = set(_FORMS.get(word, ()))
    if 3 <= len(word) <= 30:
        found |= {k for s in _shorter(word) for f, k in _NEAR_FORMS.get(s, ()) if osa(word, f, 1) <= 1}
    return sorted(found)


def same_given(a: str, b: str) -> int:
    """2: the same given name (typos, short forms); 1: one is the other's initial; 0: neither."""
    if a == b and len(a) > 1:
        return 2
    if not a or not b:
        return 0
    if len(a) == 1 or len(b) == 1:
        return 1 if a[0] == b[0] else 0
    if a in FULL and b in FULL:
        return 0  # two different correct names, however near, even if one is a form of the other elsewhere
    if _FORMS.get(a, set()) & _FORMS.get(b, set()):
        return 2
    most = 2 if min(len(a), len(b)) >= 6 else 1
    if osa(a, b, most) <= most:
        return 2
    for x, y in ((a, b), (b, a)):  # a misspelt short form
        for k in _FORMS.get(x, ()):
            if any(len(f) >= 4 and len(y) >= 4 and osa(f, y, 1) <= 1 for f in (GROUPS[k] if k < len(GROUPS) else ())):
                return 2
    return 0


def family_distance(a: str, b: str, most: int = 2) -> int:
    """Edits between surnames; of a double name the nearest single part counts.  Two edits make any two letters of any others: they never link parts of two letters."""
    pairs = ((x, y, osa(x, y, most)) for x in a.split("-") for y in b.split("-") if len(x) > 1 and len(y) > 1)
    return min((d for x, y, d in pairs if d < 2 or min(len(x), len(y)) > 2), default=most + 1)


def family_keys(family: str) -> list[str]:
    """The parts of a surname that find it: all of two letters or more, but a particle only where no longer part is there."""
    parts = [w for w in family.split("-") if len(w) > 1]
    long = any(len(w) > 2 for w in parts)
    return [w for w in parts if not (long and w in PARTICLES)]


class Name:
    """A person's name: given names, surname (parts of a double one joined by '-'), initials, suffix."""

    __slots__ = ("family", "given", "suffix")

    def __init__(self, given: str, family: str, suffix: str = "") -> None:
        self.given, self.family, self.suffix = given, family, suffix

    def __repr__(self) -> str:
        return f"Name({self.given!r}, {self.family!r}, {self.suffix!r})"


def _clean(text: str) -> str:
    t = _PARENTHESIS.sub(" ", text)
    t = _CREDENTIALS.sub(" ", t)
    t = _ROLE.sub(" ", t)
    return t


def _core(text: str) -> tuple[list[str], str]:
    found = words(text)
    suffix = next((w for w in found if w in SUFFIXES), "")
    return [w for w in found if w not in TITLES and w not in SUFFIXES and w not in ("md", "facs")], suffix


@remembered(200_000)
def read_doctor(text: str | None) -> Name | None:
    """One typed name, in any order; null where it names nobody."""
    if text is None:
        return None
    if " ".join(words(text)) in NOBODY or "".join(words(text)) in NOBODY:
        return None
    t = _clean(text)
    double = _DOUBLE.findall(t)
    for a, b in double:
        t = t.replace(f"{a}-{b}", f"{a}\0{b}")
    if "," in t:
        left, right = t.split(",", 1)
        fam, s1 = _core(left.replace("\0", "zzqzz"))
        giv, s2 = _core(right.replace("\0", "zzqzz"))
        if not fam and giv:
            fam, giv = giv, []
        given = next((w for w in giv if len(w) > 1), giv[0] if giv else "")
        family = fam[-1] if fam else ""
        return Name(given, family.replace("zzqzz", "-"), s1 or s2) if family else None
    parts, suffix = _core(_DOTS.sub(" ", t).replace("\0", "zzqzz"))
    if not parts:
        return None
    long = [w for w in parts if len(w) > 1]
    if not long:
        return None
    if len(long) == 1:
        initial = next((w for w in parts if len(w) == 1), "")
        return Name(initial, long[0].replace("zzqzz", "-"), suffix)
    first, last = long[0], long[-1]
    if "zzqzz" in first or (given_like(last) and not given_like(first)):
        first, last = last, first
    return Name(first, last.replace("zzqzz", "-"), suffix)


def read_person(first: str | None, last: str | None) -> Name | None:
    """A patient's name from its two fields, which may be swapped, or hold both names."""
    f, l = first or "", last or ""
    if " ".join(words(f)) in NOBODY:
        f = ""
    if " ".join(words(l)) in NOBODY:
        l = ""
    if "," in f and not l.strip():
        return read_doctor(f)
    if "," in f:
        a, b = f.split(",", 1)
        f = b
        l = l or a
    pf, s1 = _core(f)
    pl, s2 = _core(l)
    suffix = s1 or s2
    longf, longl = [w for w in pf if len(w) > 1], [w for w in pl if len(w) > 1]
    if not longl and len(longf) >= 2:
        longl, longf = longf[1:], longf[:1]
    elif not longf and len(longl) >= 2 and not pf and given_like(longl[0]):
        longf, longl = longl[:1], longl[1:]
    elif longf and len(longl) >= 2 and given_like(longl[0]) and same_given(longl[0], longf[0]) == 2:
        longl = longl[1:]
    elif len(longf) >= 2 and not given_like(longf[-1]) and longl and family_distance(longf[-1], longl[-1]) <= 2:
        longf = longf[:-1]
    if longf and longl and given_like(longl[0]) and not given_like(longf[0]):
        longf, longl = longl, longf
    given = longf[0] if longf else (pf[0] if pf else "")
    family = "-".join(longl)
    if not family and not given:
        return None
    return Name(given, family, suffix)
