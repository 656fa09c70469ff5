"""Free-typed values to entries of a reference list.

A multi-pattern automaton over the list's names and known aliases finds mentions
inside a value; the longest non-overlapping mention wins.  Values without one go
to similarity: over the whole spelling (typos, lost or misplaced spaces), over
token sets (other orders, abbreviated words), as a cut-off beginning, and as
initials.  Where two entries are equally near, or none is near, the value is
unmatched.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.edits import osa
from loomlake.llm.memory import remembered

_TOKEN = regex.compile(r"[\p{L}\p{N}$@]+")
_CUT_OFF = regex.compile(r"(?:\.|…)\s*$")

NONE = "NONE"
MOST_PATTERNS = 1_000_000  # the automaton is a broadcast: a longer reference list is refused
MOST_REMEMBERED = 200_000
NEAR_SHARE, NEAR_WORD, NEAR_MOVED = 0.22, 0.45, 0.15  # edits per character: of the entry, of any of its words, and of the entry where spaces moved

# Other names of entries, by field. Left: the entry. Right: names for the same thing.
ALIASES: dict[str, dict[str, tuple[str, ...]]] = {
    "department": {
        "Nephrology": ("kidney clinic", "renal medicine", "renal", "renal unit", "kidney unit"),
        "Oncology": ("cancer care", "cancer clinic", "medical oncology", "cancer centre", "cancer center"),
        "Urology": ("urologic surgery", "bladder clinic", "urinary clinic", "prostate clinic"),
        "Hematology": ("haematology", "blood disorders", "blood clinic", "blood diseases"),
        "Endocrinology": ("diabetes and hormone clinic", "hormone clinic", "diabetes clinic", "diabetes and endocrine"),
        "Rheumatology": ("joint clinic", "arthritis clinic", "joints"),
        "Ophthalmology": ("eye clinic", "eyes", "eye care", "eye department"),
        "Pediatrics": ("paediatrics", "childrens clinic", "children's clinic", "peds", "child health", "childrens ward"),
        "Psychiatry": ("mental health", "psych", "behavioral health", "psychiatric unit"),
        "Radiology": ("imaging", "x-ray", "xray", "x ray", "diagnostic imaging", "medical imaging"),
        "General Surgery": ("gen surg", "surgery general", "surgical clinic"),
        "Emergency Medicine": ("er", "a&e", "a and e", "emergency room", "accident and emergency", "emergency department", "ed", "casualty", "emergency"),
        "Obstetrics and Gynecology": ("ob/gyn", "obgyn", "ob gyn", "obg", "obs and gynae", "obs & gynae", "obstetrics and gynaecology", "womens health", "women's health", "maternity", "womens clinic"),
        "Ear Nose and Throat": ("ent", "otolaryngology", "otorhinolaryngology"),
        "Infectious Diseases": ("id clinic", "infection clinic", "infectious disease"),
        "Physical Medicine and Rehabilitation": ("pm&r", "pm and r", "pmr", "rehab", "rehabilitation", "physiatry", "rehabilitation medicine"),
        "Geriatrics": ("elderly care", "senior care", "care of the elderly", "geriatric medicine"),
        "Palliative Care": ("hospice care", "hospice", "comfort care", "end of life care", "palliative medicine"),
        "Vascular Surgery": ("vasc surg", "vascular", "vein clinic", "blood vessel surgery"),
        "Neonatal Care": ("nicu", "newborn unit", "neonatal unit", "neonatology", "newborn care", "special care baby unit"),
        "Plastic Surgery": ("plastics", "reconstructive surgery", "plastic and reconstructive surgery", "cosmetic surgery"),
        "Allergy and Immunology": ("allergy clinic", "allergy", "immunology", "allergies"),
    },
    "diagnosis": {
        "Chronic kidney disease": ("ckd", "chronic renal disease", "chronic renal failure", "chronic kidney failure"),
        "Nephrotic syndrome": ("nephrosis",),
        "Kidney stones": ("nephrolithiasis", "renal calculi", "renal stones", "urolithiasis", "renal calculus"),
        "Acute renal failure": ("arf", "aki", "acute kidney injury", "acute kidney failure"),
        "Polycystic kidneys": ("pkd", "adpkd", "polycystic kidney disease"),
        "Colorectal carcinoma": ("crc", "colorectal ca", "colorectal cancer", "bowel cancer", "colon cancer"),
        "Breast carcinoma": ("breast ca", "breast cancer"),
        "Malignant lymphoma": ("lymphoma", "lymph node cancer", "lymphatic cancer"),
        "Lung carcinoma": ("lung ca", "lung cancer", "bronchial carcinoma"),
        "Skin melanoma": ("melanoma", "malignant melanoma"),
        "Urinary tract infection": ("uti", "bladder infection", "urine infection", "water infection", "urinary infection"),
        "Benign prostatic hyperplasia": ("bph", "enlarged prostate", "prostate enlargement"),
        "Overactive bladder": ("oab", "detrusor overactivity"),
        "Urinary retention": ("unable to void", "cannot pass urine"),
        "Ureteral stricture": ("narrowed ureter", "ureteric stricture"),
        "Iron deficiency anemia": ("ida", "low iron", "iron deficiency anaemia"),
        "Sickle cell disease": ("scd", "sickle cell anemia", "sickle cell anaemia", "sickle cell"),
        "Hemophilia A": ("factor viii deficiency", "factor 8 deficiency", "haemophilia a", "classic hemophilia"),
        "Thrombocytopenia": ("low platelets", "low platelet count"),
        "Deep vein thrombosis": ("dvt", "leg clot", "blood clot in leg", "deep venous thrombosis"),
        "Type 2 diabetes mellitus": ("t2dm", "dm2", "dm 2", "type 2 dm", "type ii diabetes", "adult onset diabetes", "niddm", "type 2 diabetes"),
        "Type 1 diabetes mellitus": ("t1dm", "dm1", "dm 1", "type 1 dm", "type i diabetes", "juvenile diabetes", "juvenile onset diabetes", "iddm", "type 1 diabetes"),
        "Hypothyroidism": ("underactive thyroid", "low thyroid"),
        "Hyperthyroidism": ("overactive thyroid", "high thyroid", "thyrotoxicosis"),
        "Adrenal insufficiency": ("addison disease", "addisons disease", "addison's disease"),
        "Rheumatoid polyarthritis": ("ra", "rheumatoid arthritis"),
        "Systemic lupus erythematosus": ("sle", "lupus"),
        "Gout": ("gouty arthritis", "podagra", "uric acid arthritis"),
        "Ankylosing spondylitis": ("as", "bechterew disease", "bechterews disease", "bekhterev disease"),
        "Giant cell arteritis": ("gca", "temporal arteritis"),
        "Cataract": ("cloudy lens", "lens opacity", "clouded lens"),
        "Open angle glaucoma": ("oag", "poag", "glaucoma"),
        "Macular degeneration": ("amd", "armd", "age related macular degeneration"),
        "Conjunctivitis": ("pink eye", "pinkeye"),
        "Retinal detachment": ("detached retina",),
        "Acute otitis media": ("aom", "ear infection", "middle ear infection", "otitis media"),
        "Croup": ("laryngotracheitis", "laryngotracheobronchitis"),
        "Hand foot and mouth disease": ("hfmd", "hand foot mouth"),
        "Febrile convulsion": ("febrile seizure", "fever seizure", "fever fit", "fever convulsion"),
        "Chickenpox": ("varicella", "chicken pox"),
        "Major depressive disorder": ("mdd", "depression", "clinical depression", "major depression"),
        "Generalized anxiety disorder": ("gad", "anxiety", "generalised anxiety disorder", "anxiety disorder"),
        "Bipolar disorder": ("manic depression", "manic depressive illness", "bipolar"),
        "Panic disorder": ("panic attacks",),
        "Insomnia disorder": ("insomnia", "sleeplessness", "cannot sleep", "chronic insomnia"),
        "Incidental pulmonary nodule": ("lung nodule", "ipn", "spot on lung", "pulmonary nodule"),
        "Suspected stress injury of bone": ("stress fracture", "possible stress fracture", "suspected stress fracture"),
        "Abnormal mammogram": ("abnormal breast imaging", "mammogram abnormal"),
        "Soft tissue mass": ("soft tissue lump", "lump"),
        "Pleural effusion": ("fluid on lung", "fluid around lung", "water on the lung"),
        "Acute appendicitis": ("appendicitis", "inflamed appendix"),
        "Inguinal hernia": ("groin hernia",),
        "Gallbladder stones": ("gallstones", "cholelithiasis", "gall stones"),
        "Perianal abscess": ("anal abscess", "perirectal abscess"),
        "Umbilical hernia": ("belly button hernia", "navel hernia"),
        "Laceration of hand": ("hand laceration", "cut hand", "cut on hand", "hand cut"),
        "Closed head injury": ("chi", "head injury", "concussion", "head trauma"),
        "Ankle sprain": ("sprained ankle", "twisted ankle", "rolled ankle"),
        "Heat exhaustion": ("heat prostration", "heat stress"),
        "Carbon monoxide poisoning": ("co poisoning", "carbon monoxide intoxication"),
        "Gestational diabetes": ("gdm", "pregnancy diabetes", "diabetes in pregnancy", "diabetes of pregnancy"),
        "Preeclampsia": ("pre-eclampsia", "pre eclampsia", "pre-eclamptic toxemia", "toxemia of pregnancy", "pet"),
        "Uterine fibroids": ("leiomyoma", "fibroids", "uterine leiomyoma", "uterine myoma", "myoma"),
        "Endometriosis": ("endo",),
        "Hyperemesis gravidarum": ("severe morning sickness", "hyperemesis", "hg"),
        "Chronic sinusitis": ("crs", "chronic rhinosinusitis", "chronic sinus infection", "sinus infection chronic"),
        "Tonsillitis": ("inflamed tonsils", "infected tonsils"),
        "Deviated nasal septum": ("dns", "deviated septum", "crooked septum"),
        "Sensorineural hearing loss": ("snhl", "nerve deafness", "nerve hearing loss"),
        "Vocal cord nodules": ("singers nodules", "singer's nodules", "vocal nodules", "singer nodules"),
        "Influenza": ("flu", "grippe", "the flu"),
        "Cellulitis": ("skin infection", "bacterial skin infection"),
        "Lyme disease": ("borreliosis", "lyme borreliosis", "lyme"),
        "Pulmonary tuberculosis": ("tb", "ptb", "tuberculosis", "lung tb", "consumption"),
        "Malaria": ("plasmodium infection", "paludism"),
        "Frozen shoulder": ("adhesive capsulitis",),
        "Spinal cord injury": ("sci", "cord injury", "spinal injury"),
        "Post stroke hemiparesis": ("hemiparesis after stroke", "stroke weakness", "weakness after stroke", "post cva hemiparesis", "one sided weakness after stroke"),
        "Carpal tunnel syndrome": ("cts", "carpal tunnel", "median nerve compression"),
        "Plantar fasciitis": ("heel spur syndrome", "plantar fasciopathy", "policemans heel", "jogger's heel"),
        "Frailty syndrome": ("frailty", "frail elderly"),
        "Vascular dementia": ("multi infarct dementia", "multi-infarct dementia", "vad"),
        "Recurrent falls": ("frequent falls", "repeated falls", "falls"),
        "Pressure ulcer": ("bedsore", "bed sore", "decubitus ulcer", "pressure sore", "decubitus"),
        "Orthostatic hypotension": ("postural hypotension", "postural drop"),
        "Cancer related pain": ("crp", "malignant pain", "cancer pain", "tumor pain"),
        "Terminal breathlessness": ("end of life dyspnea", "terminal dyspnea", "terminal dyspnoea"),
        "Cachexia": ("wasting syndrome", "wasting"),
        "Opioid induced constipation": ("oic", "narcotic bowel constipation"),
        "End stage heart failure": ("eshf", "terminal heart failure", "advanced heart failure", "end stage chf"),
        "Abdominal aortic aneurysm": ("aaa", "triple a"),
        "Peripheral artery disease": ("pad", "pvd", "peripheral arterial disease", "peripheral vascular disease"),
        "Varicose veins": ("varicosities", "varices of leg"),
        "Carotid stenosis": ("carotid artery stenosis", "narrowed carotid", "carotid narrowing"),
        "Venous leg ulcer": ("vlu", "venous ulcer", "stasis ulcer", "venous stasis ulcer"),
        "Neonatal jaundice": ("newborn jaundice", "neonatal hyperbilirubinemia", "jaundice of newborn", "yellow baby"),
        "Respiratory distress of newborn": ("rds", "nrds", "hyaline membrane disease", "irds"),
        "Prematurity": ("preterm birth", "premature birth", "preterm infant", "preterm", "premature baby"),
        "Neonatal sepsis": ("newborn sepsis", "sepsis of newborn", "sepsis neonatorum"),
        "Transient tachypnea of newborn": ("ttn", "wet lung", "ttnb", "transient tachypnoea of newborn"),
        "Keloid scar": ("keloid", "raised scar"),
        "Cleft lip": ("harelip", "hare lip", "cheiloschisis"),
        "Burn contracture": ("scar contracture after burn", "burn scar contracture", "contracture after burn"),
        "Breast asymmetry": ("uneven breasts", "asymmetric breasts"),
        "Eyelid ptosis": ("droopy eyelid", "drooping eyelid", "blepharoptosis"),
        "Allergic rhinitis": ("hay fever", "hayfever", "seasonal allergies", "seasonal allergy"),
        "Anaphylaxis": ("anaphylactic shock", "severe allergic reaction", "anaphylactic reaction"),
        "Chronic urticaria": ("csu", "chronic hives", "hives", "chronic spontaneous urticaria"),
        "Peanut allergy": ("allergy to peanuts", "nut allergy", "allergic to peanuts"),
        "Selective IgA deficiency": ("siga deficiency", "iga deficiency", "low iga", "sigad"),
    },
}
PLAIN_WORDS = frozenset(("as", "ed", "pet", "er", "ra", "ld"))  # short forms that are also words: only as the whole value
# Words that leave the named thing the same.
NOISE_WORDS = """dx hx of known clinic dept department ward outpatients outpatient main bldg building floor 2nd 1st 3rd follow up followup check checkup fu
    f u review stable left right bilateral ppo hmo family gold silver bronze tier via employer inc llc ltd co the a unit history diagnosis
    status post new old patient pt has with for and service services section div division"""
# Short forms that are no beginning and no skeleton of their word.
SHORT = {"d/o": "disorder", "dm": "diabetes", "w": "with", "fx": "fracture", "&": "and"}


def folded(text: str) -> str:
    text = unicodedata.normalize("NFKD", text).casefold()
    return "".join(ch for ch in text if not unicodedata.combining(ch))


def skeleton(word: str) -> str:
    """One form for letters and the digits put for them (1 stands for i and l), in words that have letters."""
    if any(ch.isalpha() for ch in word):
        return word.translate(str.maketrans("013457$@i", "oleastsal"))
    return word


@remembered(100_000)
def tokens(text: str) -> tuple[str, ...]:
    t = folded(text).replace("d/o", "disorder").replace("f/u", " fu ").replace("&", " and ").replace("'", "")
    return tuple(skeleton(w) for w in _TOKEN.findall(t))


NOISE = frozenset(map(skeleton, NOISE_WORDS.split()))


def is_noise(word: str) -> bool:
    """Noise words, and numbers as of members or files."""
    return word in NOISE or (word.isdigit() and len(word) > 2)


def abbreviates(short: str, word: str) -> bool:
    """The word's first letter, then some of its letters in order; or a known short form."""
    if SHORT.get(short) == word:
        return True
    if len(short) < 2 or short[0] != word[0] or len(short) >= len(word):
        return False
    rest = iter(word)
    return all(ch in rest for ch in short)


class Resolver:
    """Entries of one field. ``resolve`` gives an entry's id or NONE."""

    def __init__(self, field: str, entries: list[tuple[str, str]], aliases: list[tuple[str, str]] | None = None) -> None:
        """``entries`` are (id, name); ``aliases`` are (name, other name), those of ALIASES where none are given."""
        import ahocorasick

        if aliases is None:
            aliases = [(name, o) for name, others in ALIASES.get(field, {}).items() for o in others]

        self.automaton = ahocorasick.Automaton()
        self.names: list[tuple[tuple[str, ...], str, str]] = []  # tokens, joined, id
        self.whole: dict[str, str] = {}
        by_name = {name: i for i, name in entries}
        known: dict[str, set[str]] = defaultdict(set)
        initials: dict[str, set[str]] = defaultdict(set)
        self.grams: dict[str, list[int]] = defaultdict(list)
        skip = skeleton("and"), "of"
        for i, name in sorted(entries):
            known[" ".join(tokens(name))].add(i)
            words = [w for w in tokens(name)]
            if len(words) > 2:
                for form in ("".join(w[0] for w in words), "".join(w[0] for w in words if w not in skip)):
                    initials[form].add(i)
        for name, o in aliases:
            if name in by_name:
                known[" ".join(tokens(o))].add(by_name[name])
        self.initials = {k: v for k, v in initials.items() if k not in known}
        for form, ids in known.items():
            if len(ids) == 1:
                self._add(form, next(iter(ids)))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.canonical = [(tokens(name), "".join(tokens(name)), i) for i, name in sorted(entries)]

    def _add(self, form: str, i: str) -> None:
        if len(form) > 3 or form not in PLAIN_WORDS:
            self.automaton.add_word(f" {form} ", (len(form), form, i))
        self.whole[form] = i
        joined = form.replace(" ", "")
        if len(joined) >= 4:
            k = len(self.names)
            self.names.append((tuple(form.split()), joined, i))
            for g in {joined[j : j + 2] for j in range(len(joined) - 1)}:
                self.grams[g].append(k)

    def mention(self, words: tuple[str, ...]) -> str | None:
        """The entry of the longest mention, which no other can overlap away; null where there is none or two entries' are equally long."""
        text = f" {' '.join(words)} "
        longest, ids = 0, set()
        for _, (size, _, i) in self.automaton.iter(text) if len(self.automaton) else ():
            if size > longest:
                longest, ids = size, {i}
            elif size == longest:
                ids.add(i)
        return next(iter(ids)) if len(ids) == 1 else None

    def by_spelling(self, words: list[str]) -> str | None:
        """The nearest name by edits over the whole spelling without spaces."""
        joined = "".join(words)
        if len(joined) < 4:
            return None
        score: dict[int, int] = defaultdict(int)
        grams = {joined[j : j + 2] for j in range(len(joined) - 1)}
        for g in grams:
            for k in self.grams.get(g, ()):
                score[k] += 1
        best: dict[str, int] = {}
        for k, (_, name, _) in enumerate(self.names):
            most = max(1, int(NEAR_SHARE * max(len(name), 5)))
            if abs(len(name) - len(joined)) > most or score.get(k, 0) < len(grams) - 3 * most:
                continue  # an edit, a swap of neighbours too, changes three bigrams at most
            d = osa(joined, name, most)
            if d > most:
                continue
            form = self.names[k][0]
            if len(form) == len(words):  # no word may be another one
                near = all(osa(x, y, 9) <= max(1, NEAR_WORD * max(len(x), len(y))) for x, y in zip(words, form, strict=True))
            else:
                near = False
            if near or d <= max(1, NEAR_MOVED * len(name)) and (len(form) != len(words) or len(form) == 1):
                best[self.names[k][2]] = min(d, best.get(self.names[k][2], 99))
        return self._only(best)

    @staticmethod
    def _only(best: dict[str, int | float]) -> str | None:
        if not best:
            return None
        least = min(best.values())
        winners = [i for i, d in best.items() if d == least]
        return winners[0] if len(winners) == 1 else None

    def by_tokens(self, words: list[str]) -> str | None:
        """Token sets: every word of the entry is there, in any order, mistyped or abbreviated; nothing else but noise is."""
        best: dict[str, float] = {}
        for entry, _, i in self.canonical:
            needed = [w for w in entry if w not in ("and", "of")]
            free = [w for w in words if w not in ("and", "of")]
            if not needed or len(free) < len(needed) or abs(len(free) - len(needed)) > 3:
                continue
            cost = 0.0
            for w in sorted(needed, key=len, reverse=True):
                options = []
                for k, x in enumerate(free):
                    most = max(1, int(0.3 * len(w))) if len(w) > 3 else 0
                    if x == w:
                        options.append((0.0, k))
                    elif (d := osa(x, w, most)) <= most and len(x) > 2:
                        options.append((float(d), k))
                    elif abbreviates(x, w):
                        options.append((0.5, k))
                if not options:
                    cost = -1
                    break
                c, k = min(options)
                cost += c
                del free[k]
            if cost >= 0 and all(map(is_noise, free)):
                best[i] = cost
        return self._only(best)

    def by_beginning(self, words: list[str], cut: bool) -> str | None:
        """A value cut off in the middle: the beginning of one entry only; a mark of omission allows a typo in it."""
        joined = "".join(words)
        if len(joined) < 3:
            return None
        starts = {i for _, name, i in self.canonical if name.startswith(joined)}
        if len(starts) == 1:
            return next(iter(starts))
        if not starts and len(joined) >= 6:
            near = {i: d for _, name, i in self.canonical if (d := min(osa(joined, name[: len(joined) + s], 2) for s in (-1, 0, 1))) <= min(2, max(1, len(joined) // 8)) and len(name) > len(joined)}
            return self._only(near)
        return None

    def resolve(self, value: str) -> str:
        words = tokens(value)
        if not words:
            return NONE
        found = self.mention(words)
        if found:
            return found
        kept = [w for w in words if not is_noise(w)]
        if found := self.whole.get(" ".join(kept)) or self.whole.get(" ".join(words)):
            return found
        cut = bool(_CUT_OFF.search(value))
        for form in dict.fromkeys((tuple(kept), words)):
            if form:
                found = self.by_spelling(list(form))
                if found:
                    return found
        found = self.by_tokens(list(words)) or self.by_beginning(list(words), cut)
        if found:
            return found
        if len(words) == 1 and len(ids := self.initials.get(words[0], ())) == 1:
            return next(iter(ids))
        return NONE


def reference_list(entries: DataFrame) -> list[tuple[str, str, str]]:
    """The reference list (field, id, value), its size checked."""
    rows = entries.select("field_name", "canonical_id", "canonical_value").limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"the reference list has more than {MOST_PATTERNS} entries")
    return [(r[0], r[1], r[2]) for r in rows if None not in (r[0], r[1], r[2])]


_RESOLVERS: dict[tuple, Resolver] = {}


def resolver_for(field: str, entries: list[tuple[str, str, str]], aliases: list[tuple[str, str, str]] | None) -> Resolver:
    """The worker's resolver of a field: one for each content of list and aliases, however often these are sent."""
    mine = tuple((i, name) for f, i, name in entries if f == field)
    others = None if aliases is None else tuple((name, o) for f, name, o in aliases if f == field)
    key = (field, mine, others)
    if key not in _RESOLVERS:
        _RESOLVERS[key] = Resolver(field, list(mine), None if others is None else list(others))
    return _RESOLVERS[key]


def mapped(values: DataFrame, listed: list[tuple[str, str, str]], aliases: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(field_name, record_key, canonical_id) for (field_name, record_key, value) rows.

    Values that are null, blank or verbatim in the list for their field are no
    cases and come out nowhere.  Each worker remembers the values it has met, so a
    frequent spelling is resolved once per worker, without any shuffle.  ``aliases``
    are (field, entry, other name) rows that replace the built-in ones.
    """
    spark = values.sparkSession
    shared = spark.sparkContext.broadcast((listed, aliases))  # both lists are bounded by MOST_PATTERNS
    if aliases is not None and len(aliases) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} aliases")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resolvers: dict[str, Resolver] = {}
        memory: dict[tuple[str, str], str] = {}
        for b in batches:
            fields, vals = b.column(0).to_pylist(), b.column(2).to_pylist()
            out = []
            for f, v in zip(fields, vals, strict=True):
                i = memory.get((f, v))
                if i is None:
                    if f not in resolvers:
                        resolvers[f] = resolver_for(f, *shared.value)
                    if len(memory) > MOST_REMEMBERED:
                        memory.clear()
                    i = memory[(f, v)] = resolvers[f].resolve(v)
                out.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["field_name", "record_key", "canonical_id"])

    case = F.col("value").isNotNull() & (F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
    verbatim = spark.createDataFrame([(f, v) for f, _, v in listed], "field_name string, value string")
    cases = values.where(case).join(F.broadcast(verbatim), ["field_name", "value"], "left_anti")  # MOST_PATTERNS rows at most
    return cases.select("field_name", "record_key", "value").mapInArrow(work, "field_name string, record_key string, canonical_id string")
