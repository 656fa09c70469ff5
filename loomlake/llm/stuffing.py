"""Keyword-stuffed pages, link lists and tag lists.

A text is a sequence of terms.  Two signals are taken from where terms recur:

* recurrence gaps: the distances between the places of each pair of neighbouring
  terms.  Pairs that come back at short or even distances mark their terms; a
  pair whose places cover much of the page is its promoted phrase;
* positional autocorrelation: the share of a window's terms that equal the term
  a fixed lag before or after.  The lags tried are all those at which a twentieth
  of the page's terms next recur, however long, so that a repeated paragraph is
  found as well as a repeated word.

Terms without function words are marked from a moderate regularity on, whole
sentences only where they are repeated nearly word for word.  The third signal is
for pages that repeat nothing: lists of many different nouns without function
words, and lists of links.  Lines of code, logs, tables and data repeat
themselves by nature and never count.  A page is a case when the marked
characters are the larger part of the text.

Texts are read one by one; all counting is done on arrays over many texts at
once, in linear or n log n time for a text of any length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomlake.llm.memory import SHORT

_LATIN_LETTER = re.compile(r"[A-Za-z]")
_CYRILLIC_RUN = regex.compile(r"\p{Cyrillic}{3}")
_LETTER_SIGN = re.compile(r"[0-9$@!€]")
_LETTER = regex.compile(r"\p{L}")
_PRICE = re.compile(r"[$€£]\s?\d|\d\s?[$€£]")
_CJK_STOP = re.compile(r"[。？！]")
_OTHER_SCRIPT = regex.compile(r"[^\p{Latin}\p{N}\p{P}\p{S}\p{M}]")

WINDOW = 24  # terms
FEW_FUNCTION = 0.13  # share of function words below which terms are not sentences
RECURRENT = 0.45  # share of terms whose pair recurs soon or evenly
SATURATED, SOME_FUNCTION = 0.70, 0.25  # so much recurrence marks terms even with some function words between them
BARE = 12  # so many terms with at most one function word are a list
DISTINCT = 0.5  # share of a list's terms that are different
REGULAR = 0.50  # share of a window's terms that equal the term a lag before or after
VERBATIM, COPIES = 0.90, 5  # sentences with function words: nearly all terms equal, in so many copies or more; fewer are quotations
LAG_SHARE = 0.05  # a lag is tried where so many of the page's terms next recur at it; at most 20 lags can be
PROMOTED = 0.30  # share of a page's terms that is its one phrase
LESS_PROMOTED, POOR = 0.24, 0.42  # a smaller share is enough where few different words stand around the phrase
LEAST_SEGMENT = 6  # terms
NEAR = 40  # terms: a gap up to this is short; a longer one counts where the pair is spread evenly
EVEN = 2.0  # times the page's length over the pair's places: gaps up to this are even
SMALL_WORD = 3  # letters: in scripts without a list of function words, words up to this stand for them
CHARACTERS = 400_000  # texts counted at once have so many characters, or are one

# Common function words of the languages of the corpus.
FUNCTION_WORDS = frozenset(
    """a about after again all also am an and another any are as at be because been before being but by can can't cannot could did do does
    doesn't don't down each either else even every few for from had has have he her here him his how i if in instead into is isn't it its
    just know like look me more most must my neither never no nor not now of off on once only or other our out over own please same she
    should so some such than that the their them then there these they this those though through to too under until up us use very was way
    we were what when where whether which while who why will with won't without would yes yet you your
    aber als am an auch auf aus bei bin bis da damit dann das dass dem den der des die dies diese doch durch ein eine einem einen einer es
    für gibt habe hat hatte ich ihr im in ist ja jemand kann kein könnte man mehr mich mir mit muss müssen nach nicht noch nur ob oder sein
    seit sich sie sind sonst soll über um und uns viel vom von vor war warum was weil wenn werden wie wir wird wurde zu zum zur zuerst
    al algo alguien como con cuando de del desde donde el ella en entre era es esa ese eso esta está este esto fue ha hay la las le les lo
    los luego más me mi muy no nos o para pero por porque primero qué que quien se sea ser si sin sobre son su también te tiene un una
    uno y ya
    à a au aussi aux avec c d quelqu'un ce ces cette chez comme d'abord dans de des dont du elle en entre est et eu il ils j je l la le les leur lors
    lue mais me mes moi n ne nous on ou où par pas peut plus pour pourquoi qu que quelqu qui s sa sans se ses si son sont sous sur t très
    trop tu un une vous y être été
    ao aos até com da das depois do dos e ela ele em essa esse está eu foi há isso já la mais mas me mesmo meu na nas não nem no nos num
    o os ou para pela pelo por porque quando que quem se sem ser seu só sua são também tem um uma você vai""".split()
)
# Letters of other scripts and signs that are put for Latin letters.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһӏԛԝАВЕКМНОРСТХ", "aeopcyxijsdhlqwABEKMHOPCTX")
SIGNS = str.maketrans("013457$@!€", "oieastsaie")

_DOTTED = re.compile(r"[.:](?:\w|//)")
_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"'\]\)]+|(?<![\w.-])(?:[\w-]{1,63}+\.){1,6}(?:example|test|invalid|com|net|org|io|info|biz)(?:\.\w{2,3})?(?:/[^\s<>\"'\]\)]*)?", re.IGNORECASE)
_MARKUP = re.compile(r"</?(?:a|b|br|code|div|em|h[1-6]|i|img|li|ol|p|pre|span|strong|table|td|th|tr|u|ul)\b[^>]{0,2000}>|<!--|-->", re.IGNORECASE)
_TERM = re.compile(r"([^\W_][\w$@!€'’-]*[\w$€]|\w|\$\w+)")
_BREAK = regex.compile(r"[_-]|(?<=^\p{L}{1,2})['’]")  # also after the elided words of French and Italian
_SPACED = re.compile(r"(?<!\w)\w([*._~+-])\w(?:\1\w){2,}+(?!\w)")
_SPACED_OUT = re.compile(r"([*._~+-])\w\1\w\1")  # stands in all of these
_CITED = re.compile(r"\s*(?:\[\w{1,3}\]:?|\(\d{1,3}\)|sources?:|see)\s+\S+\s*(?:\[\d+\])?\s*$", re.IGNORECASE)  # a numbered or named source
_STOP = re.compile(r"[`\"')]?[.?!。？！](?:\s|$)")
_ENDER = re.compile(r"\s?[,;|•>·/\]、]|\s[-–—]\s|\s*$")
_CAMEL = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})")
_CJK = re.compile(r"[⺀-⻿⼀-⿕々-〇〡-〩〸-〻぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")
_CJK_SENTENCE = re.compile(r"[的了是我你他她它们們这這那吗嗎呢吧也很没沒を]|不(?:要|能|会|會|是|到)|可以|因为|因為|所以|如果|需要|[はがに][㐀-鿿]|です|ます|ません|まし|した|して|する|ない|くださ|から|ので|では")  # particles and endings
_STAMP = re.compile(r"\d{4}-\d\d-\d\d[ T]\d\d:\d\d|\b\d\d:\d\d:\d\d\b")
_CODE_START = re.compile(
    r"\s*(?:import|from|select|where|group by|having|order by|with|def|class|return|if|else|for|while|try|except|raise|yield|val|var|let|const|assert|print|public|private|static|function|File|Traceback|at|#include|\)|\}|\]|\{|//|--\s)\b|\s*[\)\}\]\{]"
)
_SHELL = re.compile(r"^\s*\$\s+\S|^\s*\[(?:warn|info|error|debug|fatal)\w*\]|\s--\w[\w-]*(?:[ =]|$)", re.IGNORECASE)
_IDENTIFIER = re.compile(r"\b[a-z]+(?:_[a-z0-9]+)+\b|\b[a-z]+\.[a-z_]+\(|\b\w+\(")
_CODED = re.compile(r"[\d()\[\]{}=;\"'`|\t\\&$_]")  # without such a sign only the beginning of a line can make it code
_SIGNS, _DIGITS = b"()[]{}=;\"'`|\t\\&", b"0123456789"
_SIGN, _DIGIT = re.compile("[" + re.escape(_SIGNS.decode()) + "]"), re.compile(r"\d")
_NO_LETTERS = bytes(i for i in range(128) if not chr(i).isalpha())
_CLOCK = re.compile(r":\d\d")

WORD, FUNCTION, LINK, STRUCTURED = range(4)


def plain(term: str) -> list[str]:
    """Terms as a reader sees them: look-alike letters folded, glued words cut."""
    out = []
    for part in [term] if term.isupper() or term.islower() else _CAMEL.split(term):
        if not part.isascii() and (_LATIN_LETTER.search(part) or not _CYRILLIC_RUN.search(part)):
            part = part.translate(LOOKALIKES)
        if _LETTER_SIGN.search(part) and _LETTER.search(part):
            part = part.translate(SIGNS)
        out += [w for w in _BREAK.split(part.casefold()) if w]
    return out


def kind_of(word: str) -> int:
    """FUNCTION for function words, or short words of a script without a list of them; CJK clauses are told by their particles."""
    if word in FUNCTION_WORDS:
        return FUNCTION
    if word.isascii():
        return WORD
    if _CJK.search(word):
        return FUNCTION if len(word) >= 5 and _CJK_SENTENCE.search(word) else WORD
    return FUNCTION if len(word) <= SMALL_WORD and _OTHER_SCRIPT.search(word) else WORD


class Terms(dict):
    """Terms by number: their words, and what is to be known of each word, in columns."""

    def __init__(self) -> None:
        super().__init__()
        self.words: list[str] = []
        self.new: list[tuple[int, int, int, bool]] = []  # of each new word: number, characters, kind, CJK
        self.new_counts: list[int] = []
        self.of_word, self.count = np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
        self.characters = 0

    def __missing__(self, term: str) -> int:
        found = plain(term) if term != URL else [URL]
        size = len(term) // max(1, len(found))
        for k, w in enumerate(found):
            self.words.append(w)
            self.new.append((hash(w), max(1, size) + (k == 0), kind_of(w) if w != URL else LINK, not w.isascii() and _CJK.search(w) is not None))
        self.new_counts.append(len(found))
        self.characters += len(term)
        self[term] = code = len(self)
        return code

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(properties of each word, number of words of each term, place of its first word)."""
        if self.new_counts:
            self.of_word = np.concatenate((self.of_word, np.array(self.new, np.int64).reshape(-1, 4)))
            self.count = np.concatenate((self.count, np.array(self.new_counts, np.int64)))
            self.new, self.new_counts = [], []
        return self.of_word, self.count, np.cumsum(self.count) - self.count

    def full(self) -> bool:
        return len(self) > 200_000 or self.characters > 10_000_000


class Gaps(dict):
    """What stands between two terms, or behind the last one with a line break: 1 where it ends a list item, 2 a sentence, 3 both."""

    def __missing__(self, gap: str) -> int:
        followed = gap if gap.endswith("\n") else gap + "x"
        value = (_ENDER.match(followed, 0, 3) is not None) + 2 * (_STOP.match(followed, 0, 4) is not None)
        if len(gap) <= SHORT and len(self) < 50_000:
            self[gap] = value
        return value


URL = "\0url"
GAPS = Gaps()
_held = [Terms()]


def is_structured(line: str, links: list[re.Match]) -> bool:
    """Lines of code, logs, tables and data; ``links`` are those in the line."""
    body = line
    if links:
        body = "".join(line[a:b] for a, b in zip([0, *(m.end() for m in links)], [*(m.start() for m in links), len(line)]))
        if len(body) < 0.6 * len(line) or not body.strip():
            return False  # a link, whatever is around it
    if not _CODED.search(body) and "--" not in body:
        return _CODE_START.match(line) is not None and len(line.split()) <= 2
    if _CLOCK.search(line) and _STAMP.search(line) or ("$" in line or "[" in line or "--" in line) and _SHELL.search(line):
        return True
    if body.isascii():
        raw = body.encode()
        signs, digits = len(raw) - len(raw.translate(None, _SIGNS)), len(raw) - len(raw.translate(None, _DIGITS))
        letters = len(raw.translate(None, _NO_LETTERS))
    else:
        signs, digits, letters = len(_SIGN.findall(body)), len(_DIGIT.findall(body)), sum(map(str.isalpha, body))
    if signs + digits >= 5 and signs + digits >= 0.3 * letters and not _PRICE.search(body):
        return True
    may = body.count("_") + body.count("(")  # as many names at most
    names = _IDENTIFIER.findall(body) if may and (may >= 2 or signs >= 3 or _CODE_START.match(line)) else []
    if (names or signs >= 2 or len(line.split()) <= 2) and _CODE_START.match(line):
        return True
    if len(names) < 2 and signs < 3:
        return False
    return sum(map(len, names)) >= 0.4 * max(1, len(body.strip())) and len(set(names)) < len(names) * 0.9 + 1 and "•" not in body and "|" not in body


class Pages:
    """The terms of many texts in a row."""

    def __init__(self, texts: list[str]) -> None:
        if _held[0].full():
            _held[0] = Terms()
        self.table = _held[0]
        self.terms: list[str] = []
        self.gaps: list[str] = []
        self.lines: list[tuple[int, bool, bool]] = []  # terms, structured, CJK sentence
        self.links: list[tuple[int, int, int]] = []  # place, characters, kind
        starts = [0]
        for t in texts:
            self._add(t)
            starts.append(len(self.terms))
        self._count(np.array(starts, np.int64))

    def _add(self, text: str) -> None:
        ascii_only = text.isascii()
        if not ascii_only:
            text = unicodedata.normalize("NFKC", text)
        if "<" in text:  # mark-up goes, the links in it stay
            text = _MARKUP.sub(lambda m: " " + " ".join(_URL.findall(m.group())) + " ", text)
        spaced, dotted = _SPACED_OUT.search(text) is not None, _DOTTED.search(text) is not None
        terms, gaps = self.terms, self.gaps
        for line in text.split("\n"):
            start = line.lstrip()[:1]
            if not start:
                continue
            before = len(terms)
            cited = start in "[(sS" and _CITED.match(line) is not None
            links = list(_URL.finditer(line)) if dotted and _DOTTED.search(line) else []
            structured = cited or is_structured(line, links)
            sentence = not ascii_only and _CJK_STOP.search(line) is not None and _CJK.search(line) is not None
            if spaced:
                line = _SPACED.sub(lambda m: m.group()[::2], line)
                links = list(_URL.finditer(line)) if links else links
            if links:
                at = 0
                for m in links:
                    pieces = _TERM.split(line[at : m.start()])
                    terms += pieces[1::2]
                    gaps += pieces[2::2]
                    if len(pieces) > 1:
                        gaps[-1] += "\n"
                    self.links.append((len(terms), len(m.group()), STRUCTURED if cited else LINK))
                    terms.append(URL)
                    gaps.append(" ")
                    at = m.end()
                line = line[at:]
            pieces = _TERM.split(line)
            terms += pieces[1::2]
            gaps += pieces[2::2]
            if len(pieces) > 1:
                gaps[-1] += "\n"
            self.lines.append((len(terms) - before, structured, sentence))

    def _count(self, term_starts: np.ndarray) -> None:
        """From terms to words: ``number``, ``size``, ``kind``, ``ends`` (of list items), ``stops`` and ``starts`` of each text."""
        codes = np.array([self.table[t] for t in self.terms], np.int64)
        marks = np.array([GAPS[g] for g in self.gaps], np.int8)
        of_word, count, first = self.table.columns()
        each = count[codes]
        end = np.cumsum(each)
        n = int(end[-1]) if len(end) else 0
        self.at = np.repeat(first[codes] - (end - each), each) + np.arange(n)
        props = of_word[self.at]
        self.number, self.size, self.kind = props[:, 0], props[:, 1].copy(), props[:, 2].astype(np.int8)
        lines = np.array(self.lines, np.int64).reshape(-1, 3)
        structured = np.repeat(lines[:, 1] > 0, lines[:, 0])
        sentence = np.repeat(lines[:, 2] > 0, lines[:, 0])
        self.kind[np.repeat(sentence, each) & (props[:, 3] > 0)] = FUNCTION
        self.kind[np.repeat(structured, each)] = STRUCTURED
        if self.links:
            at, size, kind = np.array(self.links, np.int64).T
            self.size[end[at] - 1], self.kind[end[at] - 1] = size, kind
        marks[structured | (each == 0)] = 0
        bounds = np.concatenate(([0], end))
        self.ends = np.zeros(n, bool)
        self.ends[end[(marks & 1) > 0] - 1] = True
        last = bounds[np.cumsum(lines[:, 0])]  # the last word of each line
        self.ends[last[last > 0] - 1] = True
        self.stops = end[(marks & 2) > 0]
        self.starts = bounds[term_starts]

    def words(self, a: int, b: int) -> list[str]:
        return [self.table.words[k] for k in self.at[a:b]]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each window, and the text it is of."""
        found, of = [], []
        stop_of = np.searchsorted(self.stops, self.starts, "right")
        starts, stops = self.starts.tolist(), self.stops.tolist()
        for page in range(len(starts) - 1):
            begin, end = starts[page], starts[page + 1]
            width = WINDOW if end - begin >= 2 * WINDOW else WINDOW // 2  # short pages: narrower, or a sentence hides the list after it
            before = len(found)
            found += windows(begin, end, stops[stop_of[page] : stop_of[page + 1]], width)
            of += [page] * (len(found) - before)
        return np.array(found, np.int64).reshape(-1, 2), np.array(of, np.int64)


def windows(begin: int, end: int, stops: list[int], width: int) -> Iterator[tuple[int, int]]:
    """Overlapping windows over the terms; none reaches over the end of a sentence, but short sentences go together."""
    step = width // 2
    for stop in [*stops, end]:
        if stop == begin or stop - begin < LEAST_SEGMENT and stop < end:
            continue
        for a in range(begin, max(begin + 1, stop - step), step):
            yield a, min(stop, a + width)
        begin = stop


def sums(values: np.ndarray) -> np.ndarray:
    """Running sums with a leading zero: the sum over [a, b) is s[b] - s[a]."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One number for two."""
    z = (x * np.uint64(0x9E3779B97F4A7C15)) ^ (y + np.uint64(0x7F4A7C15))
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(32))


def groups_of(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in the order of their keys, and where each key's run begins, with the end at last."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    begins = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return places[order], np.append(begins, len(k))


def recurrence(pair_places: np.ndarray, begins: np.ndarray, page: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which terms belong to a pair of neighbours that stands three times or more in its page, at a short or even gap from its next place."""
    hit = np.zeros(n, bool)
    if not len(pair_places):
        return hit
    count = np.diff(begins)
    often = np.repeat(count, count)
    gap = np.diff(pair_places, append=0)
    gap[begins[1:] - 1] = 0
    allowed = np.maximum(NEAR, EVEN * length[page[pair_places]] / often)
    close = (often >= 3) & (gap > 0) & (gap <= allowed)
    for p in (pair_places[close], pair_places[np.flatnonzero(close) + 1]):
        hit[p] = hit[p + 1] = True
    return hit


def next_gaps(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, gap to the next place of the same term) for every term that recurs."""
    p, begins = groups_of(keys, places)
    gap = np.diff(p, append=0)
    gap[begins[1:] - 1] = 0
    again = gap > 0
    return p[again], gap[again]


def autocorrelation(number: np.ndarray, free: np.ndarray, starts: np.ndarray, page: np.ndarray, win: np.ndarray, of: np.ndarray, places: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best, verbatim) per window: the greatest share, over the page's lags, of terms that equal the term a lag before or after, and whether nearly all do in COPIES copies or more."""
    best, verbatim = np.zeros(len(win)), np.zeros(len(win), bool)
    if not len(places):
        return best, verbatim
    length = np.diff(starts)
    top = int(length.max()) + 1
    lags, times = np.unique(page[places].astype(np.int64) * top + gaps, return_counts=True)
    wanted = times >= np.maximum(3, LAG_SHARE * length[lags // top])
    first = np.searchsorted(of, np.arange(len(length) + 1))
    for key in lags[wanted]:
        d, lag = divmod(int(key), top)
        a, b = int(starts[d]), int(starts[d + 1])
        same = (number[a + lag : b] == number[a : b - lag]) & free[a + lag : b] & free[a : b - lag]
        both = np.zeros(b - a, bool)
        both[lag:] = same
        both[: b - a - lag] |= same
        s = sums(both)
        w = slice(first[d], first[d + 1])
        lo, hi = win[w, 0] - a, win[w, 1] - a
        share = (s[hi] - s[lo]) / (hi - lo)
        best[w] = np.maximum(best[w], share)
        if same.sum() >= (COPIES - 1) * lag * VERBATIM:
            verbatim[w] |= share >= VERBATIM
    return best, verbatim


def promoted(words: list[str], kinds: list[int]) -> bool:
    """Whether the page's most frequent pair, or longer phrase, has a PROMOTED share of its terms."""
    words = [w for w, k in zip(words, kinds, strict=True) if k != STRUCTURED]
    if len(words) < 12:
        return False
    at: dict[tuple[str, str], list[int]] = {}
    for i, p in enumerate(zip(words, words[1:])):
        if "\0url" not in p and not (p[0] in FUNCTION_WORDS or p[1] in FUNCTION_WORDS):
            at.setdefault(p, []).append(i)
    if not at:
        return False
    phrase, places = max(at.items(), key=lambda x: len(x[1]))
    if len(places) < 4:
        return False
    covered = {j for i in places for j in (i, i + 1)}
    glued = "".join(phrase)
    covered |= {i for i, w in enumerate(words) if len(w) > len(glued) and glued in w}
    for other, places2 in at.items():  # a third word of the phrase
        if other != phrase and len(places2) >= 0.8 * len(places) and (other[0] == phrase[1] or other[1] == phrase[0]):
            covered |= {j for i in places2 for j in (i, i + 1)}
    share = len(covered) / len(words)
    if share >= PROMOTED:
        return True
    rest = [w for i, w in enumerate(words) if i not in covered]
    return share >= LESS_PROMOTED and len(set(rest)) <= POOR * len(rest)  # a few words in ever new order around the phrase


def shares(texts: list[str]) -> list[float]:
    """For each text, the share of its characters that stands in stuffed keywords, link lists, tag lists or repeated sentences."""
    pages = Pages(texts)
    starts, number, size, kind = pages.starts, pages.number, pages.size, pages.kind
    n, length = len(number), np.diff(starts)
    if not n:
        return [0.0] * len(texts)
    page = np.repeat(np.arange(len(texts), dtype=np.int64), length)
    free = kind != STRUCTURED
    key = _mixed(number.astype(np.uint64), page.astype(np.uint64))
    places = np.flatnonzero(free)
    again, gap = next_gaps(key[places], places)

    joined = np.flatnonzero(free[:-1] & free[1:] & (page[:-1] == page[1:]))
    pair, begins = groups_of(_mixed(key[joined], key[joined + 1]), joined)
    hit = recurrence(pair, begins, page, length, n)

    # pages whose most frequent pair might be a promoted phrase
    most = np.zeros(len(texts), np.int64)
    named = (kind[pair] == WORD) & (kind[pair + 1] == WORD)
    first = begins[:-1]
    np.maximum.at(most, page[pair[first]], np.where(named[first], np.diff(begins), 0))
    of_phrase = np.zeros(len(texts), bool)
    for d in np.flatnonzero((most >= 4) & (most >= 0.04 * length)):
        a, b = starts[d], starts[d + 1]
        of_phrase[d] = promoted(pages.words(a, b), kind[a:b].tolist())

    win, of = pages.windows()
    lo, hi = win[:, 0], win[:, 1]
    m = hi - lo
    over = lambda x: (s := sums(x))[hi] - s[lo]
    structured, function, links = over(~free), over(kind == FUNCTION), over(kind == LINK)
    chars, link_chars = over(size), over(np.where(kind == LINK, size, 0))
    enders, hits = over(pages.ends), over(hit)
    regular, verbatim = autocorrelation(number, free, starts, page, win, of, again, gap)
    # different terms of a window: those whose last place lies before it
    before = np.full(n + 1, -1, np.int64)
    before[again + gap] = again
    inside = lo[:, None] + np.arange(WINDOW)
    inside = np.where(inside < hi[:, None], inside, n)
    different = ((before[inside] < lo[:, None]) & (inside < n)).sum(axis=1)

    share = function / np.maximum(1, m - structured)
    listed = (m >= 10) & (enders >= 0.3 * m) & (structured <= 0.15 * m) | (m >= BARE) & (function <= m // BARE) & (structured == 0)
    listed &= different >= DISTINCT * m
    marked = (share < FEW_FUNCTION) & (
        (links >= 2) & (link_chars >= 0.3 * chars) | (hits >= RECURRENT * m) | (m >= 8) & (regular >= REGULAR) | listed
    )
    marked |= (share < SOME_FUNCTION) & (hits >= SATURATED * m) | verbatim
    marked &= structured <= 0.5 * m

    step = np.zeros(n + 1, np.int64)
    np.add.at(step, lo[marked], 1)
    np.add.at(step, hi[marked], -1)
    on = (np.cumsum(step)[:n] > 0) & free
    good = length > 0
    total, spam = sums(size), sums(np.where(on, size, 0))
    total, spam = np.diff(total[starts]), np.diff(spam[starts])
    out = np.where(good & (length >= 4), spam / np.maximum(1, total), 0.0)
    out[of_phrase] = 1.0
    return out.tolist()


def spam_share(text: str) -> float:
    """``shares`` of one text."""
    return shares([text])[0]


def stuffed(df: DataFrame, key: str = "doc_id", text: str = "text", share: float = 0.5) -> DataFrame:
    """The keys of pages of which more than ``share`` is spam; null, empty and very short texts are none. One row per row found."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found: list[float] = []
            start = held = 0
            for i, t in enumerate(texts):
                if i > start and held + len(t) > CHARACTERS:
                    found += shares(texts[start:i])
                    start, held = i, 0
                held += len(t)
            found += shares(texts[start:])
            keep = [x > share for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_()))], names=[key])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(work, f"`{key}` {kind}")
