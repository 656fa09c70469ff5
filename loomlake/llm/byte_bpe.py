"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

Three facts carry the design.  (1) Cut at any token border, the two halves of a
BPE encoding are the encodings of their own bytes; so every prefix of the input
has exactly one last token, found from the last tokens of shorter prefixes by
asking whether two neighbouring tokens survive each other's merges.  (2) A token
is no longer than the longest entry of the vocabulary (L bytes), so whatever
follows, the final encoding passes through one of the last L prefixes.  (3) Once
the token chains of these L prefixes meet in one prefix, everything before it is
stable and is emitted.  How far the chains can run before they meet is bounded
by the merge list (``sufficient_lookahead``); memory is therefore constant,
however long a run without a pre-token border is.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from functools import lru_cache

import regex

#: The published pre-token pattern of the byte_bpe_50k vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1 << 16
LONG = 512  # bytes: longer pre-tokens go through the transducer piece by piece
MOST_CACHED = 200_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The vocabulary: token bytes to id, ids in merge order."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs: dict[tuple[int, int], bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The defining rule, for short pieces: merge the neighbouring pair of least rank until none is left."""
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def survive(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when they are neighbours."""
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > MOST_CACHED:
                self._pairs.clear()
            known = self._pairs[key] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def sufficient_lookahead(self) -> int:
        """Bytes after which a prefix's tokens can no longer change, from the merge list alone.

        A change runs leftwards through tokens that overlap each other, each made
        by an earlier merge than the one before.  The longest such chain, counted
        in bytes, bounds the distance; it is found in one pass over the
        vocabulary in merge order, through the heads that tokens share.
        """
        reach: dict[bytes, int] = {}
        most = 0
        for token, _ in sorted(self.ranks.items(), key=lambda x: x[1]):
            best = max((reach.get(token[k:], 0) for k in range(1, len(token))), default=0)
            own = best + len(token)
            most = max(most, own)
            for k in range(1, len(token) + 1):
                head = token[:k]
                if reach.get(head, 0) < own:
                    reach[head] = own
        return most + self.longest


class Transducer:
    """Feed bytes, take stable tokens; ``held`` bytes wait at any time."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.peak = 0
        self.reset()

    def reset(self) -> None:
        self.bytes = bytearray()
        self.last = [-1]  # last[i]: the last token of the first i held bytes; -1 at the stable border
        self.border = -1  # the token that ends at the border, -1 at the start of a pre-token

    def feed(self, data: bytes) -> list[int]:
        """Take more bytes of the same pre-token; give the tokens that have become stable."""
        v, held, last = self.v, self.bytes, self.last
        ranks, survive, longest = v.ranks, v.survive, v.longest
        out: list[int] = []
        for b in data:
            held.append(b)
            n = len(held)
            found = -1
            for size in range(min(longest, n), 0, -1):
                t = ranks.get(bytes(held[n - size :]))
                if t is None:
                    continue
                before = last[n - size] if n > size else self.border
                if before == -1 or survive(before, t):
                    found = t
                    break
            last.append(found)
            if n >= 4 * longest and n % longest == 0:
                out += self._settle()
                held, last = self.bytes, self.last
        self.peak = max(self.peak, len(held))
        return out

    def _chain(self, at: int) -> list[int]:
        path = [at]
        while at > 0:
            at -= len(self.v.tokens[self.last[at]])
            path.append(at)
        return path

    def _settle(self) -> list[int]:
        """Emit up to the last prefix that the chains of all of the last L prefixes share."""
        n = len(self.bytes)
        shared: set[int] | None = None
        for at in range(max(1, n - self.v.longest + 1), n + 1):
            path = set(self._chain(at))
            shared = path if shared is None else shared & path
        stable = max(shared or {0})
        if stable <= 0:
            return []
        out = self._tokens(stable)
        self.border = out[-1]
        del self.bytes[:stable]
        self.last = [-1, *self.last[stable + 1 :]]
        return out

    def _tokens(self, at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(self.last[at])
            at -= len(self.v.tokens[self.last[at]])
        return out[::-1]

    def finish(self) -> list[int]:
        out = self._tokens(len(self.bytes))
        self.reset()
        return out


class Encoder:
    """Text to ids.  Pre-tokens come from a sliding window over the text; short ones are remembered, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, block: int = BLOCK) -> None:
        self.v, self.block = vocabulary, block
        self.transducer = Transducer(vocabulary)
        self.find = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of one window after another; the last two of a window wait, as the next characters may change them."""
        at, end, size = 0, len(text), self.block
        while at < end:
            window = text[at : at + size]
            found = self.find(window)
            if at + size < end:
                if len(found) < 3:
                    size *= 2
                    continue
                found = found[:-2]
                at += sum(map(len, found))
                size = self.block
            else:
                at = end
            yield found

    def piece(self, text: str) -> list[int]:
        data = text.encode("utf-8")
        one = self.v.ranks.get(data)
        if one is not None:
            return [one]
        t = self.transducer
        out: list[int] = []
        for k in range(0, len(data), LONG):
            out += t.feed(data[k : k + LONG])
        return out + t.finish()

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens, whose strings are ordinary text here; the empty list for null and empty texts."""
        if not text:
            return []
        known, out = self.known, []
        for found in self.pieces(text):
            for p in found:
                ids = known.get(p)
                if ids is None:
                    ids = self.piece(p)
                    if len(p) <= 32:
                        if len(known) >= MOST_CACHED:
                            known.clear()
                        known[p] = ids
                out += ids
        return out


class Decoder:
    """Ids to text, incrementally: bytes go into a UTF-8 state machine that keeps at most three bytes back."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.tokens = vocabulary.tokens
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> Iterator[str]:
        for i in ids:
            piece = self.machine.decode(self.tokens[i])
            if piece:
                yield piece

    def finish(self) -> str:
        rest = self.machine.decode(b"", True)
        self.machine.reset()
        return rest

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.feed(ids)) + self.finish()


@lru_cache(maxsize=2)
def encoder_for(data: bytes) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(Vocabulary(read_ranks(data)))
