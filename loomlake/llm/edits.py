"""Edit distances."""

from __future__ import annotations


def osa(a: str, b: str, most: int = 99) -> int:
    """Optimal string alignment distance (neighbouring swaps cost 1); ``most`` + 1 where it is greater than ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    i, j = 0, min(len(a), len(b))
    while i < j and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    i, j = 0, min(len(a), len(b))
    while i < j and a[-1 - i] == b[-1 - i]:
        i += 1
    a, b = a[: len(a) - i], b[: len(b) - i]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    last = list(range(len(b) + 1))
    before, now = last[:], last[:]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)  # farther from the diagonal every distance is greater
        now[low - 1] = i if low == 1 else most + 1
        for j in range(low, high + 1):
            y = b[j - 1]
            d = last[j - 1] if x == y else 1 + min(last[j - 1], last[j], now[j - 1])
            if x != y and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now[j] = d
        if high < len(b):
            now[high + 1] = most + 1
        if min(now[low - 1 : high + 1]) > most:
            return most + 1
        before, last, now = last, now, before
    return min(last[-1], most + 1)


def levenshtein(a: str, b: str, most: int = 99) -> int:
    """Insertions, deletions and substitutions: a metric; ``most`` + 1 where it is greater than ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(last[j - 1] if x == y else 1 + min(last[j - 1], last[j], now[j - 1]))
        if min(now) > most:
            return most + 1
        last = now
    return min(last[-1], most + 1)
