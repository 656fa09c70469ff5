"""A bounded memory for functions of one short text."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, wraps
from typing import TypeVar

T = TypeVar("T")
SHORT = 200  # characters: longer arguments are computed anew, so that the memory stays small


def remembered(most: int) -> Callable[[Callable[[str], T]], Callable[[str], T]]:
    """Remember the results of the last ``most`` short arguments."""

    def wrap(f: Callable[[str], T]) -> Callable[[str], T]:
        cached = lru_cache(maxsize=most)(f)

        @wraps(f)
        def call(text):
            return cached(text) if text is None or len(text) <= SHORT else f(text)

        return call

    return wrap
