"""The part of a text most similar to a quote: votes of shared 4-grams, then a search that skips by a bound."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

GRAM = 4


def _common_subsequence(pattern: dict[str, int], size: int, window: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the pattern."""
    state = (1 << size) - 1
    for ch in window:
        hit = state & pattern.get(ch, 0)
        state = ((state + hit) | (state - hit)) & ((1 << size) - 1)
    return size - state.bit_count()


def _gram_keys(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    keys = np.zeros(max(len(codes) - GRAM + 1, 0), dtype=np.uint64)
    for i in range(GRAM):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(keys)]
    return keys


def voted_place(short: str, long: str) -> int | None:
    """The place of ``short`` over ``long`` that most of its 4-grams point to, each by its first occurrence; None without any."""
    grams, first = np.unique(_gram_keys(short), return_index=True)
    held = _gram_keys(long)
    if not len(grams) or not len(held):
        return None
    at = np.minimum(np.searchsorted(grams, held), len(grams) - 1)
    ends = np.flatnonzero(grams[at] == held)
    if not len(ends):
        return None
    votes = np.bincount(ends - first[at[ends]] + len(short))
    return int(votes.argmax()) - len(short)


def best_window(quote: str, text: str, least: float = 0.0) -> tuple[float, int, int]:
    """(score, start, end) of the part of ``text`` most similar to ``quote``; zeros if no score reaches ``least``.

    The shorter string slides over the longer one, hanging over at both ends; the score is twice the longest common
    subsequence over both lengths, in percent; ties go to the first place. From one place to the next a window gains and
    loses one character at most, so the subsequence changes by at most one: a place whose subsequence is too short
    rules out the places behind it up to where the best score so far could be reached again. The place that most
    4-grams point to is scored first, which makes the skips long. Every comparison is between whole numbers.
    """
    if not quote or not text:
        return 0.0, 0, 0
    short, long = (quote, text) if len(quote) <= len(text) else (text, quote)
    size, full = len(short), len(long) - len(short)
    pattern: dict[str, int] = {}
    for i, ch in enumerate(short):
        pattern[ch] = pattern.get(ch, 0) | (1 << i)
    floor = Fraction(str(least)) / 200
    top, whole, place = floor.numerator, floor.denominator, None

    def score(at: int) -> tuple[int, int]:
        nonlocal top, whole, place
        lo, hi = max(at, 0), min(at + size, len(long))
        common = _common_subsequence(pattern, size, long[lo:hi])
        both = size + hi - lo
        better = common * whole - top * both
        if better > 0 or better == 0 and (place is None or at < place):
            top, whole, place = common, both, at
        return common, both

    voted = voted_place(short, long)
    if voted is not None:
        score(voted)
    at = 1 - size
    while at < len(long):
        common, both = score(at)
        if at < 0:  # the window grows: one character more, and perhaps one more in common
            step, border = -((common * whole - top * both) // (whole - top)), 0
        elif at < full:  # full windows: only the common part can grow
            step, border = -((common * whole - top * both) // whole), full
        else:  # the window shrinks: its common part cannot grow
            step, border = -((common * whole - top * both) // top) if top else 1, len(long)
        at = min(at + max(step, 1), border)
    if place is None:
        return 0.0, 0, 0
    found = 200.0 * top / whole
    return (found, max(place, 0), min(place + size, len(long))) if short is quote else (found, 0, len(text))


def fuzzy_anchor(quote, text, least: float = 0.0) -> Column:
    """``best_window`` of each row; quote and text lie in one row, so nothing is shuffled."""
    @F.pandas_udf("struct<score:double,start:int,end:int>")
    def locate(quotes: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best_window(q or "", t or "", least) for q, t in zip(quotes, texts)], columns=["score", "start", "end"])

    return locate(quote, text)
