"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
import sys

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import checkpoint


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: it is computed once, and executors may go."""
    return checkpoint(df)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def digest(text: Column) -> list[Column]:
    """128 bits of a text as two longs."""
    return [F.xxhash64(text), F.xxhash64(F.lit(17), text)]


def remembered() -> dict:
    """A dictionary that lives as long as the Python worker, for models that a task would load anew."""
    return sys.__dict__.setdefault("_factloom_remembered", {})


_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _A
    x = x ^ (x >> np.uint64(27))
    x = x * _B
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray, np.uint64]:
    byte = np.arange(256, dtype=np.uint64)
    c = np.arange(256)
    inside = (c >= 128) | (c == 95) | ((c >= 48) & (c <= 57)) | ((c >= 65) & (c <= 90)) | ((c >= 97) & (c <= 122))
    return inside, mix(byte + np.uint64(0x9E3779B97F4A7C15)), np.uint64(pow(_BASE, -1, 1 << 64))


_BASE = 0xD1342543DE82EF95
_FOREIGN = re.compile(r"[^\x00-\x7f\w]")
_PIECE = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64; kept by the worker."""
    held = remembered().get("powers")
    if held is None or len(held[0]) < n:
        size = max(n, _PIECE + 4096)
        both = []
        for base in (np.uint64(_BASE), _tables()[2]):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        held = tuple(both)
        if size <= 8 * _PIECE:
            remembered()["powers"] = held
    return held


def _hash_block(data: bytes, ends_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data`` (which begins and ends with a blank), and how many begin before each offset."""
    inside, value, _ = _tables()
    raw = np.frombuffer(data, dtype=np.uint8)
    turn = np.flatnonzero(np.diff(inside[raw].view(np.int8))) + 1
    starts, ends = turn[0::2], turn[1::2]
    power, inverse = _powers(len(raw))
    sums = np.cumsum(value[raw] * power[: len(raw)], dtype=np.uint64)
    h = (sums[ends - 1] - sums[starts - 1]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64)), np.searchsorted(starts, ends_of)


def text_words(texts: list[str | None]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text, in order.

    Words are runs of letters, digits and underscores in lower case; a character
    outside ASCII that is no letter or digit parts words as blanks do. The hash is
    a polynomial over the bytes, taken from running sums of a whole block of texts.
    """
    pieces: list[tuple[int, bytes]] = []
    for i, text in enumerate(texts):
        text = (text or "").lower()
        if not text.isascii():
            text = _FOREIGN.sub(" ", text)
        raw = text.encode("utf-8", "replace")
        while len(raw) > _PIECE:
            at = raw.find(b" ", _PIECE)
            if at < 0:
                break
            pieces.append((i, raw[:at]))
            raw = raw[at:]
        pieces.append((i, raw))
    out: list[list[np.ndarray]] = [[] for _ in texts]
    at = 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and (end == at or size + len(pieces[end][1]) <= _PIECE):
            size += len(pieces[end][1]) + 1
            end += 1
        block = pieces[at:end]
        offsets = np.cumsum([1 + len(p) for _, p in block])
        hashes, upto = _hash_block(b" " + b" ".join(p for _, p in block) + b" ", offsets)
        for (i, _), lo, hi in zip(block, np.append(0, upto[:-1]), upto):
            out[i].append(hashes[lo:hi])
        at = end
    return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of ``k`` words, in order; a text of fewer words has one run, an empty one none."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    acc = hashes[: n - k + 1].copy()
    for i in range(1, k):
        acc = mix(acc) + hashes[i : n - k + 1 + i]
    return mix(acc)
