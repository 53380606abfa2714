"""Document quality by regularised quadratic discriminant analysis.

Each text becomes a dozen transformed statistics (logs of lengths, of shares of
characters, of repetition). Class means and covariances come from sums over at
most ``FIT_ROWS`` labelled rows, added up in the tasks and then by Spark, so that
their ids fit a broadcast and no text is shuffled; covariances shrink towards
the pooled one. The Cholesky factors are taken once and travel with the
scoring task; a score is the logistic of the difference of the two log-densities
from Mahalanobis distances, plus the log of the prior odds.

Defined cases: null and empty texts have the statistics of an empty text and get
a score too; repeated rows are scored each; a null id is never learned from and
never held out; with fewer than two rows of a class every score is the share of
label 1 (0 if none); other columns pass through; an empty table stays empty.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import fresh
from factloom.llm.toxicity import labelled

THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
SHRINK, RIDGE = 0.15, 1e-4
#: Labelled rows to learn from, at most, in hash order.
FIT_ROWS = 60_000
FEATURES = ("words", "word_length", "distinct", "upper", "digits", "symbols", "stops", "repeats", "top_word", "line_copies",
            "packed", "line_words", "capitals")

_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[[*range(97, 123), *range(128, 256)]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9, 10, 11, 12, 13]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words, lines = text.split(), text.split("\n")
    n, size = len(words), len(raw)
    _, lower, upper, digits, blanks, stops = [int(x) for x in np.bincount(
        _CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=6)] if size else [0] * 6
    symbols = size - lower - upper - digits - blanks - stops
    counts, held = Counter(words), max(n, 1)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    share = lambda x, of: float(np.log((x + 0.2) / (of + 10.0)))
    full = [x for x in lines if x.strip()]
    return [
        float(np.log1p(n)), float(np.log1p((size - blanks) / held)), float(np.log((len(counts) + 1) / (n + 1))),
        share(upper, size), share(digits, size), share(symbols, size), share(stops, size), share(repeats, n),
        share(max(counts.values(), default=0), n), share(len(full) - len(set(full)), len(full)),
        float(np.log((len(zlib.compress(raw, 1)) + 10) / (size + 10))), float(np.log1p(n / max(len(full), 1))),
        share(sum(w[:1].isupper() for w in words), n)]


def sums(texts: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of the statistics, by class, of rows (text, y)."""
    d = len(FEATURES)

    def part(batches):
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            for y in (0, 1):
                x = np.array([statistics(t) for t in b["text"][b["y"] == y]]).reshape(-1, d)
                total[y] += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).reshape(-1)])
        yield pd.DataFrame({"y": [0, 1], "v": list(total)})

    rows = texts.mapInPandas(part, "y int, v array<double>").select("y", F.posexplode("v").alias("at", "v")).groupBy("y", "at").agg(
        F.sum("v").alias("v")).collect()
    out = {y: np.zeros(1 + d + d * d) for y in (0, 1)}
    for r in rows:
        out[r["y"]][r["at"]] = r["v"]
    return {y: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for y, v in out.items()}


class Discriminant:
    """Class means, inverse Cholesky factors and constants; ``None`` factors if a class has no spread to learn."""

    def __init__(self, parts: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = SHRINK, ridge: float = RIDGE):
        n = {y: p[0] for y, p in parts.items()}
        total = n[0] + n[1]
        self.share = n[1] / total if total else 0.0
        self.factors = None
        if min(n.values()) < 2:
            return
        mean = {y: s / n[y] for y, (_, s, _) in parts.items()}
        scatter = {y: o - n[y] * np.outer(mean[y], mean[y]) for y, (_, _, o) in parts.items()}
        pooled = (scatter[0] + scatter[1]) / max(total - 2, 1)
        floor = ridge * np.eye(len(pooled)) * max(np.trace(pooled) / len(pooled), 1e-9)
        self.factors = {}
        for y in (0, 1):
            # little data leans on the pooled covariance more
            part = min(1.0, shrink + len(pooled) / (n[y] + len(pooled)))
            lower = np.linalg.cholesky((1 - part) * scatter[y] / max(n[y] - 1, 1) + part * pooled + floor)
            constant = float(np.log(n[y] / total) - np.log(np.diag(lower)).sum())
            self.factors[y] = (mean[y], np.linalg.inv(lower), constant)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.factors is None:
            return np.full(len(x), self.share)
        log = {}
        for y, (mean, inverse, constant) in self.factors.items():
            log[y] = constant - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        folds: int = FOLDS, held_out: int = HELD_OUT) -> Discriminant:
    """Learn from rows of ``labels`` whose remainder is not ``held_out``."""
    known, _ = labelled(labels, id_col, label_col, folds, held_out, FIT_ROWS)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return Discriminant(sums(texts.join(F.broadcast(known), "id").select("text", "y")))


def score(docs: DataFrame, model: Discriminant, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` added (underscores in front if the name is there already)."""
    (name,) = fresh(docs, "score")

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))))

    return docs.withColumn(name, scored(F.col(text_col)))
