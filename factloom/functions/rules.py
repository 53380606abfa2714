"""Deterministic labelling expressions: text flags, overlap, numbers, polarity, severity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import _col, collapse_lower, let, text_or_empty

# Label vocabulary and severities.
LABELS = ["contradiction", "granularity", "redundancy", "no_conflict", "unlabeled"]
SHIFT_LABELS = ["contradiction", "granularity", "redundancy", "unlabeled"]
SEVERITY = {"contradiction": 4, "granularity": 3, "redundancy": 2, "no_conflict": 1,
            "unlabeled": 0, "escalate": 0}
ARBITER_LABELS = ["CONTRADICTION", "GRANULARITY", "REDUNDANCY", "NO_CONFLICT"]
LOGIC_OPERATORS = ["AND", "OR", "XOR"]

# Text cues.
CONDITION_CUE = r"\b(if|when|unless|provided that|subject to|in the event|conditional upon)\b"
NEGATION_CUE = r"\b(not|no longer|never|without|fails? to|shall not|may not|cannot)\b"
MODALITY_CUE = r"\b(alleged(?:ly)?|reportedly|according to|claims? that|is said to)\b"
COMPLEXITY_CUE = (r"\b(either|or else|whether|all of|each of|none of|any of|"
                  r"if and only if|implies)\b")
POLARITY_MARKERS = ("not", "no", "never", "without", "fails", "failed", "unable")
NUMBER = r"\d+[,.]?\d*"
PERCENT = r"\d+[,.]?\d+\s*%"
CITATION_NO = r"(?i)\bno\.?\s*\d"


@dataclass(frozen=True)
class RuleConfig:
    """Tunables of the rule labeller."""

    redundancy_cosine: float = 0.95
    overlap_threshold: float = 0.75
    polarity_markers: tuple[str, ...] = POLARITY_MARKERS


def _cue(text, pattern: str) -> Column:
    return text_or_empty(text).rlike("(?i)" + pattern)


def is_conditional(condition, text) -> Column:
    return (text_or_empty(condition) != "") | _cue(text, CONDITION_CUE)


def is_negated(text) -> Column:
    return _cue(text, NEGATION_CUE)


def is_complex(text) -> Column:
    return _cue(text, COMPLEXITY_CUE)


def modality(text) -> Column:
    return F.when(_cue(text, MODALITY_CUE), F.lit("alleged")).otherwise(F.lit("asserted"))


def trigrams(c) -> Column:
    """Distinct three-character windows; a look-ahead keeps the scan linear in the text."""
    return F.array_distinct(F.regexp_extract_all(collapse_lower(c), F.lit("(?s)(?=(.{3}))."), F.lit(1)))


def trigram_jaccard(a, b) -> Column:
    """Overlap of two texts; equal texts, the usual case, need no windows at all."""
    return F.when(_col(a) == _col(b), F.lit(1.0)).otherwise(jaccard_of(trigrams(a), trigrams(b)))


def jaccard_of(left, right) -> Column:
    def ratio(x):
        a, b, shared = F.size(x["a"]), F.size(x["b"]), F.size(F.array_intersect(x["a"], x["b"]))
        return (F.when((a == 0) & (b == 0), F.lit(1.0)).when((a == 0) | (b == 0), F.lit(0.0))
                .otherwise(shared / (a + b - shared)))

    return let(F.struct(_col(left).alias("a"), _col(right).alias("b")), ratio)


def numbers(c) -> Column:
    return F.regexp_extract_all(text_or_empty(c), F.lit(f"({NUMBER})"), F.lit(1))


def polarity_tokens(c, markers: tuple[str, ...] = POLARITY_MARKERS) -> Column:
    scrubbed = F.regexp_replace(text_or_empty(c), CITATION_NO, " ")
    tokens = F.transform(F.regexp_extract_all(scrubbed, F.lit("([A-Za-z]+)"), F.lit(1)), F.lower)
    return F.array_sort(F.array_intersect(tokens, F.array(*[F.lit(m) for m in markers])))


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def severity(label) -> Column:
    """Rank of a label; unknown labels rank below everything."""
    expr = F.lit(-1)
    for name, rank in SEVERITY.items():
        expr = F.when(_col(label) == name, F.lit(rank)).otherwise(expr)
    return expr


def strongest(labels) -> Column:
    """Most severe label of an array; an empty array is unlabeled."""
    ranked = F.transform(_col(labels), lambda l: F.struct(severity(l).alias("rank"), l.alias("label")))
    return F.coalesce(F.array_max(ranked)["label"], F.lit("unlabeled"))


def fixed(x, digits: int) -> Column:
    """Half-up text rendering with a fixed number of digits."""
    scale = 10 ** digits
    return F.format_string(f"%.{digits}f", F.floor(_col(x) * scale + 0.5) / scale)


def quoted_list(items: Column, empty: str = "[]") -> Column:
    body = F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    return F.when(F.size(items) == 0, F.lit(empty)).otherwise(
        F.concat(F.lit("["), body, F.lit("]")))


def percent_claims(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(text_or_empty(c), F.lit(f"({PERCENT})"), F.lit(1)))


def stub_verdict(prompt) -> Column:
    """Offline stand-in for the arbiter model, judged on the text it is given."""
    low = F.lower(text_or_empty(prompt))
    return (F.when(F.size(percent_claims(prompt)) >= 2, F.lit("CONTRADICTION"))
            .when(low.contains("split") | low.contains("qualified"), F.lit("GRANULARITY"))
            .otherwise(F.lit("REDUNDANCY")))
