"""Selecting documents in source order until enough are acceptable, with resume.

Judging a document means parsing it, so no more of the source is parsed than the
selection needs. The source order is cut into ranges by a scan of the order column
alone. Ranges are judged in waves, each twice as many as the one before, until
the accepted ones suffice; a filter on the range reaches the reader, which skips the
texts of all others. Inside the judged ranges a running sum of accepted documents
says which rows come before the stop, without sorting them into one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.scan import PART_ROWS, dealt, scanned
from factloom.session import checkpoint

#: Ranges of the source order that waves are made of.
RANGES = 64


def _cuts(candidates: DataFrame, index: str, ranges: int) -> list:
    """At most ``ranges - 1`` distinct values that part the source order into ranges of similar size."""
    if ranges < 2:
        return []
    at = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    found = candidates.agg(F.percentile_approx(index, at, 10_000).alias("c")).first()["c"]
    return sorted(set(found or []))


def select_until(candidates: DataFrame, manifest: DataFrame, need: int, judge: Callable[[DataFrame], DataFrame], index: str = "source_index",
                 doc_id: str = "doc_id", ranges: int = RANGES, part_rows: int = PART_ROWS) -> DataFrame:
    """Every candidate looked at up to the one that completes ``need``, with ``accepted``; the rest was never parsed.

    ``judge`` adds ``reason`` (empty: acceptable, null counts as a rejection without words) to rows of ``candidates``,
    keeps ``index`` and ``doc_id`` and drops what the selection does not need. Candidates that the ``manifest`` names are
    passed over and do not count, so a selection resumes where it stopped.

    Equal places in the source order are told apart by id; rows without a place come last; a null id is never in
    a manifest; repeated candidates are judged each. Too few acceptable ones return all candidates. ``need`` of
    zero or less, or an empty table, gives no rows.
    """
    fresh = candidates.join(manifest.select(doc_id).distinct(), doc_id, "left_anti")
    if need <= 0:
        return judge(fresh.where("false")).withColumn("accepted", F.lit(True))
    cuts, place = _cuts(candidates, index, ranges), F.col(index)
    n_ranges, at, step, taken, judged = len(cuts) + 2, 0, 1, 0, None  # the last one holds rows without a place
    while at < n_ranges and taken < need:
        end = min(at + step, n_ranges)
        inside = place.isNull() if at == n_ranges - 1 else F.lit(True)
        if at < n_ranges - 1:
            if at:
                inside = inside & (place > cuts[at - 1])
            if end <= len(cuts):
                inside = inside & (place <= cuts[end - 1])
            inside = inside & place.isNotNull() if end < n_ranges else inside | place.isNull()
        wave = checkpoint(judge(fresh.where(inside)).withColumn("accepted", F.coalesce(F.col("reason") == "", F.lit(False))))
        taken += wave.where("accepted").count()
        judged = wave if judged is None else judged.unionByName(wave)
        at, step = end, 2 * step
    placed = judged.withColumn("_late", place.isNull())
    order = ["_late", index, doc_id]
    before = scanned(dealt(placed, [], order, part_rows), [], order, _before=("sum", F.col("accepted").cast("long")))
    return before.where(F.col("_before") < need).select(*judged.columns)


def manifest_rows(selected: DataFrame, document: str = "document") -> DataFrame:
    """What a manifest says of each accepted document, from a ``judge`` that kept the parsed one."""
    d = F.col(document)
    return selected.where("accepted").select(
        d["celex"].alias("doc_id"), d["title"].alias("title"), "n_words",
        (F.length(d["preamble_text"]) + F.length(d["enacting_text"])).alias("char_length"), F.size(d["recitals"]).alias("recital_count"),
        F.size(d["articles"]).alias("article_count"), F.size(d["citations"]).alias("citation_count"))
