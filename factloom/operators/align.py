"""One-to-one alignment of the facts of every annotator pair of every document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions.rules import fixed
from factloom.functions.text import fact_text
from factloom.operators.assignment import priced_matching
from factloom.operators.encode import DocumentVectors

SCOPE = ["guideline_version", "doc_id"]
CARRY = ["subject", "predicate", "object", "natural_language", "quote"]


def _schema(carry: list[str], prices: bool = False) -> str:
    sides = ", ".join([f"{side}_{c} string" for side in ("a", "b") for c in carry] + prices * ["price_a double", "price_b double", "assigned double"])
    return ("guideline_version string, doc_id string, annotator_a string, annotator_b string, "
            "fact_a_id string, fact_b_id string, cosine double, status string" + (", " + sides if sides else ""))


def match_sides(cos: np.ndarray, threshold: float):
    """(matched row/col indices, row orphans, col orphans, row prices, col prices, assigned score per row) of one cosine matrix."""
    rows, cols, row_price, col_price = priced_matching(cos)
    assigned = np.full(cos.shape[0], np.nan)
    assigned[rows] = cos[rows, cols]
    good = cos[rows, cols] >= threshold if len(rows) else np.zeros(0, dtype=bool)
    rows, cols = rows[good], cols[good]
    return (rows, cols, np.setdiff1d(np.arange(cos.shape[0]), rows),
            np.setdiff1d(np.arange(cos.shape[1]), cols), row_price, col_price, assigned)


#: Characters of facts that are aligned at a time, of as many whole documents as hold them.
BATCH_CHARS = 250_000
#: Rows looked at for that in one go.
SLICE = 1000


def _document_starts(rows: pa.Table) -> np.ndarray:
    """Where each document begins in rows that hold one behind the other; missing ids are equal to each other."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in SCOPE:
        values = rows.column(c).combine_chunks()
        gone = values.is_null().to_numpy(zero_copy_only=False)
        values = pc.fill_null(values, "")
        new[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False) | (gone[1:] != gone[:-1])
    return np.flatnonzero(new)


def _aligned(rows: pa.Table, threshold: float, carry: list[str], dense: bool, prices: bool) -> pa.Table:
    """The pairs of whole documents that come one behind the other."""
    starts = _document_starts(rows)
    ends = np.append(starts[1:], rows.num_rows)
    if (rows.column("total").to_numpy()[starts] != ends - starts).any():
        raise RuntimeError("a document's facts came in parts")
    document = np.repeat(np.arange(len(starts)), ends - starts)
    order = pc.sort_indices(pa.table({"d": document, **{c: rows.column(c) for c in ("annotator", "fact_pos", "fact_id")}}),
                            sort_keys=[(c, "ascending") for c in ("d", "annotator", "fact_pos", "fact_id")], null_placement="at_end")
    rows = rows.take(order).combine_chunks()
    annotator = rows.column("annotator").to_pylist()
    if dense:
        given = rows.column("vector").to_pylist()
    else:
        vectors = DocumentVectors(rows.column("text").to_pylist(), document)
    found: dict[str, list] = {c: [] for c in ("names", "li", "ri", "best", "status", "price_a", "price_b", "assigned")}
    for d, (start, end) in enumerate(zip(starts.tolist(), ends.tolist())):
        own = annotator[start:end]
        names = sorted(set(own))
        if len(names) < 2:
            continue
        if dense:
            vectors = np.array(given[start:end], dtype=float)
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)
        members = {a: np.array([i for i, x in enumerate(own) if x == a]) for a in names}
        for x, a in enumerate(names):
            for b in names[x + 1:]:
                left, right = members[a], members[b]
                cos = vectors[left] @ vectors[right].T if dense else vectors.cosines(d, vectors.text[start + left], vectors.text[start + right])
                at, cols, only_a, only_b, row_price, col_price, assigned = match_sides(cos, threshold)
                n, n_a, n_b = len(at), len(only_a), len(only_b)
                none_a, none_b = np.full(n_a, -1), np.full(n_b, -1)
                found["names"].append((a, b, n + n_a + n_b))
                found["li"].append(np.concatenate([start + left[at], start + left[only_a], none_b]))
                found["ri"].append(np.concatenate([start + right[cols], none_a, start + right[only_b]]))
                found["best"].append(np.concatenate([cos[at, cols], cos[only_a].max(axis=1, initial=0.0), cos[:, only_b].max(axis=0, initial=0.0)]))
                found["status"].append(np.repeat(np.arange(3), [n, n_a, n_b]))
                if prices:
                    found["price_a"].append(np.concatenate([row_price[at], row_price[only_a], np.full(n_b, np.nan)]))
                    found["price_b"].append(np.concatenate([col_price[cols], np.full(n_a, np.nan), col_price[only_b]]))
                    found["assigned"].append(np.concatenate([assigned[at], assigned[only_a], np.full(n_b, np.nan)]))
    joined = {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in found.items() if c != "names"}
    side = {s: pa.array(joined[i], pa.int64(), mask=joined[i] < 0) for s, i in (("a", "li"), ("b", "ri"))}
    held = np.maximum(joined["li"], joined["ri"])
    out = {c: rows.column(c).take(pa.array(held)) for c in SCOPE}
    times = [n for _, _, n in found["names"]]
    for i, c in enumerate(("annotator_a", "annotator_b")):
        out[c] = pa.array([x[i] for x in found["names"]], pa.string()).take(pa.array(np.repeat(np.arange(len(times)), times)))
    for s in ("a", "b"):
        out[f"fact_{s}_id"] = rows.column("fact_id").take(side[s])
    out["cosine"] = pa.array(joined["best"], pa.float64())
    out["status"] = pa.array(["matched", "unmatched_a", "unmatched_b"]).take(pa.array(joined["status"]))
    out |= {f"{s}_{c}": rows.column(c).take(side[s]) for s in ("a", "b") for c in carry}
    if prices:
        out |= {c: pa.array(joined[c], pa.float64(), from_pandas=True) for c in ("price_a", "price_b", "assigned")}
    return pa.table(out)


def _align_documents(threshold: float, carry: list[str], dense: bool, prices: bool):
    """Rows of whole documents, one behind the other, to their pairs: of as many documents at a time as fill a batch."""
    def size(b):
        return STORED_VECTOR_CHARS * b.num_rows if dense else pc.sum(pc.utf8_length(b.column("text"))).as_py() or 0

    def run(batches):
        waiting, chars = [], 0
        for b in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            waiting.append(b)
            chars += size(b)
            if chars >= BATCH_CHARS:
                rows = pa.Table.from_batches(waiting)
                whole = int(_document_starts(rows)[-1])
                if whole:
                    yield from _aligned(rows.slice(0, whole), threshold, carry, dense, prices).combine_chunks().to_batches()
                    waiting = rows.slice(whole).combine_chunks().to_batches()
                    chars = sum(map(size, waiting))
        if waiting:
            yield from _aligned(pa.Table.from_batches(waiting), threshold, carry, dense, prices).combine_chunks().to_batches()

    return run


def align(facts: DataFrame, threshold: float = 0.78, carry: list[str] | None = None,
          vector: str | None = None, prices: bool = False) -> DataFrame:
    """Matched pairs and orphans of both sides.

    Facts travel once, keyed by document, or stay where facts dealt out by document lie; a task scores the documents of a
    batch and solves their assignments there, so neither windows nor candidate pairs are ever shuffled. The
    carried columns of both facts ride along and spare the labeller two joins.
    ``vector`` names a stored embedding column; without it TF-IDF is fitted on all
    annotators of the document together. Documents too large for one task belong to
    ``align_large``; ``align_any`` picks by size. ``prices`` adds each fact's price
    and what its assignment scored before the threshold, for ``certificate``.
    """
    carry = CARRY if carry is None else carry
    quote = F.col("source_locator.quote") if "source_locator" in facts.columns else F.lit(None).cast("string")
    text = fact_text("natural_language", "subject", "predicate", "object")
    base = facts.withColumn("quote", quote) if "quote" not in facts.columns else facts
    needed = base.select(*SCOPE, "annotator", "fact_id", "fact_pos", *carry,
                         *([F.col(vector).alias("vector")] if vector else [text.alias("text")]))
    # the window brings a document's facts together, and says how many there are
    needed = needed.withColumn("total", F.count(F.lit(1)).over(W.partitionBy(*SCOPE)))
    return needed.mapInArrow(_align_documents(threshold, carry, vector is not None, prices), _schema(carry, prices))


PAIR = [*SCOPE, "annotator_a", "annotator_b"]


def certificate(priced: DataFrame, cosines: DataFrame, slack: float = 1e-6) -> DataFrame:
    """Per annotator pair of a document: is the assignment optimal? Answered by joins, without searching again.

    ``priced`` comes from ``align(prices=True)``, ``cosines`` has (pair, fact_a_id, fact_b_id, cosine) for every pair of
    facts, from anywhere but the solver. ``n_violations`` counts pairs that score above their two prices, matched pairs
    that miss theirs, unassigned facts with a price and negative prices of facts that may stay alone; ``gap`` is what
    all prices exceed the assigned scores by. No violation and no gap prove the optimum.
    """
    # the solver's own numbers are NaN where a row has no such side
    num = lambda c: F.when(~F.isnan(c), F.col(c))
    rows = priced.select(*PAIR, "fact_a_id", "fact_b_id", "status", num("price_a").alias("price_a"), num("price_b").alias("price_b"), num("assigned").alias("assigned"))
    side = lambda s: rows.where(F.col(f"fact_{s}_id").isNotNull()).select(*PAIR, f"fact_{s}_id", f"price_{s}")
    scored = cosines.join(side("a"), [*PAIR, "fact_a_id"]).join(side("b"), [*PAIR, "fact_b_id"])
    chosen = rows.where("status = 'matched'").select(*PAIR, "fact_a_id", "fact_b_id", F.lit(True).alias("chosen"))
    scored = scored.join(chosen, [*PAIR, "fact_a_id", "fact_b_id"], "left")
    over = F.col("cosine") - F.col("price_a") - F.col("price_b")
    pairs = scored.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_pairs"),
                                      F.count_if((over > slack) | (F.col("chosen") & (over < -slack))).alias("bad_pairs"))
    sums = rows.groupBy(*PAIR).agg(
        F.count("fact_a_id").alias("n_a"), F.count("fact_b_id").alias("n_b"), F.count("assigned").alias("n_assigned"), F.sum("assigned").alias("total"),
        (F.coalesce(F.sum("price_a"), F.lit(0.0)) + F.coalesce(F.sum("price_b"), F.lit(0.0)) - F.coalesce(F.sum("assigned"), F.lit(0.0))).alias("gap"),
        F.min("price_a").alias("least_a"), F.min("price_b").alias("least_b"))
    longer_negative = ((F.col("n_a") > F.col("n_b")) & (F.col("least_a") < -slack)) | ((F.col("n_b") > F.col("n_a")) & (F.col("least_b") < -slack))
    short = F.col("n_assigned") != F.least("n_a", "n_b")
    return sums.join(pairs, PAIR, "left").select(
        *PAIR, "n_a", "n_b", "n_assigned", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), F.coalesce("total", F.lit(0.0)).alias("total"),
        (F.coalesce("bad_pairs", F.lit(0)) + longer_negative.cast("long") + short.cast("long")).alias("n_violations"),
        F.when(F.abs("gap") > slack, F.col("gap")).otherwise(F.lit(0.0)).alias("gap"))


def orphans_of_empty_sides(facts: DataFrame, roster: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Orphans where an announced annotator has no fact in a document; their cosine is null, as there was nobody to compare with.

    ``roster`` has (scope, annotator) of everybody who was asked. A document of two silent annotators has no facts and gives
    no rows. Columns are those of ``align``; ``carry`` is empty unless stated.
    """
    carry = carry or []
    base = facts if "quote" in facts.columns or "quote" not in carry else facts.withColumn("quote", F.col("source_locator.quote"))
    present = facts.select(*SCOPE, "annotator").distinct()
    silent = roster.select(*SCOPE, "annotator").distinct().join(present, [*SCOPE, "annotator"], "left_anti")
    silent = silent.withColumnRenamed("annotator", "other")
    rows = base.select(*SCOPE, "annotator", "fact_id", *carry).join(silent, SCOPE)
    first = F.col("annotator") < F.col("other")
    return rows.select(
        *SCOPE, F.least("annotator", "other").alias("annotator_a"), F.greatest("annotator", "other").alias("annotator_b"),
        F.when(first, F.col("fact_id")).alias("fact_a_id"), F.when(~first, F.col("fact_id")).alias("fact_b_id"),
        F.lit(None).cast("double").alias("cosine"), F.when(first, F.lit("unmatched_a")).otherwise(F.lit("unmatched_b")).alias("status"),
        *[F.when(first, F.col(c)).alias(f"a_{c}") for c in carry], *[F.when(~first, F.col(c)).alias(f"b_{c}") for c in carry])


def annotator_pairs(facts: DataFrame) -> DataFrame:
    """Unordered annotator pairs per document: the skeleton of agreement tables."""
    seen = facts.groupBy(*SCOPE).agg(F.array_sort(F.collect_set("annotator")).alias("names"))
    pair = F.flatten(F.transform("names", lambda a, i: F.transform(
        F.slice("names", i + 2, F.greatest(F.size("names"), F.lit(1))), lambda b: F.struct(a.alias("annotator_a"), b.alias("annotator_b")))))
    return seen.select(*SCOPE, F.explode(pair).alias("p")).select(*SCOPE, "p.*")


def orphan_reason(threshold: float):
    """Why a fact stayed alone; states the real cause when its best partner was good enough."""
    best = fixed("cosine", 3)
    return F.when(F.col("cosine") < threshold, F.concat(F.lit("best partner cosine="), best, F.lit(f" < {threshold}"))).otherwise(
        F.concat(F.lit("best partner cosine="), best, F.lit(", assigned elsewhere")))


def persisted(pairs: DataFrame) -> DataFrame:
    """Stored form of a pair table: ids, four-digit cosine, labels and reasons."""
    return pairs.select(*SCOPE, "annotator_a", "annotator_b", "fact_a_id", "fact_b_id",
                        F.round("cosine", 4).alias("cosine"), "status", "conflict_label",
                        "layer1_reason", "layer2_reason")




# --- documents that outgrow a task ------------------------------------------

TASK_CHARS = 8_000_000  # statement text one task may hold for one document
STORED_VECTOR_CHARS = 500  # what a fact with a stored vector counts for


def align_any(facts: DataFrame, threshold: float = 0.78, carry: list[str] | None = None, vector: str | None = None,
              largest_document: int | None = None) -> DataFrame:
    """Align every document, routing each by its size.

    ``largest_document`` is a proven bound on the characters of any document's facts;
    when it fits a task no measuring pass is needed. Otherwise sizes are measured and
    only oversized documents take the distributed route.
    """
    if largest_document is not None and largest_document <= TASK_CHARS:
        return align(facts, threshold, carry, vector)
    text = fact_text("natural_language", "subject", "predicate", "object")
    size = F.lit(STORED_VECTOR_CHARS) if vector else F.length(text)
    oversized = facts.groupBy(*SCOPE).agg(F.sum(size).alias("n_chars")).where(
        F.col("n_chars") > TASK_CHARS).select(*SCOPE)
    if oversized.isEmpty():
        return align(facts, threshold, carry, vector)
    ordinary = align(facts.join(oversized, SCOPE, "left_anti"), threshold, carry, vector)
    from factloom.operators.align_large import align_large
    if vector is not None:
        raise ValueError("oversized documents are aligned on TF-IDF vectors; raise TASK_CHARS to use stored vectors")
    large = align_large(facts.join(oversized, SCOPE, "left_semi"), threshold, carry)
    return ordinary.unionByName(large)
