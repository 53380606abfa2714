"""The heat map of two annotators: full matrix rows on request, matched cells for a corpus."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions.text import fact_text
from factloom.operators import encode
from factloom.operators.align import SCOPE
from factloom.operators.encode import gram_weights, product, sparse_vectors, unit_length


def matrix_rows(facts: DataFrame, annotator_a: str, annotator_b: str) -> DataFrame:
    """One row per fact of the first annotator with its cosines, rounded to three digits.

    The vocabulary is fitted on the two shown annotators only. Meant for the documents
    a reader opens: the result holds every cell of the matrix by definition.
    """
    chosen = facts.where(F.col("annotator").isin(annotator_a, annotator_b)).select(
        *SCOPE, "annotator", "fact_id", "fact_pos", fact_text("natural_language", "subject", "predicate", "object").alias("text"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fact_pos", "fact_id"], kind="stable").reset_index(drop=True)
        left = np.flatnonzero((pdf["annotator"] == annotator_a).to_numpy())
        right = np.flatnonzero((pdf["annotator"] == annotator_b).to_numpy())
        cos = np.floor(product(sparse_vectors(pdf["text"].tolist()), left, right) * 1000 + 0.5) / 1000
        return pd.DataFrame({"guideline_version": pdf["guideline_version"].iloc[0], "doc_id": pdf["doc_id"].iloc[0],
                             "ia": np.arange(len(left)), "fact_a_id": pdf["fact_id"].to_numpy()[left], "cosines": list(cos)})

    return chosen.groupBy(*SCOPE).applyInPandas(
        run, "guideline_version string, doc_id string, ia int, fact_a_id string, cosines array<double>")


#: Cells a task may compute for one document, and how many it holds at a time; the cells of documents of more are spread over tasks.
TASK_CELLS = 100_000_000
HELD_CELLS = 2_000_000
_PART = "guideline_version string, doc_id string, fact_a_id string, fact_b_ids array<string>, cosines array<double>"


def matrix_cells(facts: DataFrame, annotator_a: str, annotator_b: str, block: int = 512) -> DataFrame:
    """All cells of the matrices in long form: (scope, fact_a_id, fact_b_id, cosine), three digits."""
    parts = matrix_parts(facts, annotator_a, annotator_b, block)
    return parts.select(*SCOPE, "fact_a_id", F.explode(F.arrays_zip("fact_b_ids", "cosines")).alias("_c")).select(
        *SCOPE, "fact_a_id", F.col("_c.fact_b_ids").alias("fact_b_id"), F.col("_c.cosines").alias("cosine"))


def matrix_parts(facts: DataFrame, annotator_a: str, annotator_b: str, block: int = 512, named: bool = True) -> DataFrame:
    """Every cell of the matrices: (scope, fact_a_id, fact_b_ids, cosines), a row of a matrix in one or more parts, three digits.

    Weights are fitted on the two shown annotators. A task takes whole documents, as many at a time as fill a batch. The
    matrices of documents of more characters than ``gram_weights`` takes or more than ``TASK_CELLS`` cells are dealt out:
    each side into blocks of about ``block`` facts by a digest of the fact id, and one task multiplies one pair of blocks, so
    a document of any size takes bounded memory per task and its cells are spread over the cluster. A fact without any
    window (empty or null text) has a row or column of zeros. A scope with one annotator has no cell. Without ``named``
    cells keep their number and order but not the ids of their columns, which are many times their size.
    """
    both = facts.where(F.col("annotator").isin(annotator_a, annotator_b)).dropna(subset=SCOPE).select(
        *SCOPE, "fact_id", (F.col("annotator") == annotator_b).alias("right"),
        F.coalesce(fact_text("natural_language", "subject", "predicate", "object"), F.lit("")).alias("text"))
    large = both.groupBy(*SCOPE).agg(F.sum(F.length("text")).alias("n"), F.count_if("right").cast("double").alias("n_b"), F.count_if(~F.col("right")).alias("n_a")).where(
        (F.col("n") > encode.TASK_CHARS) | (F.col("n_a") * F.col("n_b") > TASK_CELLS)).select(*SCOPE)
    some = not large.isEmpty()
    small = both.join(large, SCOPE, "left_anti") if some else both
    rows = encode._dealt(small.select(*SCOPE, "right", F.col("fact_id").alias("_item"), F.lower("text").alias("_text")), SCOPE)
    out = rows.mapInArrow(encode._scopes_at_a_time(SCOPE, _whole_matrices(named)), _PART)
    return out.unionByName(_spread_parts(both.join(large, SCOPE, "left_semi"), block, named)) if some else out


def _whole_matrices(named: bool):
    """Rows of the matrices of whole documents."""
    def work(rows: pa.Table) -> pa.Table:
        held = encode._Items(rows, SCOPE)
        ids, item = rows.column("_item").combine_chunks(), np.array(held.item, np.int64)
        known = ~ids.is_null().to_numpy(zero_copy_only=False)
        text, side = held.vectors.text[item], rows.column("right").to_numpy()
        starts = encode._scope_starts(rows, SCOPE)
        found = []
        for d, (start, end) in enumerate(zip(starts, np.append(starts[1:], rows.num_rows))):
            left, right = start + np.flatnonzero(~side[start:end]), start + np.flatnonzero(side[start:end])
            if not len(right):
                continue
            step = max(1, HELD_CELLS // len(right))
            for at in range(0, len(left), step):
                here = left[at:at + step]
                cos = held.vectors.cosines(d, text[here], text[right]) * np.outer(known[here], known[right])
                found.append(_part(rows, here, ids.take(pa.array(here)), ids.take(pa.array(right)), np.floor(cos * 1000 + 0.5) / 1000, named))
        return pa.concat_tables(found) if found else pa.table({c: pa.array([], t) for c, t in _part_types().items()})

    return work


def _part_types() -> dict:
    return dict.fromkeys([*SCOPE, "fact_a_id"], pa.string()) | {"fact_b_ids": pa.list_(pa.string()), "cosines": pa.list_(pa.float64())}


def _part(rows: pa.Table, here: np.ndarray, left: pa.Array, right: pa.Array, cos: np.ndarray, named: bool) -> pa.Table:
    ends = pa.array(np.arange(cos.shape[0] + 1) * cos.shape[1], pa.int32())
    ids = pa.ListArray.from_arrays(ends, right.take(pa.array(np.tile(np.arange(cos.shape[1]), cos.shape[0])))) if named else pa.nulls(len(left), pa.list_(pa.string()))
    return pa.table({c: rows.column(c).take(pa.array(here)) for c in SCOPE} | {
        "fact_a_id": left, "fact_b_ids": ids, "cosines": pa.ListArray.from_arrays(ends, pa.array(cos.ravel()))})


def _spread_parts(both: DataFrame, block: int, named: bool) -> DataFrame:
    """``matrix_parts`` of documents of any size; windows are told apart by 64-bit digests."""
    vectors = gram_weights(both, SCOPE, "fact_id", "text").groupBy(*SCOPE, "fact_id").agg(
        F.collect_list(F.xxhash64("gram")).alias("grams"), F.collect_list("weight").alias("weights"))
    sizes = both.groupBy(*SCOPE).agg(*[F.ceil(F.count_if(F.col("right") == side) / block).cast("int").alias(n)
                                       for side, n in ((False, "n_a"), (True, "n_b"))]).where("n_a > 0 and n_b > 0")
    rows = both.drop("text").join(vectors, [*SCOPE, "fact_id"], "left").join(sizes, SCOPE)
    own = F.pmod(F.xxhash64("fact_id"), F.when(F.col("right"), F.col("n_b")).otherwise(F.col("n_a"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("right"), F.col("n_a")).otherwise(F.col("n_b")) - 1))
    dealt = rows.withColumn("_own", own).withColumn("_other", other)
    pair = [F.when(F.col("right"), F.col("_other")).otherwise(F.col("_own")).alias("block_a"),
            F.when(F.col("right"), F.col("_own")).otherwise(F.col("_other")).alias("block_b")]
    dealt = dealt.select(*SCOPE, *pair, "fact_id", "right", F.coalesce("grams", F.array().cast("array<bigint>")).alias("grams"),
                         F.coalesce("weights", F.array().cast("array<double>")).alias("weights"))

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["right"].to_numpy()
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        lengths = pdf["grams"].map(len).to_numpy()
        held, columns = np.unique(np.concatenate(list(pdf["grams"])).astype(np.int64), return_inverse=True)
        vectors = unit_length(np.repeat(np.arange(len(pdf)), lengths), np.concatenate(list(pdf["weights"])).astype(float), columns, len(pdf))
        cos = np.floor(product((*vectors, len(held)), left, right) * 1000 + 0.5) / 1000
        ids = pdf["fact_id"].to_numpy()
        return pd.DataFrame({"guideline_version": pdf["guideline_version"].iloc[0], "doc_id": pdf["doc_id"].iloc[0],
                             "fact_a_id": ids[left], "fact_b_ids": [ids[right] if named else None] * len(left), "cosines": list(cos)})

    return dealt.groupBy(*SCOPE, "block_a", "block_b").applyInPandas(multiply, _PART)


def matched_cells(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Matrix coordinates of stored matches, whichever way round a pair was stored."""
    place = F.row_number().over(W.partitionBy(*SCOPE, "annotator").orderBy("fact_pos", "fact_id")) - 1
    at = facts.select(*SCOPE, "annotator", "fact_id", place.alias("i"))
    swapped = F.col("annotator_a") > F.col("annotator_b")
    both = pairs.where("status = 'matched'").select(
        *SCOPE, F.least("annotator_a", "annotator_b").alias("annotator_a"), F.greatest("annotator_a", "annotator_b").alias("annotator_b"),
        F.when(swapped, F.col("fact_b_id")).otherwise(F.col("fact_a_id")).alias("fact_a_id"),
        F.when(swapped, F.col("fact_a_id")).otherwise(F.col("fact_b_id")).alias("fact_b_id"), "cosine", "conflict_label")
    for side in ("a", "b"):
        both = both.join(at.select(*SCOPE, F.col("fact_id").alias(f"fact_{side}_id"), F.col("i").alias(f"i{side}")), [*SCOPE, f"fact_{side}_id"])
    return both
