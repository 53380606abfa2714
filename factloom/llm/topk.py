"""Exact top-k inner products by norm-bucketed retrieval.

Components are scaled to integers, so products are exact. Candidates are dealt
into buckets of similar length (a range partition by dimension and norm). A
first pass over the bucket of the longest vectors gives every query a sure lower
bound for its k-th score. In the second pass each bucket turns that bound into a
local cosine threshold: where it is high, the bucket's sorted lists of one
coordinate give the only vectors that can reach it; where it is low, vectors too
short to reach it are cut off at the bucket's end. What is left is verified with
integer products. Queries meet the buckets in blocks; each pair of block and
bucket is one task, which returns k rows per query at most.

Defined cases: vectors that are null, hold null or non-finite components, or have
a null id take no part; vectors of different dimension are not compared; an
empty vector has the score 0 with another empty one; rows with the query's own
id are not its candidates; of queries with equal ids the least vector asks; equal
candidate rows rank side by side; scores beyond 64 bits raise an error; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut

K, SCALE, EVERY = 10, 1024, 100
#: Queries of a block, and candidates of a bucket at most.
BLOCK, BUCKET = 2048, 8192
#: From this local cosine threshold on, a coordinate prunes more than the length.
COORDINATE_FROM = 0.6


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """The integer vector, null if a component is null or not finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of two matrices."""
    most = float(np.abs(left.astype(np.float64)).max(initial=0)) * float(np.abs(right.astype(np.float64)).max(initial=0)) * max(left.shape[1], 1)
    if most < 2**53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    out = left.astype(object) @ right.astype(object).T
    return np.array([[_long(x) for x in row] for row in out.tolist()], dtype=np.int64).reshape(len(left), len(right))


def _long(x: int) -> int:
    if not -(2**63) <= x < 2**63:
        raise OverflowError("an inner product does not fit 64 bits")
    return x


class Bucket:
    """Vectors of similar length, longest first, with sorted coordinates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        order = np.lexsort((ids, -norms))
        self.ids, self.vectors, self.norms = ids[order], vectors[order], norms[order]
        unit = self.vectors / np.maximum(self.norms, 1e-300)[:, None]
        self.by_coordinate = np.argsort(unit, axis=0, kind="stable") if len(ids) and vectors.shape[1] else None
        self.sorted = np.take_along_axis(unit, self.by_coordinate, axis=0) if self.by_coordinate is not None else None

    def feasible(self, query: np.ndarray, bound: float) -> np.ndarray:
        """Positions of all vectors whose product with ``query`` can reach ``bound``."""
        length, slack = float(np.sqrt((query.astype(np.float64) ** 2).sum())), 1e-9
        if bound <= 0 or length == 0 or self.sorted is None:
            return np.arange(len(self.ids)) if bound <= 0 else np.arange(0)
        cosine = bound / (length * self.norms[0]) if self.norms[0] > 0 else np.inf
        if cosine > 1 + slack:
            return np.arange(0)
        if cosine < COORDINATE_FROM:
            return np.arange(np.searchsorted(-self.norms, -(bound / length) * (1 - slack), side="right"))
        # a unit vector within the angle of the threshold has each coordinate within that angle of the query's
        q = query / length
        spread = np.sqrt(np.maximum(0, 1 - q**2)) * np.sqrt(max(0.0, 1 - cosine**2))
        best = None
        for at in np.argsort(-np.abs(q))[:4]:
            lo, hi = np.searchsorted(self.sorted[:, at], [q[at] * cosine - spread[at] - 1e-7, q[at] * cosine + spread[at] + 1e-7])
            if q[at] > cosine:
                hi = len(self.ids)
            elif -q[at] > cosine:
                lo = 0
            if best is None or hi - lo < best[1] - best[0]:
                best = (lo, hi, at)
        return np.sort(self.by_coordinate[best[0] : best[1], best[2]])

    def top(self, query_id: int, query: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k``, ties to the smaller id, of those that reach ``bound``."""
        at = self.feasible(query, bound)
        at = at[self.ids[at] != query_id]
        if not len(at):
            return self.ids[:0], self.ids[:0]
        scores = product(query[None, :], self.vectors[at])[0]
        if len(at) > k:
            keep = scores >= np.partition(scores, len(at) - k)[len(at) - k]
            at, scores = at[keep], scores[keep]
        if bound > -np.inf:
            keep = scores >= bound
            at, scores = at[keep], scores[keep]
        order = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at][order], scores[order]


def top_k(vectors: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows for which ``asks`` (over column ``id``) holds."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col), scale).alias("v")).where("id is not null and v is not null")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = rows.select("id", "v", F.size("v").alias("dim"), squares.alias("norm"))
    n = rows.count()
    dealt = rows.repartitionByRange(max(1, -(-2 * n // BUCKET)), "dim", F.desc("norm"), "id").withColumn("bucket", F.spark_partition_id())
    dealt = cut(dealt)
    queries = dealt.where(asks).groupBy("id", "dim").agg(F.min("v").alias("v"))
    queries = queries.groupBy("id").agg(F.min(F.struct("dim", "v")).alias("x")).select("id", "x.dim", "x.v")
    blocks = max(1, -(-queries.count() // BLOCK))
    queries = cut(queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")))

    def search(_, held, asking):
        out = []
        if len(held) and len(asking):
            width = int(held["dim"].iloc[0])
            bucket = Bucket(held["id"].to_numpy(), np.array(held["v"].tolist(), dtype=np.int64).reshape(len(held), width))
            for q, v, bound in zip(asking["q_id"].tolist(), asking["q_v"], asking["q_bound"].tolist()):
                ids, scores = bucket.top(q, np.asarray(v, dtype=np.int64), bound, k)
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)

    def found(candidates: DataFrame, asking: DataFrame) -> DataFrame:
        """Each block of queries meets each bucket of its dimension."""
        every = candidates.select("bucket", "dim").distinct()
        left = candidates.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = asking.join(every, "dim").select(F.col("bucket").alias("q_bucket"), F.col("block").alias("q_block"), F.col("dim").alias("q_dim"),
                                                 F.col("id").alias("q_id"), F.col("v").alias("q_v"), F.col("bound").alias("q_bound"))
        return left.groupBy("bucket", "block", "dim").cogroup(right.groupBy("q_bucket", "q_block", "q_dim")).applyInPandas(
            search, "query_id long, vec_id long, score long")

    longest = dealt.join(dealt.groupBy("dim").agg(F.min("bucket").alias("bucket")), ["dim", "bucket"])
    first = found(longest, queries.withColumn("bound", F.lit(float("-inf"))))
    bounds = first.groupBy(F.col("query_id").alias("id")).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    bounded = cut(queries.join(bounds, "id", "left").select(
        "id", "dim", "v", "block", F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(F.lit(float("-inf"))).alias("bound")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found(dealt, bounded).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
