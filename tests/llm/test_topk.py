import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import topk


def brute(rows, k):
    good = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in good:
        if i % 100 == 0:
            asked[i] = min(asked.get(i, (len(v), v)), (len(v), v))
    out = []
    for q, (_, v) in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 64)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(6, 12))
    rows = [(i, [float(np.float32(x)) for x in (centre[i % 6] + 0.2 * rng.normal(size=12)) * rng.choice([0.1, 1, 3])]) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # one very common vector
    rows += [(1300, None), (None, rows[1][1]), (1400, [None] * 12), (1401, [float("nan")] * 12), (1402, [float("inf")] * 12),
             (1500, []), (1501, []), (1600, [1.0, 2.0]), (1601, [1.0, -2.0]), (1700, [0.0] * 12), (5, rows[5][1]), (100, rows[3][1])]
    df = spark.createDataFrame([(a, b, "x", 1.0) for a, b in rows], "vec_id long, embedding array<float>, score string, rank double")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("id") % 100 == 0).collect())
    assert got == brute(rows, 10)
    assert topk.top_k(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_pruning_keeps_every_reachable_vector():
    rng = np.random.default_rng(2)
    v = np.floor(1024 * rng.normal(size=(300, 8))).astype(np.int64)
    v = np.vstack([v, v[:3] * 2, v[:1]])
    b = topk.Bucket(np.arange(len(v)), v)
    for q in v[:40]:
        scores = topk.product(q[None, :], b.vectors)[0]
        for share in (0.2, 0.5, 0.7, 0.9, 1.0, 1.1):
            bound = float(scores.max()) * share
            assert set(np.flatnonzero(scores >= bound)) <= set(b.feasible(q, bound).tolist())


def test_exact_beyond_doubles():
    a = np.array([[2**40, 3]])
    assert topk.product(a, np.array([[2**20, 7]]))[0, 0] == 2**60 + 21
    with pytest.raises(OverflowError):
        topk.product(np.array([[2**40]]), np.array([[2**40]]))
