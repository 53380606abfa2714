import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facts import fact
from factloom.operators import align as A
from factloom.operators import encode as E
from factloom.operators import entities as N
from factloom.operators.align_large import align_large
from factloom.operators.assignment import best_matching, priced_matching
from factloom.plans import phase2

WORDS = "council commission deficit measures report deadline decision member state budget growth target".split()


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_matching_is_optimal(n, m, seed):
    score = np.round(np.random.default_rng(seed).random((n, m)), 1)
    rows, cols = best_matching(score)
    k = min(n, m)
    assert len(rows) == k and len(set(rows)) == k and len(set(cols)) == k
    best = max(sum(score[i, j] for i, j in zip(r, c)) for r in itertools.combinations(range(n), k) for c in itertools.permutations(range(m), k))
    assert abs(score[rows, cols].sum() - best) < 1e-9


def sample(seed, n_docs=3, n=14):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(n_docs):
        base = [" ".join(rng.choice(WORDS, 5)) for _ in range(n)] + ["the same line again"] * 5
        for annotator in ("ann_a", "ann_b", "ann_c"):
            for i, text in enumerate(base):
                words = text.split()
                if rng.random() < 0.4:
                    words[int(rng.integers(len(words)))] = str(rng.choice(WORDS))
                if rng.random() < 0.85:
                    rows.append(fact(annotator, f"{annotator}{d}x{i}", words[0], words[1], " ".join(words[2:]), doc=f"d{d}", pos=i))
    return rows


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 7), st.integers(0, 7), st.integers(0, 10_000))
def test_prices_prove_the_matching(n, m, seed):
    score = np.round(np.random.default_rng(seed).random((n, m)) * 2 - 0.7, 1)
    rows, cols, u, v = priced_matching(score)
    assert len(u) == n and len(v) == m and (u[:, None] + v[None, :] >= score - 1e-9).all()
    assert np.allclose(u[rows] + v[cols], score[rows, cols]) and abs(u.sum() + v.sum() - score[rows, cols].sum()) < 1e-9 or not score.size
    if score.size and n != m:
        longer, at = (u, rows) if n > m else (v, cols)
        assert (longer >= -1e-9).all() and np.allclose(np.delete(longer, at), 0)


def test_certificate_finds_a_wrong_assignment(make_facts):
    facts = make_facts(sample(2, n_docs=2))
    priced = A.align(facts, 0.6, carry=[], prices=True).cache()
    plain = A.align(facts, 0.6, carry=[])
    assert priced.select(*plain.columns).exceptAll(plain).isEmpty() and plain.exceptAll(priced.select(*plain.columns)).isEmpty()
    weights = E.gram_weights(facts.withColumn("key", F.concat("annotator", F.lit("/"), "fact_id")), A.SCOPE, "key", "natural_language")
    every = A.annotator_pairs(facts).alias("p").join(facts.select(*A.SCOPE, F.col("annotator").alias("annotator_a"), F.col("fact_id").alias("fact_a_id")), [*A.SCOPE, "annotator_a"]).join(
        facts.select(*A.SCOPE, F.col("annotator").alias("annotator_b"), F.col("fact_id").alias("fact_b_id")), [*A.SCOPE, "annotator_b"])
    every = every.withColumns({"ka": F.concat("annotator_a", F.lit("/"), "fact_a_id"), "kb": F.concat("annotator_b", F.lit("/"), "fact_b_id")})
    cosines = E.cosine_of_pairs(every, weights, A.SCOPE, "key", "ka", "kb").drop("ka", "kb", "dot").cache()
    good = A.certificate(priced, cosines).collect()
    assert len(good) == 6 and all(r.n_violations == 0 and r.gap == 0 and r.n_pairs == r.n_a * r.n_b for r in good)
    # a better partner that the assignment has not seen, and a price too high, are both found
    better = cosines.withColumn("cosine", F.when((F.col("fact_a_id") == cosines.first().fact_a_id), F.lit(2.5)).otherwise(F.col("cosine")))
    assert any(r.n_violations for r in A.certificate(priced, better).collect())
    dear = A.certificate(priced.withColumn("price_a", F.col("price_a") + 1), cosines).collect()
    assert all(r.gap > 0 and (r.n_violations or not r.n_assigned) for r in dear if r.n_a)


def test_three_matches_and_orphans(make_facts):
    rows = [fact("A", "a1", "the Council", "adopted", "the decision"), fact("A", "a2", "the deficit", "was", "2,3 % of GDP"),
            fact("A", "a3", "the Commission", "made a recommendation", ""),
            fact("B", "b1", "the Council", "adopted", "the decision"), fact("B", "b2", "the deficit", "was", "2,8 % of GDP"),
            fact("B", "b3", "the Commission", "issued a recommendation", "")]
    out = A.align(make_facts(rows), 0.5).collect()
    assert {(r.fact_a_id, r.fact_b_id) for r in out if r.status == "matched"} == {("a1", "b1"), ("a2", "b2"), ("a3", "b3")}
    strict = A.align(make_facts(rows), 0.999999).collect()
    assert sum(r.status == "matched" for r in strict) == 1
    assert sum(r.status == "unmatched_a" for r in strict) == sum(r.status == "unmatched_b" for r in strict) == 2


def test_third_annotator_gives_three_pairs(make_facts):
    rows = [fact(a, f"{a}{i}", "s", "p", f"o{i}") for a in ("A", "B", "C") for i in range(3)]
    assert A.annotator_pairs(make_facts(rows)).count() == 3
    assert {(r.annotator_a, r.annotator_b) for r in A.align(make_facts(rows), 0.5).collect()} == {("A", "B"), ("A", "C"), ("B", "C")}


def test_empty_side_gives_orphans_without_cosine(spark, make_facts):
    facts = make_facts([fact("A", f"a{i}", "s", "p", "o") for i in range(3)])
    roster = spark.createDataFrame([("v1", "d1", "A"), ("v1", "d1", "B")], "guideline_version string, doc_id string, annotator string")
    out = A.orphans_of_empty_sides(facts, roster).collect()
    assert len(out) == 3 and {(r.status, r.cosine) for r in out} == {("unmatched_a", None)}


def test_roster_reaches_the_whole_run(spark, make_facts):
    """A document whose second annotator found nothing is compared; without the roster it is refused."""
    facts = make_facts([fact("A", f"a{i}", "s", "p", "o") for i in range(3)] + [fact(a, f"{a}{i}", "the council", "met", f"day {i}", doc="d2") for a in ("A", "B") for i in range(2)])
    roster = spark.createDataFrame([("v1", d, a) for d in ("d1", "d2", "d3") for a in ("A", "B", "C")], "guideline_version string, doc_id string, annotator string")
    plain = phase2.run(facts)["pairs"].collect()
    assert {r.doc_id for r in plain} == {"d2"}
    out = phase2.run(facts, roster=roster)
    rows = out["pairs"].collect()
    silent = [(r.doc_id, r.annotator_a, r.annotator_b, r.fact_a_id, r.status, r.layer1_reason) for r in rows if r.layer1_reason == "orphan_unmatched_a"]
    assert len(silent) == 6 + 4 and len(rows) == len(plain) + len(silent)
    assert {(d, a, b) for d, a, b, *_ in silent} == {("d1", "A", "B"), ("d1", "A", "C"), ("d2", "A", "C"), ("d2", "B", "C")}
    assert {r.n_facts for r in out["graph_edges"].where("doc_id = 'd1'").collect()} == {3}


def test_native_and_task_weights_agree(make_facts):
    facts = make_facts(sample(1, n_docs=1))
    native = E.gram_weights(facts, ["doc_id"], "fact_id", "natural_language").toPandas()
    local = facts.orderBy("fact_id").toPandas()
    rows, cols, values, _ = E.sparse_vectors(local["natural_language"].tolist())
    sums = np.bincount(rows, weights=values)
    want = native.groupby("fact_id")["weight"].sum().reindex(local["fact_id"]).to_numpy()
    assert np.allclose(sums, want)


@pytest.mark.parametrize("seed", [3, 4])
def test_large_route_equals_task_route(make_facts, seed):
    facts = make_facts(sample(seed))
    for threshold in (0.0, 0.6):
        small = A.align(facts, threshold, carry=["subject"]).toPandas()
        large = align_large(facts, threshold, carry=["subject"], block=4).toPandas()
        assert sorted(small.columns) == sorted(large.columns)
        if threshold == 0.0:  # everything assigned: totals must be equal, ties may differ
            key = ["doc_id", "annotator_a", "annotator_b", "status"]
            a, b = (x.groupby(key)["cosine"].agg(["count"]).sort_index() for x in (small, large))
            assert a.equals(b)
            a, b = (x[x.status == "matched"].groupby(key[:3])["cosine"].sum().sort_index() for x in (small, large))
            assert np.allclose(a, b)
        for side in ("a", "b"):  # each fact of a pair appears exactly once
            ids = large.dropna(subset=[f"fact_{side}_id"]).groupby(["annotator_a", "annotator_b"])[f"fact_{side}_id"]
            assert (ids.nunique() == ids.size()).all()
        orphan = large[large.status != "matched"]
        joined = orphan.merge(small[small.status != "matched"], on=["annotator_a", "annotator_b", "fact_a_id", "fact_b_id"])
        assert np.allclose(joined.cosine_x, joined.cosine_y)


def test_oversized_documents_take_the_large_route(make_facts, monkeypatch):
    facts = make_facts(sample(5, n_docs=2))
    plain = A.align(facts, 0.6, carry=[]).count()
    monkeypatch.setattr(A, "TASK_CHARS", 100)
    assert A.align_any(facts, 0.6, carry=[]).count() == plain


def brute_clusters(names, threshold):
    keys = [n.lower() for n in names]
    vectors = E.sparse_vectors(keys)
    cos = E.product(vectors, np.arange(len(keys)), np.arange(len(keys)))
    group = {n: {n} for n in names}
    for i, j in itertools.combinations(range(len(names)), 2):
        if cos[i, j] >= threshold or keys[i] == keys[j]:
            merged = group[names[i]] | group[names[j]]
            for n in merged:
                group[n] = merged
    return {frozenset(g) for g in group.values()}


@pytest.mark.parametrize("chunk", [N.CHUNK, 2])
def test_clusters_match_brute_force(make_facts, chunk):
    names = ["general government deficit", "the general government deficit", "General Government Deficit", "government deficit", "savings measure",
             "savings measures", "European Commission", "Commission of Europe", "null", "  "]
    rows = [fact("A", f"a{i}", n, "p", names[(i + 1) % len(names)]) for i, n in enumerate(names)]
    facts = make_facts(rows)
    got = N.cluster(facts, 0.6, core_entities=False, chunk=chunk).toPandas()
    clusters = {frozenset(g) for g in got.groupby("cluster_id")["surface"].agg(list)}
    assert clusters == brute_clusters([n for n in names if n.strip() and n != "null"], 0.6)


def drawn_names(seed, n, alphabet="abcde"):
    draw = random.Random(seed)
    stem = ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 7))) for _ in range(12)]
    return sorted({" ".join(draw.choice(stem) for _ in range(draw.randint(1, 6))) for _ in range(n)})


def groups_of(names, representatives):
    found = {}
    for name, r in zip(names, representatives):
        found.setdefault(r, set()).add(name)
    return {frozenset(g) for g in found.values()}


@pytest.mark.parametrize("limit", [None, 7])
@pytest.mark.parametrize("alphabet", ["abcde", "\u00e9\u0416\u4e00\U0001f600"])
def test_names_of_several_documents_in_one_task(monkeypatch, limit, alphabet):
    if limit:
        monkeypatch.setattr(N, "MEETINGS", limit)
        monkeypatch.setattr(N, "PAIRS", limit)
    documents = [drawn_names(i, n, alphabet) for i, n in enumerate((40, 1, 25, 90))]
    names = [x for d in documents for x in d]
    sizes = np.array([len(d) for d in documents])
    found = N._representatives(names, names, np.repeat(np.arange(len(sizes)), sizes), sizes, 0.78)
    ends = np.cumsum(sizes)
    for d, end in zip(documents, ends):
        assert groups_of(d, found[end - len(d):end]) == brute_clusters(d, 0.78)


def test_wide_alphabets_have_codes_of_their_own():
    wide = [chr(0x4e00 + i) + chr(0x4e00 + 7 * i % 9000) + "ab" for i in range(6000)]
    name, code = N._gram_codes(wide)
    assert len(set(code.tolist())) == len({g for w in wide for g in E._windows(w)})
    counts = np.bincount(name, minlength=len(wide))
    assert counts.tolist() == [sum(E._windows(w).values()) for w in wide]


def test_both_routes_give_the_same_clusters(make_facts, monkeypatch):
    rows = [fact("A", f"a{i}", n, "p", f"the {n}", doc=d) for d, seed in (("d1", 3), ("d2", 4), (None, 5)) for i, n in enumerate(drawn_names(seed, 30))]
    facts = make_facts(rows)
    small = {tuple(r) for r in N.cluster(facts, core_entities=False).collect()}
    assert {r[1] for r in small} == {"d1", "d2"}
    monkeypatch.setattr(N, "TASK_CHARS", 450)
    sizes = facts.sparkSession.createDataFrame([("v1", "d1", 10), ("v1", "d2", 451)], "guideline_version string, doc_id string, n_chars long")
    assert {tuple(r) for r in N.cluster(facts, core_entities=False, sizes=sizes).collect()} == small
    monkeypatch.setattr(N, "TASK_CHARS", 0)
    assert {tuple(r) for r in N.cluster(facts, core_entities=False).collect()} == small


def test_grams_of_names_are_not_stored(spark, make_facts, tmp_path):
    context = spark.sparkContext
    before = context.getCheckpointDir()
    facts = make_facts([fact("A", f"a{i}", f"the member of the board number {i}", "p", f"an item of business that has {i} parts") for i in range(400)])
    context.setCheckpointDir(str(tmp_path))
    try:
        n = N.cluster(facts).count()
    finally:
        if before:
            context.setCheckpointDir(before.rsplit("/", 1)[0])
    assert n == 800
    assert sum(f.stat().st_size for f in tmp_path.rglob("part-*")) < 20 * n


def test_core_names_merge_year_variants(make_facts):
    rows = [fact("A", "a1", "the deficit in 2004", "p", "x"), fact("A", "a2", "the deficit in 2005", "p", "y")]
    got = {r.surface: r.cluster_id for r in N.cluster(make_facts(rows), 0.95, True).collect()}
    assert got["the deficit in 2004"] == got["the deficit in 2005"]


def test_components_of_chains_and_hubs(spark):
    from factloom.operators.components import connected_components
    edges = [("s", f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("s", "zz", f"y{i}") for i in range(30)] + [("t", "n000", "n001")]
    df = spark.createDataFrame(edges, "scope string, a string, b string")
    out = {(r.scope, r.node): r.component for r in connected_components(df, ["scope"]).collect()}
    assert {c for (s, n), c in out.items() if s == "s" and n.startswith("n")} == {"n000"}
    assert out[("s", "zz")] == "y0" and out[("t", "n001")] == "n000"
