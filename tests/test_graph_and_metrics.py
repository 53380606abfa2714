import itertools
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from facts import fact
from factloom import schema as S
from factloom.operators import graph as G
from factloom.operators import metrics as M
from factloom.operators import pgraph as PG
from factloom.operators import reified as RG
from factloom.operators import reviews as V
from factloom.operators.similarity import matrix_rows

CLUSTERS = "guideline_version string, doc_id string, surface string, cluster_id string"
PAIRS = ("guideline_version string, doc_id string, annotator_a string, annotator_b string, fact_a_id string, fact_b_id string, "
         "cosine double, status string, conflict_label string, layer2_called boolean")


def clusters_of(spark, *names):
    return spark.createDataFrame([("v1", "d1", n, "ent_" + n.lower().split()[-1]) for n in names], CLUSTERS)


def pair(a, b, label, cosine=0.9, status="matched", doc="d1", version="v1"):
    return (version, doc, "A", "B", a, b, cosine, status, label, label != "redundancy")


def test_same_triple_is_one_edge_and_severity_spreads(spark, make_facts):
    facts = make_facts([fact("A", "a1", "the Council", "shall adopt", "rule"), fact("B", "b1", "Council", "adopt", "rule"), fact("B", "b2", "Council", "fix", "null")])
    resolved = G.resolve(facts, clusters_of(spark, "the Council", "Council", "rule", "null"))
    edges = G.edges(resolved, spark.createDataFrame([pair("a1", "b1", "contradiction")], PAIRS))
    row = edges.collect()
    assert len(row) == 1 and row[0].predicate_key == "adopt" and row[0].annotators == ["A", "B"] and row[0].n_facts == 2
    nodes = {r.cluster_id: r for r in G.nodes(resolved, edges).collect()}
    assert set(nodes) == {"ent_council", "ent_rule"}
    assert {n.conflict_label for n in nodes.values()} == {"contradiction"}
    assert nodes["ent_council"].surface_forms == ["Council", "the Council"] and nodes["ent_council"].full_label == "Council"


def test_reified_graph(spark, make_facts):
    facts = make_facts([
        fact("A", "a1", "Council", "adopts", "rule", condition="if the Commission agrees"), fact("B", "b1", "Council", "adopts", "rule"),
        fact("A", "a2", "Commission", "waits", "null", logic_group="g", logic_op="or"), fact("A", "a3", "Commission", "acts", "null", logic_group="g", logic_op="OR")])
    clusters = clusters_of(spark, "Council", "rule", "Commission")
    members = RG.statement_facts(G.resolve(facts, clusters))
    statements = RG.statements(members, spark.createDataFrame([pair("a1", "b1", "granularity")], PAIRS))
    rows = statements.collect()
    assert len(rows) == 4 and sum(r.scope_variant for r in rows) == 2 and sum(r.conditional for r in rows) == 1
    assert sum(r.conflict_label == "granularity" for r in rows) == 2
    edges = RG.edges(statements, clusters)
    assert {(r.role, r.target) for r in edges.where("role = 'condition'").collect()} == {("condition", "ent_commission")}
    logic = RG.logic_nodes(members, statements).collect()
    assert len(logic) == 1 and logic[0].op == "OR" and logic[0].n_branches == 2
    assert RG.logic_branches(members, RG.logic_nodes(members, statements)).count() == 2
    assert RG.entity_nodes(edges, clusters, members).where("ref_only").count() == 0


def test_granularity_join_equals_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i in range(120):
        start = rng.randrange(0, 4000)
        rows.append(("v1", "d1", f"f{i:03d}", rng.choice("AB"), rng.choice(["p", "q"]), "s", "preamble.recitals[0]", start, start + rng.choice([0, 3, 40, 900])))
    df = spark.createDataFrame(rows, "guideline_version string, doc_id string, fact_id string, annotator string, predicate_norm string, "
                                     "subject_surface string, section_path string, char_start int, char_end int")
    got = {(r.fact_id_a, r.fact_id_b) for r in PG.granularity(df, bin_chars=64).collect()}
    want = {(a[2], b[2]) for a, b in itertools.combinations(sorted(rows, key=lambda r: r[2]), 2)
            if a[3] != b[3] and a[4] != b[4] and a[7] <= b[8] and b[7] <= a[8]}
    assert got == want and want


@pytest.mark.parametrize("query,mode,ok", [
    ("SELECT 1", "report", True), ("", "report", False), ("MERGE (a)", "report", False), ("MERGE (a)", "materialize", True),
    ("MATCH (n) DETACH DELETE n", "materialize", False), ("x REMOVE y", "materialize", False), ("DROP TABLE x", "materialize", False),
    ("CALL db.labels()", "report", False), ("SELECT 1", "other", False)])
def test_query_gate(query, mode, ok):
    assert PG.check_custom_query(query, mode)[0] is ok


def test_constraints_report_and_materialise(spark, make_facts):
    facts = make_facts([fact("A", "a1", "Council", "adopts", "rule", condition="if x"), fact("B", "b1", "Council", "adopts", "rule"), fact("B", "b2", "Council", "rejects", "rule")])
    v = PG.fact_vertices(G.resolve(facts, clusters_of(spark, "Council", "rule")))
    assert PG.run_constraint("conditional_scope", v).count() == 1
    edges = PG.run_constraint("materialize_predicate_mismatch", v)
    again = PG.run_constraint("materialize_predicate_mismatch", v, edges)
    assert edges.count() == again.count() == 1
    assert PG.run_constraint("cardinality", v, predicate="adopts").count() == 0
    with pytest.raises(ValueError):
        PG.custom_query(spark, {"facts": v}, "DROP TABLE pg_facts")


def covered(spans):
    return len({p for s, e in spans for p in range(s, e)})


def test_interval_union(spark):
    rng = random.Random(1)
    spans = [(k, s, s + rng.randrange(-2, 60)) for k in "ab" for s in [rng.randrange(0, 400) for _ in range(60)]]
    df = spark.createDataFrame(spans, "k string, start int, end int")
    for size in (7, 64, 4096):
        assert {r.k: r.covered for r in M.covered_length(df, ["k"], bin_size=size).collect()} == {
            k: covered([(s, e) for x, s, e in spans if x == k]) for k in "ab"}
    three = spark.createDataFrame([("a", 0, 10), ("a", 5, 20), ("a", 30, 40), ("a", 7, 7)], "k string, start int, end int")
    for size in (8, 4096):
        assert {(r.start, r.end) for r in M.merged_intervals(three, ["k"], bin_size=size).collect()} == {(0, 20), (30, 40)}


def test_overlap_depth_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [("k", s, s + rng.choice([1, 5, 30]), i) for i, s in enumerate(rng.randrange(0, 100) for _ in range(50))]
    df = spark.createDataFrame(rows, "k string, s int, e int, id int")
    got = {r.id: r.depth for r in M.overlap_depth(df, ["k"], ["s", "e", "id"]).collect()}
    ordered = sorted(rows, key=lambda r: r[1:])
    assert got == {r[3]: sum(1 for o in ordered[:i] if o[2] > r[1] and o[1] < r[2]) for i, r in enumerate(ordered)}


def test_coverage_case(spark, make_facts):
    facts = make_facts([fact("A", "a1", "s", "p", "o", span=(0, 30)), fact("A", "a2", "s", "p", "o", span=(40, 60), section="preamble.recitals[1]"),
                        fact("B", "b1", "s", "p", "o", span=(0, 50)), fact("B", "b2", "s", "p", "o", span=(30, 70))])
    sections = spark.createDataFrame([("d1", "preamble.recitals[0]"), ("d1", "preamble.recitals[1]"), ("d1", "enacting.article_1")], "doc_id string, section_path string")
    sizes = spark.createDataFrame([("d1", "preamble", 100), ("d1", "enacting", 50)], "doc_id string, container string, n_chars int")
    out = {r.annotator: r for r in M.coverage(facts, sections, sizes).collect()}
    assert (out["A"].total_chars_covered, out["A"].sections_hit_frac, out["A"].char_coverage_frac) == (50, 0.667, 0.333)
    assert out["B"].total_chars_covered == 70 and out["B"].mean_fact_chars == 45.0


def test_agreement_case(spark, make_facts):
    facts = make_facts([fact("A", f"a{i}", "s", "p", "o") for i in range(3)] + [fact("B", f"b{i}", "s", "p", "o") for i in range(3)])
    pairs = spark.createDataFrame([pair("a0", "b0", "redundancy", 0.97), pair("b1", "a1", "granularity", 0.93)[:2] + ("B", "A", "b1", "a1", 0.93, "matched", "granularity", True),
                                   pair("a2", None, "unlabeled", 0.2, "unmatched_a")], PAIRS)
    row = M.agreement(facts, pairs).first()
    assert (row.n_matched, row.jaccard, row.mean_cosine, row.n_redundancy, row.n_granularity) == (2, 0.5, 0.95, 1, 1)


def test_distribution_shift(spark):
    pairs = spark.createDataFrame(
        [pair(f"a{i}", f"b{i}", "redundancy") for i in range(4)] + [pair("a9", "b9", "contradiction")]
        + [pair("x", "y", "redundancy", version="v2"), pair("x", None, "unlabeled", status="unmatched_a", version="v2")], PAIRS)
    rows = {r.label: r for r in M.distribution_shift(M.document_profile(pairs)).collect()}
    assert (rows["redundancy"].delta, rows["redundancy"].delta_pct) == (-3, -75.0)
    assert rows["granularity"].delta_pct is None and rows["total"].n_old == 5 and rows["total"].rate_old == 0.8
    corpus = {r.label: r for r in M.corpus_shift(M.document_profile(pairs)).collect()}
    assert corpus["total"].n_docs == 1 and corpus["total"].rate_new == 0.0


def review(doc, key, rules, note="", resolution="agree", label="contradiction", at=1, deleted=False):
    return (doc, key, rules, note, resolution, label, ["A"], datetime(2024, 1, at), deleted)


def test_reviews(spark):
    log = V.normalise_reviews(spark.createDataFrame([
        review("d1", "p1", ["6", "2", "6"], "old"), review("d1", "p1", ["6"], " newer ", at=2), review("d1", "p2", [], at=1),
        review("d2", "p1", ["6"], "x" * 3000, "relabel:granularity"), review("d2", "p9", ["1"], at=1), review("d2", "p9", [], at=3, deleted=True)], S.REVIEW))
    current = V.current_reviews(log)
    assert current.count() == 3 and current.agg(F.max(F.length("note"))).first()[0] == 2000
    rules = spark.createDataFrame([("6", "Keep it short")], "rule_id string, title string")
    top = V.rule_evidence(current, rules).first()
    assert (top.rule_id, top.title, top.n_conflicts, top.n_docs) == ("6", "Keep it short", 2, 2) and top.sample_notes[0] == "newer"
    assert tuple(V.review_totals(current).first()) == (3, 2, 1)
    with pytest.raises(Exception, match="invalid resolution"):
        V.normalise_reviews(spark.createDataFrame([review("d", "p", [], resolution="maybe")], S.REVIEW)).collect()


def test_verifications_can_be_unset(spark):
    rows = [("d", "f1", "verified", "", datetime(2024, 1, 1)), ("d", "f1", "", "", datetime(2024, 1, 2)), ("d", "f2", "rejected", "", datetime(2024, 1, 1))]
    assert [r.fact_id for r in V.current_verifications(spark.createDataFrame(rows, S.VERIFICATION)).collect()] == ["f2"]


def test_fact_view_filters_and_order(spark, make_facts):
    rows = V.fact_rows(make_facts([fact("A", "a1", "Council", "adopts", "rule", section="enacting.article_2"), fact("A", "a2", "x", "y", "z", section="preamble.recitals[10]"),
                                   fact("B", "b1", "x", "y", "z", section="preamble.recitals[9]")]),
                       spark.createDataFrame([("v1", "d1", "a1", "contradiction")], "guideline_version string, doc_id string, fact_id string, conflict_label string"))
    assert [r.fact_id for r in V.in_document_order(rows).collect()] == ["b1", "a2", "a1"]
    assert [r.fact_id for r in V.visible_facts(rows, label="contradiction", query="COUNCIL adopts").collect()] == ["a1"]
    assert [r.fact_id for r in V.in_group_order(rows, "model").collect()] == ["a1", "a2", "b1"]


def test_matrix_rows(make_facts):
    facts = make_facts([fact("A", "a1", "Council", "adopts", "rule"), fact("A", "a2", "x", "y", "zed"), fact("B", "b1", "Council", "adopts", "rule")])
    rows = matrix_rows(facts, "A", "B").orderBy("ia").collect()
    assert rows[0].cosines == [1.0] and len(rows) == 2 and 0 <= rows[1].cosines[0] < 0.5


def test_islands_and_neighbours(spark):
    rows = [("v1", "d1", s, "p", o) for s, o in (("a", "b"), ("b", "c"), ("x", "y"), ("q", "q"))]
    edges = spark.createDataFrame(rows, "guideline_version string, doc_id string, s_cluster string, predicate_key string, o_cluster string")
    assert {r.s_cluster for r in G.without_islands(edges).collect()} == {"a", "b"}
    assert {r.s_cluster for r in G.without_islands(edges, 1).collect()} == {"a", "b", "x"}
    centre = spark.createDataFrame([("v1", "d1", "b")], "guideline_version string, doc_id string, centre string")
    assert {r.neighbour for r in G.neighbourhood(edges, centre).collect()} == {"a", "c"}


def test_scan_over_one_hot_key(spark, monkeypatch):
    """Sums and maxima over partitions whose borders lie inside keys, null keys and equal rows included."""
    import random

    from factloom.operators import scan

    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", None, "b"]), rng.randrange(40), rng.randrange(100)) for _ in range(500)] + [("hot", 7, 7)] * 60
    df = spark.createDataFrame(rows, "k string, at int, v int")
    held = scan.dealt(df, ["k"], ["at", "v"], part_rows=25)
    assert held.where("k = 'hot'").select("_part").distinct().count() > 8
    got = scan.scanned(held, ["k"], ["at", "v"], total=("sum", F.col("v")), most=("max", F.col("v")), nth=("sum", F.lit(1)))
    want = []
    for key in ("hot", None, "b"):
        total, most = 0, None
        for n, (_, at, v) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1:])):
            want.append((key, at, v, total, most, n))
            total, most = total + v, v if most is None else max(most, v)
    assert sorted(((r.k, r.at, r.v, r.total, r.most, r.nth) for r in got.collect()), key=str) == sorted(want, key=str)


def test_islands_and_depth_over_small_partitions(spark, monkeypatch):
    import random

    from factloom.operators import metrics, scan

    rng = random.Random(12)
    rows = [(i, rng.choice(["u", "u", "w"]), s, s + rng.randrange(0, 30)) for i, s in enumerate(rng.randrange(3000) for _ in range(300))]
    df = spark.createDataFrame(rows, "id int, k string, s long, e long")
    deal = scan.dealt
    monkeypatch.setattr(metrics, "dealt", lambda df, keys, order: deal(df, keys, order, part_rows=20))
    depth = {r.id: r.depth for r in metrics.overlap_depth(df, ["k"], ["s", "e", "id"]).where("e > s").collect()}
    for i, k, s, e in rows:
        if e > s:
            assert depth[i] == sum(k == k2 and (s2, e2, j) < (s, e, i) and e2 > s and s2 < e for j, k2, s2, e2 in rows)
    merged = {(r.k, r.s, r.e) for r in metrics.merged_intervals(df, ["k"], "s", "e", bin_size=64).collect()}
    covered = {(k, x) for _, k, s, e in rows for x in range(s, e)}
    assert {(k, x) for k, s, e in merged for x in range(s, e)} == covered and all((k, e) not in covered for k, _, e in merged)
