"""Operators that read their rows once: what that is worth shows in the plan, and that it changes nothing in the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facts import fact
from factloom.functions import text as T
from factloom.operators import encode as E
from factloom.operators import graph as G
from factloom.operators import pgraph as PG
from factloom.operators import reified as RG
from factloom.operators import similarity as M
from factloom.plans import phase2
from factloom.sources.tables import facts
from factloom.workload import chain_queries

PAIRS = "guideline_version string, doc_id string, fact_a_id string, fact_b_id string, conflict_label string, cosine double, status string"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _rows(df):
    return sorted(map(str, df.collect()))


def _same(left, right):
    left, right = ({tuple(r)[:-1]: r[-1] for r in df.collect()} for df in (left, right))
    assert left == pytest.approx(right)
    return left


@pytest.fixture
def resolved(make_facts):
    rows = [fact("A", "a1", "the board", "pays", "in 2019 the fee", group_id="g2", condition="if the Council agrees"), fact("B", "b1", "board", "pays", "fee", group_id="g1"),
            fact("B", "b1", "board", "pays", "fee", group_id="g1"), fact("A", "a2", "fee", "binds", "Council", temporal_context="when the board meets"),
            fact("A", "a3", "Council", "pays", None), fact("B", "b4", "Council", "is paid", "board", doc="d2", group_id=" "), fact("B", "b5", "Council", "not pays", "Council")]
    rows += [fact("A", f"a{i}", "board", "pays", "fee", group_id=f"h{i:02d}") for i in range(20, 32)]
    name = lambda c: F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), "(board|fee|council)", 1)
    return make_facts(rows).withColumn("s_cluster", F.nullif(name("subject"), F.lit(""))).withColumn("o_cluster", F.nullif(name("object"), F.lit("")))


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame([("v1", "d1", "a1", "b1", "redundancy", 0.9, "matched"), ("v1", "d1", "a2", None, "contradiction", 0.1, "unmatched_a")], PAIRS)


def test_edges_group_their_facts_once(resolved, pairs):
    table = G.edges(resolved, pairs)
    plan = _plan(table)
    assert "Expand" not in plan and "Window" not in plan and plan.count("natural_language#") and plan.count("Scan ExistingRDD") <= 2
    edges = {(r.doc_id, r.s_cluster, r.predicate_key, r.o_cluster): r for r in table.collect()}
    pays = edges["d1", "board", "pays", "fee"]
    assert (pays.n_facts, pays.conflict_label, pays.conditional) == (14, "redundancy", True)
    assert (pays.groups, pays.qualifiers, pays.conditions, pays.temporals) == (["g1", "g2", *[f"h{i}" for i in range(20, 26)]], ["in 2019"], ["if the Council agrees"], [])
    alone = edges["d2", "council", "paid", "board"]
    assert (alone.groups, alone.qualifiers, alone.conditions, alone.temporals) == (None, None, None, None)


def test_members_of_edges_stay_with_their_documents(resolved, pairs):
    members = G.edge_members(resolved, pairs)
    edges = {r.edge_id: r for r in G.edges(resolved, pairs).collect()}
    found = members.collect()
    assert len({(r.edge_id, r.fact_id) for r in found}) == len(found) == sum(e.n_facts for e in edges.values())
    assert all(edges[r.edge_id].edge_name == r.edge_name for r in found)
    line = next(x for x in _plan(members).splitlines() if "Aggregate" in x)
    assert "doc_id" in line.split("],")[0] and "sha1" not in line.split("],")[0]


def test_qualifiers_of_plain_names_cost_nothing(spark):
    names = [None, "", " ", "null", "the board", "Rule of 5 May 2020", "a b c d e f g h", "a b c OF d e f g h", "a b c of, d e f g h", "a b in d e f g h ٣", "(2019) x", "x\x1cof\x1cy a b c d e",
             "one two three four five concerning six seven."]
    df = spark.createDataFrame([(x,) for x in names], "n string").select("n", T.entity_qualifiers("n").alias("q"), T.split_entity("n")["qualifiers"].alias("w"))
    assert all(r.q == r.w for r in df.collect()) and sum(bool(r.q) for r in df.collect()) == 4


def test_subgraphs_read_the_edges_once(spark):
    edges = spark.createDataFrame([("v1", "d1", "a", "p", "b", ["A", "B"]), ("v1", "d1", "a", "p", "a", ["A"]), ("v1", "d2", "x", "p", "y", ["B"])],
                                  "guideline_version string, doc_id string, s_cluster string, predicate_key string, o_cluster string, annotators array<string>")
    nodes = spark.createDataFrame([("v1", "d1", c) for c in "abc"] + [("v1", "d2", "x")], "guideline_version string, doc_id string, cluster_id string")
    found = G.annotator_subgraphs(edges, nodes)
    assert _plan(found).count("annotators#") and _plan(found).count("explode(annotators") == 1
    assert {(r.doc_id, r.annotator, r.n_relations, r.n_entities, r.n_total) for r in found.collect()} == {("d1", "A", 2, 2, 3), ("d1", "B", 1, 2, 3), ("d2", "B", 1, 2, 1)}


def test_islands_are_found_on_stored_edges(spark):
    made = spark.sparkContext.accumulator(0)
    rows = spark.sparkContext.parallelize([("v1", "d1", "a", "b"), ("v1", "d1", "b", "c"), ("v1", "d1", "x", "y")], 1)

    def counted(r):
        made.add(1)
        return r

    edges = spark.createDataFrame(rows.map(counted), "guideline_version string, doc_id string, s_cluster string, o_cluster string")
    assert {r.s_cluster for r in G.without_islands(edges).collect()} == {"a", "b"} and made.value == 3


def test_reified_edges_read_statements_once(resolved, pairs, spark):
    table = RG.statements(RG.statement_facts(resolved), pairs)
    clusters = spark.createDataFrame([("v1", "d1", "the board", "board"), ("v1", "d1", "Council", "council"), ("v1", "d1", "fee", "fee")],
                                     "guideline_version string, doc_id string, surface string, cluster_id string")
    edges = RG.edges(table, clusters)
    assert _plan(edges).count("min_by(struct(s_cluster") == 1
    found = {(r.role, r.statement_id, r.source if r.role == "subject" else r.target, r.label) for r in edges.collect()}
    want = {("subject", r.statement_id, r.s_cluster, "") for r in table.collect() if r.s_cluster} | {("object", r.statement_id, r.o_cluster, "") for r in table.collect() if r.o_cluster}
    for role, word in (("condition", "if"), ("temporal", "then")):
        want |= {(role, r.statement_id, r.ref_cluster, word) for r in RG.references(table, clusters, role).collect()}
    assert found == want and len({x[0] for x in found}) == 4 and edges.count() == len(want)
    assert {(r.role, r.source) for r in edges.where("role = 'condition'").collect()} <= {("condition", x[1]) for x in want}


def test_exports_are_counted_in_one_pass(resolved, pairs, spark):
    clusters = spark.createDataFrame([("v1", "d1", c, c) for c in ("board", "council", "fee")], "guideline_version string, doc_id string, surface string, cluster_id string")
    tables = PG.export_tables(resolved, clusters, pairs)
    counts = PG.export_counts(tables, PG.fact_vertices(resolved))
    assert {r.name: r.n for r in counts.collect()} == {name: df.count() for name, df in tables.items()}
    assert _plan(counts).count("Union") == 1 and len(tables) - len(PG.ROW_OF_FACT) == 5


def test_rules_on_ends_share_a_join(resolved):
    v = PG.fact_vertices(resolved)
    ruled = PG.conflict_edges(PG.end_rules(v))
    assert _rows(ruled) == _rows(PG.conflict_edges(predicate_mismatch=PG.predicate_mismatch(v), redundancy=PG.redundant_triples(v))) and ruled.count() == 13
    assert _plan(ruled).count("Join") == 1


TEXTS = [("d", "a", "one two two"), ("d", "b", "One\x85ore"), ("d", "b", "three one"), (None, "c", "one"), ("e", "f", ""), ("e", "g", None), ("e", None, "ein Öl"), ("g", "a", "x 𝔘nd one" * 9)]


@pytest.mark.parametrize("task_chars", [2_000_000, 20, 0])
def test_weights_are_made_where_the_rows_lie(spark, monkeypatch, task_chars):
    monkeypatch.setattr(E, "TASK_CHARS", task_chars)
    monkeypatch.setattr(E, "BATCH_CHARS", 15)
    rows = spark.createDataFrame(TEXTS, "doc_id string, fact_id string, t string").repartition("doc_id")
    if task_chars > 20:
        assert "regexp_extract_all" not in _plan(E.gram_weights(rows, ["doc_id"], "fact_id", "t"))
    found = _same(E.gram_weights(rows, ["doc_id"], "fact_id", "t"), E.spread_weights(rows, ["doc_id"], "fact_id", "t"))
    assert {k[:2] for k in found} == {("d", "a"), ("d", "b"), ("e", None), ("g", "a")}
    pairs = spark.createDataFrame([("d", "a", "b"), ("d", "b", "a"), ("d", "a", "a"), ("d", "a", "z"), ("e", "f", "g"), ("e", None, "f"), ("g", "a", "a"), ("h", "a", "b"), (None, "c", "c")],
                                  "doc_id string, x string, y string")
    args = ["doc_id"], "fact_id"
    near = _same(E.pair_cosines(pairs, rows, *args, "t", "x", "y"), E.cosine_of_pairs(pairs, E.spread_weights(rows, *args, "t"), *args, "x", "y"))
    assert near["d", "a", "a"] == pytest.approx(1) and 0 < near["d", "a", "b"] < 1 and near[None, "c", "c"] == near["h", "a", "b"] == 0 and len(near) == 9


@pytest.mark.parametrize("task_cells,small", [(100, 0), (100, 10**9), (2, 0)])
def test_matrices_are_made_where_documents_lie(make_facts, monkeypatch, task_cells, small):
    monkeypatch.setattr(M, "TASK_CELLS", task_cells)
    monkeypatch.setattr(M, "HELD_CELLS", 6)
    monkeypatch.setattr(E, "SMALL_PRODUCT", small)
    monkeypatch.setattr(E, "MEETING_COST", 3)
    monkeypatch.setattr(E, "MEETINGS", 4)
    said = ["the council adopts a budget", "member states close the frontier", "council budgets", "a deficit", "", "the frontier of the council"]
    rows = [fact(a, f"{a}{i}{d}", "", "", "", nl=said[(i * k) % 6], doc=d, pos=i) for a, k in (("A", 1), ("B", 5)) for d in ("d1", "d2") for i in range(5)]
    facts = make_facts([*rows, rows[0], fact("A", "x", "s", "p", "o", doc="d3"), fact("B", "y", "s", "p", "o", doc=None), fact("A", "z", "s", "p", "o", doc=None)])
    parts = M.matrix_parts(facts, "A", "B", named=False)
    if task_cells > 2:
        assert "FlatMapGroupsInPandas" not in _plan(parts) and "regexp_extract_all" not in _plan(parts)
    got = sorted((r.doc_id, r.fact_a_id, len(r.cosines)) for r in parts.collect())
    assert sum(n for *_, n in got) == 6 * 5 + 25 and {d for d, *_ in got} == {"d1", "d2"}
    cells = {(r.fact_a_id, r.fact_b_id): r.cosine for r in M.matrix_cells(facts, "A", "B").collect()}
    whole = {}
    for r in M.matrix_rows(facts.where("doc_id = 'd2'"), "A", "B").collect():
        whole |= {(r.fact_a_id, f"B{i}d2"): c for i, c in enumerate(r.cosines)}
    assert {k: v for k, v in cells.items() if k[0].endswith("d2")} == pytest.approx(whole) and len(cells) == 50


def test_large_products_meet_on_rare_windows(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice("council budget the member states frontier of deficit path".split(), rng.integers(0, 9))) for _ in range(60)]
    document = np.repeat([0, 1, 2], 20)
    v = E.DocumentVectors(texts, document)
    for d in range(3):
        own = np.flatnonzero(document == d)
        left, right = v.text[own[:9]], v.text[own[6:]]
        want = v.cosines(d, left, right)
        monkeypatch.setattr(E, "SMALL_PRODUCT", 0)
        monkeypatch.setattr(E.DocumentVectors, "_product", None)
        for cost, meetings in ((0, 1), (3, 7), (150, 10**6), (10**9, 5)):
            monkeypatch.setattr(E, "MEETING_COST", cost)
            monkeypatch.setattr(E, "MEETINGS", meetings)
            np.testing.assert_allclose(v.cosines(d, left, right), want, atol=1e-12)
        monkeypatch.undo()


def test_derived_facts_are_not_stored(spark, tmp_path, monkeypatch):
    text = "The board pays 3 fees. Members may split it if all agree. The court never decides. " * 4
    spark.createDataFrame([(1, text), (2, "One."), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    whole, dealt = phase2.checkpoint, phase2.checkpoint_dealt
    monkeypatch.setattr(phase2, "checkpoint", lambda df: kept.append(df.columns) or whole(df))
    monkeypatch.setattr(phase2, "checkpoint_dealt", lambda df: kept.append(df.columns) or dealt(df))
    out = chain_queries._run(spark, str(tmp_path))
    assert len(kept) == 2 and not any({"natural_language", "source_locator", "layer1_reason", "a_quote"} & set(c) for c in kept)
    plain = phase2.run(facts(spark, str(tmp_path)))
    assert set(plain) - set(out) == {"pairs"}
    for name in ("label_counts", "graph_edges", "graph_nodes", "statements", "agreement"):
        assert _rows(out[name].select(*plain[name].columns)) == _rows(plain[name])
