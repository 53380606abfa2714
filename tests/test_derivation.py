"""Facts derived from tables: what a reader pays for, and that shortcuts change nothing."""

import re

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import graph as G
from factloom.sources import tables as S

TEXT = "The court shall decide within 3 days of 12 May 2020. " * 3 + " ".join(f"Member {i} may never split item {i} if the board agrees." for i in range(12))


def _documents(spark, tmp_path):
    spark.createDataFrame([(1, TEXT), (2, "One."), (2, "One."), (3, ""), (4, None), (None, TEXT)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def _optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ids_alone_cost_one_digest(spark, tmp_path):
    sf = _documents(spark, tmp_path)
    plan = _optimised(S.facts(spark, sf).select("doc_id", "fact_id"))
    assert len(re.findall(r"\bsha1\(", plan)) == 1
    assert "within two days" not in plan
    assert len(re.findall(r"\bsha1\(", _optimised(S.pairs(spark, sf)))) <= 2


def test_pairs_name_the_facts(spark, tmp_path):
    sf = _documents(spark, tmp_path)
    facts = [(r.doc_id, r.annotator, r.fact_id) for r in S.facts(spark, sf, ("v1", "v2")).where("doc_id is not null").collect()]
    pairs = S.pairs(spark, sf, ("v1", "v2")).where("doc_id is not null").collect()
    named = [(p.doc_id, "ann_a", p.fact_a_id) for p in pairs if p.fact_a_id] + [(p.doc_id, "ann_b", p.fact_b_id) for p in pairs if p.fact_b_id]
    assert sorted(named) == sorted(facts)
    assert {p.status for p in pairs} == {"matched", "unmatched_a", "unmatched_b"}
    assert all((p.fact_a_id is not None) == (p.status != "unmatched_b") and (p.fact_b_id is not None) == (p.status != "unmatched_a") for p in pairs)


def test_white_space_is_the_listed_characters(spark):
    points = spark.range(1, 0x3100).where("id < 55296").select(F.col("id"), F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    found = {r.c for r in points.where(F.col("c").rlike(f"^{T.WS}$")).collect()}
    assert found == set(T.WHITESPACE)


def test_qualifiers_with_and_without_digits(spark):
    rows = spark.createDataFrame([("the treaty of 12 May 2020",), ("the treaty",), ("an act in 1999 on ٣ May ٢٠٢٠",), ("",), (None,)], "x string")
    found = [r.q for r in rows.select(T.split_entity("x").alias("q")).collect()]
    assert (found[0].core, found[0].qualifiers) == ("treaty", ["of 12 May 2020"])
    assert (found[1].core, found[1].qualifiers) == ("treaty", [])
    assert found[2].qualifiers == ["in 1999", "on ٣ May ٢٠٢٠"]
    assert [found[3].qualifiers, found[4].qualifiers] == [[], []]


def test_flagged_facts_leave_their_texts_behind(spark, tmp_path):
    from factloom.workload import graph_queries as Q
    sf = _documents(spark, tmp_path)
    f = S.facts(spark, sf)
    pairs = S.pairs(spark, sf).withColumn("conflict_label", F.lit("redundancy"))
    plain, flagged = (G.edges(G.resolve(x, Q.clusters(f)), pairs) for x in (f, G.flagged(f)))
    assert sorted(map(str, plain.collect())) == sorted(map(str, flagged.collect()))
    joined = [line for line in _optimised(Q.resolved(spark, sf).select("fact_id", "s_cluster", "o_cluster", "_conditional")).splitlines() if re.search(r"Join ", line)]
    assert joined and not any("quote" in line for line in joined)
    assert "_conditional" in Q.resolved(spark, sf).columns


def _shuffles(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def test_documents_are_dealt_out_once_for_all_joins(spark, tmp_path):
    from factloom.operators import label as L
    from factloom.workload import graph_queries as Q
    from factloom.workload import pair_queries as P
    sf = _documents(spark, tmp_path)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _shuffles(L.label_counts(P.labelled(spark, sf, ("v1", "v2")))) == []
        assert _shuffles(Q.a30(spark, sf)) == []
        assert _shuffles(Q._statements(spark, sf)[1]) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_stored_sentences_change_no_row(spark, tmp_path):
    sf = _documents(spark, tmp_path)
    base = S.stored_sentences(spark, sf)
    for versions in (("v1",), ("v1", "v2")):
        for of in (S.facts, S.pairs):
            assert sorted(map(str, of(spark, sf, versions, base).collect())) == sorted(map(str, of(spark, sf, versions).collect()))


def test_statements_count_ids_and_scopes_in_one_pass(spark, make_facts):
    from facts import fact
    from factloom.operators import reified as RG
    rows = [fact("ann_a", "f1", "A", "pays", "B", condition="If x", group_id="g1"), fact("ann_b", "f2", "A", "pays", "B", condition="if  X", group_id="g1"),
            fact("ann_b", "f2", "A", "pays", "B", condition="if  X", group_id="g2"), fact("ann_a", "f3", "A", "pays", "B", conflict_label="granularity"),
            fact("ann_a", "f4", "A", "owes", "B"), fact("ann_a", "f5", None, "owes", "B"), fact("ann_a", "f6", None, "owes", "B", condition="if y")]
    resolved = make_facts(rows).withColumn("s_cluster", F.col("subject")).withColumn("o_cluster", F.col("object"))
    pairs = spark.createDataFrame([("v1", "d1", "f1", "f2", "redundancy"), ("v1", "d1", "f3", None, "contradiction")],
                                  "guideline_version string, doc_id string, fact_a_id string, fact_b_id string, conflict_label string")
    table = RG.statements(RG.statement_facts(resolved), pairs)
    found = {(r.predicate, r.conditions and tuple(r.conditions)): r for r in table.collect()}
    both = found["pays", ("If x", "if  X")]
    assert (both.n_facts, both.n_groups, both.n_annotators, both.conflict_label, both.scope_variant, both.temporals) == (2, 2, 2, "redundancy", True, [])
    assert (found["pays", None].conflict_label, found["pays", None].scope_variant) == ("contradiction", True)
    assert [found["owes", c].scope_variant for c in (None, ("if y",))] == [False, False]
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and plan.count("Join") <= 1


def test_windows_are_made_once(spark, tmp_path):
    from factloom.operators import encode as E
    rows = spark.createDataFrame([("d", "a", "one two"), ("d", "b", "one"), (None, "c", "one"), ("e", "f", "")], "doc_id string, fact_id string, t string")
    weights = E.gram_weights(rows, ["doc_id"], "fact_id", "t")
    assert weights._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    found = {(r.doc_id, r.fact_id, r.gram): r.weight for r in weights.collect()}
    assert {k[:2] for k in found} == {("d", "a"), ("d", "b")} and found["d", "a", " on"] < found["d", "a", " tw"]
    assert abs(sum(w * w for k, w in found.items() if k[1] == "a") - 1) < 1e-9


def test_results_by_parameters_split_the_documents_once(spark, tmp_path):
    from factloom.workload import run_queries as U
    out = U.results_by_parameters(spark, _documents(spark, tmp_path))
    assert {(r.call, r.held) for r in out.collect()} == {("first", False), ("again", True), ("other threshold", False), ("other rows", False)}
    calls = []
    whole, U.stored_result = U.stored_result, lambda s, root, name, params, inputs, build: calls.append(inputs["facts"]) or (build(), False)
    try:
        U.results_by_parameters(spark, str(tmp_path))
    finally:
        U.stored_result = whole
    assert len(calls) == 4 and not any("regexp_extract_all" in _optimised(rows) for rows in calls)


def test_names_stay_within_their_bound(spark, tmp_path):
    from factloom.operators import entities as E
    short = "A b c. " * 400
    marked = "The board of item 7 may agree. " * 900
    rows = [(i, x) for i, x in enumerate((TEXT, short, marked, marked, "A. B. C! D? E", "", None))] + [(1, short), (1, None), (None, TEXT)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len(marked) > 20_000
    bound = {(r.guideline_version, r.doc_id): r.n_chars for r in S.name_bounds(spark, str(tmp_path), ("v1", "v2")).collect()}
    assert len(bound) == 2 * 8
    held = E.surface_forms(S.facts(spark, str(tmp_path), ("v1", "v2"))).groupBy("guideline_version", "doc_id").agg(F.sum(F.length("surface")).alias("n")).collect()
    assert len(held) == 2 * 6 and all(r.n <= bound[r.guideline_version, r.doc_id] for r in held)
