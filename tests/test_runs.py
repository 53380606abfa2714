"""Runs that store and resume: ledger, buckets, kept results, matrix blocks."""

import json

import pytest
from pyspark.sql import functions as F

from facts import fact
from factloom.operators import ledger as L
from factloom.operators.similarity import matrix_cells, matrix_rows
from factloom.plans.results import snapshot, stored_result
from factloom.streaming import buckets as B

SECTION_DDL = "guideline_version string, annotator string, doc_id string, section_path string, base_offset int, text string, status string"


def test_ledger_resumes_and_keeps_errors(spark, tmp_path):
    rows = [("v1", "m", d, f"preamble.recitals[{i}]", 10 * i, t, "mine") for d, ts in (
        ("d1", ["good one", "bad one"]), ("d2", ["good two", "broken"]), (None, ["good three", None, ""])) for i, t in enumerate(ts)]
    sections = spark.createDataFrame(rows, SECTION_DDL)
    path = str(tmp_path / "ledger")

    def first(text):
        if not text or text.startswith("bad"):
            raise ConnectionError("down")
        quote = {"natural_language": text, "source_quote": text, "subject": "s", "predicate": "p", "object": "o"}
        return "{" if text == "broken" else json.dumps({"facts": [quote]})

    one = L.run_extraction(sections, first, path, 1, attempts=3)
    got = {(r.doc_id, r.section_path[-2]): (r.status, r.error, r.attempts) for r in one.collect()}
    assert got[("d1", "0")] == ("ok", None, 1) and got[("d1", "1")] == ("error", "ConnectionError: down", 3)
    assert got[("d2", "1")] == ("invalid", "not valid JSON", 1) and got[(None, "1")][0] == got[(None, "2")][0] == "error" and len(got) == 7
    cells = {r.doc_id: (r.status, r.n_sections, r.n_ok) for r in L.cells(one).collect()}
    assert cells == {"d1": ("error", 2, 1), "d2": ("error", 2, 1), None: ("error", 3, 1)}
    assert L.pending(sections, one).count() == 4

    def second(text):
        assert text not in ("good one", "good two", "good three")
        return '{"facts": []}'

    for _ in range(2):  # a run that is repeated replaces its own records
        two = L.run_extraction(sections, second, path, 2)
        assert two.count() == 11 and two.where("run = 2").count() == 4
    assert {r.status for r in L.cells(two).collect()} == {"ok"} and L.pending(sections, two).count() == 0
    assert sorted(r.source_locator.char_start for r in L.facts_of(two, sections).collect()) == [0, 0, 0]
    assert L.run_extraction(sections, first, path, 3, force=True).where("run = 3").count() == 7
    assert L.run_extraction(sections.limit(0), first, str(tmp_path / "none"), 1).count() == 0


ROW_DDL = "doc string, id int, body string, at int"


def test_buckets_are_read_and_written_where_touched(spark, tmp_path):
    source, path, offsets, seen = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "ck"), []

    def load(rows):
        spark.createDataFrame(rows, ROW_DDL).write.mode("append").parquet(source)
        B.follow_into_buckets(spark, source, path, offsets, ROW_DDL, ["doc"], ["doc", "id"], "at",
                              lambda df, n: seen.append((n, sorted((r.doc or "", r.id, r.body) for r in df.collect()))), buckets=8).awaitTermination()

    load([("a", 1, "x", 1), ("b", 1, "y", 1), (None, 1, "n", 1), ("a", 2, None, 1), ("a", 1, "x", 1)])
    before = B.generations(spark, path, ROW_DDL)
    load([("a", 1, "late", 0), ("a", 2, "new", 2), (None, 1, "m", 1)])
    assert seen[1] == (1, [("", 1, "m"), ("a", 1, "x"), ("a", 2, "new")])
    now = B.generations(spark, path, ROW_DDL)
    touched = {b for b in now if now[b] == 1}
    assert set(now) == set(before) and 1 <= len(touched) <= 2 and any(g == 0 for g in now.values())
    state = lambda: sorted((r.doc or "", r.id, r.body, r.at) for r in B.read_buckets(spark, path, ROW_DDL).collect())
    held = state()
    assert held == [("", 1, "m", 1), ("a", 1, "x", 1), ("a", 2, "new", 2), ("b", 1, "y", 1)]
    again = spark.createDataFrame([("a", 1, "late", 0), ("a", 2, "new", 2), (None, 1, "m", 1)], ROW_DDL)
    B.merge_batch(again, 1, path, ROW_DDL, ["doc"], ["doc", "id"], "at", buckets=8)
    assert state() == held and B.generations(spark, path, ROW_DDL) == now
    assert B.merge_batch(again.limit(0), 2, path, ROW_DDL, ["doc"], ["doc", "id"], "at", buckets=8) == set()
    pruned = B.read_buckets(spark, path, ROW_DDL, touched)
    assert len(pruned.inputFiles()) <= len(B.read_buckets(spark, path, ROW_DDL).inputFiles())


def test_results_are_kept_by_parameters_and_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id int, t string")
    built = []

    def ask(df, **params):
        def build():
            built.append(params)
            return df.groupBy("id").count()
        out, held = stored_result(spark, str(tmp_path), "counts", params, {"rows": df}, build)
        return sorted(tuple(r) for r in out.collect()), held

    assert ask(rows, least=1) == ([(1, 1), (2, 2)], False) and ask(rows.repartition(3), least=1) == ([(1, 1), (2, 2)], True)
    assert ask(rows, least=2)[1] is False and ask(rows.distinct(), least=1) == ([(1, 1), (2, 1)], False) and len(built) == 3
    prints = [rows, rows.limit(0), rows.distinct(), rows.withColumnRenamed("t", "u"), rows.withColumn("id", F.col("id").cast("long")), rows.union(rows)]
    assert len({snapshot(df) for df in prints}) == len(prints) and snapshot(rows.limit(0)) == snapshot(rows.where("false"))


@pytest.mark.parametrize("block", [1, 3, 512])
def test_matrix_blocks_equal_the_whole_matrix(make_facts, block):
    rows = [fact(a, f"{a}{i}", w, "adopts", o, doc=d, pos=i) for a in ("A", "B") for d in ("d1", "d2")
            for i, (w, o) in enumerate([("council", "budget"), ("member state", "frontier"), ("the council", "budgets"), ("deficit", "path")])]
    rows += [fact("A", "A9", "", "", "", nl="", doc="d1", pos=9), fact("A", "A7", "x", "y", "z", doc="d3"), fact("C", "C1", "x", "y", "z", doc="d1")]
    facts = make_facts([{**r, "fact_id": r["fact_id"] + r["doc_id"]} for r in rows])
    cells = {(r.fact_a_id, r.fact_b_id): r.cosine for r in matrix_cells(facts, "A", "B", block).collect()}
    whole = {}
    right = {d: [f"B{i}{d}" for i in range(4)] for d in ("d1", "d2")}
    for r in matrix_rows(facts.where("doc_id <> 'd3'"), "A", "B").collect():
        whole |= {(r.fact_a_id, b): c for b, c in zip(right[r.doc_id], r.cosines)}
    assert cells == pytest.approx(whole) and len(cells) == 36 and cells[("A9d1", "B0d1")] == 0 and cells[("A0d1", "B0d1")] == 1
    assert matrix_cells(facts.limit(0), "A", "B", block).count() == 0
