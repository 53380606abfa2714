"""what the chain does once, where rows stay, and that results are those of the plain way."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import align as A
from factloom.operators import encode as E
from factloom.plans import phase2
from factloom.sources.tables import facts, stored_sentences

WORDS = "the buyer shall pay interest on late sums unless both parties agree in writing that no such duty exists €5 Straße 𝔘nit 2,3".split()


def _texts(n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, rng.integers(0, 9))) for _ in range(n)]


@pytest.fixture
def documents(spark, tmp_path):
    texts = [". ".join(t.capitalize() for t in _texts(n, n) if t) + "." for n in (2, 9, 30, 61)] + [None, "", "Alone it stands.", "  "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_vectors_of_several_documents_are_those_of_each(monkeypatch):
    texts = [_texts(n, n) for n in (1, 40, 7)] + [["", "  "]]
    cut = []
    plain = E._gram_codes
    monkeypatch.setattr(E, "_gram_codes", lambda names: cut.extend(names) or plain(names))
    together = E.DocumentVectors([t for ts in texts for t in ts], np.repeat(np.arange(4), [len(t) for t in texts]))
    assert len(cut) == len(set(cut)) and set(cut) == {w.lower() for ts in texts for t in ts for w in t.split()}
    at = 0
    for d, own in enumerate(texts):
        left, right = np.arange(0, len(own), 2), np.arange(1, len(own), 2)
        place = together.text[at:at + len(own)]
        at += len(own)
        # all in one slice, then in many
        for width in (4096, 7):
            want = E.product(E.sparse_vectors(own), left, right, width)
            np.testing.assert_allclose(together.cosines(d, place[left], place[right], width), want, atol=1e-12)


def test_keys_that_outgrow_one_number_give_the_same_places():
    key = np.array([5, 3, 5, 9, 3, 5])
    for most in (10, 1 << 62):
        first, n = E._first_of_each(key, most)
        assert first.tolist() == [0, 1, 3] and n.tolist() == [3, 2, 1]


def test_documents_are_aligned_whole_whatever_the_batches(monkeypatch):
    rows = [{"guideline_version": v, "doc_id": d, "annotator": a, "fact_id": f"{a}{i}", "fact_pos": i, "text": t, "total": 12}
            for v, d in ((None, "x"), ("v1", None), ("v1", "x"), ("v1", "y")) for a in "ab" for i, t in enumerate(_texts(6, 3))]
    monkeypatch.setattr(A, "BATCH_CHARS", 100)
    monkeypatch.setattr(A, "SLICE", 5)
    found = []
    for size in (1, 7, 100):
        batches = pa.Table.from_pylist(rows).to_batches(max_chunksize=size)
        out = pa.Table.from_batches(list(A._align_documents(0.78, [], False, False)(batches))).to_pylist()
        assert {(r["guideline_version"], r["doc_id"]) for r in out} == {(None, "x"), ("v1", None), ("v1", "x"), ("v1", "y")}
        assert all(r["status"] == "matched" and r["fact_a_id"][1:] == r["fact_b_id"][1:] for r in out if r["cosine"] > 0)
        found.append(sorted(map(str, out)))
    assert found[0] == found[1] == found[2]
    with pytest.raises(RuntimeError, match="in parts"):
        list(A._align_documents(0.78, [], False, False)(pa.Table.from_pylist(rows[:-1]).to_batches()))


def test_an_exploded_sentence_carries_its_own_offset_only(spark):
    df = spark.createDataFrame([(1, "One is. Two are.  Three."), (2, None), (3, "")], "doc_id long, text string")
    rows = T.explode_sections(df, "text", "sentence")
    assert [tuple(r) for r in rows.orderBy("pos").collect()] == [(1, 0, 0, 7, "One is."), (1, 1, 8, 16, "Two are."), (1, 2, 18, 24, "Three.")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate" in line)
    assert "posexplode(arrays_zip" in generate
    # neither array, second and fourth column below, is kept beside the exploded rows
    assert ", [1, 3], true" in generate


def test_a_run_that_stores_keeps_facts_where_they_lie(spark, documents):
    base = stored_sentences(spark, documents)
    out = phase2.run(facts(spark, documents, base=base), stored=True)
    plan = out["graph_nodes"]._jdf.queryExecution().optimizedPlan()
    stored = [p for p in plan.collectLeaves().mkString("\n").splitlines() if "source_locator" in p]
    assert stored and not any("a_quote" in p for p in plan.collectLeaves().mkString("\n").splitlines())
    aligned = A.align(facts(spark, documents, base=base))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in aligned and "Exchange" not in aligned


def test_a_run_that_stores_gives_the_rows_of_one_that_does_not(spark, documents):
    plain = phase2.run(facts(spark, documents))
    kept = phase2.run(facts(spark, documents, base=stored_sentences(spark, documents)), stored=True, largest_document=100_000,
                      sizes=spark.createDataFrame([("v1", str(d), 5_000) for d in range(8)], "guideline_version string, doc_id string, n_chars long"))
    for name in ("pairs", "label_counts", "graph_nodes"):
        rows = [sorted(map(str, t[name].select(*plain[name].columns).collect())) for t in (plain, kept)]
        assert rows[0] and rows[0] == rows[1]
    assert kept["pairs"].where(F.col("status") == "matched").count() > 0


def test_numbers_and_polarity_still_decide_what_is_not_redundant(spark):
    from factloom.operators import label as L
    kinds = ", ".join(f"{s}_{c} string" for s in "ab" for c in A.CARRY)
    side = lambda o: ("we", "owe", o, f"we owe {o}.", "")
    rows = spark.createDataFrame([("n", 0.9, "matched", *side("5 apples"), *side("7 apples")), ("p", 0.9, "matched", *side("tax"), *side("never tax at all")),
                                  ("r", 1.0, "matched", *side("5 pears"), *side("5 pears")), ("o", None, "unmatched_a", *side("5 figs"), *[None] * 5)],
                                 f"k string, cosine double, status string, {kinds}")
    got = {r["k"]: (r["conflict_label"], r["layer1_reason"].split(" ")[0]) for r in L.layer1(rows).collect()}
    assert got == {"n": ("escalate", "numeric"), "p": ("escalate", "polarity"), "r": ("redundancy", got["r"][1]), "o": ("unlabeled", "orphan_unmatched_a")}
