import json
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from facts import FACT_DDL, fact
from factloom.operators import bands as B
from factloom.operators import extract as X
from factloom.operators import html as H
from factloom.operators import parsing as P
from factloom.operators import synth as Y
from factloom.operators.anchors import best_window
from factloom.plans import phase2
from factloom.sources import files as S
from factloom.sources import sinks as K
from factloom.streaming.incremental import follow_facts

ACT = """COUNCIL REGULATION (EC) No 1/96
of 2 January 1996

THE COUNCIL OF THE EUROPEAN UNION,
Having regard to the Treaty,
Having regard to the proposal,

(1) First reason
 goes on.
(2) Second reason.
HAS ADOPTED THIS REGULATION:
Article 1
Subject matter
This Regulation lays down rules.

Article 2a
It shall enter into force.
Done at Brussels, 2 January 1996.
ANNEX I
List of things
"""


def act(spark, text, strict=False):
    df = spark.createDataFrame([("d", text)], "id string, text string")
    return df.select(P.plain_text_document("id", "text", strict).alias("document"))


def test_plain_text_act(spark):
    df = act(spark, ACT)
    d = df.first().document
    assert d.title == "COUNCIL REGULATION (EC) No 1/96 — of 2 January 1996"
    assert d.citations == ["Having regard to the Treaty", "Having regard to the proposal"]
    assert [(r.number, r.text) for r in d.recitals] == [("(1)", "First reason goes on."), ("(2)", "Second reason.")]
    assert [(a.number, a.title, a.paragraphs) for a in d.articles] == [
        ("1", "Subject matter", ["This Regulation lays down rules."]), ("2a", None, ["It shall enter into force."])]
    assert [(a.annex_id, a.title, a.prose) for a in d.annexes] == [("I", "ANNEX I", "List of things")]
    assert d.concluding_formulas == "Done at Brussels, 2 January 1996."
    strict = act(spark, ACT, strict=True).first().document
    assert strict.annexes == [] and strict.articles[1].paragraphs[-1].startswith("Done at")
    rows = P.sections(df).orderBy("container", "ordinal").collect()
    assert [r.section_path for r in rows] == ["enacting.article_1", "enacting.article_2a", "preamble.recitals[0]", "preamble.recitals[1]"]
    source = {"preamble": d.preamble_text, "enacting": d.enacting_text}
    assert all(source[r.container][r.base_offset:r.base_offset + len(r.text)] == r.text for r in rows)
    assert df.select(P.quality_rejection()).first()[0] == f"enacting_text too short ({len(d.enacting_text)} chars)"


def test_whereas_fallback(spark):
    d = act(spark, "Title line\nHaving regard to x,\nWhereas one;\nWhereas two;\nHAS ADOPTED THIS DECISION:\nArticle 1\nDone.").first().document
    assert [r.text for r in d.recitals] == ["Whereas one;", "Whereas two;"] and d.articles[0].title is None


PAGE = """<html><head><title>Fallback</title><script>var x="HAS ADOPTED THIS REGULATION";</script></head><body><div class="wrap">
<p class="oj-doc-ti">Commission  Regulation</p><p>Having regard to the Treaty,</p><p>Whereas:</p><p>Having regard to nothing</p>
<table><tr><td>(1)</td><td>First reason.</td></tr><tr><td>(2)</td><td>Second <b>reason</b>.</td></tr></table>
<p>HAS ADOPTED THIS REGULATION:</p><p class="oj-ti-art">Article 1</p><p>Scope</p><p>It applies to all goods.</p><p>Article 2</p><p>It enters into force.</p>
<p>ANNEX II</p><p>Some prose.</p><table><thead><tr><th>Code:</th><th>Rate</th></tr></thead><tr><td>A1</td><td>5</td><td>x</td></tr><tr><td>B2</td></tr></table>
<p>Done at Brussels.</p></div></body></html>"""


def test_html_act(spark):
    df = spark.createDataFrame([("c1", PAGE)], "id string, html string").select("id", H.html_blocks("html").alias("blocks"))
    df = df.select(H.html_document("id", "blocks").alias("document"))
    d = df.first().document
    assert d.title == "Commission Regulation" and d.citations == ["Having regard to the Treaty,"]
    assert [(r.number, r.text) for r in d.recitals] == [("(1)", "First reason."), ("(2)", "Second reason .")] or d.recitals[1].text == "Second reason."
    assert all(d.preamble_text[r.char_start:r.char_end] == r.text for r in d.recitals)
    assert [(a.number, a.title, a.paragraphs) for a in d.articles] == [("1", "Scope", ["It applies to all goods."]), ("2", None, ["It enters into force."])]
    assert d.enacting_text[d.articles[1].char_start:d.articles[1].char_end] == "It enters into force."
    table = d.annexes[0].tables[0]
    assert (d.annexes[0].annex_id, table.headers, table.rows) == ("II", ["Code:", "Rate"], [["A1", "5"], ["B2", ""]])
    assert d.concluding_formulas == "Done at Brussels."
    tables = df.select(F.explode("document.annexes").alias("a")).select(F.explode("a.tables").alias("t")).select("t.*")
    assert [r.sentence for r in P.linearised_rows(tables).orderBy("row_idx").collect()] == [
        "In Annex II, Table 0, row 0: Code = A1; Rate = 5.", "In Annex II, Table 0, row 1: Code = B2."]


def group(**over):
    return {"natural_language": "N", "source_quote": "Q", "subject": "s", "predicate": "p", "object": "o", **over}


@pytest.mark.parametrize("raw,good", [
    ("{", False), ("{}", False), ('{"facts": 3}', False), ('{"facts": []}', True), (json.dumps({"facts": [group()]}), True),
    (json.dumps({"facts": [group(), group(object=" ")]}), False), (json.dumps({"facts": [group(subject=5)]}), False), (json.dumps({"facts": ["x"]}), False),
    (json.dumps({"facts": [group(triples=[{"subject": "a", "predicate": "b", "object": "c"}, {"subject": "a", "predicate": "b"}])]}), False)])
def test_response_gate(spark, raw, good):
    df = spark.createDataFrame([(raw,)], "response string")
    assert (df.select(X.response_problem()).first()[0] == "") is good


def test_annotate_with_callable(spark):
    text = "The Council adopts rules. The deficit is high in this year."

    answer = json.dumps({"facts": [
        group(source_quote="The Council adopts rules.", condition="if asked", triples=[
            {"subject": "Council", "predicate": "adopts", "object": "rules"}, {"subject": "C", "predicate": "a", "object": "r", "condition": ""}]),
        group(source_quote="The deficit is hgh in this year"), group(source_quote="zzzz qqqq xxxx wwww")]})

    def model(prompt):
        return answer

    sections = spark.createDataFrame([("d1", "preamble.recitals[0]", 100, text)], "doc_id string, section_path string, base_offset int, text string")
    rows = X.annotate(sections, model, "m1").orderBy("fact_pos").collect()
    assert [(r.fact_pos, r.condition) for r in rows] == [(0, "if asked"), (1, ""), (1000, "")]
    loc = rows[2].source_locator
    assert text[loc.char_start - 100:loc.char_end - 100] == loc.quote and "deficit is high" in loc.quote and 70 <= rows[2].extra.anchor_score < 100
    assert rows[0].source_locator.char_start == 100 and rows[0].group_id == rows[1].group_id

    def broken(prompt):
        raise ConnectionError

    assert X.annotate(sections, broken, "m1").count() == 0


def test_best_window_against_exhaustive_search():
    def lcs(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    quote, text = "the deficit fell", "we saw that the defcit fell, in 2004"
    windows = [text[max(0, s):s + len(quote)] for s in range(1 - len(quote), len(text))]
    best = max(200 * lcs(quote, w) / (len(quote) + len(w)) for w in windows if w)
    score, start, end = best_window(quote, text)
    assert abs(score - best) < 1e-9 and "defcit fell" in text[start:end]
    rng = random.Random(8)
    for turn in range(400):
        letters = "ab" if turn % 2 else "abcdeé𝒳 "
        q, t = ("".join(rng.choice(letters) for _ in range(rng.randrange(1, top))) for top in (14, 40))
        if turn % 5 == 0:
            t = t + q[:3] + "z" + q[3:] + t
        short, long = (q, t) if len(q) <= len(t) else (t, q)
        tried = [(-Fraction(2 * lcs(short, w), len(short) + len(w)), s) for s in range(1 - len(short), len(long))
                 for w in [long[max(0, s) : s + len(short)]]]
        score, s = min(tried)
        place = (max(s, 0), min(s + len(short), len(long))) if short is q else (0, len(t))
        want = (float(-100 * score), *place) if score else (0.0, *place)
        assert best_window(q, t) == pytest.approx(want)
        assert best_window(q, t, 70) == (pytest.approx(want) if want[0] >= 70 else (0.0, 0, 0))
    assert best_window("", "x") == best_window("x", "") == (0.0, 0, 0)
    long = "lorem ipsum dolor " * 20_000
    assert best_window("a deficit of two percnt", long + "a deficit of two percent" + long, 70)[1] == len(long)


def test_spo_bands(spark):
    rows = [(1, "The Commission services' estimate was revised.", "the commission", "was revised", "services estimate of the Commission"),
            (2, "a deficit of 2,3 % of GDP", "deficit", "of", "gdp of 2,3 % total"), (3, None, "x", "y", None), (4, "nothing here", "", " ", "other words"),
            (5, "one two one two three", "two", "one", "three two")]
    df = spark.createDataFrame(rows, "i int, q string, s string, p string, o string")
    df = df.toDF("i", "quote", "subject", "predicate", "object")
    got = {i: [] for i in range(1, 6)}
    for r in B.spo_bands(df, ["i"]).orderBy("i", "start").collect():
        got[r.i].append((r.start, r.end, r.role, r.fuzzy))
    assert got[1] == [(0, 14, "subject", False), (14, 33, "object", True), (34, 45, "predicate", False)]
    assert got[2] == [(2, 9, "subject", False), (10, 12, "predicate", False), (13, 25, "object", True)]
    assert got[3] == got[4] == [] and got[5] == [(4, 7, "subject", False), (8, 11, "predicate", False), (12, 21, "object", True)]
    for spans in got.values():
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    spans = B.tokens(df.where("i = 2").withColumn("low", F.lower("quote")), ["i"]).orderBy("idx").collect()
    assert [(x.token, x.start, x.end) for x in spans][3:5] == [("2,3", 13, 16), ("%", 17, 18)]


def _windows(needle, quote):
    """The fuzzy band by trying every window."""
    tokens = lambda s: [(m[0], m.start(), m.end()) for m in re.finditer(r"\d+(?:[.,]\d+)?|%|[^\W\d_]+", s.lower())]
    want, held = [t for t, _, _ in tokens(needle)], tokens(quote)
    best = None
    for a in range(len(held)):
        if held[a][0] in want:
            for b in range(a, min(a + len(want) + 2, len(held))):
                hits = (Counter(want) & Counter(t for t, _, _ in held[a : b + 1])).total()
                if hits / len(want) >= 0.55 and (best is None or (-hits, b - a) < best[0]):
                    best = ((-hits, b - a), held[a][1], held[b][2])
    return best and best[1:]


def test_fuzzy_bands_against_every_window(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        words = ["one", "two", "2,5", "%", "vier", "É", "six"][: rng.randrange(2, 8)]
        quote = "".join(rng.choice(words) + rng.choice([" ", ", ", " - "]) for _ in range(rng.randrange(1, 30)))
        rows.append((i, "object", quote.lower(), " ".join(rng.choice([*words, "absent"]) for _ in range(rng.randrange(1, 9))).lower()))
    rows.append((150, "object", "one two " * 4000, "two two one absent"))
    df = spark.createDataFrame(rows, "i int, role string, low string, needle string")
    got = {r.i: (r.start, r.end) for r in B.fuzzy_bands(df, ["i"]).collect()}
    assert got == {i: w for i, _, low, needle in rows if (w := _windows(needle, low))} and len(got) > 50


def test_fact_files_and_guidelines(spark, tmp_path):
    for directory, annotator, n in (("a_dir", "model:x", 1), ("b_dir", "model:x", 2), ("c_dir", "", 1)):
        (tmp_path / "facts" / directory).mkdir(parents=True)
        facts = [{"fact_id": f"{directory}{i}", "subject": "s", "predicate": "p", "object": "o"} for i in range(n)]
        (tmp_path / "facts" / directory / "doc1.json").write_text(json.dumps({"doc_id": "doc1", "annotator": annotator, "facts": facts}, indent=1))
    (tmp_path / "facts" / "a_dir" / "bad.json").write_text("{nope")
    rows = S.read_fact_files(spark, str(tmp_path / "facts")).collect()
    assert sorted((r.annotator, r.fact_id) for r in rows) == [("c_dir", "c_dir0"), ("model:x", "b_dir0"), ("model:x", "b_dir1")]
    assert rows[0].condition == "" and rows[0].guideline_version == "v1"
    (tmp_path / "extract_v2.md").write_text("# Guideline (second)\n### 99. Outside\n<guideline>\n### 1. Be brief \n### 12. Keep conditions\n</guideline>\n")
    (tmp_path / "ids.txt").write_text("# head\n\n 32004D0001 \n32005D0002\n")
    g = S.read_guidelines(spark, str(tmp_path))
    assert (g.first().version, g.first().summary) == ("v2", "Guideline (second)")
    assert [(r.rule_id, r.title) for r in S.guideline_rules(g).orderBy("ordinal").collect()] == [("1", "Be brief"), ("12", "Keep conditions")]
    assert S.read_id_list(spark, str(tmp_path / "ids.txt")).count() == 2
    assert S.version_of("base") == "v1" and S.version_of("v2.1") == "v2.1"
    with pytest.raises(ValueError):
        S.version_of("../x")
    assert S.read_table(spark, str(tmp_path / "nothing"), "a int").count() == 0


def test_documents_wrapped_or_bare(spark, tmp_path):
    doc = {"celex": "c", "title": "t", "recitals": [], "articles": [], "preamble_text": "p", "enacting_text": ""}
    (tmp_path / "a.json").write_text(json.dumps({"document": doc}))
    (tmp_path / "b.json").write_text(json.dumps({**doc, "celex": "c2"}))
    (tmp_path / "c.json").write_text("broken")
    assert sorted(r.document.celex for r in S.read_documents(spark, str(tmp_path) + "/*.json").collect()) == ["c", "c2"]


def test_sinks(spark, make_facts, tmp_path):
    facts = make_facts([fact("m:1", "a1", "s", 'say "x", y', "o"), fact("m:1", "a2", "s", "p", "o", version="v2"), fact("m:1", "a3", "s", "p", "o", doc="d2")])
    path = str(tmp_path / "wh" / "facts")
    K.write_by_version(facts, path)
    K.write_by_version(facts.where("guideline_version = 'v2'"), path)
    assert spark.read.parquet(path).count() == 3
    assert K.drop_document(spark, str(tmp_path / "wh"), str(tmp_path / "wh2"), "d2") == {"facts": 1}
    assert spark.read.parquet(str(tmp_path / "wh2" / "facts")).count() == 2
    K.write_export(facts.select("fact_id", "predicate"), str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert 'a1,"say ""x"", y"' in text
    K.write_fact_files(facts, str(tmp_path / "json"))
    assert (tmp_path / "json" / "guideline_version=v1" / "model_dir=m_1").exists()


def test_selection_resumes(spark):
    base = act(spark, ACT.replace("This Regulation lays down rules.", "This Regulation lays down rules. " * 12))
    df = base.withColumn("source_index", F.lit(1)).withColumn("n_words", F.lit(90))
    none = spark.createDataFrame([], "doc_id string")
    chosen = S.select_documents(df, none, 5)
    assert chosen.first().article_count == 2
    assert S.select_documents(df, chosen, 5).count() == 0


def test_synthetic_annotators(spark, make_facts):
    rows = [fact("q", f"f{i}", "the Council", "decided", f"deficit of 2,3 % for state {i} and others") for i in range(300)]
    facts = make_facts(rows)
    friendly, adverse = Y.synthesize(facts, "g", "friendly").collect(), Y.synthesize(facts, "p", "adversarial").collect()
    ops = {r.synth_op for r in friendly} | {r.synth_op for r in adverse}
    assert {"granularity_split", "number_perturb_object", "predicate_paraphrase", "entity_swap_subject"} <= ops
    bumped = [r.object for r in adverse if r.synth_op == "number_perturb_object"]
    assert {b.split(" for")[0] for b in bumped} == {"deficit of 2,6 %", "deficit of 2,8 %", "deficit of 3,0 %"}
    assert len({r.fact_id for r in friendly}) == len(friendly) and len({r.derived_from for r in adverse}) < 300
    assert all("qualified" in r.predicate or r.predicate == "decided" for r in friendly if r.synth_op == "granularity_split")


def test_pipeline_and_incremental_run(spark, tmp_path):
    things = [("council", "budget"), ("member state", "frontier"), ("deficit", "growth path")]
    rows = [fact(a, f"{a}{i}{d}", s, "adopts", o, doc=d, pos=i, extra=None) for a in ("A", "B") for d in ("d1", "d2") for i, (s, o) in enumerate(things)]
    rows += [fact("A", "solo", "x", "y", "z", doc="d3")]
    for r in rows:
        r["extra"] = None
    ddl = FACT_DDL + ", extra struct<anchor_score:double,model_quote:string,triple_index:int>"
    facts = spark.createDataFrame(rows, ddl)
    out = phase2.run(facts)
    assert {r.doc_id for r in out["pairs"].collect()} == {"d1", "d2"}
    assert out["label_counts"].where("conflict_label = 'redundancy'").agg(F.sum("n")).first()[0] == 6
    assert out["graph_edges"].count() == out["statements"].count() == 6
    seen = []

    def publish(batch, number):
        seen.append({(r.doc_id, r.n) for r in batch.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()})

    path, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    facts.where("annotator = 'A' and doc_id = 'd1'").write.mode("append").parquet(path)
    follow_facts(spark, path, ck, publish).awaitTermination(120)
    facts.where("annotator = 'B' and doc_id = 'd1'").write.mode("append").parquet(path)
    follow_facts(spark, path, ck, publish).awaitTermination(120)
    assert seen == [{("d1", 3)}, {("d1", 6)}]


def test_every_query_is_registered_once():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 120


def test_responses_are_read_and_anchored_once(spark, tmp_path):
    rows = [(f'{{"facts": {f}}}',) for f in (
        "[]", "null", '"[]"', "{}", "[null]", "[1]", '[{"natural_language": "n", "source_quote": "q", "subject": "s", "predicate": "p", "object": "o"}]',
        '[{"natural_language": "n", "source_quote": "q", "triples": [], "subject": "s", "predicate": "p", "object": 1}]',
        '[{"natural_language": "n", "source_quote": "q", "triples": {"a": 1}, "subject": "s", "predicate": "p", "object": "o"}]',
        '[{"natural_language": "n", "source_quote": "q", "triples": [{"subject": "s", "predicate": "p", "object": "o"}, null]}]')]
    spark.createDataFrame([*rows, ("{}",), ("no",), (None,)], "response string").coalesce(1).write.parquet(f"{tmp_path}/r")
    read = spark.read.parquet(f"{tmp_path}/r")
    assert [r.p for r in read.select(X.response_problem().alias("p")).collect()] == [
        "", *["facts is not an array"] * 3, *["missing or blank required field"] * 2, "", "missing or blank required field", "",
        "missing or blank required field", "no facts key", "not valid JSON", "not valid JSON"]
    sections = read.withColumns({"section_text": F.lit("a q b"), "base_offset": F.lit(7)})
    anchored = X.anchor_quotes(X.parse_responses(sections))
    assert [(r.char_start, r.char_end, r.anchor_score) for r in anchored.collect()] == [(9, 10, 100.0)] * 2
    plan = anchored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == plan.count("from_json(") == plan.count("parseJson") == 1
