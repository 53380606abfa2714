import json

import pytest
from pyspark.sql import functions as F

from facts import fact
from factloom.functions import rules as R
from factloom.functions import text as T
from factloom.operators import label as L
from factloom.operators.parsing import parsed_document_of_text


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first().x


def split(spark, text, mode):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return [(r.char_start, r.char_end, r.body) for r in T.explode_sections(df, "text", mode).orderBy("pos").collect()]


@pytest.mark.parametrize("mode", ["paragraph", "sentence"])
def test_sections_keep_offsets(spark, mode):
    text = "\n\n  First one. Second – “quoted” bit!\n\n\nThird élan?  \"Yes.\" (Fourth 😀 part.) and on.\n \n tail \n"
    parts = split(spark, text, mode)
    assert all(text[s:e] == body == body.strip() for s, e, body in parts)
    assert len(parts) == (3 if mode == "paragraph" else 4)
    assert split(spark, " \n ", mode) == []
    assert split(spark, "no break here", mode) == [(0, 13, "no break here")]


def test_unknown_split_mode():
    with pytest.raises(ValueError):
        T._pieces(F.lit("x"), "word")


def test_pasted_text_document(spark):
    d = one(spark, parsed_document_of_text(F.col("t"), F.col("x"), "sentence"), t="Title", x="One is here. Two is here.")
    assert d.celex.startswith("user-") and len(d.celex) == 15 and d.title == "Title"
    assert [r.number for r in d.recitals] == ["(1)", "(2)"]
    assert all(d.preamble_text[r.char_start:r.char_end] == r.text for r in d.recitals)


@pytest.mark.parametrize("name,core,qualifiers", [
    ("the Council", "Council", []),
    ("the Decision of 12 March 2004", "Decision", ["of 12 March 2004"]),
    ("the deficit in 2004", "deficit", ["in 2004"]),
    ("further decline of the cyclically adjusted deficit of the state", "further decline", ["of the cyclically adjusted deficit of the state"]),
    ("the", "the", []), ("", "", []), ("Kingdom of Spain", "Kingdom of Spain", []),
    ("a b c d e f g h i j k", "b c d e f g h i", []),
])
def test_split_entity(spark, name, core, qualifiers):
    out = one(spark, T.split_entity("n"), n=name)
    assert (out.core, out.qualifiers) == (core, qualifiers)


@pytest.mark.parametrize("raw,key", [("shall fix", "fix"), ("May  fix", "fix"), ("is", "is"), ("shall be", "be"), ("are held by", "held by"), ("to the", "the")])
def test_predicate_key(spark, raw, key):
    assert one(spark, T.predicate_key("p"), p=raw) == key


def test_ids_labels_and_hue(spark):
    import hashlib
    assert one(spark, T.fact_id("a", "b", "c", "d", "e"), a="m", b="doc", c="sec", d=1, e=0) == hashlib.sha1(b"m|doc|sec|1|0").hexdigest()[:16]
    assert one(spark, T.pasted_text_id("a", "b"), a="t", b="x") == "user-" + hashlib.sha1(b"t\0x").hexdigest()[:10]
    assert one(spark, T.display_label("a"), a="x" * 40) == "x" * 33 + "…"
    h = 2166136261
    for ch in "ab12":
        h = ((h ^ ord(ch)) * 16777619) % 2 ** 32
    assert one(spark, T.fnv1a_hue("a"), a="ab12") == h % 360


def test_overlap_edge_cases(spark):
    assert one(spark, R.trigram_jaccard("a", "b"), a="ab", b="x") == 1.0
    assert one(spark, R.trigram_jaccard("a", "b"), a="abc", b="x") == 0.0
    assert one(spark, R.trigram_jaccard("a", "b"), a="a  BCD", b="a bcd") == 1.0


def matched(spark, a, b, cosine, status="matched"):
    cols = "guideline_version string, doc_id string, fact_a_id string, fact_b_id string, cosine double, status string"
    pairs = spark.createDataFrame([("v1", "d1", a and a["fact_id"], b and b["fact_id"], cosine, status)], cols)
    from facts import FACT_DDL
    facts = spark.createDataFrame([f for f in (a, b) if f], FACT_DDL)
    return L.layer1(L.attach_sides(pairs, facts))


def test_rule_labels(spark):
    same = matched(spark, fact("A", "a1", "Council", "adopts", "rule"), fact("B", "b1", "Council", "adopts", "rule"), 0.99).first()
    assert same.conflict_label == "redundancy" and same.layer1_reason == "cos=0.990≥0.95; subj+obj trigram jaccard=1.00≥0.75"
    number = matched(spark, fact("A", "a1", "deficit", "is", "2,3 %"), fact("B", "b1", "deficit", "is", "2,8 %"), 0.9).first()
    assert number.conflict_label == "escalate" and number.layer1_reason.startswith("numeric mismatch: A=['2,3']  B=['2,8']")
    polar = matched(spark, fact("A", "a1", "x", "is", "valid"), fact("B", "b1", "x", "is not", "valid"), 0.9).first()
    assert polar.layer1_reason == "polarity asymmetry: A=∅ B=['not']"
    cited = matched(spark, fact("A", "a1", "x", "cites", "y", nl="x cites Regulation No 584/75"), fact("B", "b1", "x", "cites", "y", nl="x cites y"), 0.9).first()
    assert cited.layer1_reason.startswith("no rule fired")
    orphan = matched(spark, fact("A", "a1", "x", "p", "y"), None, None, "unmatched_a").first()
    assert (orphan.conflict_label, orphan.layer1_reason, orphan.cosine) == ("unlabeled", "orphan_unmatched_a", 0.0)
    alone = matched(spark, fact("A", "a1", "x", "p", "y"), None, 0.0, "unmatched_a").first()
    assert alone.layer1_reason == "best partner cosine=0.000 < 0.78"
    elsewhere = matched(spark, fact("A", "a1", "x", "p", "y"), None, 0.9, "unmatched_a").first()
    assert elsewhere.layer1_reason == "best partner cosine=0.900, assigned elsewhere"


def test_arbiter_only_sees_open_pairs(spark):
    open_pair = matched(spark, fact("A", "a1", "x", "is", "1,5 %"), fact("B", "b1", "x", "is", "2,5 %"), 0.9)
    closed = matched(spark, fact("A", "a1", "x", "is", "y"), fact("B", "b1", "x", "is", "y"), 1.0)

    def arbiter(prompt):
        assert "1,5 %" in prompt
        return json.dumps({"label": "no_conflict", "reason": "because"})

    row = L.layer2(open_pair, arbiter).first()
    assert (row.conflict_label, row.layer2_reason, row.layer2_called) == ("no_conflict", "because", True)
    assert L.layer2(closed, arbiter).first().layer2_called is False
    assert L.layer2(open_pair).first().conflict_label == "contradiction"
    assert L.layer2(open_pair, strict=True).first().conflict_label == "contradiction"

    def broken(prompt):
        raise TimeoutError("slow")

    failed = L.layer2(open_pair, broken).first()
    assert (failed.conflict_label, failed.layer2_reason) == ("escalate", "call failed: TimeoutError")
    odd = L.layer2(open_pair, lambda p: '{"label": "MAYBE"}').first()
    assert odd.conflict_label == "escalate" and odd.layer2_reason == "label not allowed: MAYBE"
    told = L.try_arbiter(spark.createDataFrame([("q",)], "question string"), lambda q: '{"label": "NEW"}').first()
    assert (told.label, told.reason, told.failure) == ("NEW", None, None)
    raws = spark.createDataFrame([(r,) for r in (None, " ", "{", "{}", '{"label": 3}', '{"label": "granularity", "reason": " r "}')], "raw string")
    got = [tuple(r.v) for r in raws.select(L.verdict(raws["raw"]).alias("v")).collect()]
    assert got == [(None, "", "no answer"), (None, "", "no answer"), (None, "", "answer is not JSON"), (None, "", "answer has no label"),
                   (None, "", "label not allowed: 3"), ("granularity", "r", "")]


def test_template_comment_is_dropped(spark):
    assert one(spark, L.template_body(F.col("t")), t="<!-- note\nmore -->\n\nBody <!-- kept -->") == "Body <!-- kept -->"


@pytest.mark.parametrize("labels,best", [([], "unlabeled"), (["redundancy", "contradiction"], "contradiction"), (["escalate"], "escalate")])
def test_strongest(spark, labels, best):
    df = spark.createDataFrame([(labels,)], "l array<string>")
    assert df.select(R.strongest("l")).first()[0] == best
