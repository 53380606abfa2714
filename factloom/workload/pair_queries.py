"""Encoding, alignment and labelling over the derived annotators."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from factloom.functions import rules as R
from factloom.functions import text as T
from factloom.operators import align as A
from factloom.operators import encode as E
from factloom.operators import label as L
from factloom.plans import phase2
from factloom.sources.tables import facts, pairs, stored_sentences, table
from factloom.workload.base import TRIGRAMS_SQL, facts_sql, pairs_sql, register, with_sql
from factloom.workload.text_queries import JACCARD_SQL

PAIR_COLUMNS = ["subject", "predicate", "object", "natural_language", "quote"]


def fact_bound(spark, sf) -> int:
    """Upper bound of the fact text of any document: three facts per sentence plus their fixed words."""
    longest = table(spark, sf, "documents").agg(F.max(F.length("text"))).first()[0] or 0
    return 8 * longest


def known_pairs(spark, sf, versions=("v1",), base=None):
    """``base``: what the query has stored of the sentences already; three tables are derived from them."""
    base = stored_sentences(spark, sf) if base is None else base
    return L.attach_sides(pairs(spark, sf, versions, base), facts(spark, sf, versions, base))


def labelled(spark, sf, versions=("v1",), base=None):
    return L.layer2(L.layer1(known_pairs(spark, sf, versions, base)))


TFIDF_SQL = r"""
item AS (SELECT doc_id, fact_id, natural_language AS text FROM facts WHERE annotator = 'ann_a'),
word AS (SELECT doc_id, fact_id, ' ' || unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) || ' ' AS w FROM item),
gram AS (SELECT doc_id, fact_id, unnest(list_concat(list_concat(
    list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3)),
    list_transform(range(1, length(w) - 2), lambda i: substring(w, i, 4))),
    list_transform(range(1, length(w) - 3), lambda i: substring(w, i, 5)))) AS gram FROM word),
tf AS (SELECT doc_id, fact_id, gram, count(*) AS tf FROM gram GROUP BY ALL),
df AS (SELECT doc_id, gram, count(*) AS df FROM tf GROUP BY ALL),
total AS (SELECT doc_id, count(*) AS n FROM item GROUP BY doc_id),
raw AS (SELECT doc_id, fact_id, gram, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS r
  FROM tf JOIN df USING (doc_id, gram) JOIN total USING (doc_id)),
norm AS (SELECT doc_id, fact_id, count(*) AS n_grams, sqrt(sum(r * r)) AS norm FROM raw GROUP BY ALL),
weight AS (SELECT doc_id, fact_id, gram, r / norm AS w FROM raw JOIN norm USING (doc_id, fact_id))"""


def _ann_a(spark, sf):
    return facts(spark, sf, base=stored_sentences(spark, sf)).where("annotator = 'ann_a'")


@register("c4_tfidf_vectors", with_sql(facts_sql() + "," + TFIDF_SQL, """
SELECT doc_id, fact_id, count(*) AS n_grams, round(max(w), 6) AS heaviest, round(sum(w), 5) AS total FROM weight GROUP BY ALL"""))
def c4(spark, sf):
    w = E.gram_weights(_ann_a(spark, sf), ["doc_id"], "fact_id", "natural_language", fact_bound(spark, sf))
    return w.groupBy("doc_id", "fact_id").agg(F.count(F.lit(1)).alias("n_grams"), F.round(F.max("weight"), 6).alias("heaviest"),
                                              F.round(F.sum("weight"), 5).alias("total"))


@register("j2_pair_cosine", with_sql(facts_sql() + "," + TFIDF_SQL + """,
nexts AS (SELECT doc_id, fact_id AS a, lead(fact_id) OVER (PARTITION BY doc_id ORDER BY fact_pos) AS b FROM facts WHERE annotator = 'ann_a')""", """
SELECT nexts.doc_id, a, b, round(coalesce(sum(x.w * y.w), 0), 6) AS cosine
FROM nexts LEFT JOIN (weight x JOIN weight y ON x.doc_id = y.doc_id AND x.gram = y.gram)
  ON x.doc_id = nexts.doc_id AND x.fact_id = nexts.a AND y.fact_id = nexts.b
WHERE b IS NOT NULL GROUP BY ALL""").replace("""LEFT JOIN (weight x JOIN weight y ON x.doc_id = y.doc_id AND x.gram = y.gram)
  ON x.doc_id = nexts.doc_id AND x.fact_id = nexts.a AND y.fact_id = nexts.b""", """JOIN weight x ON x.doc_id = nexts.doc_id AND x.fact_id = nexts.a
  LEFT JOIN weight y ON y.doc_id = nexts.doc_id AND y.fact_id = nexts.b AND y.gram = x.gram"""))
def j2(spark, sf):
    from pyspark.sql import Window as W
    f = _ann_a(spark, sf)
    nexts = f.select("doc_id", F.col("fact_id").alias("a"), F.lead("fact_id").over(
        W.partitionBy("doc_id").orderBy("fact_pos")).alias("b")).where("b is not null")
    return E.pair_cosines(nexts, f, ["doc_id"], "fact_id", "natural_language", "a", "b", fact_bound(spark, sf)).select(
        "doc_id", "a", "b", F.round("cosine", 6).alias("cosine"))


@register("c5_embedding_cosine", """
SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def c5(spark, sf):
    e = table(spark, sf, "embeddings")
    a = e.select(F.col("vec_id").alias("vec_a"), F.col("embedding").alias("ea"), (F.col("vec_id") + 1).alias("vec_b"))
    b = e.select(F.col("vec_id").alias("vec_b"), F.col("embedding").alias("eb"))
    return a.join(b, "vec_b").select("vec_a", "vec_b", F.round(E.dense_cosine(F.col("ea"), F.col("eb")), 6).alias("cosine"))


def _vector_facts(spark, sf):
    """Twenty consecutive vectors make a document, odd and even ids its annotators."""
    return table(spark, sf, "embeddings").select(
        F.lit("v1").alias("guideline_version"), (F.col("vec_id") / 20).cast("long").cast("string").alias("doc_id"),
        F.when(F.col("vec_id") % 2 == 0, F.lit("even")).otherwise(F.lit("odd")).alias("annotator"),
        F.col("vec_id").cast("string").alias("fact_id"), F.col("vec_id").alias("fact_pos"), F.col("embedding").alias("vector"))


@register("j3_embedding_alignment")
def j3_dense(spark, sf):
    """Assignment on stored vectors."""
    e = _vector_facts(spark, sf)
    out = A.align(e.withColumn("quote", F.lit("")), threshold=0.2, carry=[], vector="vector")
    return out.withColumn("cosine", F.round("cosine", 4))


@register("j3_assignment_certificate", """
WITH f AS (SELECT CAST(vec_id // 20 AS VARCHAR) AS doc_id, vec_id % 2 = 0 AS even FROM embeddings),
n AS (SELECT doc_id, count(*) FILTER (WHERE even) AS n_a, count(*) FILTER (WHERE NOT even) AS n_b FROM f GROUP BY doc_id)
SELECT doc_id, n_a, n_b, least(n_a, n_b) AS n_assigned, n_a * n_b AS n_pairs, 0 AS n_violations, 0.0 AS gap FROM n WHERE n_a > 0 AND n_b > 0""")
def j3_certificate(spark, sf):
    """Every assignment on stored vectors is optimal: the solver's prices hold against cosines that Spark computes."""
    f = _vector_facts(spark, sf)
    priced = A.align(f.withColumn("quote", F.lit("")), threshold=0.2, carry=[], vector="vector", prices=True)
    side = lambda who, s: f.where(F.col("annotator") == who).select(*A.SCOPE, F.col("annotator").alias(f"annotator_{s}"), F.col("fact_id").alias(f"fact_{s}_id"),
                                                                    F.col("vector").alias(f"vector_{s}"))
    every = side("even", "a").join(side("odd", "b"), A.SCOPE)
    every = every.withColumn("cosine", E.dense_cosine(F.col("vector_a"), F.col("vector_b"))).drop("vector_a", "vector_b")
    return A.certificate(priced, every).select("doc_id", "n_a", "n_b", "n_assigned", "n_pairs", "n_violations", "gap")


@register("j1_annotator_pairs", """
WITH r AS (SELECT DISTINCT conv_id, role FROM conversations)
SELECT CAST(a.conv_id AS VARCHAR) AS doc_id, a.role AS annotator_a, b.role AS annotator_b FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.role < b.role""")
def j1(spark, sf):
    f = table(spark, sf, "conversations").select(F.lit("v1").alias("guideline_version"), F.col("conv_id").cast("string").alias("doc_id"), F.col("role").alias("annotator"))
    return A.annotator_pairs(f).drop("guideline_version")


@register("j3_j4_aligned_pairs")
def j34(spark, sf):
    aligned = A.align_any(facts(spark, sf), carry=[], largest_document=fact_bound(spark, sf))
    return aligned.select("doc_id", "annotator_a", "annotator_b", "fact_a_id", "fact_b_id", F.round("cosine", 4).alias("cosine"), "status")


@register("j4_silent_annotators", with_sql(facts_sql(), """
SELECT doc_id, least(annotator, other) AS annotator_a, greatest(annotator, other) AS annotator_b, CASE WHEN annotator < other THEN fact_id END AS fact_a_id,
  CASE WHEN annotator > other THEN fact_id END AS fact_b_id, CASE WHEN annotator < other THEN 'unmatched_a' ELSE 'unmatched_b' END AS status,
  0.0 AS cosine, 'orphan_' || CASE WHEN annotator < other THEN 'unmatched_a' ELSE 'unmatched_b' END AS layer1_reason, CASE WHEN annotator < other THEN subject END AS a_subject
FROM facts JOIN (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(['ann_a', 'ann_b', CASE WHEN lang = 'en' THEN 'ann_aa' ELSE 'ann_c' END]) AS other FROM documents
  EXCEPT SELECT doc_id, annotator FROM facts) USING (doc_id)"""))
def j4_silent(spark, sf):
    """Everybody was asked about every document; one annotator, another one by language, found nothing."""
    d = table(spark, sf, "documents").select(F.lit("v1").alias("guideline_version"), F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.array(
        F.lit("ann_a"), F.lit("ann_b"), F.when(F.col("lang") == "en", F.lit("ann_aa")).otherwise(F.lit("ann_c")))).alias("annotator"))
    orphans = L.layer1(A.orphans_of_empty_sides(facts(spark, sf), d, A.CARRY))
    return orphans.select("doc_id", "annotator_a", "annotator_b", "fact_a_id", "fact_b_id", "status", "cosine", "layer1_reason", "a_subject")


@register("phase2_label_counts")
def phase2_counts(spark, sf):
    out = phase2.labelled_pairs(facts(spark, sf), largest_document=fact_bound(spark, sf))
    return phase2.corpus_label_counts(out)


@register("s3_comparable_documents", with_sql(facts_sql(), """
SELECT guideline_version, doc_id, count(DISTINCT annotator) AS n_annotators FROM facts GROUP BY ALL HAVING count(DISTINCT annotator) >= 2"""))
def s3(spark, sf):
    from factloom.sources.files import comparable_documents
    return comparable_documents(facts(spark, sf))


@register("l7_run_guard", with_sql(facts_sql(), """
SELECT guideline_version, doc_id, count(DISTINCT annotator) AS n_annotators,
  CASE WHEN count(DISTINCT annotator) >= 2 THEN 'ok' ELSE 'refused' END AS status,
  CASE WHEN count(DISTINCT annotator) < 2 THEN 'needs at least two annotators' END AS error FROM facts GROUP BY ALL"""))
def l7(spark, sf):
    from factloom.sources.files import run_guard
    return run_guard(facts(spark, sf))


def _fixed(x, d):
    return f"printf('%.{d}f', floor({x} * {10 ** d} + 0.5) / {10 ** d}.0)"


def _quoted(x, empty):
    return f"CASE WHEN len({x}) = 0 THEN '{empty}' ELSE '[' || array_to_string(list_transform({x}, lambda v: '''' || v || ''''), ', ') || ']' END"


_POL = r"""list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace({x}, '(?i)\bno\.?\s*\d', ' ', 'g'), '[A-Za-z]+'),
  lambda v: lower(v)), lambda v: v IN ('not','no','never','without','fails','failed','unable'))))"""


def labelled_sql(versions=("v1",)) -> str:
    """CTE list ending in ``labelled``: pairs with both layers applied."""
    same = "len(list_filter({a}, lambda v: NOT list_contains({b}, v))) = 0 AND len(list_filter({b}, lambda v: NOT list_contains({a}, v))) = 0"
    redundant = "cosine >= 0.95 AND overlap >= 0.75"
    numeric = "len(na) > 0 AND len(nb) > 0 AND NOT (" + same.format(a="na", b="nb") + ")"
    polar = "NOT (" + same.format(a="pa", b="pb") + ")"
    low = r"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"
    return pairs_sql(versions) + rf""",
sided AS (
  SELECT p.*, a.quote AS qa, b.quote AS qb, a.natural_language AS nla, b.natural_language AS nlb,
    trim(a.subject || ' ' || a.object) AS soa, trim(b.subject || ' ' || b.object) AS sob
  FROM pairs p LEFT JOIN facts a ON p.guideline_version = a.guideline_version AND p.fact_a_id = a.fact_id
  LEFT JOIN facts b ON p.guideline_version = b.guideline_version AND p.fact_b_id = b.fact_id),
grams3 AS (SELECT *, {TRIGRAMS_SQL.format(x='la')} AS ta, {TRIGRAMS_SQL.format(x='lb')} AS tb FROM (
  SELECT *, {low.format(x='soa')} AS la, {low.format(x='sob')} AS lb FROM sided)),
measured AS (SELECT *, {JACCARD_SQL} AS overlap, regexp_extract_all(soa, '\d+[,.]?\d*') AS na, regexp_extract_all(sob, '\d+[,.]?\d*') AS nb,
  {_POL.format(x='nla')} AS pa, {_POL.format(x='nlb')} AS pb FROM grams3),
ruled AS (SELECT *, CASE WHEN status <> 'matched' THEN 'unlabeled' WHEN {redundant} THEN 'redundancy' ELSE 'escalate' END AS l1,
  CASE WHEN status <> 'matched' THEN 'best partner cosine=' || {_fixed('cosine', 3)} || CASE WHEN cosine < 0.78 THEN ' < 0.78' ELSE ', assigned elsewhere' END
    WHEN {redundant} THEN 'cos=' || {_fixed('cosine', 3)} || '≥0.95; subj+obj trigram jaccard=' || {_fixed('overlap', 2)} || '≥0.75'
    WHEN {numeric} THEN 'numeric mismatch: A=' || {_quoted('na', '[]')} || '  B=' || {_quoted('nb', '[]')} || '; cos=' || {_fixed('cosine', 3)}
    WHEN {polar} THEN 'polarity asymmetry: A=' || {_quoted('pa', '∅')} || ' B=' || {_quoted('pb', '∅')}
    ELSE 'no rule fired; cos=' || {_fixed('cosine', 3)} || ' overlap=' || {_fixed('overlap', 2)} END AS layer1_reason FROM measured),
labelled AS MATERIALIZED (SELECT *, (status = 'matched' AND l1 = 'escalate') AS layer2_called,
  CASE WHEN status = 'matched' AND l1 = 'escalate' THEN
    CASE WHEN len(list_distinct(regexp_extract_all(qa || chr(10) || nla || chr(10) || nlb, '\d+[,.]?\d+\s*%'))) >= 2 THEN 'contradiction'
      WHEN contains(lower(qa || chr(10) || nla || chr(10) || nlb), 'split') OR contains(lower(qa || chr(10) || nla || chr(10) || nlb), 'qualified') THEN 'granularity'
      ELSE 'redundancy' END ELSE l1 END AS conflict_label FROM ruled)"""


@register("l1_rule_labels", with_sql(labelled_sql(), "SELECT fact_a_id, fact_b_id, status, l1 AS conflict_label, layer1_reason FROM labelled"))
def l1(spark, sf):
    return L.layer1(known_pairs(spark, sf)).select("fact_a_id", "fact_b_id", "status", "conflict_label", "layer1_reason")


@register("l2_stub_verdicts", with_sql(labelled_sql(), """
SELECT fact_a_id, fact_b_id, conflict_label, layer2_called, CASE WHEN layer2_called THEN 'stub:' || conflict_label END AS layer2_reason FROM labelled"""))
def l2(spark, sf):
    return labelled(spark, sf).select("fact_a_id", "fact_b_id", "conflict_label", "layer2_called", "layer2_reason")


REPLAYED = ["CONTRADICTION", "granularity", "Redundancy", "NO_CONFLICT"]


def replay(question: str) -> str:
    """Answers as they were stored once: the digest of the question picks one, every fourth is of no use."""
    h = hashlib.sha1(question.encode()).hexdigest()
    d = int(h[0], 16)
    return (json.dumps({"label": REPLAYED[d % 4], "reason": f" told {h[1]} "}) if d < 12
            else [" ", "no json", '{"label": "MAYBE"}', '{"reason": "none"}'][d - 12])


@register("l2_replayed_answers", with_sql(labelled_sql() + """,
asked AS (SELECT fact_a_id, fact_b_id, sha1(replace(replace(replace(replace(t.body, '<<DOC_TITLE>>', doc_id), '<<SOURCE_QUOTE>>', qa), '<<FACT_A>>', nla), '<<FACT_B>>', nlb)) AS h
  FROM labelled, (SELECT '%s' AS body) t WHERE layer2_called),
told AS (SELECT *, strpos('0123456789abcdef', h[1]) - 1 AS d FROM asked)""" % L.ARBITER_TEMPLATE.replace("'", "''"), """
SELECT fact_a_id, fact_b_id, CASE WHEN d < 12 THEN ['contradiction', 'granularity', 'redundancy', 'no_conflict'][d % 4 + 1] ELSE 'escalate' END AS conflict_label,
  CASE WHEN d < 12 THEN 'told ' || h[2] ELSE ['no answer', 'answer is not JSON', 'label not allowed: MAYBE', 'answer has no label'][d - 11] END AS layer2_reason FROM told"""))
def l2_replayed(spark, sf):
    out = L.layer2(L.layer1(known_pairs(spark, sf)), replay)
    return out.where("layer2_called").select("fact_a_id", "fact_b_id", "conflict_label", "layer2_reason")


@register("p15_persisted_pairs", with_sql(labelled_sql(), """
SELECT fact_a_id, fact_b_id, round(cosine, 4) AS cosine, status, conflict_label FROM labelled"""))
def p15(spark, sf):
    return A.persisted(labelled(spark, sf)).select("fact_a_id", "fact_b_id", "cosine", "status", "conflict_label")


@register("a1_layer1_counts", with_sql(labelled_sql(), "SELECT l1 AS conflict_label, count(*) AS n FROM labelled GROUP BY ALL"))
def a1(spark, sf):
    return L.layer1(known_pairs(spark, sf)).groupBy("conflict_label").agg(F.count(F.lit(1)).alias("n"))


@register("a2_label_counts", with_sql(labelled_sql(), """
SELECT guideline_version, doc_id, conflict_label, count(*) AS n, count(*) FILTER (WHERE layer2_called) AS n_layer2 FROM labelled GROUP BY ALL"""))
def a2(spark, sf):
    return L.label_counts(labelled(spark, sf))


@register("a23_corpus_label_counts", with_sql(labelled_sql(("v1", "v2")), """
SELECT guideline_version, conflict_label, count(*) AS n, count(*) FILTER (WHERE layer2_called) AS n_layer2 FROM labelled GROUP BY ALL"""))
def a23(spark, sf):
    return phase2.corpus_label_counts(labelled(spark, sf, ("v1", "v2")))


@register("p20_arbiter_prompt", with_sql(pairs_sql(), """
SELECT p.fact_a_id, sha1(replace(replace(replace(replace(t.body, '<<DOC_TITLE>>', p.doc_id), '<<SOURCE_QUOTE>>', a.quote),
  '<<FACT_A>>', a.natural_language), '<<FACT_B>>', b.natural_language)) AS prompt_sha
FROM pairs p JOIN facts a ON a.fact_id = p.fact_a_id JOIN facts b ON b.fact_id = p.fact_b_id, (SELECT '%s' AS body) t""" % L.ARBITER_TEMPLATE.replace("'", "''")))
def p20(spark, sf):
    return known_pairs(spark, sf).where("status = 'matched'").select("fact_a_id", F.sha1(L.prompt()).alias("prompt_sha"))


@register("u3_polarity_difference", with_sql(labelled_sql(), """
SELECT fact_a_id, fact_b_id, array_to_string(list_sort(list_concat(list_filter(pa, lambda v: NOT list_contains(pb, v)), list_filter(pb, lambda v: NOT list_contains(pa, v)))), '|') AS differs
FROM labelled WHERE status = 'matched'"""))
def u3(spark, sf):
    p = known_pairs(spark, sf).where("status = 'matched'")
    a, b = R.polarity_tokens("a_natural_language"), R.polarity_tokens("b_natural_language")
    return p.select("fact_a_id", "fact_b_id", F.array_join(F.array_sort(F.concat(F.array_except(a, b), F.array_except(b, a))), "|").alias("differs"))


@register("x12_rounding", "SELECT event_id, round(value, 1) AS one, round(value / 7, 3) AS three, round(value / 7, 4) AS four FROM events")
def x12(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round("value", 1).alias("one"), F.round(F.col("value") / 7, 3).alias("three"),
                                             F.round(F.col("value") / 7, 4).alias("four"))


@register("x20_provenance_text", with_sql(facts_sql(), """
SELECT fact_id, sha1(quote || ' ' || natural_language) AS said_sha, trim(subject || ' ' || object) AS so_text FROM facts"""))
def x20(spark, sf):
    return facts(spark, sf).select("fact_id", F.sha1(T.provenance_text("source_locator.quote", "source_locator.linearized_sentence", "natural_language")).alias("said_sha"),
                                   T.subject_object_text("subject", "object").alias("so_text"))
