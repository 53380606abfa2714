"""Coverage, agreement, shift, statistics, spans and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import rules as R
from factloom.functions import text as T
from factloom.operators import bands as B
from factloom.operators import extract as X
from factloom.operators import graph as G
from factloom.operators import metrics as M
from factloom.operators import parsing as P
from factloom.operators import reviews as V
from factloom.operators import synth as Y
from factloom.operators.align import SCOPE
from factloom.sources import files as S
from factloom.sources import selection as SEL
from factloom.sources.tables import facts, pairs, sentences, spread, table
from factloom.workload.base import SENTENCES_SQL, facts_sql, pairs_sql, register, with_sql
from factloom.workload.graph_queries import FLAT
from factloom.workload.pair_queries import labelled, labelled_sql

EVENT_SPANS = "SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(60 * value) AS BIGINT) AS e FROM events"


def event_spans(spark, sf):
    start = F.unix_timestamp("ts").cast("long")
    return table(spark, sf, "events").select("event_id", "user_id", start.alias("s"), (start + F.floor(F.col("value") * 60)).alias("e"))


_ISLANDS = f"""
span AS (SELECT user_id, s, max(e) AS e FROM ({EVENT_SPANS}) WHERE e > s GROUP BY ALL),
reach AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM span),
island AS (SELECT *, count(*) FILTER (WHERE r IS NULL OR s > r) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM reach),
merged AS (SELECT user_id, k, min(s) AS s, max(e) AS e FROM island GROUP BY ALL)"""


@register("a4_w2_merged_intervals", with_sql(_ISLANDS, "SELECT user_id, s, e FROM merged"))
def a4(spark, sf):
    return M.merged_intervals(event_spans(spark, sf), ["user_id"], "s", "e")


@register("a4_covered_length", with_sql(_ISLANDS, "SELECT user_id, CAST(sum(e - s) AS BIGINT) AS covered FROM merged GROUP BY ALL"))
def a4_length(spark, sf):
    return M.covered_length(event_spans(spark, sf), ["user_id"], "s", "e")


COVERAGE_SQL = """,
sec AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'preamble.recitals[' || (pos // 4) || ']' AS section_path FROM sents GROUP BY ALL),
nsec AS (SELECT doc_id, count(*) AS n FROM sec GROUP BY ALL),
len AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, length(text) AS n_chars FROM documents),
hits AS (SELECT doc_id, annotator, count(DISTINCT section_path) AS n_hit FROM facts GROUP BY ALL),
cs AS (SELECT doc_id, annotator, char_start AS s, max(char_end) AS e FROM facts WHERE char_end > char_start GROUP BY ALL),
cr AS (SELECT *, max(e) OVER (PARTITION BY doc_id, annotator ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM cs),
ci AS (SELECT *, count(*) FILTER (WHERE r IS NULL OR s > r) OVER (PARTITION BY doc_id, annotator ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM cr),
cm AS (SELECT doc_id, annotator, k, min(s) AS s, max(e) AS e FROM ci GROUP BY ALL),
cov AS (SELECT doc_id, annotator, CAST(sum(e - s) AS BIGINT) AS total_chars_covered FROM cm GROUP BY ALL),
coverage AS (SELECT f.doc_id, f.annotator, f.n_facts, round(f.mean_len, 1) AS mean_fact_chars, total_chars_covered, n_chars AS total_chars_available,
    round(n_hit / CAST(nsec.n AS DOUBLE), 3) AS sections_hit_frac, round(total_chars_covered / CAST(n_chars AS DOUBLE), 3) AS char_coverage_frac
  FROM (SELECT doc_id, annotator, count(*) AS n_facts, avg(char_end - char_start) AS mean_len FROM facts GROUP BY ALL) f
  JOIN hits USING (doc_id, annotator) JOIN cov USING (doc_id, annotator) JOIN nsec USING (doc_id) JOIN len USING (doc_id))"""


def _coverage(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("preamble").alias("container"), F.length("text").alias("n_chars"))
    sec = sentences(spark, sf).select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(
        F.lit("preamble.recitals["), (F.col("pos") / 4).cast("int").cast("string"), F.lit("]")).alias("section_path")).distinct()
    return M.coverage(facts(spark, sf), sec, docs)


@register("a3_coverage", with_sql(facts_sql() + COVERAGE_SQL, "SELECT * FROM coverage"))
def a3(spark, sf):
    return _coverage(spark, sf).drop("guideline_version")


@register("a5_coverage_rollup", with_sql(facts_sql() + COVERAGE_SQL, """
SELECT annotator, count(*) AS n_docs, CAST(sum(n_facts) AS BIGINT) AS total_facts, round(avg(sections_hit_frac), 3) AS mean_sections_hit_frac,
  round(avg(char_coverage_frac), 3) AS mean_char_coverage_frac, round(avg(mean_fact_chars), 1) AS mean_fact_chars FROM coverage GROUP BY ALL"""))
def a5(spark, sf):
    return M.coverage_rollup(_coverage(spark, sf)).drop("guideline_version")


@register("a6_agreement", with_sql(labelled_sql(), """
SELECT n.doc_id, n_a, n_b, coalesce(n_matched, 0) AS n_matched, round(coalesce(n_matched, 0) / CAST(n_a + n_b - coalesce(n_matched, 0) AS DOUBLE), 3) AS jaccard,
  mean_cosine, coalesce(n_contradiction, 0) AS n_contradiction, coalesce(n_redundancy, 0) AS n_redundancy
FROM (SELECT doc_id, count(*) FILTER (WHERE annotator = 'ann_a') AS n_a, count(*) FILTER (WHERE annotator = 'ann_b') AS n_b FROM facts GROUP BY ALL) n
LEFT JOIN (SELECT doc_id, count(*) AS n_matched, floor((200 * sum(CAST(round(cosine * 10000) AS BIGINT)) + count(*)) / (2 * count(*))) / 1000000 AS mean_cosine, count(*) FILTER (WHERE conflict_label = 'contradiction') AS n_contradiction,
  count(*) FILTER (WHERE conflict_label = 'redundancy') AS n_redundancy FROM labelled WHERE status = 'matched' GROUP BY ALL) m USING (doc_id)
WHERE n_a > 0 AND n_b > 0"""))
def a6(spark, sf):
    return M.agreement(facts(spark, sf), labelled(spark, sf)).select(
        "doc_id", "n_a", "n_b", "n_matched", "jaccard", "mean_cosine", "n_contradiction", "n_redundancy")


PROFILE_SQL = """,
profile AS (SELECT guideline_version, doc_id, count(*) FILTER (WHERE conflict_label = 'contradiction') AS contradiction,
  count(*) FILTER (WHERE conflict_label = 'granularity') AS granularity, count(*) FILTER (WHERE conflict_label = 'redundancy') AS redundancy,
  count(*) FILTER (WHERE conflict_label = 'unlabeled') AS unlabeled, count(*) FILTER (WHERE status = 'matched') AS n_matched,
  count(*) FILTER (WHERE layer2_called) AS n_layer2 FROM labelled GROUP BY ALL),
long AS (SELECT guideline_version, doc_id, u.label, u.n, CASE WHEN u.label = 'total' THEN round(1 - n_layer2 / CAST(greatest(n_matched, 1) AS DOUBLE), 3) END AS rate FROM (
  SELECT *, unnest([{'label': 'contradiction', 'n': contradiction}, {'label': 'granularity', 'n': granularity}, {'label': 'redundancy', 'n': redundancy},
    {'label': 'unlabeled', 'n': unlabeled}, {'label': 'total', 'n': contradiction + granularity + redundancy + unlabeled}]) AS u FROM profile))"""
_BOTH = ("v1", "v2")


def _profile(spark, sf):
    return M.document_profile(labelled(spark, sf, _BOTH))


@register("a14_distribution_shift", with_sql(labelled_sql(_BOTH) + PROFILE_SQL, """
SELECT a.doc_id, a.label, a.n AS n_old, b.n AS n_new, a.rate AS rate_old, b.rate AS rate_new, b.n - a.n AS delta,
  CASE WHEN a.n <> 0 THEN round((b.n - a.n) / CAST(a.n AS DOUBLE) * 100, 1) END AS delta_pct
FROM long a JOIN long b ON a.doc_id = b.doc_id AND a.label = b.label WHERE a.guideline_version = 'v1' AND b.guideline_version = 'v2'"""))
def a14(spark, sf):
    return M.distribution_shift(_profile(spark, sf))


@register("a15_j13_corpus_shift", with_sql(labelled_sql(_BOTH) + PROFILE_SQL + """,
joined AS (SELECT a.doc_id, a.contradiction AS c1, b.contradiction AS c2, a.granularity AS g1, b.granularity AS g2, a.redundancy AS r1, b.redundancy AS r2,
  a.unlabeled AS u1, b.unlabeled AS u2, a.n_matched AS m1, b.n_matched AS m2, a.n_layer2 AS l1, b.n_layer2 AS l2
  FROM profile a JOIN profile b USING (doc_id) WHERE a.guideline_version = 'v1' AND b.guideline_version = 'v2'),
s AS (SELECT count(*) AS n_docs, sum(c1) AS c1, sum(c2) AS c2, sum(g1) AS g1, sum(g2) AS g2, sum(r1) AS r1, sum(r2) AS r2, sum(u1) AS u1, sum(u2) AS u2,
  sum(m1) AS m1, sum(m2) AS m2, sum(l1) AS l1, sum(l2) AS l2 FROM joined)""", """
SELECT n_docs, x.label, x.a AS n_old, x.b AS n_new, x.b - x.a AS delta, CASE WHEN x.a <> 0 THEN round((x.b - x.a) / CAST(x.a AS DOUBLE) * 100, 1) END AS delta_pct,
  CASE WHEN x.label = 'total' THEN round(1 - l1 / CAST(m1 AS DOUBLE), 3) END AS rate_old, CASE WHEN x.label = 'total' THEN round(1 - l2 / CAST(m2 AS DOUBLE), 3) END AS rate_new
FROM (SELECT *, unnest([{'label': 'contradiction', 'a': c1, 'b': c2}, {'label': 'granularity', 'a': g1, 'b': g2}, {'label': 'redundancy', 'a': r1, 'b': r2},
  {'label': 'unlabeled', 'a': u1, 'b': u2}, {'label': 'total', 'a': c1 + g1 + r1 + u1, 'b': c2 + g2 + r2 + u2}]) AS x FROM s)"""))
def a15(spark, sf):
    return M.corpus_shift(_profile(spark, sf))


@register("a16_filter_rate", with_sql(labelled_sql(_BOTH) + PROFILE_SQL, "SELECT guideline_version, doc_id, rate FROM long WHERE label = 'total'"))
def a16(spark, sf):
    return _profile(spark, sf).select("guideline_version", "doc_id", F.round(1 - F.col("n_layer2") / F.greatest("n_matched", F.lit(1)), 3).alias("rate"))


@register("u4_annotator_sets", with_sql(facts_sql(_BOTH), """
SELECT doc_id, array_to_string(list_sort(list_distinct(coalesce(list(annotator) FILTER (WHERE guideline_version = 'v1'), []))), '|') =
  array_to_string(list_sort(list_distinct(coalesce(list(annotator) FILTER (WHERE guideline_version = 'v2'), []))), '|') AS annotators_match FROM facts GROUP BY doc_id"""))
def u4(spark, sf):
    return M.annotator_sets_match(facts(spark, sf, _BOTH)).select("doc_id", "annotators_match")


@register("a21_facts_per_annotator", with_sql(facts_sql(), "SELECT doc_id, annotator, count(*) AS n_facts FROM facts GROUP BY ALL"))
def a21(spark, sf):
    return M.facts_per_annotator(facts(spark, sf)).drop("guideline_version")


@register("a21_f13_section_spread", with_sql(facts_sql(), """
SELECT doc_id, section_path, a AS ann_a, b AS ann_b, abs(a - b) AS spread, abs(a - b) >= 2 AS hot FROM (
  SELECT doc_id, section_path, count(*) FILTER (WHERE annotator = 'ann_a') AS a, count(*) FILTER (WHERE annotator = 'ann_b') AS b FROM facts GROUP BY ALL)"""))
def a21_sections(spark, sf):
    return M.section_spread(facts(spark, sf), ["ann_a", "ann_b"]).drop("guideline_version")


@register("w3_p18_overlap_depth", f"""
WITH sp AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(60 * value) AS BIGINT) AS e FROM events)
SELECT a.event_id, count(b.event_id) FILTER (WHERE b.e > a.s AND b.s < a.e) AS depth, greatest(a.s, coalesce(max(b.e), 0)) AS draw_start,
  greatest(a.e, a.s, coalesce(max(b.e), 0)) AS draw_end
FROM sp a LEFT JOIN sp b ON a.user_id = b.user_id AND (b.s, b.e, b.event_id) < (a.s, a.e, a.event_id)
WHERE a.e > a.s GROUP BY a.event_id, a.s, a.e""")
def p18(spark, sf):
    return M.overlap_depth(event_spans(spark, sf), ["user_id"], ["s", "e", "event_id"]).where("e > s").select("event_id", "depth", "draw_start", "draw_end")


def _fact_rows(spark, sf):
    labels = G.strongest_by(G.labels_of_facts(labelled(spark, sf)), [*SCOPE, "fact_id"])
    checks = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("quality") == 1, F.lit("verified")).otherwise(F.lit("rejected")).alias("verdict"))
    marks = facts(spark, sf).where("fact_pos % 5 = 0").join(checks, "doc_id").select("doc_id", "fact_id", F.col("verdict").alias("status"))
    return V.fact_rows(facts(spark, sf), labels, marks)


ROWS_SQL = """,
rows AS (SELECT f.*, coalesce(l.label, 'unlabeled') AS edge_label, CASE WHEN f.fact_pos % 5 = 0 THEN
    CASE v.quality WHEN 1 THEN 'verified' WHEN 0 THEN 'rejected' END END AS verification
  FROM facts f LEFT JOIN fact_label l USING (fact_id) LEFT JOIN labels v ON CAST(v.doc_id AS VARCHAR) = f.doc_id)"""


@register("j12_k6_fact_rows", with_sql(FLAT + ROWS_SQL, "SELECT fact_id, edge_label, verification FROM rows"))
def j12(spark, sf):
    return _fact_rows(spark, sf).select("fact_id", "edge_label", "verification")


@register("a22_f2_f3_visible_label_counts", with_sql(FLAT + ROWS_SQL, """
SELECT edge_label, count(*) AS n FROM rows WHERE annotator = 'ann_b' AND contains(lower(subject || ' ' || predicate || ' ' || object), 'on') GROUP BY ALL"""))
def a22(spark, sf):
    return V.visible_facts(_fact_rows(spark, sf), ["ann_b"], query="ON").groupBy("edge_label").agg(F.count(F.lit(1)).alias("n"))


@register("k11_export_rows", with_sql(FLAT + ROWS_SQL, """
SELECT fact_id, annotator, subject, predicate, object, natural_language, section_path, char_start, char_end, edge_label AS conflict_label, coalesce(verification, '') AS verification FROM rows"""))
def k11(spark, sf):
    return V.export_rows(_fact_rows(spark, sf))


@register("s11_facts_only_view", with_sql(facts_sql(), "SELECT fact_id, annotator, 'unlabeled' AS edge_label FROM facts"))
def s11(spark, sf):
    none = facts(spark, sf).select(*SCOPE, "fact_id", "conflict_label").where("false")
    return V.fact_rows(facts(spark, sf), none).select("fact_id", "annotator", "edge_label")


@register("o3_o4_fact_order", with_sql(facts_sql(), """
SELECT fact_id, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(regexp_extract(section_path, '(\\d+)', 1) AS BIGINT), annotator, fact_pos, fact_id) AS place FROM facts""".replace("\\\\", "\\")))
def o3(spark, sf):
    from pyspark.sql import Window as W
    w = W.partitionBy(*SCOPE).orderBy(T.section_order("source_locator.section_path"), "annotator", "fact_pos", "fact_id")
    return facts(spark, sf).select("fact_id", F.row_number().over(w).alias("place"))


@register("p14_fact_brief", with_sql(facts_sql(), "SELECT fact_id, natural_language AS text, subject, predicate, object, section_path, quote FROM facts"))
def p14(spark, sf):
    return facts(spark, sf).select("fact_id", T.fact_text("natural_language", "subject", "predicate", "object").alias("text"), "subject", "predicate", "object",
                                   "source_locator.section_path", "source_locator.quote")


# --- reviews -----------------------------------------------------------------

REVIEW_LOG = """
log AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, 'p' || (turn // 3) AS pair_key, turn,
  CASE turn % 3 WHEN 0 THEN ['6', '2', '6'] WHEN 1 THEN ['10'] ELSE [] END AS rules, substring(text, 1, 2000) AS note,
  CASE WHEN turn % 2 = 0 THEN 'agree' ELSE 'relabel:granularity' END AS resolution, CASE WHEN turn % 2 = 0 THEN 'contradiction' ELSE '' END AS label_at_review,
  role = 'system' AS deleted FROM conversations),
reviews AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pair_key ORDER BY turn DESC) AS rn FROM log) WHERE rn = 1 AND NOT deleted)"""


def review_log(spark, sf):
    t = F.col("turn")
    return V.normalise_reviews(table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("doc_id"), F.concat(F.lit("p"), (t / 3).cast("int").cast("string")).alias("pair_key"),
        F.when(t % 3 == 0, F.array(F.lit("6"), F.lit("2"), F.lit("6"))).when(t % 3 == 1, F.array(F.lit("10"))).otherwise(F.array().cast("array<string>")).alias("rules"),
        F.col("text").alias("note"), F.when(t % 2 == 0, F.lit("agree")).otherwise(F.lit("relabel:granularity")).alias("resolution"),
        F.when(t % 2 == 0, F.lit("contradiction")).otherwise(F.lit("")).alias("label_at_review"), F.array(F.col("role")).alias("annotators"),
        t.alias("ts"), (F.col("role") == "system").alias("deleted")))


@register("k5_current_reviews", with_sql(REVIEW_LOG, """
SELECT doc_id, pair_key, array_to_string(list_sort(list_distinct(rules)), '|') AS rules, sha1(note) AS note_sha, resolution,
  CASE WHEN label_at_review = '' THEN 'unlabeled' ELSE label_at_review END AS label_at_review FROM reviews"""))
def k5(spark, sf):
    return V.current_reviews(review_log(spark, sf)).select(
        "doc_id", "pair_key", F.array_join("rules", "|").alias("rules"), F.sha1("note").alias("note_sha"), "resolution", "label_at_review")


@register("a17_o1_rule_evidence", with_sql(REVIEW_LOG + """,
cited AS (SELECT doc_id, pair_key, unnest(list_distinct(rules)) AS rule_id, CASE WHEN label_at_review = '' THEN 'unlabeled' ELSE label_at_review END AS label FROM reviews)""", """
SELECT rule_id, count(*) AS n_conflicts, count(DISTINCT doc_id) AS n_docs, count(*) FILTER (WHERE label = 'contradiction') AS n_contradiction, least(count(*), 5) AS n_notes
FROM cited GROUP BY ALL"""))
def a17(spark, sf):
    titles = spark.createDataFrame([], "rule_id string, title string")
    e = V.rule_evidence(V.current_reviews(review_log(spark, sf)), titles)
    return e.select("rule_id", "n_conflicts", "n_docs", F.coalesce(F.col("by_label")["contradiction"], F.lit(0)).alias("n_contradiction"), F.size("sample_notes").alias("n_notes"))


@register("a17_review_totals", with_sql(REVIEW_LOG, """
SELECT count(*) AS n_reviews, count(DISTINCT doc_id) AS n_docs, count(*) FILTER (WHERE len(rules) = 0) AS n_unattributed FROM reviews"""))
def a17_totals(spark, sf):
    return V.review_totals(V.current_reviews(review_log(spark, sf)))


def _pair_reviews(spark, sf):
    """Reviews of derived pairs: every pair whose first fact id starts with a low digit."""
    key = V.pair_key()
    return pairs(spark, sf).withColumn("pair_key", key).where(F.substring("pair_key", 1, 1).isin("0", "1", "2", "3", "-")).select(
        "doc_id", "pair_key", F.array(F.lit("6")).alias("rules"), F.lit("agree").alias("resolution"))


QUEUE_SQL = """,
qkeyed AS (SELECT *, coalesce(fact_a_id, '-') || '|' || coalesce(fact_b_id, '-') AS pair_key,
  CASE conflict_label WHEN 'contradiction' THEN 0 WHEN 'granularity' THEN 1 WHEN 'redundancy' THEN 2 WHEN 'unlabeled' THEN 3 WHEN 'no_conflict' THEN 4 ELSE 9 END AS queue_rank FROM labelled),
queue AS (SELECT *, pair_key[1] IN ('0', '1', '2', '3', '-') AS reviewed FROM qkeyed)"""


@register("f6_o2_review_queue", with_sql(labelled_sql() + QUEUE_SQL, """
SELECT doc_id, pair_key, queue_rank, round(cosine, 4) AS cosine FROM queue WHERE NOT reviewed AND status = 'matched' AND conflict_label = 'redundancy'"""))
def f6(spark, sf):
    q = V.ordered_queue(V.review_queue(labelled(spark, sf), _pair_reviews(spark, sf), "redundancy", unreviewed_only=True))
    return q.select("doc_id", "pair_key", "queue_rank", F.round("cosine", 4).alias("cosine"))


@register("o8_next_unreviewed", with_sql(labelled_sql() + QUEUE_SQL, """
SELECT doc_id, min_by(pair_key, {'r': queue_rank, 'c': -cosine, 'k': pair_key}) AS pair_key FROM queue WHERE NOT reviewed GROUP BY doc_id"""))
def o8(spark, sf):
    return V.next_unreviewed(labelled(spark, sf), _pair_reviews(spark, sf)).select("doc_id", "pair_key")


@register("a27_review_progress", with_sql(labelled_sql() + QUEUE_SQL, "SELECT doc_id, count(*) AS n_pairs, count(*) FILTER (WHERE reviewed) AS n_reviewed FROM queue GROUP BY doc_id"))
def a27(spark, sf):
    return V.review_progress(pairs(spark, sf), _pair_reviews(spark, sf))


@register("j15_review_rows", with_sql(labelled_sql() + QUEUE_SQL, """
SELECT pair_key, nla AS text_a, nlb AS text_b, CASE WHEN reviewed THEN 'agree' END AS resolution FROM queue"""))
def j15(spark, sf):
    return V.review_rows(pairs(spark, sf), facts(spark, sf), _pair_reviews(spark, sf)).select("pair_key", "text_a", "text_b", "resolution")


# --- sources, parsing, extraction ---------------------------------------------


@register("s4_corpus_slice", r"""
SELECT doc_id, n_words FROM (SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n_words FROM documents)
WHERE n_words BETWEEN 200 AND 900 ORDER BY doc_id LIMIT 50 OFFSET 10""")
def s4(spark, sf):
    return S.corpus_slice(spread(table(spark, sf, "documents")), 200, 900, 50, 10).select("doc_id", "n_words")


@register("s5_corpus_scan", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL")
def s5(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@register("s7_page_predicates", """
SELECT page_id, contains(html, 'awswaf') OR contains(html, 'AwsWafIntegration') OR contains(html, 'challenge-container') AS challenge,
  contains(html, 'oj-doc-ti') OR contains(html, 'FORMEX') OR contains(html, 'celex/') OR length(html) > 20000 AS is_document FROM pages""")
def s7(spark, sf):
    from factloom.operators import html as H
    return table(spark, sf, "pages").select("page_id", H.looks_like_challenge("html").alias("challenge"), H.looks_like_document("html").alias("is_document"))


@register("p6_page_documents")
def p6(spark, sf):
    from factloom.operators import html as H
    blocks = spread(table(spark, sf, "pages")).select("page_id", H.html_blocks("html").alias("blocks"))
    d = blocks.select("page_id", F.size("blocks").alias("n_blocks"), H.html_document(F.col("page_id").cast("string"), "blocks").alias("d"))
    return d.select("page_id", "n_blocks", "d.title", F.size("d.citations").alias("n_citations"), F.size("d.recitals").alias("n_recitals"), F.size("d.articles").alias("n_articles"))


@register("p5_plain_text_documents")
def p5(spark, sf):
    docs = spread(_legal_texts(spark, sf))
    d = docs.select(P.plain_text_document("doc_id", "text").alias("document"))
    return P.document_summary(d).drop("n_tables", "n_rows")


def _legal_texts(spark, sf):
    """Acts laid out from document sentences: title, citations, numbered recitals, articles, annex, closing."""
    return _acts_of(sentences(spark, sf))


def _acts_of(found):
    s = found.select(F.col("doc_id").cast("string").alias("doc_id"), "pos", F.regexp_replace("body", r"\s+", " ").alias("body"))
    role = (F.when(F.col("pos") == 0, F.concat("body", F.lit("\n\nTHE COUNCIL,\n")))
            .when(F.col("pos") <= 2, F.concat(F.lit("Having regard to "), "body", F.lit(",\n")))
            .when(F.col("pos") <= 5, F.concat(F.lit("("), (F.col("pos") - 2).cast("string"), F.lit(") "), "body", F.lit("\n")))
            .when(F.col("pos") == 6, F.concat(F.lit("HAS ADOPTED THIS REGULATION:\n"), F.lit("Article 1\n"), "body", F.lit("\n")))
            .when(F.col("pos") % 5 == 0, F.concat(F.lit("Article "), (F.col("pos") / 5 + 1).cast("int").cast("string"), F.lit("\n"), "body", F.lit("\n")))
            .otherwise(F.concat("body", F.lit("\n"))))
    lines = s.withColumn("line", role).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return lines.select("doc_id", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), ""), F.lit("\nANNEX I\nforms\n\nDone at Brussels.")).alias("text"))


ACT_SQL = r""",
acts AS (SELECT doc_id, count(*) AS n_sent, max(pos) AS last_pos, list(regexp_replace(body, '\s+', ' ', 'g') ORDER BY pos)[1] AS title FROM sents GROUP BY doc_id)"""


@register("p5_p22_act_structure", with_sql(SENTENCES_SQL + ACT_SQL, """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, least(greatest(n_sent - 1, 0), 2) AS n_citations, least(greatest(n_sent - 3, 0), 3) AS n_recitals,
  CASE WHEN last_pos >= 6 THEN 1 + (last_pos // 5 - 1) ELSE 0 END AS n_articles FROM acts WHERE n_sent >= 7"""))
def p5_structure(spark, sf):
    long = sentences(spark, sf).groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).where("n >= 7").select("doc_id")
    texts = _legal_texts(spark, sf).join(long, "doc_id", "left_semi")
    d = texts.select(P.plain_text_document("doc_id", "text").alias("document"))
    return P.document_summary(d).select("doc_id", "n_citations", "n_recitals", "n_articles")


@register("f1_s17_quality_filter", with_sql(SENTENCES_SQL, """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN length(source) < 5 THEN 'title missing or too short' ELSE 'no articles parsed' END AS reason FROM documents"""))
def f1(spark, sf):
    d = spread(table(spark, sf, "documents")).select(F.col("doc_id").cast("string").alias("doc_id"), P.parsed_document_of_text("source", "text", "sentence").alias("document"))
    return d.select("doc_id", P.quality_rejection("document").alias("reason"))


SELECT_NEED = 200  # documents that the registered selection is to find


@register("s17_f1_selection_with_stop", with_sql(SENTENCES_SQL + r""",
line AS (SELECT doc_id, pos, length(CASE WHEN pos = 6 THEN 'Article 1' || chr(10) WHEN pos % 5 = 0 THEN 'Article ' || (pos // 5 + 1) || chr(10) ELSE '' END
  || regexp_replace(body, '\s+', ' ', 'g') || chr(10)) AS n FROM sents WHERE pos >= 6),
size AS (SELECT doc_id, sum(n) - 1 AS n_enacting FROM line GROUP BY doc_id),
title AS (SELECT doc_id, regexp_replace(body, '\s+', ' ', 'g') AS title FROM sents WHERE pos = 0),
judged AS (SELECT doc_id, CASE WHEN coalesce(length(title), 0) < 5 THEN 'title missing or too short' WHEN n_enacting IS NULL THEN 'no articles parsed'
    WHEN n_enacting < 200 THEN 'enacting_text too short (' || CAST(n_enacting AS BIGINT) || ' chars)' ELSE '' END AS reason
  FROM documents LEFT JOIN title USING (doc_id) LEFT JOIN size USING (doc_id)
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)),
run AS (SELECT *, coalesce(sum(CASE WHEN reason = '' THEN 1 ELSE 0 END) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM judged)""", f"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS source_index, reason, reason = '' AS accepted FROM run WHERE before < {SELECT_NEED}"""))
def s17(spark, sf):
    """Acts laid out from documents in id order; those that the labels call good are in the manifest already."""
    documents = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("source_index"), "text")
    manifest = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("doc_id"))

    def judge(rows):
        acts = _acts_of(T.explode_sections(rows.select("doc_id", "text"), "text", "sentence"))
        parsed = acts.select("doc_id", P.plain_text_document("doc_id", "text").alias("document")).select(
            "doc_id", P.quality_rejection("document").alias("reason"))
        return rows.select("doc_id", "source_index").join(parsed, "doc_id", "left").withColumn(
            "reason", F.coalesce("reason", F.lit("title missing or too short")))

    return SEL.select_until(documents, manifest, SELECT_NEED, judge)


@register("p8_section_enumeration", with_sql(SENTENCES_SQL, """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'preamble.recitals[' || pos || ']' AS section_path, char_start AS base_offset, sha1(body) AS text_sha FROM sents"""))
def p8(spark, sf):
    d = spread(table(spark, sf, "documents")).select(P.parsed_document_of_text("source", "text", "sentence", F.col("doc_id").cast("string")).alias("document"))
    return P.sections(d).select("doc_id", "section_path", "base_offset", F.sha1("text").alias("text_sha"))


@register("p7_linearised_rows", """
SELECT n_nationkey, 'In Annex ' || r_name || ', Table 0, row 0: name = ' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN '; key = ' || n_nationkey ELSE '' END || '.' AS sentence
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def p7(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    t = n.select("n_nationkey", F.col("r_name").alias("annex_id"), F.lit(0).alias("table_id"), F.array(F.lit("name"), F.lit("key:")).alias("headers"), F.array(
        F.array(F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string")).otherwise(F.lit("")))).alias("rows"))
    return P.linearised_rows(t).select("n_nationkey", "sentence")


def _responses(spark, sf):
    """Responses written out from derived facts of one annotator, every seventh one with a blank object."""
    f = facts(spark, sf).where("annotator = 'ann_a'")
    obj = F.when(F.col("fact_pos") % 7 == 0, F.lit("  ")).otherwise(F.col("object"))
    triple = F.struct("subject", "predicate", obj.alias("object"), F.lit(" per triple ").alias("condition"))
    body = F.to_json(F.struct(F.array(F.struct(
        "natural_language", F.col("source_locator.quote").alias("source_quote"), F.lit("if asked").alias("condition"), F.lit("today").alias("temporal_context"),
        F.lower("logic_op").alias("logic_op"), F.array(triple, triple).alias("triples"))).alias("facts")))
    return f.select("doc_id", F.lit("ann_a").alias("annotator"), F.lit("v1").alias("guideline_version"), "source_locator.section_path", "fact_pos", body.alias("response"),
                    F.col("source_locator.quote").alias("section_text"), F.col("source_locator.char_start").alias("base_offset"))


@register("p10_parse_responses", with_sql(facts_sql(), """
SELECT doc_id, fact_pos, CAST(t.i AS BIGINT) AS triple_index, subject, object, 'per triple' AS condition, 'today' AS temporal_context, logic_op FROM facts, (VALUES (0), (1)) t(i)
WHERE annotator = 'ann_a' AND fact_pos % 7 <> 0 AND trim(object) <> '' AND predicate <> ''"""))
def p10(spark, sf):
    return X.parse_responses(_responses(spark, sf)).select("doc_id", "fact_pos", "triple_index", "subject", "object", "condition", "temporal_context", "logic_op")


@register("p11_p12_anchored_facts", with_sql(facts_sql(), """
SELECT doc_id, char_start, char_start + length(quote) AS char_end, substr(sha1(concat_ws('|', 'ann_a', doc_id, section_path, 0, t.i)), 1, 16) AS fact_id
FROM facts, (VALUES (0), (1)) t(i) WHERE annotator = 'ann_a' AND fact_pos % 7 <> 0 AND trim(object) <> '' AND predicate <> ''"""))
def p11(spark, sf):
    anchored = X.anchor_quotes(X.parse_responses(_responses(spark, sf)).drop("fact_pos"))
    return X.build_facts(anchored).select("doc_id", "source_locator.char_start", "source_locator.char_end", "fact_id")


@register("p12_fact_positions", with_sql(facts_sql(), """
SELECT doc_id, section_path, fact_id, CAST((dense_rank() OVER (PARTITION BY doc_id ORDER BY CAST(regexp_extract(section_path, '([0-9]+)', 1) AS BIGINT), place) - 1) * 1000 + i AS INTEGER) AS fact_pos
FROM (SELECT doc_id, section_path, fact_pos AS place, t.i, substr(sha1(concat_ws('|', 'ann_a', doc_id, section_path, fact_pos, t.i)), 1, 16) AS fact_id
  FROM facts, (VALUES (0), (1)) t(i) WHERE annotator = 'ann_a' AND fact_pos % 7 <> 0 AND trim(object) <> '' AND predicate <> '')"""))
def p12(spark, sf):
    """Places of facts in their document's list when every section numbers its groups anew, with gaps of any size."""
    anchored = X.anchor_quotes(X.parse_responses(_responses(spark, sf)).withColumn("group_index", F.col("fact_pos")).drop("fact_pos"))
    return X.build_facts(anchored).select("doc_id", "source_locator.section_path", "fact_id", "fact_pos")


@register("p11_fuzzy_anchors")
def p11_fuzzy(spark, sf):
    """Statements whose subject was reworded no longer occur verbatim and need the similarity search."""
    f = facts(spark, sf).where("annotator = 'ann_b' and synth_op = 5")
    rows = f.select("fact_id", F.col("natural_language").alias("source_quote"), F.col("source_locator.quote").alias("section_text"),
                    F.col("source_locator.char_start").alias("base_offset"))
    return X.anchor_quotes(rows).select("fact_id", "char_start", "char_end", F.round("anchor_score", 3).alias("anchor_score"))


_TOKEN = r"\d+(?:[.,]\d+)?|%|\p{L}+"
_ROLES_SQL = "\n".join(f"""e{i} AS (SELECT *, CASE WHEN {r}_n <> '' AND strpos(substr(low, at{i}), {r}_n) > 0 THEN strpos(substr(low, at{i}), {r}_n) + at{i} - 1 ELSE 0 END AS {r}_p,
  CASE WHEN {r}_n <> '' AND strpos(substr(low, at{i}), {r}_n) > 0 THEN strpos(substr(low, at{i}), {r}_n) + at{i} - 1 + length({r}_n) ELSE at{i} END AS at{i + 1} FROM e{i - 1}),"""
    for i, r in enumerate(("subject", "predicate", "object"), 1))


@register("p17_x19_spo_bands", with_sql(facts_sql() + rf""",
e0 AS (SELECT fact_id, lower(quote) AS low, 1 AS at1, {", ".join(f"lower(trim({r}, E' \t\n\r\f\x0b')) AS {r}_n" for r in ("subject", "predicate", "object"))} FROM facts),
{_ROLES_SQL}
role AS (SELECT fact_id, low, unnest([{", ".join(f"{{'role': '{r}', 'needle': {r}_n, 'place': {r}_p}}" for r in ("subject", "predicate", "object"))}], recursive := true) FROM e3),
miss AS (SELECT *, regexp_extract_all(needle, '{_TOKEN}') AS wanted FROM role WHERE place = 0 AND needle <> ''),
cut AS (SELECT DISTINCT fact_id, string_split(regexp_replace(translate(low, chr(1) || chr(2), '  '), '({_TOKEN})', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS ps FROM miss),
piece AS (SELECT fact_id, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS idx FROM cut),
tok AS (SELECT fact_id, idx, split_part(piece, chr(2), 1) AS token, sum(length(piece) - CASE WHEN idx > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY fact_id ORDER BY idx
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start FROM piece QUALIFY idx > 0),
need AS (SELECT fact_id, role, len(wanted) AS n, u.token, count(*) AS need FROM (SELECT *, unnest(list_transform(wanted, lambda t: {{'token': t}})) AS u FROM miss) GROUP BY ALL),
hit AS (SELECT fact_id, role, n, token, need, idx, start FROM tok JOIN need USING (fact_id, token)),
nth AS (SELECT a.fact_id, a.role, a.n, a.idx AS a, a.start, b.idx AS b, b.start + length(b.token) AS stop,
  row_number() OVER (PARTITION BY a.fact_id, a.role, a.idx, b.token ORDER BY b.idx) <= b.need AS counts
  FROM hit a JOIN hit b ON a.fact_id = b.fact_id AND a.role = b.role AND b.idx >= a.idx AND b.idx < a.idx + a.n + 2),
win AS (SELECT *, count(*) FILTER (WHERE counts) OVER (PARTITION BY fact_id, role, a ORDER BY b) AS hits FROM nth),
best AS (SELECT fact_id, role, start, stop FROM win WHERE hits / n >= 0.55 QUALIFY row_number() OVER (PARTITION BY fact_id, role ORDER BY hits DESC, b - a, a) = 1),
band AS (SELECT fact_id, role, CAST(place - 1 AS INTEGER) AS s, CAST(place - 1 + length(needle) AS INTEGER) AS e, false AS fuzzy FROM role WHERE place > 0
  UNION ALL SELECT fact_id, role, CAST(start AS INTEGER), CAST(stop AS INTEGER), true FROM best)""", """
SELECT fact_id, role, greatest(s, reach) AS start, e AS "end", fuzzy FROM (SELECT *, coalesce(max(e) OVER (PARTITION BY fact_id ORDER BY s, e, role, fuzzy
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM band) WHERE e > greatest(s, reach)"""))
def p17(spark, sf):
    f = facts(spark, sf).select("fact_id", "subject", "predicate", "object", "source_locator.quote")
    return B.spo_bands(f, ["fact_id"])


DRAW = "CAST(('0x' || substr(sha1(fact_id || '|{p}'), 1, 8)) AS BIGINT)"


_WORDING = {"decided": ["determined", "ruled"], "made": ["issued", "produced"], "was": ["stood at", "reached"], "followed": ["came after"]}
_REWORDED = "CASE " + " ".join(
    f"WHEN predicate = '{p}' THEN [" + ", ".join(f"'{o}'" for o in options) + f"][{DRAW.format(p='wording')} % {1 << 20} % {len(options)} + 1]"
    for p, options in _WORDING.items()) + " ELSE predicate END"


@register("c8_x14_synthetic_annotator", with_sql(facts_sql() + f""",
drawn AS (SELECT *, contains(object, '2,3 %') AND {DRAW.format(p='number')} % 100 < 50 AS bump, 23 + [3, 5, 7][{DRAW.format(p='step')} % 3 + 1] AS tenths,
  CASE WHEN {DRAW.format(p='predicate')} % 100 < 55 THEN {_REWORDED} ELSE predicate END AS reworded
  FROM facts WHERE annotator = 'ann_a' AND {DRAW.format(p='drop')} % 100 >= 16)""", """
SELECT substr(sha1('sim|' || fact_id || '|0'), 1, 16) AS fact_id, fact_id AS derived_from,
  CASE WHEN bump THEN 'number_perturb_object' WHEN reworded <> predicate THEN 'predicate_paraphrase' ELSE 'identity' END AS synth_op,
  CASE WHEN bump THEN predicate ELSE reworded END AS predicate,
  CASE WHEN bump THEN replace(object, '2,3 %', (tenths // 10) || ',' || (tenths % 10) || ' %') ELSE object END AS object FROM drawn"""))
def c8(spark, sf):
    f = facts(spark, sf).where("annotator = 'ann_a'")
    return Y.synthesize(f, "sim", "adversarial").select("fact_id", "derived_from", "synth_op", "predicate", "object")


@register("u5_span_replacement", with_sql(facts_sql(), "SELECT fact_id, doc_id FROM facts WHERE NOT (doc_id = '1' AND annotator = 'ann_a' AND char_start >= 0 AND char_start < 200)"))
def u5(spark, sf):
    f = facts(spark, sf)
    return X.replace_span(f, f.where("false"), "1", "ann_a", 0, 200).select("fact_id", "doc_id")


@register("k12_cascade_delete", with_sql(facts_sql(), "SELECT doc_id, count(*) AS n FROM facts WHERE doc_id <> '1' GROUP BY ALL"))
def k12(spark, sf):
    return facts(spark, sf).where("doc_id <> '1'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


RUNS = """
runs AS (SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN 'model_a' ELSE 'model_b' END AS model, 'v1' AS guideline_version,
  CASE WHEN n_chars % 5 = 0 THEN 'failed' ELSE 'ok' END AS status, n_chars % 40 AS fact_count FROM documents)"""


def _runs(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang").isin("en", "fr"), F.lit("model_a")).otherwise(F.lit("model_b")).alias("model"), F.lit("v1").alias("guideline_version"),
        F.when(F.col("n_chars") % 5 == 0, F.lit("failed")).otherwise(F.lit("ok")).alias("status"), (F.col("n_chars") % 40).alias("fact_count"))


@register("a24_extraction_totals", with_sql(RUNS, """
SELECT model, count(*) FILTER (WHERE status = 'ok') AS docs_ok, count(*) AS n_runs, CAST(sum(CASE WHEN status = 'ok' THEN fact_count ELSE 0 END) AS BIGINT) AS n_facts FROM runs GROUP BY ALL"""))
def a24(spark, sf):
    return S.extraction_totals(_runs(spark, sf))


@register("j14_run_matrix", with_sql(RUNS, """
SELECT d.doc_id, m.model, v.guideline_version, coalesce(status, 'pending') AS status FROM documents d, (VALUES ('model_a'), ('model_b')) m(model), (VALUES ('v1'), ('v2')) v(guideline_version)
LEFT JOIN runs r ON r.doc_id = d.doc_id AND r.model = m.model AND r.guideline_version = v.guideline_version""".replace(
    "FROM documents d, (VALUES ('model_a'), ('model_b')) m(model), (VALUES ('v1'), ('v2')) v(guideline_version)",
    "FROM documents d CROSS JOIN (VALUES ('model_a'), ('model_b')) m(model) CROSS JOIN (VALUES ('v1'), ('v2')) v(guideline_version)")))
def j14(spark, sf):
    runs = _runs(spark, sf)
    return S.extraction_matrix(table(spark, sf, "documents"), ["model_a", "model_b"], ["v1", "v2"], runs).select("doc_id", "model", "guideline_version", "status")


@register("f14_pending_cells", with_sql(RUNS, """
SELECT d.doc_id, m.model FROM documents d CROSS JOIN (VALUES ('model_a'), ('model_b')) m(model)
WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = d.doc_id AND r.model = m.model AND status = 'ok')"""))
def f14(spark, sf):
    cells = table(spark, sf, "documents").select("doc_id", F.explode(F.array(F.lit("model_a"), F.lit("model_b"))).alias("model"))
    return S.pending_cells(cells, _runs(spark, sf))


@register("k13_latest_runs", """
SELECT user_id, max_by(event_type, {'t': ts, 'e': event_id}) AS status, count(*) AS n FROM events GROUP BY user_id""")
def k13(spark, sf):
    e = table(spark, sf, "events")
    last = V.latest(e.withColumn("o", F.struct("ts", "event_id")), ["user_id"], "o").select("user_id", F.col("event_type").alias("status"))
    return last.join(e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id")


@register("o5_latest_jobs", "SELECT event_id AS job_id, event_type AS status FROM events ORDER BY ts DESC, event_id DESC LIMIT 30")
def o5(spark, sf):
    jobs = table(spark, sf, "events").select(F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("status"))
    return S.latest_jobs(jobs).select("job_id", "status")


@register("s12_s13_versions", with_sql(pairs_sql(_BOTH), "SELECT DISTINCT doc_id, guideline_version FROM pairs WHERE guideline_version <> 'v1'"))
def s13(spark, sf):
    return S.versions_of(pairs(spark, sf, _BOTH))


@register("o7_latest_version", """
SELECT CAST(user_id AS VARCHAR) AS doc_id, max_by(event_type, {'t': ts, 'v': event_type}) AS guideline_version FROM events GROUP BY user_id""")
def o7(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("doc_id"), F.col("event_type").alias("guideline_version"), F.col("ts").alias("modified"))
    return S.latest_version(e)


@register("s18_document_list", with_sql(labelled_sql(_BOTH), """
SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, coalesce(has, false) AS has_conflicts, coalesce(variants, '') AS variants, coalesce(annotators, '') AS annotators, coalesce(n, 0) AS n_redundancy
FROM documents d LEFT JOIN (SELECT doc_id, bool_or(guideline_version = 'v1') AS has, max(CASE WHEN guideline_version <> 'v1' THEN guideline_version ELSE '' END) AS variants,
  max(CASE WHEN guideline_version = 'v1' THEN annotator_a || '|' || annotator_b ELSE '' END) AS annotators,
  count(*) FILTER (WHERE guideline_version = 'v1' AND conflict_label = 'redundancy') AS n FROM labelled GROUP BY doc_id) x ON x.doc_id = CAST(d.doc_id AS VARCHAR)"""))
def s18(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"))
    out = S.document_list(docs, labelled(spark, sf, _BOTH))
    return out.select("doc_id", "has_conflicts", F.array_join("variants", "|").alias("variants"),
                      F.array_join(F.coalesce("annotators", F.array()), "|").alias("annotators"), F.coalesce(F.col("label_counts")["redundancy"], F.lit(0)).alias("n_redundancy"))


@register("s14_guideline_rules", r"""
WITH p AS (SELECT doc_id, 'intro' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '<guideline>' || chr(10) END || '### ' || doc_id || '. ' || source || chr(10) || 'text'
    || chr(10) || '### 7. ' || lang || ' only' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '</guideline>' || chr(10) END || '### 99. outside' || chr(10) AS body FROM documents),
h AS (SELECT doc_id, unnest(regexp_extract_all(CASE WHEN doc_id % 3 = 0 THEN body ELSE split_part(body, '</guideline>', 1) END, '### \d+\. [^\n]+')) AS h FROM p)
SELECT doc_id, regexp_extract(h, '###\s*(\d+)', 1) AS rule_id, regexp_extract(h, '\.\s*(.+)$', 1) AS title FROM h""")
def s14(spark, sf):
    """One guideline per document, two out of three with a block that leaves the last heading outside."""
    block = lambda text: F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.lit(text))
    body = F.concat(F.lit("intro\n"), block("<guideline>\n"), F.lit("### "), F.col("doc_id").cast("string"), F.lit(". "), "source", F.lit("\ntext\n### 7. "), "lang",
                    F.lit(" only\n"), block("</guideline>\n"), F.lit("### 99. outside\n"))
    return S.guideline_rules(table(spark, sf, "documents").select("doc_id", body.alias("value"))).select("doc_id", "rule_id", "title")


@register("s16_section_prompts", with_sql(SENTENCES_SQL, """
SELECT doc_id, pos, sha1('RULES be brief ' || doc_id || ' s' || pos || ': ' || body || chr(10) || chr(10) || '/no_think') AS prompt_sha FROM sents"""))
def s16(spark, sf):
    template = S.assemble_prompt(F.lit("be brief"), F.lit("RULES <<GUIDELINE>> <<DOC_TITLE>> <<SECTION_PATH>>: <<SECTION_TEXT>>"))
    s = sentences(spark, sf)
    return s.select("doc_id", "pos", F.sha1(S.render_section_prompt(
        template, F.col("doc_id").cast("string"), F.concat(F.lit("s"), F.col("pos").cast("string")), F.col("body"))).alias("prompt_sha"))


@register("c7_j11_matched_cells", with_sql(labelled_sql() + """,
cell AS (SELECT *, row_number() OVER (PARTITION BY doc_id, annotator ORDER BY fact_pos) - 1 AS i FROM facts)""", """
SELECT p.doc_id, a.i AS ia, b.i AS ib, round(p.cosine, 4) AS cosine, p.conflict_label FROM labelled p JOIN cell a ON a.fact_id = p.fact_a_id JOIN cell b ON b.fact_id = p.fact_b_id"""))
def c7(spark, sf):
    from factloom.operators.similarity import matched_cells
    return matched_cells(facts(spark, sf), labelled(spark, sf)).select("doc_id", "ia", "ib", F.round("cosine", 4).alias("cosine"), "conflict_label")
