"""Graph building, property graph and pattern rules.

Clusters here are a table derived by a fixed rule (first word of the surface), so
that a second engine can repeat every graph query; ``c1_entity_clusters`` runs the
real clustering.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import rules as R
from factloom.functions import text as T
from factloom.operators import entities as E
from factloom.operators import graph as G
from factloom.operators import pgraph as PG
from factloom.operators import reified as RG
from factloom.operators.align import SCOPE
from factloom.session import checkpoint
from factloom.sources.tables import facts, name_bounds, pairs, stored_sentences, table
from factloom.workload.base import LOWER_COLLAPSED, facts_sql, predicate_key_sql, register, sql_cue, with_sql
from factloom.workload.text_queries import ENTITY_SQL
from factloom.workload.pair_queries import labelled, labelled_sql


def clusters(fact_table):
    surfaces = E.surface_forms(fact_table).select(*SCOPE, "surface").distinct()
    first = F.lower(F.get(F.split("surface", " "), F.lit(0)))
    return surfaces.withColumn("cluster_id", F.concat(F.lit("ent_"), F.substring(F.sha1(first), 1, 10)))


def resolved(spark, sf, base=None):
    """``base``: what the query has stored of the sentences already; facts and two tables of clusters are derived from them."""
    f = facts(spark, sf, base=stored_sentences(spark, sf) if base is None else base)
    return G.resolve(G.flagged(f), clusters(f))


def _cluster_sql(x):
    return f"CASE WHEN trim({x}) = '' OR lower(trim({x})) = 'null' THEN NULL ELSE 'ent_' || substr(sha1(lower(split_part(trim({x}), ' ', 1))), 1, 10) END"


RESOLVED = f"""
resolved AS (SELECT *, {_cluster_sql('subject')} AS s_cluster, {_cluster_sql('object')} AS o_cluster,
  {predicate_key_sql('predicate')} AS predicate_key, {LOWER_COLLAPSED.format(x='predicate')} AS predicate_norm FROM facts),
member AS (SELECT guideline_version, doc_id, annotator, cluster_id, surface FROM (
  SELECT guideline_version, doc_id, annotator, s_cluster AS cluster_id, trim(subject) AS surface FROM resolved
  UNION ALL SELECT guideline_version, doc_id, annotator, o_cluster, trim(object) FROM resolved) WHERE cluster_id IS NOT NULL)"""
SEVERITY_SQL = ("CASE {x} WHEN 'contradiction' THEN 4 WHEN 'granularity' THEN 3 WHEN 'redundancy' THEN 2 WHEN 'no_conflict' THEN 1 "
                "WHEN 'unlabeled' THEN 0 WHEN 'escalate' THEN 0 ELSE -1 END")
EDGES = f""",
fact_label AS (SELECT fact_id, max_by(conflict_label, {SEVERITY_SQL.format(x='conflict_label')}) AS label FROM (
  SELECT fact_a_id AS fact_id, conflict_label FROM labelled UNION ALL SELECT fact_b_id, conflict_label FROM labelled)
  WHERE fact_id IS NOT NULL AND conflict_label NOT IN ('unlabeled', 'escalate') GROUP BY fact_id),
edge_fact AS (SELECT r.*, l.label FROM resolved r LEFT JOIN fact_label l USING (fact_id) WHERE s_cluster IS NOT NULL AND o_cluster IS NOT NULL),
edge AS (SELECT guideline_version, doc_id, s_cluster, predicate_key, o_cluster, count(DISTINCT fact_id) AS n_facts,
  array_to_string(list_sort(list_distinct(list(annotator))), '|') AS annotators,
  bool_or(condition <> '' OR {sql_cue("(quote || ' ' || natural_language)", R.CONDITION_CUE)}) AS conditional,
  array_to_string(list_sort(list_distinct(list(group_id)))[1:8], '|') AS groups,
  coalesce(array_to_string(list_sort(list_distinct(list(substring(condition, 1, 80)) FILTER (WHERE condition <> '')))[1:4], '|'), '') AS conditions,
  coalesce(array_to_string(list_sort(list_distinct(list(temporal_context) FILTER (WHERE temporal_context <> '')))[1:4], '|'), '') AS temporals,
  coalesce(max_by(label, {SEVERITY_SQL.format(x='label')}), 'unlabeled') AS conflict_label
  FROM edge_fact GROUP BY ALL),
ends AS (SELECT guideline_version, doc_id, s_cluster AS cluster_id, conflict_label, annotators FROM edge
  UNION ALL SELECT guideline_version, doc_id, o_cluster, conflict_label, annotators FROM edge WHERE o_cluster <> s_cluster)"""
FLAT = labelled_sql() + "," + RESOLVED + EDGES
BASE = facts_sql() + "," + RESOLVED


def _resolved_and_labelled(spark, sf):
    base = stored_sentences(spark, sf)
    return resolved(spark, sf, base), labelled(spark, sf, base=base)


def _edges(spark, sf):
    return G.edges(*_resolved_and_labelled(spark, sf))


CLUSTER_SQL = facts_sql() + "," + RESOLVED + """,
names AS (SELECT DISTINCT doc_id, surface FROM member),
ents AS (SELECT DISTINCT surface AS raw FROM names),""" + ENTITY_SQL[ENTITY_SQL.index("dated AS"):] + r""",
keyed AS MATERIALIZED (SELECT doc_id, surface, lower(coalesce(nullif(trim(array_to_string(kept, ' '), ' ,;:.'), ''), trim(raw))) AS key FROM names JOIN cores ON raw = surface),
keys AS (SELECT doc_id, key, count(*) AS copies FROM keyed GROUP BY ALL),
word AS (SELECT doc_id, key, copies, ' ' || unnest(list_filter(string_split_regex(key, '\s+'), lambda x: x <> '')) || ' ' AS w FROM keys),
gram AS (SELECT doc_id, key, copies, unnest(list_concat(list_concat(
    list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3)),
    list_transform(range(1, length(w) - 2), lambda i: substring(w, i, 4))),
    list_transform(range(1, length(w) - 3), lambda i: substring(w, i, 5)))) AS gram FROM word),
tf AS (SELECT doc_id, key, copies, gram, count(*) AS tf FROM gram GROUP BY ALL),
df AS (SELECT doc_id, gram, sum(copies) AS df FROM tf GROUP BY ALL),
total AS (SELECT doc_id, sum(copies) AS n FROM keys GROUP BY doc_id),
raw_w AS (SELECT doc_id, key, gram, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS r FROM tf JOIN df USING (doc_id, gram) JOIN total USING (doc_id)),
weight AS MATERIALIZED (SELECT doc_id, key, gram, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id, key)) AS w FROM raw_w),
link AS MATERIALIZED (SELECT x.doc_id, x.key AS a, y.key AS b FROM weight x JOIN weight y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.key <> y.key
  GROUP BY ALL HAVING sum(x.w * y.w) >= 0.78),
reach AS (SELECT doc_id, key, key AS spot FROM keys UNION SELECT r.doc_id, r.key, l.b FROM reach r JOIN link l ON l.doc_id = r.doc_id AND l.a = r.spot),
root AS (SELECT doc_id, key, min(spot) AS root FROM reach GROUP BY ALL),
rep AS (SELECT doc_id, root, min_by(surface, {'n': length(surface), 's': surface}) AS rep FROM keyed JOIN root USING (doc_id, key) GROUP BY ALL)"""


@register("c1_entity_clusters", "WITH RECURSIVE " + CLUSTER_SQL.strip() + r"""
SELECT doc_id, surface, 'ent_' || trim(substr(regexp_replace(lower(rep), '[^a-z0-9]+', '_', 'g'), 1, 24), '_') || '_' || substr(sha1(rep), 1, 8) AS cluster_id
FROM keyed JOIN root USING (doc_id, key) JOIN rep USING (doc_id, root)""")
def c1(spark, sf):
    found = E.cluster(facts(spark, sf), sizes=name_bounds(spark, sf))
    return found.select("doc_id", "surface", "cluster_id")


@register("f8_u6_surface_forms", with_sql(BASE, "SELECT DISTINCT doc_id, surface FROM member"))
def f8(spark, sf):
    return E.surface_forms(facts(spark, sf)).select("doc_id", "surface").distinct()


@register("c2_cluster_names", with_sql(BASE, r"""
SELECT doc_id, cluster_id, 'ent_' || trim(substr(regexp_replace(lower(rep), '[^a-z0-9]+', '_', 'g'), 1, 24), '_') || '_' || substr(sha1(rep), 1, 8) AS name FROM (
  SELECT doc_id, cluster_id, min_by(surface, {'n': length(surface), 's': surface}) AS rep FROM member GROUP BY ALL)"""))
def c2(spark, sf):
    c = clusters(facts(spark, sf)).groupBy("doc_id", "cluster_id").agg(F.min_by("surface", F.struct(F.length("surface"), F.col("surface"))).alias("rep"))
    return c.select("doc_id", "cluster_id", E.cluster_id(F.col("rep")).alias("name"))


@register("c3_alignment_components", with_sql(labelled_sql(), """
SELECT f.doc_id, f.fact_id, coalesce(least(p.fact_a_id, p.fact_b_id), f.fact_id) AS component FROM facts f
LEFT JOIN (SELECT * FROM labelled WHERE fact_a_id IS NOT NULL AND fact_b_id IS NOT NULL) p
  ON f.fact_id = CASE WHEN f.annotator = 'ann_a' THEN p.fact_a_id ELSE p.fact_b_id END"""))
def c3(spark, sf):
    return E.alignment_components(pairs(spark, sf), facts(spark, sf)).select("doc_id", "fact_id", "component")


@register("j5_fact_clusters", with_sql(BASE, "SELECT fact_id, s_cluster, o_cluster FROM resolved"))
def j5(spark, sf):
    return resolved(spark, sf).select("fact_id", "s_cluster", "o_cluster")


@register("j6_fact_labels", with_sql(FLAT, "SELECT fact_id, label AS conflict_label FROM fact_label"))
def j6(spark, sf):
    return G.strongest_by(G.labels_of_facts(labelled(spark, sf)), [*SCOPE, "fact_id"]).select("fact_id", "conflict_label")


@register("a7_flat_edges", with_sql(FLAT, """
SELECT doc_id, s_cluster, predicate_key, o_cluster, n_facts, annotators, conditional, groups, conditions, temporals, conflict_label FROM edge"""))
def a7(spark, sf):
    joined = lambda c: F.array_join(F.coalesce(c, F.array()), "|").alias(c)
    return _edges(spark, sf).select("doc_id", "s_cluster", "predicate_key", "o_cluster", "n_facts", joined("annotators"), "conditional",
                                    joined("groups"), joined("conditions"), joined("temporals"), "conflict_label")


NAME_SQL = "replace('e_' || s_cluster || '__' || substr(predicate_key, 1, 24) || '__' || o_cluster, ' ', '_')"


@register("a7_x16_edge_members", with_sql(FLAT, f"""
SELECT doc_id, 'e_' || substr(sha1(concat_ws('|', guideline_version, doc_id, s_cluster, predicate_key, o_cluster)), 1, 16) AS edge_id,
  {NAME_SQL} AS edge_name, fact_id, annotator, section_path, coalesce(label, 'unlabeled') AS conflict_label FROM edge_fact"""))
def a7_members(spark, sf):
    return G.edge_members(*_resolved_and_labelled(spark, sf)).select("doc_id", "edge_id", "edge_name", "fact_id", "annotator", "section_path", "conflict_label")


@register("a7_x16_edge_sections", with_sql(FLAT, f"""
SELECT doc_id, {NAME_SQL} AS edge_name, array_to_string(list_sort(list_distinct(list(section_path))), '|') AS section_paths,
  coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE label IS NOT NULL))), '|'), '') AS labels
FROM edge_fact GROUP BY guideline_version, doc_id, s_cluster, predicate_key, o_cluster"""))
def a7_sections(spark, sf):
    return _edges(spark, sf).select("doc_id", "edge_name", F.array_join("section_paths", "|").alias("section_paths"), F.array_join("labels", "|").alias("labels"))


@register("a8_j17_flat_nodes", with_sql(FLAT, f"""
SELECT m.*, coalesce(w.label, 'unlabeled') AS conflict_label FROM (
  SELECT doc_id, cluster_id, min_by(surface, {{'n': length(surface), 's': surface}}) AS full_label, count(DISTINCT surface) AS n_surface,
    array_to_string(list_sort(list_distinct(list(annotator))), '|') AS annotators FROM member GROUP BY ALL) m
LEFT JOIN (SELECT doc_id, cluster_id, max_by(conflict_label, {SEVERITY_SQL.format(x='conflict_label')}) AS label FROM ends
  WHERE {SEVERITY_SQL.format(x='conflict_label')} > 0 GROUP BY ALL) w USING (doc_id, cluster_id)"""))
def a8(spark, sf):
    r, pairs = _resolved_and_labelled(spark, sf)
    return G.nodes(r, G.edges(r, pairs)).select(
        "doc_id", "cluster_id", "full_label", "n_surface", F.array_join("annotators", "|").alias("annotators"), "conflict_label")


@register("a9_strongest_label", with_sql(FLAT, f"""
SELECT doc_id, max_by(conflict_label, {SEVERITY_SQL.format(x='conflict_label')}) AS conflict_label FROM labelled GROUP BY doc_id"""))
def a9(spark, sf):
    names = labelled(spark, sf).groupBy("doc_id").agg(F.collect_set("conflict_label").alias("labels"))
    return names.select("doc_id", R.strongest("labels").alias("conflict_label"))


@register("a10_edge_label_counts", with_sql(FLAT, "SELECT doc_id, conflict_label, count(*) AS n_edges FROM edge GROUP BY ALL"))
def a10(spark, sf):
    return G.edge_label_counts(_edges(spark, sf)).drop("guideline_version")


@register("a30_node_degree", with_sql(FLAT, "SELECT doc_id, cluster_id, count(*) AS degree FROM ends GROUP BY ALL"))
def a30(spark, sf):
    return G.degrees(_edges(spark, sf)).drop("guideline_version")


@register("a28_annotator_subgraphs", with_sql(FLAT, """
SELECT doc_id, annotator, n_relations, n_entities, n_total FROM (
  SELECT doc_id, annotator, count(*) AS n_relations FROM (SELECT doc_id, unnest(string_split(annotators, '|')) AS annotator FROM edge) GROUP BY ALL)
JOIN (SELECT doc_id, annotator, count(DISTINCT cluster_id) AS n_entities FROM (SELECT doc_id, cluster_id, unnest(string_split(annotators, '|')) AS annotator FROM ends) GROUP BY ALL) USING (doc_id, annotator)
JOIN (SELECT doc_id, count(DISTINCT cluster_id) AS n_total FROM member GROUP BY ALL) USING (doc_id)"""))
def a28(spark, sf):
    r, pairs = _resolved_and_labelled(spark, sf)
    e = G.edges(r, pairs)
    return G.annotator_subgraphs(e, G.nodes(r, e)).drop("guideline_version")


@register("f7_visible_edges", with_sql(FLAT, """
SELECT doc_id, s_cluster, predicate_key, o_cluster FROM edge WHERE conflict_label = 'contradiction' AND contains(annotators, 'ann_b')"""))
def f7(spark, sf):
    return G.visible_graph(_edges(spark, sf), ["ann_b"], "contradiction").select("doc_id", "s_cluster", "predicate_key", "o_cluster")


@register("f7_without_islands")
def f7b(spark, sf):
    return G.without_islands(_edges(spark, sf).select(*G.EDGE)).select("doc_id", "s_cluster", "predicate_key", "o_cluster")


@register("j18_neighbourhood", with_sql(FLAT, """
SELECT DISTINCT c.doc_id, c.centre, CASE WHEN e.s_cluster = c.centre THEN e.o_cluster ELSE e.s_cluster END AS neighbour
FROM (SELECT doc_id, min(cluster_id) AS centre FROM member GROUP BY doc_id) c JOIN edge e ON e.doc_id = c.doc_id AND (e.s_cluster = c.centre OR e.o_cluster = c.centre)"""))
def j18(spark, sf):
    base = stored_sentences(spark, sf)
    centres = clusters(facts(spark, sf, base=base)).groupBy(*SCOPE).agg(F.min("cluster_id").alias("centre"))
    return G.neighbourhood(G.edges(resolved(spark, sf, base), labelled(spark, sf, base=base)), centres).select("doc_id", "centre", "neighbour")


@register("f4_facts_of_entity", with_sql(BASE + """,
form AS (SELECT DISTINCT doc_id, cluster_id, surface FROM member)""", """
SELECT r.doc_id, m.cluster_id, r.fact_id FROM resolved r JOIN form m ON m.doc_id = r.doc_id AND m.surface = r.subject
UNION SELECT r.doc_id, m.cluster_id, r.fact_id FROM resolved r JOIN form m ON m.doc_id = r.doc_id AND m.surface = r.object"""))
def f4(spark, sf):
    r = resolved(spark, sf)
    seen = r.select(*SCOPE, "annotator", F.explode(F.array(
        F.struct(F.col("s_cluster").alias("cluster_id"), T.strip("subject").alias("surface")),
        F.struct(F.col("o_cluster").alias("cluster_id"), T.strip("object").alias("surface")))).alias("m")).select(*SCOPE, "m.*")
    forms = seen.where("cluster_id is not null").groupBy(*SCOPE, "cluster_id").agg(F.collect_set("surface").alias("surface_forms"))
    return G.facts_of_entity(facts(spark, sf), forms).select("doc_id", "cluster_id", "fact_id")


@register("f5_pairs_on_edges", with_sql(FLAT, """
SELECT DISTINCT e.doc_id, e.s_cluster, e.predicate_key, e.o_cluster, p.fact_a_id, p.fact_b_id FROM (
  SELECT fact_a_id AS fact_id, fact_a_id, fact_b_id FROM labelled UNION ALL SELECT fact_b_id, fact_a_id, fact_b_id FROM labelled) p
JOIN edge_fact e ON e.fact_id = p.fact_id"""))
def f5(spark, sf):
    base = stored_sentences(spark, sf)
    return G.pairs_on_edges(pairs(spark, sf, base=base), resolved(spark, sf, base)).drop("guideline_version")


@register("x16_edge_ids", with_sql(FLAT, """
SELECT doc_id, 'e_' || substr(sha1(concat_ws('|', guideline_version, doc_id, s_cluster, predicate_key, o_cluster)), 1, 16) AS edge_id FROM edge"""))
def x16(spark, sf):
    return _edges(spark, sf).select("doc_id", "edge_id")


# --- reified graph -----------------------------------------------------------

STATEMENTS = f""",
sfact AS (SELECT *, 'st_' || substr(sha1(concat_ws('|', coalesce(s_cluster, ''), predicate_key, coalesce(o_cluster, ''),
    {LOWER_COLLAPSED.format(x='condition')}, {LOWER_COLLAPSED.format(x='temporal_context')})), 1, 14) AS statement_id,
  quote || ' ' || natural_language AS said FROM resolved),
slabel AS (SELECT doc_id, statement_id, max_by(label, {SEVERITY_SQL.format(x='label')}) AS label FROM sfact JOIN fact_label USING (fact_id) GROUP BY ALL),
stmt AS (SELECT doc_id, statement_id, any_value(s_cluster) AS s_cluster, any_value(o_cluster) AS o_cluster, any_value(predicate_key) AS predicate_key,
  min_by(predicate, {{'a': annotator, 'p': fact_pos}}) AS predicate, min_by(subject, {{'a': annotator, 'p': fact_pos}}) AS subject_label,
  count(DISTINCT fact_id) AS n_facts, count(DISTINCT annotator) AS n_annotators, count(DISTINCT group_id) AS n_groups,
  bool_or(condition <> '' OR {sql_cue('said', R.CONDITION_CUE)}) AS conditional, bool_or({sql_cue('said', R.NEGATION_CUE)}) AS negated,
  bool_or({sql_cue('said', R.COMPLEXITY_CUE)}) AS complex,
  CASE WHEN bool_or({sql_cue('said', R.MODALITY_CUE)}) THEN 'alleged' ELSE 'asserted' END AS modality,
  coalesce(array_to_string(list_sort(list_distinct(list(substring(condition, 1, 120)) FILTER (WHERE condition <> '')))[1:4], ' '), '') AS condition_text,
  coalesce(array_to_string(list_sort(list_distinct(list(substring(temporal_context, 1, 80)) FILTER (WHERE temporal_context <> '')))[1:4], ' '), '') AS temporal_text
  FROM sfact GROUP BY doc_id, statement_id),
scopes AS (SELECT doc_id, s_cluster, predicate_key, o_cluster FROM stmt WHERE s_cluster IS NOT NULL AND o_cluster IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
statement AS (SELECT stmt.*, coalesce(label, 'unlabeled') AS conflict_label, (scopes.doc_id IS NOT NULL) AS scope_variant FROM stmt
  LEFT JOIN slabel USING (doc_id, statement_id)
  LEFT JOIN scopes ON scopes.doc_id = stmt.doc_id AND scopes.s_cluster = stmt.s_cluster AND scopes.predicate_key = stmt.predicate_key AND scopes.o_cluster = stmt.o_cluster)"""


def _statements(spark, sf):
    base = stored_sentences(spark, sf)
    f = facts(spark, sf, base=base)
    c = clusters(f)
    m = RG.statement_facts(G.resolve(f, c))
    return m, RG.statements(m, labelled(spark, sf, base=base)), c


@register("a11_statements", with_sql(FLAT + STATEMENTS, """
SELECT doc_id, statement_id, predicate, subject_label, n_facts, n_annotators, n_groups, conditional, negated, complex, modality, condition_text,
  temporal_text, conflict_label FROM statement"""))
def a11(spark, sf):
    _, s, _ = _statements(spark, sf)
    return s.select("doc_id", "statement_id", "predicate", "subject_label", "n_facts", "n_annotators", "n_groups", "conditional", "negated", "complex",
                    "modality", F.array_join(F.coalesce("conditions", F.array()), " ").alias("condition_text"),
                    F.array_join(F.coalesce("temporals", F.array()), " ").alias("temporal_text"), "conflict_label")


@register("a12_scope_variants", with_sql(FLAT + STATEMENTS, "SELECT doc_id, statement_id, scope_variant FROM statement"))
def a12(spark, sf):
    return _statements(spark, sf)[1].select("doc_id", "statement_id", "scope_variant")


@register("a13_logic_groups", with_sql(FLAT + STATEMENTS + """,
branch AS (SELECT * FROM sfact WHERE logic_group <> '' AND logic_op IN ('AND', 'OR', 'XOR'))""", f"""
SELECT doc_id, annotator, 'lo_' || substr(sha1(annotator || '|' || logic_group), 1, 12) AS logic_id, n_branches, op, conflict_label FROM (
  SELECT b.doc_id, b.annotator, b.logic_group, count(DISTINCT b.statement_id) AS n_branches,
    max_by(s.conflict_label, {SEVERITY_SQL.format(x='s.conflict_label')}) AS conflict_label
  FROM branch b JOIN statement s ON s.doc_id = b.doc_id AND s.statement_id = b.statement_id GROUP BY ALL) x
JOIN (SELECT doc_id, annotator, logic_group, max_by(logic_op, {{'n': n, 'p': -p}}) AS op FROM (
  SELECT doc_id, annotator, logic_group, logic_op, count(*) AS n, min(fact_pos) AS p FROM branch GROUP BY ALL) GROUP BY ALL) o USING (doc_id, annotator, logic_group)
WHERE n_branches >= 2"""))
def a13(spark, sf):
    m, s, _ = _statements(spark, sf)
    return RG.logic_nodes(m, s).select("doc_id", "annotator", "logic_id", "n_branches", "op", "conflict_label")


@register("j10_condition_references", with_sql(FLAT + STATEMENTS, """
SELECT s.doc_id, s.statement_id, min_by(m.cluster_id, {'n': -length(m.surface), 's': m.surface}) AS ref_cluster
FROM statement s JOIN (SELECT DISTINCT doc_id, cluster_id, surface FROM member) m ON m.doc_id = s.doc_id
WHERE s.condition_text <> '' AND length(m.surface) >= 5 AND contains(lower(s.condition_text), lower(m.surface))
  AND m.cluster_id IS DISTINCT FROM s.s_cluster AND m.cluster_id IS DISTINCT FROM s.o_cluster GROUP BY ALL"""))
def j10(spark, sf):
    _, s, c = _statements(spark, sf)
    return RG.references(s, c, "condition").select("doc_id", "statement_id", "ref_cluster")


def _reference_sql(name, phrase):
    return f""",
{name} AS (SELECT s.doc_id, s.statement_id, min_by(m.cluster_id, {{'n': -length(m.surface), 's': m.surface}}) AS cluster_id
  FROM statement s JOIN (SELECT DISTINCT doc_id, cluster_id, surface FROM member) m ON m.doc_id = s.doc_id
  WHERE s.{phrase} <> '' AND length(m.surface) >= 5 AND contains(lower(s.{phrase}), lower(m.surface))
    AND m.cluster_id IS DISTINCT FROM s.s_cluster AND m.cluster_id IS DISTINCT FROM s.o_cluster GROUP BY ALL)"""


@register("u2_reified_entities", with_sql(FLAT + STATEMENTS + _reference_sql("ref", "condition_text") + _reference_sql("tref", "temporal_text") + """,
touch AS (SELECT doc_id, s_cluster AS cluster_id, true AS asserted FROM statement WHERE s_cluster IS NOT NULL
  UNION ALL SELECT doc_id, o_cluster, true FROM statement WHERE o_cluster IS NOT NULL
  UNION ALL SELECT doc_id, cluster_id, false FROM ref UNION ALL SELECT doc_id, cluster_id, false FROM tref)""",
    "SELECT doc_id, cluster_id, NOT bool_or(asserted) AS ref_only FROM touch GROUP BY ALL"))
def u2(spark, sf):
    m, s, c = _statements(spark, sf)
    return RG.entity_nodes(RG.edges(s, c), c, m).select("doc_id", "cluster_id", "ref_only")


@register("reified_edges", with_sql(FLAT + STATEMENTS, """
SELECT doc_id, s_cluster AS source, statement_id AS target, 'subject' AS role, conflict_label FROM statement WHERE s_cluster IS NOT NULL
UNION ALL SELECT doc_id, statement_id, o_cluster, 'object', conflict_label FROM statement WHERE o_cluster IS NOT NULL"""))
def reified_edges(spark, sf):
    _, s, c = _statements(spark, sf)
    return RG.edges(s, c).where("role in ('subject', 'object')").select("doc_id", "source", "target", "role", "conflict_label")


# --- property graph ----------------------------------------------------------


def _export_inputs(spark, sf, base=None):
    base = stored_sentences(spark, sf) if base is None else base
    f = facts(spark, sf, base=base)
    return f, clusters(f), labelled(spark, sf, base=base)


def _export(spark, sf, base=None):
    f, c, pairs = _export_inputs(spark, sf, base)
    return PG.export_tables(G.resolve(f, c), c, pairs)


@register("k7_fact_vertices", with_sql(BASE, f"""
SELECT fact_id, predicate_norm, trim(subject) AS subject_surface, condition, (condition <> '' OR {sql_cue('t', R.CONDITION_CUE)}) AS conditional,
  {sql_cue('t', R.NEGATION_CUE)} AS negated FROM (SELECT *, quote || ' ' || natural_language AS t FROM resolved)"""))
def k7(spark, sf):
    return _export(spark, sf)["facts"].select("fact_id", "predicate_norm", "subject_surface", "condition", "conditional", "negated")


@register("k7_a29_export_counts", with_sql(FLAT, """
SELECT 'documents' AS name, count(DISTINCT doc_id) AS n FROM facts UNION ALL SELECT 'annotators', count(DISTINCT annotator) FROM facts
UNION ALL SELECT 'entities', count(*) FROM (SELECT DISTINCT doc_id, cluster_id FROM member)
UNION ALL SELECT 'spans', count(*) FROM (SELECT DISTINCT doc_id, section_path, char_start, char_end, quote FROM facts)
UNION ALL SELECT 'facts', count(*) FROM facts UNION ALL SELECT 'subject', count(s_cluster) FROM resolved UNION ALL SELECT 'object', count(o_cluster) FROM resolved
UNION ALL SELECT 'from_span', count(*) FROM facts UNION ALL SELECT 'asserted_by', count(*) FROM facts UNION ALL SELECT 'in_doc', count(*) FROM facts
UNION ALL SELECT 'aligned_with', count(*) FROM labelled WHERE fact_a_id IS NOT NULL AND fact_b_id IS NOT NULL"""))
def k7_counts(spark, sf):
    f, c, pairs = _export_inputs(spark, sf)
    r = G.resolve(f, c)
    return PG.export_counts(PG.export_tables(r, c, pairs), PG.fact_vertices(r))


@register("k8_merge_load", with_sql(BASE, "SELECT fact_id, count(*) AS n FROM resolved GROUP BY ALL"))
def k8(spark, sf):
    vertices = _export(spark, sf)["facts"].select("guideline_version", "doc_id", "fact_id")
    merged = PG.merge_by_id(vertices, vertices.unionByName(vertices), ["guideline_version", "fact_id"])
    return merged.groupBy("fact_id").agg(F.count(F.lit(1)).alias("n"))


@register("k9_uniqueness_violations", with_sql(facts_sql(), "SELECT fact_id, count(*) AS n FROM facts GROUP BY ALL HAVING count(*) > 1"))
def k9(spark, sf):
    return PG.duplicate_keys(facts(spark, sf), ["guideline_version", "fact_id"]).select("fact_id", "n")


@register("j16_aligned_edges", with_sql(FLAT, "SELECT fact_a_id, fact_b_id, conflict_label AS label FROM labelled WHERE fact_a_id IS NOT NULL AND fact_b_id IS NOT NULL"))
def j16(spark, sf):
    return _export(spark, sf)["aligned_with"].select("fact_a_id", "fact_b_id", "label")


def _rule_sql(where):
    return f"""SELECT a.doc_id, a.fact_id AS fact_id_a, b.fact_id AS fact_id_b FROM resolved a JOIN resolved b
ON a.guideline_version = b.guideline_version AND a.doc_id = b.doc_id AND a.s_cluster = b.s_cluster AND a.o_cluster = b.o_cluster
WHERE a.fact_id < b.fact_id AND a.annotator <> b.annotator AND {where}"""


@register("r1_predicate_mismatch", with_sql(BASE, _rule_sql("a.predicate_norm <> b.predicate_norm")))
def r1(spark, sf):
    return PG.predicate_mismatch(_export(spark, sf)["facts"]).select("doc_id", "fact_id_a", "fact_id_b")


@register("r2_redundancy", with_sql(BASE, _rule_sql("a.predicate_norm = b.predicate_norm")))
def r2(spark, sf):
    return PG.redundant_triples(_export(spark, sf)["facts"]).select("doc_id", "fact_id_a", "fact_id_b")


R3_SQL = """SELECT a.doc_id, a.fact_id AS fact_id_a, b.fact_id AS fact_id_b FROM resolved a JOIN resolved b
ON a.guideline_version = b.guideline_version AND a.doc_id = b.doc_id AND a.section_path = b.section_path
WHERE a.fact_id < b.fact_id AND a.annotator <> b.annotator AND a.char_start <= b.char_end AND b.char_start <= a.char_end
  AND (a.predicate_norm <> b.predicate_norm OR a.subject <> b.subject)"""


def _spanned(spark, sf, base=None):
    f = facts(spark, sf, base=base)
    return f.select(*SCOPE, "fact_id", "annotator", T.predicate_norm("predicate").alias("predicate_norm"), T.strip("subject").alias("subject_surface"),
                    "source_locator.section_path", "source_locator.char_start", "source_locator.char_end")


@register("r3_j8_granularity", with_sql(BASE, R3_SQL))
def r3(spark, sf):
    return PG.granularity(_spanned(spark, sf)).select("doc_id", "fact_id_a", "fact_id_b")


@register("r4_a18_cardinality", with_sql(BASE, """
SELECT doc_id, predicate_norm, s_cluster, count(DISTINCT o_cluster) AS distinct_objects, count(*) AS n_facts FROM resolved
WHERE s_cluster IS NOT NULL AND o_cluster IS NOT NULL GROUP BY ALL HAVING count(DISTINCT o_cluster) > 1"""))
def r4(spark, sf):
    return PG.cardinality(_export(spark, sf)["facts"]).drop("guideline_version")


@register("r4_supplier_part_cardinality", """
SELECT l_linestatus AS guideline_version, l_returnflag AS predicate_norm, CAST(l_suppkey AS VARCHAR) AS s_cluster, count(DISTINCT l_partkey) AS distinct_objects,
  count(*) AS n_facts FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) > 3""")
def r4_lineitem(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("guideline_version"), F.lit("lineitem").alias("doc_id"), F.col("l_returnflag").alias("predicate_norm"),
        F.col("l_suppkey").cast("string").alias("s_cluster"), F.col("l_partkey").cast("string").alias("o_cluster"))
    return PG.cardinality(li, more_than=3).drop("doc_id")


R5 = f""", conflicts AS (
  SELECT 'predicate_mismatch' AS rule, fact_id_a, fact_id_b FROM ({_rule_sql('a.predicate_norm <> b.predicate_norm')})
  UNION SELECT 'redundancy', fact_id_a, fact_id_b FROM ({_rule_sql('a.predicate_norm = b.predicate_norm')})
  UNION SELECT 'granularity', fact_id_a, fact_id_b FROM ({R3_SQL}))"""


def _conflicts(spark, sf, base=None):
    base = stored_sentences(spark, sf) if base is None else base
    v = _export(spark, sf, base)["facts"]
    return PG.conflict_edges(PG.end_rules(v), granularity=PG.granularity(_spanned(spark, sf, base)))


@register("l5_conflict_edges", with_sql(BASE + R5, "SELECT rule, fact_id_a AS fact_a_id, fact_id_b AS fact_b_id FROM conflicts"))
def l5(spark, sf):
    # kept once: it is both what is there and what comes in
    found = checkpoint(_conflicts(spark, sf))
    return PG.materialise(found, found).select("rule", "fact_a_id", "fact_b_id")


@register("r5_a26_rule_validation", with_sql(FLAT + R5, """
SELECT rule, pipeline_label, count(*) AS n FROM conflicts c LEFT JOIN (
  SELECT least(fact_a_id, fact_b_id) AS lo, greatest(fact_a_id, fact_b_id) AS hi, conflict_label AS pipeline_label FROM labelled
  WHERE fact_a_id IS NOT NULL AND fact_b_id IS NOT NULL) p ON p.lo = c.fact_id_a AND p.hi = c.fact_id_b GROUP BY ALL"""))
def r5(spark, sf):
    base = stored_sentences(spark, sf)
    return PG.validate_rules(_conflicts(spark, sf, base), _export(spark, sf, base)["aligned_with"])


@register("l4_conditional_scope", with_sql(BASE, _rule_sql("a.predicate_norm = b.predicate_norm AND a.condition <> b.condition")))
def l4(spark, sf):
    return PG.conditional_scope(_export(spark, sf)["facts"]).select("doc_id", "fact_id_a", "fact_id_b")


@register("l6_complex_and_negated", with_sql(BASE, f"""
SELECT fact_id, annotator, {sql_cue('t', R.COMPLEXITY_CUE)} AS complex, {sql_cue('t', R.NEGATION_CUE)} AS negated
FROM (SELECT *, quote || ' ' || natural_language AS t FROM resolved) WHERE {sql_cue('t', R.COMPLEXITY_CUE)} OR {sql_cue('t', R.NEGATION_CUE)}"""))
def l6(spark, sf):
    return _export(spark, sf)["facts"].where("complex or negated").select("fact_id", "annotator", "complex", "negated")


@register("l6_surface_hotspots", with_sql(BASE, """
SELECT doc_id, cluster_id, count(DISTINCT surface) AS n_surface FROM member GROUP BY ALL ORDER BY n_surface DESC, doc_id, cluster_id LIMIT 20"""))
def l6_hot(spark, sf):
    c = clusters(facts(spark, sf)).groupBy("doc_id", "cluster_id").agg(F.count(F.lit(1)).alias("n_surface"))
    return c.orderBy(F.desc("n_surface"), "doc_id", "cluster_id").limit(20)


@register("a19_conditional_counts", with_sql(BASE, f"""
SELECT doc_id, guideline_version, count(*) AS n_conditional FROM resolved
WHERE condition <> '' OR {sql_cue("(quote || ' ' || natural_language)", R.CONDITION_CUE)} GROUP BY ALL"""))
def a19(spark, sf):
    return _export(spark, sf)["facts"].where("conditional").groupBy("doc_id", "guideline_version").agg(F.count(F.lit(1)).alias("n_conditional"))


@register("a20_version_label_distribution", with_sql(labelled_sql(("v1", "v2")) + f""",
decided AS (SELECT guideline_version, fact_id, max_by(conflict_label, {SEVERITY_SQL.format(x='conflict_label')}) AS label FROM (
  SELECT guideline_version, fact_a_id AS fact_id, conflict_label FROM labelled UNION ALL SELECT guideline_version, fact_b_id, conflict_label FROM labelled)
  WHERE fact_id IS NOT NULL AND conflict_label NOT IN ('unlabeled', 'escalate') GROUP BY ALL)""", """
SELECT guideline_version, coalesce(label, 'unlabeled') AS conflict_label, count(*) AS n
FROM facts LEFT JOIN decided USING (guideline_version, fact_id) GROUP BY ALL"""))
def a20(spark, sf):
    """Facts of both annotators by version and the strongest label among their pairs."""
    base = stored_sentences(spark, sf)
    decided = G.strongest_by(G.labels_of_facts(labelled(spark, sf, ("v1", "v2"), base)), [*SCOPE, "fact_id"])
    f = facts(spark, sf, ("v1", "v2"), base).select(*SCOPE, "fact_id").join(decided.hint("shuffle_hash"), [*SCOPE, "fact_id"], "left")
    return f.groupBy("guideline_version", F.coalesce("conflict_label", F.lit("unlabeled")).alias("conflict_label")).agg(F.count(F.lit(1)).alias("n"))


@register("a25_graph_status", with_sql(BASE + R5, "SELECT (SELECT count(*) FROM facts) AS n_facts, (SELECT count(*) FROM conflicts) AS n_conflicts_with"))
def a25(spark, sf):
    base = stored_sentences(spark, sf)
    n = facts(spark, sf, base=base).agg(F.count(F.lit(1)).alias("n_facts")).withColumn("k", F.lit(1))
    c = _conflicts(spark, sf, base).agg(F.count(F.lit(1)).alias("n_conflicts_with")).withColumn("k", F.lit(1))
    return n.join(c, "k").drop("k")


@register("l3_custom_query", with_sql(BASE, """
SELECT predicate_norm, count(*) AS n FROM resolved WHERE annotator = 'ann_a' GROUP BY ALL ORDER BY n DESC, predicate_norm LIMIT 50"""))
def custom(spark, sf):
    return PG.custom_query(spark, {"facts": _export(spark, sf)["facts"]}, """
        SELECT predicate_norm, count(*) AS n FROM pg_facts WHERE annotator = :who GROUP BY predicate_norm ORDER BY n DESC, predicate_norm LIMIT 50""",
        {"who": "ann_a"}, limit=50)
