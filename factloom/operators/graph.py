"""Flat conflict graph: entity nodes and one edge per resolved triple."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import rules as R
from factloom.functions import text as T
from factloom.operators.align import SCOPE
from factloom.session import checkpoint_dealt

# How many sorted values an edge shows, and how long each may be.
EDGE_CAPS = {"qualifier": 6, "group": 8, "condition": 4, "temporal": 4}
QUALIFIER_CHARS, EDGE_CONDITION_CHARS, EDGE_TEMPORAL_CHARS, EDGE_NAME_CHARS = 60, 80, 60, 24


def resolve(facts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Facts with the clusters of subject and object (null when blank or unknown).

    A task holds the names of its documents by hash, so that facts, which are wider and more, are not sorted for them.
    """
    out = facts
    for side, column in (("s", "subject"), ("o", "object")):
        lookup = clusters.select(*SCOPE, F.col("surface").alias(f"_{side}"), F.col("cluster_id").alias(f"{side}_cluster")).hint("shuffle_hash")
        out = out.withColumn(f"_{side}", T.entity_surface(column)).join(lookup, [*SCOPE, f"_{side}"], "left").drop(f"_{side}")
    return out


def _is_conditional() -> Column:
    said = F.concat(T.text_or_empty("source_locator.quote"), F.lit(" "), T.text_or_empty("natural_language"))
    return R.is_conditional(T.strip(T.text_or_empty("condition")), said)


def flagged(facts: DataFrame) -> DataFrame:
    """Facts with what edges read from quote and statement, so that these texts need not travel through the joins."""
    return facts.withColumn("_conditional", _is_conditional())


def strongest_by(df: DataFrame, keys: list[str], label: str = "conflict_label") -> DataFrame:
    """Most severe label per key: a partial maximum, one small row per key and task."""
    return df.groupBy(*keys).agg(F.max_by(F.col(label), R.severity(label)).alias("conflict_label"))


def labels_of_facts(pairs: DataFrame) -> DataFrame:
    """(scope, fact_id, label): decided labels of the pairs a fact takes part in."""
    decided = pairs.where(~F.col("conflict_label").isin("unlabeled", "escalate"))
    return decided.select(*SCOPE, "conflict_label", F.explode(F.array("fact_a_id", "fact_b_id")).alias("fact_id")).where(
        "fact_id is not null")


def edge_facts(resolved: DataFrame) -> DataFrame:
    """Facts that form an edge, with their edge key."""
    return resolved.where("s_cluster is not null and o_cluster is not null").withColumn(
        "predicate_key", T.predicate_key("predicate"))


def _first_values(values: Column, cap: int) -> Column:
    """The first few distinct values of a column, in order, as an array; blanks do not count."""
    return F.slice(F.array_sort(F.collect_set(F.when(values != "", values))), 1, cap)


def _qualifiers(*columns: str) -> Column:
    found = F.concat(*[T.entity_qualifiers(c) for c in columns])
    return F.transform(found, lambda q: F.substring(q, 1, QUALIFIER_CHARS))


EDGE = [*SCOPE, "s_cluster", "predicate_key", "o_cluster"]


def edges(resolved: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per (subject cluster, normalised predicate, object cluster).

    Facts are grouped once. Fact ids stay in ``edge_members``, one row each; an edge keeps their number. Labels are of a
    fixed set; the sets of ids, sections and values behind counts and lists are those of one edge of one document, whose
    facts lie in one task anyway. Everything else an edge shows is either a scalar aggregate or a capped list. ``edge_name`` is the readable id, unique within a document and version as
    long as predicates differ in their first characters; ``edge_id`` always is.
    """
    decided = strongest_by(labels_of_facts(pairs), [*SCOPE, "fact_id"]).withColumnRenamed("conflict_label", "_label")
    members = edge_facts(resolved).join(decided.hint("shuffle_hash"), [*SCOPE, "fact_id"], "left")
    conditional = F.col("_conditional") if "_conditional" in resolved.columns else _is_conditional()
    section = F.col("source_locator.section_path")
    group, condition, temporal = (T.strip(T.text_or_empty(c)) for c in ("group_id", "condition", "temporal_context"))
    found = members.groupBy(*EDGE).agg(
        F.size(F.collect_set("fact_id")).cast("long").alias("n_facts"),
        F.array_sort(F.collect_set("annotator")).alias("annotators"),
        F.array_sort(F.collect_set("_label")).alias("labels"),
        F.array_sort(F.collect_set(F.when(section != "", section))).alias("section_paths"),
        F.bool_or(conditional).alias("conditional"),
        F.max_by("_label", F.when(F.col("_label").isNotNull(), R.severity("_label"))).alias("conflict_label"),
        F.collect_set(_qualifiers("subject", "object")).alias("qualifiers"),
        _first_values(group, EDGE_CAPS["group"]).alias("groups"),
        _first_values(F.substring(condition, 1, EDGE_CONDITION_CHARS), EDGE_CAPS["condition"]).alias("conditions"),
        _first_values(F.substring(temporal, 1, EDGE_TEMPORAL_CHARS), EDGE_CAPS["temporal"]).alias("temporals"))
    qualifiers = F.filter(F.array_distinct(F.flatten("qualifiers")), lambda q: q != "")
    found = found.withColumn("qualifiers", F.slice(F.array_sort(qualifiers), 1, EDGE_CAPS["qualifier"]))
    kinds = [f"{kind}s" for kind in EDGE_CAPS]
    # an edge without any of these values has no lists; those of others may be empty
    listed = F.greatest(*[F.size(c) for c in kinds]) > 0
    found = found.select("*", listed.alias("_listed")).withColumns({c: F.when(F.col("_listed"), F.col(c)) for c in kinds}).drop("_listed")
    return (found.withColumn("conflict_label", F.coalesce("conflict_label", F.lit("unlabeled")))
            .withColumn("n_annotators", F.size("annotators"))
            .withColumn("edge_name", edge_name())
            .withColumn("edge_id", T.sha_id(*EDGE, prefix="e_")))


def edge_name() -> Column:
    """Ends and the beginning of the predicate, blanks as underscores."""
    return F.replace(F.concat(F.lit("e_"), "s_cluster", F.lit("__"), F.substring("predicate_key", 1, EDGE_NAME_CHARS), F.lit("__"), "o_cluster"), F.lit(" "), F.lit("_"))


def edge_members(resolved: DataFrame, pairs: DataFrame) -> DataFrame:
    """(edge_id, edge_name, fact_id, annotator, section_path, conflict_label): the facts of every edge, however many."""
    decided = strongest_by(labels_of_facts(pairs), [*SCOPE, "fact_id"])
    members = edge_facts(resolved).select(*EDGE, "fact_id", "annotator", "source_locator.section_path").join(
        decided.hint("shuffle_hash"), [*SCOPE, "fact_id"], "left").withColumn("conflict_label", F.coalesce("conflict_label", F.lit("unlabeled")))
    # by what an edge id stands for, so that members dealt out by document stay where they are
    return members.dropDuplicates([*EDGE, "fact_id"]).select(
        *SCOPE, "fact_id", "annotator", "section_path", edge_name().alias("edge_name"), T.sha_id(*EDGE, prefix="e_").alias("edge_id"), "conflict_label")


def nodes(resolved: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Entity nodes with their surface forms, annotators and the worst label on any incident edge."""
    seen = resolved.select(*SCOPE, "annotator", F.explode(F.array(
        F.struct(F.col("s_cluster").alias("cluster_id"), T.strip("subject").alias("surface")),
        F.struct(F.col("o_cluster").alias("cluster_id"), T.strip("object").alias("surface")))).alias("m"))
    seen = seen.select(*SCOPE, "annotator", "m.*").where("cluster_id is not null")
    body = seen.groupBy(*SCOPE, "cluster_id").agg(
        F.min_by("surface", F.struct(F.length("surface"), F.col("surface"))).alias("full_label"),
        F.array_sort(F.collect_set("surface")).alias("surface_forms"),
        F.array_sort(F.collect_set("annotator")).alias("annotators"))
    return (body.join(incident_labels(edge_table), [*SCOPE, "cluster_id"], "left")
            .withColumn("conflict_label", F.coalesce("conflict_label", F.lit("unlabeled")))
            .withColumn("label", T.display_label("full_label"))
            .withColumn("n_surface", F.size("surface_forms")).withColumn("n_annotators", F.size("annotators")))


def endpoints(edge_table: DataFrame) -> DataFrame:
    return edge_table.withColumn("cluster_id", F.explode(F.array_distinct(F.array("s_cluster", "o_cluster"))))


def incident_labels(edge_table: DataFrame) -> DataFrame:
    """Worst positive label among the edges touching a node."""
    hot = endpoints(edge_table.select(*EDGE, "conflict_label").where(R.severity("conflict_label") > 0))
    return strongest_by(hot, [*SCOPE, "cluster_id"])


def degrees(edge_table: DataFrame) -> DataFrame:
    return endpoints(edge_table).groupBy(*SCOPE, "cluster_id").agg(F.count(F.lit(1)).alias("degree"))


def edge_label_counts(edge_table: DataFrame) -> DataFrame:
    return edge_table.groupBy(*SCOPE, "conflict_label").agg(F.count(F.lit(1)).alias("n_edges"))


def annotator_subgraphs(edge_table: DataFrame, node_table: DataFrame) -> DataFrame:
    """Per annotator: relations it asserts, entities they touch, entities overall."""
    # one pass over the edges: the first end of each counts the edge, and an end of several edges is one entity
    own = edge_table.select(*SCOPE, F.explode("annotators").alias("annotator"), F.array_distinct(F.array("s_cluster", "o_cluster")).alias("ends"))
    ends = own.where("annotator is not null").select(*SCOPE, "annotator", F.posexplode("ends").alias("place", "cluster_id"))
    entities = ends.groupBy(*SCOPE, "annotator", "cluster_id").agg(F.count_if(F.col("place") == 0).alias("n"))
    found = entities.groupBy(*SCOPE, "annotator").agg(F.sum("n").alias("n_relations"), F.count(F.lit(1)).alias("n_entities"))
    # distinct, as that tells the planner that labels of nodes are not asked for
    total = node_table.select(*SCOPE, "cluster_id").distinct().groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n_total"))
    return found.join(total, SCOPE)


def neighbourhood(edge_table: DataFrame, centres: DataFrame) -> DataFrame:
    """(scope, centre, neighbour): the one-hop surroundings of each listed node."""
    ends = edge_table.select(*SCOPE, F.explode(F.array(
        F.struct(F.col("s_cluster").alias("centre"), F.col("o_cluster").alias("neighbour")),
        F.struct(F.col("o_cluster").alias("centre"), F.col("s_cluster").alias("neighbour")))).alias("n")).select(*SCOPE, "n.*")
    return ends.join(centres, [*SCOPE, "centre"], "left_semi").distinct()


def visible_graph(edge_table: DataFrame, annotators: list[str] | None = None, label: str | None = None) -> DataFrame:
    """Edges passing the annotator and label filters; nodes without such an edge vanish with them."""
    shown = edge_table
    if annotators is not None:
        shown = shown.where(F.arrays_overlap("annotators", F.array(*[F.lit(a) for a in annotators])))
    return shown if label is None else shown.where(F.col("conflict_label") == label)


def without_islands(edge_table: DataFrame, largest_island: int = 2) -> DataFrame:
    """Drop edges of components with at most ``largest_island`` nodes.

    The edges are stored, as the components need several passes over them; hand over no more columns than are wanted.
    """
    from factloom.operators.components import connected_components
    edge_table = checkpoint_dealt(edge_table)
    component = connected_components(edge_table, SCOPE, "s_cluster", "o_cluster").withColumnRenamed("node", "s_cluster")
    sizes = component.groupBy(*SCOPE, "component").agg(F.count(F.lit(1)).alias("n_nodes")).where(F.col("n_nodes") > largest_island)
    keep = component.join(sizes, [*SCOPE, "component"], "left_semi").select(*SCOPE, "s_cluster")
    return edge_table.join(keep, [*SCOPE, "s_cluster"], "left_semi")


def facts_of_entity(facts: DataFrame, node_table: DataFrame) -> DataFrame:
    """(scope, cluster_id, fact_id): facts naming any surface form of a node."""
    forms = node_table.select(*SCOPE, "cluster_id", F.explode("surface_forms").alias("surface"))
    names = facts.select(*SCOPE, "fact_id", F.explode(F.array_distinct(F.array("subject", "object"))).alias("surface"))
    return names.join(forms, [*SCOPE, "surface"]).select(*SCOPE, "cluster_id", "fact_id").distinct()


def pairs_on_edges(pairs: DataFrame, resolved: DataFrame) -> DataFrame:
    """(edge key, pair ids): pairs with at least one fact on the edge."""
    sides = pairs.select(*SCOPE, "fact_a_id", "fact_b_id", F.explode(F.array("fact_a_id", "fact_b_id")).alias("fact_id")).where(
        "fact_id is not null")
    return sides.join(edge_facts(resolved).select(*EDGE, "fact_id"), [*SCOPE, "fact_id"]).select(
        *EDGE, "fact_a_id", "fact_b_id").distinct()
