"""Property-graph tables (vertices and edges), pattern rules and the read-only query gate."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import rules as R
from factloom.functions import text as T
from factloom.operators.align import SCOPE
from factloom.operators.graph import QUALIFIER_CHARS

RULE_KEYS = ["guideline_version", "fact_a_id", "fact_b_id", "rule"]


def fact_vertices(resolved: DataFrame) -> DataFrame:
    said = T.provenance_text("source_locator.quote", "source_locator.linearized_sentence", "natural_language")
    base = resolved.withColumn("_said", said)
    quals = F.concat(T.split_entity("subject")["qualifiers"], T.split_entity("object")["qualifiers"])
    return base.select(
        *SCOPE, "fact_id", "annotator", "predicate", T.predicate_norm("predicate").alias("predicate_norm"),
        T.strip(T.text_or_empty("subject")).alias("subject_surface"), T.strip(T.text_or_empty("object")).alias("object_surface"),
        "natural_language", "conflict_label",
        F.array_sort(F.array_distinct(F.transform(quals, lambda q: F.substring(q, 1, QUALIFIER_CHARS)))).alias("qualifiers"),
        T.strip(T.text_or_empty("condition")).alias("condition"), T.strip(T.text_or_empty("temporal_context")).alias("temporal_context"),
        R.is_conditional(T.strip(T.text_or_empty("condition")), "_said").alias("conditional"),
        R.is_negated("_said").alias("negated"), R.modality("_said").alias("modality"), R.is_complex("_said").alias("complex"),
        "s_cluster", "o_cluster", F.col("source_locator").alias("locator"))


def locator_key():
    """Sorted-key JSON of a locator; equal spans get equal ids."""
    fields = ["annex_id", "char_end", "char_start", "quote", "row_idx", "section_path", "source_type", "table_id"]
    return F.to_json(F.struct(*[F.col(f"locator.{f}").alias(f) for f in fields]))


def export_tables(resolved: DataFrame, clusters: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """Vertex and edge tables of the property graph. Versions are part of every key."""
    facts = fact_vertices(resolved)
    spanned = facts.where("locator is not null").withColumn("span_id", T.span_id("doc_id", locator_key()))
    used = facts.select(*SCOPE, F.explode(F.array("s_cluster", "o_cluster")).alias("cluster_id")).where("cluster_id is not null").distinct()
    entities = clusters.join(used, [*SCOPE, "cluster_id"], "left_semi").groupBy(*SCOPE, "cluster_id").agg(
        F.min_by("surface", F.struct(F.length("surface"), F.col("surface"))).alias("label"),
        F.array_sort(F.collect_set("surface")).alias("surface_forms"))
    known = facts.select(*SCOPE, "fact_id")
    aligned = pairs.where("fact_a_id is not null and fact_b_id is not null")
    for side in ("a", "b"):
        aligned = aligned.join(known.withColumnRenamed("fact_id", f"fact_{side}_id").hint("shuffle_hash"), [*SCOPE, f"fact_{side}_id"], "left_semi")
    return {
        "documents": facts.select(*SCOPE).distinct(),
        "annotators": facts.select("annotator").distinct(),
        "entities": entities.withColumn("n_surface", F.size("surface_forms")),
        "spans": spanned.select("doc_id", "span_id", "locator.*").dropDuplicates(["span_id"]),
        "facts": facts.drop("locator"),
        "subject": facts.where("s_cluster is not null").select(*SCOPE, "fact_id", F.col("s_cluster").alias("cluster_id")),
        "object": facts.where("o_cluster is not null").select(*SCOPE, "fact_id", F.col("o_cluster").alias("cluster_id")),
        "from_span": spanned.select(*SCOPE, "fact_id", "span_id"),
        "asserted_by": facts.select(*SCOPE, "fact_id", "annotator"),
        "in_doc": facts.select(*SCOPE, "fact_id"),
        "aligned_with": aligned.select(*SCOPE, "fact_a_id", "fact_b_id", F.col("conflict_label").alias("label"), "cosine", "status"),
    }


#: Tables of ``export_tables`` that have one row for each fact with such a column.
ROW_OF_FACT = {"facts": None, "subject": "s_cluster", "object": "o_cluster", "from_span": "locator", "asserted_by": None, "in_doc": None}


def export_counts(tables: dict[str, DataFrame], vertices: DataFrame) -> DataFrame:
    """(name, n) of every table. Those with one row for each fact are counted in one pass over the facts."""
    one = vertices.agg(*[F.count(F.lit(1) if c is None else F.col(c)).alias(name) for name, c in ROW_OF_FACT.items()])
    out = one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("n")) for name in ROW_OF_FACT])).alias("x")).select("x.*")
    for name, df in tables.items():
        if name not in ROW_OF_FACT:
            out = out.unionByName(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n"))
    return out


def merge_by_id(existing: DataFrame | None, incoming: DataFrame, keys: list[str], wipe: str | None = None) -> DataFrame:
    """Idempotent load: incoming rows replace equal keys; ``wipe`` first drops whole documents."""
    fresh = incoming.dropDuplicates(keys)
    if existing is None:
        return fresh
    old = existing if wipe is None else existing.join(incoming.select(wipe).distinct(), wipe, "left_anti")
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows violating uniqueness; empty when the constraint holds."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# --- pattern rules ---------------------------------------------------------


def _same_ends(facts: DataFrame, how) -> DataFrame:
    """Ordered pairs of facts of two annotators linking the same entities; equi-join on the ends."""
    ends = [*SCOPE, "s_cluster", "o_cluster"]  # entities belong to a document and version
    side = facts.where("s_cluster is not null and o_cluster is not null")
    a = side.select(*ends, *[F.col(c).alias(f"{c}_a") for c in ("fact_id", "annotator", "predicate", "predicate_norm", "condition")])
    b = side.select(*ends, *[F.col(c).alias(f"{c}_b") for c in ("fact_id", "annotator", "predicate", "predicate_norm", "condition")])
    return a.join(b, ends).where("fact_id_a < fact_id_b and annotator_a <> annotator_b").where(how)


def end_rules(facts: DataFrame) -> DataFrame:
    """Both rules on facts that link the same entities, with a rule column: one join for the two."""
    rule = F.when(F.col("predicate_norm_a") == F.col("predicate_norm_b"), "redundancy").otherwise("predicate_mismatch")
    return _same_ends(facts, "predicate_norm_a is not null and predicate_norm_b is not null").withColumn("rule", rule)


def predicate_mismatch(facts: DataFrame) -> DataFrame:
    return _same_ends(facts, "predicate_norm_a <> predicate_norm_b")


def redundant_triples(facts: DataFrame) -> DataFrame:
    return _same_ends(facts, "predicate_norm_a = predicate_norm_b")


def conditional_scope(facts: DataFrame) -> DataFrame:
    return _same_ends(facts, "predicate_norm_a = predicate_norm_b and coalesce(condition_a, '') <> coalesce(condition_b, '')")


def granularity(spanned: DataFrame, bin_chars: int = 512, same_document: bool = True) -> DataFrame:
    """Facts of two annotators over overlapping source text with different triples.

    Spans are laid over bins; two spans meet in the bin where the later one starts,
    once, so a long section never joins all of its facts with each other.
    """
    keys = ["guideline_version", "section_path"] + (["doc_id"] if same_document else [])
    columns = ["fact_id", "annotator", "predicate_norm", "subject_surface", "char_start", "char_end"]
    placed = spanned.where("section_path is not null and char_start is not null and char_end >= char_start").select(*keys, *columns)
    bins = placed.withColumn("bin", F.explode(F.sequence(
        F.floor(F.col("char_start") / bin_chars), F.floor(F.col("char_end") / bin_chars))))
    a = bins.select(*keys, "bin", *[F.col(c).alias(f"{c}_a") for c in columns])
    b = bins.select(*keys, "bin", *[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(b, [*keys, "bin"]).where(
        "fact_id_a < fact_id_b and annotator_a <> annotator_b and char_start_a <= char_end_b and char_start_b <= char_end_a "
        "and (predicate_norm_a <> predicate_norm_b or subject_surface_a <> subject_surface_b)").where(
        F.col("bin") == F.floor(F.greatest("char_start_a", "char_start_b") / bin_chars))


def cardinality(facts: DataFrame, predicate: str | None = None, more_than: int = 1) -> DataFrame:
    """Subjects a functional predicate links to several objects."""
    rows = facts.where("s_cluster is not null and o_cluster is not null")
    if predicate is not None:
        rows = rows.where(F.col("predicate_norm") == predicate)
    key = [*SCOPE, "predicate_norm", "s_cluster"]
    per_object = rows.groupBy(*key, "o_cluster").agg(F.count(F.lit(1)).alias("n"))
    return per_object.groupBy(*key).agg(F.count(F.lit(1)).alias("distinct_objects"), F.sum("n").alias("n_facts")).where(
        F.col("distinct_objects") > more_than)


def conflict_edges(*ruled: DataFrame, **found: DataFrame) -> DataFrame:
    """CONFLICTS_WITH edges of several rules as one idempotent set; ``ruled`` tables name the rule of each row themselves."""
    out = None
    for rows in [*ruled, *[rows.withColumn("rule", F.lit(rule)) for rule, rows in found.items()]]:
        part = rows.select("guideline_version", F.col("fact_id_a").alias("fact_a_id"), F.col("fact_id_b").alias("fact_b_id"), "rule")
        out = part if out is None else out.unionByName(part)
    # a group, as the planner would take a plain distinct out of a union of this set with others and derive it once for each use
    return out.groupBy(*RULE_KEYS).agg(F.count(F.lit(1)).alias("_n")).drop("_n")


def materialise(existing: DataFrame | None, found: DataFrame) -> DataFrame:
    return found if existing is None else existing.unionByName(found).dropDuplicates(RULE_KEYS)


def validate_rules(conflicts: DataFrame, aligned: DataFrame) -> DataFrame:
    """How often each rule's edge coincides with which pipeline label, in either direction."""
    lo, hi = F.least("fact_a_id", "fact_b_id"), F.greatest("fact_a_id", "fact_b_id")
    left = conflicts.select("guideline_version", lo.alias("lo"), hi.alias("hi"), "rule")
    right = aligned.select("guideline_version", lo.alias("lo"), hi.alias("hi"), F.col("label").alias("pipeline_label"))
    return left.join(right, ["guideline_version", "lo", "hi"], "left").groupBy("rule", "pipeline_label").agg(F.count(F.lit(1)).alias("n"))


CONSTRAINTS = {
    "conditional_scope": {"mode": "report", "params": {}, "run": conditional_scope,
                          "description": "same subject, predicate and object, different condition"},
    "cardinality": {"mode": "report", "params": {"predicate": "decided"}, "run": cardinality,
                    "description": "a functional predicate with several objects"},
    "predicate_mismatch": {"mode": "report", "params": {}, "run": predicate_mismatch,
                           "description": "same subject and object, different predicate"},
    "materialize_predicate_mismatch": {"mode": "materialize", "params": {}, "run": predicate_mismatch,
                                       "description": "store predicate mismatches as conflict edges"},
}
REPORT_ROWS = 200  # length of a report where the caller wants a top list


def run_constraint(name: str, facts: DataFrame, existing: DataFrame | None = None, limit: int | None = None, **params) -> DataFrame:
    """All matches of a rule, or the first ``limit`` in column order; a materialised rule is stored whole."""
    spec = CONSTRAINTS[name]
    found = spec["run"](facts, **{**spec["params"], **params})
    if spec["mode"] == "materialize":
        return materialise(existing, conflict_edges(predicate_mismatch=found))
    return found if limit is None else found.orderBy(*found.columns).limit(limit)


# Words that destroy, words that write, and namespaces that no query may call.
DESTROYING = {"delete", "detach", "remove", "drop", "foreach", "truncate", "load"}
WRITING = {"merge", "create", "set", "insert", "update", "alter"}
UNCALLABLE = {"db", "dbms", "apoc"}
ALLOWED_WRITES = {"report": frozenset(), "materialize": frozenset(WRITING)}

_INERT = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|//[^\n]*|/\*.*?\*/", re.S)


def statement_words(statement: str | None) -> list[str]:
    """Lower-case words of a statement, without literals, quoted names and comments."""
    return re.findall(r"\w+", _INERT.sub(" ", statement or "").lower())


def check_custom_query(statement: str | None, mode: str = "report") -> tuple[bool, str]:
    """Whether a user-written statement may run, and what speaks against it."""
    words = statement_words(statement)
    against = [] if words else ["nothing to run"]
    if mode not in ALLOWED_WRITES:
        against.append(f"no such mode: {mode}")
    refused = sorted(set(words) & (DESTROYING | WRITING - ALLOWED_WRITES.get(mode, frozenset())))
    against += [f"{w.upper()} may not be used here" for w in refused]
    against += [f"{name} may not be called" for call, name in zip(words, words[1:]) if call == "call" and name in UNCALLABLE]
    return not against, "; ".join(against)


def custom_query(spark: SparkSession, tables: dict[str, DataFrame], statement: str, args: dict | None = None,
                 limit: int | None = None) -> DataFrame:
    """Run a gated SELECT over the graph tables, named ``pg_<name>`` in the statement.

    The views are gone when the statement is planned. A ``limit`` keeps that many rows of a statement that orders them itself.
    """
    allowed, reason = check_custom_query(statement)
    if not allowed:
        raise ValueError(reason)
    if statement_words(statement)[0] not in ("select", "with"):
        raise ValueError("only SELECT or WITH queries are accepted")
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(f"pg_{name}")
        found = spark.sql(statement, args=args or {})
    finally:
        for name in tables:
            spark.catalog.dropTempView(f"pg_{name}")
    return found if limit is None else found.limit(limit)
