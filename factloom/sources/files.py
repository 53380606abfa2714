"""Readers for fact files, documents, prompts and stored result tables."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.functions import text as T

# Names of the base version, accepted identifiers, rule headings, prompt slots.
BASE_VERSIONS = ("", "v1", "base")
IDENTIFIER = r"^[A-Za-z0-9_.\-]+$"
RULE_HEADING = r"(?m)^###\s*(\d+)\.\s*(.+?)\s*$"
GUIDELINE_SLOT, SECTION_SLOT = "<<GUIDELINE>>", "<<SECTION_TEXT>>"
USER_DOCUMENT_PREFIX = "user-"


def version_of(variant: str | None) -> str:
    """Stored guideline version behind a variant name; refuses anything but identifiers."""
    name = (variant or "").strip()
    if name in BASE_VERSIONS:
        return "v1"
    return check_identifier(name)


def check_identifier(name: str) -> str:
    if not re.match(IDENTIFIER, name or ""):
        raise ValueError(f"invalid identifier {name!r}")
    return name


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents, wrapped in ``document`` or bare; unreadable files are skipped."""
    schema = f"struct<document:{S.DOCUMENT_STRUCT},{S.DOCUMENT_STRUCT[len('struct<'):-1]}>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"))
    bare = F.struct(*[F.col(f"j.{f}").alias(f) for f in (
        "celex", "title", "citations", "recitals", "articles", "annexes", "concluding_formulas", "preamble_text", "enacting_text")])
    return raw.where("j is not null").select(F.coalesce(F.col("j.document"), bare).alias("document")).where("document.celex is not null")


def read_fact_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per fact from ``<root>/<annotator dir>/<doc>.json``.

    The annotator is the file's own name for it, else the directory. Broken files are
    skipped. When two directories claim the same annotator, document and guideline
    version, the last directory in name order wins.
    """
    raw = spark.read.text(f"{root}/*/*.json", wholetext=True).select(
        F.from_json("value", S.FACT_FILE.replace(", ", ",")).alias("j"), F.col("_metadata.file_path").alias("path"))
    files = raw.where("j is not null and j.facts is not null").select(
        "j.*", F.element_at(F.split("path", "/"), -2).alias("directory"),
        F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", "").alias("stem"))
    files = files.withColumn("annotator", F.coalesce(F.nullif(F.col("annotator"), F.lit("")), "directory")).withColumn(
        "doc_id", F.coalesce("doc_id", "stem")).withColumn(
        "_version", F.coalesce("guideline_version", F.get("facts", F.lit(0))["guideline_version"], F.lit("v1")))
    newest = files.groupBy("doc_id", "annotator", "_version").agg(F.max("directory").alias("directory"))
    kept = files.join(newest, ["doc_id", "annotator", "_version", "directory"], "left_semi")
    rows = kept.select(F.col("doc_id").alias("_d"), F.col("annotator").alias("_a"), F.col("guideline_version").alias("_v"),
                       F.posexplode("facts").alias("fact_pos", "f"))
    text_fields = ("condition", "temporal_context", "group_id", "logic_group", "logic_op")
    return rows.select(
        F.coalesce("f.guideline_version", "_v", F.lit("v1")).alias("guideline_version"), F.col("_d").alias("doc_id"),
        F.col("_a").alias("annotator"), "fact_pos", "f.fact_id", "f.subject", "f.predicate", "f.object", "f.natural_language",
        *[T.text_or_empty(f"f.{c}").alias(c) for c in text_fields], "f.source_locator",
        F.coalesce("f.conflict_label", F.lit("unlabeled")).alias("conflict_label"), "f.extra")


def comparable_documents(facts: DataFrame) -> DataFrame:
    """(guideline_version, doc_id) with at least two annotators; fewer cannot be compared."""
    return facts.groupBy("guideline_version", "doc_id").agg(F.count_distinct("annotator").alias("n_annotators")).where("n_annotators >= 2")


def run_guard(facts: DataFrame) -> DataFrame:
    """Per document a status row: comparable, or why it is refused."""
    counted = facts.groupBy("guideline_version", "doc_id").agg(F.count_distinct("annotator").alias("n_annotators"))
    return counted.withColumn("status", F.when(F.col("n_annotators") >= 2, F.lit("ok")).otherwise(F.lit("refused"))).withColumn(
        "error", F.when(F.col("n_annotators") < 2, F.lit("needs at least two annotators")))


def read_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A stored table, or an empty one of the same layout when there is none yet."""
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], ddl)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids, one per line; blank lines and # comments are skipped."""
    return spark.read.text(path).select(T.strip("value").alias("id")).where("id <> '' and not startswith(id, '#')")


def corpus_slice(documents: DataFrame, min_words: int, max_words: int, limit: int, skip: int = 0,
                 order: str = "doc_id", text: str = "text") -> DataFrame:
    """The first ``limit`` documents in source order whose length fits, after ``skip`` fitting ones."""
    fitting = documents.withColumn("n_words", T.word_count(text)).where(F.col("n_words").between(min_words, max_words))
    return fitting.orderBy(order).offset(skip).limit(limit)


def select_documents(candidates: DataFrame, already: DataFrame, need: int, document: str = "document") -> DataFrame:
    """Resume a selection: skip chosen ids, record rejections, keep the first acceptable ones."""
    from factloom.operators.parsing import quality_rejection
    d = F.col(document)
    fresh = candidates.join(already.select("doc_id"), F.col(f"{document}.celex") == F.col("doc_id"), "left_anti")
    judged = fresh.withColumn("reason", quality_rejection(document)).where("reason = ''")
    return judged.orderBy("source_index").limit(need).select(
        d["celex"].alias("doc_id"), d["title"].alias("title"), "n_words",
        (F.length(d["preamble_text"]) + F.length(d["enacting_text"])).alias("char_length"), F.size(d["recitals"]).alias("recital_count"),
        F.size(d["articles"]).alias("article_count"), F.size(d["citations"]).alias("citation_count"))


def guideline_rules(prompts: DataFrame, body: str = "value") -> DataFrame:
    """Numbered rule headings inside the <guideline> block, or in the whole text without one."""
    keep = [c for c in prompts.columns if c != body]
    block = F.regexp_extract(body, r"(?s)<guideline>(.*?)</guideline>", 1)
    within = F.when(F.col(body).rlike(r"(?s)<guideline>.*?</guideline>"), block).otherwise(F.col(body))
    found = F.regexp_extract_all(within, F.lit(RULE_HEADING), F.lit(0))
    return prompts.select(*keep, F.posexplode(found).alias("ordinal", "_h")).select(
        *keep, "ordinal", F.regexp_extract("_h", RULE_HEADING, 1).alias("rule_id"), F.regexp_extract("_h", RULE_HEADING, 2).alias("title"))


def read_guidelines(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue of stored guidelines: version, size, change time, summary line, body."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "extract_*.md").load(folder)
    body = F.decode("content", "UTF-8")
    heading = F.regexp_extract(body, r"(?m)^#\s*(Guideline.*)$", 1)
    first = F.substring(T.strip(F.regexp_extract(body, r"\A\s*([^\n]*)", 1)), 1, 120)
    return files.select(
        F.regexp_extract("path", r"extract_([^/]+)\.md$", 1).alias("version"), F.col("length").alias("n_bytes"),
        F.col("modificationTime").alias("modified"), F.when(heading != "", heading).otherwise(first).alias("summary"), body.alias("value"))


def assemble_prompt(guideline, schema_frame) -> Column:
    """Guideline put into its slot of the schema frame; self-contained guidelines stay as they are."""
    g, s = T._col(guideline), T._col(schema_frame)
    return F.when(F.contains(g, F.lit(SECTION_SLOT)), g).when(
        F.contains(s, F.lit(GUIDELINE_SLOT)), F.replace(s, F.lit(GUIDELINE_SLOT), g)).otherwise(
        F.raise_error(F.lit("schema frame has no guideline slot")))


def render_section_prompt(template, title, section_path, section_text, suffix: str = "\n\n/no_think") -> Column:
    out = T._col(template)
    for slot, value in (("<<DOC_TITLE>>", title), ("<<SECTION_PATH>>", section_path), (SECTION_SLOT, section_text)):
        out = F.replace(out, F.lit(slot), T.text_or_empty(value))
    return F.concat(out, F.lit(suffix))


def document_list(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """Documents with their annotators, base label counts and other versions."""
    base = pairs.where(F.col("guideline_version") == "v1")
    counts = base.groupBy("doc_id", "conflict_label").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("conflict_label", "n")))).alias("label_counts"))
    names = base.select("doc_id", F.explode(F.array("annotator_a", "annotator_b")).alias("a")).groupBy("doc_id").agg(
        F.array_sort(F.collect_set("a")).alias("annotators"))
    variants = pairs.where(F.col("guideline_version") != "v1").groupBy("doc_id").agg(
        F.array_sort(F.collect_set("guideline_version")).alias("variants"))
    return (documents.join(counts, "doc_id", "left").join(names, "doc_id", "left").join(variants, "doc_id", "left")
            .withColumn("has_conflicts", F.col("label_counts").isNotNull())
            .withColumn("is_user_doc", F.col("doc_id").startswith(USER_DOCUMENT_PREFIX))
            .withColumn("variants", F.coalesce("variants", F.array())))


def versions_of(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("guideline_version") != "v1").select("doc_id", "guideline_version").distinct()


def latest_version(runs: DataFrame) -> DataFrame:
    """Per document the version written last (ties by name)."""
    return runs.where(F.col("guideline_version") != "v1").groupBy("doc_id").agg(
        F.max_by("guideline_version", F.struct("modified", "guideline_version")).alias("guideline_version"))


def extraction_matrix(documents: DataFrame, models: list[str], versions: list[str], runs: DataFrame) -> DataFrame:
    """Every document, model and guideline cell with its latest run.

    Models and versions are a configured handful, so each document row carries the
    list of cells it expands into; no join without a key is needed.
    """
    cells = [F.struct(F.lit(m).alias("model"), F.lit(v).alias("guideline_version")) for m in models for v in versions]
    grid = documents.select("doc_id", F.explode(F.array(*cells)).alias("c")).select("doc_id", "c.*")
    return grid.join(runs, ["doc_id", "model", "guideline_version"], "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def pending_cells(cells: DataFrame, runs: DataFrame, force: bool = False) -> DataFrame:
    """Cells without a finished run; where both tables tell the guideline version, a run counts for its own version only."""
    if force:
        return cells
    key = ["doc_id", "model", *(["guideline_version"] if "guideline_version" in cells.columns and "guideline_version" in runs.columns else [])]
    return cells.join(runs.where("status = 'ok'").select(*key), key, "left_anti")


def extraction_totals(runs: DataFrame) -> DataFrame:
    """Documents done and facts found per model."""
    ok = F.col("status") == "ok"
    return runs.groupBy("model").agg(F.count_if(ok).alias("docs_ok"), F.count(F.lit(1)).alias("n_runs"),
                                     F.sum(F.when(ok, F.col("fact_count")).otherwise(0)).alias("n_facts"))


def latest_jobs(jobs: DataFrame, limit: int = 30) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit)
