"""The ledger of an extraction run: every answer and error is stored per section, a rerun asks only for what is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.extract import anchor_quotes, ask_sections, build_facts, parse_responses, response_problem
from factloom.sources.files import read_table

KEYS = ["guideline_version", "annotator", "doc_id", "section_path"]
CELL = ["guideline_version", "annotator", "doc_id"]
LEDGER = ("guideline_version string, annotator string, doc_id string, section_path string, status string, response string, "
          "error string, attempts int, run int")


def latest_answers(ledger: DataFrame) -> DataFrame:
    """The last record of every section. A good answer is never asked again, unless forced, so the last one counts."""
    rest = [c for c in ledger.columns if c not in KEYS]
    newest = ledger.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), "run").alias("_r"))
    return newest.select(*KEYS, "_r.*")


def pending(sections: DataFrame, ledger: DataFrame) -> DataFrame:
    """Sections without a good answer; only keys of the ledger are read. Null keys count as equal."""
    done = ledger.groupBy(*KEYS).agg(F.max_by("status", "run").alias("_status")).where("_status = 'ok'")
    a, b = sections.alias("a"), done.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in KEYS]
    return a.join(b, same, "left_anti")


def run_extraction(sections: DataFrame, ask: Callable[[str], str], path: str, run: int, prompt: Column | None = None,
                   attempts: int = 2, force: bool = False) -> DataFrame:
    """Ask for the missing sections (all, with ``force``), store what came back, return the ledger.

    ``sections`` has the columns of ``KEYS``, ``base_offset`` and ``text``. The records of a run are one partition that
    is replaced as a whole and a run sees earlier runs only, so repeating one that was cut off leaves no record twice.
    A record is ``ok``, ``error`` (no answer; the last error is kept) or ``invalid`` (an answer that cannot be used,
    with the reason). Answers are asked for once, written, and read from there.
    """
    spark = sections.sparkSession
    before = read_table(spark, path, LEDGER).where(F.col("run") < run)
    wanted = sections if force else pending(sections, before)
    problem = response_problem("response")
    answers = ask_sections(wanted, ask, prompt, attempts).withColumn("_why", F.when(F.col("error").isNull(), problem))
    answers.select(
        *KEYS, F.when(F.col("error").isNotNull(), "error").when(F.col("_why") != "", "invalid").otherwise("ok").alias("status"), "response",
        F.coalesce("error", F.nullif("_why", F.lit(""))).alias("error"), "attempts").write.mode("overwrite").parquet(f"{path}/run={run}")
    return read_table(spark, path, LEDGER).where(F.col("run") <= run)


def cells(ledger: DataFrame) -> DataFrame:
    """One row per annotator and document: ``ok`` when every section is, counts, the last run and the least error in text order."""
    good = F.col("status") == "ok"
    return latest_answers(ledger).groupBy(*CELL).agg(
        F.when(F.every(good), "ok").otherwise("error").alias("status"), F.count(F.lit(1)).alias("n_sections"), F.count_if(good).alias("n_ok"),
        F.max("run").alias("last_run"), F.min("error").alias("error"))


def facts_of(ledger: DataFrame, sections: DataFrame) -> DataFrame:
    """Facts of all good answers, anchored in their sections."""
    good = latest_answers(ledger).where("status = 'ok'").select(*KEYS, "response")
    a, b = sections.alias("a"), good.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in KEYS]
    rows = a.join(b, same).select(*[f"a.{k}" for k in KEYS], "a.base_offset", F.col("a.text").alias("section_text"), "b.response")
    return build_facts(anchor_quotes(parse_responses(rows)))
