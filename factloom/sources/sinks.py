"""Writers: partitioned tables, latest-wins logs, cascade delete, exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.reviews import latest

DOCUMENT_TABLES = ("documents", "facts", "pairs", "entity_clusters", "graph_nodes", "graph_edges", "reviews", "verifications")
VERSION_SPREAD = 32  # tasks that write one version at most


def write_by_version(df: DataFrame, path: str) -> None:
    """Replace only the guideline versions present in ``df``.

    Rows are clustered by version and a spread of documents, so a version that
    holds most rows is written by many tasks.
    """
    parts = F.pmod(F.xxhash64("doc_id"), F.lit(VERSION_SPREAD)) if "doc_id" in df.columns else F.lit(0)
    df.repartition("guideline_version", parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "guideline_version").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def compact_log(log: DataFrame, keys: list[str], path: str) -> None:
    """Rewrite a log as its latest records, into a new folder."""
    latest(log, keys).write.mode("errorifexists").parquet(path)


def write_fact_files(facts: DataFrame, path: str) -> None:
    """Facts as JSON lines under version, model directory and document."""
    from factloom.functions.text import model_directory
    (facts.withColumn("model_dir", model_directory("annotator"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("guideline_version", "model_dir").json(path))


def write_export(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV with a header, quotes only where needed and doubled inside; or JSON lines."""
    writer = rows.write.mode("errorifexists")
    if fmt == "json":
        writer.json(path)
    else:
        writer.option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def drop_document(spark: SparkSession, warehouse: str, target: str, doc_id: str) -> dict[str, int]:
    """Copy every stored table without one document; returns removed rows per table."""
    removed = {}
    for name in DOCUMENT_TABLES:
        try:
            table = spark.read.parquet(f"{warehouse}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            continue  # a table never written has nothing to drop
        removed[name] = table.where(F.col("doc_id") == doc_id).count()
        writer = table.where(F.col("doc_id") != doc_id).write.mode("errorifexists")
        if "guideline_version" in table.columns:
            writer = writer.partitionBy("guideline_version")
        writer.parquet(f"{target}/{name}")
    return removed
