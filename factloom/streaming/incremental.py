"""Incremental pick-up of new fact files: each micro-batch re-runs the documents it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from factloom import schema as S
from factloom.operators.align import SCOPE


def touched_documents(batch: DataFrame) -> DataFrame:
    return batch.select(*SCOPE).distinct()


def follow_facts(spark: SparkSession, path: str, checkpoint_path: str, publish: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Watch a folder of stored facts (Parquet); process what is there, then stop.

    For every batch all facts of its documents are read again, so a document whose
    annotators arrive in different batches is always recomputed whole. ``publish``
    receives those facts and the batch number; writing by version and document makes
    a repeated batch harmless.
    """
    stream = spark.readStream.schema(S.FACT_FIELDS + ", fact_pos int").parquet(path)

    def handle(batch: DataFrame, number: int) -> None:
        everything = batch.sparkSession.read.schema(S.FACT_FIELDS + ", fact_pos int").parquet(path)
        publish(everything.join(touched_documents(batch), SCOPE, "left_semi"), number)

    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_path)
            .trigger(availableNow=True).start())
