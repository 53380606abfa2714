"""Session defaults and the checkpoint location used to cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "factloom", cores: str = "8", shuffle_partitions: int = 8,
                  driver_memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``.

    A machine-local folder is only acceptable when everything runs on this
    machine, so outside local mode a missing setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint: survives executor loss, keeps plans short."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_dealt(df: DataFrame) -> DataFrame:
    """``checkpoint`` of rows dealt out by a key; readers still know by which.

    An adaptive plan does not tell how its rows are dealt, so it is left out while these rows, which need none of its
    choices, are written.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    adaptive = conf.get(name)
    conf.set(name, "false")
    try:
        return checkpoint(df)
    finally:
        conf.set(name, adaptive)
