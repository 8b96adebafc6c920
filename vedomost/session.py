"""Session helpers: table loading, lineage cuts and sizing."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

_OWN_CHECKPOINT_DIR: str | None = None


def build_session(app: str = "vedomost", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # call sites of every column cost seconds on wide plans
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` names the folder that all executors of a cluster share. A local
    temporary folder is set only where the setting is missing and the master is local.
    """
    global _OWN_CHECKPOINT_DIR
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
    if _OWN_CHECKPOINT_DIR is None or not os.path.isdir(_OWN_CHECKPOINT_DIR):
        _OWN_CHECKPOINT_DIR = tempfile.mkdtemp(prefix="vedomost-checkpoint-")
    spark.sparkContext.setCheckpointDir(_OWN_CHECKPOINT_DIR)
    return _OWN_CHECKPOINT_DIR


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` in as many partitions as shuffles are set to, for few rows that are dear to compute; adaptive execution would put them into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def small(df: DataFrame, most_rows: int = 300_000) -> DataFrame:
    """``df``, which is materialised, marked for broadcast if it has at most ``most_rows`` narrow rows; otherwise joins shuffle it."""
    return broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
