"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale-factor folder, whole."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    It is the one named by the session in ``spark.checkpoint.dir``. Only where that is unset in a
    local session, where driver and executors are one process, a temporary folder is made; a cluster
    without the setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="siltstone-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold at most ``rows`` rows: whole texts are large, and two copies of a batch are in memory at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column):
    return F.coalesce(column.cast("string"), F.lit(""))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows whose number in the table, as ``monotonically_increasing_id`` gives it, is in ``gone`` (row)."""
    name = "row"
    while name in docs.columns:
        name += "_"
    numbered = docs.withColumn(name, F.monotonically_increasing_id())
    return numbered.join(gone.select(F.col("row").alias(name)), name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
