"""Session helpers: reading tables and cutting lineage."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory (a file or a directory of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in ``spark.checkpoint.dir``; where none is set, a temporary one in local mode, on a cluster an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[[^,]*(,\d+)?\])?$", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rollweave-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, so that no later stage recomputes its lineage.

    What Python still holds of the plans so far is let go: the driver keeps their broadcasts and the shuffle files stay as long as it doesn't.
    """
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    del df
    gc.collect()
    return out


def release(spark: SparkSession) -> None:
    """Let the driver drop the plans, broadcasts and shuffle files of finished steps now; Spark's cleaner acts on what the collector finds, which may be late in a query of many steps."""
    gc.collect()
    spark._jvm.System.gc()


def store(df: DataFrame, *done: DataFrame) -> DataFrame:
    """As ``cut``, for large tables: written in compressed columns, then the shuffle files of the step and the files of ``done`` are dropped.

    ``done`` are earlier results of ``store`` that nothing reads any more.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    for old in done:
        drop(old)
    release(spark)
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a result of ``store``; others are left alone."""
    if path := df.__dict__.pop("stored_at", None):
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
