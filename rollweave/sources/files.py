"""What all file sources share."""

from __future__ import annotations

import logging
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("rollweave")


class ClaimSource(Protocol):
    """A source of claims. It never fails on bad input: what can't be read gives no claims and a warning."""

    def read(self, spark: SparkSession, path: str) -> DataFrame: ...


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that the cluster knows exists."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    if not found:
        log.warning("no such file: %s", path)
    return bool(found)
