"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str, kind: str = "tables") -> str:
    """A new folder below ``spark.checkpoint.dir``, shared by all executors. Where that is unset, a local one, and only for a session
    on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: this needs a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tidewatch-")
    return f"{root.rstrip('/')}/{kind}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table of the shared folder: lineage ends there, and nothing before it is computed again."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
