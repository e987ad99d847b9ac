"""The folder that all executors share, and tables cut from their lineage there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """spark.checkpoint.dir of the session; one of our own only where it is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        import tempfile

        base = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """df as a written table: computed once, whoever reads it, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
