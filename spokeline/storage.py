"""Written intermediates for iterative operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession) -> str:
    """A path of its own in the folder of spark.checkpoint.dir (where it is unset, in the warehouse)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/intermediates")
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet to a path of its own and read it back."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
