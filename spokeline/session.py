"""Session helpers shared by tests, bench and the entry module."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def local_session(cpus: int = 8, memory: str = "8g", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings that the tests and the bench share."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("spokeline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))  # one machine, so its own folder is shared
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return let_workers_import(spark)


def let_workers_import(spark: SparkSession) -> SparkSession:
    """Put the repository on the Python path of the workers that this session starts."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([*paths, ROOT])
    return spark
