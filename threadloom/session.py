"""Session settings that the library recommends; every function takes any session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("threadloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def arrow_batch_records(mean_length: float, cpus: int) -> int:
    """Rows of an Arrow batch for Python extractors, by the texts' mean length and the cores: 10 to 2000.

    Set it as ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    base = next((n for bound, n in ((100, 1000), (500, 500), (2000, 200), (5000, 100)) if mean_length < bound), 50)
    return max(10, min(2000, base * max(1, cpus // 4)))
