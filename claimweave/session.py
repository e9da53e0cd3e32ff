"""Session builder for local runs; on a cluster the submitted session is used as is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def spark_session(app: str = "claimweave", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library expects.

    Nothing in the operators depends on these values: partition counts, broadcast
    limits and skew handling all come from the running session.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
