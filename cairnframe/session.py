"""Session settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "cairnframe", master: str | None = None, shared_folder: str | None = None, **conf: str) -> SparkSession:
    """Start (or get) a session with adaptive execution, skew splitting and UTC time.

    ``shared_folder`` holds intermediate tables and is seen by the driver and all
    executors (``spark.checkpoint.dir``); who starts the session removes it.

    Shuffle width is left to adaptive coalescing: the initial number is set
    high by the cluster, and small inputs shrink to few partitions at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a hot join key even where that costs another shuffle.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shared_folder:
        settings["spark.checkpoint.dir"] = shared_folder
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
