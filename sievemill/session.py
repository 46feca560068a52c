"""Session factory with the settings the engine is tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "sievemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, UTC and Arrow batches bounded by rows; ``conf`` overrides any setting.

    On a cluster ``master`` comes from spark-submit, so nothing here pins executors or memory.
    """
    builder = SparkSession.builder.appName(app)
    if master or os.environ.get("SIEVEMILL_MASTER"):
        builder = builder.master(master or os.environ["SIEVEMILL_MASTER"])
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
