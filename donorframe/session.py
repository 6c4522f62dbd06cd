"""A session with settings that suit the operators."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "donorframe", **conf: str) -> SparkSession:
    """The running session, or a new one: adaptive execution with skew handling, UTC, Arrow batches of bounded size."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    } | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()
