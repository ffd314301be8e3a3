"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Values for a cluster; shuffle partitions follow the data by adaptive coalescing.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def session(app: str = "sedimenta", **conf: str) -> SparkSession:
    """The active session, or a new one with DEFAULTS and conf."""
    builder = SparkSession.builder.appName(app)
    for k, v in (DEFAULTS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
