"""Session settings the reports are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even where that costs one more shuffle further up
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # the JVM never compiles a method above this size; wide reports then run as smaller ones
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


#: To set when the session is made: checkpoints go when nothing refers to them any more.
CLUSTER_SETTINGS = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session; sizes and the shuffle width stay the cluster's own."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark
