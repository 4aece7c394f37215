"""Settings that suit the library's plans."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive plans split crowded join partitions and merge small ones; texts come to Python in bounded batches.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(app: str = "rillstone", checkpoint_dir: str | None = None, **settings: object) -> SparkSession:
    """A session with these settings; on a cluster `checkpoint_dir` names a folder that all executors share."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **({"spark.checkpoint.dir": checkpoint_dir} if checkpoint_dir else {}), **settings}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()
