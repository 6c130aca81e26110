"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def configure(builder: SparkSession.Builder, cores: int) -> SparkSession.Builder:
    """Settings by cluster size; anything the cluster names itself may override them.

    Adaptive execution merges small shuffle partitions, broadcasts sides that turn
    out small and splits heavy join keys, so the partition count only has to be
    large enough. Times are written as UTC text, hence the session zone.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(max(8, cores if cores <= 16 else 3 * cores)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.files.maxPartitionBytes": "128m",
        # Keep hash aggregation of text (listagg) longer before it sorts.
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder
