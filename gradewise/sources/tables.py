"""Parquet table loading for the driver's test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-spread a scan that yields fewer splits than the session's
    parallelism (an unsplittable single-row-group file would otherwise run
    the whole pre-shuffle pipeline in one task).  A no-op at cluster scale,
    where a scan already has many more splits than cores."""
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() >= target:
            return df
    except Exception:  # noqa: BLE001 - e.g. no RDD access: leave as is
        return df
    return df.repartition(target, *cols)
