"""Standard scaling fitted on train rows only.

Population standard deviation (``stddev_pop``) and divisor 1 for a constant
column, as the reference's scaler does; Spark ML's StandardScaler uses the
sample deviation, so the statistics are computed here in one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_standard(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """One pass: mean and population std of every column (a 2k-value row)."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
    row = train.agg(*aggs).first()
    stats = {}
    for c in cols:
        mean = row[f"m_{c}"] or 0.0
        std = row[f"s_{c}"]
        stats[c] = (float(mean), float(std) if std else 1.0)
    return stats


def scaled(col: str, stats: dict[str, tuple[float, float]]) -> Column:
    mean, std = stats[col]
    return (F.col(col).cast("double") - F.lit(mean)) / F.lit(std)


def apply_standard(df: DataFrame, stats: dict[str, tuple[float, float]], digits: int | None = None) -> DataFrame:
    cols = {}
    for c in stats:
        e = scaled(c, stats)
        cols[c] = F.round(e, digits) if digits is not None else e
    return df.withColumns(cols)


def standard_scale(df: DataFrame, cols: list[str], train_filter: Column | None = None,
                   digits: int | None = None) -> DataFrame:
    train = df.filter(train_filter) if train_filter is not None else df
    return apply_standard(df, fit_standard(train, cols), digits)
