"""Count / sum / sum-of-squares aggregates that merge by addition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CMV = ("cnt", "total", "total_2", "empty")


def accumulate(value: Column | str) -> list[Column]:
    """Aggregates of raw measurements."""
    x = F.col(value) if isinstance(value, str) else value
    return [
        F.count(x).cast("bigint").alias("cnt"),
        F.coalesce(F.sum(x), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(x * x), F.lit(0.0)).alias("total_2"),
    ]


def merge() -> list[Column]:
    """Aggregates that add partial CMV rows."""
    return [
        F.sum("cnt").cast("bigint").alias("cnt"),
        F.sum("total").alias("total"),
        F.sum("total_2").alias("total_2"),
        F.sum("empty").cast("bigint").alias("empty"),
    ]


def merge_windows() -> list[Column]:
    """Aggregates that add window totals; a window without rows counts as empty."""
    filled = F.col("cnt") > 0
    return [
        F.sum(F.when(filled, F.col("cnt")).otherwise(0)).cast("bigint").alias("cnt"),
        F.sum(F.when(filled, F.col("total")).otherwise(0.0)).alias("total"),
        F.sum(F.when(filled, F.col("total_2")).otherwise(0.0)).alias("total_2"),
        F.sum(F.when(filled, 0).otherwise(1)).cast("bigint").alias("empty"),
    ]


def avg(cnt: str = "cnt", total: str = "total") -> Column:
    return F.when(F.col(cnt) == 0, F.lit(0.0)).otherwise(F.col(total) / F.col(cnt))


def avg2(cnt: str = "cnt", total_2: str = "total_2") -> Column:
    return F.when(F.col(cnt) == 0, F.lit(0.0)).otherwise(F.col(total_2) / F.col(cnt))


def variance(cnt: str = "cnt", total: str = "total", total_2: str = "total_2") -> Column:
    """Population variance from partial sums."""
    return avg2(cnt, total_2) - avg(cnt, total) * avg(cnt, total)


def scv(cnt: str = "cnt", total: str = "total", total_2: str = "total_2") -> Column:
    """Squared coefficient of variation; NaN when the mean is 0 and rows exist."""
    mean = avg(cnt, total)
    return (
        F.when(F.col(cnt) == 0, F.lit(0.0))
        .when(mean == 0, F.lit(float("nan")))
        .otherwise(avg2(cnt, total_2) / (mean * mean) - 1.0)
    )


def long_string() -> Column:
    """Report text with count, sum, mean, variance, scv and empty windows."""
    return F.format_string(
        "Count: %d, sum: %.2f, avg: %.5f, var: %.5f, scv: %.5f, empEn: %d",
        "cnt", "total", avg(), variance(), scv(), "empty",
    )


def short_string() -> Column:
    return F.format_string("cnt:%d,avg:%.2f,scv:%.2f", "cnt", avg(), scv())
