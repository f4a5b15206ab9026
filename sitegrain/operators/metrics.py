"""Latency summaries and comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latency(samples: DataFrame, key: str, value: str) -> DataFrame:
    """(key, samples, median, p95, least, most), percentiles by nearest rank."""
    return samples.filter(F.col(value).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("samples"),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("median"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
    )


def paired_overhead(one: DataFrame, two: DataFrame, pair: str, value: str) -> DataFrame:
    """(pair, overhead): the second measurement of each pair less the first."""
    a = one.select(pair, F.col(value).alias("first"))
    return a.join(two.select(pair, F.col(value).alias("second")), pair).select(pair, (F.col("second") - F.col("first")).alias("overhead"))


def regressions(current: DataFrame, baseline: DataFrame, tolerance: float = 0.1, explained: tuple[str, ...] = ()) -> DataFrame:
    """Metrics (metric, value) worse than the baseline by more than the tolerance."""
    both = current.join(F.broadcast(baseline.select("metric", F.col("value").alias("before"))), "metric")
    worse = both.filter(F.col("value") > F.col("before") * (1 + tolerance))
    return worse.select("metric", "before", "value", F.col("metric").isin(list(explained)).alias("explained")) if explained else worse.select("metric", "before", "value", F.lit(False).alias("explained"))
