"""Calibration of scores and routing of pairs."""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUTES = ["auto", "review", "reject"]


def isotonic(scored: DataFrame, value: str, label: str, weight: str | None = None) -> DataFrame:
    """Add `probability`, a monotone step fit of the label on the value; beyond the fitted range the end values hold.

    weight: column with the number of pairs that a row stands for, one each without it.
    """
    rows = scored.withColumn("_label", F.col(label).cast("double"))
    named = {"weightCol": weight} if weight else {}
    model = IsotonicRegression(featuresCol=value, labelCol="_label", predictionCol="probability", **named).fit(rows)
    return model.transform(rows).drop("_label")


def route(p: Column, auto: float = 0.92, review: float = 0.65) -> Column:
    """0 auto, 1 review, 2 reject."""
    return F.when(p >= auto, 0).when(p >= review, 1).otherwise(2)


def routing_report(routed: DataFrame, route_col: str, label: str) -> DataFrame:
    """Pairs and false merges per route."""
    return routed.groupBy(route_col).agg(
        F.count(F.lit(1)).alias("pairs"), F.sum(F.lit(1) - F.col(label)).cast("long").alias("false_merges"),
        F.round(F.avg(F.lit(1.0) - F.col(label)), 6).alias("false_rate"),
    )


def reliability(rows: DataFrame, value: str, label: str, bins: int = 10) -> DataFrame:
    """Mean value and label per bin between exact quantiles of the value; the last bin is closed, empty bins are left out."""
    cuts = rows.select(F.percentile(value, F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("e")).first()["e"]
    inner = F.array(*[F.lit(float(x)) for x in cuts[1:-1]])
    nth = F.size(F.filter(inner, lambda e: F.col(value) >= e))
    return rows.groupBy(nth.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean_value"), F.round(F.avg(label), 6).alias("mean_label")
    )
