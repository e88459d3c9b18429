"""Audit of a corpus, curves and ablation of a resolution, growth of costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import cluster, linkage


def top_names(mentions: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent names with their share of all mentions, ties by name."""
    counts = mentions.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.round(F.col("n") / total, 6)).orderBy(F.desc("n"), "name").limit(n)


def accused_per_case(mentions: DataFrame) -> DataFrame:
    """Histogram of mentions per case."""
    per = mentions.groupBy("case_id").agg(F.count(F.lit(1)).alias("accused"))
    return per.groupBy("accused").agg(F.count(F.lit(1)).alias("cases"))


def trap_pairs(mentions: DataFrame) -> DataFrame:
    """Pairs of different people under one name."""
    per = mentions.groupBy("name").agg(F.count_distinct("identity").alias("k"))
    return per.agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.lit(0)).cast("long").alias("pairs"))


def dyad_recurrence(edge: DataFrame) -> DataFrame:
    """Share of co-accused pairs that are seen in more than one case."""
    return edge.agg(F.round(F.avg((F.col("shared_cases") > 1).cast("double")), 6).alias("share"))


def curve(pairs: DataFrame, records: DataFrame, truth: str, cuts: list[float]) -> list[dict]:
    """Precision, recall and F1 of the clusters at each cut. pairs: (a, b, score, case_a, case_b); records: (id, <truth>)."""
    out = []
    for cut in cuts:
        groups = cluster.with_singletons(records, "id", cluster.agglomerate(pairs, cut)).withColumnRenamed("node", "id")
        out.append({"cut": cut} | cluster.pairwise(groups.join(records, "id"), "cluster", truth).first().asDict())
    return out


def cuts_of(scored: DataFrame, n: int = 40, low: float = 0.9) -> list[float]:
    """n cuts between the `low` quantile and the maximum of the scores."""
    a, b = scored.agg(F.percentile("score", F.lit(low)), F.max("score")).first()
    return [a + (b - a) * i / (n - 1) for i in range(n)] if a is not None else []


def without(levels: DataFrame, weights: dict[str, list[float]], signal: str) -> Column:
    """Score with one signal left out, the model kept as it is."""
    return linkage.score({s: [0.0] * len(w) if s == signal else w for s, w in weights.items()})


def growth_exponent(measured: DataFrame, size: str, cost: str) -> DataFrame:
    """Slope of log cost over log size."""
    return measured.agg(F.round(F.regr_slope(F.log(cost), F.log(size)), 6).alias("exponent"))


def gold_sample(pairs: DataFrame, truth: DataFrame, hard: int = 40_000, easy: int = 10_000, seed: int = 4471) -> DataFrame:
    """All true pairs and bounded samples of false ones: hard ones from the candidate pairs, easy ones from other pairs given.

    pairs: (a, b, stratum) with stratum 'candidate' or 'other'; truth: (a, b). The sample is by hash, so reruns agree.
    """
    labelled = pairs.join(truth.withColumn("label", F.lit(1)), ["a", "b"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    false = labelled.where("label = 0").withColumn("key", F.xxhash64("a", "b", F.lit(seed)))
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("key", "a", "b"))
    most = F.when(F.col("stratum") == "candidate", hard).otherwise(easy)
    kept = false.withColumn("place", place).where(F.col("place") <= most)
    return labelled.where("label = 1").select("a", "b", "label", "stratum").unionByName(kept.select("a", "b", "label", "stratum"))
