"""Feeds for a console: evidence of pairs under review, identities with their spellings, and a fingerprint of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import script

from . import linkage


def review_pairs(scored: DataFrame, weights: dict[str, list[float]], members: DataFrame, low: float = 0.65, high: float = 0.92, most: int = 300) -> DataFrame:
    """Pairs in the review band, likeliest first, with each signal's weight and whether their identities share a case.

    scored: (a, b, probability, <signals>); members: (id, identity, case_id).
    """
    evidence = F.array(*[F.struct(F.lit(s).alias("signal"), c.alias("weight")) for s, c in linkage.contributions(weights).items()])
    band = scored.where((F.col("probability") >= low) & (F.col("probability") < high))
    top = band.select("a", "b", "probability", evidence.alias("evidence")).orderBy(F.desc("probability"), "a", "b").limit(most)
    cases = members.groupBy("identity").agg(F.collect_set("case_id").alias("cases"))
    side = members.select("id", "identity").join(cases, "identity").select("id", "identity", "cases")
    x = side.select(F.col("id").alias("a"), F.col("identity").alias("ia"), F.col("cases").alias("ca"))
    y = side.select(F.col("id").alias("b"), F.col("identity").alias("ib"), F.col("cases").alias("cb"))
    joined = top.join(x, "a").join(y, "b")
    conflict = (F.col("ia") != F.col("ib")) & F.arrays_overlap("ca", "cb")
    return joined.select("a", "b", "probability", "evidence", conflict.alias("conflict")).orderBy(F.desc("conflict"), F.desc("probability"), "a", "b")


def identities(mentions: DataFrame, scored: DataFrame | None = None, most: int = 200) -> DataFrame:
    """Identities with most records: spellings, scripts and, with scored pairs (a, b, probability), their merge confidence."""
    base = mentions.groupBy("identity").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("case_id").alias("cases"),
        F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.collect_set(script(F.col("name")))).alias("scripts"),
    )
    out = base.orderBy(F.desc("records"), "identity").limit(most)
    if scored is not None:
        of = mentions.select(F.col("mention"), "identity")
        inner = scored.join(of.withColumnRenamed("mention", "a"), "a").join(of.select(F.col("mention").alias("b"), F.col("identity").alias("other")), "b").where("identity = other")
        out = out.join(inner.groupBy("identity").agg(F.avg("probability").alias("mean_confidence"), F.min("probability").alias("min_confidence")), "identity", "left")
    return out.orderBy(F.desc("records"), "identity")


def subgraph(edge: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends among the chosen identities."""
    ids = chosen.select("identity")
    return edge.join(ids.withColumnRenamed("identity", "a"), "a", "left_semi").join(ids.withColumnRenamed("identity", "b"), "b", "left_semi")


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free digest of a result: rows, and the sum of their hashes as hexadecimal SHA-256."""
    per = F.xxhash64(*df.columns).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.sum(per).cast("string")), 256).alias("digest"))
