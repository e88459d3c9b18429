"""Jurisdiction filters and search over feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def in_district(mentions: DataFrame, cases: DataFrame, edge: DataFrame, district: int) -> dict[str, DataFrame]:
    """Feeds of one district: its identities with their cases there, edges with both ends in it, edges that the border cuts."""
    here = cases.where(F.col("district") == district)
    own = mentions.join(here.select("case_id"), "case_id", "left_semi")
    identities = own.groupBy("identity").agg(F.count_distinct("case_id").alias("cases"))
    ids = identities.select("identity")
    with_a = edge.join(ids.withColumnRenamed("identity", "a"), "a", "left_semi")
    inside = with_a.join(ids.withColumnRenamed("identity", "b"), "b", "left_semi")
    either = edge.join(ids.withColumnRenamed("identity", "b"), "b", "left_semi").select("a", "b").union(with_a.select("a", "b")).distinct()
    return {"identities": identities, "edges": inside, "cut": either.join(inside, ["a", "b"], "left_anti")}


def search(mentions: DataFrame, numbers: DataFrame, text: str, most: int = 8) -> DataFrame:
    """Identities with a rendering or case number that contains the text: names first, one hit each, at most `most`."""
    needle = text.strip().lower()
    if len(needle) < 2:
        return mentions.select("identity", F.col("name").alias("found"), F.lit(0).alias("kind")).limit(0)
    names = mentions.where(F.lower("name").contains(needle)).select("identity", F.col("name").alias("found"), F.lit(0).alias("kind"))
    cases = mentions.join(numbers.where(F.lower("number").contains(needle)), "case_id").select("identity", F.col("number").alias("found"), F.lit(1).alias("kind"))
    place = F.row_number().over(Window.partitionBy("identity").orderBy("kind", "found"))
    hits = names.union(cases).withColumn("place", place).where("place = 1").drop("place")
    return hits.orderBy("kind", "found", "identity").limit(most)
