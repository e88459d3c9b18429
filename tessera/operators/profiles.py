"""Profiles of identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.schema import guard

FIELDS = [
    "identity", "records", "cases", "names", "districts", "stations", "top_head", "top_head_share", "first_day", "last_day",
    "active_days", "apparent_people", "largest_fragment", "neighbours",
]
guard(FIELDS, "profiles")


def _ranked(df: DataFrame, key: str, name: str) -> DataFrame:
    """(identity, array of (value, n)), most frequent first, the smallest one of equals."""
    counted = df.where(F.col(key).isNotNull()).groupBy("identity", key).agg(F.count_distinct("case_id").alias("n"))
    entry = F.struct((-F.col("n")).alias("m"), F.col(key).cast("string").alias("value"))
    rows = counted.groupBy("identity").agg(F.array_sort(F.collect_list(entry)).alias("r"))
    return rows.select("identity", F.transform("r", lambda x: F.struct(x["value"].alias("value"), (-x["m"]).alias("n"))).alias(name))


def core(seen: DataFrame, parts: int) -> DataFrame:
    """What `build` says of numbers, days and kinds of offence, unordered, without names or lists.

    seen: (mention, case_id, identity, day, head); it is dealt once by identity, to `parts` tasks.
    """
    seen = seen.where("identity is not null").repartition(parts, "identity")
    base = seen.groupBy("identity").agg(
        F.count_distinct("mention").alias("records"), F.count_distinct("case_id").alias("cases"), F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    ).withColumn("active_days", F.datediff("last_day", "first_day"))
    heads = seen.groupBy("identity", F.coalesce("head", F.lit("unknown")).alias("top_head")).agg(F.count_distinct("case_id").alias("n"))
    top = heads.groupBy("identity").agg(F.min(F.struct((-F.col("n")).alias("m"), "top_head")).alias("top"))
    return base.join(top, "identity").select(*base.columns, "top.top_head", F.round(-F.col("top.m") / F.col("cases"), 4).alias("top_head_share"))


def build(mentions: DataFrame, cases: DataFrame, edge: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """One row per identity. mentions: (mention, case_id, identity, name); cases: (case_id, day, district, unit, head)."""
    joined = mentions.join(cases, "case_id")
    base = joined.groupBy("identity").agg(
        F.count_distinct("mention").alias("records"), F.count_distinct("case_id").alias("cases"), F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    ).withColumn("active_days", F.datediff("last_day", "first_day"))
    names = joined.groupBy("identity", "name").agg(F.count_distinct("mention").alias("n"))
    fragments = names.groupBy("identity").agg(F.count(F.lit(1)).alias("apparent_people"), F.max("n").alias("largest_fragment"))
    heads = joined.groupBy("identity", F.coalesce("head", F.lit("unknown")).alias("top_head")).agg(F.count_distinct("case_id").alias("n"))
    place = F.row_number().over(Window.partitionBy("identity").orderBy(F.desc("n"), "top_head"))
    top = heads.withColumn("place", place).where("place = 1").select("identity", "top_head", F.col("n").alias("_n"))
    out = base.join(fragments, "identity").join(top, "identity").withColumn("top_head_share", F.round(F.col("_n") / F.col("cases"), 4)).drop("_n")
    for key, name in (("name", "names"), ("district", "districts"), ("unit", "stations")):
        out = out.join(_ranked(joined, key, name), "identity", "left")
    if edge is not None:
        both = edge.select("a", "b", "shared_cases").union(edge.select("b", "a", "shared_cases"))
        near = both.groupBy(F.col("a").alias("identity")).agg(F.array_sort(F.collect_list(F.struct((-F.col("shared_cases")).alias("m"), "b"))).alias("r"))
        near = near.select("identity", F.transform("r", lambda x: F.struct(x["b"].alias("identity"), (-x["m"]).alias("shared_cases"))).alias("neighbours"))
        out = out.join(near, "identity", "left")
    out = out.orderBy(F.desc("cases"), "identity")
    return out.limit(limit) if limit else out


def report(profiles: DataFrame) -> DataFrame:
    return profiles.agg(
        F.count(F.lit(1)).alias("identities"), F.max("cases").alias("most_cases"), F.max("apparent_people").alias("most_names"),
        F.sum((F.col("cases") > 1).cast("long")).alias("repeat"), F.sum((F.size("districts") > 1).cast("long")).alias("travelling"),
    )
