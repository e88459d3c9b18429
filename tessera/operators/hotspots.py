"""Grid and district density, monthly trends and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.measures import cell

BEFORE = 12


def repeaters(mentions: DataFrame) -> DataFrame:
    """Identities of more than one mention row."""
    return mentions.groupBy("identity").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("identity", F.lit(True).alias("repeats"))


def _density(joined: DataFrame, *keys: str) -> DataFrame:
    return joined.groupBy(*keys).agg(
        F.count_distinct("case_id").alias("cases"), F.count_distinct("identity").alias("offenders"),
        F.count_distinct(F.when(F.col("repeats"), F.col("identity"))).alias("repeat_offenders"), F.count_distinct("name").alias("raw_names"),
    ).withColumn("cases_per_offender", F.round(F.col("cases") / F.col("offenders"), 3))


def _joined(mentions: DataFrame, cases: DataFrame) -> DataFrame:
    return mentions.join(cases, "case_id").join(repeaters(mentions), "identity", "left")


def grid(mentions: DataFrame, cases: DataFrame, head: str | None = None) -> DataFrame:
    """Per cell of 0.25 degrees: cases, people, repeat offenders, names. Cases without numeric coordinates are left out."""
    picked = cases.where(F.col("head") == head) if head else cases
    at = picked.select("case_id", cell(F.expr("try_cast(lat AS DOUBLE)")).alias("cell_lat"), cell(F.expr("try_cast(lon AS DOUBLE)")).alias("cell_lon"))
    return _density(_joined(mentions, at.where("cell_lat is not null and cell_lon is not null")), "cell_lat", "cell_lon")


def districts(mentions: DataFrame, cases: DataFrame) -> DataFrame:
    """As `grid`, per district, with the head of most mention rows (the smallest one of equals)."""
    joined = _joined(mentions, cases.select("case_id", "district", "head"))
    heads = joined.groupBy("district", F.coalesce("head", F.lit("unknown")).alias("top_head")).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("district").orderBy(F.desc("n"), "top_head"))
    top = heads.withColumn("place", place).where("place = 1").select("district", "top_head")
    return _density(joined, "district").join(top, "district")


def trends(cases: DataFrame, least: int = 5, factor: float = 2.0) -> DataFrame:
    """Cases per district and month, with the median of the twelve months before and whether the month stands out.

    The calendar is all months seen anywhere, so a district without cases in a month counts zero.
    """
    month = F.date_format("day", "yyyy-MM").alias("month")
    counts = cases.groupBy("district", month).agg(F.count_distinct("case_id").alias("n"))
    calendar = counts.select("month").distinct().join(F.broadcast(counts.select("district").distinct()))
    dense = calendar.join(counts, ["district", "month"], "left").select("district", "month", F.coalesce("n", F.lit(0)).alias("cases"))
    frame = Window.partitionBy("district").orderBy("month").rowsBetween(-BEFORE, -1)
    out = dense.withColumn("median", F.round(F.percentile("cases", F.lit(0.5)).over(frame), 2)).withColumn("seen", F.count(F.lit(1)).over(frame))
    flag = (F.col("seen") == BEFORE) & (F.col("cases") >= least) & (F.col("median") > 0) & (F.col("cases") >= F.col("median") * factor)
    return out.select("district", "month", "cases", "median", F.coalesce(flag, F.lit(False)).alias("anomaly"))


def totals(density: DataFrame) -> DataFrame:
    """Sums over cells and by how much raw names exceed people, in percent."""
    return density.agg(F.sum("cases").alias("cases"), F.sum("offenders").alias("offenders"), F.sum("raw_names").alias("raw_names")).withColumn(
        "inflation_pct", F.round((F.col("raw_names") / F.col("offenders") - 1) * 100, 2)
    )


def densest(cells: DataFrame, n: int = 20) -> DataFrame:
    """The n cells of most cases."""
    return cells.orderBy(F.desc("cases"), "cell_lat", "cell_lon").limit(n)
