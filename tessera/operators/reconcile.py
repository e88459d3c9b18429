"""Counts of offences reconciled across a change of code books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Old number, new number, offence, head.
CODES = [
    ("302", "103", "Murder", "Body"),
    ("304", "105", "Culpable homicide not amounting to murder", "Body"),
    ("307", "109", "Attempt to murder", "Body"),
    ("323", "115", "Voluntarily causing hurt", "Body"),
    ("324", "118", "Hurt by dangerous weapon", "Body"),
    ("341", "126", "Wrongful restraint", "Body"),
    ("354", "74", "Assault on a woman with intent to outrage modesty", "Women"),
    ("379", "303", "Theft", "Property"),
    ("380", "305", "Theft in a dwelling house", "Property"),
    ("392", "309", "Robbery", "Property"),
    ("395", "310", "Dacoity", "Property"),
    ("411", "317", "Dishonestly receiving stolen property", "Property"),
    ("427", "324", "Mischief causing damage", "Property"),
    ("457", "331", "Lurking house trespass by night", "Property"),
    ("420", "318", "Cheating and dishonestly inducing delivery", "Economic"),
    ("506", "351", "Criminal intimidation", "Public order"),
    ("143", "189", "Unlawful assembly", "Public order"),
    ("147", "191", "Rioting", "Public order"),
]
#: Day from which the new code holds, in the star-schema adapter; a corpus of cases passes its own.
SWITCH = "1998-01-01"


def code_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CODES, "old_no string, new_no string, offence string, head string")


def equivalents(codes: DataFrame) -> DataFrame:
    """(code, other): each number with itself and its counterparts in both directions; not transitive."""
    both = codes.select(F.col("old_no").alias("code"), F.explode(F.array("old_no", "new_no")).alias("other"))
    back = codes.select(F.col("new_no").alias("code"), F.explode(F.array("old_no", "new_no")).alias("other"))
    return both.union(back).distinct()


def ambiguous(codes: DataFrame) -> DataFrame:
    """Numbers that both code books use, for different offences."""
    new = codes.select(F.col("new_no").alias("number"), F.col("offence").alias("new_offence"))
    old = codes.select(F.col("old_no").alias("number"), F.col("offence").alias("old_offence"))
    return old.join(new, "number").select("number", "old_offence", "new_offence")


def counts(case_codes: DataFrame, codes: DataFrame, first: str, last: str, switch: str) -> DataFrame:
    """Per offence: naive, wrong, reconciled and missed cases, error and undercount.

    case_codes has rows (case_id, day, act, number), act being 'old' or 'new'. naive counts cases that carry the old number
    under whatever act; wrong are those of them whose act in force does not give the offence; reconciled are the cases with
    the old code before the switch or the new one from it on.
    """
    inside = case_codes.where(F.col("day").between(first, last))
    per = F.broadcast(codes)
    hit = inside.join(per, (inside["number"] == per["old_no"]) | (inside["number"] == per["new_no"]))
    in_force = F.when(F.col("day") < F.lit(switch), (F.col("act") == "old") & (F.col("number") == F.col("old_no"))).otherwise(
        (F.col("act") == "new") & (F.col("number") == F.col("new_no"))
    )
    flags = hit.groupBy("old_no", "case_id").agg(
        F.max((F.col("number") == F.col("old_no")).cast("int")).alias("naive"), F.max(in_force.cast("int")).alias("good")
    )
    out = flags.groupBy("old_no").agg(
        F.sum("naive").alias("naive"), F.sum("good").alias("reconciled"),
        F.sum(F.when((F.col("naive") == 1) & (F.col("good") == 0), 1).otherwise(0)).alias("wrong"),
    )
    full = per.join(out, "old_no", "left").select(
        "old_no", "new_no", "offence", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("naive", "wrong", "reconciled")]
    )
    missed = F.greatest(F.col("reconciled") - F.col("naive") + F.col("wrong"), F.lit(0))
    return full.withColumn("missed", missed.cast("long")).withColumn(
        "undercount_pct", F.round(F.coalesce(F.try_divide(F.col("missed") * 100.0, F.col("reconciled")), F.lit(0.0)), 4)
    )
