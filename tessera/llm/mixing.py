"""Weighted fair queueing over sources, with built-in functions only.

Each source gets a target by weight; its shuffled documents get virtual finish times, cumulative words divided by the
target, over up to two passes; the global order of finish times is cut at the total budget. Running totals are taken in
two levels (slices, then rows of a slice), so neither a source nor the whole corpus has to be sorted in one task: a task
orders one of SLICES slices of a source, and the slice of the time axis in which the budget ends, one of TICKS per unit.
There is one row per source in `targets`, which one task orders.

Defined results: null or empty texts have size 0 and take 0; a null source is a source of its own and comes last; repeated
rows are separate documents; an empty table gives an empty result; other columns are ignored. Reruns give equal results:
the shuffle is a hash of the content, and sums are of integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, table, written

SLICES = 4096
#: Slices of the virtual time axis per unit; the axis is closed at CLOSE units, what lies beyond shares the last slice.
TICKS, CLOSE = 16384, 4
PASSES = 2


def words(text: Column) -> Column:
    """Number of words of a text; null and blank texts have none."""
    full = F.coalesce(text, F.lit(""))
    return F.size(F.filter(F.split(full, f"{SPACE}+"), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size and target from rows (source, size): one row for each source.

    Water filling in closed form. In ascending order of cap / weight, the first k sources are held at their caps and the
    rest share what is left by weight; k is the least for which no further source exceeds its cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank - 1) % len(weights) + 1)
    ranked = per.select("source", "source_size", weight.alias("w"), rank.alias("r"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), "r")
    everything = Window.partitionBy()
    level = ranked.select(
        "source", "source_size", "w",
        (F.sum("source_size").over(everything) * F.lit(share)).alias("budget"),
        (F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(cap)).alias("held"),
        F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("left_w"),
    ).withColumn("rate", (F.col("budget") - F.col("held")) / F.col("left_w"))
    # at the least k that fits, the rate is the one that all uncapped sources get
    fits = level.withColumn("fits", F.col("rate") * F.col("w") <= F.col("source_size") * F.lit(cap))
    final = fits.withColumn("rate", F.min(F.when(F.col("fits"), F.struct("held", "rate"))).over(everything)["rate"])
    full = F.col("source_size") * F.lit(cap)
    return final.select(
        "source", "source_size", F.coalesce(F.least(full, F.col("rate") * F.col("w")), full).cast("double").alias("target")
    )


def _finish_times(docs: DataFrame, goal: DataFrame) -> DataFrame:
    """Each document with `cum`, the words of its source up to and with it in shuffled order."""
    keyed = docs.withColumn("slice", F.pmod(F.shiftright("key", 20), F.lit(SLICES)))
    sums = keyed.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "slice", F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("offset"))
    offsets = offsets.join(
        F.broadcast(goal) if goal.count() <= 100_000 else goal, offsets["source"].eqNullSafe(goal["source"])
    ).drop(goal["source"])
    both = keyed.join(
        offsets, keyed["source"].eqNullSafe(offsets["source"]) & (keyed["slice"] == offsets["slice"])
    ).drop(offsets["source"], offsets["slice"])
    within = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return both.select(
        "doc_id", "source", "key", "size", "source_size", "target",
        (F.sum("size").over(within) + F.col("offset")).alias("cum"),
    )


def _finish(n: int) -> Column:
    """Virtual finish time of a document in pass n."""
    return (F.col("source_size") * F.lit(n) + F.col("cum")) / F.col("target")


def _key() -> Column:
    """Order of the shuffle within a source."""
    return F.xxhash64("doc_id", "text")


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document. docs has doc_id, text and source.

    taken counts the words of all passes in which the document comes before the cut, so it is 0, 1 or 2 times size.
    """
    return _mixed(docs, share, weights).select("doc_id", "size", "source_size", "target", "taken")


def repeated(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it.

    Rows that are equal in doc_id, source and text share a line of the plan; its passes are dealt to them one by one, so
    together they are taken as often as planned.
    """
    plan = _mixed(docs, share, weights).where("size > 0")
    plan = plan.groupBy("doc_id", "source", "key").agg((F.sum("taken") / F.max("size")).cast("int").alias("_times"), F.count(F.lit(1)).alias("_rows"))
    plan = written(plan.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("key").alias("_k"), "_times", "_rows"), "mix-plan")
    same = (F.col("_key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s"))
    joined = docs.withColumn("_key", _key()).join(plan.where("_times > 0"), same)
    once = joined.where("_rows = 1").withColumn("_n", F.col("_times"))
    several = plan.where("_rows > 1 and _times > 0")
    if several.limit(1).count():
        # equal rows are numbered in two levels, by partition and within it, so that very many of them are not one task
        equal = written(joined.where("_rows > 1").withColumn("_part", F.spark_partition_id()), "mix-equal")
        line = ["_k", "_d", "_s"]
        counts = equal.groupBy(*line, "_part").agg(F.count(F.lit(1)).alias("_c"))
        earlier = Window.partitionBy(*line).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select(*[F.col(c).alias(f"{c}2") for c in (*line, "_part")], F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
        on = (F.col("_k") == F.col("_k2")) & (F.col("_part") == F.col("_part2")) & F.col("_d").eqNullSafe(F.col("_d2")) & F.col("_s").eqNullSafe(F.col("_s2"))
        nth = F.row_number().over(Window.partitionBy(*line, "_part").orderBy(F.xxhash64(*docs.columns))) + F.col("_before")
        base = F.floor(F.col("_times") / F.col("_rows"))
        more = (nth <= F.col("_times") - base * F.col("_rows")).cast("int")
        once = once.unionByName(equal.join(counts, on).withColumn("_n", (base + more).cast("int")).select(*once.columns))
    return once.withColumn("_n", F.explode(F.when(F.col("_n") > 0, F.sequence(F.lit(1), F.col("_n"))))).select(*docs.columns)


def _mixed(docs: DataFrame, share: float, weights: tuple[int, ...]) -> DataFrame:
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), _key().alias("key"))
    sized = written(sized, "mix-sizes")
    goal = written(targets(sized, weights, share, float(PASSES)), "mix-targets")
    timed = written(_finish_times(sized, goal), "mix-times")
    passes = F.explode(F.array(*[F.struct(_finish(n).alias("finish"), F.lit(n).alias("pass")) for n in range(PASSES)]))
    items = timed.where("size > 0 and target > 0").select("source", "key", "doc_id", "size", passes.alias("i"))
    items = items.select(
        "size", "i.finish", F.struct(F.col("i.finish"), "source", "key", "doc_id", F.col("i.pass")).alias("at"),
        F.least(F.floor(F.col("i.finish") * TICKS), F.lit(TICKS * CLOSE)).alias("tick"),
    )
    # at most TICKS * CLOSE + 1 rows, whatever the corpus: the slices of the time axis and what lies before each
    ticks = items.groupBy("tick").agg(F.sum("size").alias("tick_size"))
    axis = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
    ticks = ticks.select("tick", "tick_size", F.coalesce(F.sum("tick_size").over(axis), F.lit(0)).alias("before"))
    budget = F.floor(F.lit(share) * goal.agg(F.sum("source_size")).scalar())
    crossing = ticks.where((F.col("before") <= budget) & (F.col("before") + F.col("tick_size") > budget))
    inside = items.join(F.broadcast(crossing), "tick")
    running = F.col("before") + F.sum("size").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    # the first document that no longer fits ends the mix; without one, everything is taken
    cut = inside.select("at", (running > budget).alias("over")).where("over").agg(F.min("at").alias("at")).scalar()
    ends = timed.withColumn("cut", cut)
    taken = F.lit(0).cast("long")
    for n in range(PASSES):
        at = F.struct(_finish(n).alias("finish"), "source", "key", "doc_id", F.lit(n).alias("pass"))
        taken = taken + F.when(F.col("cut").isNull() | (at < F.col("cut")), F.col("size")).otherwise(0)
    return ends.select(
        "doc_id", "source", "key", "size", "source_size", "target",
        F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(0).cast("long").alias("taken"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
