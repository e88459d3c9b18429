"""Review decisions as an append-only log: the state of each pair, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window


def fold(log: DataFrame) -> DataFrame:
    """Last entry of each pair; a reversal puts it back to pending. log: (seq, pair_id, action)."""
    last = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("seq")))
    state = F.when(F.col("action") == "reverse", "pending").otherwise(F.col("action"))
    return log.withColumn("place", last).where("place = 1").select("pair_id", state.alias("state"), F.col("seq").alias("last_seq"))


def summary(log: DataFrame, queue: int) -> DataFrame:
    """Pairs per state, reversals in the log, and what is still pending of a queue (never below 0)."""
    states = fold(log).agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("accept", "reject", "pending")])
    undone = log.agg(F.count_if(F.col("action") == "reverse").alias("reversed")).scalar()
    return states.select("accept", "reject", undone.alias("reversed"), F.greatest(F.lit(queue) - F.col("accept") - F.col("reject"), F.lit(0)).alias("pending"))


def windowed(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; rows later than `late` are dropped when `events` is a stream."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def keep_state(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Fold a stream of log entries: each micro-batch is merged with the state so far, which is a table of its own version."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        known = f"{path}/v{n - 1}"
        new = batch.select("seq", "pair_id", "action")
        if n:
            new = new.unionByName(spark.read.parquet(known))
        last = new.groupBy("pair_id").agg(F.max_by(F.struct("seq", "action"), "seq").alias("x")).select("x.seq", "pair_id", "x.action")
        last.write.mode("overwrite").parquet(f"{path}/v{n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
