"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and \x09-\x0D. Everything else belongs to a word.
SPACE = "[\\x20\\x09-\\x0D]"
WORD_BYTES = rb"[^\x20\x09-\x0D]+"
#: Found in every text that has a word.
HAS_WORD = "[^\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, spark.checkpoint.dir; a temporary one of our own only where it is unset and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all executors share")
    root = tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(f"file://{root}")
    return f"file://{root}"


#: Paths below the shared folder that were given out and not removed since, in order.
_GIVEN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends or by `drop_scratch`."""
    path = f"{scratch_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    _GIVEN.append(path)
    atexit.register(_remove, spark, path)
    return path


def drop_scratch(spark: SparkSession, since: int, keep: str) -> int:
    """Remove the intermediate tables given out after the first `since`, but for `keep`; returns how many are left."""
    for path in _GIVEN[since:]:
        if path != keep:
            _remove(spark, path)
    _GIVEN[since:] = [x for x in _GIVEN[since:] if x == keep]
    return len(_GIVEN)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the driver may be gone already; what stays lies in the cluster's scratch folder
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder once and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Bytes of the tables that `df` reads, by Catalyst's estimate; it costs no job and only sizes partitions, never results.

    Inputs of unknown size (rows of the driver or an RDD) are measured instead.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        total += int(str(leaves.next().stats().sizeInBytes()))
    if total < 1 << 60:
        return total
    wide = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    row = df.agg(F.count(F.lit(1)), *wide).first()
    return 8 * row[0] * len(df.columns) + sum(row[1:])


def pieces(df: DataFrame, mb: float, least: int | None = None) -> int:
    """Partitions of about `mb` MB of `df`'s estimated bytes, at least the session's shuffle partitions."""
    spark = df.sparkSession
    least = least if least is not None else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, int(plan_bytes(df) / (mb * 1e6)) + 1)


#: What clears the caches that operators keep in a Python worker between tasks.
_CACHES: dict[str, object] = {}


def keeps(owner: str, clear) -> None:
    """Register a cache that lives as long as the Python worker."""
    _CACHES[owner] = clear


def starts(owner: str) -> None:
    """Called when an operator's task starts in a Python worker: caches of other operators are dropped."""
    for name in [x for x in _CACHES if x != owner]:
        _CACHES.pop(name)()


def side(df: DataFrame, most: int = 400_000) -> DataFrame:
    """Broadcast a narrow table, but only if it is counted to have at most `most` rows (some 20 MB); else it is shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def components(links: DataFrame) -> DataFrame:
    """(node, component): for every node of `links` (a, b), the smallest node that it reaches.

    Labels move to the smallest neighbour's label and then jump to that label's own label; each round is written to the
    shared folder. The rounds grow with the logarithm of the longest path.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = written(both, "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node"))
        low = near.agg(F.min("component").alias("low"))
        step = labels.join(low, "node", "left").select("node", F.least("component", "low").alias("component"))
        target = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        moved = step.join(target, "component", "left").select("node", F.least("component", "next").alias("component"))
        after = written(moved, "labels")
        changed = after.join(labels.withColumnRenamed("component", "old"), "node").where("component < old").limit(1).count()
        labels = after
        if not changed:
            return labels


def grouped_join(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows joined with groups, which has `key` once each and n, the rows of it; both are read several times, so cut their lineage.

    Keys of more than a thousandth of the rows (there are at most a thousand of them) are joined by broadcast, the others by
    shuffle (or broadcast, if counted few), so no key of the shuffled join is larger.
    """
    bound = max(1000, rows.count() // 1000)
    hot, rest = F.broadcast(groups.where(F.col("n") > bound)), groups.where(F.col("n") <= bound)
    return rows.join(hot, key).union(rows.join(hot.select(key), key, "left_anti").join(side(rest), key))


def sliced(batches: Iterator[pa.RecordBatch], column: str, rows: int = 1_000, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows and about `size` bytes in `column`, so that what is made of one stays bounded."""
    for batch in batches:
        of = batch.column(batch.schema.get_field_index(column))
        lengths = pc.fill_null(pc.binary_length(of), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(upto[at - 1]) if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(upto, before + size, "right"))))
            yield batch.slice(at, end - at)
            at = end


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 64-bit number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte at each place of a word; a word's code is their sum.
_PLACED = mixed(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices begin[0], begin[0] + 1, ..., then those from begin[1] on, and so on."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def word_codes(letters: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit code of each word; `letters` are the bytes of the words, one word after another, each of at least one byte."""
    begin = np.cumsum(size) - size
    place = np.arange(len(letters)) - np.repeat(begin, size)
    value = _PLACED[((place & 255) << 8) | letters]
    if size.max(initial=0) > 256:
        value *= (2 * (place >> 8) + 1).astype(np.uint64)
    return (np.add.reduceat(value, begin) if len(size) else np.zeros(0, np.uint64)) + size.astype(np.uint64)
