"""Components, constrained agglomeration and pair metrics."""

from __future__ import annotations

import os
import tempfile
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder of the cluster (spark.checkpoint.dir); a folder of our own only where it is unset and Spark is local."""
    spark = df.sparkSession
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()


#: Edges up to which one task links them by itself, in less time than a round of all tasks takes.
FEW = 1_000_000


def _united(batches):
    """Smallest node that each one reaches, from all edges in one task."""
    parent: dict = {}

    def root(n):
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    for rows in batches:
        for a, b in zip(rows["a"].tolist(), rows["b"].tolist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    yield pd.DataFrame({"node": list(parent), "component": [root(n) for n in parent]})


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b): the smallest node it reaches.

    Up to FEW edges are linked in one task. Beyond, each round takes the smallest label of all neighbours and then that label's own label, so the number of rounds grows
    with the logarithm of the longest path.
    """
    edges = checkpointed(edges.select("a", "b"))
    n, blank = edges.agg(F.count(F.lit(1)), F.count_if(F.col("a").isNull() | F.col("b").isNull())).first()
    if n <= FEW and not blank:
        kind = edges.schema["a"].dataType.simpleString()
        return checkpointed(edges.coalesce(1).mapInPandas(_united, f"node {kind}, component {kind}"))
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node"))
        step = labels.join(near.agg(F.min("component").alias("low")), "node").select("node", F.least("component", "low").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        after = checkpointed(step.join(jump, "component").select("node", F.least("component", "next").alias("component")))
        moved = after.join(labels.withColumnRenamed("component", "old"), "node").where("component < old").limit(1).count()
        labels = after
        if not moved:
            return labels


def _agglomerate(least_density: float, most: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Edges of whole components, strongest first; ends of a merge must not share a case and be linked densely enough."""
        nodes = sorted(set(rows["a"]) | set(rows["b"]))
        largest = max(Counter((dict(zip(rows["a"], rows["component"])) | dict(zip(rows["b"], rows["component"]))).values()).values())
        if largest > most:
            raise ValueError(f"a component of {largest} records is over the limit of {most}; raise the threshold or the limit")
        case = dict(zip(rows["a"], rows["case_a"])) | dict(zip(rows["b"], rows["case_b"]))
        group, members, cases = {n: n for n in nodes}, {n: [n] for n in nodes}, {n: {case[n]} for n in nodes}
        links: dict[int, dict[int, int]] = {n: {} for n in nodes}  # of clusters: how many pairs link two of them
        for a, b in zip(rows["a"], rows["b"]):
            links[a][b] = links[b][a] = 1
        for a, b in rows.sort_values(["score", "a", "b"], ascending=[False, True, True])[["a", "b"]].itertuples(index=False):
            p, q = sorted((group[a], group[b]))
            if p == q or cases[p] & cases[q]:
                continue
            if links[p].get(q, 0) < least_density * len(members[p]) * len(members[q]):
                continue
            for n, w in links.pop(q).items():
                del links[n][q]
                if n != p:
                    links[p][n] = links[n][p] = links[p].get(n, 0) + w
            for n in members[q]:
                group[n] = p
            members[p] += members.pop(q)
            cases[p] |= cases.pop(q)
        return pd.DataFrame({"node": nodes, "cluster": [group[n] for n in nodes]})

    return run


def agglomerate(pairs: DataFrame, threshold: float, least_density: float = 0.5, most: int = 100_000) -> DataFrame:
    """(node, cluster) from scored pairs (a, b, score, case_a, case_b), a < b.

    Merges follow pairs at or above the threshold, so each connected component of those is worked on by itself; a group holds many.
    """
    strong = checkpointed(pairs.where(F.col("score") >= threshold).select("a", "b", "score", "case_a", "case_b"))
    labels = components(strong)
    buckets = max(4 * pairs.sparkSession.sparkContext.defaultParallelism, strong.count() // 20_000)
    rows = strong.join(labels.withColumnRenamed("node", "a"), "a").withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets)))
    return rows.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_agglomerate(least_density, most), "node long, cluster long")


def with_singletons(records: DataFrame, row_id: str, clusters: DataFrame) -> DataFrame:
    """(node, cluster) of all records; those without a merge stand alone."""
    all_rows = records.select(F.col(row_id).alias("node"))
    return all_rows.join(clusters, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"))


def violations(clusters: DataFrame, cases: DataFrame) -> DataFrame:
    """Pairs of records of one case within one cluster, counted as sum of n (n - 1) / 2; cases has (node, case)."""
    per = clusters.join(cases, "node").groupBy("cluster", "case").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("long").alias("violations"))


def _pairs(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("long").alias("pairs"))


def pairwise(labelled: DataFrame, label: str, truth: str, beta: float = 1.0) -> DataFrame:
    """Predicted, true and common pairs with precision, recall and F1 or F-beta."""
    counts = labelled.select(
        _pairs(labelled, label).scalar().alias("predicted"), _pairs(labelled, truth).scalar().alias("gold"), _pairs(labelled, label, truth).scalar().alias("tp")
    ).limit(1)
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), "predicted"), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), "gold"), F.lit(0.0))
    f = F.coalesce(F.try_divide((1 + beta**2) * p * r, beta**2 * p + r), F.lit(0.0))
    return counts.select("predicted", "gold", "tp", p.alias("precision"), r.alias("recall"), f.alias("f"))


def greedy_split(records: DataFrame, key: str, case: str, row_id: str) -> DataFrame:
    """Cluster by key, but rows of one case go to different parts: the n-th row of a case in a key group to part n."""
    part = F.row_number().over(Window.partitionBy(key, case).orderBy(row_id))
    return records.withColumn("part", part)


def score_submission(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Pair metrics of a submission (id, label) against gold (id, person); rows that are missing are an error."""
    missing = gold.join(predicted, "id", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} ids of the gold set are missing")
    return pairwise(gold.join(predicted, "id"), "label", "person")
