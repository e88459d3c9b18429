"""Co-occurrence graph, communities and their reports."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cluster import checkpointed, components


def anchor_names(mentions: DataFrame) -> DataFrame:
    """(identity, anchor): the most frequent name of each, the earliest row first among equals."""
    counts = mentions.groupBy("identity", "name").agg(F.count(F.lit(1)).alias("n"), F.min("mention").alias("first"))
    place = F.row_number().over(Window.partitionBy("identity").orderBy(F.desc("n"), "first"))
    return counts.withColumn("place", place).where("place = 1").select("identity", F.col("name").alias("anchor"))


def edges(mentions: DataFrame) -> DataFrame:
    """Edges of identities that share a case: (a, b), shared_cases, cases, visible_before and recovered.

    mentions has (mention, case_id, identity, name). An edge was visible before resolution if in some shared case both are
    written as their anchor names; otherwise resolution recovered it. Cases hold few mentions each, so the self-join is small.
    """
    named = mentions.join(anchor_names(mentions), "identity")
    per = named.groupBy("case_id", "identity").agg(F.bool_or(F.col("name") == F.col("anchor")).alias("plain"))
    x, y = per.alias("x"), per.alias("y")
    pairs = x.join(y, (F.col("x.case_id") == F.col("y.case_id")) & (F.col("x.identity") < F.col("y.identity")))
    out = pairs.groupBy(F.col("x.identity").alias("a"), F.col("y.identity").alias("b")).agg(
        F.count(F.lit(1)).alias("shared_cases"), F.array_sort(F.collect_list("x.case_id")).alias("cases"),
        F.bool_or(F.col("x.plain") & F.col("y.plain")).alias("visible_before"),
    )
    return out.withColumn("recovered", ~F.col("visible_before"))


def links(mentions: DataFrame) -> DataFrame:
    """(a, b) of the edges alone: no names, no lists of cases. Intermediate tables are written once."""
    per = checkpointed(mentions.select("case_id", "identity").distinct())
    x, y = per.alias("x"), per.alias("y")
    pairs = x.join(y, (F.col("x.case_id") == F.col("y.case_id")) & (F.col("x.identity") < F.col("y.identity")))
    return checkpointed(pairs.select(F.col("x.identity").alias("a"), F.col("y.identity").alias("b")).distinct())


def rings(mentions: DataFrame, node: int) -> tuple[DataFrame, DataFrame]:
    """(node) of the identities one step and of those two steps from a node, over its cases and those of its neighbours only."""
    per = checkpointed(mentions.select("case_id", "identity").where("case_id is not null and identity is not null").distinct())

    def met(people: DataFrame) -> DataFrame:
        theirs = per.join(people.withColumnRenamed("node", "identity"), "identity", "left_semi").select("case_id").distinct()
        return per.join(theirs, "case_id", "left_semi").select(F.col("identity").alias("node")).where(F.col("node") != node).distinct()

    ring = checkpointed(met(per.where(F.col("identity") == node).select(F.col("identity").alias("node"))))
    return ring, checkpointed(met(ring).join(ring, "node", "left_anti"))


def ego_of(mentions: DataFrame, node: int) -> DataFrame:
    """As `ego`, but only the edges among the people of both rings are made."""
    ring, far = rings(mentions, node)
    people = ring.union(far).union(mentions.sparkSession.createDataFrame([(node,)], "node long")).withColumnRenamed("node", "identity")
    return edges(checkpointed(mentions.join(people, "identity", "left_semi")))


def degrees(edge: DataFrame) -> DataFrame:
    ends = edge.select(F.col("a").alias("node")).union(edge.select(F.col("b").alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def report(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    d = degrees(edge).agg(F.max("degree").alias("max_degree"))
    e = edge.agg(F.count(F.lit(1)).alias("edges"), F.sum(F.col("recovered").cast("long")).alias("recovered"))
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    return e.select(
        n.scalar().alias("nodes"), "edges", "recovered", F.round(F.try_divide(F.col("recovered").cast("double"), "edges"), 4).alias("recovered_share"),
        F.round(F.try_divide(F.col("edges") * 2.0, n.scalar()), 4).alias("mean_degree"), d.scalar().alias("max_degree"),
    )


def root_paths(units: DataFrame, most: int = 32) -> DataFrame:
    """(unit, path): each unit's superiors from the root down to itself. units: (unit, parent), a null parent is a root.

    One join per level of the hierarchy; more than `most` levels mean a circle and are an error.
    """
    up = checkpointed(units.select("unit", F.array("unit").alias("path"), F.col("parent").alias("next")))
    parents = units.select(F.col("unit").alias("next"), F.col("parent").alias("further"))
    for _ in range(most):
        if not up.where("next is not null").limit(1).count():
            return up.select("unit", "path")
        known = F.when(F.col("next").isNotNull(), F.concat(F.array("next"), F.col("path"))).otherwise(F.col("path"))
        up = checkpointed(up.join(parents, "next", "left").select("unit", known.alias("path"), F.col("further").alias("next")))
    raise ValueError(f"the hierarchy has a circle or more than {most} levels")


def two_hop(edge: DataFrame, node: int) -> DataFrame:
    """Nodes exactly two steps from a node."""
    both = edge.select("a", "b").union(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ring = both.where(F.col("a") == node).select(F.col("b").alias("node")).distinct()
    far = both.join(ring.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct()
    return far.where(F.col("node") != node).join(ring, "node", "left_anti")


def ego(edge: DataFrame, node: int, before: bool = False) -> DataFrame:
    """Edges within two rings of a node; `before` leaves out recovered ones."""
    kept = edge.where(~F.col("recovered")) if before else edge
    both = kept.select("a", "b").union(kept.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ring = both.where(F.col("a") == node).select(F.col("b").alias("node"))
    rings = ring.union(two_hop(kept, node)).union(kept.sparkSession.createDataFrame([(node,)], "node long")).distinct()
    return kept.join(rings.withColumnRenamed("node", "a"), "a", "left_semi").join(rings.withColumnRenamed("node", "b"), "b", "left_semi")


def _merge(total: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Greedy modularity within one component: merge the pair with the largest gain while there is one.

        Gains are whole numbers, in units of 1 / (2 total^2). The heap has one valid entry for each pair, at or above its gain: a
        gain falls when an end grows and is then looked at again when its entry comes up; it is entered anew where links add up.
        """
        ends, at = np.unique(np.concatenate([rows["a"].to_numpy(), rows["b"].to_numpy()]), return_inverse=True)
        nodes, size = ends.tolist(), len(ends)
        links: list[dict[int, int]] = [{} for _ in nodes]
        for a, b in zip(at[: len(rows)].tolist(), at[len(rows) :].tolist()):
            links[a][b] = links[b][a] = links[b].get(a, 0) + 1
        degree, members = [sum(x.values()) for x in links], [[i] for i in range(size)]
        # an entry is one number, the gain's negative in front of the pair, so that it orders as both do
        each, pairs = 2 * total, size * size
        entered = {a * size + b: each * w - degree[a] * degree[b] for a, x in enumerate(links) for b, w in x.items() if a < b}
        heap = [pair - g * pairs for pair, g in entered.items() if g > 0]
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            key, pair = divmod(pop(heap), pairs)
            if entered.get(pair) != -key:
                continue
            a, b = divmod(pair, size)
            if (now := each * links[a][b] - degree[a] * degree[b]) != -key:
                entered[pair] = now
                if now > 0:
                    push(heap, pair - now * pairs)
                continue
            moved, links[b], own, joint = links[b], {}, links[a], degree[a] + degree[b]
            degree[a] = joint
            for n, w in moved.items():
                near = links[n]
                del near[b]
                del entered[n * size + b if n < b else b * size + n]
                if n != a:
                    own[n] = near[a] = w = own.get(n, 0) + w
                    fresh = a * size + n if a < n else n * size + a
                    entered[fresh] = now = each * w - joint * degree[n]
                    if now > 0:
                        push(heap, fresh - now * pairs)
            members[a] += members[b]
            members[b] = []
        found = [(nodes[n], nodes[c]) for c, ns in enumerate(members) for n in ns]
        return pd.DataFrame(found, columns=["node", "community"])

    return run


def communities(edge: DataFrame) -> DataFrame:
    """(node, community) by greedy modularity, component by component; the gains use the edge count of the whole graph.

    The merges of one component depend on each other and are one task, which holds the component's edges.
    """
    flat = checkpointed(edge.select("a", "b"))
    total = flat.count()
    labelled = flat.join(components(flat).withColumnRenamed("node", "a"), "a")
    return labelled.groupBy("component").applyInPandas(_merge(total), "node long, community long")


def modularity(edge: DataFrame, labels: DataFrame) -> DataFrame:
    """Modularity of a partition (node, community)."""
    total = edge.agg(F.count(F.lit(1)).cast("double")).scalar()
    a, b = labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), labels.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    inside = edge.join(a, "a").join(b, "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("inner"))
    total_degree = degrees(edge).join(labels, "node").groupBy("community").agg(F.sum("degree").alias("d"))
    per = total_degree.join(inside, "community", "left").select(
        (F.coalesce("inner", F.lit(0)) / total - F.pow(F.col("d") / (total * 2), F.lit(2.0))).alias("part")
    )
    return per.agg(F.sum("part").alias("modularity"))
