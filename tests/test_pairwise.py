"""Comparison in tiles and links in one task, against the lists of pairs and the rounds that they stand for."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster, graph, linkage, pairwise, resolve
from tessera.sources import corpus


@pytest.fixture(scope="module")
def records(spark, sf_dir):
    m = corpus.mentions(spark, sf_dir)
    blank = lambda c, n: F.when(F.col("id") % n > 0, F.col(c)).alias(c)
    odd = {"age": 7, "name": 31, "case_id": 29, "deed": 11, "officer": 9, "lat": 8, "circle": 13}
    return cluster.checkpointed(m.select(*[blank(c, odd[c]) if c in odd else c for c in m.columns]))


@pytest.mark.parametrize("rows", [16, 8192])
def test_tiles_count_and_keep_the_pairs_that_are_listed(spark, records, monkeypatch, rows):
    monkeypatch.setattr(pairwise, "ROWS", rows)
    monkeypatch.setattr(pairwise, "SMALL", 8)
    paths = graph.root_paths(corpus.units(spark))
    listed, model = resolve.scored(records, paths)
    x, y = (records.select(F.col("id").alias(c), F.col("person").alias(f"p{c}")) for c in "ab")
    listed = cluster.checkpointed(listed.join(x, "a").join(y, "b").withColumn("match", F.coalesce((F.col("pa") == F.col("pb")).cast("int"), F.lit(0))))
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(resolve.counted_levels(records, paths)) == plain(listed.groupBy(*resolve.SIGNALS, "match").agg(F.count(F.lit(1)).alias("n")))
    monkeypatch.setattr(linkage.Model, "threshold", lambda self, cost=4.0: 2.0)
    kept, again = resolve.strong(records, paths)
    want = plain(listed.where("score >= 2.0").select("a", "b", F.round("score", 9), "case_a", "case_b"))
    assert want and plain(kept.select("a", "b", F.round("score", 9), "case_a", "case_b")) == want and again.weights() == model.weights()


def test_links_in_one_task_equal_those_in_rounds(spark, monkeypatch):
    e = cluster.checkpointed(spark.range(300).selectExpr("id as a", "(id * 37 + 11) % 500 as b"))
    plain = lambda df: sorted(map(tuple, df.select("node", "component").collect()))
    one = plain(cluster.components(e))
    monkeypatch.setattr(cluster, "FEW", 0)
    assert plain(cluster.components(e)) == one
