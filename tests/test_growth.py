"""Answers that are made without pairing the rows of large groups, against the texts and operators that pair them."""

import re

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import cluster, graph, linkage
from tessera.plans import questions
from tessera.sources import adapter


@pytest.mark.parametrize("number", sorted(questions.PLANS))
def test_plans_answer_as_their_texts(spark, sf_dir, monkeypatch, number):
    adapter.register(spark, sf_dir)
    other = {"station": F.lit(7), "district": F.lit(2)}
    values = {k: other[k] for k in questions.parameters(number)}
    planned = questions.ask(spark, number, **values)
    monkeypatch.setattr(questions, "PLANS", {})
    plain = questions.ask(spark, number, **values)
    assert planned.columns == plain.columns
    assert sorted(map(tuple, planned.collect())) == sorted(map(tuple, plain.collect()))


def test_only_pairs_that_can_reach_the_threshold_are_made(spark, sf_dir):
    every = catalog._candidate_levels(spark, sf_dir).withColumn("score", linkage.score(catalog._WEIGHTS)).withColumns({"case_a": F.col("a") % 50, "case_b": F.col("b") % 50})
    rows = lambda df: sorted(map(tuple, df.select("node", "cluster").collect()))
    assert rows(catalog.agglomerate(spark, sf_dir)) == rows(cluster.agglomerate(every, 6.5))


def test_rings_equal_those_of_all_edges(spark):
    rows = [(1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 4), (4, 1), (5, 5), (4, 2), (4, 6)]
    m = spark.createDataFrame([(i, c, p, "n") for i, (c, p) in enumerate(rows)], "mention long, case_id long, identity long, name string")
    e = graph.edges(m)
    ring, far = graph.rings(m, 1)
    assert sorted(r["node"] for r in ring.collect()) == [2, 6] and sorted(r["node"] for r in far.collect()) == sorted(r["node"] for r in graph.two_hop(e, 1).collect())
    edge = lambda df: sorted((r["a"], r["b"], r["shared_cases"]) for r in df.collect())
    assert edge(graph.ego_of(m, 1)) == edge(graph.ego(e, 1))
    assert sorted(map(tuple, graph.links(m).collect())) == sorted((r["a"], r["b"]) for r in e.collect())


def test_equal_parts_are_linked_without_pairs(spark, tmp_path):
    n = 50_000
    spark.range(n).selectExpr("id as p_partkey", "'red rod' as p_name", "'B' as p_brand", "1 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    found = catalog.connected_components(spark, str(tmp_path)).groupBy("component").count().collect()
    assert [(r["component"], r["count"]) for r in found] == [(0, n)]


def test_communities_need_no_names(spark, sf_dir, monkeypatch):
    want = sorted(r["size"] for r in graph.communities(graph.edges(catalog.mentions(spark, sf_dir))).groupBy("community").agg(F.count(F.lit(1)).alias("size")).collect())
    monkeypatch.setattr(graph, "edges", None)
    assert sorted(r["size"] for r in catalog.QUERIES["communities"](spark, sf_dir).collect()) == want


@pytest.mark.parametrize("number", [33, 35, 36, 44, 130])
def test_pairs_are_dealt_to_tasks_by_the_size_of_the_table(spark, sf_dir, monkeypatch, number):
    adapter.register(spark, sf_dir)
    deal = spark.table("lineitem").count() // 50
    monkeypatch.setattr(questions, "DEAL", deal, raising=False)
    dealt = questions.ask(spark, number)
    parts = re.findall(r"hashpartitioning\(.*?, (\d+)\)", dealt._jdf.queryExecution().executedPlan().toString())
    assert parts.count(str(spark.table("lineitem").count() // deal)) >= 2
    monkeypatch.setattr(questions, "DEALT", {}, raising=False)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, questions.ask(spark, number).collect()))


def test_tables_of_another_corpus_answer_for_themselves(spark, sf_dir):
    other = spark.newSession()
    adapter.register(other, sf_dir)
    rows = [(1, 1, 7), (2, 1, 8), (3, 2, 7), (4, 2, 8), (5, 3, 9)]
    other.createDataFrame(rows, "AccusedMasterID long, CaseMasterID long, ResolvedIdentityID long").createOrReplaceTempView("resolved_identity")
    assert [tuple(r) for r in questions.ask(other, 33).collect()] == [(7, 8, 2)]


def test_profiles_are_dealt_by_the_size_of_the_table(spark, sf_dir, monkeypatch):
    deal = catalog.read(spark, sf_dir, "lineitem").count() // 50
    monkeypatch.setattr(questions, "DEAL", deal, raising=False)
    p = catalog.QUERIES["identity_profiles"](spark, sf_dir)
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"hashpartitioning\(identity.*?, {questions.tasks(spark)}\)", plan) and "AccusedName" not in plan
    want = catalog.profiles.build(catalog.mentions(spark, sf_dir), catalog.cases(spark, sf_dir)).select(*p.columns)
    assert sorted(map(tuple, p.collect())) == sorted(map(tuple, want.collect()))
