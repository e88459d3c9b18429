"""Collective iteration, curves, samples and exports on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import collective, evaluate, exports, graph, linkage, studies


def test_relations_through_a_partition(spark):
    rows = [(1, 1, "x"), (2, 1, "p"), (3, 2, "y"), (4, 2, "p"), (5, 3, "z"), (6, 4, "w"), (7, 4, "q")]
    df = spark.createDataFrame(rows, "id long, case_id long, label string")
    pairs = spark.createDataFrame([(1, 3), (1, 5), (1, 6)], "a long, b long")
    got = {(r["a"], r["b"]): r["relational"] for r in collective.relational(pairs, df, "label").collect()}
    assert got == {(1, 3): 2, (1, 5): -1, (1, 6): 0}
    levels = spark.createDataFrame([(0, 2), (0, 0), (2, 0), (1, -1)], "o int, n int").select(collective.damped("o", "n", 0.5).alias("v"))
    assert [r["v"] for r in levels.collect()] == [1, 0, 1, 1]


def test_collective_rounds_end(spark):
    records = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2), (5, 3)], "id long, case_id long")
    scored = spark.createDataFrame([(1, 3, 5.0, 1, 2), (2, 4, 0.5, 1, 2), (4, 5, -3.0, 2, 3)], "a long, b long, base double, case_a long, case_b long")
    labels, moved = collective.iterate(scored, records, [0.0, 0.4, 2.0], 1.0, factor=1.0)
    got = {r["node"]: r["cluster"] for r in labels.collect()}
    assert got[1] == got[3] and got[2] == got[4] and got[5] == 5 and moved[-1] == 0


def test_curve_and_cuts(spark):
    truth = spark.createDataFrame([(i, i // 2) for i in range(8)], "id long, person long")
    pairs = spark.createDataFrame([(0, 1, 9.0, 0, 1), (2, 3, 5.0, 2, 3), (4, 6, 2.0, 4, 6)], "a long, b long, score double, case_a long, case_b long")
    out = evaluate.curve(pairs, truth, "person", [1.0, 4.0, 8.0])
    assert [r["recall"] for r in out] == [0.5, 0.5, 0.25] and out[1]["precision"] == 1.0
    assert evaluate.cuts_of(pairs, 3, 0.0) == [2.0, 5.5, 9.0] and evaluate.cuts_of(pairs.limit(0)) == []


def test_gold_sample_is_bounded_and_stable(spark):
    rng = random.Random(1)
    pairs = spark.createDataFrame([(i, i + 1, rng.choice(["candidate", "other"])) for i in range(300)], "a long, b long, stratum string")
    truth = pairs.where("a < 20").select("a", "b")
    sample = lambda: sorted(map(tuple, evaluate.gold_sample(pairs.repartition(rng.randint(1, 5)), truth, 30, 10).collect()))
    rows = sample()
    assert sum(r[2] for r in rows) == 20 and len(rows) == 60 and rows == sample()


def test_review_pairs_and_fingerprint(spark):
    scored = spark.createDataFrame([(1, 2, 0.8, 1), (1, 3, 0.7, 0), (2, 3, 0.99, 1)], "a long, b long, probability double, s int")
    members = spark.createDataFrame([(1, 10, 100), (2, 11, 100), (3, 12, 101)], "id long, identity long, case_id long")
    rows = exports.review_pairs(scored, {"s": [-1.0, 2.0]}, members).collect()
    assert [(r["a"], r["b"], r["conflict"]) for r in rows] == [(1, 2, True), (1, 3, False)] and rows[0]["evidence"][0]["weight"] == 2.0
    first = exports.fingerprint(scored).first()
    assert first == exports.fingerprint(scored.orderBy(F.desc("b")).repartition(3)).first() and first["n_rows"] == 3


def test_ablation_drops_one_signal(spark):
    df = spark.createDataFrame([(1, 1)], "s int, t int")
    w = {"s": [-1.0, 2.0], "t": [-1.0, 3.0]}
    assert df.select(evaluate.without(df, w, "t")).first()[0] == pytest.approx(2.0)


def test_fit_options():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = [(0, 0)] * 3000 + [(1, 1)] * 260 + [(1, 0)] * 90 + [(0, 1)] * 60 + [(1, -1)] * 30
    levels = spark.createDataFrame(rows, "x int, y int")
    signals, seeds = {"x": 2, "y": 2}, {"x": 1, "y": 1}
    plain = linkage.fit(levels, signals, seeds)
    only = linkage.fit(levels, signals, seeds, estimate_only=True)
    assert only.p == 0.003 and only.m == plain.m and not only.trace and plain.trace == sorted(plain.trace)
    assert linkage.fit(levels, signals, seeds, fix_u={"x": [0.9, 0.1]}).u["x"] == [0.9, 0.1]
    prior = linkage.fit(levels, signals, seeds, m_prior={"x": [0.5, 0.5]}, prior_pairs=10**9).m["x"]
    assert abs(prior[0] - 0.5) < 1e-4
    masked = linkage.fit(levels, signals, seeds, seed_mask={"y": 1})
    assert masked.m["x"] == plain.m["x"] and masked.m["y"][1] > 0.99


def test_studies_on_small_inputs(spark, tmp_path):
    records = spark.createDataFrame([(i, i // 2, 1 + i % 2) for i in range(400)], "id long, person long, gender long")
    flipped = studies.with_gender_noise(records, 0.25).join(records.withColumnRenamed("gender", "old"), "id").where("gender <> old").count()
    assert 60 < flipped < 140 and studies.with_gender_noise(records, 0.0).exceptAll(records).count() == 0
    assert studies.true_pairs(records).count() == 200
    pooled = studies.pooled(spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3,)], "x int"))
    assert sorted(map(tuple, pooled.collect()), key=str) == [(1, 2), (3, None)]
    assert studies.reduction_ratio(5, 5) == 0.5
    truth = records.select("id", "person")
    assert studies.truth_labels(truth, records.limit(3)).count() == 3
    with pytest.raises(ValueError):
        studies.truth_labels(truth, spark.createDataFrame([(1000,)], "id long"))
    for kind in ("json", "text"):
        studies.write_report(truth.limit(2), f"file://{tmp_path}/{kind}", kind)
    assert spark.read.json(f"file://{tmp_path}/json").count() == spark.read.text(f"file://{tmp_path}/text").count() == 2


def test_hierarchies(spark):
    units = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1), (9, None)], "unit long, parent long")
    assert {r["unit"]: r["path"] for r in graph.root_paths(units).collect()} == {1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [1, 4], 9: [9]}
    with pytest.raises(ValueError):
        graph.root_paths(spark.createDataFrame([(1, 2), (2, 1)], "unit long, parent long"), 4)
