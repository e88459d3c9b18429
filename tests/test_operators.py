"""Linkage, clusters, graph, hotspots, retrieval, reconciliation, decisions and the guard."""

import random

import pytest
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions import measures as M
from tessera.operators import blocking, calibrate, cluster, graph, hotspots, linkage, reconcile, retrieval, scope
from tessera.streaming import decisions


def _values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_levels(spark):
    years = [F.lit(x).cast("double") for x in (0, 2, 3)] + [F.lit(None).cast("double")]
    assert _values(spark, *[M.temporal_level(y, F.lit(0.0)) for y in years]) == [2, 1, 0, -1]
    km = M.haversine_km(F.lit(12.97), F.lit(77.59), F.lit(12.30), F.lit(76.65))
    assert 110 < _values(spark, km)[0] < 145
    none = F.lit(None).cast("double")
    assert _values(spark, *[M.spatial_level(F.lit(h), k) for h, k in ((0, none), (2, none), (4, none), (6, F.lit(10.0)), (6, none))]) == [3, 2, 1, 2, 0]
    assert _values(spark, *[M.cell(F.lit(x)) for x in (12.97, -0.1, 75.0)]) == [12.75, -0.25, 75.0]
    assert _values(spark, M.address_level(F.lit("A, x"), F.lit("a, y")), M.address_level(F.lit(" "), F.lit("a")), M.phone_level(F.lit("1"), F.lit("2"))) == [1, -1, 0]


def test_candidate_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 9), [f"k{rng.randint(0, 6)}" for _ in range(rng.randint(0, 3))]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, case long, keys array<string>").withColumn("keys", F.array_distinct("keys"))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and set(a[2]) & set(b[2])}
    for salt in (1, 5):
        got = [tuple(r) for r in blocking.candidate_pairs(df, "id", "case", salt).collect()]
        assert len(got) == len(want) and set(got) == want


def _levels(spark, n=4000, rate=0.02):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        match = rng.random() < rate
        pick = lambda good, bad: -1 if rng.random() < 0.05 else int(rng.random() < (good if match else bad))
        rows.append((i, pick(0.95, 0.1), pick(0.9, 0.05), pick(0.85, 0.2)))
    return spark.createDataFrame(rows, "i long, s int, t int, u int")


def test_linkage_fit(spark):
    levels = _levels(spark)
    model = linkage.fit(levels, {"s": 2, "t": 2, "u": 2}, {"s": 1, "t": 1, "u": 1}, least_seed=30)
    w = model.weights()
    assert all(v[1] > 0 > v[0] for v in w.values()) and 0.005 < model.p < 0.08
    first = levels.withColumn("score", linkage.score(w)).withColumns({f"c_{k}": c for k, c in linkage.contributions(w).items()})
    assert first.where("abs(score - c_s - c_t - c_u) > 1e-9").count() == 0
    assert first.where("s = -1 and c_s <> 0").count() == 0
    few = linkage.fit(levels.limit(20), {"s": 2}, {"t": 1}, least_seed=1)
    assert few.weights()["s"] == [0.0, 0.0]
    model.p = 0.001
    strict = model.threshold()
    model.p = 0.1
    assert model.threshold() < strict


def test_rare_names_count_more(spark):
    freq = linkage.frequencies(spark.createDataFrame([("a",)] * 90 + [("b",)] * 8 + [("",)] * 2, "k string"), "k")
    pairs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "")], "i long, agreed string").withColumn("v", F.lit(0.0))
    got = {r["i"]: r["v"] for r in linkage.frequency_adjusted(pairs, "agreed", freq, "k", "v").collect()}
    assert got[2] > 0 > got[1] and got[3] == 0


def test_submission_metrics(spark):
    gold = spark.createDataFrame([(1, "P1"), (2, "P1"), (3, "P1"), (4, "P2"), (5, "P2"), (6, "P3")], "id long, person string")
    sub = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (4, "A"), (5, "B"), (6, "B")], "id long, label string")
    r = cluster.score_submission(gold, sub).first()
    assert (r["gold"], r["predicted"], r["tp"]) == (4, 7, 3) and r["f"] == pytest.approx(0.545455, abs=1e-6)
    half = cluster.pairwise(gold.join(sub, "id"), "label", "person", beta=0.5).first()
    assert half["f"] == pytest.approx(0.46875)
    one = cluster.pairwise(gold.withColumn("label", F.lit("x")), "label", "person").first()
    assert one["predicted"] == 15
    with pytest.raises(ValueError):
        cluster.score_submission(gold, sub.where("id > 1"))


PAIRS = "a long, b long, score double, case_a long, case_b long"


def test_agglomeration_keeps_its_constraints(spark):
    rng = random.Random(3)
    case = {i: rng.randint(0, 12) for i in range(60)}
    rows = [(a, b, rng.random() * 10, case[a], case[b]) for a in range(60) for b in range(a + 1, 60) if case[a] != case[b] and rng.random() < 0.2]
    out = cluster.agglomerate(spark.createDataFrame(rows, PAIRS), 3.0)
    cases = spark.createDataFrame(list(case.items()), "node long, case long")
    assert cluster.violations(out, cases).first()[0] == 0


def test_a_single_bridge_is_refused(spark):
    triangle = lambda n: [(n, n + 1, 9.0, n, n + 1), (n, n + 2, 9.0, n, n + 2), (n + 1, n + 2, 9.0, n + 1, n + 2)]
    df = spark.createDataFrame([*triangle(0), *triangle(10), (2, 10, 8.0, 2, 10)], PAIRS)
    count = lambda d: cluster.agglomerate(df, 1.0, d).select("cluster").distinct().count()
    assert count(0.5) == 2 and count(0.0) == 1


def test_components_of_a_long_path(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in cluster.components(df).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 43
    assert cluster.components(df.limit(0)).count() == 0


def test_graph_and_communities(spark):
    rows = [(1, 1, 1, "a"), (2, 1, 2, "b"), (3, 2, 1, "a"), (4, 2, 2, "bee"), (5, 3, 2, "b"), (6, 3, 3, "c")]
    men = spark.createDataFrame(rows, "mention long, case_id long, identity long, name string")
    edges = {(r["a"], r["b"]): r for r in graph.edges(men).collect()}
    assert edges[1, 2]["shared_cases"] == 2 and edges[1, 2]["cases"] == [1, 2] and edges[1, 2]["visible_before"] and (1, 3) not in edges
    clique = lambda ns: [(a, b) for a in ns for b in ns if a < b]
    e = spark.createDataFrame([*clique(range(5)), *clique(range(10, 15)), (4, 10)], "a long, b long")
    groups = {}
    for r in graph.communities(e).collect():
        groups.setdefault(r["community"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [list(range(5)), list(range(10, 15))]


def test_trend_anomaly(spark):
    rows = [(f"{y}-{m:02d}-01", 1) for y in (2020, 2021) for m in range(1, 13) for _ in range(3)] + [("2021-06-01", 1)] * 9 + [("2021-07-01", 2)] * 9
    df = spark.createDataFrame([(i, d, k) for i, (d, k) in enumerate(rows)], "case_id long, day string, district long").withColumn("day", F.to_date("day"))
    flagged = {(r["district"], r["month"]) for r in hotspots.trends(df).where("anomaly").collect()}
    assert flagged == {(1, "2021-06")}


def test_vectors_and_retrieval(spark):
    docs = spark.createDataFrame([(1, "red door broken at night"), (2, "red door broken in daylight"), (3, "phone stolen on a bus"), (4, None)], "d long, t string")
    v = retrieval.combined(docs, "d", "t")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 1)], "a long, b long")
    got = {(r["a"], r["b"]): r["cosine"] for r in retrieval.cosine(pairs, v, "d").collect()}
    assert got[1, 1] == pytest.approx(1) and got[1, 2] > got[1, 3]
    ranked = spark.createDataFrame([(1, 7, 1), (2, 8, 3), (3, 1, 1)], "case_id long, identity long, place int")
    truth = spark.createDataFrame([(1, 7), (2, 8), (3, 9), (4, 1)], "case_id long, identity long")
    r = retrieval.hit_rates(ranked, truth).first()
    assert (r["cases"], r["hit_1"], r["hit_3"]) == (4, 0.25, 0.5) and r["mrr"] == pytest.approx(0.3333)


def test_code_books(spark):
    codes = reconcile.code_table(spark)
    eq = {}
    for r in reconcile.equivalents(codes).collect():
        eq.setdefault(r["code"], set()).add(r["other"])
    assert eq["324"] == {"324", "118", "427"} and [r["number"] for r in reconcile.ambiguous(codes).collect()] == ["324"]
    rows = [(1, "1997-05-01", "old", "324"), (2, "1999-05-01", "new", "118"), (3, "1999-05-01", "new", "324"), (4, "2009-01-01", "old", "324")]
    df = spark.createDataFrame(rows, "case_id long, day string, act string, number string").withColumn("day", F.to_date("day"))
    got = reconcile.counts(df, codes, "1990-01-01", "2005-01-01", "1998-01-01").where("old_no = '324'").first()
    assert (got["naive"], got["wrong"], got["reconciled"], got["missed"]) == (2, 1, 2, 1)


def test_decisions_in_batch_and_stream(spark, tmp_path):
    rows = [(1, 10, "accept"), (2, 11, "reject"), (3, 10, "reverse"), (4, 12, "accept"), (5, 11, "accept")]
    log = spark.createDataFrame(rows, "seq long, pair_id long, action string")
    assert {r["pair_id"]: r["state"] for r in decisions.fold(log).collect()} == {10: "pending", 11: "accept", 12: "accept"}
    s = decisions.summary(log, 5).first()
    assert (s["accept"], s["reversed"], s["pending"]) == (2, 1, 3)
    for i in range(2):
        log.where(F.col("seq") % 2 == i).write.parquet(f"{tmp_path}/in/part={i}")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = decisions.keep_state(stream, f"{tmp_path}/state", f"{tmp_path}/check")
    query.awaitTermination(120)
    versions = sorted(tmp_path.glob("state/v*"), key=lambda p: int(p.name[1:]))
    last = spark.read.parquet(str(versions[-1]))
    assert {r["pair_id"]: r["action"] for r in last.collect()} == {10: "reverse", 11: "accept", 12: "accept"}


def test_calibration_is_monotone(spark):
    rng = random.Random(5)
    rows = [(x := rng.random() * 10, int(rng.random() < x / 10)) for _ in range(3000)]
    out = calibrate.isotonic(spark.createDataFrame(rows, "v double, y int"), "v", "y").orderBy("v").select("probability").toPandas()
    assert out.probability.is_monotonic_increasing
    p = [0.99, 0.92, 0.80, 0.65, 0.10]
    assert _values(spark, *[calibrate.route(F.lit(x)) for x in p]) == [0, 0, 1, 1, 2]


def test_search_and_scope(spark):
    men = spark.createDataFrame([(1, 5, 1, "Ramesh"), (2, 6, 2, "Suresh"), (3, 6, 1, "Ramesha")], "mention long, case_id long, identity long, name string")
    numbers = spark.createDataFrame([(5, "1RAM"), (6, "200")], "case_id long, number string")
    assert [(r["identity"], r["found"]) for r in scope.search(men, numbers, "RAM").collect()] == [(1, "Ramesh")]
    assert scope.search(men, numbers, "r").count() == 0


def test_protected_columns_never_pass(spark):
    for name in ("CasteID", "caste_id", "RELIGION NAME", "Occupation"):
        assert schema.is_protected(name)
    with pytest.raises(schema.ProtectedColumnError, match="profile"):
        schema.guard(["AgeYear", "caste"], "profile")
    assert schema.features(spark.range(1).withColumn("AgeYear", F.lit(3)), "AgeYear").columns == ["AgeYear"]


def test_corpus_files(spark, tmp_path):
    state = spark.createDataFrame([(1, "S", None, "")], "StateID long, StateName string, StateNameKn string, StateCode string")
    schema.write_corpus({"State": state}, str(tmp_path), "csv")
    back = schema.read_corpus(spark, str(tmp_path), "csv")
    assert list(back) == ["State"] and back["State"].first()["StateNameKn"] is None
