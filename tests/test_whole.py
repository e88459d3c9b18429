"""Registered queries take all rows: compared with their SQL after the subsets and cuts in it are taken out, and by brute force."""

import random
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import names
from tessera.operators import graph, retrieval
from tessera.sources import adapter


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in adapter.BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _rows(found, columns):
    cols = sorted(columns)
    return sorted([f"{r[c]:.5f}" if isinstance(r[c], float) else str(r[c]) for c in cols] for r in found)


def _same(spark, duck, sf_dir, name, *cuts):
    sql = catalog.ORACLES[name]
    for cut in cuts:  # those in the registered SQL; without any, it is compared as it stands
        sql = sql.replace(cut, "")
    df = catalog.QUERIES[name](spark, sf_dir)
    cur = duck.execute(sql)
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert _rows(df.collect(), cols) == _rows([dict(zip(cols, r)) for r in cur.fetchall()], cols)


SUBSETS = " AND case_id % 40 = 2", "m.identity % 20 = 7 AND ", "identity % 20 = 7 AND "


def test_retrieval_asks_all_open_cases_for_all_people(spark, duck, sf_dir):
    _same(spark, duck, sf_dir, "retrieval_top", *SUBSETS)
    asked = catalog.mentions(spark, sf_dir).join(catalog.cases(spark, sf_dir).where("status = 'Undetected'"), "case_id")
    assert catalog.QUERIES["hit_rates"](spark, sf_dir).first()["cases"] == asked.select("case_id").distinct().count()


def test_hit_rates_see_every_place(spark, duck, sf_dir):
    _same(spark, duck, sf_dir, "hit_rates", *SUBSETS, " AND r.place <= 10")
    r = catalog.QUERIES["hit_rates"](spark, sf_dir).first()
    assert r["hit_50"] > r["hit_10"]


def test_places_without_a_cut(spark):
    opened = spark.createDataFrame([(1, 12.0, 75.0, "2020-01-01", 1)], "case_id long, lat double, lon double, day string, district long")
    people = spark.createDataFrame([(i, 12.0 + i / 100, 75.0, "2020-01-01", 1) for i in range(60)], "identity long, lat double, lon double, day string, district long")
    modus = spark.createDataFrame([], "case_id long, identity long, cosine double")
    every = retrieval.rank(opened, people, modus, None)
    assert [(r["identity"], r["place"]) for r in every.orderBy("place").collect()] == [(i, i + 1) for i in range(60)]
    assert retrieval.rank(opened, people, modus).count() == 10
    truth = spark.createDataFrame([(1, 29)], "case_id long, identity long")
    r = retrieval.hit_rates(every, truth).first()
    assert (r["hit_10"], r["hit_50"], r["mrr"]) == (0.0, 1.0, 0.0333)


def test_modularity_counts_every_edge(spark, duck, sf_dir):
    _same(spark, duck, sf_dir, "modularity", " WHERE shared_cases > 1")


def test_communities_hold_every_linked_identity(spark, sf_dir):
    e = graph.edges(catalog.mentions(spark, sf_dir))
    sizes = [r["size"] for r in catalog.QUERIES["communities"](spark, sf_dir).collect()]
    assert sum(sizes) == graph.degrees(e).count()
    assert sorted(sizes) == sorted(r["count"] for r in graph.communities(e).groupBy("community").count().collect())


def _greedy(edges, total):
    """All pairs of groups looked at before each merge."""
    nodes = sorted({n for e in edges for n in e})
    group = {n: n for n in nodes}
    while True:
        degree, links = dict.fromkeys(nodes, 0), {}
        for a, b in edges:
            p, q = sorted((group[a], group[b]))
            degree[p] += 1
            degree[q] += 1
            if p != q:
                links[p, q] = links.get((p, q), 0) + 1
        gains = sorted((degree[p] * degree[q] - 2 * total * w, p, q) for (p, q), w in links.items())
        if not gains or gains[0][0] >= 0:
            return group
        group = {n: gains[0][1] if g == gains[0][2] else g for n, g in group.items()}


def test_merging_equals_all_pairs_greedy():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(2, 18)
        edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(1, 3 * n))})
        total = len(edges) + rng.choice([0, 5])
        found = graph._merge(total)(pd.DataFrame(edges, columns=["a", "b"]))
        assert dict(zip(found["node"], found["community"])) == _greedy(edges, total)


def test_a_component_of_many_nodes(spark):
    e = spark.range(5_500).selectExpr("id as a", "id + 1 as b")
    found = graph.communities(e)
    assert found.count() == found.select("node").distinct().count() == 5_501


def _blocked(spark, sf_dir):
    """Pairs of parts with a common four-letter head, or a common letter within a brand."""
    n = names.normalised(F.col("p_name"))
    rows = catalog.parts(spark, sf_dir).select("p_partkey", "p_brand", "p_type", "p_size", n["tokens"].alias("tokens"), n["initials"].alias("initials")).collect()
    rows = [(r, {t[:4] for t in r["tokens"]}, {t[:1] for t in r["tokens"]} | set(r["initials"])) for r in rows]
    return [
        (x, y) for x, hx, lx in rows for y, hy, ly in rows
        if x["p_partkey"] < y["p_partkey"] and (hx & hy or x["p_brand"] == y["p_brand"] and lx & ly)
    ]


def test_candidate_pairs_and_levels_cross_brands(spark, sf_dir):
    pairs = _blocked(spark, sf_dir)
    found = {r["brand"]: r["pairs"] for r in catalog.QUERIES["candidate_pairs"](spark, sf_dir).collect()}
    assert found == Counter(x["p_brand"] for x, _ in pairs)
    level = lambda d: 2 if d <= 1 else 1 if d <= 2 else 0
    want = Counter((int(x["p_brand"] == y["p_brand"]), int(x["p_type"] == y["p_type"]), level(abs(x["p_size"] - y["p_size"]))) for x, y in pairs)
    assert {tuple(r[:3]): r[3] for r in map(tuple, catalog.QUERIES["pattern_collapse"](spark, sf_dir).collect())} == want
    calibrated = catalog.QUERIES["isotonic_calibration"](spark, sf_dir).collect()
    assert sum(r["n"] for r in calibrated) == len(pairs)
    assert {r["signal"] for r in catalog.QUERIES["em_fit"](spark, sf_dir).collect()} == {"brand", "kind", "size"}


def test_every_identity_has_relational_levels(spark, duck, sf_dir):
    _same(spark, duck, sf_dir, "relational_level", " WHERE identity % 50 = 7")
