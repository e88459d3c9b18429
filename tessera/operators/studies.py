"""Reports and studies around a resolution: what could be recovered, what each signal tells, what a change of data does to it."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import names as N

from . import cluster, linkage


def true_pairs(records: DataFrame, person: str = "person", row_id: str = "id") -> DataFrame:
    """(a, b), a < b: records of one person; each person has few."""
    x, y = (records.select(F.col(row_id).alias(c), F.col(person).alias("p")) for c in "ab")
    return x.join(y, "p").where("a < b").select("a", "b")


def tiers(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs per tier of what speaks for them: equal text, equal key, a shared token, three other facts, or less.

    records: id, name, born, gender, unit, district, deed, officer; the facts are all but the name.
    """
    normal = N.normalised(F.col("name"))
    side = records.select("id", F.lower(F.trim("name")).alias("surface"), N.canonical(normal).alias("canon"), normal["tokens"].alias("tokens"), "born", "gender", "unit", "district", "deed", "officer")
    x, y = (side.select(*[F.col(c).alias(f"{c}_{s}") for c in side.columns]) for s in "xy")
    both = pairs.join(x, F.col("a") == F.col("id_x")).join(y, F.col("b") == F.col("id_y"))
    same = lambda c: F.coalesce(F.col(f"{c}_x") == F.col(f"{c}_y"), F.lit(False))
    facts = [F.coalesce(F.abs(F.col("born_x") - F.col("born_y")) <= 1, F.lit(False)), *map(same, ("gender", "unit", "district", "deed", "officer"))]
    n = sum((f.cast("int") for f in facts[1:]), facts[0].cast("int"))
    tier = (
        F.when(same("surface"), "1 text").when(same("canon") & (F.col("canon_x") != ""), "2 key").when(F.arrays_overlap("tokens_x", "tokens_y"), "3 token")
        .when(n >= 3, "4 facts").otherwise("5 little")
    )
    return both.select(tier.alias("tier"), n.alias("facts")).groupBy("tier").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("facts"), 4).alias("mean_facts"))


def signal_report(levels: DataFrame, signals: dict[str, int], label: str, weight: str | None = None) -> DataFrame:
    """Per signal: share of pairs where it is computable, and rank AUC of its level there against the label.

    weight: column with the number of pairs that a row stands for; one each without it.
    """
    out = None
    size = F.coalesce(F.sum(weight), F.lit(0)) if weight else F.count(F.lit(1))
    total = levels.agg(size).first()[0]
    for s in signals:
        known = levels.where(F.col(s) >= 0).select(F.col(s).alias("v"), F.col(label).alias("y"), *([weight] if weight else []))
        row = known.agg(F.lit(s).alias("signal"), F.round(size / F.lit(max(total, 1)), 6).alias("coverage"), F.round(linkage.auc(known, "v", "y", weight).scalar(), 6).alias("auc"))
        out = row if out is None else out.unionByName(row)
    return out


def blocking_report(keyed: DataFrame, pairs: DataFrame, families: tuple[str, ...] = ("PH", "P4", "TR")) -> DataFrame:
    """Share of the given true pairs (a, b) that each combination of key families brings together. keyed: (id, keys)."""
    x, y = (keyed.select(F.col("id").alias(c), F.col("keys").alias(f"k{c}")) for c in "ab")
    shared = F.array_distinct(F.transform(F.array_intersect("ka", "kb"), lambda k: F.substring(k, 1, 2)))
    met = pairs.join(x, "a").join(y, "b").select(shared.alias("f"))
    combos = [c for n in range(1, len(families) + 1) for c in combinations(families, n)]
    sums = met.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.arrays_overlap("f", F.array(*map(F.lit, c))).cast("long")).alias("+".join(c)) for c in combos])
    rows = F.explode(F.array(*[F.struct(F.lit("+".join(c)).alias("families"), F.col("+".join(c)).alias("covered")) for c in combos]))
    return sums.select("n", rows.alias("r")).select("r.families", F.col("n").alias("true_pairs"), F.coalesce("r.covered", F.lit(0)).alias("covered"))


def reduction_ratio(candidates: int, records: int) -> float:
    """Share of all pairs that blocking spares."""
    return 1 - candidates / max(records * (records - 1) / 2, 1)


def objective(pairs: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """Sum of what the scores of pairs within a cluster are above the threshold. pairs: (a, b, score); clusters: (node, cluster)."""
    x = clusters.select(F.col("node").alias("a"), F.col("cluster").alias("x"))
    y = clusters.select(F.col("node").alias("b"), F.col("cluster").alias("y"))
    inside = pairs.join(x, "a").join(y, "b").where("x = y")
    return inside.agg(F.round(F.coalesce(F.sum(F.col("score") - F.lit(threshold)), F.lit(0.0)), 6).alias("objective"), F.count(F.lit(1)).alias("pairs"))


def counted_objective(patterns: DataFrame, score: str, weight: str, threshold: float) -> DataFrame:
    """The same from patterns of the pairs within a cluster, each with the number of its pairs."""
    above = F.sum((F.col(score) - F.lit(threshold)) * F.col(weight))
    return patterns.agg(F.round(F.coalesce(above, F.lit(0.0)), 6).alias("objective"), F.coalesce(F.sum(weight), F.lit(0)).alias("pairs"))


def pooled(*levels: DataFrame) -> DataFrame:
    """Levels of several tables as one, for weights that a small table cannot give by itself."""
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def with_gender_noise(records: DataFrame, share: float) -> DataFrame:
    """Records with the gender of a share of them flipped, chosen by hash, so that reruns agree."""
    chosen = F.pmod(F.xxhash64("id", F.lit("flip")), F.lit(10_000)) < F.lit(int(share * 10_000))
    return records.withColumn("gender", F.when(chosen, 3 - F.col("gender")).otherwise(F.col("gender")))


def community_summary(labels: DataFrame, edge: DataFrame, mentions: DataFrame, cases: DataFrame, most: int = 40) -> DataFrame:
    """The largest communities of two and more: size, inner and recovered edges, cases, and the three districts of most cases.

    labels: (node, community); edge: (a, b, recovered); mentions: (identity, case_id); cases: (case_id, district).
    """
    size = labels.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where("size >= 2").orderBy(F.desc("size"), "community").limit(most)
    of = labels.join(F.broadcast(size.select("community")), "community", "left_semi")
    x, y = (of.select(F.col("node").alias(c), F.col("community").alias(f"c{c}")) for c in "ab")
    inner = edge.join(x, "a").join(y, "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(
        F.count(F.lit(1)).alias("edges"), F.sum(F.col("recovered").cast("long")).alias("recovered")
    )
    seen = mentions.join(of.withColumnRenamed("node", "identity"), "identity").select("community", "case_id").distinct().join(cases.select("case_id", "district"), "case_id")
    per = seen.groupBy("community", "district").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "district"))
    top = per.withColumn("place", place).groupBy("community").agg(
        F.sum("n").alias("cases"), F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "district")))).alias("t")
    )
    out = size.join(inner, "community", "left").join(top, "community", "left").fillna(0, ["edges", "recovered"])
    return out.select("community", "size", "edges", "recovered", "cases", F.transform("t", lambda t: t["district"]).alias("districts"))


def stale(reports: DataFrame, inputs: DataFrame) -> DataFrame:
    """Reports (report, built) that are older than one of their inputs (report, changed), or were never built."""
    last = inputs.groupBy("report").agg(F.max("changed").alias("changed"))
    return last.join(reports, "report", "left").where("built is null or built < changed").select("report", "built", "changed")


def surface_tokens(name: Column) -> Column:
    """Words of a name as it is written, in lower case, longer than a letter, without markers."""
    return F.filter(F.split(F.lower(F.trim(name)), "[\\s./\\\\@]+"), lambda t: (F.length(t) > 1) & ~t.isin(N.MARKERS))


def gold_key(name: Column) -> Column:
    """Words of a name longer than two letters, sorted, as one key."""
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(F.trim(name)), "\\s+"), lambda t: F.length(t) > 2)), " ")


def truth_labels(truth: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, person) of the given ids from a ground-truth table; an id without truth is an error, not a blank."""
    out = ids.select("id").join(truth.select("id", "person"), "id", "left")
    missing = out.where("person is null").count()
    if missing:
        raise ValueError(f"{missing} ids have no ground truth")
    return out


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A report as JSON lines, or as text, one line of `column: value` pairs per row."""
    if kind == "json":
        df.write.mode("overwrite").json(path)
    else:
        line = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in df.columns])
        df.select(line.alias("line")).write.mode("overwrite").text(path)


# What each role may do with a pair under review.
ROLES = {"reviewer": ["accept", "reject", "reverse"], "analyst": ["accept", "reject"], "supervisor": ["accept", "reject"], "officer": []}


def allowed(log: DataFrame) -> DataFrame:
    """Entries of a decision log (role, action, ...) that the role may make."""
    rows = [(r, a) for r, acts in ROLES.items() for a in acts]
    gate = log.sparkSession.createDataFrame(rows, "role string, action string")
    return log.join(F.broadcast(gate), ["role", "action"], "left_semi")


def singletons_and_merges(clusters: DataFrame) -> DataFrame:
    """Clusters, those of one record, and records in the largest."""
    per = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("clusters"), F.sum((F.col("n") == 1).cast("long")).alias("singletons"), F.max("n").alias("largest"))


def baselines(records: DataFrame, person: str = "person") -> DataFrame:
    """Pair metrics of clusters by the exact key and by the sound of a name. records: (id, name, <person>)."""
    from .resolve import by_value

    keyed = records.select("id", person, N.baseline_key(F.col("name")).alias("key"), N.phonetic_code(F.col("name")).alias("sound"))
    out = None
    for kind in ("key", "sound"):
        labelled = by_value(keyed, kind, "id").withColumnRenamed("node", "id").join(keyed.select("id", person), "id")
        row = cluster.pairwise(labelled, "cluster", person).withColumn("baseline", F.lit(kind))
        out = row if out is None else out.unionByName(row)
    return out
