"""Frequency-adjusted probabilistic linkage on comparison patterns."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A level seen on fewer pairs than this has no weight.
SUPPORT = 30


@dataclass
class Model:
    p: float
    m: dict[str, list[float]]
    u: dict[str, list[float]]
    support: dict[str, list[int]]
    trace: list[float] = field(default_factory=list)

    def weights(self) -> dict[str, list[float]]:
        """ln(m / u) per level; 0 where a level has little support. Level -1 (not computable) always weighs 0."""
        floor = lambda x: max(x, 1e-9)
        return {
            s: [math.log(floor(a) / floor(b)) if n >= SUPPORT else 0.0 for a, b, n in zip(self.m[s], self.u[s], self.support[s])]
            for s in self.m
        }

    def threshold(self, cost: float = 4.0) -> float:
        """Score from which a match is likelier than `cost` times a mistake."""
        return math.log((1 - self.p) / self.p) + math.log(cost)


def patterns(levels: DataFrame, signals: list[str], weight: str | None = None) -> DataFrame:
    """Distinct comparison vectors and their counts: a few thousand rows, whatever the number of pairs.

    weight: column with the number of pairs that a row stands for, here and in the functions below; one each without it.
    """
    return levels.groupBy(*signals).agg(_size(weight).alias("n"))


def _size(weight: str | None) -> Column:
    return F.sum(weight) if weight else F.count(F.lit(1))


def _marked(label: str, weight: str | None) -> Column:
    return F.sum(F.col(label) * F.col(weight)) if weight else F.sum(label)


def fit(
    levels: DataFrame, signals: dict[str, int], seeds: dict[str, int], start: float = 0.003, rounds: int = 300, tolerance: float = 1e-10,
    least_seed: int = 200, seed_mask: dict[str, int] | None = None, m_prior: dict[str, list[float]] | None = None, prior_pairs: float = 100.0,
    fix_u: dict[str, list[float]] | None = None, estimate_only: bool = False,
    weight: str | None = None,
) -> Model:
    """EM for the match rate p. signals: number of levels of each; seeds: lowest level of each seed condition.

    u comes from all candidate pairs; m of a signal from the pairs that meet the seed conditions of the other signals, of
    which the first are dropped while too few pairs meet them. Only p is fitted. Works on the collected patterns.

    seed_mask: one set of lowest levels for all signals instead; m_prior: m of another table, counted as prior_pairs pairs;
    fix_u: u of some signals as given; estimate_only: m and u without EM, p stays at its start.
    """
    names = list(signals)
    rows = [(r[:-1], r[-1]) for r in map(tuple, patterns(levels, names, weight).collect())]
    total = sum(n for _, n in rows)
    at = {s: i for i, s in enumerate(names)}

    def histogram(keep, s: str) -> list[int]:
        out = [0] * (signals[s] + 1)
        for v, n in rows:
            if keep(v):
                out[v[at[s]]] += n  # level -1 lands in the last place
        return out

    m, u, support = {}, {}, {}
    for s, k in signals.items():
        every = histogram(lambda v: True, s)
        conditions = [(at[x], low) for x, low in (seed_mask or seeds).items() if x in at and (seed_mask or x != s)]
        while True:
            held = list(conditions)
            seed = histogram(lambda v, held=held: all(v[i] >= low for i, low in held), s)
            if seed_mask or sum(seed) >= least_seed or len(conditions) <= 1:
                break
            conditions = conditions[1:]
        smooth = lambda h: [(x + 1) / (sum(h) + len(h)) for x in h]
        m[s], u[s], support[s] = smooth(seed)[:k], smooth(every)[:k], every[:k]
        if m_prior and s in m_prior:
            n = sum(seed)
            m[s] = [(x * n + p * prior_pairs) / (n + prior_pairs) for x, p in zip(m[s], m_prior[s])]
        if fix_u and s in fix_u:
            u[s] = list(fix_u[s])
    model = Model(start, m, u, support)
    if estimate_only:
        return model
    ratio = [
        math.prod(m[s][v[at[s]]] / u[s][v[at[s]]] for s in names if v[at[s]] >= 0) for v, _ in rows
    ]
    last = None
    for _ in range(rounds):
        mixed = [model.p * r + (1 - model.p) for r in ratio]
        score = sum(n * math.log(x) for (_, n), x in zip(rows, mixed))
        model.trace.append(score)
        if last is not None and abs(score - last) <= tolerance * max(1.0, abs(last)):
            break
        last = score
        model.p = min(max(sum(n * model.p * r / x for (_, n), r, x in zip(rows, ratio, mixed)) / max(total, 1), 1e-9), 1 - 1e-9)
    return model


def _term(level: Column, weights: list[float]) -> Column:
    return F.when(level < 0, 0.0).otherwise(F.element_at(F.array(*map(F.lit, weights)), level.cast("int") + 1))


def contributions(weights: dict[str, list[float]], levels: dict[str, Column] | None = None) -> dict[str, Column]:
    """Column of each signal's term; levels: where a signal is no column of its name."""
    return {s: _term((levels or {}).get(s, F.col(s)), w) for s, w in weights.items()}


def score(weights: dict[str, list[float]], levels: dict[str, Column] | None = None) -> Column:
    terms = list(contributions(weights, levels).values())
    return sum(terms[1:], terms[0])


def frequencies(records: DataFrame, key: str) -> DataFrame:
    """(key, p): relative frequency of each key, the empty one included."""
    counts = records.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(key, (F.col("n") / counts.agg(F.sum("n")).scalar()).alias("p"))


def generic_u(freq: DataFrame) -> float:
    """Chance that two random records agree."""
    return freq.agg(F.sum(F.col("p") * F.col("p"))).first()[0] or 0.0


def frequency_adjusted(pairs: DataFrame, agreed: str, freq: DataFrame, key: str, value: str) -> DataFrame:
    """Add to `value` ln(sum of p² / p of the agreed key) where a key agreed: rare names count more."""
    base = generic_u(freq)
    table = freq.select(F.col(key).alias("_k"), "p")
    bonus = F.when((F.col(agreed) != "") & F.col("p").isNotNull(), F.log(F.lit(base) / F.col("p"))).otherwise(0.0)
    return pairs.join(table, pairs[agreed] == table["_k"], "left").withColumn(value, F.col(value) + bonus).drop("_k", "p")


def auc(df: DataFrame, value: str, label: str, weight: str | None = None) -> DataFrame:
    """Rank AUC, ties sharing their mean rank; null with one class only. Windows run over distinct values."""
    from pyspark.sql.window import Window

    by = df.groupBy(value).agg(_size(weight).alias("n"), _marked(label, weight).alias("pos"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = by.select("n", "pos", (before + (F.col("n") + 1) / 2).alias("rank"))
    sums = ranked.agg(F.sum("pos").cast("double").alias("p"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("q"), F.sum(F.col("rank") * F.col("pos")).alias("r"))
    return sums.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"))


def best_cut(df: DataFrame, value: str, label: str, weight: str | None = None) -> DataFrame:
    """The cut with the best F1 (the highest one of equals), with its precision and recall."""
    from pyspark.sql.window import Window

    by = df.groupBy(F.col(value).alias("cut")).agg(_size(weight).alias("n"), _marked(label, weight).alias("pos"))
    down = Window.orderBy(F.desc("cut")).rowsBetween(Window.unboundedPreceding, 0)
    total = df.agg(_marked(label, weight)).scalar()
    run = by.select("cut", F.sum("n").over(down).alias("taken"), F.sum("pos").over(down).alias("tp"))
    f1 = F.try_divide(F.col("tp") * 2.0, F.col("taken") + total)
    return run.select("cut", (F.col("tp") / F.col("taken")).alias("precision"), F.try_divide(F.col("tp").cast("double"), total).alias("recall"), f1.alias("f1")).orderBy(F.desc("f1"), F.desc("cut")).limit(1)
