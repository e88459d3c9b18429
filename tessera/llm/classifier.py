"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training bins each statistic into at most 64 quantile bins and grows trees of fixed depth on gradient histograms. The trees
are flattened into arrays (feature, threshold, first child, value), which numpy walks for all rows and trees at once, one
level per step. Training takes a bounded sample of the labelled rows (max_train, by hash order); scoring takes every row.

Defined results: null and empty texts get the score of a text without words; a null doc_id is scored and not held out;
repeated rows get equal scores; several labels of one document count as their majority; without labels of both kinds every
score is the share of good ones (0.5 without any); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import starts, table

STATISTICS = [
    "log_words", "word_length", "upper", "digits", "symbols", "exclaims", "other_marks", "high_bytes", "spaces_per_word",
    "log_lines", "words_per_line", "unique_words", "repeated_next", "unique_lines", "sentence_ends", "line_ends", "bars",
    "byte_entropy", "unique_pairs", "longest_word",
]
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_MARKS = np.frombuffer(b"\"'()-/:;=@[]^_`{}~+\\", np.uint8)


def statistics(text: bytes) -> list[float]:
    """The statistics of one text, from all of its bytes."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(float)
    size = float(len(text))
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = hist[hist > 0] / size
    ends = text.count(b". ") + text.count(b".\n") + text.endswith((b".", b"!", b"?"))
    return [
        np.log1p(n), (size - hist[9:14].sum() - hist[32]) / n, hist[65:91].sum() / size, hist[48:58].sum() / size,
        hist[_SYMBOLS].sum() / n, hist[33] / n, hist[_MARKS].sum() / n, hist[128:].sum() / size,
        (hist[9:14].sum() + hist[32]) / n, np.log1p(len(lines)), n / len(lines), len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n, len(set(lines)) / len(lines), ends / n,
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines), text.count(b" | ") / n,
        float(-(share * np.log2(share)).sum()), len(set(zip(words, words[1:]))) / n, float(max(map(len, words))),
    ]


def matrix(texts: pa.Array) -> np.ndarray:
    raw = texts.cast(pa.large_binary()) if pa.types.is_large_string(texts.type) else texts.cast(pa.binary())
    out = np.zeros((len(raw), len(STATISTICS)))
    for i, x in enumerate(raw):
        out[i] = statistics(x.as_py() or b"")
    return out


@dataclass
class Trees:
    """All trees in flat arrays. A node's children are first[i] and first[i] + 1; leaves point at themselves."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    first: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.base)
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(self.depth):
            right = x[rows, self.feature[at]] > self.threshold[at]  # never at a leaf: its threshold is infinite
            at = self.first[at] + right
        return self.base + self.value[at].sum(1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Boosted trees for the logistic loss. least: the least sum of second derivatives on either side of a split."""
    n = len(y)
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    base = float(np.log(mean / (1 - mean)))
    none = np.zeros(0, np.int64)
    if n == 0 or y.min() == y.max():
        return Trees(none, none, np.zeros(0), none, np.zeros(0), depth, base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # bin b: x <= edges[b]
    features = np.arange(x.shape[1]) * bins
    roots, feature, threshold, first, value = [], [], [], [], []

    def node() -> int:
        feature.append(0), threshold.append(np.inf), first.append(len(first)), value.append(0.0)
        return len(first) - 1

    margin = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(node())
        level = [(roots[-1], np.arange(n))]
        for d in range(depth + 1):
            below = []
            for at, rows in level:
                g, h = grad[rows].sum(), hess[rows].sum()
                best = None
                if d < depth and h >= 2 * least:
                    flat = (binned[rows] + features).ravel()
                    hg = np.bincount(flat, np.repeat(grad[rows], x.shape[1]), features[-1] + bins).reshape(-1, bins).cumsum(1)
                    hh = np.bincount(flat, np.repeat(hess[rows], x.shape[1]), features[-1] + bins).reshape(-1, bins).cumsum(1)
                    gain = hg**2 / (hh + l2) + (g - hg) ** 2 / (h - hh + l2) - g**2 / (h + l2)
                    gain[(hh < least) | (h - hh < least)] = -1
                    best = np.unravel_index(gain.argmax(), gain.shape)
                    best = best if gain[best] > 1e-6 else None
                if best is None:
                    value[at] = -rate * g / (h + l2)
                    margin[rows] += value[at]
                    continue
                j, b = int(best[0]), int(best[1])
                right = binned[rows, j] > b
                feature[at], threshold[at], first[at] = j, float(edges[j][b]), node()
                below += [(first[at], rows[~right]), (node(), rows[right])]
            level = below
    return Trees(np.array(roots), np.array(feature), np.array(threshold), np.array(first), np.array(value), depth, base)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = 20_000) -> Trees:
    """Fit on at most max_train labelled documents that are not held out, the first by hash of doc_id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    measured = rows.mapInArrow(_measure, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(measured["x"].to_pylist(), float).reshape(-1, len(STATISTICS))
    return fit(x, np.array(measured["y"].to_pylist(), float))


def _measure(batches):
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        x = pa.array(list(matrix(text)), pa.list_(pa.float64()))
        y = batch.column(batch.schema.get_field_index("_y"))
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), y, x], ["doc_id", "y", "x"])


def score(text: Column, model: Trees) -> Column:
    """Score of a text column, between 0 and 1."""

    @F.arrow_udf("double")
    def apply(texts: pa.Array) -> pa.Array:
        starts("classifier")
        return pa.array(model.predict(matrix(texts)))

    return apply(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train: int = 20_000) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = train(docs, labels, max_train=max_train)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
