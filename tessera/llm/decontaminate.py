"""Benchmark decontamination by greedy string tiling.

Texts are words in lower case without punctuation. Documents and test items are joined on shared seeds of `least` words. For
each pair that shares enough of them, the longest common runs of words that do not overlap earlier ones are marked again and
again (windows are looked up by a running Karp-Rabin hash, then compared), down to `least` words. An item leaks into a document
whose tiles cover at least `cover` of its words, in whatever order they stand there.

Up to `max_seeds` different seeds of the benchmark, about 32 MB, are broadcast, so that documents send only those of their seeds
that some item has; beyond that, all their seeds go to the join. Equal texts are looked at once.

Defined results: null and empty texts match nothing; items without words and null item_ids are ignored; items of fewer than
`least` words are matched as a whole; repeated documents or items count each (an item_id that repeats is listed once, with its
best cover); empty tables give empty results or no matches; other columns of docs are kept or ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, side, sliced, starts, table, word_codes, written

_WORD = re.compile(r"\w+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def codes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of each text, one text after another, and how many words each has. No number is 0."""
    found = [words(t) for t in texts]
    counts = np.array([len(w) for w in found], np.int64)
    raw = np.frombuffer(" ".join([w for ws in found for w in ws]).encode(), np.uint8)
    ends = np.append(np.flatnonzero(raw == 0x20), len(raw))
    size = np.diff(ends, prepend=-1) - 1 if len(raw) else np.zeros(0, np.int64)
    return mixed(word_codes(raw[raw != 0x20], size)) | np.uint64(1), counts


def _seeds(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` codes."""
    out = np.full(max(0, len(codes) - size + 1), size, np.uint64)
    for k in range(size):
        out = mixed(out * _A + codes[k : k + len(out)])
    return out


def _windows(codes: np.ndarray, marked: np.ndarray, size: int, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and Karp-Rabin hash of each window of `size` unmarked codes, from running sums; power: of the base, ascending."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.append(np.uint64(0), np.cumsum(codes * power[: len(codes)], dtype=np.uint64))
    taken = np.append(0, np.cumsum(marked))
    at = np.flatnonzero(taken[size:] == taken[:n])
    return at, (total[at + size] - total[at]) * power[len(power) - 1 - at]  # every window ends up times the same power


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _B, np.uint64), dtype=np.uint64)


def _longest(text: np.ndarray, item: np.ndarray, in_text: np.ndarray, in_item: np.ndarray, least: int, most: int, power: np.ndarray) -> int:
    """Length of the longest common run of unmarked codes; less than `least` without one. A shorter run is in every longer one."""
    low, high = least - 1, most
    while low < high:
        middle = (low + high + 1) // 2
        if np.isin(_windows(text, in_text, middle, power)[1], _windows(item, in_item, middle, power)[1]).any():
            low = middle
        else:
            high = middle - 1
    return low


def tiles(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (start in text, start in item, length), longest first, none overlapping another."""
    text, item = np.asarray(text).astype(np.uint64), np.asarray(item).astype(np.uint64)
    in_text, in_item, found = np.zeros(len(text), bool), np.zeros(len(item), bool), []
    most, power = min(len(text), len(item)), _powers(max(len(text), len(item)))
    while most >= least:
        most = _longest(text, item, in_text, in_item, least, most, power)
        if most < least:
            break
        where = defaultdict(deque)
        for j, h in zip(*(x.tolist() for x in _windows(item, in_item, most, power))):
            where[h].append(j)
        starts_, hashes = _windows(text, in_text, most, power)
        shared = np.isin(hashes, np.array(list(where), np.uint64))
        for i, h in zip(starts_[shared].tolist(), hashes[shared].tolist()):
            free = where[h]
            while free and (in_item[free[0]] or in_item[free[0] + most - 1]):
                free.popleft()  # marked by now, and for good
            if free and not in_text[i] and not in_text[i + most - 1] and (text[i : i + most] == item[free[0] : free[0] + most]).all():
                j = free.popleft()
                in_text[i : i + most] = in_item[j : j + most] = True
                found.append((i, j, most))
        most -= 1  # what is left of this length overlaps marked words
    return found


def covered(text: np.ndarray, item: np.ndarray, least: int) -> float:
    """Share of the item's words in tiles."""
    size = min(least, len(item))
    near = np.isin(_seeds(text, size), _seeds(item, size))
    inside = np.zeros(len(text) + 1, np.int64)
    np.add.at(inside, np.flatnonzero(near), 1)
    np.add.at(inside, np.flatnonzero(near) + size, -1)
    kept = np.flatnonzero(np.cumsum(inside[:-1]))  # only words within seeds can be in tiles; a gap becomes a code of no word
    gaps = np.flatnonzero(np.diff(kept) > 1) + 1
    return sum(n for _, _, n in tiles(np.insert(text[kept], gaps, 0), item, size)) / len(item)


def _batch(kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))


def _items(least: int, cover: float):
    """Of each item: its codes, its seeds, how often it has each, and how many places a leak shares at least."""
    kinds = {"item": pa.string(), "item_id": pa.int64(), "codes": pa.binary(), "size": pa.int32(), "need": pa.int64(), "seeds": pa.list_(pa.int64()), "times": pa.list_(pa.int64())}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            codes, counts = codes_of(batch.column(2).to_pylist())
            rows = []
            for item, item_id, mine in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), np.split(codes, np.cumsum(counts)[:-1])):
                if len(mine):
                    size = min(least, len(mine))
                    seeds, times = np.unique(_seeds(mine, size).view(np.int64), return_counts=True)
                    need = -(-int(np.ceil(cover * len(mine) - 1e-9)) // size)  # tiles of the least size share fewest
                    rows.append((item, item_id, mine.tobytes(), size, need, seeds, times))
            yield _batch(kinds, rows)

    return read


def _known(sizes: list[int], shared):
    """key, codes and seeds of documents. With the benchmark's seeds at hand, only those and the words in them, gaps as 0."""
    kinds = {"key": pa.string(), "codes": pa.binary(), "seeds": pa.list_(pa.int64())}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts("decontaminate")
        for batch in sliced(batches, "text"):
            codes, counts = codes_of(batch.column(1).to_pylist())
            ends = np.cumsum(counts)
            near, wanted, of = np.zeros(len(codes) + 1, np.int64), [], []
            for size in sizes:
                seeds = _seeds(codes, size)
                at = np.flatnonzero(np.arange(len(seeds)) + size <= np.repeat(ends, counts)[: len(seeds)])
                if shared is not None:
                    known = shared.value
                    at = at[known[np.minimum(np.searchsorted(known, seeds[at]), len(known) - 1)] == seeds[at]] if len(known) else at[:0]
                np.add.at(near, at, 1)
                np.add.at(near, at + size, -1)
                wanted.append(seeds[at])
                of.append(np.searchsorted(ends, at, "right"))
            inside, rows = np.cumsum(near[:-1]) > 0, []
            wanted, of = np.concatenate(wanted), np.concatenate(of)
            order = np.argsort(of, kind="stable")
            wanted, of = wanted[order], of[order]
            keys = batch.column(0)
            for i in np.unique(of).tolist():
                a, b = np.searchsorted(of, i, "left"), np.searchsorted(of, i, "right")
                begin = int(ends[i] - counts[i])
                kept = np.flatnonzero(inside[begin : ends[i]])
                gaps = np.flatnonzero(np.diff(kept) > 1) + 1
                rows.append((keys[i].as_py(), np.insert(codes[begin + kept], gaps, 0).tobytes(), np.unique(wanted[a:b]).view(np.int64)))
            yield _batch(kinds, rows)

    return read


def _cover(least: int):
    def cover(texts: pa.Array, items: pa.Array) -> pa.Array:
        starts("decontaminate")
        pairs = zip(texts.to_pylist(), items.to_pylist())
        return pa.array([covered(np.frombuffer(t, np.uint64), np.frombuffer(i, np.uint64), least) for t, i in pairs], pa.float64())

    return cover


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", least: int = 5, cover: float = 0.5, max_seeds: int = 4_000_000) -> DataFrame:
    """(key, hits): for each text (by its md5) into which items leak, an array of (item_id, cover) by item_id."""
    spark = docs.sparkSession
    named = benchmark.where("item_id is not null and text is not null").select(
        F.md5(F.concat(F.col("item_id").cast("string"), F.lit(":"), F.col("text"))).alias("item"), F.col("item_id").cast("long").alias("item_id"), "text"
    )
    schema = "item string, item_id long, codes binary, size int, need long, seeds array<long>, times array<long>"
    items = written(named.dropDuplicates(["item"]).mapInArrow(_items(least, cover), schema), "items")
    pairs = items.select("item", "need", F.explode(F.arrays_zip("seeds", "times")).alias("s"))
    of_item = pairs.select(F.col("s.seeds").alias("seed"), "item", "need", F.col("s.times").alias("times"))
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most `least` numbers
    distinct = of_item.select("seed").distinct()
    small = distinct.limit(max_seeds + 1).count() <= max_seeds
    shared = None
    if small:
        seeds = distinct.toArrow()["seed"].to_numpy().view(np.uint64) if sizes else np.zeros(0, np.uint64)
        shared = spark.sparkContext.broadcast(np.sort(seeds))
    mine = docs.where(F.col(text).isNotNull()).select(F.md5(text).alias("key"), F.col(text).alias("text"))
    read = mine.mapInArrow(_known(sizes or [least], shared), "key string, codes binary, seeds array<long>")
    of_doc = read if not small else written(read, "seeded")
    shares = of_doc.select("key", "seeds").dropDuplicates(["key"]).select("key", F.explode("seeds").alias("seed"))
    met = shares.join(side(of_item), "seed").groupBy("key", "item").agg(F.sum("times").alias("times"), F.max("need").alias("need"))
    met = written(met.where("times >= need").select("key", "item"), "candidates")
    if not small:  # the words of documents that have candidates, read again
        found = mine.join(side(met.select("key").distinct()), "key", "left_semi").dropDuplicates(["key"])
        of_doc = found.mapInArrow(_known(sizes or [least], None), "key string, codes binary, seeds array<long>")
    codes = of_doc.select("key", "codes").dropDuplicates(["key"]).join(side(met.select("key").distinct()), "key", "left_semi")
    both = met.join(side(items.select("item", "item_id", F.col("codes").alias("wanted")), 20_000), "item").join(codes, "key")
    share = both.select("key", "item_id", F.arrow_udf(_cover(least), "double")("codes", "wanted").alias("cover")).where(F.col("cover") >= cover)
    best = share.groupBy("key", "item_id").agg(F.max("cover").alias("cover"))
    return best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("item_id", "cover"))).alias("hits"))


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """doc_id, contaminated, n_items, cover (the best, 0 without any) and item_ids of every document."""
    found = side(written(leaks(docs, benchmark, text, **options), "leaks"))
    h = F.coalesce("hits", F.array().cast("array<struct<item_id: bigint, cover: double>>"))
    rows = docs.select("doc_id", F.md5(text).alias("key")).join(found, "key", "left").select("doc_id", h.alias("h"))
    return rows.select(
        "doc_id", (F.size("h") > 0).alias("contaminated"), F.size("h").cast("long").alias("n_items"),
        F.coalesce(F.array_max(F.transform("h", lambda x: x["cover"])), F.lit(0.0)).alias("cover"),
        F.transform("h", lambda x: x["item_id"]).alias("item_ids"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, into which no item leaks."""
    found = side(written(leaks(docs, benchmark, text, **options).select(F.col("key").alias("_leaks")), "leaks"))
    return docs.join(found, F.coalesce(F.md5(text), F.lit("")) == F.col("_leaks"), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
