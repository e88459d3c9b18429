"""Removal of repeated 100-byte strings by a logarithmic family of suffix arrays.

A window's shard is chosen by the smallest 32-byte hash in it, which equal windows share, so every shard holds a part of the
suffix space of the whole corpus, and neighbouring windows mostly go to the same shard as one stretch of text. Per shard,
stretches come in document order, batch by batch: a batch gets a suffix array (the windows in the order of their bytes, by
doubling or tripling of ranks), is merge-scanned against the arrays of all existing levels for matches of the whole length (a hit starts
earlier), and what is new becomes a level of its own; levels of equal size merge, so there are logarithmically many. Windows
are compared by their bytes throughout.

Only stretches whose smallest hash occurs twice in the corpus can hold a repeat. A first exchange finds those: each batch of
documents sends its distinct hashes, one row per shard, and gets a bit for each back. Of stretches with equal bytes, a batch
sends only the first; the others are repeats as a whole. So a passage in a third of all documents costs one hash and one
stretch per batch there. Batches are formed once by a hash of the rows; that exchange is reused.

Defined results: null texts are empty (hash of no bytes); texts shorter than `length` lose nothing; a null doc_id counts as
larger than all others; rows that repeat a doc_id come in the order of a 64-bit hash of their texts; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed as _mix, pieces, ranges, starts, table

GRAM = 32
#: Bytes of text handled at a time.
CHUNK = 1 << 20
#: Stretches of a shard that get a suffix array together.
BATCH = 1 << 12
LAST = (1 << 63) - 1
_B = 0x9E3779B97F4A7C15
_U = (1 << 64) - 1


def _rolled(data: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of each run of `size` bytes, by doubling."""
    power, width = data.astype(np.uint64) + np.uint64(1), 1
    out, done = None, 0
    left = size
    while True:
        if left & 1:  # append a run of `width` bytes to what is there
            if out is None:
                out, done = power, width
            else:
                n = len(data) - done - width + 1
                out = out[:n] * np.uint64(pow(_B, width, 1 << 64)) + power[done : done + n]
                done += width
        left >>= 1
        if not left:
            return out[: max(0, len(data) - size + 1)]
        n = len(power) - width
        power = power[:n] * np.uint64(pow(_B, width, 1 << 64)) + power[width : width + n]
        width *= 2


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of `size` values."""
    out, width = values, 1
    while width * 2 <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(values) - size + 1], out[size - width : size - width + len(values) - size + 1])


def stretches(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Stretches of windows with the same smallest hash: hash, first and last window start, whether it may repeat in itself.

    data: bytes of texts one after another; ends: for each byte, where its text ends.
    """
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, np.uint64), none, none, np.zeros(0, bool)
    width = length - GRAM + 1
    grams = _mix(_rolled(data, GRAM))
    low = _least(grams, width)
    valid = np.arange(n) + length <= ends[:n]
    new = np.ones(n, bool)
    new[1:] = (low[1:] != low[:-1]) | (ends[1:n] != ends[: n - 1])
    first = np.flatnonzero(new & valid)
    stop = np.append(np.flatnonzero(new | ~valid), n)
    last = stop[np.searchsorted(stop, first, "right")] - 1
    # a stretch that holds its smallest hash twice may repeat itself
    span = 2 * width
    padded = np.concatenate([grams, np.zeros(span, np.uint64)])
    view = np.lib.stride_tricks.sliding_window_view(padded, span)
    twice = last - first >= width
    for a in range(0, len(first), 1 << 14):
        part = slice(a, a + (1 << 14))
        same = view[first[part]] == low[first[part]][:, None]
        twice[part] |= (same & (np.arange(span) <= (last - first)[part][:, None] + width - 1)).sum(1) > 1
    return low[first], first, last, twice


class Batch:
    """Documents of a batch in order, and their stretches."""

    def __init__(self, rows: pa.Table, length: int):
        ids, texts = rows["doc_id"].to_pylist(), rows["text"].cast(pa.large_binary()).to_pylist()
        full = [(LAST if d is None else d, xxhash.xxh64_intdigest(t or b""), t or b"", d) for d, t in zip(ids, texts)]
        self.docs = sorted(full, key=lambda x: x[:2])
        self.length = length

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(data, ends, row, start in the row's text, text end) of pieces of about CHUNK bytes; long texts overlap by a window."""
        parts, size = [], 0
        for row, (_, _, text, _) in enumerate(self.docs):
            for at in range(0, max(1, len(text) - self.length + 1), CHUNK):
                body = text[at : at + CHUNK + self.length - 1]
                if len(body) >= self.length:
                    parts.append((row, at, body))
                    size += len(body)
            if size >= CHUNK:
                yield self._flat(parts)
                parts, size = [], 0
        if parts:
            yield self._flat(parts)

    @staticmethod
    def _flat(parts: list) -> tuple:
        sizes = np.array([len(p[2]) for p in parts])
        ends = np.repeat(np.cumsum(sizes), sizes)
        where = np.repeat(np.arange(len(parts)), sizes)
        begin = np.cumsum(sizes) - sizes
        return np.frombuffer(b"".join(p[2] for p in parts), np.uint8), ends, where, begin, parts

    def all(self) -> Iterator[tuple]:
        for data, ends, where, begin, parts in self.chunks():
            yield data, where, begin, parts, *stretches(data, ends, self.length)


def _hashes(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Distinct smallest hashes of a batch, and which of them the batch itself has twice."""
    found = [(h, twice) for *_, h, _, _, twice in batch.all()]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    every, twice = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    keys, counts = np.unique(every, return_counts=True)
    return keys, (counts > 1) | np.isin(keys, every[twice])


def _shards(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by shard, and for each shard that occurs its number and first place in that order."""
    shard = (_mix(keys) % np.uint64(n)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
    return order, shard[order][cuts], cuts


def _ask(shards: int, length: int):
    def ask(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        keys, _ = _hashes(Batch(rows, length))
        order, names, cuts = _shards(keys, shards)
        blobs = [x.tobytes() for x in np.split(keys[order], cuts[1:])] if len(cuts) else []
        return pa.table({
            "batch": pa.array([key[0].as_py()] * len(blobs), pa.int32()), "shard": pa.array(names, pa.int32()), "keys": pa.array(blobs, pa.binary()),
        })

    return ask


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch's hashes of this shard, a bit: whether another batch has it, too."""
    asked = [(b, s, np.frombuffer(k, np.uint64)) for x in batches for b, s, k in zip(*(x.column(i).to_pylist() for i in range(3)))]
    by_shard: dict[int, list] = {}
    for b, s, k in asked:
        by_shard.setdefault(s, []).append((b, k))
    for s, held in by_shard.items():
        keys, counts = np.unique(np.concatenate([k for _, k in held]), return_counts=True)
        common = keys[counts > 1]
        bits = [np.packbits(np.isin(k, common, assume_unique=True)).tobytes() for _, k in held]
        yield pa.RecordBatch.from_arrays([
            pa.array([b for b, _ in held], pa.int32()), pa.array([s] * len(held), pa.int32()), pa.array(bits, pa.binary()),
        ], ["batch", "shard", "bits"])


def _send(shards: int, length: int):
    """Stretches that may repeat, by shard: place, size and bytes."""

    def send(key: tuple[pa.Scalar, ...], rows: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(rows, length)
        keys, repeated = _hashes(batch)
        order, names, cuts = _shards(keys, shards)
        bits = dict(zip(answers["shard"].to_pylist(), answers["bits"].to_pylist()))
        for name, at in zip(names.tolist(), np.split(order, cuts[1:]) if len(cuts) else []):
            repeated[at] |= np.unpackbits(np.frombuffer(bits[name], np.uint8), count=len(at)).astype(bool)
        wanted, out, seen, again = keys[repeated], [], {}, []
        names_of, ties = np.array([d[0] for d in batch.docs]), np.array([d[1] for d in batch.docs], np.uint64)
        for data, where, begin, parts, h, first, last, _ in batch.all() if len(wanted) else ():
            at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            pick = np.flatnonzero(wanted[at] == h)
            if not len(pick):
                continue
            part = where[first[pick]]
            row = np.array([p[0] for p in parts])[part]
            start = np.array([p[1] for p in parts])[part] + first[pick] - begin[part]
            size = (last - first)[pick] + length
            whole, new = data.tobytes(), np.ones(len(pick), bool)
            for i, (a, n) in enumerate(zip(first[pick].tolist(), size.tolist())):
                place = (int(row[i]), int(start[i]))
                new[i] = seen.setdefault(whole[a : a + n], place) == place
            if not new.all():
                again.append((row[~new], start[~new], size[~new]))
            pick, row, start, size = pick[new], row[new], start[new], size[new]
            if not len(pick):
                continue
            order, shard, cuts = _shards(h[pick], shards)
            for name, at in zip(shard.tolist(), np.split(order, cuts[1:])):
                out.append((
                    name, ties[row[at]].astype("<u8").tobytes(), names_of[row[at]].astype("<i8").tobytes(), row[at].astype("<i4").tobytes(),
                    start[at].astype("<i8").tobytes(), size[at].astype("<i4").tobytes(), data[ranges(first[pick][at], size[at])].tobytes(),
                ))
        if again:  # repeats that are known: no text goes with them
            row, start, size = (np.concatenate([x[i] for x in again]) for i in range(3))
            out.append((key[0].as_py() % shards, b"", b"", row.astype("<i4").tobytes(), start.astype("<i8").tobytes(), size.astype("<i4").tobytes(), b""))
        columns = list(zip(*out)) if out else [[] for _ in range(7)]
        kinds = (pa.int32(), *[pa.binary()] * 6)
        return pa.table(
            [pa.array([key[0].as_py()] * len(out), pa.int32()), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
            names=["batch", "shard", "tie", "doc", "row", "start", "size", "data"],
        )

    return send


def _word(text: np.ndarray, at: np.ndarray, nth: int, length: int) -> np.ndarray:
    """Bytes 8 nth to 8 nth + 7 of the windows that start at `at`, those beyond `length` left out, as numbers in the order of the bytes."""
    n = min(8, length - 8 * nth)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = (out << np.uint64(8)) | text[at + (8 * nth + k)]
    return out


def _ranked(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    ordered = key[order]
    rank = np.empty(len(key), np.uint64)
    rank[order] = np.append(np.uint64(0), np.cumsum(ordered[1:] != ordered[:-1], dtype=np.uint64))
    return rank


def suffix_array(text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The different windows of `length` bytes among those that start at `at` (ascending), each by its first place, in the order
    of their bytes; and which of all windows are not the first of theirs."""
    padded = np.append(text, np.zeros(length + 8, np.uint8))
    eight = np.zeros(len(text) + length, np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | padded[k : k + len(eight)]
    rank, width = _ranked(eight), 8
    while 2 * width <= length:
        if 3 * width <= length and rank.max() < 1 << 21:  # three small ranks fit into one number
            n = len(rank) - 2 * width
            key = (rank[:n] << np.uint64(42)) | (rank[width : width + n] << np.uint64(21)) | rank[2 * width :]
            rank, width = _ranked(key), 3 * width
        else:
            rank, width = _ranked((rank[: len(rank) - width] << np.uint64(32)) | rank[width:]), 2 * width
    key = (rank[at] << np.uint64(32)) | rank[at + (length - width)]
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    firsts = np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order
    again = np.ones(len(at), bool)
    again[firsts] = False
    return at[firsts], again


class Level:
    """A suffix array over different windows of a text: where they start, in the order of their bytes."""

    def __init__(self, text: np.ndarray, order: np.ndarray, length: int):
        self.text, self.order, self.length = text, order, length
        self.head = _word(text, order, 0, length)

    def scan(self, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each window of `text` belongs among those here, and whether an equal one is here.

        The range of windows that agree so far is narrowed eight bytes at a time.
        """
        head = _word(text, at, 0, self.length)
        low, high = np.searchsorted(self.head, head, "left"), np.searchsorted(self.head, head, "right")
        left = np.flatnonzero(low < high)
        for nth in range(1, -(-self.length // 8)):
            if not len(left):
                break
            asked = _word(text, at[left], nth, self.length)
            low[left] = self._bound(asked, low[left], high[left], nth, False)
            high[left] = self._bound(asked, low[left], high[left], nth, True)
            left = left[low[left] < high[left]]
        return low, low < high

    def _bound(self, asked: np.ndarray, low: np.ndarray, high: np.ndarray, nth: int, after: bool) -> np.ndarray:
        low, high, left = low.copy(), high.copy(), np.flatnonzero(low < high)
        while len(left):
            middle = (low[left] + high[left]) // 2
            found = _word(self.text, self.order[middle], nth, self.length)
            up = found <= asked[left] if after else found < asked[left]
            low[left[up]], high[left[~up]] = middle[up] + 1, middle[~up]
            left = left[low[left] < high[left]]
        return low

    def merged(self, other: Level) -> Level:
        """Both in one; no window is in both."""
        where = self.scan(other.text, other.order)[0] + np.arange(len(other.order))
        out = Level.__new__(Level)
        out.text, out.length = np.append(self.text, other.text), self.length
        mine = np.ones(len(self.order) + len(other.order), bool)
        mine[where] = False
        out.order, out.head = np.empty(len(mine), np.int64), np.empty(len(mine), np.uint64)
        out.order[mine], out.order[where] = self.order, other.order + len(self.text)
        out.head[mine], out.head[where] = self.head, other.head
        return out


class Family:
    """Suffix arrays, no two of similar size."""

    def __init__(self, length: int):
        self.levels: list[Level] = []
        self.length = length

    def take(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which windows of a batch (starts in ascending order) occur earlier, in it or before it; the batch becomes part of the family."""
        text = np.append(text, np.zeros(8, np.uint8))
        order, again = suffix_array(text, at, self.length)
        new = np.ones(len(order), bool)
        for level in self.levels:
            new[new] = ~level.scan(text, order[new])[1]
        again[np.searchsorted(at, order[~new])] = True
        if new.any():
            level = Level(text, order[new], self.length)
            while self.levels and len(self.levels[-1].order) <= len(level.order):
                level = self.levels.pop().merged(level)
            self.levels.append(level)
        return again


def _scan(length: int, most: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts("suffixes")
        shards: dict[int, list] = {}
        for x in batches:
            for row in zip(*(x.column(i).to_pylist() for i in range(8))):
                if row[7]:
                    shards.setdefault(row[1], []).append(row)
                else:
                    at, low, size = np.frombuffer(row[4], "<i4"), np.frombuffer(row[5], "<i8"), np.frombuffer(row[6], "<i4")
                    yield from _intervals(np.full(len(at), row[0]), at, low, low + size)
        for rows in shards.values():
            yield from _one_shard(rows, length, most)

    return scan


def _one_shard(rows: list, length: int, most: int) -> Iterator[pa.RecordBatch]:
    take = lambda i, kind: np.concatenate([np.frombuffer(r[i], kind) for r in rows])
    tie, doc, row, start, size = take(2, "<u8"), take(3, "<i8"), take(4, "<i4"), take(5, "<i8"), take(6, "<i4").astype(np.int64)
    whole = b"".join(r[7] for r in rows)
    data = np.frombuffer(whole, np.uint8)
    batch = np.repeat([r[0] for r in rows], [len(r[4]) // 4 for r in rows])
    rows.clear()
    offset = np.cumsum(size) - size
    order, family, seen = np.lexsort((start, row, tie, doc)), Family(length), set()
    first = np.ones(len(order), bool)  # stretches whose bytes come for the first time; the others are repeats as a whole
    for i, (a, n) in enumerate(zip(offset[order].tolist(), size[order].tolist())):
        before = len(seen)
        seen.add(whole[a : a + n])
        first[i] = len(seen) > before
    seen.clear()
    same = order[~first]
    if len(same):
        yield from _intervals(batch[same], row[same], start[same], start[same] + size[same])
    order = order[first]
    for a in range(0, len(order), most):
        at = order[a : a + most]
        sizes = size[at]
        begin = np.cumsum(sizes) - sizes
        counts = sizes - length + 1  # windows of each stretch
        hit = family.take(data[ranges(offset[at], sizes)], ranges(begin, counts))
        # runs of repeated windows within a stretch become intervals of bytes
        owner = np.repeat(np.arange(len(at)), counts)
        edge = np.ones(len(hit), bool)
        edge[1:] = (hit[1:] != hit[:-1]) | (owner[1:] != owner[:-1])
        heads = np.flatnonzero(edge)
        tails = np.append(heads[1:], len(hit)) - 1
        heads, tails = heads[hit[heads]], tails[hit[heads]]
        if not len(heads):
            continue
        own = owner[heads]
        nth = np.cumsum(counts) - counts
        low = start[at][own] + heads - nth[own]
        high = start[at][own] + tails - nth[own] + length
        yield from _intervals(batch[at][own], row[at][own], low, high)


def _intervals(batch, row, low, high) -> Iterator[pa.RecordBatch]:
    order = np.argsort(batch, kind="stable")
    cuts = np.flatnonzero(np.diff(batch[order], prepend=-1))
    out = [(int(batch[x[0]]), *(v[x].astype("<i8").tobytes() for v in (row, low, high))) for x in np.split(order, cuts[1:])]
    yield pa.RecordBatch.from_arrays(
        [pa.array([x[i] for x in out], pa.int32() if not i else pa.binary()) for i in range(4)], ["batch", "row", "low", "high"]
    )


def _cut(length: int, keep_text: bool):
    def cut(key: tuple[pa.Scalar, ...], rows: pa.Table, found: pa.Table) -> pa.Table:
        batch = Batch(rows, length)
        row, low, high = (
            np.concatenate([np.frombuffer(x, "<i8") for x in found[c].to_pylist()]) if len(found) else np.zeros(0, np.int64)
            for c in ("row", "low", "high")
        )
        order = np.argsort(row, kind="stable")
        row, low, high = row[order], low[order], high[order]
        out = []
        for i, (_, _, text, doc_id) in enumerate(batch.docs):
            a, b = np.searchsorted(row, i, "left"), np.searchsorted(row, i, "right")
            kept, removed, spans = text, 0, 0
            if a < b:
                step = np.zeros(len(text) + 1, np.int64)
                np.add.at(step, low[a:b], 1)
                np.add.at(step, high[a:b], -1)
                gone = np.cumsum(step[:-1]) > 0
                removed = int(gone.sum())
                spans = int((gone & ~np.append(False, gone[:-1])).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            out.append((doc_id, len(text), removed, spans, hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if keep_text else []))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])]
        columns = list(zip(*out)) if out else [[] for _ in kinds]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return cut


def dedup(docs: DataFrame, length: int = 100, keep_text: bool = False, most: int = BATCH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, kept (binary) of every row of docs (doc_id, text).

    most: stretches of a shard that get a suffix array together.
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    shards = pieces(docs, 8)
    batches = pieces(docs, 4)
    of = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("batch")
    dealt = docs.select("doc_id", F.col("text").cast("binary").alias("text"), of)
    grouped = dealt.groupBy("batch")
    asked = grouped.applyInArrow(_ask(shards, length), "batch int, shard int, keys binary")
    answers = asked.repartitionById(shards, F.col("shard")).mapInArrow(_answer, "batch int, shard int, bits binary")
    sent = grouped.cogroup(answers.groupBy("batch")).applyInArrow(
        _send(shards, length), "batch int, shard int, tie binary, doc binary, row binary, start binary, size binary, data binary"
    )
    found = sent.repartitionById(shards, F.col("shard")).mapInArrow(_scan(length, most), "batch int, row binary, low binary, high binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    return grouped.cogroup(found.groupBy("batch")).applyInArrow(_cut(length, keep_text), schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
