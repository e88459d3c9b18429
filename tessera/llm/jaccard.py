"""Exact n-gram Jaccard join by PartEnum signatures.

A document's set is its distinct 5-word shingles. Sets are put into bands of sizes in which a set can match only its own and
the next band. Each band and the one above it are an instance of PartEnum: the feature domain is cut into first-level
partitions, each of these into second-level ones, and a set's signatures are the hashes of what it has in every subset of all
but one second-level partition of a first-level one. Matching sets of an instance differ in at most a third of the smaller
one; with more first-level partitions than half of that, at least one of them differs in one element or none, and then the
subset that leaves out the place of this element is equal in both sets.

Subsets without elements are no signatures. A set that has too few first-level partitions with elements in two or more
places for the argument above is not covered; it sends signatures under a second, third, ... independent partitioning, too.
A pair that is missed under one partitioning has both of its sets uncovered there, so both send more; after SEEDS
partitionings the uncovered sets send the shingles of a prefix filter, which misses nothing. So no set needs a scan.

Before that, sets that cannot match are left out. A linked set shares three quarters of its shingles at least. The shingles
of a hash class (two fifths of all) are counted; a set with more than a quarter of its shingles in this class that no other
set has is linked with nothing. It sends some bytes for each of them and no signature.

Sets that share a signature form a list. Lists are cut into blocks of bounded size; each is compared exactly in one task,
which gives a spanning forest, so thousands of near copies cost no pairs among them. A first round compares each document with
those of its longest list that have it for theirs, too, and with one member of the list; a second looks at every list (and every two blocks of a list) whose
documents are not yet connected. There, sketches (element counts by hash bucket) bound the common elements from above. Only
documents that may match by that bound are compared, once for all lists: those that such possible links connect go to one
task, or, where they are many, block by block. Both rounds together miss no link.

One task holds the ids (20 bytes each) of those that share one signature, but never their texts.

Shingles and equal texts are told apart by hashes of 64 and 256 bits: results are exact up to collisions of these.

Defined results: null texts and texts without words have no shingles and are linked with nothing; null doc_ids get a null
component; rows that repeat a doc_id are one node, linked by any of their texts; equal texts are collapsed first; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HAS_WORD, components, grouped_join, mixed as _mix, pieces, ranges, side, sliced, starts, table, word_codes, written

SHINGLE = 5
#: Independent partitionings before the prefix filter.
SEEDS = 8
#: Sets up to this size have a second-level partition for (about) each element, larger ones THIRDS of them.
FINE, THIRDS = 66, 3
#: A block of a list has at most so many documents, and so many shingles if its documents were all as long as the longest.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19
#: Of 256 hash classes of shingles, those that are counted before signatures are made.
CLASSES = 102
BUCKETS = 256
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_32 = np.uint64(32)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def _codes(raw: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """A code for each word, without regard to case."""
    out = np.zeros(len(heads), np.uint64)
    for a in range(0, len(heads), 1 << 16):
        head, tail = heads[a : a + (1 << 16)], tails[a : a + (1 << 16)]
        part = raw[head[0] : tail[-1]]
        out[a : a + (1 << 16)] = word_codes(_LOWER[part[_IS_WORD[part]]], tail - head)
    return _mix(out)


def sets_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the 5-word shingles of each text, one text after another, and how many each text has.

    A text of fewer words has one shingle, the whole sequence; one without words has none.
    """
    raw = np.frombuffer(b"\n".join([b"", *(t or b"" for t in texts), b""]), np.uint8)
    word = _IS_WORD[raw]
    heads = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    tails = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    ends = np.cumsum([len(t or b"") + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    upto = np.searchsorted(heads, ends, "right")
    words = np.diff(upto, prepend=0)
    codes = _codes(raw, heads, tails) if len(heads) else np.zeros(0, np.uint64)
    counts = np.where(words >= SHINGLE, words - SHINGLE + 1, words > 0)
    stops = np.cumsum(counts)
    begins = stops - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    long = words >= SHINGLE
    n = len(codes) - SHINGLE + 1
    if long.any():
        chain = np.full(n, SHINGLE, np.uint64)
        for k in range(SHINGLE):
            chain = _mix(chain * _A + codes[k : k + n])
        inside = np.arange(n) + SHINGLE <= np.repeat(upto, words)[:n]
        out[np.repeat(long, counts)] = chain[inside]
    for i in np.flatnonzero((words > 0) & ~long).tolist():
        value = np.full(1, words[i], np.uint64)
        for c in codes[upto[i] - words[i] : upto[i]]:
            value = _mix(value * _A + c)
        out[begins[i]] = value[0]
    for a, b in zip(begins.tolist(), stops.tolist()):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[begins[counts > 0]] = True
    total = np.append(0, np.cumsum(keep))
    return out[keep], total[stops] - total[begins]


def shingles(text: bytes | None) -> np.ndarray:
    return sets_of([text])[0]


def bands(top: int) -> np.ndarray:
    """The least size of each band: a set matches sets of its own band and of its neighbours only."""
    most, out = 3, [1]
    while most < top:
        out.append(most + 1)
        most = 4 * most // 3
    return np.array([*out, most + 1])


_BANDS = bands(1 << 30)
#: First- and second-level partitions of the instance of each band and the one above it.
_FIRST = np.maximum(1, -(-(_BANDS[1:] - 1) // 5))
_SECOND = np.where(_BANDS[1:] - 1 <= FINE, 1 << 12, THIRDS)


def _under(elements: np.ndarray, begin: np.ndarray, size: np.ndarray, band: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets under one partitioning, the set of each, and each set's first-level partitions that count."""
    h, owner = elements[ranges(begin, size)], np.repeat(np.arange(len(size)), size)
    where = h
    if seed:
        where = _mix(h + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        order = np.lexsort((where, owner))
        where, h = where[order], h[order]
    second = np.repeat(_SECOND[band], size)
    place = (((where >> _32) * (np.repeat(_FIRST[band], size) * second).astype(np.uint64)) >> _32).astype(np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    cells = np.flatnonzero(new)
    held = np.add.reduceat(_mix(h ^ _B), cells)
    of, part = owner[cells], place[cells] // second[cells]
    edge = np.ones(len(cells), bool)
    edge[1:] = (part[1:] != part[:-1]) | (of[1:] != of[:-1])
    parts = np.flatnonzero(edge)
    n = np.diff(np.append(parts, len(cells)))
    every, salt = np.add.reduceat(held, parts), _mix(((band + 1) * SEEDS + seed).astype(np.uint64) * _A)
    good = n > 1
    one = np.repeat(good, n)  # all but one place of a first-level partition
    left = (np.repeat(every, n) - held)[one] + salt[of[one]]
    whole = n < _SECOND[band][of[parts]]  # the place left out is an empty one
    keys = _mix(np.concatenate([left, every[whole] + salt[of[parts[whole]]]]))
    return keys, np.concatenate([of[one], of[parts[whole]]]), np.bincount(of[parts[good]], minlength=len(size))


def signatures(elements: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets that lie one after another in `elements`, and the set of each."""
    begin, some = np.cumsum(counts) - counts, np.flatnonzero(counts)
    own = np.searchsorted(_BANDS, counts, "right") - 1
    above = some[own[some] > 0]
    # as the smaller set of a pair it differs from the other in a third of its size, as the larger one in two sevenths
    who, band = np.concatenate([some, above]), np.concatenate([own[some], own[above] - 1])
    need = np.concatenate([counts[some] // 3 // 2, 2 * counts[above] // 7 // 2])
    keys, docs = [], []
    for seed in range(SEEDS):
        if not len(who):
            break
        key, of, good = _under(elements, begin[who], counts[who], band, seed)
        keys.append(key), docs.append(who[of])
        open_ = good <= need
        who, band, need = who[open_], band[open_], need[open_]
    if len(who):
        size = counts[who] // 4 + 1
        salt = np.repeat(_mix((band + 1).astype(np.uint64) * _B), size)
        keys.append(_mix(elements[ranges(begin[who], size)] + salt)), docs.append(np.repeat(who, size))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(docs)


def linked(a: int, b: int, both: int) -> bool:
    return 100 * both >= 75 * (a + b - both)


def _raw(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.large_binary()).to_pylist()


def _batch(kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))


def _by_shard(shard: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
    return [(int(shard[at[0]]), at) for at in np.split(order, cuts[1:])] if len(order) else []


# --- sets that can match nothing ----------------------------------------------------------------------------------------

_ASKED = {"shard": pa.int32(), "slice": pa.int64(), "tags": pa.binary(), "local": pa.binary(), "docs": pa.binary(), "sizes": pa.binary()}
_SEVERAL = 0xFFFF


def _ask(shards: int):
    """For each slice of documents, a row per shard with the counted shingles (by tag) and the document of each.

    A shingle of several documents of the slice is sent once and without a document, so a common line costs a row a slice.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts("jaccard")
        number = TaskContext.get().partitionId() << 32
        for batch in sliced(batches, "text"):
            elements, counts = sets_of(_raw(batch.column(1)))
            chosen = np.flatnonzero((elements & np.uint64(255)) < CLASSES)
            local = np.repeat(np.arange(len(counts)), counts)[chosen].astype("<u2")
            order = np.argsort(elements[chosen])
            h, local = elements[chosen][order], local[order]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            local[:-1][~first[1:]] = _SEVERAL
            h, local = h[first], local[first]
            tags, rows = (h >> _32).astype("<u4"), []
            for shard, at in _by_shard(((h >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.int64) % shards):
                rows.append((shard, number, tags[at].tobytes(), local[at].tobytes(), b"", b""))
            docs = np.array(batch.column(0).to_pylist(), "<i8")
            rows.append((number % shards, number, b"", b"", docs.tobytes(), counts.astype("<i8").tobytes()))
            yield _batch(_ASKED, rows)
            number += 1

    return ask


_ANSWERED = {"slice": pa.int64(), "alone": pa.binary(), "docs": pa.binary(), "sizes": pa.binary()}


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each slice, how many shingles of this shard each of its documents has alone."""
    held: dict[int, list] = {}
    for batch in batches:
        about = []
        for shard, number, tags, local, docs, sizes in zip(*(c.to_pylist() for c in batch.columns)):
            if docs:
                about.append((number, b"", docs, sizes))
            else:
                held.setdefault(shard, []).append((number, np.frombuffer(tags, "<u4"), np.frombuffer(local, "<u2")))
        if about:
            yield _batch(_ANSWERED, about)
    for rows in held.values():
        tags, local = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
        order = np.argsort(tags)
        ordered = tags[order]
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = ordered[1:] == ordered[:-1]
        alone = np.zeros(len(order), bool)
        alone[order] = ~(same[1:] | same[:-1])
        alone &= local != _SEVERAL
        out, at = [], 0
        for number, mine, _ in rows:
            part = slice(at, at + len(mine))
            at += len(mine)
            out.append((number, np.bincount(local[part][alone[part]]).astype("<u2").tobytes(), b"", b""))
        yield _batch(_ANSWERED, out)


def _stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id of the documents of each slice that may be linked."""
    alone: dict[int, np.ndarray] = {}
    known = {}
    for batch in batches:
        for number, counts, docs, sizes in zip(*(c.to_pylist() for c in batch.columns)):
            if docs:
                known[number] = (np.frombuffer(docs, "<i8"), np.frombuffer(sizes, "<i8"))
                continue
            counts, sum_ = np.frombuffer(counts, "<u2"), alone.setdefault(number, np.zeros(0, np.int64))
            if len(sum_) < len(counts):
                sum_ = alone[number] = np.append(sum_, np.zeros(len(counts) - len(sum_), np.int64))
            sum_[: len(counts)] += counts
    for number, (docs, sizes) in known.items():
        sum_ = alone.get(number, np.zeros(0, np.int64))
        sum_ = np.append(sum_, np.zeros(len(docs) - len(sum_), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(docs[(sum_ <= sizes // 4) & (sizes > 0)])], ["doc_id"])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id of the documents (doc_id, text) that share enough shingles with others to be linked."""
    shards = pieces(docs, 24)
    asked = docs.mapInArrow(_ask(shards), "shard int, slice long, tags binary, local binary, docs binary, sizes binary")
    told = asked.repartitionById(shards, F.col("shard")).mapInArrow(_answer, "slice long, alone binary, docs binary, sizes binary")
    return told.repartition(shards, "slice").mapInArrow(_stay, "doc_id long").distinct()


# --- lists --------------------------------------------------------------------------------------------------------------

_EMITTED = {"shard": pa.int32(), "key": pa.binary(), "doc": pa.binary(), "size": pa.binary()}


def _emit(shards: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts("jaccard")
        for batch in sliced(batches, "text"):
            elements, counts = sets_of(_raw(batch.column(1)))
            key, of = signatures(elements, counts)
            docs = np.array(batch.column(0).to_pylist(), "<i8")
            rows = [
                (shard, key[at].tobytes(), docs[of[at]].tobytes(), counts[of[at]].astype("<i4").tobytes())
                for shard, at in _by_shard((_mix(key) % np.uint64(shards)).astype(np.int64))
            ]
            yield _batch(_EMITTED, rows)

    return emit


_LISTED = {"name": pa.binary(), "part": pa.int32(), "m": pa.int32(), "pivot": pa.int64(), "docs": pa.list_(pa.int64())}


def _lists(block: int):
    return lambda batches: _listed(batches, block)


def _listed(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Documents that share a signature, in blocks: name of the list, block, size of the list, a document of it, documents."""
    shards: dict[int, list] = {}
    for batch in batches:
        for shard, *row in zip(*(c.to_pylist() for c in batch.columns)):
            shards.setdefault(shard, []).append([np.frombuffer(x, kind) for x, kind in zip(row, ("<u8", "<i8", "<i4"))])
    for rows in shards.values():
        key, doc, size = (np.concatenate([r[i] for r in rows]) for i in range(3))
        rows.clear()
        order = np.argsort(key)
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = key[order[1:]] == key[order[:-1]]
        order = order[same[1:] | same[:-1]]
        order = order[np.lexsort((doc[order], size[order], key[order]))]
        key, doc, size = key[order], doc[order], size[order].astype(np.int64)
        if len(key):
            yield from _named(*_once(key, doc, size), block)


def _once(key: np.ndarray, doc: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Without repeated rows."""
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (size[1:] != size[:-1])
    return key[keep], doc[keep], size[keep]


def _named(key: np.ndarray, doc: np.ndarray, size: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    edge = np.ones(len(key), bool)
    edge[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(edge)
    m = np.diff(np.append(begin, len(key)))
    near = np.zeros(len(key), bool)  # may it match the one before it?
    near[1:] = ~edge[1:] & (4 * size[:-1] >= 3 * size[1:]) & (doc[1:] != doc[:-1])
    names = np.stack([np.add.reduceat(_mix(doc.astype(np.uint64) + c), begin) + m.astype(np.uint64) for c in (_A, _B)], 1)
    order = np.lexsort((names[:, 1], names[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (names[order[1:]] != names[order[:-1]]).any(1)
    wanted = np.zeros(len(begin), bool)
    wanted[order[new]] = True
    wanted &= np.logical_or.reduceat(near, begin)
    most = np.clip(BLOCK_SHINGLES // np.maximum.reduceat(size, begin), 2, block)
    short = np.flatnonzero(wanted & (m <= most))
    for a in range(0, len(short), 50_000):
        at = short[a : a + 50_000]
        flat = pa.array(doc[ranges(begin[at], m[at])])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(m[at])), pa.int32()), flat)
        title = pa.array([x.tobytes() for x in names[at]], pa.binary())
        none = pa.nulls(len(at), pa.int64())
        columns = [title, pa.array(np.zeros(len(at), np.int32)), pa.array(m[at].astype(np.int32)), none, lists]
        yield pa.RecordBatch.from_arrays(columns, list(_LISTED))
    for i in np.flatnonzero(wanted & (m > most)).tolist():
        members, title = doc[begin[i] : begin[i] + m[i]], names[i].tobytes()
        for part, a in enumerate(range(0, len(members), int(most[i]))):
            yield _batch(_LISTED, [(title, part, len(members), members[len(members) // 2], members[a : a + most[i]])])


# --- comparing ----------------------------------------------------------------------------------------------------------

#: Elements of a list that are sorted together when sets are compared.
PIECE = 1 << 20


def _pieces_of(sets: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Elements of all sets in sorted pieces of bounded size, with the position of the set that each belongs to."""
    out, start, size = [], 0, 0
    for i, s in enumerate(sets):
        size += len(s)
        if size >= PIECE or i + 1 == len(sets):
            flat = np.concatenate(sets[start : i + 1])
            owner = np.repeat(np.arange(start, i + 1, dtype=np.int32), [len(x) for x in sets[start : i + 1]])
            by = np.argsort(flat)
            out.append((flat[by], owner[by]))
            start, size = i + 1, 0
    return out


def forest(sets: list[np.ndarray], roots: np.ndarray | None = None) -> np.ndarray:
    """Root (a position) of each set under the links of the list. Only sets of different trees are ever compared.

    roots: trees that are known before.
    """
    n = len(sets)
    roots = np.arange(n) if roots is None else roots.copy()
    sizes = np.array([len(s) for s in sets])
    sorted_pieces = _pieces_of(sets)
    for i in range(n):
        apart = (roots != roots[i]) & (4 * np.minimum(sizes, sizes[i]) >= 3 * np.maximum(sizes, sizes[i])) & (sizes > 0)
        if not sizes[i] or not apart.any():
            continue
        both = np.zeros(n, np.int64)
        for flat, owner in sorted_pieces:
            lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            both += np.bincount(owner[ranges(lo, hi - lo)], minlength=n)
        hit = apart & (100 * both >= 75 * (sizes + sizes[i] - both))
        if hit.any():
            trees = np.append(roots[hit], roots[i])
            roots[np.isin(roots, trees)] = trees.min()
    return roots


_DESCRIBED = {"doc_id": pa.int64(), "n": pa.int64(), "sketch": pa.binary()}


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n and sketch. The sketch counts elements by hash bucket; null where a count is over 255."""
    starts("jaccard")
    for batch in sliced(batches, "text"):
        elements, counts = sets_of(_raw(batch.column(1)))
        bucket = np.repeat(np.arange(len(counts)), counts) * BUCKETS + (elements & np.uint64(BUCKETS - 1)).astype(np.int64)
        sketch = np.bincount(bucket, minlength=len(counts) * BUCKETS).reshape(-1, BUCKETS)
        raw = [x.astype(np.uint8).tobytes() if x.max() < 256 else None for x in sketch]
        yield _batch(_DESCRIBED, list(zip(batch.column(0).to_pylist(), counts.tolist(), raw)))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, a third of what the shuffle would make of them."""
    starts("jaccard")
    packer = zstandard.ZstdCompressor(level=3)
    for batch in sliced(batches, "text"):
        packed = pa.array([packer.compress(t or b"") for t in _raw(batch.column(1))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["doc_id", "packed"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one name at a time, from rows sorted by name."""
    rows: list[tuple] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                if rows and row[0] != rows[0][0]:
                    yield rows
                    rows = []
                rows.append(row)
    if rows:
        yield rows


_SCREENED = {"a": pa.int64(), "b": pa.int64(), "doc_id": pa.int64()}


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What may match by an upper bound on common elements, and is not yet in one component.

    Rows (a, b): components that such possible links connect, one row less than components in a list; and rows (a, doc_id): the
    documents at their ends, with their components. There is no row for each pair.
    """
    starts("jaccard")
    out = set()
    for rows in _grouped(batches):
        _, docs, component, n, sketch = zip(*rows)
        component, n = np.array(component), np.array(n)
        if (component == component[0]).all():
            continue
        open_end = np.array([x is None for x in sketch])
        counts = np.array([np.frombuffer(x or bytes(BUCKETS), np.uint8) for x in sketch])
        names, sizes = np.unique(component, return_counts=True)
        trees, touched = np.arange(len(docs)), np.zeros(len(docs), bool)
        # of two documents of different components, one at least is not of the largest
        for i in np.flatnonzero(component != names[sizes.argmax()]).tolist():
            near = np.flatnonzero((component != component[i]) & (4 * np.minimum(n, n[i]) >= 3 * np.maximum(n, n[i])))
            most = np.minimum(counts[i], counts[near]).sum(1, dtype=np.int64)
            may = near[(100 * most >= 75 * (n[near] + n[i] - most)) | open_end[near] | open_end[i]]
            if len(may):
                touched[i] = touched[may] = True
                joined = np.append(trees[may], trees[i])
                trees[np.isin(trees, joined)] = joined.min()
        for tree in np.unique(trees[touched]).tolist():
            ends = np.unique(component[(trees == tree) & touched]).tolist()
            out.update((ends[0], c, None) for c in ends[1:])
        out.update((int(component[i]), None, docs[i]) for i in np.flatnonzero(touched).tolist())
        if len(out) >= 100_000:
            yield _batch(_SCREENED, list(out))
            out.clear()
    if out:
        yield _batch(_SCREENED, list(out))


_LINKS = {"a": pa.int64(), "b": pa.int64()}


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, doc_id, component, packed text) sorted by name: links between each document and the root of its tree."""
    starts("jaccard")
    reader, links = zstandard.ZstdDecompressor(), []
    for rows in _grouped(batches):
        docs = [r[1] for r in rows]
        known = np.unique([r[2] for r in rows], return_inverse=True)[1]
        if len(rows) < 2 or (known == known[0]).all():
            continue
        first = np.full(len(rows), len(rows))
        np.minimum.at(first, known, np.arange(len(rows)))
        before = first[known]
        roots = forest([shingles(reader.decompress(r[3])) for r in rows], before)
        links += [(docs[r], d) for r, d, b in zip(roots.tolist(), docs, before.tolist()) if r != b and docs[r] != d]
        if len(links) > 50_000:
            yield _batch(_LINKS, links)
            links = []
    if links:
        yield _batch(_LINKS, links)


def _within(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on doc_id."""
    return docs.join(side(ids), "doc_id", how)


def _copies(known: DataFrame) -> DataFrame:
    """(doc_id, first): documents whose text another one of smaller doc_id has, too."""
    hashed = written(known.select("doc_id", F.sha2("text", 256).alias("h")), "texts")
    groups = written(hashed.groupBy("h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    return grouped_join(hashed, groups, "h").where("doc_id <> first").select("doc_id", "first")


def _sorted(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "name").sortWithinPartitions("name", "doc_id")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows with the component of their doc_id, itself without one."""
    if labels is None:
        return rows.withColumn("component", F.col("doc_id"))
    named = rows.join(side(labels.withColumnRenamed("node", "doc_id")), "doc_id", "left")
    return named.withColumn("component", F.coalesce("component", "doc_id"))


def _unsettled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, doc_id, component): lists, and two blocks of one list, whose documents are in more than one component."""
    title = F.concat("name", F.unhex(F.lpad(F.hex("part"), 8, "0"))).alias("title")
    blocks = lists.select("name", "part", title, F.col("pivot").isNotNull().alias("cut"), F.explode("docs").alias("doc_id"))
    rows = _labelled(blocks, labels)
    spans = rows.groupBy("name", "part", "title", "cut").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    spans = written(spans.where("cut or lo < hi"), "spans")
    inside = spans.where("lo < hi").select("title", F.col("title").alias("pair"))
    cut = spans.where("cut")
    one, two = (cut.select("name", *(F.col(c).alias(f"{c}_{k}") for c in ("part", "title", "lo", "hi"))) for k in "ij")
    across = one.join(two, "name").where("part_i < part_j and (lo_i < hi_i or lo_j < hi_j or lo_i <> lo_j)")
    across = across.select("title_i", "title_j", F.concat("title_i", "title_j").alias("pair"))
    ends = across.select(F.col("title_i").alias("title"), "pair").union(across.select(F.col("title_j").alias("title"), "pair"))
    return rows.join(side(written(inside.union(ends), "unsettled")), "title").select(F.col("pair").alias("name"), "doc_id", "component")


def _together(may: DataFrame, sketches: DataFrame, block: int) -> DataFrame:
    """(name, doc_id, component): documents whose components possible links connect, each group as a list, or as every two of
    its blocks. may: as `_screen` gives it."""
    groups = components(may.where("doc_id is null").select("a", "b")).select(F.col("node").alias("component"), F.col("component").alias("g"))
    ends = may.where("doc_id is not null").select("doc_id", F.col("a").alias("component"))
    rows = ends.join(side(groups), "component")
    rows = written(rows.join(side(sketches.groupBy("doc_id").agg(F.max("n").alias("n"))), "doc_id"), "together")
    half = block / 2
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / half), F.ceil(2 * F.sum("n") / BLOCK_SHINGLES)).cast("int")
    spans = rows.groupBy("g").agg(blocks.alias("k"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    k = F.when(F.col("k") == 2, 1).otherwise(F.col("k"))  # two halves are one block
    dealt = rows.join(side(written(spans.where("lo < hi").select("g", k.alias("k")), "groups")), "g")
    own = F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int")
    title = lambda *x: F.unhex(F.concat(*(F.lpad(F.hex(c), n, "0") for c, n in zip(x, (16, 8, 8)))))
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: title(F.col("g"), F.least(own, j), F.greatest(own, j)))
    return dealt.select(F.explode(pairs).alias("name"), "doc_id", "component")


def _compared(few: DataFrame, docs: DataFrame, parts: int, name: str) -> DataFrame:
    """Links found within the lists (name, doc_id, component): each text is compressed before it goes to its lists."""
    few = written(few.distinct(), f"{name}-rows")
    packed = _within(docs, few.select("doc_id").distinct(), "left_semi").select("doc_id", "text").mapInArrow(_packed, "doc_id long, packed binary")
    texts = packed.join(side(few), "doc_id").select("name", "doc_id", "component", "packed")
    return written(_sorted(texts, parts).mapInArrow(_verify, "a long, b long").distinct(), f"{name}-links")


def links(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect exactly what the Jaccard links of `docs` (doc_id, text) connect.

    block: the most documents that are compared in one task; longer lists are compared block by block.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike(HAS_WORD)).select("doc_id", "text")
    copies = written(_copies(known), "copies")
    # a doc_id of several texts stays: it may be a copy by one and not by another
    several = known.groupBy("doc_id").count().where("count > 1").select("doc_id")
    spare = written(copies.select("doc_id").distinct().join(several, "doc_id", "left_anti"), "spare")
    first = _within(known, spare, "left_anti")
    near = _within(first, written(candidates(first), "candidates"), "left_semi")
    shards, parts = pieces(docs, 24), pieces(docs, 12)
    emitted = near.mapInArrow(_emit(shards), "shard int, key binary, doc binary, size binary")
    made = emitted.repartitionById(shards, F.col("shard")).mapInArrow(_lists(block), "name binary, part int, m int, pivot long, docs array<long>")
    lists = written(made.dropDuplicates(["name", "part"]), "lists")
    # each document goes to its longest list first, and a member of middle size to all blocks of the list: for most groups of
    # near copies this connects all of them, with two rows for each document at most
    title = F.concat("name", F.unhex(F.lpad(F.hex("part"), 8, "0")))
    place = F.max(F.struct("m", "name", title.alias("title"), "hub")).alias("l")
    own = lists.select("name", "part", "m", F.coalesce("pivot", F.get("docs", F.expr("cast(size(docs) div 2 as int)"))).alias("hub"), F.explode("docs").alias("doc_id"))
    own = written(own.groupBy("doc_id").agg(place), "longest")
    few = own.select(F.col("l.title").alias("name"), "doc_id").union(own.select("l.title", "l.hub"))
    found = _compared(_labelled(few, None), near, parts, "first")
    labels = components(found)
    open_ = written(_unsettled(lists, labels), "open")
    sketches = _within(near, open_.select("doc_id").distinct(), "left_semi").mapInArrow(_described, "doc_id long, n long, sketch binary")
    sketches = written(sketches, "sketches")
    wide = open_.join(side(sketches, 100_000), "doc_id").select("name", "doc_id", "component", "n", "sketch")
    may = written(_sorted(wide, parts).mapInArrow(_screen, "a long, b long, doc_id long").distinct(), "may")
    rest = _compared(_together(may, sketches, block), near, parts, "second")
    connected = labels.where("component < node").select(F.col("component").alias("a"), F.col("node").alias("b"))  # as found, in fewer links
    return connected.union(rest).union(copies.select(F.col("first").alias("a"), F.col("doc_id").alias("b")))


def join(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs` (doc_id, text)."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        starts("jaccard")
        parts = [sets_of(_raw(x.column(0)))[1] for x in sliced([pa.record_batch([texts], ["text"])], "text")]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.int64())

    labels = components(written(links(docs, block), "links"))
    sized = docs.select("doc_id", count("text").alias("n_shingles"))
    return sized.join(side(labels.withColumnRenamed("node", "doc_id")), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that are kept: the smallest doc_id of each component, of its rows the first by content."""
    labels = components(written(links(docs), "links"))
    gone = labels.where("component < node").select(F.col("node").alias("doc_id"))
    kept = _within(docs, gone, "left_anti")
    several = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    if several.limit(1).count():
        rows = _within(kept, several, "left_semi").select("doc_id", F.struct(*docs.columns).alias("row"))
        once = rows.groupBy("doc_id").agg(F.min("row").alias("row")).select("row.*")
        kept = _within(kept, several, "left_anti").unionByName(once)
    return kept


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))
