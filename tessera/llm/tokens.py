"""Token ids in shuffled planes, with a chunk index.

Encoding: documents are range-sorted by doc_id; each range becomes one file of fixed-size id blocks. A block's ids are
transposed into byte planes (or bit planes), each plane a Zstandard frame. The last frame of a file is skippable and holds
the index: place, size and plane lengths of each block, and doc_id and length of each document. Spark's text writer lays
the rows out with an empty skippable frame as separator, so files are committed like any other output and any file system
works. A reader finds the index from the end of the file.

Tokenizing: texts are cut where the tokenizer certainly starts a new token; the ids of each piece are kept in a bounded
cache. Texts with anything unusual are encoded whole.

Defined results: null and empty texts are a single end id; null doc_ids come first; equal doc_ids stay together, ordered by
content; repeated rows are written each; an empty table gives files without blocks; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keeps, mixed, pieces, ranges, scratch_path, sliced, starts, table, word_codes, written
from .warc import EMPTY_FRAME

INDEX_MAGIC = 0x184D2A5E
TAIL = b"BPIX"
BLOCK = 1 << 16
#: Bytes of texts that are cut: printable ASCII, space, line feed, and the letters (and two signs) from U+00C0 to U+023F.
_CUT = np.zeros(256, bool)
_CUT[[0x0A, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = True
#: Marks that make one word of the tokenizer where they follow one another; no apostrophe, which may begin one.
_MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27)
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
#: Pieces that a Python worker remembers at most, at some 40 bytes each, and how many new ones are put among them at a time.
_MOST, _FRESH = 1_500_000, 200_000
#: Bytes of text that are cut into pieces at a time.
_SLICE = 1 << 21


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _stand_ins() -> dict[int, str]:
    """Byte-level BPE works on characters that stand for bytes: printable ones for themselves, the rest in order from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    of = [chr(b) if b in plain else chr(next(other)) for b in range(0x100)]
    return {c: "".join(of[b] for b in chr(c).encode()) for c in (*range(0x20, 0x7F), *range(0xC0, 0x240))}


class _Known:
    """Pieces, told apart by two 64-bit hashes and sorted by the first, and the ids of each."""

    def __init__(self, code=(), check=(), size=(), ids=()):
        self.code, self.check = np.array(code, np.uint64), np.array(check, np.uint64)
        self.size, self.ids = np.array(size, np.int32), np.array(ids, np.uint32)
        self.start = (np.cumsum(self.size) - self.size).astype(np.int32)

    def find(self, code: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the asked pieces are here, and where those are."""
        if not len(self.code):
            return np.zeros(len(code), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        hit = (self.code[at] == code) & (self.check[at] == check)
        return hit, at[hit]

    def add(self, other: _Known) -> None:
        start = np.append(self.start, other.start + np.int32(len(self.ids)))
        code = np.append(self.code, other.code)
        order = np.argsort(code)
        self.code, self.check, self.start = code[order], np.append(self.check, other.check)[order], start[order]
        self.size, self.ids = np.append(self.size, other.size)[order], np.append(self.ids, other.ids)


class Encoder:
    """Texts to ids, equal to the tokenizer's own for byte-level BPE without a prefix space.

    A single space or line feed between printable characters begins a token, and so does a comma or full stop at the end of
    a piece, after a letter or digit. Texts are cut there, many at once; each different piece of a slice is looked up once.
    Texts with other white space, or with characters beyond U+023F, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.stand_ins = self.tokenizer.model, _stand_ins()
        if hasattr(self.model, "_resize_cache"):  # pieces are remembered here; a small second cache costs more than it saves
            self.model._resize_cache(0)
        self.old, self.fresh = _Known(), _Known()
        self.signs = [np.frombuffer(self.whole(x), "<u4") for x in (",", ".", "\n")]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, text: str) -> array:
        """Ids of a piece. A run of letters, or of marks after them, is a word of its own to the tokenizer: its model is asked directly."""
        letters = text.rstrip(_MARKS)
        if letters[1:].isalpha() and (letters[0] == " " or letters[0].isalpha()):
            parts = (letters, text[len(letters) :]) if len(letters) < len(text) else (text,)
            return array("I", [t.id for p in parts for t in self.model.tokenize(p.translate(self.stand_ins))])
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _looked_up(self, code: np.ndarray, check: np.ndarray, piece) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces, one piece after another, and how many each has. piece(i): the text of the i-th."""
        size, sources, left = np.zeros(len(code), np.int64), [], np.arange(len(code))
        for known in (self.old, self.fresh):
            hit, at = known.find(code[left], check[left])
            size[left[hit]] = known.size[at]
            sources.append((left[hit], known.ids, known.start[at]))
            left = left[~hit]
        made, sizes = array("I"), []
        for i in left.tolist():
            ids = self._piece(piece(i))
            made += ids
            sizes.append(len(ids))
        size[left] = sizes
        new = _Known(code[left], check[left], sizes, made)
        sources.append((left, new.ids, new.start))
        out, place = np.empty(int(size.sum()), np.uint32), np.cumsum(size) - size
        for who, ids, start in sources:
            out[ranges(place[who], size[who])] = ids[ranges(start.astype(np.int64), size[who])]
        self.fresh.add(new)
        if len(self.fresh.code) > _FRESH:
            if len(self.old.code) > _MOST:
                self.old = _Known()
            self.old.add(self.fresh)
            self.fresh = _Known()
        return out, size

    def encode(self, texts: list[bytes | None], end: bytes = b"") -> list[np.ndarray]:
        """Ids of each text (UTF-8), each followed by those in `end`."""
        out = [np.frombuffer(end, "<u4")] * len(texts)
        some = [i for i, t in enumerate(texts) if t]
        if not some:
            return out
        raw = np.frombuffer(b"\n".join([b"", *(texts[i] for i in some), b""]), np.uint8)
        stops = np.cumsum([len(texts[i]) + 1 for i in some])  # place of the line feed after each text
        blank = (raw == 0x0A) | (raw == 0x20)
        odd = ~_CUT[raw]
        odd[1:] |= blank[1:] & blank[:-1]
        odd[:-1] |= blank[1:] & blank[:-1]
        odd[0] = False
        odd[stops] = False
        cut = np.add.reduceat(odd, np.append(1, stops[:-1] + 1)) == 0
        for i, good in zip(some, cut.tolist()):
            if not good:
                out[i] = np.frombuffer(self.whole(texts[i].decode()) + end, "<u4")
        if cut.any():
            ids, counts = self._cut(raw, blank, stops, cut, end)
            for i, part in zip((i for i, good in zip(some, cut.tolist()) if good), np.split(ids, np.cumsum(counts)[:-1])):
                out[i] = part
        return out

    def _cut(self, raw: np.ndarray, blank: np.ndarray, stops: np.ndarray, cut: np.ndarray, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts that can be cut, and how many each has."""
        heads = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
        tails = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
        text = np.searchsorted(stops, heads)
        mine = cut[text]
        heads, tails, text = heads[mine], tails[mine], text[mine]
        last, before, lead = raw[tails - 1], raw[tails - 2], raw[np.maximum(tails, 3) - 3]
        letter = _ALNUM[before] | ((before >= 0x80) & ~((lead == 0xC3) & ((before == 0x97) | (before == 0xB7))))
        sign = np.where((tails - heads > 1) & letter, np.where(last == 0x2C, 0, np.where(last == 0x2E, 1, 4)), 4)
        size = tails - heads - (sign < 4)
        spaced = raw[heads - 1] == 0x20
        code = mixed(word_codes(raw[ranges(heads, size)], size) * np.uint64(2) + spaced)
        eight = np.lib.stride_tricks.sliding_window_view(np.append(raw, np.zeros(8, np.uint8)), 8)
        front, back = (eight[x].view("<u8")[:, 0] for x in (heads, np.maximum(heads, heads + size - 8)))
        short = np.uint64(8) * (np.uint64(8) - np.minimum(size, 8).astype(np.uint64))
        check = mixed(((front << short) >> short) + size.astype(np.uint64)) + ((back << short) >> short)
        order = np.argsort(code)
        new = np.ones(len(order), bool)
        new[1:] = (code[order[1:]] != code[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
        like = np.empty(len(order), np.int64)
        like[order] = np.cumsum(new) - 1
        first, data = order[new], raw.tobytes()
        begin, stop = (heads - spaced)[first].tolist(), (heads + size)[first].tolist()
        ids, length = self._looked_up(code[first], check[first], lambda i: data[begin[i] : stop[i]].decode())
        n, more = len(first), [*self.signs, np.frombuffer(end, "<u4"), np.zeros(0, np.uint32)]
        ids, length = np.concatenate([ids, *more]), np.append(length, [len(x) for x in more])
        place = np.cumsum(length) - length
        feed = np.where(raw[tails] == 0x0A, 2, 4)
        feed[np.flatnonzero(np.diff(text, append=-1))] = 3  # the last piece of a text
        items = np.stack([like, n + sign, n + feed], 1)
        counts = length[items]
        of = np.bincount(text, counts.sum(1), len(cut)).astype(np.int64)[cut]
        return ids[ranges(place[items.ravel()], counts.ravel())], of


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One encoder for a Python worker, so that its pieces serve all of the worker's tasks."""
    keeps("tokens", _encoder.cache_clear)
    return Encoder(path)


def pack(ids: np.ndarray, bits: bool = False, level: int = 1) -> tuple[bytes, list[int]]:
    """One block: its planes, each compressed, and their lengths."""
    packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
    top = int(ids.max(initial=0)).bit_length()
    if bits:
        planes = [np.packbits((ids >> p) & 1) for p in range(max(1, top))]
    else:
        planes = list(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[: max(1, (top + 7) // 8)])
    out = [packer.compress(np.ascontiguousarray(p).tobytes()) for p in planes]
    return b"".join(out), [len(x) for x in out]


def unpack(block: bytes, lengths: list[int], n: int, bits: bool = False) -> np.ndarray:
    reader, at, ids = zstandard.ZstdDecompressor(), 0, np.zeros(n, np.uint32)
    for p, size in enumerate(lengths):
        plane = np.frombuffer(reader.decompress(block[at : at + size]), np.uint8)
        ids |= (np.unpackbits(plane, count=n) if bits else plane).astype(np.uint32) << np.uint32(p if bits else 8 * p)
        at += size
    return ids


def _index(part: int, bits: bool, blocks: list, docs: list) -> bytes:
    """Skippable frame: part, form, blocks (offset, ids, planes), plane lengths, documents (null flag, doc_id, length)."""
    lengths = [x for b in blocks for x in b[2]]
    flat = struct.pack("<qBIIQ", part, bits, len(blocks), len(lengths), len(docs))
    flat += np.array([(b[0], b[1], len(b[2])) for b in blocks], "<i8").tobytes() + np.array(lengths, "<i8").tobytes()
    flat += np.array([d[0] is None for d in docs], np.uint8).tobytes()
    flat += np.array([d[0] or 0 for d in docs], "<i8").tobytes() + np.array([d[1] for d in docs], "<i8").tobytes()
    body = zstandard.ZstdCompressor(level=3, write_content_size=True).compress(flat)
    body += struct.pack("<I4s", len(body), TAIL)
    return struct.pack("<II", INDEX_MAGIC, len(body)) + body


def read_index(data: memoryview) -> dict:
    end = len(data)
    while bytes(data[end - 8 : end]) == EMPTY_FRAME:
        end -= 8
    size, tail = struct.unpack("<I4s", data[end - 8 : end])
    if tail != TAIL:
        raise ValueError("no index at the end of the file")
    flat = zstandard.ZstdDecompressor().decompress(bytes(data[end - 8 - size : end - 8]))
    part, bits, nb, nl, nd = struct.unpack_from("<qBIIQ", flat)
    at, out = struct.calcsize("<qBIIQ"), {"part": part, "bits": bool(bits)}
    for name, kind, n in (("blocks", "<i8", 3 * nb), ("planes", "<i8", nl), ("null", "u1", nd), ("doc_id", "<i8", nd), ("length", "<i8", nd)):
        out[name] = np.frombuffer(flat, kind, n, at)
        at += out[name].nbytes
    out["blocks"] = out["blocks"].reshape(-1, 3)
    return out


def ids_of(data: memoryview, index: dict) -> Iterator[np.ndarray]:
    """The ids of each block."""
    lengths = np.split(index["planes"], np.cumsum(index["blocks"][:, 2])[:-1]) if len(index["blocks"]) else []
    for (offset, n, _), planes in zip(index["blocks"], lengths):
        yield unpack(bytes(data[offset : offset + planes.sum()]), planes.tolist(), int(n), index["bits"])


def _encode(path: str, end_id: int, bits: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts("tokens")
        encoder, end = _encoder(path), np.array([end_id], "<u4").tobytes()
        waiting, held, offset, blocks, docs = [], 0, 0, [], []
        frame = lambda x: pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], ["frame"])
        for batch in sliced(batches, "text", 4_000, _SLICE):
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts, end)):
                docs.append((doc_id, len(ids)))
                waiting.append(ids.tobytes())
                held += 4 * len(ids)
                if held >= 4 * BLOCK:
                    flat = b"".join(waiting)
                    cut = len(flat) // (4 * BLOCK) * (4 * BLOCK)
                    for at in range(0, cut, 4 * BLOCK):
                        body, planes = pack(np.frombuffer(flat, "<u4", BLOCK, at), bits)
                        blocks.append((offset, BLOCK, planes))
                        offset += len(body) + len(EMPTY_FRAME)
                        yield frame(body)
                    waiting, held = [flat[cut:]], len(flat) - cut
        if held:
            ids = np.frombuffer(b"".join(waiting), "<u4")
            body, planes = pack(ids, bits)
            blocks.append((offset, len(ids), planes))
            yield frame(body)
        yield frame(_index(TaskContext.get().partitionId(), bits, blocks, docs))

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, bits: bool = False, mb: float = 16) -> None:
    """Write the ids of `docs` (doc_id, text) below `path`, in ascending doc_id order, files of about `mb` MB of input."""
    ranges = docs.select("doc_id", "text").repartitionByRange(pieces(docs, mb), "doc_id")
    ordered = ranges.sortWithinPartitions("doc_id", F.xxhash64("text"))
    made = ordered.mapInArrow(_encode(tokenizer or vocabulary(), end_id, bits), "frame binary")
    made.select(F.col("frame").cast("string")).write.option("lineSep", EMPTY_FRAME.decode("latin-1")).text(path)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            data = memoryview(content.as_buffer())
            index = read_index(data)
            n, crc, docs, doc, left = index["length"], [], len(index["length"]), 0, 0
            if docs:
                crc, left = [0] * docs, int(n[0])
            for ids in ids_of(data, index):  # one block at a time; a document may go on in the next
                raw, at = ids.astype("<u4").tobytes(), 0
                while at < len(raw):
                    step = min(4 * left, len(raw) - at)
                    crc[doc] = zlib.crc32(raw[at : at + step], crc[doc])
                    at, left = at + step, left - step // 4
                    if not left and doc + 1 < docs:
                        doc, left = doc + 1, int(n[doc + 1])
            if docs:
                start = np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(docs, index["part"])), pa.array(index["doc_id"], mask=index["null"].astype(bool)), pa.array(start),
                    pa.array(n), pa.array(crc, pa.int64()),
                ], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files below `path`."""
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = written(files.mapInArrow(_rows, "part long, doc_id long, at long, n_tokens long, ids_crc32 long"), "token-rows")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(offsets, "part").select(
        "doc_id", (F.col("before") + F.col("at")).cast("long").alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame) -> DataFrame:
    """Write and read back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path)
    return read_tokens(docs.sparkSession, path)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
