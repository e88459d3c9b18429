"""WARC archives as Zstandard streams: a dictionary in a leading skippable frame, then one frame per record.

Writing: pages are dealt to archives of about `mb` MB of text; each archive trains a dictionary on its first records, puts
it into a skippable frame (magic 0x184D2A5D) and compresses every record into a frame of its own. The frames leave Python as
rows; Spark's text writer lays them out, with an empty skippable frame as its separator, which every Zstandard reader skips.
So archives are committed like any other Spark output: a lost task leaves nothing behind, and any file system works.

Reading: the frames are walked without decompressing more than one record at a time; the dictionary is loaded from the
leading frame, and each record must have a version line, the mandatory headers and exactly the length it states.

Defined results: a null html is an empty payload; a null page_id keeps its record (id '-') and never beats a number as
response; rows that repeat the smallest page_id are all responses; archives of an empty table hold no record;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grouped_join, pieces, scratch_path, table, written

DICT_MAGIC = 0x184D2A5D
#: An empty skippable frame, the separator between rows in the files.
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
MIN_REVISIT = 100
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: Dictionaries are trained on at most this many bytes of an archive's first records.
DICT_SAMPLE, DICT_SIZE = 1 << 20, 1 << 15


class WarcError(ValueError):
    """A record or frame that breaks the format."""


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header of the full payload but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "-" if page_id is None else str(page_id)
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", "".join((url or "about:blank").split())),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if revisit:
        head.append(("WARC-Refers-To", f"<urn:page:{'-' if refers_to is None else refers_to}>"))
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; raises WarcError where version, headers or lengths are wrong."""
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not raw.startswith(b"WARC/1."):
        raise WarcError("no WARC header")
    headers: dict[str, str] = {}
    for line in raw[:end].decode("utf-8").split("\r\n")[1:]:
        key, sep, value = line.partition(":")
        if not sep or key in headers:
            raise WarcError(f"bad header line {line[:80]!r}")
        headers[key] = value.strip()
    if missing := [k for k in MANDATORY if k not in headers]:
        raise WarcError(f"no {', '.join(missing)}")
    if not headers["Content-Length"].isdigit():
        raise WarcError("Content-Length is not a number")
    size = int(headers["Content-Length"])
    if len(raw) != end + 4 + size + 4 or not raw.endswith(b"\r\n\r\n"):
        raise WarcError(f"the record has {len(raw) - end - 8} bytes, its header says {size}")
    return headers, raw[end + 4 : end + 4 + size]


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time, each decompressed from a frame of its own."""
    view, at, dictionary = memoryview(data), 0, None
    decoder = zstandard.ZstdDecompressor()
    while at < len(view):
        if len(view) - at < 8:
            raise WarcError("the archive ends within a frame")
        magic, size = struct.unpack_from("<II", view, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if at + 8 + size > len(view):
                raise WarcError("the archive ends within a frame")
            if magic == DICT_MAGIC and at == 0:
                body = bytes(view[8 : 8 + size])
                if body[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may be compressed itself
                    body = zstandard.ZstdDecompressor().decompress(body)
                dictionary = zstandard.ZstdCompressionDict(body)
                decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
            at += 8 + size
            continue
        end = _frame_end(view, at)
        try:
            raw = decoder.decompressobj().decompress(view[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"bad frame at {at}: {e}") from e
        at = end
        yield raw


def _frame_end(view: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends, from its header and the headers of its blocks; nothing is copied."""
    if bytes(view[at : at + 4]) != b"\x28\xb5\x2f\xfd":
        raise WarcError(f"no frame at {at}")
    try:
        about, pos = view[at + 4], at + 5
        single = about >> 5 & 1
        pos += (0 if single else 1) + (0, 1, 2, 4)[about & 3] + (single, 2, 4, 8)[about >> 6]
        last = 0
        while not last:
            head = view[pos] | view[pos + 1] << 8 | view[pos + 2] << 16
            last, kind = head & 1, head >> 1 & 3
            if kind == 3:
                raise WarcError(f"bad block at {pos}")
            pos += 3 + (1 if kind == 1 else head >> 3)
    except IndexError as e:
        raise WarcError("the archive ends within a frame") from e
    pos += 4 * (about >> 2 & 1)
    if pos > len(view):
        raise WarcError("the archive ends within a frame")
    return pos


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(DICT_SIZE, samples) if len(samples) >= 16 else None
    except zstandard.ZstdError:  # too little to learn from
        return None


def _archive(date: str, level: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, waiting, held = None, [], 0

        def pack(raws: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([packer.compress(x) for x in raws], pa.binary())], ["frame"])

        for batch in batches:
            raws = [
                record(p, u, (h or "").encode(), n, d, r, kind == "revisit", date)
                for p, u, h, n, d, r, kind in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True)
            ]
            if packer is None:
                waiting += raws
                held += sum(map(len, raws))
                if held < DICT_SAMPLE:
                    continue
                raws, waiting, packer, lead = waiting, [], *_start(waiting, level)
                yield lead
            if raws:
                yield pack(raws)
        if waiting:
            packer, lead = _start(waiting, level)
            yield lead
            yield pack(waiting)

    return encode


def _start(raws: list[bytes], level: int):
    sample, size = [], 0
    for x in raws:
        if size >= DICT_SAMPLE:
            break
        sample.append(x[: DICT_SIZE * 2])
        size += len(sample[-1])
    learned = _dictionary(sample)
    body = learned.as_bytes() if learned else b""
    packer = zstandard.ZstdCompressor(level=level, dict_data=learned, write_content_size=True, write_checksum=True) if learned else (
        zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True)
    )
    lead = struct.pack("<II", DICT_MAGIC if learned else 0x184D2A50, len(body)) + body
    return packer, pa.RecordBatch.from_arrays([pa.array([lead], pa.binary())], ["frame"])


def with_revisits(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to, record_type.

    The response of a payload of at least 100 bytes is its smallest page_id. Minima are taken per map task first, so a
    payload that a third of all pages share is no group in one task; who revisits what is found on rows without html, and
    html moves once, to `parts` partitions by page_id.
    """
    html = F.coalesce("html", F.lit(""))
    size, digest = F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest")
    # null page_ids are told apart by their payloads, so that they are no one group
    key = F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("-"), F.sha2(html, 256))).alias("_key")
    narrow = written(pages.select(key, "page_id", size, digest).where(F.col("payload_bytes") >= MIN_REVISIT).drop("payload_bytes"), "payloads")
    groups = narrow.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1")
    again = grouped_join(narrow, written(groups, "groups"), "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    found = again.groupBy("_key").agg(F.map_from_entries(F.collect_set(F.struct("payload_digest", "first"))).alias("_first"))
    sized = pages.select(key, "page_id", "url", "html", size, digest)
    if parts:
        sized, found = sized.repartition(parts, "_key"), found.repartition(parts, "_key")
    joined = sized.join(found.hint("merge"), "_key", "left")
    hit = F.map_contains_key("_first", F.col("payload_digest"))
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest", F.when(hit, F.col("_first")[F.col("payload_digest")]).alias("refers_to"),
        F.when(hit, "revisit").otherwise("response").alias("record_type"),
    )


def write_archives(pages: DataFrame, path: str, mb: float = 8, date: str = "2024-01-01T00:00:00Z", level: int = 3) -> None:
    """Write a record per row of `pages` (page_id, url, html) into archives of about `mb` MB of estimated input below `path`."""
    rows = with_revisits(pages, pieces(pages, mb, 1))
    made = rows.mapInArrow(_archive(date, level), "frame binary")
    made.select(F.col("frame").cast("string")).write.option("lineSep", EMPTY_FRAME.decode("latin-1")).text(path)


SCHEMA = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "valid boolean"
)


def _page(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name.lstrip("-").isdigit() else None


def _decode(with_payload: bool):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("valid", pa.bool_()),
        ])
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for raw in frames(data.as_buffer().to_pybytes()):
                    headers, block = parse_record(raw)
                    head, _, payload = block.partition(b"\r\n\r\n")
                    stated = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    kind, digest = headers["WARC-Type"], headers.get("WARC-Payload-Digest", "").removeprefix("sha256:")
                    good = kind == "revisit" or (len(payload) == stated and hashlib.sha256(payload).hexdigest() == digest)
                    rows.append((
                        _page(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), payload if with_payload else None, stated,
                        digest, kind, _page(headers.get("WARC-Refers-To")), good,
                    ))
                    held += len(raw) if with_payload else 256
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return decode


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives below `path`; `valid` says whether length and digest of its payload hold."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_decode(with_payload), SCHEMA)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    back = read_archives(spark, path, with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")
