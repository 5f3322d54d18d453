"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of whole WARC records, and a seek table in a skippable frame
at its end, as the seekable format of Zstandard lays down: compressed and plain size of each frame, the number of frames,
and a magic number. The index maps each record to its bundle, frame, and place in the plain frame, so that one
record costs one frame. Tasks write bundles of bounded size; a bundle counts once the index names it.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm._tables import file_system, new_file, shuffle_partitions, stored
from marketlake.plans.scratch import scratch_path

#: Payloads shorter than this are always written out.
LEAST_REVISIT = 1000
FRAME, BUNDLE = 1 << 20, 1 << 26
# Magic numbers and field widths of the Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
ENTRY, FOOTER = struct.Struct("<II"), struct.Struct("<IBI")

INDEX = "page_id long, bundle string, frame int, frame_at long, at long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def plan(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, and response: the page that holds the payload, if that is another.

    Of equal payloads of `least` bytes or more the one with the largest page_id is written out, and so are rows that repeat its
    page_id. Payloads are equal if their SHA-1 and their length are. Null html is an empty payload; a page without id never is
    the one that others refer to.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    several = (
        rows.where(F.col("size") >= least)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
        .where("n > 1 and response is not null")
        .drop("n")
    )
    other = F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return rows.join(several, ["digest", "size"], "left").select("page_id", "url", "payload", "digest", other.alias("response"))


def _safe(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, response: int | None, date: str) -> bytes:
    """One WARC 1.1 record; a revisit has the headers of its payload but not the payload."""
    name = "none" if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_safe(url) or f'urn:page:{name}'}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if response is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{response}>",
            "WARC-Truncated: length",
        ]
        payload = b""
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(ENTRY.pack(*f) for f in frames) + FOOTER.pack(len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


class _Bundles:
    """Writes records one after another and tells where each one is."""

    def __init__(self, folder: str, frame: int, bundle: int):
        self.folder, self.frame, self.bundle = folder, frame, bundle
        self.out, self.zstd = None, zstandard.ZstdCompressor(level=3)

    def add(self, page_id: int | None, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.uri, fs, path = new_file(self.folder, ".warc.zst")
            self.out, self.frames, self.written, self.rows, self.plain, self.fill = fs.open_output_stream(path, compression=None), [], 0, [], [], 0
        self.rows.append((page_id, self.uri, len(self.frames), self.written, self.fill, len(data)))
        self.plain.append(data)
        self.fill += len(data)
        if self.fill >= self.frame:
            self._end_frame()
        if self.written >= self.bundle:
            yield from self.close()

    def _end_frame(self) -> None:
        packed = self.zstd.compress(b"".join(self.plain))
        self.out.write(packed)
        self.frames.append((len(packed), self.fill))
        self.written, self.plain, self.fill = self.written + len(packed), [], 0

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            if self.plain:
                self._end_frame()
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.out = None
            yield from self.rows


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    columns = zip(*rows, strict=True) if rows else [()] * 6
    names = ["page_id", "bundle", "frame", "frame_at", "at", "length"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _writer(folder: str, frame: int, bundle: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundles = _Bundles(folder, frame, bundle)
        for b in batches:
            rows = []
            for row in zip(*b.columns, strict=True):
                page_id, url, payload, digest, response = (x.as_py() for x in row)
                rows += bundles.add(page_id, record(page_id, url, payload, digest, response, date))
            yield _index_batch(rows)
        yield _index_batch(list(bundles.close()))

    return run


def write(
    pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT, frame: int = FRAME, bundle: int = BUNDLE,
    date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Writes a record for every row of `pages` (page_id, url, html) below `folder`, and returns the stored index.

    Repeated rows give repeated records. Other columns are not written.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return stored(plan(pages, least).mapInArrow(_writer(folder, frame, bundle, date), INDEX), "warc-index")


def frames(data_size: int, tail) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame; tail(n) gives the last n bytes of the bundle."""
    count, _, magic = FOOTER.unpack(tail(FOOTER.size))
    if magic != SEEKABLE:
        raise ValueError("the bundle has no seek table")
    table = tail(FOOTER.size + count * ENTRY.size)[: count * ENTRY.size]
    at, out = 0, []
    for packed, plain in ENTRY.iter_unpack(table):
        out.append((at, packed, plain))
        at += packed
    if at + 8 + count * ENTRY.size + FOOTER.size != data_size:
        raise ValueError("the seek table does not fit the bundle")
    return out


def parse(data: memoryview, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload, and end of the record at `at`; ValueError if it is not whole."""
    size = 65536
    block = bytes(data[at : at + size])
    cut = block.find(b"\r\n\r\n")
    while cut < 0 and at + size < len(data):
        size *= 2
        block = bytes(data[at : at + size])
        cut = block.find(b"\r\n\r\n")
    lines = block[: max(cut, 0)].decode(errors="replace").split("\r\n")
    head = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    length = head.get("Content-Length", "")
    if not lines[0].startswith("WARC/") or not length.isdigit():
        raise ValueError(f"no record at byte {at}")
    start = at + cut + 4
    end = start + int(length)
    body = bytes(data[start:end])
    http, _, payload = body.partition(b"\r\n\r\n")
    declared = re.search(rb"Content-Length: (\d+)", http)
    if bytes(data[end : end + 4]) != b"\r\n\r\n" or not declared:
        raise ValueError(f"the record at byte {at} is cut off")
    head["payload-length"] = declared[1].decode()
    return head, payload, end + 4


def _page(urn: str | None) -> int | None:
    name = urn[len("<urn:page:") : -1] if urn else "none"
    return None if name == "none" else int(name)


def _row(head: dict[str, str], payload: bytes, keep: bool) -> tuple:
    kind = head["WARC-Type"]
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(head["payload-length"])):
        raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
    page, other = _page(head["WARC-Record-ID"]), _page(head.get("WARC-Refers-To"))
    url = head["WARC-Target-URI"]
    own = None if url.startswith("urn:page:") else url
    return page, int(head["payload-length"]), digest, kind, other, own, payload if keep and kind == "response" else None


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [()] * 7
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _reader(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, known, table, file = zstandard.ZstdDecompressor(), None, [], None
        for b in batches:
            for uri, number in zip(b.column("bundle").to_pylist(), b.column("frame").to_pylist(), strict=True):
                if uri != known:  # frames come bundle by bundle
                    if file is not None:
                        file.close()
                    fs, path = file_system(uri)
                    file = fs.open_input_file(path)
                    size = file.size()
                    known, table = uri, frames(size, lambda n: file.read_at(n, size - n))
                at, packed, plain = table[number]
                data = memoryview(unzip.decompress(file.read_at(packed, at), max_output_size=plain))
                rows, place = [], 0
                while place < len(data):
                    head, payload, place = parse(data, place)
                    rows.append(_row(head, payload, payloads))
                yield _record_batch(rows)
        if file is not None:
            file.close()

    return run


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the bundles that `index` names; a revisit's payload is null, its size and digest are those of its headers.

    Frames are independent, so they, not bundles, are dealt to tasks. A damaged record or table fails the job.
    """
    every = index.select("bundle", "frame").distinct()
    # By another expression than that of distinct(), whose few partitions Spark would merge and keep.
    dealt = every.repartition(shuffle_partitions(index.sparkSession), F.xxhash64("bundle", "frame"))
    dealt = dealt.sortWithinPartitions("bundle", "frame")
    return dealt.mapInArrow(_reader(payloads), RECORDS)


def _looker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unzip = zstandard.ZstdDecompressor()
    for b in batches:
        rows = []
        for row in b.to_pylist():
            fs, path = file_system(row["bundle"])
            with fs.open_input_file(path) as f:
                size = f.size()
                at, packed, plain = frames(size, lambda n: f.read_at(n, size - n))[row["frame"]]
                data = memoryview(unzip.decompress(f.read_at(packed, at), max_output_size=plain))
            head, payload, _ = parse(data[row["at"] : row["at"] + row["length"]])
            rows.append(_row(head, payload, True))
        yield _record_batch(rows)


def look_up(index: DataFrame, wanted: Column) -> DataFrame:
    """The records of the index rows that satisfy `wanted`, each read from its own frame alone."""
    return index.where(wanted).mapInArrow(_looker, RECORDS)
