"""Operator 10: dictionary-compressed WARC writer.

Each input partition becomes one or more archive files. For every file a
Zstandard dictionary is built from all the records that the file holds, stored
in a leading skippable frame, and every record is a frame of its own compressed
with that dictionary. Nothing is shuffled: the work is one pass over the table,
and a lost task writes the same file again. A file is named by its archive (drawn
anew for each call), its input partition and its number there, so results may be
coalesced or united with others and still tell their files apart.

Cases: a null id, URL or body is written as an empty field and read back as
null (a header says so); empty and very long bodies are ordinary records (a file
may exceed its bound by one record); repeated rows are separate records; an
empty table gives no rows; other columns, whatever their names, are ignored.
Where a file holds too little to train on, its dictionary is the raw content of
its records, cut to the dictionary size.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

#: Frame magic that announces a dictionary at the start of a file.
SKIPPABLE_MAGIC = 0x184D2A5D
DICT_BYTES = 32 << 10
FILE_BYTES = 32 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
SCHEMA = "file string, seq long, page_id long, url string, offset long, length int, raw_length int, frame binary"


def record(page_id: int | None, url: str | None, body: bytes | None, date: str = DATE) -> bytes:
    """One WARC/1.1 response record."""
    null = ",".join(n for n, v in (("id", page_id), ("url", url), ("body", body)) if v is None)
    payload = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body or b"") + (body or b"")
    clean = url or ""
    escaped = "\r" in clean or "\n" in clean
    if escaped:
        clean = clean.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {clean}')}>", f"WARC-Target-URI: {clean}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{hashlib.sha1(body or b'').hexdigest()}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if null:
        head.append(f"X-Null-Fields: {null}")
    if escaped:
        head.append("X-Escaped-URI: yes")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[int | None, str | None, bytes | None]:
    """(page_id, url, body) of a record made by ``record``."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = rest[: int(fields["Content-Length"])]
    body = payload.partition(b"\r\n\r\n")[2]
    null = set(fields.get("X-Null-Fields", "").split(","))
    url = fields["WARC-Target-URI"]
    if "X-Escaped-URI" in fields:
        url = url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    return None if "id" in null else int(fields["X-Page-ID"]), None if "url" in null else url, None if "body" in null else body


def build_dictionary(records: list[bytes], size: int = DICT_BYTES):
    """Train on all the records; raw content where they are too few for training."""
    import zstandard as zstd

    try:
        return zstd.train_dictionary(size, records, k=256, d=8, steps=1, threads=0)
    except (zstd.ZstdError, ValueError):
        return zstd.ZstdCompressionDict(b"".join(records)[-size:] or b"warc", dict_type=zstd.DICT_TYPE_RAWCONTENT)


def dictionary_frame(data: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE_MAGIC, len(data)) + data


def _file(name: str, rows: list[tuple], seq: int, dict_bytes: int, level: int) -> Iterator[pa.RecordBatch]:
    import zstandard as zstd

    d = build_dictionary([r[2] for r in rows], dict_bytes)
    packer = zstd.ZstdCompressor(level=level, dict_data=d, write_content_size=True, write_checksum=True)
    head = dictionary_frame(d.as_bytes())
    out = [(name, -1, None, None, 0, len(head), len(d.as_bytes()), head)]
    at = len(head)
    for k, (page_id, url, raw) in enumerate(rows):
        frame = packer.compress(raw)
        out.append((name, seq + k, page_id, url, at, len(frame), len(raw), frame))
        at += len(frame)
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for i in range(0, len(out), 1000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 1000]), types)], names=names)


def warc_frames(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", dict_bytes: int = DICT_BYTES, file_bytes: int = FILE_BYTES, level: int = LEVEL, date: str = DATE, archive: str | None = None) -> DataFrame:
    """Frames of all archive files: seq -1 is a file's leading dictionary frame, the rest are records in file order."""
    ship(pages.sparkSession)
    archive = archive or uuid.uuid4().hex[:16]
    data = pages.select(F.spark_partition_id().alias("part"), F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{body_col}`").cast("binary").alias("body"))

    def run(batches):
        part, number, seq, rows, size = 0, 0, 0, [], 0
        for b in batches:
            for part, page_id, url, body in zip(*(b.column(i) for i in range(4))):
                raw = record(page_id.as_py(), url.as_py(), body.as_py(), date)
                rows.append((page_id.as_py(), url.as_py(), raw))
                size += len(raw)
                if size >= file_bytes:
                    yield from _file(f"{archive}-{part.as_py():05d}-{number:05d}", rows, seq, dict_bytes, level)
                    number, seq, rows, size = number + 1, seq + len(rows), [], 0
        if rows:
            yield from _file(f"{archive}-{part.as_py():05d}-{number:05d}", rows, seq, dict_bytes, level)

    return data.mapInArrow(run, SCHEMA)


def write_warc(pages: DataFrame, folder: str, **options) -> DataFrame:
    """Write FILE.warc.zst files into a folder that all executors share (a mount); returns the index (CDX) rows.

    Each file is written under a temporary name and renamed, so a task that is run twice leaves one whole file.
    """
    frames = warc_frames(pages, **options)

    def save(batches):
        os.makedirs(folder, exist_ok=True)
        out, name, tmp = None, None, None
        for b in batches:
            for file, frame in zip(b.column("file").to_pylist(), b.column("frame")):
                if name != file:
                    if out:
                        out.close()
                        os.replace(tmp, f"{folder}/{name}.warc.zst")
                    name, tmp = file, f"{folder}/.{file}-{uuid.uuid4().hex}"
                    out = open(tmp, "wb")
                out.write(frame.as_buffer())
            yield b.drop_columns(["frame"])
        if out:
            out.close()
            os.replace(tmp, f"{folder}/{name}.warc.zst")

    return frames.mapInArrow(save, SCHEMA.removesuffix(", frame binary"))


def open_dictionary(head: bytes):
    """The dictionary in a file's leading frame."""
    import zstandard as zstd

    magic, size = struct.unpack("<II", head[:8])
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("no dictionary frame")
    return zstd.ZstdCompressionDict(head[8 : 8 + size])


def read_file(data: bytes) -> list[tuple[int | None, str | None, bytes | None]]:
    """All records of one archive file."""
    import zstandard as zstd

    d = open_dictionary(data)
    at, out, reader = 8 + struct.unpack("<I", data[4:8])[0], [], zstd.ZstdDecompressor(dict_data=d)
    while at < len(data):
        o = reader.decompressobj()
        raw = o.decompress(memoryview(data)[at:])
        at = len(data) - len(o.unused_data)
        out.append(parse(raw))
    return out


def read_frames(frames: DataFrame) -> DataFrame:
    """(page_id, url, body) decoded from the rows of ``warc_frames``."""

    def run(key, rows):
        import zstandard as zstd

        rows = rows.sort_by("seq")
        f = rows.column("frame").to_pylist()
        reader = zstd.ZstdDecompressor(dict_data=open_dictionary(f[0]))
        got = [parse(reader.decompress(x)) for x in f[1:]]
        return pa.table({"page_id": pa.array([g[0] for g in got], pa.int64()), "url": pa.array([g[1] for g in got], pa.string()), "body": pa.array([g[2] for g in got], pa.binary())})

    return frames.groupBy("file").applyInArrow(lambda k, t: run(k, t), "page_id long, url string, body binary")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_frames(table(spark, sf_dir, "pages"))
