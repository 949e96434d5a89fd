import hashlib
import struct

import pytest
import zstandard as zstd

from lakeplan.llm import warc
from lakeplan.llm.common import table

from .util import LONG, rows


def pages(spark, data):
    return spark.createDataFrame([(*r, "x", 3) for r in data], "page_id long, url string, html string, frame string, seq int").repartition(2)


AWKWARD = [(1, "http://a.example/x", "<p>body</p>"), (1, "http://a.example/x", "<p>body</p>"), (None, "http://a.example/y", "b"), (2, None, "b"), (3, "http://a.example/z", None), (4, "", ""), (5, "http://a.example/%0D\r\nX-Evil: 1", "line\r\n\r\nWARC/1.1\r\n"), (6, "http://a.example/ö", LONG), (7, "http://a.example/%250D", "é🙂\x00")]


def bodies(data):
    return sorted(((i, u, None if b is None else b.encode()) for i, u, b in data), key=str)


@pytest.mark.parametrize("options", [{}, {"file_bytes": 1000}, {"dict_bytes": 1024, "level": 9}])
def test_round_trip(spark, options):
    frames = warc.warc_frames(pages(spark, AWKWARD), **options)
    assert sorted(((r[0], r[1], None if r[2] is None else bytes(r[2])) for r in rows(warc.read_frames(frames))), key=str) == bodies(AWKWARD)


def test_files(spark, data, tmp_path):
    df = table(spark, data, "pages")
    index = warc.write_warc(df.repartition(2), str(tmp_path / "out"), file_bytes=50_000).collect()
    files = sorted((tmp_path / "out").iterdir())
    assert len(files) > 2 and all(f.name.endswith(".warc.zst") for f in files)
    got = []
    for f in files:
        raw = f.read_bytes()
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == warc.SKIPPABLE_MAGIC
        d = zstd.ZstdCompressionDict(raw[8 : 8 + size])
        got += warc.read_file(raw)
        own = sorted((r for r in index if f"{r.file}.warc.zst" == f.name), key=lambda r: r.offset)
        assert own[0].seq == -1 and own[-1].offset + own[-1].length == len(raw)
        for r in own[1:4]:  # any record can be read alone
            one = zstd.ZstdDecompressor(dict_data=d).decompress(raw[r.offset : r.offset + r.length])
            assert one.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and warc.parse(one)[0] == r.page_id and len(one) == r.raw_length
    assert sorted(got, key=str) == bodies([(r.page_id, r.url, r.html) for r in df.collect()])


def test_the_dictionary_pays(spark, data):
    df = table(spark, data, "pages").coalesce(1)
    frames = warc.warc_frames(df).collect()
    alone = sum(len(zstd.ZstdCompressor(level=warc.LEVEL).compress(warc.record(r.page_id, r.url, r.html.encode()))) for r in df.collect())
    assert sum(r.length for r in frames if r.seq >= 0) < 0.8 * alone


def test_a_task_run_twice_writes_the_same(spark, data):
    df = table(spark, data, "pages").coalesce(2)
    key = lambda q: sorted((r.file, r.seq, bytes(r.frame)) for r in q.collect())
    frames = warc.warc_frames(df)
    assert key(frames) == key(frames)


def plain_reader(data):
    """Bodies of an archive by the bytes alone: skippable frame, dictionary, then frame after frame, record after record."""
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    size = int.from_bytes(data[4:8], "little")
    d, at, out = zstd.ZstdCompressionDict(data[8 : 8 + size]), 8 + size, []
    while at < len(data):
        o = zstd.ZstdDecompressor(dict_data=d).decompressobj()
        raw = o.decompress(data[at:])
        at = len(data) - len(o.unused_data)
        lines = raw[: raw.index(b"\r\n\r\n")].split(b"\r\n")
        fields = dict(x.split(b": ", 1) for x in lines[1:])
        body = raw[raw.index(b"\r\n\r\n") + 4 :]
        assert lines[0] == b"WARC/1.1" and len(body) == int(fields[b"Content-Length"]) + 4 and body.endswith(b"\r\n\r\n")
        assert fields[b"WARC-Payload-Digest"] == b"sha1:" + hashlib.sha1(body[:-4].split(b"\r\n\r\n", 1)[1]).hexdigest().encode()
        out.append(body[:-4].split(b"\r\n\r\n", 1)[1])
    return out


def test_files_of_merged_partitions(spark, data, tmp_path):
    """Merging partitions after the writer, and uniting results, keeps every record."""
    df = table(spark, data, "pages")
    want = sorted(r.html.encode() for r in df.collect())
    index = warc.write_warc(df.repartition(4), str(tmp_path / "out")).coalesce(1).collect()
    files = sorted((tmp_path / "out").iterdir())
    assert len(files) == len({r.file for r in index}) == 4
    assert sorted(x for f in files for x in plain_reader(f.read_bytes())) == want
    frames = warc.warc_frames(df.repartition(4)).coalesce(1).union(warc.warc_frames(df.repartition(3)))
    assert sorted(bytes(r.body) for r in warc.read_frames(frames).collect()) == sorted(want * 2)
    assert frames.filter("seq = -1").count() == frames.select("file").distinct().count() == 7


def test_empty_table(spark):
    assert rows(warc.warc_frames(pages(spark, AWKWARD).limit(0))) == [] and rows(warc.read_frames(warc.warc_frames(pages(spark, AWKWARD).limit(0)))) == []


def test_not_an_archive():
    with pytest.raises(ValueError):
        warc.open_dictionary(b"12345678")
