"""Operator 9: HTML extraction by differencing pages of neighbouring URLs.

Pages of a host are ordered by URL path; a page is compared with the nearest page
of another path (the longer common path prefix of the page before and the page
after; on a tie the one before). Their text lines are aligned by longest common
subsequence and the shared lines, the site's furniture, are deleted.

Only text lines travel, compressed page by page, in one range partitioning by
(host, path, page_id), so a host of any size is spread over tasks; the ranges
come from a sample of the URLs alone, so no page is read twice. A task settles
all pages but those at its ends; the ends of all tasks, with the pages beside
them, are ordered again, and so on until one task holds them: no result depends
on where partitions begin.

Cases: null HTML gives null text and is a neighbour without lines; empty HTML gives empty text; pages of null or
host-less URLs, of hosts with one path, and pages whose neighbours both have the
very same lines (copies, which tell nothing about furniture) keep all lines; several pages of
one path (other queries, repeated rows) share their neighbours and are not
compared with each other; null page ids come first in their path; very long pages
are aligned whole; an empty table gives no rows; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets, ship, table, written

RANGE_BYTES = 8 << 20
#: Pages that one task orders when the ends of partitions are settled.
END_PAGES = 20_000
#: URLs sampled for each range, and for all ranges together.
RANGE_SAMPLE, RANGE_SAMPLES = 60, 1_000_000
#: Bits of alignment state kept at once; longer pages are halved first.
_STATE_BITS = 1 << 28
_GONE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|head|noscript|template|svg|iframe)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|button|caption|center|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|legend|li|main|menu|nav|ol|option|p|pre|section|select|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-z!?][^<>]*>", re.I)
_URL = re.compile(r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)", re.I)


def text_lines(page: str) -> list[str]:
    """Lines of visible text: one for each block element, blanks collapsed, empty ones left out."""
    s = _TAG.sub("", _BLOCK.sub("\n", _GONE.sub(" ", page.replace("\n", " ").replace("\r", " "))))
    return [x for x in (" ".join(line.split()) for line in html.unescape(s.replace("\x00", "")).split("\n")) if x]


def host_path(url: str | None) -> tuple[str, str]:
    """Lower-case host and path without query, fragment, closing slash and page suffix; ('', '') without a host."""
    m = _URL.match(url or "")
    if not m or not m[1]:
        return "", ""
    return m[1].lower(), re.sub(r"(?:/index)?\.(?:html?|php|aspx?)$", "", m[2].rstrip("/"), flags=re.I).rstrip("/")


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence with b."""
    lo, hi_a, hi_b = 0, len(a), len(b)
    while lo < min(hi_a, hi_b) and a[lo] == b[lo]:
        lo += 1
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
    out = {*range(lo), *range(hi_a, len(a))}
    common = set(a[lo:hi_a]) & set(b[lo:hi_b])
    x = [i for i in range(lo, hi_a) if a[i] in common]
    y = [b[j] for j in range(lo, hi_b) if b[j] in common]
    if not x:
        return out
    code: dict[str, int] = {}
    out.update(x[i] for i in _aligned([code.setdefault(a[i], len(code)) for i in x], [code[line] for line in y]))
    return out


def _states(a: list[int], b: list[int]) -> Iterator[int]:
    """For each prefix of b, one bit a place of a: 0 where the longest common subsequence grows by that place."""
    where: dict[int, int] = {}
    for i, line in enumerate(a):
        where[line] = where.get(line, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    yield v
    for line in b:
        m = v & where.get(line, 0)
        v = ((v + m) | (v - m)) & full
        yield v


def _grows(a: list[int], b: list[int]) -> np.ndarray:
    """Whether the longest common subsequence with b grows by each place of a."""
    for v in _states(a, b):
        last = v
    return 1 - np.unpackbits(np.frombuffer(last.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)].astype(np.int64)


def _aligned(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence with b; bit-parallel, and in halves where the state would be large."""
    if not a or not b:
        return []
    if len(b) > 1 and len(a) * len(b) > _STATE_BITS:
        half = len(b) // 2
        before = np.concatenate([[0], np.cumsum(_grows(a, b[:half]))])  # common with the first half, by prefix of a
        after = np.concatenate([[0], np.cumsum(_grows(a[::-1], b[half:][::-1]))])[::-1]
        at = int(np.argmax(before + after))
        return _aligned(a[:at], b[:half]) + [at + i for i in _aligned(a[at:], b[half:])]
    rows, out = list(_states(a, b)), []
    i, j = len(a), len(b)
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif rows[j - 1] >> (i - 1) & 1:
            i, j = i - 1, j - 1
            out.append(i)
        else:
            j -= 1
    return out[::-1]


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def differenced(lines: list[str], path: str, before: tuple | None, after: tuple | None) -> tuple[int | None, list[str]]:
    """(partner's page_id, lines kept) against the nearer of (path, page_id, lines) before and after."""
    near = sorted((n for n in (before, after) if n), key=lambda n: -_common(path, n[0]))
    for _, partner, other in near:
        if other != lines:
            gone = shared_lines(lines, other)
            return partner, [x for i, x in enumerate(lines) if i not in gone]
    return None, lines


# A page in transit: settled pages have kind 0 and plain text, which Parquet packs better than single pages could be; kind 1 is a page at a partition's end, kind 2 one that only serves as its neighbour.
_SCHEMA = "kind int, host string, path string, page_id long, url string, partner_id long, n_lines int, n_removed int, lines binary"
_ARROW = pa.schema([("kind", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("partner_id", pa.int64()), ("n_lines", pa.int32()), ("n_removed", pa.int32()), ("lines", pa.binary())])


def _pack(lines: list[str]) -> bytes:
    import zstandard as zstd

    return zstd.ZstdCompressor(level=1).compress("\n".join(lines).encode("utf-8", "surrogatepass"))


def _unpack(blob: bytes) -> list[str]:
    import zstandard as zstd

    s = zstd.ZstdDecompressor().decompress(blob).decode("utf-8", "surrogatepass")
    return s.split("\n") if s else []


def _rows(batches) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def _settle(rows: Iterator[dict], whole: bool) -> Iterator[dict]:
    """Settle sorted pages; ``whole``: the rows are all there are, so the ends are settled as well."""
    groups = groupby(rows, key=lambda r: (r["host"], r["path"]))
    window: list[list[dict]] = []  # up to three path groups: before, current, after
    first = True

    def near(group: list[dict], at: int, host: str):
        if not group or group[0]["host"] != host or not host:
            return None
        r = group[at]
        return r["path"], r["page_id"], [] if r["lines"] is None else _unpack(r["lines"])

    def settled(before, group, after):
        host, path = group[0]["host"], group[0]["path"]
        b, a = near(before, -1, host), near(after, 0, host)
        for r in group:
            if r["kind"] == 2:
                continue
            if r["lines"] is None:
                yield r | {"kind": 0, "n_removed": 0}
                continue
            lines = _unpack(r["lines"])
            partner, kept = differenced(lines, path, b, a)
            yield r | {"kind": 0, "partner_id": partner, "n_removed": len(lines) - len(kept), "lines": "\n".join(kept).encode("utf-8", "surrogatepass")}

    def held(group, beside: int):
        """An end group waits; beside: which of its neighbour's pages serves it."""
        for r in group:
            yield r if r["kind"] == 2 else r | {"kind": 1}

    for _, g in groups:
        window.append(list(g))
        if len(window) < 2:
            continue
        if first:  # the first group: its predecessor is unknown unless nothing precedes
            yield from settled([], window[0], window[1]) if whole else held(window[0], 0)
            if not whole:
                yield window[1][0] | {"kind": 2}
            first = False
        if len(window) == 3:
            yield from settled(*window)
            window.pop(0)
    if not window:
        return
    if len(window) == 1:
        yield from settled([], window[0], []) if whole else held(window[0], 0)
    elif whole:
        yield from settled(window[0], window[1], [])
    else:
        yield window[0][-1] | {"kind": 2}
        yield from held(window[1], 0)


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    part: list[dict] = []
    for r in rows:
        part.append(r)
        if len(part) == 1000:
            yield pa.RecordBatch.from_pylist(part, schema=_ARROW)
            part = []
    if part:
        yield pa.RecordBatch.from_pylist(part, schema=_ARROW)


def _key(host: str, path: str, page_id: int | None, url: str | None) -> tuple:
    return host, path, page_id is not None, page_id or 0, url is not None, url or ""


def range_bounds(pages: DataFrame, parts: int, id_col: str, url_col: str) -> list[tuple]:
    """Keys that cut the pages into about ``parts`` ranges of equal size, by a sample of ids and URLs as Spark's own range partitioning would take."""
    urls = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    rows = urls.count()
    wanted = min(RANGE_SAMPLE * parts, RANGE_SAMPLES)
    some = urls.sample(min(1.0, wanted / max(rows, 1)), 17).collect()
    keys = sorted(_key(*host_path(r.url), r.page_id, r.url) for r in some)
    cuts = [keys[len(keys) * k // parts] for k in range(1, parts)] if keys else []
    return sorted(set(cuts))


def page_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", bounds: list[tuple] = ()) -> DataFrame:
    """Pages as rows in transit; n_removed holds the range between the bounds."""
    data = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def run(batches):
        def rows():
            for r in _rows(batches):
                host, path = host_path(r["url"])
                lines = None if r["html"] is None else text_lines(r["html"])
                yield {"kind": 1, "host": host, "path": path, "page_id": r["page_id"], "url": r["url"], "partner_id": None, "n_lines": len(lines or []), "n_removed": bisect_right(bounds, _key(host, path, r["page_id"], r["url"])), "lines": None if lines is None else _pack(lines)}

        yield from _batches(rows())

    return data.mapInArrow(run, _SCHEMA)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", range_bytes: int = RANGE_BYTES, end_pages: int = END_PAGES) -> DataFrame:
    """page_id, url, partner_id, n_lines, n_removed, text of every page."""
    ship(pages.sparkSession)
    order = ["host", "path", "page_id", "url"]
    parts = buckets(pages, range_bytes)
    bounds = range_bounds(pages, parts, id_col, url_col) if parts > 1 else []
    lines = page_lines(pages, id_col, url_col, html_col, bounds)
    done: list[DataFrame] = []
    todo = lines
    while True:
        whole = parts == 1
        if whole:
            ranged = todo.coalesce(1)
        elif done:
            ranged = todo.repartitionByRange(parts, *order)
        else:
            ranged = todo.repartitionById(len(bounds) + 1, F.col("n_removed"))  # holds the range as yet
        result = written(ranged.sortWithinPartitions(*order, "lines", "kind").mapInArrow(lambda b, w=whole: _batches(_settle(_merged(_rows(b)), w)), _SCHEMA), "pages")
        done.append(result.filter("kind = 0"))
        if whole:
            break
        todo = result.filter("kind > 0")
        left = todo.count()
        if not left:
            break
        parts = min(-(-left // end_pages), parts - 1)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select("page_id", "url", "partner_id", "n_lines", "n_removed", F.col("lines").cast("string").alias("text"))


def _merged(rows: Iterator[dict]) -> Iterator[dict]:
    """Sorted rows without the neighbours that also wait themselves."""
    last = None
    for r in rows:
        if r["kind"] == 2 and last and all(r[k] == last[k] for k in ("host", "path", "page_id", "url", "lines")):
            continue
        last = r
        yield r


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
