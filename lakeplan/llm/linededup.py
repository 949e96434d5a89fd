"""Operator 6: line deduplication by a deletion-neighbourhood join.

A line is a near copy of another if their word sequences are within the edit
bound: one word replaced, added or removed in lines of at least ``short`` words,
none in shorter lines, where a word is more than a small edit. A line goes if an
earlier line, by (doc_id, text fingerprint, line number), is such a copy of it.

1. Lines become 64-bit sequence hashes; equal lines are one line with its
   earliest place from here on.
2. Two lines one edit apart share their first or their last half, so a line whose
   halves no other line has is settled; only the others go on. Nothing is lost.
3. Every remaining line emits the hashes of all its one-word deletions and its
   own hash. Equal deletions at one place are a replacement; a deletion equal to
   a line's own hash is an addition. All lines that share such a key are one edit
   from its earliest, so one aggregation per key finds it: no pairs are listed.
4. Each line and the earliest found are compared by their words.

Cases: lines without words (blank, punctuation only) always stay; null and empty
texts are returned as they are; rows of null id are returned as they are and make
no other line go; rows of one id and one text are one document, so a repeated row
keeps the lines that its first keeps; rows of one id with different texts are
documents of their own, in the order of their fingerprints; very long lines are taken whole; an empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_only, light, slices, table, written
from .kernels import U64, _powers, mix, words_of, lowered, text_buffer

#: Words from which on a line may differ by one word.
SHORT = 6
#: Variants that a kernel makes at once.
_VARIANTS = 400_000
_B = 0xC2B2AE3D27D4EB4F
_B_INVERSE = pow(_B, -1, 1 << 64)
_cache: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    if len(_cache.get(base, ())) < n:
        _cache[base] = _powers(base, max(4096, 2 * n))
    return _cache[base]


class Lines:
    """Non-blank lines of a batch: text, line number, words offset, sequence hash and running sums."""

    def __init__(self, texts: pa.Array):
        w = words_of(*text_buffer(lowered(texts)))
        breaks = np.flatnonzero(w.buf == 10)
        before = np.searchsorted(breaks, w.text_offset[:-1])
        number = np.searchsorted(breaks, w.start)
        doc = w.doc
        new = np.ones(len(w.hash), bool)
        new[1:] = (number[1:] != number[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        self.words, self.doc = w.hash, doc[first]
        self.number = number[first] - before[self.doc] if len(first) else first
        self.offset = np.append(first, len(w.hash))
        self.n = np.diff(self.offset)
        self.hash = sequence_hashes(w.hash, self.offset)


def _sums(words: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each word in its line, running sums of word * B^place, with a leading 0)."""
    n = np.diff(offset)
    at = np.arange(len(words)) - np.repeat(offset[:-1], n)
    with np.errstate(over="ignore"):
        return at, np.concatenate([np.zeros(1, U64), np.cumsum(words * _pow(_B, int(n.max(initial=0)) + 1)[at], dtype=U64)])


def _named(value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hash of a sequence of n words from its sum."""
    with np.errstate(over="ignore"):
        return mix(value + n.astype(U64) * U64(0x9E3779B97F4A7C15))


def sequence_hashes(words: np.ndarray, offset: np.ndarray) -> np.ndarray:
    _, s = _sums(words, offset)
    return _named(s[offset[1:]] - s[offset[:-1]], np.diff(offset))


def half_hashes(words: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """(lines, 4): hashes of the first and last n // 2 and (n - 1) // 2 words of each line, told apart by end."""
    _, s = _sums(words, offset)
    n, a, b = np.diff(offset), offset[:-1], offset[1:]
    inverse = _pow(_B_INVERSE, int(n.max(initial=0)) + 1)
    out = []
    with np.errstate(over="ignore"):
        for m in (n // 2, (n - 1) // 2):
            out.append(_named(s[a + m] - s[a], m))
            out.append(~_named((s[b] - s[b - m]) * inverse[n - m], m))
    return np.stack(out, 1)


def deletion_hashes(words: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, place, hash of the line without the word at place) of every word."""
    at, s = _sums(words, offset)
    n = np.diff(offset)
    line = np.repeat(np.arange(len(n)), n)
    a, b = offset[:-1][line], offset[1:][line]
    i = np.arange(len(words))
    with np.errstate(over="ignore"):
        value = (s[i] - s[a]) + (s[b] - s[i + 1]) * U64(_B_INVERSE)
    return line, at, _named(value, n[line] - 1)


def within_one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether word sequences differ by at most one replaced, added or removed word."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    m = len(b)
    differs = np.flatnonzero(a[:m] != b)
    if not len(differs):
        return True
    p = int(differs[0])
    return bool((a[p + 1 :] == b[p + 1 :] if len(a) == m else a[p + 1 :] == b[p:]).all())


_LINES = "doc_id long, t long, line int, key long, n int, h1 long, h2 long, h3 long, h4 long"


def line_keys(docs: DataFrame) -> DataFrame:
    """Written table of all lines with words: place, sequence hash, words and half hashes."""

    def run(batches):
        for b in batches:
            for s in slices(b, "text"):
                x = Lines(s.column("text"))
                h = half_hashes(x.words, x.offset).view(np.int64) if len(x.n) else np.zeros((0, 4), np.int64)
                at = pa.array(x.doc)
                yield pa.RecordBatch.from_arrays([s.column("doc_id").take(at), s.column("t").take(at), pa.array(x.number.astype(np.int32)), pa.array(x.hash.view(np.int64)), pa.array(x.n.astype(np.int32)), *(pa.array(np.ascontiguousarray(h[:, k])) for k in range(4))], names=[c.split()[0] for c in _LINES.split(", ")])

    return written(docs.mapInArrow(run, _LINES), "lines")


def line_words(docs: DataFrame, short: int) -> DataFrame:
    """(key, words) of the lines of at least ``short`` words; each once a slice of documents."""

    def run(batches):
        for b in batches:
            for s in slices(b, "text"):
                x = Lines(s.column("text"))
                _, pick = np.unique(x.hash, return_index=True)
                pick = pick[x.n[pick] >= short]
                yield pa.RecordBatch.from_arrays([pa.array(x.hash[pick].view(np.int64)), pa.array([x.words[x.offset[i] : x.offset[i + 1]].tobytes() for i in pick], pa.binary())], names=["key", "words"])

    return docs.select("text").mapInArrow(run, "key long, words binary")


def _variants(lines: DataFrame) -> DataFrame:
    """(h, n, place, key, doc_id, t, line): one row for each deletion, and the line itself with place -1."""

    def run(batches):
        for b in batches:
            for s in slices(b, "words", 8 * _VARIANTS):
                parts = [np.frombuffer(x.as_buffer(), U64) for x in s.column("words")]
                n = np.array([len(p) for p in parts])
                line, place, h = deletion_hashes(np.concatenate(parts), np.concatenate([[0], np.cumsum(n)]))
                key = s.column("key").to_numpy()
                line, place, h = np.concatenate([line, np.arange(len(n))]), np.concatenate([place, np.full(len(n), -1)]), np.concatenate([h.view(np.int64), key])
                at = pa.array(line)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n[line].astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(key[line]), s.column("doc_id").take(at), s.column("t").take(at), s.column("line").take(at)], names=["h", "n", "place", "key", "doc_id", "t", "line"])

    return lines.select("key", "words", "doc_id", "t", "line").mapInArrow(run, "h long, n int, place int, key long, doc_id long, t long, line int")


def fingerprint(text: F.Column) -> F.Column:
    """60 bits that tell texts of one id apart, and order them, as SQL can too."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def dropped_lines(docs: DataFrame, short: int = SHORT) -> DataFrame:
    """(doc_id, t, lines): numbers of the lines to remove from each document of (doc_id, t, text)."""
    lines = line_keys(docs)
    halves = [F.min(c).alias(c) for c in ("n", "h1", "h2", "h3", "h4")]
    first = written(lines.groupBy("key").agg(F.min(F.struct("doc_id", "t", "line")).alias("at"), *halves).select("key", "at.doc_id", "at.t", "at.line", "n", "h1", "h2", "h3", "h4"), "first")
    half = first.filter(F.col("n") >= short).select("key", F.explode(F.array_distinct(F.array("h1", "h2", "h3", "h4"))).alias("half"))
    shared = half.groupBy("half").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a != b").select("half")
    open_ = written(half.join(shared, "half").select("key").distinct(), "open")
    wordy = line_words(docs, short).join(light(open_), "key", "left_semi").groupBy("key").agg(F.first("words").alias("words"))
    wordy = written(wordy.join(first.select("key", "doc_id", "t", "line"), "key"), "words")
    v = _variants(wordy).repartition("h")
    me = F.struct("doc_id", "t", "line", "key")
    swap = v.filter("place >= 0").groupBy("h", "n", "place").agg(F.min(me).alias("best"), F.count("*").alias("c")).filter("c > 1")
    swapped = v.join(swap, ["h", "n", "place"]).select("key", "doc_id", "t", "line", "best")
    longer, own = F.min(F.when(F.col("place") >= 0, me)), F.min(F.when(F.col("place") < 0, me))
    grown = v.groupBy("h").agg(longer.alias("longer"), own.alias("own")).filter("longer is not null and own is not null")
    added = v.join(grown, "h").select("key", "doc_id", "t", "line", F.when(F.col("place") < 0, F.col("longer")).otherwise(F.col("own")).alias("best"))
    near = swapped.union(added).filter(F.col("best") < F.struct("doc_id", "t", "line", "key"))
    near = written(near.groupBy("key").agg(F.min("best").alias("best")).select("key", F.col("best.key").alias("other")), "near")
    one, two = wordy.select("key", "words"), wordy.select(F.col("key").alias("other"), F.col("words").alias("others"))

    @F.arrow_udf("boolean")
    def close(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([within_one_edit(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)) for x, y in zip(a, b)], pa.bool_())

    gone = near.join(one, "key").join(two, "other").filter(close("words", "others")).select("key")
    place = first.select("key", F.struct("doc_id", "t", "line").alias("at")).join(gone.withColumn("gone", F.lit(True)), "key", "left")
    out = lines.select("key", "doc_id", "t", "line").join(place, "key").filter(F.col("gone") | (F.struct("doc_id", "t", "line") != F.col("at")))
    return out.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: int = SHORT) -> DataFrame:
    """doc_id, text without its repeated lines, n_dropped of every row."""
    all_ = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    data = documents_only(docs, id_col, text_col)
    drops = written(dropped_lines(data.withColumn("t", fingerprint(F.col("text"))), short), "drops").select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), "lines")
    joined = all_.join(light(drops, F.size("lines")), (F.col("doc_id") == F.col("__id")) & (fingerprint(F.col("text")) == F.col("__t")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("lines", i)), "\n")
    return joined.select("doc_id", F.when(F.col("lines").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_dropped"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, t, line, w, len(w) AS n, array_to_string(w, ' ') AS key FROM (
    SELECT doc_id, t, line - 1 AS line, regexp_extract_all(lower(string_split(text, chr(10))[line]), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w
    FROM (SELECT doc_id, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS t, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents))
  WHERE len(w) > 0),
f AS (SELECT key, any_value(w) AS w, any_value(n) AS n, min((doc_id, t, line)) AS spot FROM l GROUP BY key),
v AS (SELECT key, spot, n, p, array_to_string(list_concat(w[1:p-1], w[p+1:]), ' ') AS h FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM f WHERE n >= 6)),
g AS (
  SELECT a.key FROM v a JOIN v b ON a.h = b.h AND a.n = b.n AND a.p = b.p WHERE b.spot < a.spot
  UNION SELECT a.key FROM v a JOIN f b ON a.h = b.key WHERE b.n >= 6 AND b.spot < a.spot
  UNION SELECT b.key FROM v a JOIN f b ON a.h = b.key WHERE b.n >= 6 AND a.spot < b.spot),
d AS (SELECT l.doc_id, l.t, list(DISTINCT l.line) AS lines FROM l JOIN f USING (key) LEFT JOIN g USING (key) WHERE g.key IS NOT NULL OR (l.doc_id, l.t, l.line) <> f.spot GROUP BY l.doc_id, l.t)
SELECT documents.doc_id,
  CASE WHEN lines IS NULL THEN text ELSE array_to_string([x FOR x, i IN string_split(text, chr(10)) IF NOT list_contains(lines, i - 1)], chr(10)) END AS text,
  CAST(coalesce(len(lines), 0) AS BIGINT) AS n_dropped
FROM documents LEFT JOIN d ON d.doc_id = documents.doc_id AND d.t = CAST('0x' || substr(md5(text), 1, 15) AS BIGINT)
"""
