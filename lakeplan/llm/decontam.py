"""Operator 7: benchmark decontamination by n-gram seeds and Smith-Waterman alignment.

Every word n-gram of a test item is a seed, however often it occurs. Where a
document holds one, the words that an alignment through it can reach are aligned
with the item (local alignment over words, linear gaps), unless the words they
have in common are too few for the score whatever their order. A pair whose best
alignment leaves one gram intact gets the score of aligning the whole document.
The score over the item's length is 1 for a copy and falls with every edit; from
MIN_WORDS matched words on, an excerpt counts however long its item is. The test
set goes to the tasks in shards of at most MAX_GRAMS grams, one pass over the
documents for each, so no document is shuffled and neither the driver nor a task
ever holds more than one shard. Of windows of equal score the first is reported.

Cases: null or empty texts, items and ids match nothing (null-id documents are
left out of the result and kept by ``drop_contaminated`` unless contaminated);
an item of fewer than NGRAM words matches only documents of just these words;
very long documents are searched whole; equal items are reported each; repeated
documents give one row for each (doc_id, item_id), with the best score; empty
tables give no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents_only, ship, slices, table, written
from .kernels import U64, ngrams, ranges, words

NGRAM = 3
MIN_SCORE = 0.5
#: Local score, in matched words, that is enough whatever the item's length.
MIN_WORDS = 30
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
#: Grams of test items sent to the tasks at once.
MAX_GRAMS = 2_000_000
_CELLS = 1 << 19
#: Pairs of a document's seed and an item that are held at once.
_PAIRS = 200_000


class Items:
    """Test items of one shard and their grams."""

    def __init__(self, ids: list[int], texts: list[str], n: int = NGRAM):
        self.n = n
        w = words(pa.array(texts, pa.string()))
        self.ids, self.hash, self.offset = np.array(ids, np.int64), w.hash, w.offset
        gram, off = ngrams(w, n)
        item = np.repeat(np.arange(len(ids)), np.diff(off))
        at = np.arange(len(gram)) - np.repeat(off[:-1], np.diff(off))
        order = np.lexsort((at, item, gram))
        self.gram, self.item, self.at = gram[order], item[order], at[order]
        self.unique = np.unique(gram)
        self.vocabulary, word = np.unique(w.hash, return_inverse=True)
        #: Sorted (item, word) keys and how often the item has the word.
        self.word, self.times = np.unique(np.repeat(np.arange(len(ids)), np.diff(w.offset)) * max(len(self.vocabulary), 1) + word, return_counts=True)

    def words_of(self, i: int) -> np.ndarray:
        return self.hash[self.offset[i] : self.offset[i + 1]]


def smith_waterman(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each (item, window) pair of word hashes."""
    out = np.zeros(len(items))
    order = sorted(range(len(items)), key=lambda i: (len(items[i]), len(windows[i])))
    at = 0
    while at < len(order):
        m, width = len(items[order[at]]), len(windows[order[at]])
        end = at + 1
        while end < len(order):
            width2 = max(width, len(windows[order[end]]))
            if len(items[order[end]]) > m + m // 4 + 4 or (end - at + 1) * width2 > _CELLS // 8:
                break
            width, end = width2, end + 1
        part = order[at:end]
        at = end
        rows = max(len(items[i]) for i in part)
        length = np.array([len(items[i]) for i in part])
        a, b = np.zeros((rows, len(part)), U64), np.ones((len(part), max(width, 1)), U64)
        used = np.zeros(b.shape, bool)
        for k, i in enumerate(part):
            a[: len(items[i]), k] = items[i]
            b[k, : len(windows[i])] = windows[i]
            used[k, : len(windows[i])] = True
        shift = -GAP * np.arange(b.shape[1], dtype=np.float32)
        h, best = np.zeros((len(part), b.shape[1] + 1), np.float32), np.zeros(len(part), np.float32)
        for r in range(rows):
            new = np.maximum(h[:, :-1] + np.where((b == a[r][:, None]) & used, np.float32(MATCH), np.float32(MISMATCH)), h[:, 1:] + np.float32(GAP))
            np.maximum(new, 0, out=new)
            new = np.maximum.accumulate(new + shift, 1) - shift
            h[:, 1:] = new
            best = np.where(r < length, np.maximum(best, new.max(1)), best)
        out[part] = best
    return out


def common_words(items: Items, item: np.ndarray, word: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words that each item and its window have in common, repeats as often as in both; word has the index in items.vocabulary or -1."""
    at, own = ranges(begin, end - begin), np.repeat(np.arange(len(item)), end - begin)
    used = word[at] >= 0
    at, own = at[used], own[used]
    key = item[own] * len(items.vocabulary) + word[at]
    at = np.minimum(np.searchsorted(items.word, key), len(items.word) - 1)
    used = items.word[at] == key
    pair, n = np.unique(own[used] * len(items.word) + at[used], return_counts=True)
    return np.bincount(pair // len(items.word), np.minimum(n, items.times[pair % len(items.word)]), len(item))


def align(texts: pa.Array, items: Items, min_score: float = MIN_SCORE) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, last word) of the best window of each pair that reaches min_score, or MIN_WORDS matched words."""
    w = words(texts)
    gram, off = ngrams(w, items.n)
    if not len(gram) or not len(items.unique):
        return []
    at = np.minimum(np.searchsorted(items.unique, gram), len(items.unique) - 1)
    hits = np.flatnonzero(items.unique[at] == gram)
    if not len(hits):
        return []
    word = np.minimum(np.searchsorted(items.vocabulary, w.hash), len(items.vocabulary) - 1)
    word[items.vocabulary[word] != w.hash] = -1
    lo, hi = np.searchsorted(items.gram, gram[hits]), np.searchsorted(items.gram, gram[hits], "right")
    cut = np.append(np.flatnonzero(np.diff(np.cumsum(hi - lo) // _PAIRS, prepend=-1)), len(hits))
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for i, j in zip(cut[:-1], cut[1:]):
        n = hi[i:j] - lo[i:j]
        pick, hit = ranges(lo[i:j], n), np.repeat(hits[i:j], n)
        doc = np.searchsorted(off, hit, "right") - 1
        item, at = items.item[pick], items.at[pick]
        size = np.diff(items.offset)[item]
        need = np.minimum(min_score * size, MIN_WORDS) * MATCH
        start = hit - off[doc] - at  # where the item would begin
        # Words that an alignment of this score may skip; before and after the seed it skips no more than its matches there pay for.
        skip = np.floor((MATCH * size - need) / -GAP + 1e-9).astype(np.int64)
        paid = MATCH / -GAP
        begin = np.maximum(start - np.minimum(skip, np.ceil(paid * at).astype(np.int64)), 0)
        end = np.minimum(start + size + np.minimum(skip, np.ceil(paid * (size - at)).astype(np.int64)), np.diff(w.offset)[doc])
        order = np.lexsort((begin, item, doc))
        doc, item, size, need, begin, end = doc[order], item[order], size[order], need[order], begin[order], end[order]
        same = np.cumsum(np.diff(doc * len(items.ids) + item, prepend=-1) != 0)
        reach = np.maximum.accumulate(same * (len(w.hash) + 1) + end)  # of the windows so far of the same pair
        new = np.ones(len(doc), bool)
        new[1:] = (same[1:] != same[:-1]) | (begin[1:] > reach[:-1] - same[:-1] * (len(w.hash) + 1))
        first = np.flatnonzero(new)
        end = np.maximum.reduceat(end, first)
        doc, item, size, need, begin = doc[first], item[first], size[first], need[first], begin[first]
        base = w.offset[doc]
        may = np.flatnonzero(MATCH * common_words(items, item, word, base + begin, base + end) >= need - 1e-9)
        doc, item, size, need, begin, end, base = doc[may], item[may], size[may], need[may], begin[may], end[may], base[may]
        score = smith_waterman([items.words_of(i) for i in item], [w.hash[s + b : s + e] for s, b, e in zip(base, begin, end)])
        enough, score = score >= need - 1e-9, score / np.maximum(size, 1) / MATCH
        for d, i, s, b, e in zip(*(x[enough].tolist() for x in (doc, item, score, begin, end))):
            if s > best.get((d, i), (0,))[0]:
                best[d, i] = (s, b, e)
    return [(d, i, *v) for (d, i), v in best.items()]


class Benchmark:
    """Test items in ``len`` shards of bounded size, by hashed id; the driver holds the one it is asked for."""

    def __init__(self, rows: DataFrame, count: int, n: int):
        self.rows, self.count, self.n = rows, count, n

    def __len__(self) -> int:
        return self.count

    def shard(self, k: int) -> Items:
        part = sorted((r.id, r.text) for r in self.rows.filter(F.pmod(F.xxhash64("id"), F.lit(self.count)) == k).collect())
        return Items([r[0] for r in part], [r[1] for r in part], self.n)


def prepared(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = NGRAM, max_grams: int = MAX_GRAMS) -> Benchmark:
    """The test items; the same for all documents, as no seed is chosen by its count among them."""
    rows = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).dropna().dropDuplicates()
    grams = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    return Benchmark(rows, max(1, -(-grams // max_grams)), n)


def _pairs(data: DataFrame, items: Items, min_score: float) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word) of one shard."""

    def run(batches):
        for b in batches:
            for s in slices(b, "text"):
                ids = s.column("doc_id").to_numpy(zero_copy_only=False)
                got = align(s.column("text"), items, min_score)
                if got:
                    d, i, score, first, last = (np.array(x) for x in zip(*got))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[d]), pa.array(items.ids[i]), pa.array(score, pa.float64()), pa.array(first, pa.int64()), pa.array(last - 1, pa.int64())], names=["doc_id", "item_id", "score", "first_word", "last_word"])

    return data.mapInArrow(run, "doc_id long, item_id long, score double, first_word long, last_word long")


def contaminated(docs: DataFrame, bench: Benchmark, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word of each contaminated pair; the words are the aligned window's."""
    data = documents_only(docs, id_col, text_col)
    rows = None
    for k in range(len(bench)):
        found = _pairs(data, bench.shard(k), min_score)
        if len(bench) > 1:
            found = written(found, "found")
        rows = found if rows is None else rows.union(found)
    best = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("first_word")).alias("f"), "last_word")).alias("b"))
    return best.select("doc_id", "item_id", "b.score", (-F.col("b.f")).alias("first_word"), "b.last_word")


def _without(docs: DataFrame, items: Items, text_col: str, min_score: float) -> DataFrame:
    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        out, at = np.zeros(len(texts), bool), 0
        for s in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
            out[[at + g[0] for g in align(s.column(0), items, min_score)]] = True
            at += s.num_rows
        return pa.array(out)

    return docs.filter(~found(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))


def drop_contaminated(docs: DataFrame, bench: Benchmark, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs that hold no test item, with all their columns; beyond one shard, each pass writes what it keeps for the next."""
    ship(docs.sparkSession)
    for k in range(len(bench)):
        before = docs
        docs = _without(docs, bench.shard(k), text_col, min_score)
        if k < len(bench) - 1:
            docs = written(docs, "kept")
            if k:
                discard(before)
    return docs


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return contaminated(docs, prepared(table(spark, sf_dir, "benchmark")))
