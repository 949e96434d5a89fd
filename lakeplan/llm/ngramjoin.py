"""Operator 4: n-gram Jaccard join with filters under several global token orders.

Two documents match if their sets of word n-grams have a Jaccard similarity of
at least ``threshold``; documents linked by matches form a class.

1. Every text's grams go to hash buckets. A bucket counts in how many distinct
   sets each gram occurs; grams of one set can match nothing and end there. The
   rest return to their set as (bucket, rank) tokens with their document
   frequency. Within a bucket 48 bits of a gram are kept; as buckets stay of one
   size, so does the chance that two grams share them (about 1 in 10^8 grams).
2. Sets with equal contents are one set, named by its 64-bit fingerprint.
3. A set's prefix under an order is the part of which two matching sets must
   share a token: size - ceil(threshold * size) + 1 grams, the rarest first.
   Grams of one set fill the front of every prefix, so most documents, having
   mostly own grams, send nothing at all.
4. Pairs of sets that share a prefix token under EVERY order are verified by
   their whole sets. So that no list of pairs grows with the square of a class,
   each set is first compared with a leading set of a few of its tokens, which
   joins copies by a number of comparisons linear in the copies; then pairs of
   sets from different classes are listed and verified. Every match is inside a
   class now, and ``jaccard_classes`` counts them class by class: blocks of a
   class meet in pairs, in tasks of their own, under the same filters.

Cases: null ids and null, empty or word-less texts match nothing; texts shorter
than NGRAM words have one gram of all their words; a repeated row is one document;
rows of one id with different texts are documents of their own, linked like any
others; very long texts are taken whole; ties of similarity with the threshold
match; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buckets, discard, documents_only, join_ids, light, slices, table, written
from .components import class_matches, components, runs, sorted_rows
from .kernels import U64, mix, ngrams, ranges, unique_per_text, words

NGRAM = 3
THRESHOLD = 0.5
#: Token orders whose filters a pair must pass: by frequency, then by a hash of the order's own.
ORDERS = 3
#: Tokens of a set that look for a first partner.
FIRST = 8
#: Rounds of comparisons with leaders before the exact round.
STARS = 2
#: Bytes of Parquet for each bucket of grams.
BUCKET_BYTES = 12 << 20
#: Sets, and bytes of their tokens, in a block of a class; sets of one leader or block that a task takes at once.
BLOCK, BLOCK_BYTES = 1024, 64 << 20
PARTNERS = 512
_FLUSH = 3_000_000
_GRID = 1 << 20


def gram_sets(texts: pa.Array, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, offsets, fingerprint of each text's set); an empty set has fingerprint 0."""
    g, off = unique_per_text(*ngrams(words(texts), n))
    total = np.concatenate([[U64(0)], np.cumsum(mix(g))]).astype(U64)
    with np.errstate(over="ignore"):
        fp = mix(total[off[1:]] - total[off[:-1]] + np.diff(off).astype(U64))
    return g, off, np.where(np.diff(off) > 0, fp, U64(0))


def _packed(parts: list[tuple], count: int) -> pa.RecordBatch:
    """Rows (bucket, fps, sizes, counts, grams) of accumulated (fp, size, grams, offsets)."""
    fp = np.concatenate([p[0] for p in parts])
    size = np.concatenate([p[1] for p in parts])
    g = np.concatenate([p[2] for p in parts])
    owner = np.repeat(np.arange(len(fp), dtype=np.int32), size)
    bucket = (mix(g) % U64(count)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    g, owner, bucket = g[order], owner[order], bucket[order]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    rows = []
    for i, j in zip(edge, np.append(edge[1:], len(g))):
        own = owner[i:j]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        who = own[first]
        rows.append((int(bucket[i]), fp[who].tobytes(), size[who].astype(np.uint32).tobytes(), np.diff(np.append(first, len(own))).astype(np.uint32).tobytes(), np.ascontiguousarray(g[i:j].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], names=["bucket", "fps", "sizes", "counts", "grams"])


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column if x.is_valid), kind)


_SETS = "fp long, size long, tokens binary, levels binary, doc_id long"


def set_table(docs: DataFrame, n: int, count: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Written (fp, size, tokens, levels) of every set whose prefix has a gram that another set has too, as no other can match, and (doc_id, fp) of every row with a gram.

    tokens are bucket * 2^32 + rank of the gram among the bucket's shared grams;
    levels are their document frequencies on a quarter-octave scale. Both come
    from one pass over the texts: ids travel along in buckets below 0.
    """

    def spread(batches):
        parts, ids, held = [], [], 0

        def flush():
            doc_id, fp = (np.concatenate(x) for x in zip(*ids))
            yield pa.RecordBatch.from_arrays([pa.array([-1 - int(fp[0] % U64(count))], pa.int32()), *(pa.array([x], pa.binary()) for x in (fp.tobytes(), b"", b"", doc_id.tobytes()))], names=["bucket", "fps", "sizes", "counts", "grams"])
            yield _packed(parts, count)

        for b in batches:
            for s in slices(b, "text"):
                g, off, fp = gram_sets(s.column("text"), n)
                size = np.diff(off)
                if len(g):
                    parts.append((fp[size > 0], size[size > 0], g))
                    ids.append((s.column("doc_id").to_numpy()[size > 0], fp[size > 0]))
                held += len(g)
                if held >= _FLUSH:
                    yield from flush()
                    parts, ids, held = [], [], 0
        if held:
            yield from flush()

    def matched(key, rows):
        bucket = int(key[0].as_py())
        if bucket < 0:
            none = pa.nulls(len(rows), pa.binary())
            return pa.table([pa.array([bucket] * len(rows), pa.int32()), pa.array([bucket] * len(rows), pa.int32()), rows["fps"], none, none, rows["grams"], none], names=["dest", "bucket", "fps", "sizes", "counts", "tokens", "levels"])
        fp, size, cnt = _joined(rows["fps"], U64), _joined(rows["sizes"], np.uint32), _joined(rows["counts"], np.uint32)
        raw = np.frombuffer(b"".join(x.as_buffer() for x in rows["grams"]), np.uint8).reshape(-1, 6)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :6] = raw
        g = wide.view(U64).ravel()
        del raw
        owner = np.repeat(np.arange(len(fp), dtype=np.int64), cnt)
        if len(np.unique(fp)) < len(fp):  # copies of a set send the same grams
            first = np.unique(fp, return_index=True)[1]
            keep = np.zeros(len(fp), bool)
            keep[first] = True
            # one set may arrive in several parts of one flush only if it is the same text, so whole parts go
            g, owner = g[keep[owner]], owner[keep[owner]]
        order = np.argsort(g)
        g, owner = g[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        df = np.diff(np.append(first, len(g)))
        common = df > 1
        pick = ranges(first[common], df[common])
        df = df[common]
        owner = owner[pick]
        token = (U64(bucket) << U64(32)) + np.repeat(np.arange(len(df), dtype=U64), df)
        level = np.minimum(np.floor(4 * np.log2(np.repeat(df, df))), 255).astype(np.uint8)
        dest = (mix(fp) % U64(count)).astype(np.int64)[owner]
        order = np.lexsort((owner, dest))
        owner, token, level, dest = owner[order], token[order], level[order], dest[order]
        out = []
        edge = np.flatnonzero(np.concatenate([[True], dest[1:] != dest[:-1]])) if len(dest) else []
        for i, j in zip(edge, [*edge[1:], len(dest)]):
            own = owner[i:j]
            head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            who = own[head]
            out.append((int(dest[i]), bucket, fp[who].tobytes(), size[who].tobytes(), np.diff(np.append(head, len(own))).astype(np.uint32).tobytes(), (token[i:j] & U64(0xFFFFFFFF)).astype(np.uint32).tobytes(), level[i:j].tobytes()))
        cols = list(zip(*out)) if out else [[]] * 7
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), *[pa.binary()] * 5))], names=["dest", "bucket", "fps", "sizes", "counts", "tokens", "levels"])

    def gathered(key, rows):
        if key[0].as_py() < 0:
            fp, doc_id = _joined(rows["fps"], np.int64), _joined(rows["tokens"], np.int64)
            return pa.table([pa.array(fp), pa.array(np.zeros(len(fp), np.int64)), pa.nulls(len(fp), pa.binary()), pa.nulls(len(fp), pa.binary()), pa.array(doc_id)], names=["fp", "size", "tokens", "levels", "doc_id"])
        fp, size, cnt = _joined(rows["fps"], U64), _joined(rows["sizes"], np.uint32), _joined(rows["counts"], np.uint32)
        per = [len(x.as_buffer()) // 4 for x in rows["tokens"]]
        token = _joined(rows["tokens"], np.uint32).astype(U64) + (np.repeat(rows["bucket"].to_numpy().astype(U64), per) << U64(32))
        level = _joined(rows["levels"], np.uint8)
        owner = np.repeat(fp, cnt)
        order = np.lexsort((token, level, owner))
        owner, token, level = owner[order], token[order], level[order]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
        cut = np.append(first, len(owner))
        size = size[np.unique(fp, return_index=True)[1]].astype(np.int64)
        keep = np.flatnonzero(size - np.ceil(threshold * size - 1e-9) + 1 > size - np.diff(cut))
        return pa.table([pa.array(owner[first[keep]].view(np.int64)), pa.array(size[keep]), pa.array([token[cut[i] : cut[i + 1]].tobytes() for i in keep], pa.binary()), pa.array([level[cut[i] : cut[i + 1]].tobytes() for i in keep], pa.binary()), pa.nulls(len(keep), pa.int64())], names=["fp", "size", "tokens", "levels", "doc_id"])

    packed = docs.select("doc_id", "text").mapInArrow(spread, "bucket int, fps binary, sizes binary, counts binary, grams binary")
    back = packed.groupBy("bucket").applyInArrow(matched, "dest int, bucket int, fps binary, sizes binary, counts binary, tokens binary, levels binary")
    all_ = written(back.groupBy("dest").applyInArrow(gathered, _SETS), "sets")
    return all_.filter("size > 0").drop("doc_id"), all_.filter("size = 0").select("doc_id", "fp")


def prefix_length(size: int, threshold: float) -> int:
    """Grams of which two sets of this similarity must share one, whatever the order."""
    return size - int(np.ceil(threshold * size - 1e-9)) + 1


def prefixes(size: int, token: np.ndarray, level: np.ndarray, threshold: float, orders: int = ORDERS) -> list[np.ndarray]:
    """Shared tokens in the prefix under each order; grams of one set come first in all of them."""
    room = prefix_length(size, threshold) - (size - len(token))
    if room <= 0:
        return [token[:0]] * orders
    if room >= len(token):
        return [token] * orders
    out = [token[:room]]  # by level, then token
    for k in range(1, orders):
        octave = (level >> 2).astype(U64) << U64(56)
        out.append(token[np.argsort(octave | (mix(token + U64(k << 20)) >> U64(8)), kind="stable")[:room]])
    return out


def _first_tokens(sets: DataFrame, threshold: float) -> DataFrame:
    """(fp, label, own, token): FIRST tokens of each prefix, chosen alike in all sets; own is the share of grams that no other set has."""

    def run(batches):
        for b in batches:
            fps, labels, own, tokens = [], [], [], []
            for fp, label, size, token, level in zip(*(b[c].to_pylist() for c in ("fp", "label", "size", "tokens", "levels"))):
                p = prefixes(size, np.frombuffer(token, U64), np.frombuffer(level, np.uint8), threshold, 1)[0]
                if len(p):
                    p = p[np.argsort(mix(p))[:FIRST]]
                    fps += [fp] * len(p)
                    labels += [label] * len(p)
                    own += [1 - len(token) / 8 / size] * len(p)
                    tokens.append(p.view(np.int64))
            if fps:
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(labels, pa.int64()), pa.array(own, pa.float64()), pa.array(np.concatenate(tokens))], names=["fp", "label", "own", "token"])

    return sets.mapInArrow(run, "fp long, label long, own double, token long")


def _stars(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): each set b with the set a that leads most of its first tokens.

    A token's leader is the set with the fewest grams of its own (among copies,
    the one that the others were made from), or for that set's group the best of another group.
    """
    first = written(_first_tokens(sets, threshold), "first")
    by = F.struct("own", "fp", "label")
    top = first.groupBy("token").agg(F.min(by).alias("one"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
    led = first.join(top, "token")
    second = led.filter("label != one.label").groupBy("token").agg(F.min(by).alias("two"))
    tries = led.join(second, "token").select("fp", F.when(F.col("label") != F.col("one.label"), F.col("one.fp")).otherwise(F.col("two.fp")).alias("lead"))
    counted = tries.groupBy("fp", "lead").agg(F.count("*").alias("k"))
    return counted.groupBy("fp").agg(F.max(F.struct("k", "lead")).alias("m")).select(F.col("m.lead").alias("a"), F.col("fp").alias("b"))


def _postings(sets: DataFrame, threshold: float, orders: int, count: int) -> DataFrame:
    """Packed (bucket, fps, labels, sizes, counts, tokens) of all prefixes; the order is the tokens' top byte of ``slots``."""

    def run(batches):
        fps, labels, sizes, slot, token, held = [], [], [], [], [], 0

        def flush():
            own = np.repeat(np.arange(len(fps), dtype=np.int64), [len(t) for t in token])
            t, o = np.concatenate(token), np.concatenate(slot)
            bucket = (t >> U64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            t, o, own, bucket = t[order], o[order], own[order], bucket[order]
            f, l, s = np.array(fps, np.int64), np.array(labels, np.int64), np.array(sizes, np.uint32)
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            rows = []
            for i, j in zip(edge, np.append(edge[1:], len(t))):
                x = own[i:j]
                head = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                who = x[head]
                rows.append((int(bucket[i]), f[who].tobytes(), l[who].tobytes(), s[who].tobytes(), np.diff(np.append(head, len(x))).astype(np.uint32).tobytes(), (t[i:j] & U64(0xFFFFFFFF)).astype(np.uint32).tobytes(), o[i:j].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 6))], names=["bucket", "fps", "labels", "sizes", "counts", "tokens", "slots"])

        for b in batches:
            for fp, label, size, tok, level in zip(b["fp"].to_pylist(), b["label"].to_pylist(), b["size"].to_pylist(), b["tokens"].to_pylist(), b["levels"].to_pylist()):
                p = prefixes(size, np.frombuffer(tok, U64), np.frombuffer(level, np.uint8), threshold, orders)
                if len(p[0]):
                    fps.append(fp)
                    labels.append(label)
                    sizes.append(size)
                    token.append(np.concatenate(p))
                    slot.append(np.repeat(np.arange(orders, dtype=np.uint8), len(p[0])))
                    held += len(token[-1])
                    if held >= _FLUSH:
                        yield flush()
                        fps, labels, sizes, slot, token, held = [], [], [], [], [], 0
        if held:
            yield flush()

    return sets.mapInArrow(run, "bucket int, fps binary, labels binary, sizes binary, counts binary, tokens binary, slots binary")


def _cross_pairs(postings: DataFrame, threshold: float) -> DataFrame:
    """(a, b, orders): pairs of sets of different labels and fitting sizes that share a prefix token of the bucket; bits of the orders."""

    def run(key, rows):
        fp, label, size, cnt = _joined(rows["fps"], np.int64), _joined(rows["labels"], np.int64), _joined(rows["sizes"], np.uint32).astype(np.float64), _joined(rows["counts"], np.uint32)
        token = _joined(rows["tokens"], np.uint32).astype(U64) | (_joined(rows["slots"], np.uint8).astype(U64) << U64(32))
        own = np.repeat(np.arange(len(fp), dtype=np.int64), cnt)
        order = np.lexsort((own, token))
        token, own = token[order], own[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        width = np.diff(np.append(first, len(token)))
        mixed = np.maximum.reduceat(label[own], first) != np.minimum.reduceat(label[own], first) if len(first) else np.zeros(0, bool)
        first, width = first[mixed], width[mixed]
        rank = np.empty(len(fp), np.int64)  # a pair is one number: (lower rank, higher rank, order)
        rank[np.argsort(fp, kind="stable")] = np.arange(len(fp))
        found: list[np.ndarray] = []
        pending: list[np.ndarray] = []

        def settle():
            if pending:
                found[:] = [np.unique(np.concatenate([*found, *pending]))]
                pending.clear()

        held = 0
        for f, n in zip(first.tolist(), width.tolist()):
            x, bit = own[f : f + n], int(token[f] >> U64(32))
            x = x[np.argsort(rank[x])]
            wide = min(n, 4096)
            for i, j in ((i, j) for i in range(0, n, _GRID // wide) for j in range(0, n, wide) if j + wide > i):
                a, b = np.meshgrid(np.arange(i, min(i + _GRID // wide, n)), np.arange(j, min(j + wide, n)), indexing="ij")
                ok = a < b
                a, b = x[a[ok]], x[b[ok]]
                ok = (label[a] != label[b]) & (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9)
                if ok.any():
                    pending.append((rank[a[ok]] * len(fp) + rank[b[ok]]) * 64 + bit)
                    held += len(pending[-1])
                    if held > max([2_000_000, *map(len, found)]):
                        settle()
                        held = 0
        settle()
        got = found[0] if found else np.zeros(0, np.int64)
        head = np.flatnonzero(np.diff(got >> 6, prepend=-1))
        bits = np.bitwise_or.reduceat(1 << (got & 63), head) if len(got) else got
        pair, by = got[head] >> 6, np.sort(fp)
        return pa.table([pa.array(by[pair // max(len(fp), 1)]), pa.array(by[pair % max(len(fp), 1)]), pa.array(bits)], names=["a", "b", "orders"])

    return postings.groupBy("bucket").applyInArrow(run, "a long, b long, orders long")


def _candidates(sets: DataFrame, threshold: float, orders: int, count: int) -> DataFrame:
    """(a, b): pairs of sets of different labels that share a prefix token under every order."""
    pairs = _cross_pairs(_postings(sets, threshold, orders, count), threshold)
    return pairs.groupBy("a", "b").agg(F.bit_or("orders").alias("orders")).filter(F.col("orders") == (1 << orders) - 1).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float, orders: int) -> DataFrame:
    """Written (a, b, jaccard) of the pairs (a, b) that match, by their whole sets.

    A leader a of many sets meets them in several tasks, PARTNERS at a time.
    """
    pairs = written(pairs, "pairs")
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts")).filter("parts > 1")
    parted = pairs.join(many.withColumnRenamed("a", "lead"), F.col("a") == F.col("lead"), "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    wanted = parted.select(F.col("a").alias("fp"), "a", "part", F.lit(None).cast("long").alias("b")).distinct().union(parted.select(F.col("b").alias("fp"), "a", "part", "b"))
    jobs = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // (2 * PARTNERS)))
    wanted = written(wanted, "wanted")
    sent = sets.select("fp", "size", "tokens", "levels").join(light(wanted), "fp").select(F.pmod(F.xxhash64("a", "part"), F.lit(jobs)).alias("job"), "a", "part", "b", "size", "tokens", "levels")

    def run(key, rows):
        out = []
        for i, j in runs(rows, ["a", "part"]):  # the leader has no b and comes first
            jac = Block(rows, i, i + 1, threshold, orders).similar(Block(rows, i + 1, j, threshold, orders))[0]
            hit = np.flatnonzero(jac)
            out.append((np.full(len(hit), rows["a"][i].as_py()), rows["b"].slice(i + 1, j - i - 1).to_numpy()[hit], jac[hit]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 3
        return pa.table([pa.array(c.astype(t)) for c, t in zip(cols, (np.int64, np.int64, float))], names=["a", "b", "jaccard"])

    out = written(sent.groupBy("job").applyInArrow(lambda k, t: run(k, sorted_rows(t, ["a", "part", "b"])), "a long, b long, jaccard double"), "links")
    discard(pairs, wanted)
    return out


class Block:
    """Some sets: sizes, all their tokens and their prefixes under each order, each as (token, owner) arrays."""

    def __init__(self, rows: pa.Table, i: int, j: int, threshold: float, orders: int):
        part = rows.slice(i, j - i)
        tokens = [np.frombuffer(x.as_buffer(), U64) for x in part["tokens"]]
        self.size = part["size"].to_numpy().astype(np.float64)
        cut = [prefixes(int(s), t, np.frombuffer(v.as_buffer(), np.uint8), threshold, orders) for s, t, v in zip(self.size, tokens, part["levels"])]
        self.parts = [self._listed([c[k] for c in cut]) for k in range(orders)]
        self.all, self.threshold = self._listed(tokens), threshold

    @staticmethod
    def _listed(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(tokens), np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])

    def similar(self, other: Block) -> np.ndarray:
        """Jaccard similarity of each pair that passes all filters and matches, else 0."""
        low, high = np.minimum.outer(self.size, other.size), np.maximum.outer(self.size, other.size)
        may = low >= self.threshold * high - 1e-9
        for a, b in zip(self.parts, other.parts):
            if may.any():
                may &= overlap(a, b, may.shape) > 0
        if not may.any():
            return np.zeros(may.shape)
        both = overlap(self.all, other.all, may.shape)
        jac = both / (low + high - both)
        return np.where(may & (jac >= self.threshold - 1e-12), jac, 0.0)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Number of tokens that each set of a shares with each of b: products of incidence matrices of some tokens at a time."""
    out = np.zeros(shape, np.float32)
    common = np.intersect1d(a[0], b[0])
    if not len(common):
        return out
    sides = []
    for token, owner in (a, b):
        at = np.minimum(np.searchsorted(common, token), len(common) - 1)
        ok = common[at] == token
        order = np.argsort(at[ok], kind="stable")
        sides.append((at[ok][order], owner[ok][order]))
    width = max(256, min(len(common), _GRID // max(max(shape), 1)))
    for k in range(0, len(common), width):
        m = []
        for (at, owner), n in zip(sides, shape):
            i, j = np.searchsorted(at, [k, k + width])
            x = np.zeros((n, min(width, len(common) - k)), np.float32)
            x[owner[i:j], at[i:j] - k] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def _labelled(sets: DataFrame, edges: DataFrame) -> DataFrame:
    labels = light(components(edges))
    return sets.join(labels, sets.fp == labels.node, "left").select("fp", "size", "tokens", "levels", F.coalesce("label", "fp").alias("label"))


def set_links(sets: DataFrame, count: int, threshold: float = THRESHOLD, orders: int = ORDERS) -> DataFrame:
    """(a, b, jaccard): verified pairs of sets, by fingerprint, whose components are those of all matching pairs."""
    links = _verified(_stars(sets.withColumn("label", F.col("fp")), threshold), sets, threshold, orders)
    for _ in range(STARS - 1):
        links = links.union(_verified(_stars(_labelled(sets, links), threshold), sets, threshold, orders))
    pairs = _candidates(_labelled(sets, links), threshold, orders, count)
    return links.union(_verified(pairs, sets, threshold, orders))


def match_counts(sets: DataFrame, members: DataFrame, threshold: float = THRESHOLD, orders: int = ORDERS) -> DataFrame:
    """(fp, n): for each of the members (fp, label, weight), the weights of the other sets of its label that match, summed."""

    def similar(rows: pa.Table, one: tuple[int, int], two: tuple[int, int]) -> np.ndarray:
        a = Block(rows, *one, threshold, orders)
        return a.similar(a if one == two else Block(rows, *two, threshold, orders)) > 0

    items = sets.select(F.col("fp").alias("node"), F.col("size") * 9, "size", "tokens", "levels").toDF("node", "bytes", "size", "tokens", "levels")
    return class_matches(items, members.withColumnRenamed("fp", "node"), similar, BLOCK, BLOCK_BYTES, 2 * BLOCK).withColumnRenamed("node", "fp")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n: int = NGRAM, orders: int = ORDERS) -> DataFrame:
    """doc_id, class_id, n_links, n_copies of every document that matches another.

    class_id is the lowest doc_id of the documents that matches link to it;
    n_links counts the documents that it matches itself, n_copies those of them
    that have the very same set of grams.
    """
    data = documents_only(docs, id_col, text_col)
    count = buckets(docs, BUCKET_BYTES)
    sets, rows = set_table(data, n, count, threshold)
    ids = written(rows.distinct(), "ids")
    labels = written(components(set_links(sets, count, threshold, orders)).withColumnRenamed("node", "fp"), "labels")
    weights = ids.groupBy("fp").agg(F.count("*").alias("weight"), F.min("doc_id").alias("low"))
    grouped = written(weights.join(labels, "fp", "left"), "weights")
    matches = match_counts(sets, grouped.filter("label is not null").select("fp", "label", "weight"), threshold, orders)
    low = grouped.filter("label is not null").groupBy("label").agg(F.min("low").alias("class_id"))
    named = grouped.filter("label is not null or weight > 1").join(low, "label", "left").join(matches, "fp", "left")
    named = named.select("fp", F.coalesce("class_id", "low").alias("class_id"), (F.col("weight") - 1).alias("n_copies"), (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    return ids.join(light(written(named, "named")), "fp").select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n: int = NGRAM, orders: int = ORDERS) -> DataFrame:
    """docs with one document of each group: the lowest id (of its rows, should the id be repeated, the first by content).

    Rows with null ids or without words stay as they are, but where other rows of
    an id are dropped, its word-less rows go too. Only ids are joined with docs.
    """
    data = documents_only(docs, id_col, text_col)
    count = buckets(docs, BUCKET_BYTES)
    sets, ids = set_table(data, n, count, threshold)
    labels = components(set_links(sets, count, threshold, orders))
    distinct = ids.distinct().join(labels, F.col("fp") == F.col("node"), "left").withColumn("label", F.coalesce("label", "fp"))
    best = F.min(F.struct("doc_id", "fp"))
    reps = distinct.groupBy("label").agg(best.alias("rep"), F.count("*").alias("n")).filter("n > 1")
    drop = written(distinct.join(reps, "label").filter("doc_id != rep.doc_id or fp != rep.fp").select("doc_id", "fp"), "drop")
    repeated = written(ids.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated")
    key = F.col(f"`{id_col}`").cast("long")
    plain = join_ids(docs, drop.select("doc_id").union(repeated).distinct(), "left_anti", key)
    if not repeated.limit(1).count():
        return plain.select(*[F.col(f"`{c}`") for c in docs.columns])

    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        got = [gram_sets(s.column(0), n)[2].view(np.int64) for s in slices(pa.RecordBatch.from_arrays([texts], names=["t"]), "t")]
        return pa.array(np.concatenate(got) if got else np.zeros(0, np.int64))

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    again = docs.select(row, key.alias("doc_id"), fingerprint(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("fp"))
    again = again.join(repeated, "doc_id", "left_semi").join(drop, ["doc_id", "fp"], "left_anti")
    place = F.row_number().over(Window.partitionBy("doc_id", "fp").orderBy(F.to_json("row")))
    again = again.withColumn("place", F.when(F.col("fp") == 0, 1).otherwise(place)).filter("place = 1")
    return plain.select(*[F.col(f"`{c}`") for c in docs.columns]).union(again.select("row.*"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


#: All pairs by their grams, and classes by following matches from document to document.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9ªµº\x{C0}-\x{1FFF}\x{2040}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i+2], ' ') FOR i IN range(1, len(w) - 1)] END) AS gram FROM w WHERE len(w) > 0),
s AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
b AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
m AS (SELECT a, b, n = x.size AND n = y.size AS same FROM b JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 2 * n >= x.size + y.size - n),
r AS (SELECT DISTINCT a AS doc_id, a AS seen FROM m UNION SELECT r.doc_id, m.b FROM r JOIN m ON m.a = r.seen),
c AS (SELECT doc_id, min(seen) AS class_id FROM r GROUP BY doc_id)
SELECT c.doc_id, class_id, count(*) AS n_links, CAST(sum(CASE WHEN same THEN 1 ELSE 0 END) AS BIGINT) AS n_copies
FROM c JOIN m ON m.a = c.doc_id GROUP BY c.doc_id, class_id
"""
