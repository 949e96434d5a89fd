"""Operator 5: hidden Markov language model over the words of the corpus.

A state emits a word by way of its class: P(word | state) = P(class | state) *
P(word | class). Classes are hashes of a word's first bytes, so what Baum-Welch
trains has a fixed size; P(word | class) is the word's share of its class in the
counts of ALL words of the corpus, a table that grows with the input and stays in
the shared folder, and that is Baum-Welch's own update for it, as it is the same
in every state.

Each step scans all words of all documents: every task runs scaled
forward-backward over whole documents, many at a time as arrays, and sends the
expected counts of the classes that it met; the sums over tasks are the next
model. Where few documents are still running, their rests are cut into pieces
that run side by side; transfer matrices give the exact state probabilities at
the cuts, so no transition is lost and nothing depends on the cuts. Scoring runs
the scaled forward recursion over each whole document, so log_likelihood is exact
for sequences of any length.

Cases: null and empty texts have no words, log-likelihood 0 and a null
perplexity; null ids are kept; repeated rows count as often as they occur in
training and get equal scores (to rounding); very long texts are taken whole;
words that the corpus lacks keep a small probability; equal counts need no order;
an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets, ship, slices, table, written
from .kernels import U64, mix, prefix_hashes, ranges, words

STATES = 8
STEPS = 5
#: Word classes: hashes of the first so many bytes of a word.
CLASSES, PREFIX = 1 << 14, 4
#: Added to the expected count of each class in each state, and of each transition; to the count of each word in its class.
SMOOTH_ID, SMOOTH_STATE, SMOOTH_WORD = 1e-3, 1e-2, 0.1
#: Fewer documents than this still running: their rests are cut into pieces that run side by side.
_FEW, _PIECE = 100, 256
#: Bytes of text in a chunk of documents.
_CHUNK = 4 << 20


class Model:
    """start (K), move (K, K) from row to column, emit (K, classes); for a trained one, words and different words of each class."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, tokens: np.ndarray | None = None, types: np.ndarray | None = None):
        self.start, self.move, self.emit, self.tokens, self.types = start, move, emit, tokens, types

    def __getstate__(self):
        return self.start, self.move, self.emit.astype(np.float32), self.tokens, self.types

    def __setstate__(self, state):
        self.start, self.move, self.emit, self.tokens, self.types = state


_CHUNKS = "chunk long, doc_ids binary, no_id binary, offsets binary, words binary, classes binary, places binary"


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = _CHUNK) -> DataFrame:
    """Written table, a row for some documents: ids, word offsets, sorted different words (64-bit hashes) with their classes, and each word's place among them."""
    ship(docs.sparkSession)
    data = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.spark_partition_id().alias("part"))

    def run(batches):
        number = 0
        for b in batches:
            for s in slices(b, "text", chunk_bytes):
                parts = [(w.hash, prefix_hashes(w, (PREFIX,))[0], np.diff(w.offset)) for w in (words(x["text"]) for x in slices(s, "text"))]
                hashes, prefix, n = (np.concatenate(x) for x in zip(*parts))
                known, first, place = np.unique(hashes, return_index=True, return_inverse=True)
                class_, offset = (prefix[first] % U64(CLASSES)).astype(np.uint16), np.concatenate([[0], np.cumsum(n)])
                ids = s["doc_id"]
                row = (int(s["part"][0].as_py()) << 32 | number, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), ids.is_null().to_numpy(zero_copy_only=False).tobytes(), offset.astype(np.int64).tobytes(), known.tobytes(), class_.tobytes(), place.astype(np.uint32).tobytes())
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([x]) if k == 0 else pa.array([x], pa.binary()) for k, x in enumerate(row)], names=[c.split()[0] for c in _CHUNKS.split(", ")])

    return written(data.mapInArrow(run, _CHUNKS), "chunks")


def _opened(b: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """The arrays of each chunk."""
    kinds = {"doc_ids": np.int64, "no_id": bool, "offsets": np.int64, "words": U64, "classes": np.uint16, "places": np.uint32}
    for k in range(b.num_rows):
        yield {c: np.frombuffer(b[c][k].as_buffer(), kind) for c, kind in kinds.items() if c in b.schema.names} | ({"chunk": b["chunk"][k].as_py()} if "chunk" in b.schema.names else {})


def initial(counts: np.ndarray, states: int = STATES, seed: int = 0) -> Model:
    """Corpus frequencies, perturbed for each state."""
    rng = np.random.default_rng(seed)
    emit = (counts + SMOOTH_ID * 10)[None, :] * np.exp(rng.normal(0, 1, (states, len(counts))))
    move = np.full((states, states), 0.5 / states) + np.eye(states) * 0.5
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


class Lanes:
    """Forward-backward over sequences ids[start:start + length] side by side, longest first.

    before: state probabilities ahead of the first token, where the sequences continue documents.
    """

    def __init__(self, model: Model, ids: np.ndarray, start: np.ndarray, length: np.ndarray, before: np.ndarray | None = None):
        self.model, self.ids, self.start, self.before = model, ids, start, before
        self.move = model.move.astype(np.float32)
        self.live = np.searchsorted(-length, -np.arange(int(length[0])), "left")  # sequences longer than t
        self.alpha, self.emit, self.scale = [], [], []
        for t, n in enumerate(self.live):
            e = np.take(model.emit, ids[start[:n] + t], axis=1)
            last = self.alpha[-1][:, :n] if t else before
            a = (self.move.T @ last) * e if last is not None else model.start.astype(np.float32)[:, None] * e
            c = a.sum(0)
            a /= c
            for x, y in ((self.alpha, a), (self.emit, e), (self.scale, c)):
                x.append(y)

    def ends(self) -> np.ndarray:
        """State probabilities after each sequence's last token."""
        out = np.empty((len(self.move), len(self.start)), np.float32)
        for a, n in zip(self.alpha, self.live):
            out[:, :n] = a
        return out

    def count(self, totals: dict, after: np.ndarray | None = None) -> np.ndarray:
        """Add expected counts to totals; after: likelihood (to a factor) of what follows, by state. Returns the same for what comes before these sequences."""
        k = len(self.move)
        beta = np.ones((k, len(self.start)), np.float32) if after is None else after.astype(np.float32)
        beta = beta / (beta * self.ends()).sum(0)
        end = np.cumsum(self.live)
        where, gamma = np.empty(end[-1], np.int64), np.empty((k, end[-1]), np.float32)
        for t in range(len(self.live) - 1, -1, -1):
            n, at = self.live[t], slice(end[t] - self.live[t], end[t])
            where[at] = self.ids[self.start[:n] + t]
            np.multiply(self.alpha[t], beta[:, :n], out=gamma[:, at])
            last = self.alpha[t - 1][:, :n] if t else self.before
            if last is not None:
                eb = self.emit[t] * beta[:, :n]
                eb /= self.scale[t]
                totals["move"] += self.model.move * (last @ eb.T)
                beta[:, :n] = self.move @ eb
        totals["log"] += float(np.log(np.concatenate(self.scale)).sum(dtype=np.float64))
        if self.before is None:
            totals["start"] += gamma[:, : self.live[0]].sum(1, dtype=np.float64)
        for i in range(k):
            totals["emit"][i] += np.bincount(where, gamma[i], minlength=totals["emit"].shape[1])
        totals["n"] += len(where)
        return beta


class Pieces:
    """Sequences ids[start:start + length] in pieces, longest piece first, with the transfer matrix of each: states after it (rows) by states before."""

    def __init__(self, model: Model, ids: np.ndarray, start: np.ndarray, length: np.ndarray, piece: int):
        k = len(model.start)
        self.per = -(-length // piece)
        at = ranges(np.zeros(len(self.per), np.int64), self.per)
        first, size = np.repeat(start, self.per) + at * piece, np.minimum(np.repeat(length, self.per) - at * piece, piece)
        order = np.argsort(-size, kind="stable")
        self.first, self.size = first[order], size[order]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        move = model.move.astype(np.float64).T
        self.matrix = np.tile(np.eye(k)[:, None, :], (1, len(first), 1))  # state now, piece, state before
        self.log = np.zeros((len(first), k))
        for t in range(int(self.size[0])):
            live = int(np.searchsorted(-self.size, -t, "left"))
            e = np.take(model.emit, ids[self.first[:live] + t], axis=1).astype(np.float64)
            x = (move @ self.matrix[:, :live].reshape(k, -1)).reshape(k, live, k) * e[:, :, None]
            c = x.sum(0)
            self.matrix[:, :live] = x / c
            self.log[:live] += np.log(c)

    def forward(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state probabilities before each piece, log-likelihood of each sequence) after state probabilities a."""
        before, out, row = np.empty((len(a), len(self.first))), np.zeros(len(self.per)), 0
        for d, pieces in enumerate(self.per):
            v = a[:, d].astype(np.float64)
            for _ in range(pieces):
                p = self.place[row]
                before[:, p] = v
                top = self.log[p].max()
                v = self.matrix[:, p] @ (v * np.exp(self.log[p] - top))
                c = v.sum()
                out[d] += np.log(c) + top
                v, row = v / c, row + 1
        return before, out

    def backward(self) -> np.ndarray:
        """Likelihood, to a factor, of what follows each piece, by state."""
        after, row = np.empty((self.matrix.shape[0], len(self.first))), len(self.first)
        for pieces in self.per[::-1]:
            v = np.ones(self.matrix.shape[0])
            for _ in range(pieces):
                row -= 1
                p = self.place[row]
                after[:, p] = v
                v = (self.matrix[:, p].T @ v) * np.exp(self.log[p] - self.log[p].max())
                v = v / v.sum()
        return after

    def first_of(self) -> np.ndarray:
        """Place of each sequence's first piece."""
        return self.place[np.cumsum(self.per) - self.per]


def _cut(length: np.ndarray, few: int, piece: int) -> int:
    """Tokens that documents (longest first) take side by side before the rests of the few longest are cut into pieces."""
    longest = int(length[0])
    if longest <= piece:
        return longest
    others = int(length[few - 1]) if len(length) >= few else 0  # fewer than ``few`` are longer
    return longest if longest - others <= piece else max(others, 1)


def expected_counts(model: Model, ids: np.ndarray, off: np.ndarray, totals: dict, few: int = _FEW, piece: int = _PIECE) -> None:
    """Add the expected counts of whole documents ids[off[i]:off[i + 1]] to totals."""
    n = np.diff(off)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    if not len(order):
        return
    start, length = off[:-1][order], n[order]
    cut = _cut(length, few, piece)
    rest = int(np.searchsorted(-length, -cut, "left"))
    main = Lanes(model, ids, start, np.minimum(length, cut))
    after = np.ones((len(model.start), len(start)), np.float32)
    if rest:
        p = Pieces(model, ids, start[:rest] + cut, length[:rest] - cut, piece)
        before, _ = p.forward(main.alpha[-1][:, :rest])
        lanes = Lanes(model, ids, p.first, p.size, before.astype(np.float32))
        after[:, :rest] = lanes.count(totals, p.backward())[:, p.first_of()]
    main.count(totals, after)


def _empty(k: int, v: int) -> dict:
    return {"start": np.zeros(k), "move": np.zeros((k, k)), "emit": np.zeros((k, v)), "log": 0.0, "n": 0}


def step(data: DataFrame, model: Model) -> tuple[Model, float]:
    """One Baum-Welch step over all documents; the new model and the mean log-likelihood a word's class under the old one.

    Each task returns one row for each class it met and a few for states; sums are
    taken in a shuffle by class, and the driver gets one row for each class.
    """
    k, v = model.emit.shape

    def run(batches):
        total = _empty(k, v)
        for b in batches:
            for c in _opened(b):
                expected_counts(model, c["classes"][c["places"]], c["offsets"], total)
        used = np.flatnonzero(total["emit"].any(0))
        rows = np.concatenate([total["emit"][:, used].T, total["move"], total["start"][None, :], np.array([[total["log"], total["n"], *[0.0] * (k - 2)]])])
        keys = np.concatenate([used, v + np.arange(k + 2)])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array(rows[:, i].astype(np.float32)) for i in range(k))], names=["id", *(f"c{i}" for i in range(k))])

    schema = ", ".join(["id int", *(f"c{i} float" for i in range(k))])
    got = data.select("offsets", "classes", "places").mapInArrow(run, schema).groupBy("id").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(k))).toArrow()
    sums = np.zeros((v + k + 2, k))
    sums[got["id"].to_numpy()] = np.stack([got[f"c{i}"].to_numpy() for i in range(k)], 1)
    emit, move, start, (log, n) = sums[:v].T + SMOOTH_ID, sums[v : v + k] + SMOOTH_STATE, sums[v + k] + SMOOTH_STATE, sums[v + k + 1][:2]
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True), model.tokens, model.types), log / max(n, 1)


def _by_bucket(words_: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the words by bucket, place in it where each bucket begins)."""
    bucket = (mix(words_) % U64(count)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(count + 1))


class Counts:
    """How often the corpus has each word: a written table (bucket, words, classes, counts), packed."""

    def __init__(self, table_: DataFrame, buckets_: int):
        self.table, self.buckets = table_, buckets_


def count_words(data: DataFrame, count: int) -> Counts:
    """Counts of all words of all chunks, in ``count`` hash buckets."""

    def spread(batches):
        for b in batches:
            for c in _opened(b):
                n = np.bincount(c["places"], minlength=len(c["words"])).astype(np.int64)
                order, edge = _by_bucket(c["words"], count)
                rows = [(k, *(x[order[i:j]].tobytes() for x in (c["words"], c["classes"], n))) for k, (i, j) in enumerate(zip(edge, edge[1:])) if i < j]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 3))], names=["bucket", "words", "classes", "counts"])

    def add(key, rows):
        join = lambda c, kind: np.frombuffer(b"".join(x.as_buffer() for x in rows[c]), kind)
        known, first, at = np.unique(join("words", U64), return_index=True, return_inverse=True)
        n = np.bincount(at, join("counts", np.int64)).astype(np.int64)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (known, join("classes", np.uint16)[first], n))], names=["bucket", "words", "classes", "counts"])

    kind = "bucket int, words binary, classes binary, counts binary"
    return Counts(written(data.select("words", "classes", "places").mapInArrow(spread, kind).groupBy("bucket").applyInArrow(add, kind), "counts"), count)


def class_sizes(counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """(words, different words) of each class."""

    def run(batches):
        total = np.zeros((2, CLASSES), np.int64)
        for b in batches:
            for c, n in zip(b["classes"], b["counts"]):
                class_, n = np.frombuffer(c.as_buffer(), np.uint16), np.frombuffer(n.as_buffer(), np.int64)
                total += np.stack([np.bincount(class_, n, CLASSES).astype(np.int64), np.bincount(class_, minlength=CLASSES)])
        used = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(x[used]) for x in total)], names=["id", "tokens", "types"])

    got = counts.table.select("classes", "counts").mapInArrow(run, "id long, tokens long, types long").groupBy("id").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).toArrow()
    out = np.zeros((2, CLASSES), np.int64)
    out[:, got["id"].to_numpy()] = [got["tokens"].to_numpy(), got["types"].to_numpy()]
    return out[0], out[1]


def train(data: DataFrame, states: int = STATES, steps: int = STEPS, seed: int = 0) -> tuple[Model, Counts, list[float]]:
    """Model, word counts, and the mean log-likelihood a word's class before each step; data as of ``chunks``."""
    counts = count_words(data, buckets(data))
    tokens, types = class_sizes(counts)
    model, seen = initial(tokens, states, seed), []
    model.tokens, model.types = tokens, types
    for _ in range(steps):
        model, mean = step(data, model)
        seen.append(mean)
    return model, counts, seen


def log_likelihoods(model: Model, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Exact log-likelihood of each sequence of classes by the scaled forward recursion."""
    n = np.diff(off)
    order = np.argsort(-n, kind="stable")
    start, length = off[:-1][order], n[order]
    out = np.zeros(len(n))
    if not len(n) or not length[0]:
        return out
    emit, move = model.emit.astype(np.float64), model.move.astype(np.float64).T
    part, a, cut = np.zeros(len(n)), None, _cut(length, _FEW, _PIECE)
    for t in range(cut):
        live = int(np.searchsorted(-length, -t, "left"))
        e = np.take(emit, ids[start[:live] + t], axis=1)
        a = (model.start[:, None] * e) if t == 0 else (move @ a[:, :live]) * e
        c = a.sum(0)
        a /= c
        part[:live] += np.log(c)
    rest = int(np.searchsorted(-length, -cut, "left"))
    if rest:
        part[:rest] += Pieces(model, ids, start[:rest] + cut, length[:rest] - cut, _PIECE).forward(a[:, :rest])[1]
    out[order] = part
    return out


def scores(data: DataFrame, model: Model, counts: Counts) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, perplexity of every document of a chunk table.

    The words of each chunk go to the counts by hash bucket, and their shares come
    back to the chunk: one entry for each different word of a chunk.
    """
    count, tokens, types = counts.buckets, model.tokens, model.types

    def ask(batches):
        for b in batches:
            for c in _opened(b):
                order, edge = _by_bucket(c["words"], count)
                rows = [(k, c["chunk"], c["words"][order[i:j]].tobytes(), c["classes"][order[i:j]].tobytes()) for k, (i, j) in enumerate(zip(edge, edge[1:])) if i < j]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "chunk", "words", "classes"])

    def answer(key, asked, known):
        have, n = (np.frombuffer(known[c][0].as_buffer(), t) if len(known) else np.zeros(0, t) for c, t in (("words", U64), ("counts", np.int64)))
        out = []
        for w, c in zip(asked["words"], asked["classes"]):
            w, c = np.frombuffer(w.as_buffer(), U64), np.frombuffer(c.as_buffer(), np.uint16)
            at = np.minimum(np.searchsorted(have, w), max(len(have) - 1, 0))
            got = np.where(have[at] == w, n[at], 0) if len(have) else np.zeros(len(w))
            out.append(np.log((got + SMOOTH_WORD) / (tokens[c] + SMOOTH_WORD * (types[c] + 1))).astype(np.float32).tobytes())
        return pa.table([asked["chunk"], asked["bucket"], pa.array(out, pa.binary())], names=["chunk", "bucket", "logs"])

    def score(key, own, logs):
        out = []
        for c in _opened(own):
            order, edge = _by_bucket(c["words"], count)
            share = np.zeros(len(c["words"]))
            for k, x in zip(logs["bucket"].to_pylist(), logs["logs"]):
                share[order[edge[k] : edge[k + 1]]] = np.frombuffer(x.as_buffer(), np.float32)
            off = c["offsets"]
            n, total = np.diff(off), np.concatenate([[0.0], np.cumsum(share[c["places"]])])
            ll = log_likelihoods(model, c["classes"][c["places"]], off) + total[off[1:]] - total[off[:-1]]
            ppl = np.exp(np.minimum(-ll / np.maximum(n, 1), 700))
            out.append(pa.table([pa.array(c["doc_ids"], mask=c["no_id"]), pa.array(n), pa.array(ll), pa.array(ppl, mask=n == 0)], names=["doc_id", "n_tokens", "log_likelihood", "perplexity"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=["doc_id", "n_tokens", "log_likelihood", "perplexity"])

    asked = data.select("chunk", "words", "classes").mapInArrow(ask, "bucket int, chunk long, words binary, classes binary")
    logs = asked.groupBy("bucket").cogroup(counts.table.groupBy("bucket")).applyInArrow(answer, "chunk long, bucket int, logs binary")
    return data.groupBy("chunk").cogroup(logs.groupBy("chunk")).applyInArrow(score, "doc_id long, n_tokens long, log_likelihood double, perplexity double")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = chunks(table(spark, sf_dir, "documents"))
    model, counts, _ = train(data)
    return scores(data, model, counts)
