"""Linear text classifiers: vectorised features, training on a bounded labelled sample, scoring of whole texts.

Features of a text are its words, their first 4 and 6 bytes, and (optionally) a
few style bins such as the share of symbols. A feature's value is log(1 + count)
over the square root of the text's words, so long texts are not favoured. Only
features of at least ``min_df`` sampled documents whose log-odds between classes
reach ``min_odds`` are used, scaled by these log-odds before the weights are fitted.
They are counted and chosen on the executors; the driver gets, of at most
``MAX_TRAIN`` documents, the features chosen, and no text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, ship, slices, written
from .kernels import U64, Words, mix, prefix_hashes, text_buffer, words

#: Most labelled documents that a classifier is fitted on: those of lowest hashed id.
MAX_TRAIN = 6_000
#: Defaults: documents of the sample that a feature must be in, and its least log-odds between a class and the rest.
MIN_DF = 4
MIN_ODDS = 0.7
#: Added to a text's words in the scale of its values.
SHORT = 10
FAMILIES = 3
STYLES = 8


#: Byte classes whose shares are style features.
_CLASSES = np.zeros((256, 6))
for _k, _set in enumerate((range(65, 91), range(48, 58), b"#$%&*@=+<>{}[]\\^~_", b"|", b"!?", b"\n")):
    _CLASSES[list(_set), _k] = 1


def _shares(w: Words, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per text: share of each byte class, words a distinct word (octaves), mean word length (tens)."""
    counts = np.stack([np.bincount(raw[i:j], minlength=256) for i, j in zip(off, off[1:])])
    n = np.maximum(np.diff(w.offset), 1)
    key = np.sort((w.doc.astype(U64) << U64(48)) | (w.hash & U64((1 << 48) - 1)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    distinct = np.maximum(np.bincount((key[new] >> U64(48)).astype(np.int64), minlength=len(w)), 1)
    length = np.concatenate([[0], np.cumsum(w.end - w.start)])
    return np.column_stack([counts @ _CLASSES / np.maximum(np.diff(off), 1)[:, None], np.log2(n / distinct), (length[w.offset[1:]] - length[w.offset[:-1]]) / n / 10])


def style_features(texts: pa.Array, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature): one feature for the bin of each style share."""
    v = _shares(w, *text_buffer(texts))
    b = np.minimum(np.floor(np.log2(1 + v * 256)), 15).astype(np.int64)
    code = np.arange(v.shape[1])[None, :] * 16 + b
    return np.repeat(np.arange(len(w)), v.shape[1]), mix(code.ravel().astype(U64) + U64(0x5715))


def word_features(w: Words) -> np.ndarray:
    """(FAMILIES, words) feature hashes."""
    return np.stack([w.hash, *prefix_hashes(w, (4, 6))])


def counted(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, feature, count) of each distinct pair."""
    order = np.lexsort((feature, doc))
    doc, feature = doc[order], feature[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
    at = np.flatnonzero(new)
    return doc[at], feature[at], np.diff(np.append(at, len(doc)))


def text_features(texts: pa.Array, style: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = words(texts)
    doc, feature = np.tile(w.doc, FAMILIES), word_features(w).ravel()
    if style:
        d, f = style_features(texts, w)
        doc, feature = np.concatenate([doc, d]), np.concatenate([feature, f])
    return counted(doc, feature)


class LinearModel:
    """Weights by feature hash; ``logits`` scores whole texts."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: np.ndarray, style: bool):
        self.features, self.weights, self.bias, self.style = features, weights, bias, style
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self.slot(features)] = True

    @staticmethod
    def slot(feature: np.ndarray) -> np.ndarray:
        return (feature & U64((1 << 22) - 1)).astype(np.int64)

    def __getstate__(self):
        return self.features, self.weights, self.bias, self.style

    def __setstate__(self, state):
        self.__init__(*state)

    def rows(self, doc: np.ndarray, feature: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Logits of texts from all their (text, feature) occurrences."""
        n = len(n_words)
        size = len(self.features)
        out = np.tile(self.bias, (n, 1))
        if not size or not len(feature):
            return out
        may = self.filter[self.slot(feature)]  # most words carry no weight
        doc, feature = doc[may], feature[may]
        at = np.minimum(np.searchsorted(self.features, feature), size - 1)
        ok = self.features[at] == feature
        key = np.sort(doc[ok] * size + at[ok])
        if not len(key):
            return out
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        value = np.log1p(np.diff(np.append(first, len(key))))
        doc, at = np.divmod(key[first], size)
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(doc, value * self.weights[at, k], n) / np.sqrt(n_words + SHORT)
        return out

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(logits, words) of each text."""
        out, count = [np.zeros((0, len(self.bias)))], [np.zeros(0, np.int64)]
        for s in slices(pa.RecordBatch.from_arrays([texts], names=["t"]), "t"):
            w = words(s.column(0))
            doc, feature = np.tile(w.doc, FAMILIES), word_features(w).ravel()
            if self.style:
                d, f = style_features(s.column(0), w)
                doc, feature = np.concatenate([doc, d]), np.concatenate([feature, f])
            out.append(self.rows(doc, feature, np.diff(w.offset)))
            count.append(np.diff(w.offset))
        return np.concatenate(out), np.concatenate(count)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Matrix:
    """Sparse rows of feature values."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int, m: int):
        self.row, self.col, self.value, self.n, self.m = row, col, value, n, m

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.row, self.value * w[self.col, k], self.n).astype(float) for k in range(w.shape[1])], 1)

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.col, self.value * r[self.row, k], self.m).astype(float) for k in range(r.shape[1])], 1)


class Sample:
    """Labelled documents: class, fold and words of each, and the counts of its features in a sorted vocabulary."""

    def __init__(self, y: np.ndarray, fold: np.ndarray, n_words: np.ndarray, row: np.ndarray, col: np.ndarray, count: np.ndarray, vocabulary: np.ndarray):
        self.y, self.fold, self.n_words, self.row, self.col, self.count, self.vocabulary = y, fold, n_words, row, col, count, vocabulary

    def part(self, rows: np.ndarray) -> Sample:
        """The documents where ``rows`` is true."""
        ok = rows[self.row]
        return Sample(self.y[rows], self.fold[rows], self.n_words[rows], (np.cumsum(rows) - 1)[self.row[ok]], self.col[ok], self.count[ok], self.vocabulary)

    def matrix(self, features: np.ndarray, scale: np.ndarray | None = None) -> Matrix:
        """Values of the sorted ``features``, each times its scale."""
        at = np.minimum(np.searchsorted(features, self.vocabulary), max(len(features) - 1, 0))
        known = features[at] == self.vocabulary if len(features) else np.zeros(len(at), bool)
        ok = known[self.col]
        row, col = self.row[ok], at[self.col[ok]]
        value = np.log1p(self.count[ok]) / np.sqrt(self.n_words + SHORT)[row]
        return Matrix(row, col, value if scale is None else value * scale[col], len(self.y), len(features))

    def odds(self, classes: int) -> np.ndarray:
        """Largest absolute log-odds of each feature between a class and the rest, by document frequency."""
        df = np.stack([np.bincount(self.col[self.y[self.row] == k], minlength=len(self.vocabulary)) for k in range(classes)], 1)
        n = np.bincount(self.y, minlength=classes)
        inside = np.log((df + 0.5) / (n + 1))
        outside = np.log((df.sum(1, keepdims=True) - df + 0.5) / (n.sum() - n + 1))
        return np.abs(inside - outside)[:, n > 0].max(1)


class Swaps:
    """All counterfactual pairs of the sample: sum over pairs of the outer product of the change of feature values."""

    def __init__(self, features: np.ndarray, gram: np.ndarray, n: int):
        self.features, self.gram, self.n = features, gram, n

    def within(self, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the vocabulary, sums over pairs of these features' changes)."""
        at = np.minimum(np.searchsorted(vocabulary, self.features), max(len(vocabulary) - 1, 0))
        ok = np.flatnonzero(vocabulary[at] == self.features) if len(vocabulary) else np.zeros(0, np.int64)
        return at[ok], self.gram[np.ix_(ok, ok)] / max(self.n, 1)


def minimise(f, x: np.ndarray, steps: int = 60, memory: int = 8, tolerance: float = 1e-6) -> np.ndarray:
    """L-BFGS with halving line search; f gives value and gradient."""
    value, grad = f(x)
    history: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, a = -grad, []
        for s, y, rho in reversed(history):
            a.append(rho * (s @ d))
            d = d - a[-1] * y
        if history:
            s, y, rho = history[-1]
            d = d / (rho * (y @ y))
        for (s, y, rho), k in zip(history, reversed(a)):
            d = d + (k - rho * (y @ d)) * s
        slope = grad @ d
        if slope >= 0:
            d, slope, history = -grad, -(grad @ grad), []
        t = 1.0
        for _ in range(25):
            new_value, new_grad = f(x + t * d)
            if new_value <= value + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = t * d, new_grad - grad
        if s @ y > 1e-12:
            history = [*history[1 - memory :], (s, y, 1 / (s @ y))]
        gain = value - new_value
        x, value, grad = x + s, new_value, new_grad
        if gain < tolerance * max(1.0, abs(value)):
            break
    return x


def loss_of(sample: Sample, features: np.ndarray, scale: np.ndarray, classes: int, l2: float, swaps: Swaps | None, swap_penalty: float, balanced: bool):
    """Value and gradient of the training loss as a function of (scaled weights, biases) in one vector.

    Cross-entropy, ridge, and swap_penalty times the mean over pairs of the squared change of logits.
    """
    y, m = sample.y, len(features)
    have = np.bincount(y, minlength=classes)
    x = sample.matrix(features, scale)
    at, gram = swaps.within(features) if swaps and swap_penalty > 0 else (np.zeros(0, np.int64), np.zeros((0, 0)))
    weight = (np.where(have > 0, len(y) / (np.maximum(have, 1) * (have > 0).sum()), 0.0)[y] if balanced else np.ones(len(y))) / len(y)
    target = np.eye(classes)[y]

    def loss(v):
        w, b = v[: m * classes].reshape(m, classes), v[m * classes :]
        p = softmax(x.times(w) + b)
        value = -(weight * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum() + l2 / 2 * (w * w).sum()
        r = (p - target) * weight[:, None]
        g = x.transposed_times(r) + l2 * w
        if len(at):
            u = w[at] * scale[at, None]
            d = gram @ u
            value += swap_penalty * (u * d).sum()
            g[at] += 2 * swap_penalty * scale[at, None] * d
        return value, np.concatenate([g.ravel(), r.sum(0)])

    return loss


def fit(sample: Sample, classes: int, l2: float = 1e-3, swaps: Swaps | None = None, swap_penalty: float = 1.0, balanced: bool = True, min_odds: float = MIN_ODDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, bias) of softmax regression on the features that tell the sample's classes apart."""
    y, have = sample.y, np.bincount(sample.y, minlength=classes)
    if not len(y) or (have > 0).sum() < 2:
        return np.zeros(0, U64), np.zeros((0, classes)), np.where((have > 0) | (len(y) == 0), 0.0, -50.0)
    scale = sample.odds(classes) if len(sample.vocabulary) else np.zeros(0)
    features, scale = sample.vocabulary[scale >= min_odds], scale[scale >= min_odds]
    m = len(features)
    start = np.concatenate([np.zeros(m * classes), np.log(np.maximum(have, 0.5) / len(y)) if not balanced else np.zeros(classes)])
    v = minimise(loss_of(sample, features, scale, classes, l2, swaps, swap_penalty, balanced), start)
    return features, v[: m * classes].reshape(m, classes) * scale[:, None], v[m * classes :]


def labelled_ids(labels: DataFrame, id_col: str, label: F.Column, most: int = MAX_TRAIN) -> list[tuple[int, int]]:
    """(id, class) of at most ``most`` labelled rows, lowest hashed id first; null ids and labels are left out.

    A repeated id counts once, with its lowest label.
    """
    rows = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("int").alias("y")).dropna().groupBy("id").agg(F.min("y").alias("y"))
    return sorted((r.id, r.y) for r in rows.orderBy(F.xxhash64("id"), "id").limit(most).collect())


def sample_table(docs: DataFrame, ids: list[tuple[int, int]], id_col: str, text_col: str, style: bool, extra=None, folds: int = 1) -> DataFrame:
    """Written table, a row for each chosen document: id, y, fold, n_words, binary features and counts, and what ``extra(texts)`` adds as binary.

    Of the rows of a repeated id one counts, the same at any order of rows.
    """
    spark = docs.sparkSession
    ship(spark)
    wanted = spark.createDataFrame([(i, y, k % folds) for k, (i, y) in enumerate(ids)], "id long, y int, fold int")
    data = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).join(F.broadcast(wanted), "id")  # bounded by MAX_TRAIN ids

    def run(batches):
        for b in batches:
            for s in slices(b, "text"):
                doc, feature, count = text_features(s.column("text"), style)
                cut = np.searchsorted(doc, np.arange(s.num_rows + 1))
                add = extra(s.column("text")) if extra else [b""] * s.num_rows
                total = [(int(count[i:j].sum()) - (STYLES if style else 0)) // FAMILIES for i, j in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in ("id", "y", "fold")), pa.array(total, pa.int64()), pa.array([feature[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()), pa.array([count[i:j].astype(np.uint32).tobytes() for i, j in zip(cut, cut[1:])], pa.binary()), pa.array(add, pa.binary())], names=["id", "y", "fold", "n_words", "features", "counts", "extra"])

    rows = data.mapInArrow(run, "id long, y int, fold int, n_words long, features binary, counts binary, extra binary")
    table = written(rows.withColumn("mark", F.xxhash64("features", "counts", "extra")), "sample")
    first = table.groupBy("id").agg(F.min("mark").alias("mark"), F.count("*").alias("n"))
    if not first.filter("n > 1").limit(1).count():
        return table
    one = written(table.join(first, ["id", "mark"], "left_semi").dropDuplicates(["id"]), "sample")
    discard(table)
    return one


def _features(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all features in a batch of a sample table."""
    n = np.array([len(x.as_buffer()) // 8 for x in b["features"]], np.int64)
    return np.repeat(np.arange(b.num_rows), n), np.frombuffer(b"".join(x.as_buffer() for x in b["features"]), U64)


def vocabulary(table: DataFrame, classes: int, folds: int, min_df: int = MIN_DF, min_odds: float = MIN_ODDS) -> np.ndarray:
    """Sorted features that the whole sample, or all of it but one fold, would use; counted and chosen on the executors."""
    cells = folds * classes

    def run(batches):
        for b in batches:
            if b.num_rows:
                row, feature = _features(b)
                cell = (b["fold"].to_numpy() * classes + b["y"].to_numpy()).astype(np.int64)[row]
                used, at = np.unique(feature, return_inverse=True)
                n = np.bincount(at * cells + cell, minlength=len(used) * cells).reshape(-1, cells)
                yield pa.RecordBatch.from_arrays([pa.array(used.view(np.int64)), *(pa.array(n[:, c].astype(np.int32)) for c in range(cells))], names=["feature", *(f"c{c}" for c in range(cells))])

    n = np.zeros((folds, classes), np.int64)
    for r in table.groupBy("fold", "y").count().collect():
        n[r.fold, r.y] = r["count"]
    counted_ = table.select("y", "fold", "features").mapInArrow(run, ", ".join(["feature long", *(f"c{c} int" for c in range(cells))]))
    sums = counted_.groupBy("feature").agg(*(F.sum(f"c{c}").alias(f"c{c}") for c in range(cells)))
    total = lambda fs, k: sum((F.col(f"c{f * classes + k}") for f in fs), F.lit(0))
    tests = []
    for part in [range(folds), *([f for f in range(folds) if f != g] for g in range(folds) if folds > 1)]:
        have = n[list(part)].sum(0)
        every = sum((total(part, k) for k in range(classes)), F.lit(0))
        for k in np.flatnonzero(have):
            inside = F.log((total(part, k) + 0.5) / float(have[k] + 1))
            outside = F.log((every - total(part, k) + 0.5) / float(have.sum() - have[k] + 1))
            tests.append(F.abs(inside - outside))
    if not tests:
        return np.zeros(0, U64)
    enough = tests[0] if len(tests) == 1 else F.greatest(*tests)
    whole = sum((total(range(folds), k) for k in range(classes)), F.lit(0))
    chosen = sums.filter((whole >= min_df) & (enough >= min_odds - 1e-6)).select("feature").toArrow()
    return np.sort(chosen["feature"].to_numpy().view(U64))


def sample_of(table: DataFrame, classes: int, folds: int = 1, min_df: int = MIN_DF, min_odds: float = MIN_ODDS) -> Sample:
    """The sample table's documents over its vocabulary, by id."""
    vocab = vocabulary(table, classes, folds, min_df, min_odds)

    def run(batches):
        for b in batches:
            cols, counts = [], []
            for f, c in zip(b["features"], b["counts"]):
                feature, count = np.frombuffer(f.as_buffer(), U64), np.frombuffer(c.as_buffer(), np.uint32)
                at = np.minimum(np.searchsorted(vocab, feature), max(len(vocab) - 1, 0))
                ok = vocab[at] == feature if len(vocab) else np.zeros(len(feature), bool)
                cols.append(at[ok].astype(np.int32).tobytes())
                counts.append(count[ok].tobytes())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("id", "y", "fold", "n_words")), pa.array(cols, pa.binary()), pa.array(counts, pa.binary())], names=["id", "y", "fold", "n_words", "cols", "counts"])

    t = table.select("id", "y", "fold", "n_words", "features", "counts").mapInArrow(run, "id long, y int, fold int, n_words long, cols binary, counts binary").toArrow().sort_by("id")
    join = lambda c, kind: np.frombuffer(b"".join(x.as_buffer() for x in t[c]), kind)
    row = np.repeat(np.arange(len(t)), [len(x.as_buffer()) // 4 for x in t["cols"]])
    return Sample(*(t[c].to_numpy().astype(np.int64) for c in ("y", "fold", "n_words")), row, join("cols", np.int32).astype(np.int64), join("counts", np.uint32), vocab)
