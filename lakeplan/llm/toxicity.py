"""Operator 2: toxicity with a counterfactually regularised classifier.

Labelled documents give a linear classifier. Every labelled sentence that names
a group of people is also read with the name swapped for every other of its kind,
and training penalises any change of score, so the names themselves carry no weight
and neutral mentions are not flagged. A swap changes the counts of the two names'
features alone (at the sentence's own length), so all swaps of the whole sample
together are one small matrix, summed on the executors; none is left out. The cut
is the one of best F1 over scores that each fifth of the sample gets from a model
fitted on the rest; a score equal to the cut is toxic.

Cases: null and empty texts score 0 and are never toxic; very long texts are
scored whole; rows with null ids are
scored like any other; repeated rows get equal scores; without labels, with
labels of one class, or where no word tells the classes apart, nothing is toxic; an empty table gives no rows; labels that
are null or whose documents are missing are left out; other columns, whatever
their names, are ignored by ``toxicity`` and returned as they are by ``reject_toxic``.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linear
from .common import discard, ship, table
from .kernels import U64, mix, words

#: Terms that may be swapped for one another, by kind.
IDENTITY_TERMS = {
    "gender": "women men females males girls boys frauen männer mädchen jungen femmes hommes filles garçons mujeres hombres niñas niños transgender nonbinary",
    "gender_one": "woman man female male girl boy frau mann femme homme fille garçon mujer hombre niña niño",
    "religion": "muslims christians jews hindus buddhists sikhs catholics protestants atheists mormons muslime christen juden musulmans chrétiens juifs musulmanes cristianos judíos",
    "religion_adjective": "muslim christian jewish hindu buddhist sikh catholic protestant atheist mormon jüdisch christlich juif juive chrétien musulman musulmán cristiano judío",
    "orientation": "gay lesbian bisexual straight heterosexual homosexual queer schwul lesbisch lesbienne homosexuel",
    "origin": "african asian european american mexican chinese indian arab latino hispanic turkish polish russian african-american native",
    "origin_people": "africans asians europeans americans mexicans indians arabs latinos turks poles russians immigrants refugees foreigners migranten flüchtlinge ausländer immigrés réfugiés inmigrantes refugiados",
    "race": "black white brown",
    "age": "old young elderly teenage",
    "ability": "disabled blind deaf autistic",
}
SWAP_PENALTY = 2.0
FOLDS = 5
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True


class Terms:
    """The terms, of one word or several, by kind, and their features.

    features: all features of all terms, sorted; kinds[k]: (places of the kind's
    features, (terms, places) how often each term has each); by_length[n]: (sorted
    hashes of the n-word terms, (kind, term) of each).
    """

    def __init__(self, groups: dict[str, str]):
        names = [list(dict.fromkeys(kind.split())) for kind in groups.values()]
        parts = [[words(pa.array([t])) for t in kind] for kind in names]
        own = [[linear.word_features(w).ravel() for w in kind] for kind in parts]
        every = [f for kind in own for f in kind]
        self.features = np.unique(np.concatenate(every)) if every else np.zeros(0, U64)
        self.kinds, found = [], {}
        for k, kind in enumerate(own):
            used = np.unique(np.concatenate(kind)) if kind else np.zeros(0, U64)
            times = np.stack([np.bincount(np.searchsorted(used, f), minlength=len(used)) for f in kind]) if kind else np.zeros((0, 0))
            self.kinds.append((np.searchsorted(self.features, used), times))
            for t, w in enumerate(parts[k]):
                if len(w.hash):
                    found.setdefault(len(w.hash), []).append((int(_joint(w.hash, len(w.hash))[0]), k, t))
        self.by_length = {n: (np.array([x[0] for x in sorted(v)], U64), [x[1:] for x in sorted(v)]) for n, v in found.items()}


def _joint(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n words in a row."""
    out = h[: max(len(h) - n + 1, 0)]
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = mix(out * U64(0x9FB21C651E98DF25) + h[k : k + len(out)])
    return out


_terms: dict[tuple, Terms] = {}


def terms(groups: dict[str, str]) -> Terms:
    key = tuple(groups.items())
    if key not in _terms:
        _terms[key] = Terms(groups)
    return _terms[key]


def mentions(texts: pa.Array, groups: dict[str, str] = IDENTITY_TERMS) -> list[bytes]:
    """For each text, its mentions as 32-bit numbers: kind, term, words of the sentence, m, and m pairs (place in the kind's features, count in the sentence).

    Where terms overlap, the one of more words is meant.
    """
    known, w = terms(groups), words(texts)
    out: list[list[bytes]] = [[] for _ in range(len(w))]
    if not len(w.hash):
        return [b""] * len(w)
    stops = np.concatenate([[0], np.cumsum(_END[w.buf])])
    breaks = np.concatenate([[True], stops[w.start[1:]] > stops[w.end[:-1]]])
    breaks[w.offset[:-1][w.offset[:-1] < len(breaks)]] = True
    first, sentence = np.flatnonzero(breaks), np.cumsum(breaks) - 1
    last, doc, taken, hits = np.append(first[1:], len(w.hash)), w.doc, np.zeros(len(w.hash), bool), []
    for n in sorted(known.by_length, reverse=True):
        keys, who = known.by_length[n]
        h = _joint(w.hash, n)
        for i in np.flatnonzero(np.isin(h, keys)):
            if sentence[i] == sentence[i + n - 1] and not taken[i : i + n].any():
                taken[i : i + n] = True
                hits += [(int(i), *who[k]) for k in range(np.searchsorted(keys, h[i]), np.searchsorted(keys, h[i], "right"))]
    for i, kind, term in sorted(hits):
        s = sentence[i]
        f = linear.word_features(_Part(w, first[s], last[s])).ravel()
        used = known.features[known.kinds[kind][0]]
        at = np.minimum(np.searchsorted(used, f), len(used) - 1)
        places, n = np.unique(at[used[at] == f], return_counts=True)
        out[doc[i]].append(np.array([kind, term, last[s] - first[s], len(places), *np.stack([places, n], 1).ravel()], np.int32).tobytes())
    return [b"".join(x) for x in out]


class _Part:
    """Words i to j of a batch, as far as features need them."""

    def __init__(self, w, i: int, j: int):
        self.hash, self.buf, self.start, self.end = w.hash[i:j], w.buf[w.start[i] : w.end[j - 1]], w.start[i:j] - w.start[i], w.end[i:j] - w.start[i]


def swap_sums(blobs: list[bytes], groups: dict[str, str] = IDENTITY_TERMS) -> tuple[np.ndarray, int]:
    """(sum of d d^T, number) over all swaps of the mentions, d being the change of the values of ``terms(groups).features``."""
    known, seen, count = terms(groups), {}, 0
    for blob in blobs:
        v, at = np.frombuffer(blob, np.int32), 0
        while at < len(v):
            kind, term, n, m = (int(x) for x in v[at : at + 4])
            key = (kind, term, v[at + 4 : at + 4 + 2 * m].tobytes())
            seen[key] = seen.get(key, 0.0) + 1 / (n + linear.SHORT)
            count += len(known.kinds[kind][1]) - 1
            at += 4 + 2 * m
    out = np.zeros((len(known.features),) * 2)
    for (kind, term, had), weight in seen.items():
        places, times = known.kinds[kind]
        now, pairs = np.zeros(len(places)), np.frombuffer(had, np.int32).reshape(-1, 2)
        now[pairs[:, 0]] = pairs[:, 1]
        other = np.arange(len(times)) != term
        d = np.log1p(now - times[term] + times[other]) - np.log1p(now)
        out[np.ix_(places, places)] += weight * (d.T @ d)
    return out, count


def swaps(sample: DataFrame, groups: dict[str, str] = IDENTITY_TERMS) -> linear.Swaps:
    """All swaps of a sample table; tasks return sums by pair of features."""

    def run(batches):
        for b in batches:
            g, n = swap_sums([x.as_buffer() for x in b["extra"]], groups)
            i, j = np.nonzero(g)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()), pa.array(np.append(g[i, j], float(n)))], names=["i", "j", "s"])

    got = sample.select("extra").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    i, j, s = (got[c].to_numpy() for c in ("i", "j", "s"))
    features = terms(groups).features
    gram = np.zeros((len(features),) * 2)
    gram[i[i >= 0], j[i >= 0]] = s[i >= 0]
    return linear.Swaps(features, gram, int(s[i < 0].sum()))


def best_cut(logit: np.ndarray, toxic: np.ndarray) -> float:
    """Logit cut of best F1, half-way between the scores on its two sides."""
    order = np.argsort(-logit, kind="stable")
    s, y = logit[order], toxic[order]
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[1:] == s[:-1]] = -1  # equal scores stay together
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k])


class ToxicityModel:
    def __init__(self, linear_model: linear.LinearModel | None, cut: float, pairs: int):
        self.linear, self.cut, self.pairs = linear_model, cut, pairs

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.linear is None:
            return np.zeros(len(texts))
        z, _ = self.linear.logits(texts)
        p = 1 / (1 + np.exp(-(z[:, 1] - z[:, 0])))
        import pyarrow.compute as pc

        return np.where(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) > 0, p, 0.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", groups: dict[str, str] | None = None, swap_penalty: float = SWAP_PENALTY, max_train: int = linear.MAX_TRAIN, min_df: int = linear.MIN_DF, min_odds: float = linear.MIN_ODDS) -> ToxicityModel:
    """Fit on at most max_train labelled documents; swap_penalty 0 turns the counterfactual term off."""
    ids = linear.labelled_ids(labels, id_col, (F.col(f"`{label_col}`").cast("int") > 0), max_train)
    if not ids:
        return ToxicityModel(None, 1.1, 0)
    groups = groups or IDENTITY_TERMS
    rows = linear.sample_table(docs, ids, id_col, text_col, False, partial(mentions, groups=groups), FOLDS)
    sample = linear.sample_of(rows, 2, FOLDS, min_df, min_odds)
    if len(np.unique(sample.y)) < 2:
        discard(rows)
        return ToxicityModel(None, 1.1, 0)
    pairs = swaps(rows, groups) if swap_penalty > 0 else None
    discard(rows)
    fitted = lambda part: linear.fit(part, 2, swaps=pairs, swap_penalty=swap_penalty, min_odds=min_odds)
    logit = np.zeros(len(sample.y))
    for k in range(FOLDS):
        features, w, b = fitted(sample.part(sample.fold != k))
        z = sample.part(sample.fold == k).matrix(features).times(w) + b
        logit[sample.fold == k] = z[:, 1] - z[:, 0]
    features, w, b = fitted(sample)
    if not len(features):  # nothing tells the classes apart
        return ToxicityModel(None, 1.1, 0)
    cut = 1 / (1 + np.exp(-best_cut(logit, sample.y > 0)))
    return ToxicityModel(linear.LinearModel(features, w, b, False), cut, pairs.n if pairs else 0)


def score_column(model: ToxicityModel, text: F.Column) -> F.Column:
    """Toxicity in [0, 1] of each text, in Arrow batches."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts), pa.float64())

    return score(text.cast("string"))


def toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, toxicity, is_toxic of every row."""
    ship(docs.sparkSession)
    scored = docs.select(F.col(f"`{id_col}`").alias("doc_id"), score_column(model, F.col(f"`{text_col}`")).alias("toxicity"))
    return scored.withColumn("is_toxic", F.col("toxicity") >= F.lit(model.cut))


def reject_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not toxic, with all their columns."""
    ship(docs.sparkSession)
    return docs.filter(score_column(model, F.col(f"`{text_col}`")) < F.lit(model.cut))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
