"""Operator 1: mixing sources to target weights by soft domain membership.

A classifier fitted on a labelled table gives every document a posterior over
domains, and document d of n_d tokens gets a rate r_d >= floor such that the
expected tokens of each domain, sum of r_d n_d p_dk, match the target. The rates
minimise

    sum_k (S_k - T_k)^2 / T_k + ridge * sum_d n_d / N * (r_d - 1)^2

by accelerated projected gradient steps. With a step weighted by 1 / n_d, a rate
follows from its document's posterior and the past domain totals alone, so each
step is one scan of the small posterior table that returns K sums, and no rate is
ever stored or shuffled. The steps begin at the optimum of a few thousand rows,
found on the driver in the same way, so few scans remain; they end where the
totals are on target or no step changes them, which ``Plan.reached`` tells apart.

Cases: null and empty texts have no tokens and get the prior as posterior; very
long texts are taken whole; null
ids are kept; repeated rows get equal rates, and each draws its own fractional
copy; a label row that meets several conditions belongs to the first;
domains without labelled documents
drop out and the other weights are rescaled; without labels all rates are 1; an
empty table gives no rows; other columns, whatever their names, are ignored by
``mixing_rates`` and returned as they are by ``apply_rates``.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linear
from .common import discard, ship, table, written

TOLERANCE = 2e-3
#: Change of each total, against its target, below which a step counts as none; so many in a row end the fit.
STILL, STILL_STEPS = 1e-5, 3
#: Rows on which the driver finds the point where the steps begin; it has no part in the optimum.
START_ROWS = 4096
RIDGE = 1e-4
#: Domains by label columns, in order: the first condition that holds is a row's domain.
DOMAINS = {"toxic": "toxic = 1", "high": "quality = 1", "low": "quality = 0"}
WEIGHTS = {"high": 0.80, "low": 0.18, "toxic": 0.02}


class DomainModel:
    """Posterior over ``names`` and token count of each text."""

    def __init__(self, names: list[str], model: linear.LinearModel):
        self.names, self.model = names, model

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        z, n = self.model.logits(texts)
        return linear.softmax(z), n


def train(docs: DataFrame, labels: DataFrame, domains: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", max_train: int = linear.MAX_TRAIN, min_df: int = linear.MIN_DF, min_odds: float = linear.MIN_ODDS) -> DomainModel:
    """Fit on at most max_train labelled documents; domains are SQL conditions on the label columns."""
    names = list(domains or DOMAINS)
    label = None
    for k, name in enumerate(names):
        test = F.expr((domains or DOMAINS)[name])
        label = F.when(test, k) if label is None else label.when(test, k)
    ids = linear.labelled_ids(labels, id_col, label, max_train)
    if not ids:
        return DomainModel(["all"], linear.LinearModel(np.zeros(0, linear.U64), np.zeros((0, 1)), np.zeros(1), True))
    rows = linear.sample_table(docs, ids, id_col, text_col, True)
    sample = linear.sample_of(rows, len(names), 1, min_df, min_odds)
    discard(rows)
    have = np.unique(sample.y) if len(sample.y) else np.array([0])
    sample.y = np.searchsorted(have, sample.y)
    features, w, b = linear.fit(sample, len(have), l2=3e-4, balanced=False, min_odds=min_odds)
    return DomainModel([names[k] for k in have] if len(sample.y) else ["all"], linear.LinearModel(features, w, b, True))


def posteriors(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """Written table (doc_id, n_tokens, p) of all rows; ``whole``: with the rows themselves as ``row``."""
    ship(docs.sparkSession)

    @F.arrow_udf("struct<n_tokens: long, p: array<double>>")
    def score(texts: pa.Array) -> pa.Array:
        p, n = model.posteriors(texts)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1], pa.array(p.ravel()))], ["n_tokens", "p"])

    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    scored = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), score(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("s"), *row)
    return written(scored.select("doc_id", "s.n_tokens", "s.p", *(["row"] if whole else [])), "posteriors")


class Plan:
    """Targets and the steps taken so far; ``rates`` replays them for any posteriors.

    reached: whether the totals are within the tolerance of the targets; if not, they are the nearest that the floor and the ridge allow.
    """

    def __init__(self, targets: np.ndarray, step: float, floor: float, ridge: float):
        self.targets, self.step, self.floor, self.ridge = targets, step, floor, ridge
        self.start = np.zeros(len(targets))
        self.errors: list[np.ndarray] = []
        self.totals: np.ndarray | None = None
        self.reached = False

    def first(self, p: np.ndarray) -> np.ndarray:
        """Rates before the first step: those that are optimal if ``start`` is the totals' error."""
        return np.maximum(1 - p @ self.start / max(self.ridge, 1e-12), self.floor)

    def next(self, p: np.ndarray, y: np.ndarray, error: np.ndarray) -> np.ndarray:
        return np.maximum(y - self.step * (p @ error + self.ridge * (y - 1)), self.floor)

    def rates(self, p: np.ndarray, ahead: bool = False) -> np.ndarray:
        """Rates after the steps taken; ``ahead``: the extrapolated point that the next step's totals belong to."""
        r = y = self.first(p)
        t = 1.0
        for e in self.errors:
            new = self.next(p, y, e)
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y, r, t = new + (t - 1) / t2 * (new - r), new, t2
        return y if ahead else r


def begin(plan: Plan, p: np.ndarray, n: np.ndarray, steps: int = 2000) -> None:
    """Set the plan's start to the error at the optimum of these rows, found by the same steps."""
    r = y = plan.first(p)
    t = 1.0
    for _ in range(steps):
        new = plan.next(p, y, ((n * y) @ p - plan.targets) / plan.targets)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, still, r, t = new + (t - 1) / t2 * (new - r), np.abs(new - r).max() < 1e-9, new, t2
        if still:
            break
    plan.start = ((n * r) @ p - plan.targets) / plan.targets


def _wide(p: pa.Array) -> np.ndarray:
    return p.flatten().to_numpy(zero_copy_only=False).reshape(len(p), -1)


def _batch(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return _wide(b.column("p")), b.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)


def _sums(post: DataFrame, fn, size: int) -> np.ndarray:
    """Sum over the table of fn(posteriors, tokens), a vector of ``size``."""

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += fn(*_batch(b))
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], names=["k", "s"])

    out = np.zeros(size)
    for r in post.select("n_tokens", "p").mapInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():
        out[r.k] = r.s
    return out


def fit_rates(post: DataFrame, names: list[str], weights: dict[str, float], budget: float | str = "same", floor: float = 0.0, ridge: float = RIDGE, tolerance: float = TOLERANCE, steps: int | None = None) -> Plan:
    """Rates whose domain totals match weights x budget, or come nearest to it (with a warning).

    ``steps`` bounds the steps; without it they go on until nothing changes.

    budget: a number of tokens, "same" for the corpus's own, or "grow" for the
    least at which no domain's target is below its present tokens.
    """
    k = len(names)
    first = _sums(post, lambda p, n: np.concatenate([n @ p, ((p * n[:, None]).T @ p).ravel()]), k + k * k)
    now, gram = first[:k], first[k:].reshape(k, k)
    w = np.array([max(weights.get(x, 0.0), 0.0) for x in names])
    w = w / w.sum() if w.sum() > 0 else now / max(now.sum(), 1e-300)
    size = now.sum() if budget == "same" else np.max(np.where(w > 0, now / np.maximum(w, 1e-12), 0)) if budget == "grow" else float(budget)
    targets = np.maximum(w * size, 1e-9 * max(size, 1.0))
    scale = np.sqrt(targets)
    plan = Plan(targets, 1 / (max(np.linalg.eigvalsh(gram / scale[:, None] / scale[None, :]).max(), 1e-12) + ridge), floor, ridge)
    if now.sum() <= 0:
        plan.totals = now
        return plan
    every = max(post.count() // START_ROWS, 1)
    few = post.filter(F.pmod(F.xxhash64("doc_id", "n_tokens", "p"), F.lit(every)) == 0).select("n_tokens", "p").limit(2 * START_ROWS).toArrow()
    if len(few):
        p, n = _wide(few["p"].combine_chunks()), few["n_tokens"].to_numpy().astype(float)
        if n.sum() > 0:
            begin(plan, p, n * (now.sum() / n.sum()))
    still, last = 0, None
    while True:
        got = _sums(post, lambda p, n: np.concatenate([(n * plan.rates(p)) @ p, (n * plan.rates(p, True)) @ p]), 2 * k)
        plan.totals = got[:k]
        plan.reached = bool((np.abs(got[:k] - targets) <= tolerance * targets).all())
        still = still + 1 if last is not None and (np.abs(got[:k] - last) <= STILL * targets).all() else 0
        if plan.reached or still >= STILL_STEPS or len(plan.errors) == steps:
            break
        last = got[:k]
        plan.errors.append((got[k:] - targets) / targets)
    if not plan.reached:
        warnings.warn(f"targets {dict(zip(names, targets))} out of reach: totals {dict(zip(names, plan.totals))}", stacklevel=2)
    return plan


def mixing_rates(docs: DataFrame, model: DomainModel, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_tokens, p_<domain>..., rate of every row."""
    post = posteriors(docs, model, id_col, text_col)
    plan = fit_rates(post, model.names, weights or WEIGHTS, **options)
    k = len(model.names)

    def run(batches):
        for b in batches:
            p, _ = _batch(b) if b.num_rows else (np.zeros((0, k)), None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), *(pa.array(np.ascontiguousarray(p[:, i])) for i in range(k)), pa.array(plan.rates(p))], names=["doc_id", "n_tokens", *(f"p_{x}" for x in model.names), "rate"])

    return post.mapInArrow(run, ", ".join(["doc_id long", "n_tokens long", *(f"p_{x} double" for x in model.names), "rate double"]))


def apply_rates(scored: DataFrame, plan: Plan, seed: int = 7) -> DataFrame:
    """Each row of ``posteriors(..., whole=True)`` as often as its rate says: the whole part for certain, the rest by chance.

    A row's chance is a hash of its id, its posterior and its place in the written
    table, so rows without an id and equal rows each have their own, and a task
    that is run again gives the same copies.
    """

    @F.arrow_udf("double")
    def rate(p: pa.Array) -> pa.Array:
        return pa.array(plan.rates(_wide(p)) if len(p) else np.zeros(0))

    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)
    chance = F.pmod(F.xxhash64("doc_id", "p", part, F.col("_metadata.row_index"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    keyed = scored.select("row", rate("p").alias("rate"), chance.alias("chance"))
    copies = keyed.select("row", F.explode(F.array_repeat(F.lit(0), (F.floor("rate") + (F.col("chance") < F.col("rate") - F.floor("rate")).cast("long")).cast("int"))).alias("copy"))
    return copies.select("row.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing_rates(docs, train(docs, table(spark, sf_dir, "labels")))
