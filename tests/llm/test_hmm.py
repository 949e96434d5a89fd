import itertools

import numpy as np
import pytest

from lakeplan.llm import hmm
from lakeplan.llm.common import table

from .util import DOCS, documents, no_documents, rows, split_words


def model(states=3, vocab=7, seed=1):
    rng = np.random.default_rng(seed)
    draw = lambda *s: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(s) + 0.05)
    return hmm.Model(draw(states), draw(states, states), draw(states, vocab))


def by_paths(m, ids):
    total = 0.0
    for path in itertools.product(range(len(m.start)), repeat=len(ids)):
        p = m.start[path[0]] * m.emit[path[0], ids[0]]
        for a, b, i in zip(path, path[1:], ids[1:]):
            p *= m.move[a, b] * m.emit[b, i]
        total += p
    return np.log(total)


def plain_forward(m, ids):
    a, log = m.start, 0.0
    for t, i in enumerate(ids):
        a = (a if t == 0 else a @ m.move) * m.emit[:, i]
        log += np.log(a.sum())
        a = a / a.sum()
    return log


def test_likelihood_is_the_sum_over_all_paths():
    m, rng = model(), np.random.default_rng(2)
    docs = [rng.integers(0, 7, n) for n in (5, 1, 7, 0, 3)]
    got = hmm.log_likelihoods(m, np.concatenate(docs), np.cumsum([0, *map(len, docs)]))
    assert np.allclose(got, [by_paths(m, d) if len(d) else 0 for d in docs])


def test_long_sequences_in_pieces():
    m, rng = model(4, 50), np.random.default_rng(3)
    docs = [rng.integers(0, 50, n) for n in (5000, 2, 300, 1023, 0, 257)]
    got = hmm.log_likelihoods(m, np.concatenate(docs), np.cumsum([0, *map(len, docs)]))
    assert np.allclose(got, [plain_forward(m, d) for d in docs], rtol=1e-9)


def test_expected_counts_are_those_over_all_paths():
    m, ids = model(2, 4), np.array([0, 3, 1, 1, 2])
    want = {"start": np.zeros(2), "move": np.zeros((2, 2)), "emit": np.zeros((2, 4))}
    total = np.exp(by_paths(m, ids))
    for path in itertools.product(range(2), repeat=5):
        p = m.start[path[0]] * m.emit[path[0], ids[0]] * np.prod([m.move[a, b] * m.emit[b, i] for a, b, i in zip(path, path[1:], ids[1:])]) / total
        want["start"][path[0]] += p
        for s, i in zip(path, ids):
            want["emit"][s, i] += p
        for a, b in zip(path, path[1:]):
            want["move"][a, b] += p
    got = hmm._empty(2, 4)
    hmm.expected_counts(m, ids, np.array([0, 5]), got)
    assert all(np.allclose(got[k], want[k], rtol=1e-4) for k in want) and got["n"] == 5
    assert np.isclose(got["log"], np.log(total), rtol=1e-5)


def plain_counts(m, docs):
    """Expected counts of whole documents, one token at a time."""
    k = len(m.start)
    out = hmm._empty(k, m.emit.shape[1])
    for d in docs:
        alpha, beta, scale = [], [np.ones(k)], []
        for t, i in enumerate(d):
            a = (m.start if t == 0 else alpha[-1] @ m.move) * m.emit[:, i]
            scale.append(a.sum())
            alpha.append(a / a.sum())
        for t in range(len(d) - 1, 0, -1):
            beta.append(m.move @ (m.emit[:, d[t]] * beta[-1]) / scale[t])
        beta = beta[::-1]
        for t, i in enumerate(d):
            out["emit"][:, i] += alpha[t] * beta[t]
            if t:
                out["move"] += alpha[t - 1][:, None] * m.move * (m.emit[:, i] * beta[t])[None, :] / scale[t]
        if len(d):
            out["start"] += alpha[0] * beta[0]
        out["log"] += np.log(scale).sum() if len(d) else 0
        out["n"] += len(d)
    return out


@pytest.mark.parametrize("few,piece", [(48, 256), (3, 16), (2, 7), (1, 5)])
def test_counts_of_long_documents_do_not_depend_on_cuts(few, piece):
    m, rng = model(4, 30), np.random.default_rng(6)
    docs = [rng.integers(0, 30, n) for n in (900, 3, 0, 700, 40, 41, 1, 90)]
    got, want = hmm._empty(4, 30), plain_counts(m, docs)
    hmm.expected_counts(m, np.concatenate(docs), np.cumsum([0, *map(len, docs)]), got, few, piece)
    assert got["n"] == want["n"] and np.isclose(got["log"], want["log"], rtol=1e-5)
    assert all(np.allclose(got[k], want[k], rtol=2e-3, atol=1e-3) for k in ("start", "move", "emit"))


@pytest.fixture(scope="module")
def trained(spark, data):
    own = hmm.chunks(table(spark, data, "documents"), chunk_bytes=50_000)
    return (own, *hmm.train(own, steps=4))


def test_training_never_lowers_the_likelihood(trained):
    _, m, _, seen = trained
    assert all(b > a for a, b in zip(seen, seen[1:]))
    assert np.isclose(m.start.sum(), 1) and np.allclose(m.move.sum(1), 1) and np.allclose(m.emit.sum(1), 1)


def test_a_step_is_that_of_whole_documents(trained):
    own, m, _, _ = trained
    docs = [c["classes"][c["places"]][i:j] for r in own.toArrow().to_batches() for c in hmm._opened(r) for i, j in zip(c["offsets"], c["offsets"][1:])]
    want = plain_counts(m, docs)
    one, a = hmm.step(own.coalesce(1), m)
    many, b = hmm.step(own.repartition(7), m)
    move = want["move"] + hmm.SMOOTH_STATE
    assert np.isclose(a, b, rtol=1e-5) and np.isclose(a, want["log"] / want["n"], rtol=1e-5)
    for x in (one, many):
        assert np.allclose(x.move, move / move.sum(1, keepdims=True), rtol=5e-3, atol=1e-5) and np.abs(x.emit - (want["emit"] + hmm.SMOOTH_ID) / (want["emit"] + hmm.SMOOTH_ID).sum(1, keepdims=True)).max() < 1e-4


def test_scores_of_the_table(trained, spark, data):
    own, m, counts, _ = trained
    docs = table(spark, data, "documents").collect()
    seen = {}
    for r in docs:
        for w in split_words(r.text):
            seen[w] = seen.get(w, 0) + 1
    at = {w: c for w, c in zip(seen, classes(list(seen)))}
    size, types = np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES)
    for w, n in seen.items():
        size[at[w]] += n
        types[at[w]] += 1
    assert (size == m.tokens).all() and (types == m.types).all()
    got = {r.doc_id: r for r in hmm.scores(own, m, counts).collect()}
    assert len(got) == len(docs)
    for r in docs[::7]:
        w = split_words(r.text)
        ids = np.array([at[x] for x in w], np.int64)
        want = plain_forward(m, ids) + sum(np.log((seen[x] + hmm.SMOOTH_WORD) / (size[at[x]] + hmm.SMOOTH_WORD * (types[at[x]] + 1))) for x in w)
        assert got[r.doc_id].n_tokens == len(w) and np.isclose(got[r.doc_id].log_likelihood, want, rtol=1e-5)


def classes(names):
    import pyarrow as pa

    from lakeplan.llm.kernels import prefix_hashes, words

    w = words(pa.array(names))
    assert len(w.hash) == len(names)
    return (prefix_hashes(w, (hmm.PREFIX,))[0] % np.uint64(hmm.CLASSES)).astype(np.int64)


def test_texts_that_occur_twice_are_likelier(spark):
    """A model of the whole corpus tells words that come back from words that never do."""
    text = lambda k: " ".join(f"{chr(97 + (k * 7 + j) % 26)}{k}x{j}" for j in range(40))
    data = [(k, text(k // 2 if k < 20 else k)) for k in range(60)]
    own = hmm.chunks(documents(spark, data))
    m, counts, _ = hmm.train(own, steps=2)
    ppl = {r.doc_id: r.perplexity for r in hmm.scores(own, m, counts).collect()}
    assert max(ppl[k] for k in range(20)) < min(ppl[k] for k in range(20, 60))


def test_awkward_rows(trained, spark):
    _, m, counts, _ = trained
    got = rows(hmm.scores(hmm.chunks(documents(spark)), m, counts))
    a, b = (r for r in got if r[0] == 2)
    assert sorted(str(r[0]) for r in got) == sorted(str(i) for i, _ in DOCS) and np.allclose(a, b, rtol=1e-12)
    assert all(r[1:] == (0, 0.0, None) for r in got if r[0] in (3, 4, 5))
    assert all(np.isfinite(r[2]) and r[3] > 1 for r in got if r[1])
    none = hmm.chunks(no_documents(spark))
    empty_model, no_counts, seen = hmm.train(none, steps=2)
    assert rows(hmm.scores(none, empty_model, no_counts)) == [] and len(seen) == 2
    assert all(np.isfinite(r[2]) for r in rows(hmm.scores(hmm.chunks(documents(spark)), empty_model, no_counts)))
    assert np.isfinite(hmm.log_likelihoods(empty_model, np.array([5, 6, 7]), np.array([0, 3]))).all()
