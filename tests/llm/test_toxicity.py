import numpy as np
import pyarrow as pa
import pytest

from lakeplan.llm import linear, toxicity
from lakeplan.llm.common import table
from lakeplan.llm.kernels import words
from lakeplan.llm.linear import counted, word_features

from .util import DOCS, documents, no_documents, rows

ANGRY = "you are awful and everyone hates you, shut up you useless idiot number"
CALM = "the meeting of the local garden club was pleasant and well attended, item"


def sample(spark, named_share=0.9, n=60):
    """Toxic texts that mostly name one group, so that a plain classifier learns the name."""
    docs, labels = [], []
    for i in range(n):
        name = " The muslim neighbours came along." if i < named_share * n else ""
        docs.append((i, f"{ANGRY} {i}.{name}"))
        labels.append((i, 0, 1))
        docs.append((1000 + i, f"{CALM} {i}." + (" The muslim neighbours came along." if i < 0.1 * n else "")))
        labels.append((1000 + i, 1, 0))
    return documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_swaps_take_the_weight_from_names(spark):
    docs, labels = sample(spark)
    names = ["muslim", "christian", "jewish", "hindu"]
    gap = {}
    for penalty in (0.0, 20.0):
        model = toxicity.train(docs, labels, swap_penalty=penalty)
        s = model.scores(pa.array([f"{CALM}. The {x} neighbours came along." for x in names]))
        gap[penalty] = s.max() - s.min()
        assert model.scores(pa.array([ANGRY]))[0] > model.cut > model.scores(pa.array([CALM]))[0]
    assert gap[20.0] < gap[0.0] / 3


KINDS = {"faith": "muslim christian african-american jewish", "sex": "women men"}
SENTENCES = [(["the", "muslim", "mayor", "muslim", "christ"], 1, 1, "muslim", "faith"), (["the", "muslim", "mayor", "muslim", "christ"], 3, 1, "muslim", "faith"), (["women", "and", "men", "agreed"], 0, 1, "women", "sex"), (["women", "and", "men", "agreed"], 2, 1, "men", "sex"), (["an", "african", "american", "spoke"], 1, 2, "african-american", "faith")]
SWAP_TEXT = "Nothing here. The muslim mayor, muslim Christ! Women and men agreed\nAn African-American spoke"


def values(sentence, n):
    """Value of each feature of a list of words."""
    _, f, c = counted(np.zeros(3 * len(sentence), np.int64), word_features(words(pa.array([" ".join(sentence)]))).ravel())
    return dict(zip(f.tolist(), np.log1p(c) / np.sqrt(n + linear.SHORT)))


def brute_changes():
    """Change of each feature's value for every mention and every other name of its kind."""
    out = []
    for sentence, at, n, name, kind in SENTENCES:
        for other in KINDS[kind].split():
            if other != name:
                a, b = values(sentence, len(sentence)), values([*sentence[:at], *other.split("-"), *sentence[at + n :]], len(sentence))
                out.append({f: b.get(f, 0) - a.get(f, 0) for f in {*a, *b}})
    return out


def test_swap_sums_are_those_of_brute_force(spark):
    got = toxicity.mentions(pa.array([SWAP_TEXT, None, "", "none"]), KINDS)
    assert got[1:] == [b"", b"", b""]
    gram, n = toxicity.swap_sums(got, KINDS)
    features, want = toxicity.terms(KINDS).features, brute_changes()
    d = np.array([[c.get(int(f), 0.0) for f in features] for c in want])
    assert n == len(want) == 11 and all(abs(v) < 1e-12 for c in want for f, v in c.items() if f not in set(features.tolist()))
    assert np.allclose(gram, d.T @ d)
    df = spark.createDataFrame([(bytearray(x),) for x in got * 3], "extra binary").repartition(3)
    spread = toxicity.swaps(df, KINDS)
    assert spread.n == 3 * n and np.allclose(spread.gram, 3 * gram)


def test_every_name_is_swapped_for_every_other():
    known = toxicity.terms(toxicity.IDENTITY_TERMS)
    names = [k.split() for k in toxicity.IDENTITY_TERMS.values()]
    for k, kind in enumerate(names):
        got = toxicity.mentions(pa.array([f"We met {t} there." for t in kind]))
        assert all(got), kind
        assert toxicity.swap_sums(got)[1] >= len(kind) * (len(kind) - 1) and len(known.kinds[k][1]) == len(kind)


def test_loss_and_gradient_by_finite_differences():
    rng = np.random.default_rng(5)
    vocab = np.sort(np.append(toxicity.terms(KINDS).features, rng.integers(1, 1 << 60, 30).astype(np.uint64)))
    row, col = np.nonzero(rng.random((20, len(vocab))) < 0.3)
    sample = linear.Sample(rng.integers(0, 2, 20), np.zeros(20, np.int64), rng.integers(5, 50, 20), row, col, rng.integers(1, 4, len(row)), vocab)
    gram, n = toxicity.swap_sums(toxicity.mentions(pa.array([SWAP_TEXT]), KINDS), KINDS)
    scale, x, h = rng.random(len(vocab)) + 0.5, rng.normal(size=2 * len(vocab) + 2), 1e-6
    plain, loss = (linear.loss_of(sample, vocab, scale, 2, 1e-3, linear.Swaps(toxicity.terms(KINDS).features, gram, n), p, True) for p in (0.0, 3.0))
    value, grad = loss(x)
    w = dict(zip(vocab.tolist(), x[: 2 * len(vocab)].reshape(-1, 2) * scale[:, None]))
    change = [sum(v * w[f] for f, v in c.items() if f in w) for c in brute_changes()]
    assert np.isclose(value - plain(x)[0], 3.0 * np.mean([(c * c).sum() for c in change]))
    for i in rng.integers(0, len(x), 40):
        e = np.eye(len(x))[i] * h
        assert np.isclose((loss(x + e)[0] - loss(x - e)[0]) / 2 / h, grad[i], rtol=1e-4, atol=1e-7)


@pytest.fixture(scope="module")
def real(spark, data):
    return table(spark, data.replace("sf0.001", "sf0.01"), "documents"), table(spark, data.replace("sf0.001", "sf0.01"), "labels")


def test_held_out(spark, real):
    docs, labels = real
    model = toxicity.train(docs, labels.filter("doc_id % 3 != 0"))
    seen = docs.select("doc_id").distinct().join(labels.filter("doc_id % 3 = 0"), "doc_id")
    got = toxicity.toxicity(docs, model).join(seen, "doc_id").collect()
    truth, said = np.array([r.toxic == 1 for r in got]), np.array([r.is_toxic for r in got])
    assert said[truth].mean() > 0.7 and said[~truth].mean() < 0.02  # a few dozen toxic examples; 0.94 on ten times as many


def test_awkward_rows(spark):
    docs, labels = sample(spark)
    model = toxicity.train(docs, labels.union(spark.createDataFrame([(None, 1, 1), (5000, 0, 1), (3, None, None)], labels.schema)))
    awkward = documents(spark, [*DOCS, (20, ANGRY), (20, ANGRY), (None, ANGRY)])
    got = rows(toxicity.toxicity(awkward, model))
    assert len(got) == len(DOCS) + 3
    assert all(r[1:] == (0.0, False) for r in got if r[0] in (3, 4))
    assert len({r[1] for r in got if r[0] == 20}) == 1 and all(r[2] for r in got if r[0] == 20)
    kept = toxicity.reject_toxic(awkward, model)
    assert kept.columns == awkward.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in DOCS)
    empty = no_documents(spark)
    assert rows(toxicity.toxicity(empty, model)) == [] and rows(toxicity.reject_toxic(empty, model)) == []


@pytest.mark.parametrize("data", [[], [(1, 0, 1)], [(1, 0, 0), (2, 1, 0)], [(None, 1, 1)], [(1, 0, 1), (12, 1, 0)]])
def test_labels_that_tell_nothing(spark, data):
    docs = documents(spark)
    model = toxicity.train(docs, spark.createDataFrame(data, "doc_id long, quality int, toxic int"))
    assert not any(r.is_toxic for r in toxicity.toxicity(docs, model).collect())
    assert toxicity.reject_toxic(docs, model).count() == len(DOCS)


def test_sample_is_bounded(spark):
    docs, labels = sample(spark)
    from lakeplan.llm.linear import labelled_ids
    from pyspark.sql import functions as F

    few = labelled_ids(labels, "doc_id", F.col("toxic"), 10)
    assert len(few) == 10 and few == labelled_ids(labels.repartition(5), "doc_id", F.col("toxic"), 10)
    assert toxicity.train(docs, labels, max_train=10).cut > 0
