import numpy as np
import pytest

from lakeplan.llm import mixing
from lakeplan.llm.common import table

from .util import DOCS, documents, no_documents, rows


def labels(spark, data):
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def trained(spark, data):
    docs = table(spark, data, "documents")
    return docs, mixing.train(docs, table(spark, data, "labels"))


def loss(r, p, n, targets, ridge):
    return (((r * n) @ p - targets) ** 2 / targets).sum() + ridge * (n * (r - 1) ** 2).sum()


def least_squares(p, n, targets, floor, ridge):
    """Plain projected gradient on all rates at once; the least value found."""
    r = np.maximum(np.ones(len(p)), floor)
    gram = (p * n[:, None]).T @ p
    step = 1 / (np.linalg.eigvalsh(gram / np.sqrt(targets)[:, None] / np.sqrt(targets)[None, :]).max() + ridge)
    for _ in range(4000):
        error = ((r * n) @ p - targets) / targets
        r = np.maximum(r - step * (p @ error + ridge * (r - 1)), floor)
    return loss(r, p, n, targets, ridge)


def test_targets_are_reached(spark, trained):
    docs, model = trained
    got = mixing.mixing_rates(docs, model).toPandas()
    assert len(got) == docs.count()
    p = got[[f"p_{x}" for x in model.names]].to_numpy()
    assert np.allclose(p.sum(1), 1) and (got.rate >= 0).all()
    n = got.n_tokens.to_numpy(float)
    share = (got.rate.to_numpy() * n) @ p / n.sum()
    want = np.array([mixing.WEIGHTS[x] for x in model.names])
    assert np.abs(share - want / want.sum()).max() < 0.01


@pytest.mark.parametrize("floor,start_rows", [(0.0, 4096), (0.6, 4096), (0.0, 10)])
def test_rates_are_those_of_brute_force(spark, trained, monkeypatch, floor, start_rows):
    monkeypatch.setattr(mixing, "START_ROWS", start_rows)
    docs, model = trained
    post = mixing.posteriors(docs, model)
    pd = post.toPandas()
    p, n = np.stack(pd.p.to_numpy()), pd.n_tokens.to_numpy(float)
    plan = mixing.fit_rates(post, model.names, mixing.WEIGHTS, floor=floor, tolerance=0)
    best = least_squares(p, n, plan.targets, floor, plan.ridge)
    r = plan.rates(p)
    assert r.min() >= floor and loss(r, p, n, plan.targets, plan.ridge) <= 1.01 * best + 1e-6 * n.sum()


def test_posteriors_know_the_domains(spark, trained, data):
    docs, model = trained
    post = {r.doc_id: r.p for r in mixing.posteriors(docs, model).collect()}
    known = table(spark, data, "labels").filter("toxic = 0").collect()
    hit = [post[r.doc_id][model.names.index("high")] > post[r.doc_id][model.names.index("low")] for r in known if r.doc_id in post]
    truth = [r.quality == 1 for r in known if r.doc_id in post]
    assert np.mean(np.array(hit) == np.array(truth)) > 0.9


def test_awkward_rows(spark):
    docs = documents(spark)
    model = mixing.train(docs, labels(spark, [(1, 1, 0), (2, 0, 0), (None, 1, 0), (12, None, None), (99, 1, 0), (1, 1, 0)]))
    assert set(model.names) == {"high", "low"}
    got = rows(mixing.mixing_rates(docs, model))
    assert sorted(str(r[0]) for r in got) == sorted(str(i) for i, _ in DOCS)
    assert {r[1] for r in got if r[0] in (3, 4, 5)} == {0}
    assert len({r[1:] for r in got if r[0] == 2}) == 1
    assert rows(mixing.mixing_rates(no_documents(spark), model)) == []


def test_no_labels(spark):
    docs = documents(spark)
    model = mixing.train(docs, labels(spark, []))
    got = rows(mixing.mixing_rates(docs, model))
    assert model.names == ["all"] and all(abs(r[-1] - 1) < 1e-6 for r in got) and len(got) == len(DOCS)


def test_rows_repeat_as_rates_say(spark, trained):
    docs, model = trained
    scored = mixing.posteriors(docs, model, whole=True)
    plan = mixing.fit_rates(scored, model.names, {"high": 0.95, "low": 0.04, "toxic": 0.01}, budget="grow", floor=1.0)
    out = mixing.apply_rates(scored, plan)
    assert out.columns == docs.columns
    per = {r.doc_id: r.n for r in out.groupBy("doc_id").agg({"*": "count"}).toDF("doc_id", "n").collect()}
    base = {r.doc_id: r.n for r in docs.groupBy("doc_id").agg({"*": "count"}).toDF("doc_id", "n").collect()}
    assert set(per) == set(base) and all(per[i] >= base[i] for i in base) and sum(per.values()) > sum(base.values())
    again = documents(spark)
    kept = mixing.apply_rates(mixing.posteriors(again, model, whole=True), plan)
    assert kept.columns == again.columns and {str(r.doc_id) for r in kept.collect()} == {str(i) for i, _ in DOCS}
    assert rows(mixing.apply_rates(mixing.posteriors(no_documents(spark), model, whole=True), plan)) == []


@pytest.mark.parametrize("i", [None, 7])
def test_equal_rows_draw_their_own_copies(spark, i):
    """400 rows of one id, or none, at rate 1.5 are about 600 rows, not 400 or 800; the same again if read again."""
    model = mixing.train(documents(spark), labels(spark, []))
    scored = mixing.posteriors(documents(spark, [(i, "one text for all of them")] * 400), model, whole=True)
    plan = mixing.Plan(np.ones(1), 1.0, 1.5, 1e-4)
    out = mixing.apply_rates(scored, plan)
    assert 540 < out.count() < 660 and out.count() == out.count()


def test_targets_out_of_reach_are_told(spark, trained):
    docs, model = trained
    post = mixing.posteriors(docs, model)
    with pytest.warns(UserWarning, match="out of reach"):
        plan = mixing.fit_rates(post, model.names, {"high": 1.0}, floor=1.0)
    assert not plan.reached and np.isfinite(plan.totals).all()
    pd = post.toPandas()
    p, n = np.stack(pd.p.to_numpy()), pd.n_tokens.to_numpy(float)
    assert loss(plan.rates(p), p, n, plan.targets, plan.ridge) <= 1.01 * least_squares(p, n, plan.targets, 1.0, plan.ridge) + 1e-6 * n.sum()
