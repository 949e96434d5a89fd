import itertools

import numpy as np
import pytest

from lakeplan.llm import lattice
from lakeplan.llm.common import table

from .util import rows


def brute(data, threshold=lattice.THRESHOLD):
    """{id: (class_id, n_links, n_copies)} of all pairs."""
    v = {i: np.array(e, float) for i, e in data}
    ids = sorted(v)
    x = np.array([v[i] / np.linalg.norm(v[i]) for i in ids])
    hit = x @ x.T >= threshold
    same = (np.abs(x[:, None, :] - x[None, :, :]).max(2) < 1e-7) if len(ids) < 1500 else None
    np.fill_diagonal(hit, False)
    label = np.arange(len(ids))
    while True:
        new = np.minimum(label, np.where(hit, label[None, :], len(ids)).min(1))
        if (new == label).all():
            break
        label = new
    return {i: (ids[label[k]], int(hit[k].sum()), int(same[k].sum()) - 1) for k, i in enumerate(ids) if hit[k].any()}


def test_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(3)
    y = rng.normal(size=(300, 8)) * 2
    p = lattice.nearest_e8(y)
    whole, half = np.rint(p) == p, np.rint(p - 0.5) == p - 0.5
    assert (whole.all(1) | half.all(1)).all() and (np.rint(p.sum(1)) % 2 == 0).all()
    best = ((y - p) ** 2).sum(1)
    for r in lattice.ROOTS:
        assert (((y - p - r) ** 2).sum(1) >= best - 1e-9).all()
    assert len(np.unique(lattice.ROOTS, axis=0)) == 240 and np.allclose((lattice.ROOTS**2).sum(1), 2)


def test_probes_are_the_next_nearest():
    rng = np.random.default_rng(4)
    y = rng.normal(size=(50, 8))
    p = lattice.nearest_e8(y)
    n, cost = lattice.neighbours(y, p, 4)
    every = ((y[:, None, :] - p[:, None, :] - lattice.ROOTS) ** 2).sum(2) - ((y - p) ** 2).sum(1)[:, None]
    assert np.allclose(np.sort(every, 1)[:, :4], cost) and np.allclose(((n - y[:, None]) ** 2).sum(2) - ((y - p) ** 2).sum(1)[:, None], cost)


def copies(dim=32, seed=1):
    """Groups of near copies of 2 to 150 vectors, some of them equal, among lone vectors."""
    rng, data = np.random.default_rng(seed), []
    for size in (150, 40, 12, 5, 3, 2, 2, *[1] * 150):
        base = rng.normal(size=dim)
        for k in range(size):
            noise = rng.normal(size=dim) * 0.12
            data.append((len(data) * 7 % 1009, (base if k % 4 == 3 else base + noise).tolist()))
    return data


@pytest.mark.parametrize("block", [lattice.BLOCK, 16])
def test_links_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    df = spark.createDataFrame(copies(), "vec_id long, embedding array<float>").repartition(4)
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    got = {r[0]: r[1:] for r in rows(lattice.near_classes(df))}
    assert len(want) > 200 and set(got) <= set(want)
    assert all(got[i][1] <= want[i][1] and got[i][2] == want[i][2] for i in got)  # no link is wrong
    assert sum(g[1] for g in got.values()) >= 0.98 * sum(w[1] for w in want.values())
    assert np.mean([got.get(i) == w for i, w in want.items()]) > 0.9


def test_the_table(spark, data):
    df = table(spark, data, "embeddings")
    want = brute([(r.vec_id, r.embedding) for r in df.collect() if r.embedding])
    assert {r[0]: r[1:] for r in rows(lattice.near_classes(df))} == want


@pytest.mark.parametrize("dim", [3, 24, 300])
def test_recall_at_the_threshold(spark, dim):
    """Pairs just above the threshold are the hardest."""
    rng = np.random.default_rng(dim)
    data = []
    for i in range(300):
        x = rng.normal(size=dim)
        x /= np.linalg.norm(x)
        e = rng.normal(size=dim)
        e -= (e @ x) * x
        e /= np.linalg.norm(e)
        data += [(2 * i, (3 * x).tolist()), (2 * i + 1, (0.956 * x + np.sqrt(1 - 0.956**2) * e).tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {r[0]: r[1:] for r in rows(lattice.near_classes(df))}
    want = brute(data)
    assert len(want) >= 600 and set(got) <= set(want) and sum(g[1] for g in got.values()) >= 0.95 * sum(w[1] for w in want.values())


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 0.0]), (7, [inf, 0.0, 0.0]), (8, [1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (9, [None, 1.0, 1.0]), (10, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", True, 3) for i, v in data], "vec_id long, embedding array<double>, cell string, own boolean, node int")
    assert sorted(rows(lattice.near_classes(df))) == [(1, 1, 1, 1), (2, 1, 1, 1)]
    for empty in (df.limit(0), df.filter("vec_id is null"), df.filter("size(embedding) = 0")):
        assert rows(lattice.near_classes(empty)) == []
