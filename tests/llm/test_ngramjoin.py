import pytest

from lakeplan.llm import ngramjoin
from lakeplan.llm.common import table
from lakeplan.llm.components import components

from .util import DOCS, documents, grams, no_documents, rows


def brute_groups(data, threshold=ngramjoin.THRESHOLD, n=ngramjoin.NGRAM):
    """group (lowest id) of every id in a group of two ids or more, by all pairs; also all matching pairs."""
    sets = [(i, grams(t, n)) for i, t in data if i is not None]
    sets = [(i, s) for i, s in sets if s]
    up = {i: i for i, _ in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    pairs = {}
    posting = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            posting.setdefault(g, []).append(k)
    near = {(a, b) for ks in posting.values() for x, a in enumerate(ks) for b in ks[x + 1 :]}
    for a, b in near:
        (i, s), (j, u) = sets[a], sets[b]
        jac = len(s & u) / len(s | u)
        if i != j and jac >= threshold - 1e-12:
            pairs[max(i, j), min(i, j)] = max(jac, pairs.get((max(i, j), min(i, j)), 0))
            x, y = top(i), top(j)
            up[max(x, y)] = min(x, y)
    members = {}
    for i in up:
        members.setdefault(top(i), set()).add(i)
    return {i: g for g, m in members.items() if len(m) > 1 for i in m}, pairs


def brute_classes(data, threshold=ngramjoin.THRESHOLD, n=ngramjoin.NGRAM):
    """doc_id, class_id, n_links, n_copies of every document with a match; rows of one id and one set of grams are one document."""
    docs = sorted({(i, frozenset(grams(t, n))) for i, t in data if i is not None and grams(t, n)}, key=lambda d: d[0])
    up, links, copies = list(range(len(docs))), [0] * len(docs), [0] * len(docs)

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, (_, s) in enumerate(docs):
        for b, (_, u) in enumerate(docs):
            if a != b and s & u and len(s & u) / len(s | u) >= threshold - 1e-12:
                links[a] += 1
                copies[a] += s == u
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return sorted((docs[k][0], docs[top(k)][0], links[k], copies[k]) for k in range(len(docs)) if links[k])


def check(docs, data, **options):
    got = sorted(rows(ngramjoin.jaccard_classes(docs, **options)))
    assert got == brute_classes(data, options.get("threshold", ngramjoin.THRESHOLD), options.get("n", ngramjoin.NGRAM))
    return {r[0]: r[1] for r in got}


@pytest.mark.parametrize("threshold,n,orders", [(0.5, 3, 3), (0.8, 2, 2), (0.3, 1, 1)])
def test_groups_are_those_of_brute_force(spark, data, threshold, n, orders):
    docs = table(spark, data, "documents")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(check(docs, pairs, threshold=threshold, n=n, orders=orders)) > 5


def test_chains_and_ties(spark):
    """Each text shares most words with the next, but the ends of the chain share none."""
    data = [(100 - k, " ".join(f"t{k * 2 + j}" for j in range(20))) for k in range(12)] + [(200 + k, "same words for all of these rows") for k in range(30)]
    groups = check(documents(spark, data), data)
    assert {groups[100 - k] for k in range(12)} == {89} and {groups[200 + k] for k in range(30)} == {200}


def test_awkward_rows(spark):
    docs = documents(spark)
    groups = check(docs, DOCS)
    assert groups == {1: 1, 2: 1, 6: 6, 7: 6, 8: 8, 9: 8, 10: 10, 11: 10}
    kept = ngramjoin.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, None, 6, 8, 10, 12]))
    assert rows(ngramjoin.jaccard_classes(no_documents(spark))) == [] and rows(ngramjoin.keep_one(no_documents(spark))) == []


def test_one_id_with_several_texts(spark):
    data = [(1, "alpha beta gamma delta epsilon"), (1, "one two three four five six"), (1, None), (2, "one two three four five six"), (3, "alpha beta gamma delta epsilon"), (4, "quite another text about nothing")]
    kept = [(r.doc_id, r.text) for r in ngramjoin.keep_one(documents(spark, data)).collect()]
    assert sorted(kept, key=str) == sorted([data[0], data[1], data[2], data[5]], key=str)
    assert sorted(rows(ngramjoin.jaccard_classes(documents(spark, data)))) == [(1, 1, 1, 1), (1, 1, 1, 1), (2, 1, 1, 1), (3, 1, 1, 1)]


def test_kept_documents(spark, data):
    docs = table(spark, data, "documents")
    all_ = [(r.doc_id, r.text) for r in docs.collect()]
    groups, _ = brute_groups(all_)
    kept = {r.doc_id for r in ngramjoin.keep_one(docs).select("doc_id").collect()}
    assert kept == {i for i, _ in all_ if groups.get(i, i) == i}


@pytest.mark.parametrize("one_task", [1_000_000, 5])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr("lakeplan.llm.components.ONE_TASK", one_task)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103), (7, 7)]
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 104)}}
    assert rows(components(spark.createDataFrame([], "a long, b long"))) == []


def near_copies(n, size=60):
    """Texts with one word of their own, so that all pairs match and no two are equal; each fifth is there twice."""
    base = [f"base{k}" for k in range(size)]
    texts = [" ".join([*base[: 5 + k % 40], f"own{k}", *base[6 + k % 40 :]]) for k in range(n)]
    return list(enumerate(texts + texts[::5]))


def test_links_in_blocks_are_those_of_brute_force(spark, monkeypatch):
    """A class of many blocks, leaders of many parts, products of a few tokens at a time."""
    data = [*near_copies(60), *((1000 + i, t) for i, t in near_copies(9, 33))]
    want = check(documents(spark, data), data)
    for name, value in {"BLOCK": 7, "PARTNERS": 5, "_GRID": 64}.items():
        monkeypatch.setattr(ngramjoin, name, value)
    assert check(documents(spark, data), data) == want
    monkeypatch.setattr(ngramjoin, "buckets", lambda *_: 37)
    assert check(documents(spark, data), data) == want


def test_overlap():
    import numpy as np

    rng = np.random.default_rng(1)
    sides = [[rng.choice(90, 12, replace=False).astype(np.uint64) for _ in range(n)] for n in (5, 8)]
    got = ngramjoin.overlap(*(ngramjoin.Block._listed(x) for x in sides), (5, 8))
    assert got.tolist() == [[len({*a.tolist()} & {*b.tolist()}) for b in sides[1]] for a in sides[0]]


def test_hashes_that_agree_in_48_bits_stay_apart():
    import numpy as np

    from lakeplan.llm.kernels import unique_per_text

    h = np.array([5 << 16 | 1, 5 << 16 | 2, 5 << 16 | 1, 9 << 20, 9 << 20, 5 << 16 | 1], np.uint64)
    got, off = unique_per_text(h, np.array([0, 4, 6]))
    assert off.tolist() == [0, 3, 5] and {*got[:3].tolist()} == {5 << 16 | 1, 5 << 16 | 2, 9 << 20}
