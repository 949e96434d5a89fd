import weakref

import numpy as np
import pytest

from lakeplan.llm import decontam
from lakeplan.llm.common import table

from .util import DOCS, documents, no_documents, rows, split_words


def local_score(a, b):
    """Smith-Waterman by its definition."""
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (decontam.MATCH if x == y else decontam.MISMATCH), h[i - 1, j] + decontam.GAP, h[i, j - 1] + decontam.GAP)
    return h.max()


def items(spark, data):
    return spark.createDataFrame([(i, t, "x") for i, t in data], "item_id long, text string, doc_id string")


def test_alignment_is_exact():
    rng = np.random.default_rng(1)
    pairs = [(rng.integers(0, 4, int(rng.integers(1, 30))).astype(np.uint64), rng.integers(0, 4, int(rng.integers(1, 60))).astype(np.uint64)) for _ in range(60)]
    got = decontam.smith_waterman([a for a, _ in pairs], [b for _, b in pairs])
    assert np.allclose(got, [local_score(a, b) for a, b in pairs])


def test_same_as_brute_force(spark, data):
    """Every document and item that share three words in a row, aligned as wholes."""
    docs, bench = table(spark, data, "documents"), table(spark, data, "benchmark")
    got = {r[:2]: r[2] for r in rows(decontam.contaminated(docs, decontam.prepared(bench)))}
    code = {}
    coded = lambda t: np.array([code.setdefault(w, len(code)) for w in split_words(t)], np.uint64)
    texts, tests = {r.doc_id: coded(r.text) for r in docs.collect()}, {r.item_id: coded(r.text) for r in bench.collect()}
    grams = lambda w: set(zip(w.tolist(), w[1:].tolist(), w[2:].tolist()))
    seeds = {j: grams(v) for j, v in tests.items()}
    pairs = [(i, j) for i, w in texts.items() for have in [grams(w)] for j in tests if have & seeds[j]]
    score = decontam.smith_waterman([tests[j] for _, j in pairs], [texts[i] for i, _ in pairs])
    want = {(i, j): s / len(tests[j]) for (i, j), s in zip(pairs, score) if s >= min(decontam.MIN_SCORE * len(tests[j]), decontam.MIN_WORDS)}
    assert len(want) >= 3 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


ITEM = "which of the following planets has the largest number of known moons orbiting around it today"


@pytest.mark.parametrize("text,found", [(ITEM, True), (f"before that {ITEM.upper()} and after", True), (ITEM.replace("largest number of", "greatest count of"), True), (ITEM.replace("planets ", "planets here ").replace("known ", ""), True), (" ".join(reversed(ITEM.split())), False), ("the largest number of known facts about gardens is kept in this book of roses", False)])
def test_copies_and_paraphrases(spark, text, found):
    filler = [(100 + i, f"filler text number {i} says the following of the largest garden around it") for i in range(30)]
    docs = documents(spark, [(1, "intro words " * 400 + text + " closing words" * 400), *filler])
    parts = decontam.prepared(items(spark, [(7, ITEM)]))
    assert {r[0] for r in rows(decontam.contaminated(docs, parts))} == ({1} if found else set())
    assert decontam.drop_contaminated(docs, parts).count() == 30 + (not found)


def test_awkward_rows(spark):
    docs = documents(spark, [*DOCS, (20, ITEM), (20, ITEM + " again"), (None, ITEM)])
    bench = items(spark, [(1, ITEM), (2, ITEM), (2, ITEM), (3, None), (4, ""), (5, "!!"), (6, "one"), (None, ITEM), (7, "two words")])
    got = rows(decontam.contaminated(docs, decontam.prepared(bench)))
    assert {r[:2] for r in got} == {(20, 1), (20, 2), (6, 6), (7, 6)} and len(got) == 4 and all(r[2] == 1 for r in got)
    kept = decontam.drop_contaminated(docs, decontam.prepared(bench))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in DOCS if i not in (6, 7))
    for d, b in ((no_documents(spark), bench), (docs, bench.limit(0)), (no_documents(spark), bench.limit(0))):
        parts = decontam.prepared(b)
        assert rows(decontam.contaminated(d, parts)) == [] and decontam.drop_contaminated(d, parts).count() == d.count()


def test_shards_find_the_same_one_at_a_time(spark, data, monkeypatch):
    docs, bench = table(spark, data, "documents"), table(spark, data, "benchmark")
    one = decontam.prepared(bench)
    want, kept = sorted(rows(decontam.contaminated(docs, one))), sorted(r.doc_id for r in decontam.drop_contaminated(docs, one).collect())
    parts, live, most = decontam.prepared(bench, max_grams=500), weakref.WeakSet(), [0]
    plain = decontam.Items.__init__

    def counted(self, *a):
        live.add(self)
        most[0] = max(most[0], len(live))
        plain(self, *a)

    monkeypatch.setattr(decontam.Items, "__init__", counted)
    assert len(parts) > 1 and sorted(rows(decontam.contaminated(docs, parts))) == want
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, parts).collect()) == kept and most[0] == 1


@pytest.mark.parametrize("size", [30, 38, 48])
def test_edited_copies_like_exhaustive_alignment(spark, size):
    """Copies with every 4th to 6th word changed, half items and spread items; fillers make all intact grams more frequent than the broken ones."""
    rng = np.random.default_rng(size)
    item = [f"word{size}x{k}" for k in range(size)]
    fill = lambda n: [f"filler{k}" for k in rng.integers(0, 500, n)]
    edited = [[f"edit{step}x{k}" if k % step == step - 1 else w for k, w in enumerate(item)] for step in (4, 5, 6)]
    spread = [item[: size // 2] + fill(size - 6) + item[size // 2 :], item[: size // 3] + item[size // 2 :], [x for k, w in enumerate(item) for x in ([w, f"new{k}"] if k % 3 == 2 else [w])]]
    halves = [item[: size // 2], item[size // 2 :], item[: size // 2 - 1]]
    texts = [fill(80) + t + fill(80) for t in [*edited, *spread, *halves, *[edited[0]] * 40, *[item] * 3]]
    docs = documents(spark, [(k, " ".join(t)) for k, t in enumerate(texts)])
    parts = decontam.prepared(items(spark, [(1, " ".join(item))]))
    want = {k: local_score(item, t) / size for k, t in enumerate(texts)}
    want = {k: s for k, s in want.items() if s >= decontam.MIN_SCORE}
    got = {r[0]: r[2] for r in rows(decontam.contaminated(docs, parts))}
    assert len(want) >= 50 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert decontam.drop_contaminated(docs, parts).count() == len(texts) - len(want)


def test_excerpts_of_long_items(spark):
    """60 words of a 200-word passage are found, with their share as the score; 29 are not."""
    passage, fill = [f"passage{k}" for k in range(200)], [f"filler{k}" for k in range(90)]
    cuts = [(40, 100), (140, 200), (0, 30), (80, 109)]
    edited = [f"edit{k}" if k % 5 == 4 else w for k, w in enumerate(passage[20:90])]
    texts = [fill + passage[a:b] + fill for a, b in cuts] + [fill + edited + fill]
    docs = documents(spark, [(k, " ".join(t)) for k, t in enumerate(texts)])
    parts = decontam.prepared(items(spark, [(1, " ".join(passage))]))
    got = {r[0]: r[2] for r in rows(decontam.contaminated(docs, parts))}
    assert got.keys() == {0, 1, 2, 4} and all(abs(got[k] - local_score(passage, texts[k]) / 200) < 1e-6 for k in got)
    assert decontam.drop_contaminated(docs, parts).count() == 1
