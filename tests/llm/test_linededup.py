import hashlib

import numpy as np
import pyarrow as pa

from lakeplan.llm import linededup
from lakeplan.llm.queries import ORACLES, QUERIES

from .util import documents, no_documents, rows, split_words


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(data):
    """(doc_id, text, dropped) of every row, by comparing all pairs of lines; documents are different (id, text)."""
    mark = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    lines = sorted({((i, mark(t or "")), k, tuple(split_words(x))) for i, t in data if i is not None for k, x in enumerate((t or "").split("\n")) if split_words(x)})
    gone = set()
    for n, (i, k, w) in enumerate(lines):
        for j, m, v in lines[:n]:
            near = w == v or min(len(w), len(v)) >= linededup.SHORT and one_edit(list(w), list(v))
            if (j, m) < (i, k) and near:
                gone.add((i, k))
                break
    out = []
    for i, t in data:
        kept = None if t is None else [x for k, x in enumerate(t.split("\n")) if i is None or ((i, mark(t)), k) not in gone]
        out.append((i, None if t is None else "\n".join(kept), 0 if t is None else len(t.split("\n")) - len(kept)))
    return sorted(out, key=str)


def test_texts_of_one_id_lose_only_their_own_lines(spark):
    data = [(1, "shared footer line"), (5, "intro of A\nshared footer line"), (5, "intro of B\nunique body of B"), (5, "intro of B\nunique body of B")]
    got = rows(linededup.dedup_lines(documents(spark, data)))
    assert sorted(got, key=str) == sorted([(1, data[0][1], 0), (5, "intro of A", 1), (5, data[2][1], 0), (5, data[2][1], 0)], key=str) == brute(data)


def test_bound_is_a_parameter(spark):
    data = [(1, "one two three"), (2, "one two four"), (3, "one two")]
    assert sorted(rows(linededup.dedup_lines(documents(spark, data), short=2))) == [(1, "one two three", 0), (2, "", 1), (3, "", 1)]
    assert sorted(rows(linededup.dedup_lines(documents(spark, data)))) == [(i, t, 0) for i, t in data]


def test_same_as_sql(same_as_sql):
    assert len(same_as_sql(QUERIES["op6_line_dedup"], ORACLES["op6_line_dedup"])) > 100


def test_same_as_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(6)]
    data = []
    for i in range(60):
        lines = []
        for _ in range(4):
            base = [f"b{int(rng.integers(0, 12))}{j}" for j in range(int(rng.integers(5, 9)))]
            if rng.random() < 0.5:
                k = int(rng.integers(0, len(base)))
                base = [*base[:k], vocab[int(rng.integers(0, 6))], *base[k + int(rng.integers(0, 2)) :]] if rng.random() < 0.6 else base[:k] + base[k + 1 :]
            lines.append(" ".join(base))
        data.append((int(rng.permutation(60)[0]) + 100 * i, "\n".join(lines)))
    assert sorted(rows(linededup.dedup_lines(documents(spark, data))), key=str) == brute(data)


def test_awkward_rows(spark):
    long = " ".join(f"x{i}" for i in range(20_000))
    base = "alpha beta gamma delta epsilon zeta"
    data = [
        (5, f"{base}\nshort line\n\n...\n"),
        (5, f"{base}\nshort line\n\n...\n"),
        (6, "alpha beta GAMMA, delta epsilon zeta!\nshort lines\nshort line"),
        (7, "alpha beta gamma delta epsilon\nalpha beta gamma delta epsilon zeta eta"),
        (8, None),
        (9, ""),
        (None, base),
        (10, long + "\n" + long + " more"),
        (11, "y " + long),
        (12, "one two three four five six\r\none two three four six"),
        (13, f"{base}\n{base}\n{base}"),
    ]
    got = sorted(rows(linededup.dedup_lines(documents(spark, data))), key=str)
    assert got == brute(data)
    assert {r[0]: r[2] for r in got}[13] == 3 and {r[0]: r[2] for r in got}[11] == 1
    assert rows(linededup.dedup_lines(no_documents(spark))) == []


def test_hashes():
    x = linededup.Lines(pa.array(["a b c d e f g\nb c\n\na b d e f g", None, ""]))
    assert x.number.tolist() == [0, 1, 3] and x.doc.tolist() == [0, 0, 0] and x.n.tolist() == [7, 2, 6]
    line, place, h = linededup.deletion_hashes(x.words, x.offset)
    assert h[(line == 0) & (place == 2)][0] == x.hash[2]
    halves = linededup.half_hashes(x.words, x.offset)
    assert set(halves[0]) & set(halves[2])
