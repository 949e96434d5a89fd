from collections import defaultdict

import numpy as np
import pytest

from lakeplan.llm import pagediff
from lakeplan.llm.common import table

from .util import rows


def lcs(a, b):
    n = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            n[i, j] = n[i - 1, j - 1] + 1 if x == y else max(n[i - 1, j], n[i, j - 1])
    return n[-1, -1]


def brute(data):
    """(page_id, url, partner_id, n_lines, n_removed) by comparing with the neighbouring paths of each host, one by one."""
    hosts = defaultdict(lambda: defaultdict(list))
    for r in data:
        host, path = pagediff.host_path(r[1])
        hosts[host][path].append(r)
    out = []
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] is not None)
    for host, paths in hosts.items():
        order = sorted(paths, key=lambda p: p.encode())
        for k, p in enumerate(order):
            near = []
            if host and k:
                near.append((order[k - 1], max(paths[order[k - 1]], key=key)))
            if host and k + 1 < len(order):
                near.append((order[k + 1], min(paths[order[k + 1]], key=key)))
            near.sort(key=lambda n: -len(common(p, n[0])))
            for r in paths[p]:
                lines = pagediff.text_lines(r[2]) if r[2] is not None else []
                found = (None, 0)
                for _, other in near if r[2] is not None else ():
                    b = pagediff.text_lines(other[2]) if other[2] is not None else []
                    if b != lines:
                        found = (other[0], int(lcs(lines, b)))
                        break
                out.append((r[0], r[1], found[0], len(lines), found[1]))
    return sorted(out, key=str)


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]


def pages(spark, data):
    return spark.createDataFrame([(*r, "x", 1, b"y") for r in data], "page_id long, url string, html string, host string, kind int, lines binary").repartition(3)


SITE = [(10 * h + i, f"http://host{h}.example/{'a' if i % 2 else 'b'}/page{i}.html?q={i}", f"<html><head><title>t</title><style>p</style></head><nav>Home</nav><p>Menu {h}</p><p>Story {h} {i} &amp; more</p><p>Own {i * 7}</p><footer>Foot</footer>") for h in range(3) for i in range(7)]


def test_same_as_brute_force(spark):
    got = sorted((tuple(r)[:5] for r in pagediff.extract(pages(spark, SITE)).collect()), key=str)
    assert got == brute(SITE)
    text = {r[0]: r[5] for r in rows(pagediff.extract(pages(spark, SITE)))}
    assert text[3] == "Story 0 3 & more\nOwn 21"


@pytest.mark.parametrize("range_bytes,end_pages", [(200, 3), (1000, 8), (1 << 30, 100)])
def test_partitions_change_nothing(spark, data, range_bytes, end_pages):
    df = table(spark, data, "pages")
    want = sorted(rows(pagediff.extract(df, range_bytes=1 << 40)), key=str)
    got = sorted(rows(pagediff.extract(df.repartition(5), range_bytes=range_bytes * 50, end_pages=end_pages)), key=str)
    assert got == want and len(got) == df.count()


def test_the_table_against_brute_force(spark, data):
    df = table(spark, data, "pages")
    got = sorted((tuple(r)[:5] for r in pagediff.extract(df).collect()), key=str)
    assert got == brute([(r.page_id, r.url, r.html) for r in df.collect()])


def test_awkward_rows(spark):
    long = "".join(f"<p>line {i}</p>" for i in range(3000))
    data = [(1, None, "<p>a</p>"), (2, "", "<p>a</p>"), (3, "not a url", "<p>a</p>"), (4, "http://one.example/x", "<p>a</p><p>b</p>"), (5, "http://two.example/x", None), (6, "http://two.example/y", "<p>s</p><p>t</p>"), (7, "http://two.example/z", ""), (8, "http://big.example/1", long + "<p>own one</p>"), (9, "http://big.example/2", "<p>other</p>" + long), (10, "http://big.example/3", "<p>line 5</p><p>x</p><p>line 9</p><p>rest of this page</p>"), (None, "http://two.example/y", "<p>s</p><p>u</p>"), (6, "http://two.example/y", "<p>s</p><p>t</p>"), (11, "http://empty.example/a", "<script>x"), (12, "http://empty.example/b", "<p>q<br>q</p>\n<!-- open")]
    got = rows(pagediff.extract(pages(spark, data)))
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(data)
    text = {(r[0], r[1]): r[5] for r in got}
    assert text[5, "http://two.example/x"] is None and text[7, "http://two.example/z"] == "" and text[4, "http://one.example/x"] == "a\nb"
    assert text[10, "http://big.example/3"] == "x\nrest of this page"
    assert rows(pagediff.extract(pages(spark, data).limit(0))) == []


@pytest.mark.parametrize("page,lines", [("<P>a  b</P><div>c<b>d</b>e</div>", ["a b", "cde"]), ("x &lt;p&gt; y", ["x <p> y"]), ("<script>if (a<b) {}</script>z", ["z"]), ("a<br/>b<!-- c -->d", ["a", "b d"]), ("3 < 4 and 5 > 2", ["3 < 4 and 5 > 2"]), ("", [])])
def test_text_lines(page, lines):
    assert pagediff.text_lines(page) == lines


def test_hosts_and_paths():
    assert pagediff.host_path("HTTPS://User:pw@Example.COM:80/a/b/index.html?x#y") == ("example.com", "/a/b")
    assert pagediff.host_path("//e.org/a/") == ("e.org", "/a") and pagediff.host_path("mailto:x") == ("", "") and pagediff.host_path(None) == ("", "")


@pytest.mark.parametrize("bits", [1 << 28, 60])
def test_alignment_is_longest(monkeypatch, bits):
    monkeypatch.setattr(pagediff, "_STATE_BITS", bits)
    rng = np.random.default_rng(2)
    for n, m, k in ((0, 5, 3), (1, 1, 1), (30, 40, 3), (60, 50, 8), (64, 64, 2), (130, 129, 40)):
        a, b = ([f"l{x}" for x in rng.integers(0, k, size)] for size in (n, m))
        got = sorted(pagediff.shared_lines(a, b))
        rest = iter(b)
        assert len(got) == lcs(a, b) and all(a[i] in rest for i in got)  # a subsequence of b, in order


def test_long_pages_align_in_little_memory(monkeypatch):
    """20,000 shuffled lines: 400 million cells."""
    import time

    monkeypatch.setattr(pagediff, "_STATE_BITS", 1 << 24)
    rng, lines = np.random.default_rng(3), [f"line {k}" for k in range(20_000)]
    began = time.time()
    got = pagediff.shared_lines(lines, [lines[k] for k in rng.permutation(20_000)])
    assert 200 < len(got) < 400 and time.time() - began < 60


def test_nearly_equal_pages_lose_what_they_share(spark):
    menu = "".join(f"<p>menu {k}</p>" for k in range(30))
    data = [(k, f"http://stub.example/{k}", f"{menu}<p>own {k}</p>") for k in range(4)] + [(9, "http://copy.example/a", menu), (10, "http://copy.example/b", menu)]
    got = {r[0]: r[5] for r in rows(pagediff.extract(pages(spark, data)))}
    assert [got[k] for k in range(4)] == [f"own {k}" for k in range(4)] and got[9] == got[10] == "\n".join(f"menu {k}" for k in range(30))
