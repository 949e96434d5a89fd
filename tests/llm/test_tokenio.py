import heapq

import numpy as np
import pytest

from lakeplan.llm import tokenio
from lakeplan.llm.common import table

from .util import DOCS, documents, no_documents


def decoded(out, **options):
    """{doc_id: [ids of each row]} from blocks alone."""
    book = next(r for r in out.collect() if r.block == -1)
    lengths = np.frombuffer(book.bits, np.uint8)
    parts = tokenio.decode_blocks(out.filter("block >= 0"), lengths, **options).collect()
    docs, open_ = [], {}
    for r in sorted(parts, key=lambda r: (r.part, r.block)):
        if r.doc_from == 0:
            docs.append((r.doc_id, list(r.ids)))
            open_[r.part] = docs[-1][1]
        else:
            assert len(open_[r.part]) == r.doc_from
            open_[r.part] += r.ids
    return docs, lengths


def check(docs, data, **options):
    out = tokenio.huffman_blocks(docs, **options)
    got, lengths = decoded(out, **({"checkpoint": options["checkpoint"]} if "checkpoint" in options else {}))
    want = [(i, tokenio.encoder().encode_ordinary(t or "")) for i, t in data]
    assert sorted(got, key=str) == sorted(want, key=str)
    return out, lengths


def test_round_trip_of_the_table(spark, data):
    docs = table(spark, data, "documents")
    out, lengths = check(docs, [(r.doc_id, r.text) for r in docs.collect()])
    blocks = out.filter("block >= 0").collect()
    assert sum(len(r.bits) for r in blocks) < 1.7 * sum(r.n_tokens for r in blocks)
    assert lengths.max() <= tokenio.MAX_BITS and sum(2.0 ** -lengths[lengths > 0].astype(float)) <= 1


def test_small_blocks_and_checkpoints(spark):
    check(documents(spark), DOCS, block=64, checkpoint=8)


def test_decoding_may_start_at_any_checkpoint(spark):
    out = tokenio.huffman_blocks(documents(spark), block=1000, checkpoint=50)
    rows = out.collect()
    lengths = np.frombuffer(next(r for r in rows if r.block == -1).bits, np.uint8)
    d = tokenio.Decoder(lengths)
    r = max(rows, key=lambda r: r.n_tokens if r.block >= 0 else 0)
    whole = d.decode([(r.bits, r.n_tokens, r.checkpoints)], 50)[0]
    for k in (1, 5, 19):
        assert (d.decode([(r.bits, 50, [r.checkpoints[k]])], 50)[0] == whole[50 * k : 50 * k + 50]).all()


def test_awkward_rows(spark):
    check(documents(spark), DOCS)
    empty = tokenio.huffman_blocks(no_documents(spark)).collect()
    assert [r.block for r in empty] == [-1] and not any(empty[0].bits)
    blank = tokenio.huffman_blocks(documents(spark, [(1, ""), (2, None)])).collect()
    assert sorted(i for r in blank for i in r.doc_ids) == [1, 2] and sum(r.n_tokens for r in blank if r.block >= 0) == 0
    check(documents(spark, [(1, "a a"), (2, " a")][:1] * 3), [(1, "a a")] * 3)


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 300_000 + "x", "word " * 100_000, "\n" * 5000 + "end" + "\t" * 5000, "it's we'll  I'd　x\x1cy", "12345 678, ..!? é漢字🙂 <|endoftext|>", "a" + " " * 2001 + "b"])
def test_long_texts_have_the_tokenizers_ids(text):
    want = tokenio.encoder().encode_ordinary(text) if text.strip() and " " * 3000 not in text else None
    got = tokenio.encode_text(text)
    assert tokenio.encoder().decode(got) == text and want in (None, got)


def huffman_cost(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


def limited_cost(counts, limit):
    """Least cost under a length limit, by trying all sorted length vectors."""
    c = sorted((int(x) for x in counts if x), reverse=True)
    best = None

    def go(k, last, room, cost):
        nonlocal best
        if best is not None and cost >= best:
            return
        if k == len(c):
            best = cost
            return
        for n in range(last, limit + 1):
            left = room - 2.0**-n
            if left >= (len(c) - k - 1) * 2.0**-limit - 1e-12:
                go(k + 1, n, left, cost + n * c[k])

    go(0, 1, 1.0, 0)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_code_lengths_are_optimal(seed):
    rng = np.random.default_rng(seed)
    counts = np.floor(np.exp(rng.normal(0, 3, 200)) * 10).astype(np.int64)
    n = tokenio.code_lengths(counts, 40)
    assert (n.astype(int) * counts).sum() == huffman_cost(counts) and ((n > 0) == (counts > 0)).all()
    few = np.array([1, 1, 2, 4, 8, 16, 32, 64])[: 4 + seed % 5]
    for limit in (3, 4):
        n = tokenio.code_lengths(few, limit)
        assert n.max() <= limit and (n.astype(int) * few).sum() == limited_cost(few, limit)


def test_codes_are_canonical():
    n = np.array([2, 0, 1, 3, 3], np.uint8)
    codes = tokenio.canonical_codes(n)
    assert [f"{codes[i]:0{n[i]}b}" for i in (2, 0, 3, 4)] == ["0", "10", "110", "111"]
    assert tokenio.code_lengths(np.zeros(4, int)).tolist() == [0] * 4 and tokenio.code_lengths(np.array([0, 9])).tolist() == [0, 1]


def test_keys_of_merged_and_united_results(spark):
    """(part, block) tells blocks apart after a coalesce and across calls, and documents come back whole."""
    docs = documents(spark).repartition(6)
    out = tokenio.huffman_blocks(docs, block=64).coalesce(1)
    both = out.union(tokenio.huffman_blocks(docs, block=64))
    keys = [(r.part, r.block) for r in both.collect()]
    assert len(set(keys)) == len(keys) and sum(b == -1 for _, b in keys) == 2
    want = sorted(((i, tokenio.encoder().encode_ordinary(t or "")) for i, t in DOCS), key=str)
    assert sorted(decoded(out)[0], key=str) == want


def test_too_short_codes_are_an_error():
    with pytest.raises(ValueError):
        tokenio.code_lengths(np.ones(300, np.int64), 8)
