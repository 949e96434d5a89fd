"""Vectorised text kernels shared by the operators of this subpackage.

Everything works on whole Arrow batches: the UTF-8 buffer of a string column is
viewed as one byte array, words are found with array operations, and every word
becomes one 64-bit hash. No loop runs per word or per character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x).astype(U64, copy=True)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        p = np.full(max(n, 1), U64(base))
        p[0] = U64(1)
        return np.multiply.accumulate(p)


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_POW = _powers(_BASE, 4096)

# Bytes that belong to words: ASCII letters, digits and everything outside ASCII.
_IS_WORD = np.zeros(256, bool)
for _r in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    _IS_WORD[list(_r)] = True
# Punctuation outside ASCII that separates words too (first byte 0xE2 0x80 and
# 0xC2 0x80-0xBF) is mapped to spaces before the scan.


def _pow(n: int) -> np.ndarray:
    return _POW if n <= len(_POW) else _powers(_BASE, n)


class Words:
    """Words of a batch of texts.

    hash: one uint64 a word; start, end: its byte range in ``buf``;
    offset: for text i, its words are offset[i]:offset[i + 1].
    """

    __slots__ = ("buf", "hash", "start", "end", "offset", "text_offset")

    def __init__(self, buf, hash_, start, end, offset, text_offset):
        self.buf, self.hash, self.start, self.end, self.offset, self.text_offset = buf, hash_, start, end, offset, text_offset

    def __len__(self):
        return len(self.offset) - 1

    @property
    def doc(self) -> np.ndarray:
        """Index of the text that each word belongs to."""
        return np.repeat(np.arange(len(self), dtype=np.int64), np.diff(self.offset))

    def text(self, word: int) -> str:
        return bytes(self.buf[self.start[word] : self.end[word]]).decode("utf-8", "replace")


def text_buffer(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def lowered(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    import pyarrow.compute as pc

    out = pc.utf8_lower(texts)
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def words(texts: pa.Array | pa.ChunkedArray, lower: bool = True) -> Words:
    """Split texts at everything that is neither a letter nor a digit and hash each word."""
    buf, toff = text_buffer(lowered(texts) if lower else texts)
    return words_of(buf, toff)


def words_of(buf: np.ndarray, toff: np.ndarray) -> Words:
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(buf, np.zeros(0, U64), z, z, np.zeros(len(toff), np.int64), toff)
    inside = _IS_WORD[buf]
    e2 = np.flatnonzero(buf[:-2] == 0xE2) if n > 2 else np.zeros(0, np.int64)
    if len(e2):
        e2 = e2[buf[e2 + 1] == 0x80]
        for k in range(3):
            inside[e2 + k] = False
    c2 = np.flatnonzero(buf[:-1] == 0xC2) if n > 1 else np.zeros(0, np.int64)
    if len(c2):
        c2 = c2[~np.isin(buf[c2 + 1], np.array([0xAA, 0xB5, 0xBA], np.uint8))]
        inside[c2] = inside[c2 + 1] = False
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cut = toff[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    starts[cut] = inside[cut]  # words never span two texts
    start = np.flatnonzero(starts)
    if not len(start):
        z = np.zeros(0, np.int64)
        return Words(buf, np.zeros(0, U64), z, z, np.zeros(len(toff), np.int64), toff)
    pos = np.flatnonzero(inside)
    first = np.searchsorted(pos, start)
    length = np.diff(np.append(first, len(pos)))
    at = np.arange(len(pos)) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_BYTE[buf[pos]] * _pow(int(length.max()))[at], first)
        h = mix(h + length.astype(U64))
    end = start + length
    return Words(buf, h, start, end, np.searchsorted(start, toff).astype(np.int64), toff)


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, offset): hashes of the n-grams of each text, in order.

    A text of 1 to n - 1 words has one gram of all its words; one without words has none.
    """
    cnt = np.diff(w.offset)
    m = np.where(cnt >= n, cnt - n + 1, np.minimum(cnt, 1))
    off = np.concatenate([[0], np.cumsum(m)]).astype(np.int64)
    if not off[-1]:
        return np.zeros(0, U64), off
    at = np.arange(off[-1]) - np.repeat(off[:-1], m) + np.repeat(w.offset[:-1], m)
    last = np.repeat(w.offset[1:], m)
    h = np.zeros(len(at), U64)
    with np.errstate(over="ignore"):
        for k in range(n):
            i = at + k
            ok = i < last
            h = np.where(ok, (h ^ w.hash[np.minimum(i, len(w.hash) - 1)]) * U64(0x9FB21C651E98DF25) + U64(k + 1), h)
            h ^= h >> U64(29)
    return mix(h), off


def unique_per_text(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, in a fixed order within it; at most 65,536 texts.

    Text index and the first 48 bits share one 64-bit key, so one plain sort orders
    both; should two hashes of a text differ only behind these bits, all bits are sorted.
    """
    if not len(h):
        return h, off
    doc = np.repeat(np.arange(len(off) - 1, dtype=U64), np.diff(off))
    key = (doc << U64(48)) | (h >> U64(16))
    order = np.argsort(key)
    key, h = key[order], h[order]
    if ((key[1:] == key[:-1]) & (h[1:] != h[:-1])).any():
        order = np.lexsort((h, key))
        key, h = key[order], h[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
    key = key[keep]
    return h[keep], np.searchsorted(key >> U64(48), np.arange(len(off), dtype=U64)).astype(np.int64)


_BYTE_AT = [_BYTE * _POW[k] for k in range(16)]


def prefix_hashes(w: Words, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size (ascending, at most 16) the hash of each word's first so many bytes, or of the whole shorter word."""
    h, out = np.zeros(len(w.hash), U64), []
    if not len(h):
        return [h] * len(sizes)
    buf, length = np.concatenate([w.buf, np.zeros(16, np.uint8)]), w.end - w.start
    with np.errstate(over="ignore"):
        for k in range(max(sizes)):
            h += _BYTE_AT[k][buf[w.start + k]] * (length > k)
            if k + 1 in sizes:
                out.append(mix(h ^ U64(0xA5A5A5A5 + k)))
    return out


def hash_word(word: str) -> int:
    """The hash that ``words`` gives to a text of this one word."""
    got = words(pa.array([word]))
    return int(got.hash[0]) if len(got.hash) else 0


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + n) for each pair."""
    length = np.asarray(length, np.int64)
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(start, np.int64) - before, length)
