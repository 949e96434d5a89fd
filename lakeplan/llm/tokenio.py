"""Operator 8: token ids as canonical length-limited Huffman blocks.

Texts are tokenised once (public tokenizer, path is a parameter) into a written
table of packed ids; ids are counted over the whole corpus, package-merge gives
optimal code lengths of at most ``MAX_BITS`` bits, and a second pass packs runs
of ids into blocks that can be read alone. A block keeps the bit offset of every
``CHECKPOINT``-th token, so a reader may start there, and the table-driven
decoder follows all checkpoints of many blocks at once.

Result rows: block -1 is the code book (``bits`` holds the code length of each
id), every other row one block. A part is named by its run (drawn anew for each
call; the code book's part is the run alone) and its input partition, so (part,
block) tells blocks apart however results are coalesced or united. doc_ids, doc_starts and doc_from tell, for each
document part in the block, its id, its first token's place in the block and
that token's place in the document.

Cases: null and empty texts are documents of no tokens; null ids stay null in
doc_ids; very long texts run over several blocks; repeated rows are encoded as
often as they occur; an empty table gives a code book of zero lengths and no
block; other columns, whatever their names, are ignored. A corpus of one
distinct id gets a one-bit code. A vocabulary in use that codes of ``max_bits`` bits
cannot tell apart is an error.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, written
from .kernels import U64, ranges

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_BITS = 16
BLOCK = 1 << 16
CHECKPOINT = 1 << 10
SCHEMA = "part string, block long, n_tokens long, n_bits long, bits binary, checkpoints array<long>, doc_ids array<long>, doc_starts array<long>, doc_from array<long>"
_ARROW = pa.schema([("part", pa.string()), ("block", pa.int64()), ("n_tokens", pa.int64()), ("n_bits", pa.int64()), ("bits", pa.binary()), *((n, pa.list_(pa.int64())) for n in ("checkpoints", "doc_ids", "doc_starts", "doc_from"))])
_loaded: dict[str, object] = {}
# A single blank between two other characters always starts a token, so a text may be cut there.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_PIECE = 200_000
# Long runs of white space overflow the tokenizer's backtracking regex; they are encoded as the one piece that they are.
_BLANKS = re.compile(r"[^\S\x1c-\x1f]{2000,}")


def encoder(path: str = TOKENIZER):
    """The tokenizer in a tiktoken rank file; loaded once in each process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def pieces(text: str, most: int = _PIECE) -> list[str]:
    """Cut a very long text at places where the tokenizer cuts anyway."""
    out, at = [], 0
    while len(text) - at > most:
        m = _CUT.search(text, at + most)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def encode_text(text: str, path: str = TOKENIZER) -> list[int]:
    enc = encoder(path)
    if len(text) < 2000:
        return enc.encode_ordinary(text)
    out, at = [], 0
    for m in _BLANKS.finditer(text):
        end = m.end() - (m.end() < len(text))  # the last blank belongs to what follows
        for p in pieces(text[at : m.start()]):
            out += enc.encode_ordinary(p)
        out += enc._encode_single_piece(text[m.start() : end])
        at = end
    for p in pieces(text[at:]) if at else [text] if len(text) <= _PIECE else pieces(text):
        out += enc.encode_ordinary(p)
    return out


def id_type(path: str):
    return np.uint16 if encoder(path).max_token_value < 1 << 16 else np.uint32


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Written table (doc_id, ids) with little-endian ids of ``id_type``; all rows of docs, null ids too."""
    data = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        kind = id_type(tokenizer)
        for b in batches:
            for s in slices(b, "text", 4 << 20):
                ids = [np.array(encode_text(t, tokenizer), kind).tobytes() for t in s.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return written(data.mapInArrow(run, "doc_id long, ids binary"), "tokens")


def _ids_of(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of a binary column, without copying it."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    width = np.dtype(kind).itemsize
    data = column.buffers()[2]
    ids = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(kind) if data is not None and off[-1] > off[0] else np.zeros(0, kind)
    return ids, (off - off[0]) // width


def count_ids(tokens: DataFrame, tokenizer: str = TOKENIZER) -> np.ndarray:
    """How often each id of the vocabulary occurs in the whole table; the driver gets one row an id."""

    def run(batches):
        kind = id_type(tokenizer)
        total = np.zeros(encoder(tokenizer).max_token_value + 1, np.int64)
        for b in batches:
            total += np.bincount(_ids_of(b.column("ids"), kind)[0], minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    counts = np.zeros(encoder(tokenizer).max_token_value + 1, np.int64)
    got = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return counts


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that don't occur."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.lexsort((used, counts[used]))]
    leaf = counts[order].astype(np.float64)
    level, is_leaf = leaf, [np.ones(len(leaf), bool)]
    for _ in range(limit - 1):
        pack = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, pack])
        at = np.argsort(both, kind="stable")
        level = both[at]
        is_leaf.append(at < len(leaf))
    take, depth = 2 * (len(leaf) - 1), np.zeros(len(leaf), np.int64)
    for flags in reversed(is_leaf):
        n = int(flags[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    out[order] = depth
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    code = prev = 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        code <<= n - prev
        prev = n
        ids = np.flatnonzero(lengths == n)
        codes[ids] = np.arange(code, code + len(ids), dtype=np.uint64)
        code += len(ids)
    return codes


def pack(ids: np.ndarray, cuts: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Bits of each run ids[cuts[i]:cuts[i+1]], every token's bit offset in its run, bits of each run."""
    size = lengths[ids].astype(np.int64)
    end = np.concatenate([[0], np.cumsum(size)])
    n_bits = end[cuts[1:]] - end[cuts[:-1]]
    words = (n_bits + 63) >> 6
    base = np.concatenate([[0], np.cumsum(words)])
    run = np.diff(cuts)
    offset = end[:-1] - np.repeat(end[cuts[:-1]], run)
    at = offset + np.repeat(base[:-1] << 6, run)
    word, room = at >> 6, 64 - (at & 63) - size
    code = codes[ids]
    fits = room >= 0
    first = np.where(fits, code << np.maximum(room, 0).astype(U64), code >> np.maximum(-room, 0).astype(U64))
    out = np.zeros(int(base[-1]) + 1, U64)
    if len(ids):
        start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[start]] = np.add.reduceat(first, start)
        over = np.flatnonzero(~fits)
        out[word[over] + 1] += code[over] << (64 + room[over]).astype(U64)
    raw = out.astype(">u8").tobytes()
    return [raw[base[i] * 8 : base[i] * 8 + (int(n_bits[i]) + 7) // 8] for i in range(len(run))], offset, n_bits


def encode_blocks(tokens: DataFrame, lengths: np.ndarray, tokenizer: str = TOKENIZER, block: int = BLOCK, checkpoint: int = CHECKPOINT, run_id: str = "") -> DataFrame:
    def run(batches):
        kind, codes, number = id_type(tokenizer), canonical_codes(lengths), 0
        for b in batches:
            part = f"{run_id}-{b.column('part')[0].as_py()}" if b.num_rows else ""
            ids, off = _ids_of(b.column("ids"), kind)
            doc_ids = b.column("doc_id")
            n = len(ids)
            bounds = np.append(np.arange(0, n, block), n) if n else np.array([0, 0])
            for k in range(0, len(bounds) - 1, 16):
                edge = bounds[k : k + 17]
                bits, offset, n_bits = pack(ids[edge[0] : edge[-1]], edge - edge[0], codes, lengths)
                rows = {x: [] for x in _ARROW.names}
                for i, (b0, b1) in enumerate(zip(edge[:-1], edge[1:])):
                    first = int(np.searchsorted(off[:-1], b0))
                    if first and off[first] > b0:
                        first -= 1
                    last = len(off) - 1 if b1 == n else int(np.searchsorted(off[:-1], b1))
                    start = off[first:last]
                    for name, value in zip(rows, (part, number, b1 - b0, n_bits[i], bits[i], offset[b0 - edge[0] : b1 - edge[0] : checkpoint], doc_ids.slice(first, last - first).to_pylist(), np.maximum(start, b0) - b0, np.maximum(b0 - start, 0))):
                        rows[name].append(value)
                    number += 1
                yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in _ARROW], schema=_ARROW)

    return tokens.select("doc_id", "ids", F.spark_partition_id().alias("part")).mapInArrow(run, SCHEMA)


def code_book(spark: SparkSession, lengths: np.ndarray, run_id: str = "") -> DataFrame:
    return spark.createDataFrame([(run_id, -1, len(lengths), 8 * len(lengths), bytearray(lengths.astype(np.uint8).tobytes()), [], [], [], [])], SCHEMA)


def huffman_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, block: int = BLOCK, checkpoint: int = CHECKPOINT, max_bits: int = MAX_BITS) -> DataFrame:
    """Code book row and block rows of all documents."""
    tokens = token_table(docs, id_col, text_col, tokenizer)
    lengths = code_lengths(count_ids(tokens, tokenizer), max_bits)
    run_id = uuid.uuid4().hex[:16]
    return code_book(docs.sparkSession, lengths, run_id).union(encode_blocks(tokens, lengths, tokenizer, block, checkpoint, run_id))


class Decoder:
    """Table-driven decoder of a code book."""

    def __init__(self, lengths: np.ndarray):
        self.bits = max(int(lengths.max(initial=0)), 1)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        span = (1 << (self.bits - lengths[order].astype(np.int64))).astype(np.int64)
        self.symbol = np.zeros(1 << self.bits, np.int64)
        self.length = np.ones(1 << self.bits, np.int64)
        self.symbol[: span.sum()] = np.repeat(order, span)
        self.length[: span.sum()] = np.repeat(lengths[order], span)

    def decode(self, blocks: list[tuple[bytes, int, list[int]]], checkpoint: int = CHECKPOINT) -> list[np.ndarray]:
        """Ids of each (bits, n_tokens, checkpoints); all checkpoints advance together."""
        base = np.cumsum([0, *(len(b) + 8 for b, _, _ in blocks)])
        raw = np.frombuffer(b"".join(b + bytes(8) for b, _, _ in blocks), np.uint8).astype(U64)
        n = np.array([x for _, x, _ in blocks], np.int64)
        lanes = np.array([len(c) for _, _, c in blocks], np.int64)
        at = np.concatenate([np.asarray(c, np.int64) + base[i] * 8 for i, (_, _, c) in enumerate(blocks)]) if len(blocks) else np.zeros(0, np.int64)
        nth = ranges(np.zeros(len(lanes), np.int64), lanes)
        left = np.minimum(np.repeat(n, lanes) - nth * checkpoint, checkpoint)
        to = np.repeat(np.cumsum(n) - n, lanes) + nth * checkpoint
        out = np.zeros(int(n.sum()), np.int64)
        for step in range(int(left.max(initial=0))):
            if step and (left == step).any():
                live = left > step
                at, left, to = at[live], left[live], to[live]
            i = at >> 3
            window = (raw[i] << U64(32)) | (raw[i + 1] << U64(24)) | (raw[i + 2] << U64(16)) | (raw[i + 3] << U64(8)) | raw[i + 4]
            key = ((window >> (40 - self.bits - (at & 7)).astype(U64)) & U64((1 << self.bits) - 1)).astype(np.int64)
            out[to + step] = self.symbol[key]
            at = at + self.length[key]
        return np.split(out, np.cumsum(n)[:-1])


def decode_blocks(blocks: DataFrame, lengths: np.ndarray, checkpoint: int = CHECKPOINT) -> DataFrame:
    """(doc_id, part, block, doc_from, ids) of every document part; blocks are decoded independently."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        d = Decoder(lengths)
        for b in batches:
            rows = [r for r in b.to_pylist() if r["block"] >= 0]
            for r, ids in zip(rows, d.decode([(r["bits"], r["n_tokens"], r["checkpoints"]) for r in rows], checkpoint)):
                ends = [*r["doc_starts"][1:], r["n_tokens"]]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array([r["part"]] * len(ends), pa.string()), pa.array([r["block"]] * len(ends), pa.int64()), pa.array(r["doc_from"], pa.int64()), pa.array([ids[s:e].tolist() for s, e in zip(r["doc_starts"], ends)], pa.list_(pa.int64()))], names=["doc_id", "part", "block", "doc_from", "ids"])

    return blocks.mapInArrow(run, "doc_id long, part string, block long, doc_from long, ids array<long>")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman_blocks(table(spark, sf_dir, "documents"))
