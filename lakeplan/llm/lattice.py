"""Operator 3: embedding near-duplicates by E8 lattice hashing.

Each of TABLES tables projects unit vectors by BLOCKS random orthonormal maps to
8 dimensions and decodes each to the nearest point of the E8 lattice; the points
together name the vector's cell. A vector is stored in its own cell and looks
into PROBES further cells of each table, reached through the next nearest lattice
points of its blocks. What meets there is verified by cosine, so no reported link
is wrong; with the defaults a pair at the threshold is missed about once in two hundred.

Equal vectors are one vector from the start. So that no list of pairs grows with
the square of a group, each vector is first compared with the leader of each of
its cells, then only vectors of different classes that share a cell are; inside a
class all vectors are compared, block by block, and only counts leave the tasks.

Cases: null, empty, zero or non-finite vectors, vectors of another length than
most, and null ids match nothing; repeated rows of an id count once (its least
vector) and an id is never linked with itself; equal vectors of different ids, and
vectors that differ in length alone, are copies of cosine 1; a cosine equal to the
threshold links; tables that are empty give no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import light, ship, table, written
from .components import class_matches, components
from .kernels import U64, mix

THRESHOLD = 0.95
TABLES = 8
BLOCKS = 2
PROBES = 4
#: Lattice scale at which a pair at THRESHOLD is REACH apart in each block on average.
REACH = 0.5
#: Vectors, and their bytes, in a block of a class.
BLOCK, BLOCK_BYTES = 2048, 64 << 20
#: Rounds of comparisons with leaders before the exact round.
STARS = 2


def nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest point of D8 (integers of even sum) to each row."""
    r = np.rint(y)
    odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
    if len(odd):
        d = y[odd] - r[odd]
        k = np.abs(d).argmax(1)
        r[odd, k] += np.where(d[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest point of E8 = D8 and D8 + 1/2 to each row."""
    a, b = nearest_d8(y), nearest_d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for m in range(256):
        v = np.array([0.5 if m >> k & 1 else -0.5 for k in range(8)])
        if int(round(v.sum())) % 2 == 0:
            out.append(v)
    return np.array(out)


ROOTS = _roots()


def neighbours(y: np.ndarray, point: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The next ``count`` lattice points around each row's own, and how much farther (squared) they are."""
    farther = 2 - 2 * ((y - point) @ ROOTS.T)  # |y - p - r|^2 - |y - p|^2
    near = np.argpartition(farther, count, 1)[:, :count]
    cost = np.take_along_axis(farther, near, 1)
    order = np.argsort(cost, 1)
    near = np.take_along_axis(near, order, 1)
    return point[:, None, :] + ROOTS[near], np.take_along_axis(cost, order, 1)


def projections(dim: int, tables: int, blocks: int, seed: int = 11) -> np.ndarray:
    """(tables, blocks, dim, 8) maps with orthonormal columns (as far as dim allows)."""
    rng = np.random.default_rng(seed)
    out = np.zeros((tables, blocks, dim, 8))
    for t in range(tables):
        for b in range(blocks):
            q = np.linalg.qr(rng.normal(size=(dim, min(8, dim))))[0]
            out[t, b, :, : q.shape[1]] = q
    return out


def _point_hash(point: np.ndarray) -> np.ndarray:
    code = (np.rint(point * 2).astype(np.int64) + 4096).astype(U64)
    h = np.zeros(code.shape[:-1], U64)
    with np.errstate(over="ignore"):
        for k in range(8):
            h = mix(h * U64(0x9E3779B97F4A7C15) + code[..., k])
    return h


def cells(x: np.ndarray, threshold: float = THRESHOLD, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, maps: np.ndarray | None = None) -> np.ndarray:
    """(rows, tables, 1 + probes) cell keys of unit vectors: the own cell first."""
    dim = x.shape[1]
    maps = projections(dim, tables, blocks) if maps is None else maps
    scale = REACH / (np.sqrt(2 - 2 * threshold) * np.sqrt(min(8, dim) / dim))
    out = np.zeros((len(x), tables, 1 + probes), U64)
    for t in range(tables):
        own, other, cost = [], [], []
        for b in range(blocks):
            y = (x @ maps[t, b]) * scale
            p = nearest_e8(y)
            n, c = neighbours(y, p, probes)
            own.append(_point_hash(p))
            other.append(_point_hash(n))
            cost.append(c)

        def name(parts):
            h = np.full(len(x), t, U64)
            for q in parts:
                h = mix(h + q)
            return h

        out[:, t, 0] = name(own)
        # a probe changes one block, the cheapest changes first
        keys = np.stack([name([other[b][:, i] if b == c else own[c] for c in range(blocks)]) for b in range(blocks) for i in range(probes)], 1)
        order = np.argsort(np.concatenate(cost, 1), 1)[:, :probes]
        out[:, t, 1:] = np.take_along_axis(keys, order, 1)
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a binary column of float32 unit vectors."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.float32).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """Written (vec_id, unit), one row an id, unit being a float32 unit vector as binary; and the dimension that most rows have."""
    ship(vectors.sparkSession)
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<float>").alias("embedding")).filter("vec_id is not null and size(embedding) > 0")
    dim = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if dim is None:
        return v, 0
    plain = ~F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("embedding", lambda e: e != 0)

    def run(batches):
        for b in batches:
            x = b["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim.d)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) + np.float32(0)  # no negative zeros
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "unit"])

    one = v.filter((F.size("embedding") == dim.d) & plain).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return written(one.mapInArrow(run, "vec_id long, unit binary"), "vectors"), dim.d


def _looks(v: DataFrame, dim: int, threshold: float, tables: int, blocks: int, probes: int) -> DataFrame:
    """(node, cell, own): every cell that each vector of (node, unit) is stored in or looks into."""

    def run(batches):
        maps = projections(dim, tables, blocks)
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                s = b.slice(i, 2000)
                key = cells(_matrix(s["unit"], dim).astype(np.float64), threshold, tables, blocks, probes, maps)
                n = key.shape[1] * key.shape[2]
                own = np.tile(np.arange(key.shape[2]) == 0, s.num_rows * key.shape[1])
                yield pa.RecordBatch.from_arrays([s["node"].take(pa.array(np.repeat(np.arange(s.num_rows), n))), pa.array(key.ravel().view(np.int64)), pa.array(own)], names=["node", "cell", "own"])

    return v.mapInArrow(run, "node long, cell long, own boolean")


def _leaders(looks: DataFrame) -> DataFrame:
    """(a, b): each vector b of (node, cell, own, label) with the first vector stored in each of its cells that is of another class."""
    by = F.struct("node", "label")
    one = looks.groupBy("cell").agg(F.min(F.when(F.col("own"), by)).alias("one"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
    led = looks.join(one, "cell")
    two = led.filter("own and label != one.label").groupBy("cell").agg(F.min(by).alias("two"))
    tries = led.join(two, "cell", "left").select(F.col("node").alias("b"), F.when(F.col("label") != F.col("one.label"), F.col("one.node")).otherwise(F.col("two.node")).alias("a"))
    return tries.filter("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _strangers(looks: DataFrame) -> DataFrame:
    """(a, b): all vectors of different classes of which one is stored where the other is stored or looks.

    Those of a cell's largest class are not compared with each other: a pair has one of another class.
    """
    per = looks.groupBy("cell", "label").agg(F.count("*").alias("k"))
    mixed = per.groupBy("cell").agg(F.max(F.struct("k", "label")).alias("top"), F.count("*").alias("n")).filter("n > 1").select("cell", F.col("top.label").alias("top"))
    here = looks.join(mixed, "cell")
    few = here.filter("label != top").select("cell", F.col("node").alias("a"), F.col("label").alias("la"), F.col("own").alias("oa"))
    all_ = here.select("cell", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("own").alias("ob"))
    met = few.join(all_, "cell").filter("la != lb and (oa or ob)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES) -> DataFrame:
    """vec_id, class_id, n_links, n_copies of every vector with a link.

    class_id is the lowest vec_id of the vectors that links lead to; n_links
    counts those at threshold or above, n_copies the equal ones among them.
    """
    all_, dim = usable(vectors, id_col, vector_col)
    if not dim:
        none = [F.col("vec_id").alias(c) for c in ("vec_id", "class_id", "n_links", "n_copies")]
        return all_.select(*none).limit(0)
    v = written(all_.groupBy("unit").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")), "distinct")
    looks = _looks(v, dim, threshold, tables, blocks, probes)
    shared = looks.groupBy("cell").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("own").alias("own")).filter("low != high and own").select("cell")
    looks = written(looks.join(shared, "cell", "left_semi"), "looks")

    @F.arrow_udf("boolean")
    def near(p: pa.Array, q: pa.Array) -> pa.Array:
        return pa.array(np.einsum("ij,ij->i", _matrix(p, dim), _matrix(q, dim), dtype=np.float64) >= threshold if len(p) else np.zeros(0, bool))

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (v.select(F.col("node").alias(c), F.col("unit").alias("u" + c)) for c in "ab")
        return written(pairs.join(a, "a").join(b, "b").filter(near("ua", "ub")).select("a", "b"), "links")

    def labelled(links: DataFrame) -> DataFrame:
        return looks.join(light(components(links)), "node", "left").select("node", "cell", "own", F.coalesce("label", "node").alias("label"))

    links = verified(_leaders(looks.withColumn("label", F.col("node"))))
    for _ in range(STARS - 1):
        links = links.union(verified(_leaders(labelled(links))))
    labels = components(links.union(verified(_strangers(labelled(links)))))

    def similar(rows: pa.Table, one: tuple[int, int], two: tuple[int, int]) -> np.ndarray:
        x, y = (_matrix(rows["unit"].slice(i, j - i), dim).astype(np.float64) for i, j in (one, two))
        return x @ y.T >= threshold

    grouped = written(v.select("node", "weight").join(labels, "node", "left").filter("label is not null or weight > 1"), "weights")
    matches = class_matches(v.select("node", F.lit(4 * dim).alias("bytes"), "unit"), grouped.filter("label is not null"), similar, BLOCK, BLOCK_BYTES, 2 * BLOCK)
    low = F.coalesce("label", "node").alias("class_id")  # the lowest id of equal vectors is their node, so the lowest node is the lowest id
    named = grouped.join(matches, "node", "left").select("node", low, (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), (F.col("weight") - 1).alias("n_copies"))
    named = written(named.join(v.select("node", "unit"), "node").drop("node"), "named")
    return all_.join(light(named), "unit").select("vec_id", "class_id", "n_links", "n_copies")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "embeddings"))
