"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected ``CURVES`` times onto a few random orthogonal directions, shifted,
quantised and put in the order of a Hilbert curve. Every order is cut into ranges of keys
(blocks); a query meets its own block and both neighbours of every curve, and what these
windows find is merged and ranked by exact distance on the original vectors.

A block holds one part in ``BLOCKS`` of the rows, or ``LEAST`` rows in small tables, so a
query always sees three blocks of several. Where many vectors have one key, blocks without
rows lie between others; the neighbours of a block are the next ones with rows. The
cuts come from a bounded sample; every row is indexed. Equal vectors are reduced to the
ids that can appear in a result before they are dealt, and blocks that are fuller than
planned are dealt on to several tasks, which each query visits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Stage, bound_batches, empty

CURVES, DIMS, BITS = 24, 16, 2
BLOCKS, LEAST = 80, 64
SAMPLE = 20_000
K = 10
REACH = 2.5  # deviations that the grid covers


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index (uint64) of each row of grid cells below 2**bits, by the transposed form."""
    x = cells.T.astype(np.int64)
    dims, top = len(x), 1 << (bits - 1)
    level = top
    while level > 1:
        low = level - 1
        for i in range(dims):
            high = (x[i] & level) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    level = top
    while level > 1:
        flip ^= np.where((x[dims - 1] & level) > 0, level - 1, 0)
        level >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[i] >> b) & 1).astype(np.uint64)
    return key


class Curves:
    """Projections, shifts and cuts, fitted on a bounded sample of vectors."""

    def __init__(self, sample: np.ndarray, blocks: int, curves: int, seed: int = 20240613):
        rng = np.random.default_rng(seed)
        size = sample.shape[1]
        self.dims = min(DIMS, size)
        self.mean = sample.mean(0)
        self.axes, self.scale, self.shift, self.cuts = [], [], [], []
        for _ in range(curves):
            axes = np.linalg.qr(rng.normal(size=(size, self.dims)))[0]
            self.axes.append(axes)
            self.scale.append(((sample - self.mean) @ axes).std(0) + 1e-12)
            self.shift.append(rng.uniform(-0.5, 0.5, self.dims))
        for c in range(curves):
            keys = np.sort(self.key(sample, c))
            at = (np.arange(1, blocks) * len(keys)) // blocks
            self.cuts.append(keys[at])
        self.blocks = blocks

    def key(self, x: np.ndarray, c: int) -> np.ndarray:
        y = ((x - self.mean) @ self.axes[c]) / self.scale[c] + self.shift[c]
        cells = np.floor((y + REACH) / (2 * REACH) * (1 << BITS))
        return hilbert(np.clip(cells, 0, (1 << BITS) - 1), BITS)

    def block(self, x: np.ndarray, c: int) -> np.ndarray:
        return np.searchsorted(self.cuts[c], self.key(x, c), side="right")


def _vectors(column: pa.Array) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)


def _blocks_of(shared):
    """Rows (curve, block) of every vector, to be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curves: Curves = shared.value
        count = np.zeros((len(curves.cuts), curves.blocks), np.int64)
        for batch in batches:
            x = _vectors(batch.column(0))
            for c in range(len(curves.cuts)):
                count[c] += np.bincount(curves.block(x, c), minlength=curves.blocks)
        c, b = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(b, pa.int32()), pa.array(count[c, b])], ["c", "b", "n"])

    return run


def _beside(filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each block, the next block with rows before it and behind it; -1 where there is none."""
    n = len(filled)
    before, behind, last = np.full(n, -1), np.full(n, -1), -1
    for k in range(n):
        before[k] = last
        last = k if filled[k] else last
    last = -1
    for k in range(n - 1, -1, -1):
        behind[k] = last
        last = k if filled[k] else last
    return before, behind


def _deal(shared, parts: np.ndarray):
    """Each candidate to its block of every curve, each query to that block and its neighbours;
    ``parts`` has the tasks of each block, 0 for one without rows."""
    beside = [_beside(p > 0) for p in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curves: Curves = shared.value
        for batch in batches:
            ids, query, vec = batch.column(0), np.array(batch.column(1).to_pylist(), bool), batch.column(2)
            x = _vectors(vec)
            asks = np.flatnonzero(query)
            for c in range(len(curves.cuts)):
                b = curves.block(x, c)
                held = np.flatnonzero(~query)
                rows, blocks, part, side = [held], [b[held]], [ids.to_numpy()[held] % parts[c, b[held]]], [np.zeros(len(held), bool)]
                here = b[asks]
                for near in (beside[c][0][here], here, beside[c][1][here]):
                    ok = near >= 0
                    n = parts[c, near[ok]]
                    rows.append(np.repeat(asks[ok], n))
                    blocks.append(np.repeat(near[ok], n))
                    part.append(np.concatenate([np.arange(k) for k in n]) if len(n) else np.zeros(0, np.int64))
                    side.append(np.ones(int(n.sum()), bool))
                at = pa.array(np.concatenate(rows))
                flat = np.concatenate(blocks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(flat), c), pa.int32()), pa.array(flat, pa.int32()), pa.array(np.concatenate(part), pa.int32()), pa.array(np.concatenate(side)), ids.take(at), vec.take(at)],
                    ["c", "b", "part", "asks", "id", "vec"],
                )

    return run


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances from one vector, summed from the first component to the last."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += (x[:, d] - q[d]) ** 2
    return np.sqrt(total)


def _search(k: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        asks = np.array(rows.column("asks").to_pylist(), bool)
        ids, x = rows.column("id").to_numpy(), _vectors(rows.column("vec"))
        cand, cid = x[~asks], ids[~asks]
        out = ([], [], [])
        norm = (cand**2).sum(1)
        for at in np.flatnonzero(asks) if len(cand) else ():
            rough = norm - 2 * cand @ x[at] + (x[at] ** 2).sum()
            rough[cid == ids[at]] = np.inf
            if len(rough) > k:
                edge = np.partition(rough, k - 1)[k - 1]
                some = np.flatnonzero(rough <= edge + 1e-9 * (1 + abs(edge) + (x[at] ** 2).sum()))
            else:
                some = np.arange(len(rough))
            some = some[cid[some] != ids[at]]
            exact = distances(x[at], cand[some])
            best = np.lexsort((cid[some], exact))[:k]
            out[0].append(np.full(len(best), ids[at]))
            out[1].append(cid[some][best])
            out[2].append(exact[best])
        columns = [np.concatenate(o) if o else np.zeros(0, t) for o, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table(columns, ["query_id", "vec_id", "score"])

    return run


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Columns id and v (array of double), of rows that take part."""
    v = F.col("v")
    out = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).dropna()
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return out.where((F.size(v) > 0) & ~bad & F.exists(v, lambda c: c != 0))


@F.arrow_udf(T.BinaryType())
def _packed(v: pa.Array) -> pa.Array:
    return pa.array([np.asarray(x, np.float64).tobytes() for x in v.to_pylist()], pa.binary())


def nearest(
    vectors: DataFrame,
    is_query: Column | None = None,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = K,
    curves: int = CURVES,
    blocks: int = BLOCKS,
) -> DataFrame:
    """For each query its ``k`` nearest found: query_id, rank (from 1), vec_id, score.

    ``is_query`` is a condition on the id column ``id``; without it, ids divisible by 100 ask.
    Defined cases: vectors that are null, empty, all zero or hold null or non-finite components,
    and rows without an id, take no part; vectors of different lengths have no distance, so each
    length is an index of its own; rows that share the query's id are its own and never its answer,
    of several queries of one id the nearer distance counts; equal distances go to the smaller id;
    with fewer candidates than ``k`` all are given.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    stage = Stage(spark)
    asks = (F.col("id") % 100 == 0) if is_query is None else is_query
    rows = valid_vectors(vectors, id_col, vec_col)
    rows = stage.cut(rows.select("id", asks.alias("asks"), "v"), "valid")
    found = None
    for r in rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():
        some = _nearest_of_length(stage, rows.where(F.size("v") == r["d"]), r["d"], k, curves, blocks)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return empty(spark, "query_id bigint, rank int, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    top = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest_of_length(stage: Stage, rows: DataFrame, length: int, k: int, curves: int, blocks: int) -> DataFrame:
    """What the windows find for queries among vectors of one length, the nearest ``k`` of each window."""
    spark = stage.spark
    # of equal vectors, only the k + 1 least ids can be an answer
    order = Window.partitionBy("v").orderBy("id")
    ranked = rows.dropDuplicates(["id", "v"]).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("id", F.lit(False).alias("asks"), "v")
    index = stage.cut(ranked.select("id", "asks", _packed("v").alias("vec")), f"index{length}")
    queries = rows.where("asks").select("id", "asks", _packed("v").alias("vec"))
    n = max(1, index.count())
    blocks = max(1, min(blocks, n // LEAST))
    # about SAMPLE rows, chosen by a hash of their ids
    sample = index.where(F.pmod(F.xxhash64("id"), F.lit(n)) < SAMPLE).select("vec").collect()
    shared = spark.sparkContext.broadcast(Curves(np.array([np.frombuffer(r["vec"], np.float64) for r in sample]), blocks, curves))
    parts = np.zeros((curves, blocks), np.int64)
    counted = index.select("vec").mapInArrow(_blocks_of(shared), "c int, b int, n bigint").groupBy("c", "b").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # at most curves * blocks rows
        parts[r["c"], r["b"]] = max(1, -(-r["n"] * blocks // (2 * n)))
    # a query is dealt as one only; as a candidate it is a row of the index
    dealt = index.unionByName(queries).mapInArrow(_deal(shared, parts), "c int, b int, part int, asks boolean, id bigint, vec binary")
    return dealt.groupBy("c", "b", "part").applyInArrow(_search(k), "query_id bigint, vec_id bigint, score double")
