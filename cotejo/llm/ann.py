"""Exact nearest neighbours by a block matrix join with int8 tiles.

Vectors are scaled to unit length and quantised to int8 with one scale per vector. A tile
is the product of a block of queries and a block of candidates; its entries are exact
integers, so for unit vectors x = x' + e and y = y' + f (x', y' dequantised) the cosine
differs from the tile's by at most |e| + |x'| |f|. Per query a tile keeps the candidates
whose upper bound reaches the k-th largest lower bound; they are computed again in double
precision from the original vectors, and heaps merge the tiles: first the tiles of one
task, then the few rows of each query.

Blocks of queries and of candidates are single rows, joined on a grid: a cell has one query
block and a group of ``GROUP`` candidate blocks. So a row of work is a tile, no pair of
vectors is ever a row, and a cell's size does not depend on the input. This is a stated
query set against all rows: the work grows with queries times candidates.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; fewer candidates than k give fewer rows; ties go to
the smaller id; equal vectors have equal scores; vectors whose squares leave the range of
doubles are scaled by a power of two, which changes no cosine; no vectors give no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.llm.common import cut_lineage

#: Vectors in a block of queries, of candidates, and queries of a tile (32 MB of doubles).
QUERIES, BLOCK, TILE = 8192, 4096, 1024
#: Candidate blocks in a cell of the grid.
GROUP = 4
_PACKED = "block bigint, ids binary, vectors binary"


def _pack_blocks(size: int, kind: str):
    """Valid vectors as blocks: ids (int64) and vectors (numpy type ``kind``), row by row."""

    def run(batches):
        part, k, held = TaskContext.get().partitionId(), 0, []

        def block():
            ids = np.concatenate([i for i, _ in held]).tobytes()
            flat = np.concatenate([v for _, v in held]).tobytes()
            cols = [pa.array([part << 32 | k]), pa.array([ids], pa.binary()), pa.array([flat], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["block", "ids", "vectors"])

        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                room = size - sum(len(i) for i, _ in held)
                ids = batch.column(0).slice(lo, room).to_numpy(zero_copy_only=False).astype(np.int64)
                held.append((ids, batch.column(1).slice(lo, room).flatten().to_numpy(zero_copy_only=False).astype(kind)))
                lo += room
                if len(ids) == room:
                    yield block()
                    k, held = k + 1, []
        if held:
            yield block()

    return run


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as floats for the product), scales, lengths of the dequantised vectors, error lengths."""
    top = np.abs(x).max(axis=1, keepdims=True)
    unit = x / top
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    code = np.rint(unit / scale).astype(np.int8)
    back = code * scale
    # entries of a product are below 2**24 up to 1040 components, so floats are exact
    wide = np.float32 if x.shape[1] <= 1040 else np.float64
    return code.astype(wide), scale[:, 0], np.sqrt((back * back).sum(axis=1)), np.sqrt(((unit - back) ** 2).sum(axis=1))


def _in_range(x: np.ndarray) -> np.ndarray:
    """Rows whose squares would leave the range of doubles, times a power of two; the others as they are."""
    top = np.abs(x).max(axis=1)
    far = (top > 1e140) | (top < 1e-140)
    if far.any():
        x = x.copy()
        x[far] = np.ldexp(x[far], -np.frexp(top[far])[1][:, None])
    return x


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the same row of y, row by row alike wherever a row stands."""
    x, y = _in_range(x), _in_range(y)
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def tile_nearest(qi, q, ci, c, coded, k: int) -> list[tuple[int, list[tuple[float, int]]]]:
    """For each query of a tile, its up to k nearest candidates as (score, -id)."""
    qc, qs, ql, qe = quantise(q)
    cc, cs, ce = coded
    about = (qc @ cc.T).astype(np.float64) * qs[:, None] * cs[None, :]
    error = qe[:, None] + ql[:, None] * ce[None, :] + 1e-12
    own = qi[:, None] == ci[None, :]
    low = np.where(own, -np.inf, about - error)
    at = min(k, low.shape[1])
    limit = np.partition(low, low.shape[1] - at, axis=1)[:, low.shape[1] - at]
    rows, cols = np.nonzero((about + error >= limit[:, None]) & ~own)
    bounds = np.searchsorted(rows, np.arange(len(qi) + 1))
    out = []
    for i in range(len(qi)):
        near = cols[bounds[i] : bounds[i + 1]]
        best: list[tuple[float, int]] = []
        for lo in range(0, len(near), 4096):
            part = near[lo : lo + 4096]
            score = cosines(np.broadcast_to(q[i], (len(part), q.shape[1])), c[part])
            best = heapq.nlargest(k, best + list(zip(score.tolist(), (-ci[part]).tolist())))
        out.append((int(qi[i]), best))
    return out


def _search(k: int, kind: str):
    def run(batches):
        heaps: dict[int, list[tuple[float, int]]] = {}

        def rows():
            flat = [(i, -v, s) for i, best in heaps.items() for s, v in best]
            heaps.clear()
            cols = list(zip(*flat)) if flat else [(), (), ()]
            types = (pa.int64(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(4)]
            for a, b, c, d in zip(*cols):
                qi, ci = np.frombuffer(a, np.int64), np.frombuffer(c, np.int64)
                q, v = (np.frombuffer(x, kind).reshape(n, -1).astype(np.float64) for x, n in ((b, len(qi)), (d, len(ci))))
                codes, scales, _, errors = quantise(v)
                for lo in range(0, len(qi), TILE):
                    for i, best in tile_nearest(qi[lo : lo + TILE], q[lo : lo + TILE], ci, v, (codes, scales, errors), k):
                        heaps[i] = heapq.nlargest(k, heaps.get(i, []) + best)
                if len(heaps) > 8 * QUERIES:
                    yield rows()
        yield rows()

    return run


def nearest(vectors: DataFrame, queries, k: int = 5, id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query's k nearest other rows.

    ``queries`` is a condition on the columns ``id`` and ``v`` that marks the query rows.
    Of valid rows that repeat an id only the one of the smallest vector takes part, so that no
    id is its own neighbour or found twice.
    """
    v = F.col("v")
    kept, kind = ("array<float>", "<f4") if dict(vectors.dtypes)[vector] == "array<float>" else ("array<double>", "<f8")
    clean = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast(kept).alias("v")).filter(
        F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    lengths = clean.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    clean = clean.filter(F.size(v) == (lengths[0]["n"] if lengths else 0))
    repeated = cut_lineage(clean.groupBy("id").count().filter("count > 1").select("id"))  # only ids are shuffled
    if not repeated.isEmpty():
        one = clean.join(repeated, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))
        clean = clean.join(repeated, "id", "left_anti").select("id", "v").unionByName(one)
    candidates = cut_lineage(clean.mapInArrow(_pack_blocks(block, kind), _PACKED))
    asked = clean.filter(queries)
    parts = math.ceil(asked.count() / QUERIES) or 1
    asked = asked.repartition(parts).mapInArrow(_pack_blocks(1 << 31, kind), _PACKED)  # a block per partition
    groups = math.ceil(candidates.count() / GROUP) or 1

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asked = asked.select(F.shiftright("block", 32).cast("int").alias("i"), all_of(groups).alias("j"), F.col("ids").alias("qi"), F.col("vectors").alias("qv"))
    candidates = candidates.select(
        all_of(parts).alias("i"), F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("j"), F.col("ids").alias("ci"), F.col("vectors").alias("cv")
    )
    tiles = candidates.join(asked.hint("shuffle_hash"), ["i", "j"]).select("qi", "qv", "ci", "cv")
    found = tiles.mapInArrow(_search(k, kind), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
