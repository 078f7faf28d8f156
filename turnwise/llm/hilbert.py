"""Approximate nearest neighbours by several shifted Hilbert orderings.

Vectors are turned by fixed random rotations; each group of `dims` coordinates gives one ordering:
coordinates become ranks on a grid by their quantiles (from a bounded sample), shifted by a
random offset, and the cell's place on the Hilbert curve is the key. Each ordering is cut into
windows of an equal share of the rows, also from the sample. A query meets the rows of its own
window and of the neighbouring ones; what all orderings find is merged and ranked by the exact inner
product of the original vectors.

A window is a share of the rows, not a number, so recall is the same at every size; rows of a
window are dealt into blocks, and what a block finds for its queries is cut to the best k
before the merge.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.anchors import mixed


@dataclass(frozen=True)
class CurveSettings:
    """`sample_rows` bounds what grids and windows are fitted on."""

    rotations: int = 4
    dims: int = 16
    bits: int = 2
    windows: int = 32
    reach: int = 1
    block_rows: int = 20_000
    sample_rows: int = 20_000
    seed: int = 7


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, d) with `bits` bits a coordinate."""
    x = cells.T.astype(np.int64).copy()
    d = len(x)
    # undo the turns of the sub-cubes, from the largest down
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(d):
            inside = (x[i] & level) > 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(inside, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap if i else 0
        level >>= 1
    # Gray code over the coordinates
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn = np.where(x[-1] & level, turn ^ (level - 1), turn)
        level >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | x[i] >> b & 1
    return key


class Curves:
    """Orderings fitted on a sample: rotation, quantiles of the grid, shift and window edges of each."""

    def __init__(self, sample: np.ndarray, s: CurveSettings):
        self.s, rng = s, np.random.default_rng(s.seed)
        width = sample.shape[1]
        s_dims = min(s.dims, width)
        self.frames = []
        for _ in range(s.rotations):
            turn, _ = np.linalg.qr(rng.standard_normal((width, width)))
            self.frames += [turn[:, a : a + s_dims] for a in range(0, width - s_dims + 1, s_dims)]
        self.grids, self.shifts, self.edges = [], [], []
        levels = 1 << s.bits
        for frame in self.frames:
            got = sample @ frame
            self.grids.append(np.quantile(got, np.arange(1, levels) / levels, axis=0))
            self.shifts.append(rng.integers(0, levels, s_dims))
            keys = self._keys(len(self.grids) - 1, sample)
            self.edges.append(np.quantile(keys, np.arange(1, s.windows) / s.windows))

    def _keys(self, k: int, vectors: np.ndarray) -> np.ndarray:
        got, levels = vectors @ self.frames[k], 1 << self.s.bits
        cells = np.stack([np.searchsorted(self.grids[k][:, i], got[:, i]) for i in range(got.shape[1])], 1)
        return hilbert_keys((cells + self.shifts[k]) % (2 * levels), self.s.bits + 1)

    def windows(self, vectors: np.ndarray) -> np.ndarray:
        """(n, orderings): the window of each vector."""
        return np.stack([np.searchsorted(e, self._keys(k, vectors), side="right") for k, e in enumerate(self.edges)], 1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def search(
    df: DataFrame, is_query: Column, k: int = 20, settings: CurveSettings = CurveSettings(), id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), id and score of the k rows found with the largest inner product, ties to the smaller id.

    `is_query` picks the queries; candidates are all rows but those with the query's own id. Null, zero and
    non-finite vectors take no part; all others must have one length (others raise). A repeated
    row is a candidate once. Queries with fewer than k candidates return them all; an empty table
    gives none; other columns are ignored. Index grids are fitted on at most `sample_rows` rows, and
    every row is indexed.
    """
    s = settings
    kind = df.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    vector = F.col(vector_col).cast(kind)
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(s.sample_rows).select("v").toArrow()
    empty = df.sparkSession.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score double")
    if not picked.num_rows:
        return empty
    sample = _matrix(picked.column("v").combine_chunks())
    total = rows.count()
    s = replace(s, windows=min(s.windows, max(1, total // (4 * k))))  # a window has room for several times k
    curves = Curves(sample, s)
    blocks = max(1, -(-total // (s.windows * s.block_rows)))
    n_curves = len(curves.frames)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids = part.column("id").to_numpy(zero_copy_only=False)
                query = part.column("q").to_numpy(zero_copy_only=False)
                window = curves.windows(_matrix(part.column("v")))
                # every row once for each ordering, queries also to the windows beside theirs, and to all blocks
                n = len(ids)
                row = np.tile(np.arange(n), n_curves)
                curve = np.repeat(np.arange(n_curves), n)
                cell = [(row, curve, window.T.reshape(-1), (mixed(ids[row].view(np.uint64)) % np.uint64(blocks)).astype(np.int64), np.zeros(len(row), bool))]
                asked = np.flatnonzero(query[row])
                for step in range(-s.reach, s.reach + 1):
                    w = window.T.reshape(-1)[asked] + step
                    ok = (w >= 0) & (w < s.windows)
                    for b in range(blocks):
                        cell.append((row[asked][ok], curve[asked][ok], w[ok], np.full(ok.sum(), b), np.ones(ok.sum(), bool)))
                row, curve, w, block, q = (np.concatenate(x) for x in zip(*cell, strict=True))
                out = pa.RecordBatch.from_arrays([pa.array(((curve * s.windows + w) * blocks + block).astype(np.int64)), pa.array(q)], ["cell", "q"])
                rows_of = part.select(["id", "v"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*out.columns, *rows_of.columns], ["cell", "q", "id", "v"])

    def best(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        query = table.column("q").to_numpy()
        ids = table.column("id").to_numpy()
        none = {"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        asked, rest = np.flatnonzero(query), np.flatnonzero(~query)
        if not len(asked) or not len(rest):
            return pa.table(none)
        vectors = _matrix(table.column("v").chunk(0))
        _, first = np.unique(ids[rest], return_index=True)
        rest = rest[first]
        out = []
        for some in np.array_split(asked, -(-len(asked) * len(rest) // 2_000_000)):
            scores = np.round(vectors[some] @ vectors[rest].T, 12)
            scores[ids[some][:, None] == ids[rest][None, :]] = -np.inf
            keep = min(k, len(rest))
            cut = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1 : keep]
            more = scores > cut
            tied = (scores == cut) & (scores > -np.inf)
            i, j = np.nonzero(more | tied & (np.cumsum(tied, axis=1) <= keep - more.sum(1, keepdims=True)))
            out.append((ids[some][i], ids[rest][j], np.einsum("ij,ij->i", vectors[some[i]], vectors[rest[j]])))
        q, c, x = (np.concatenate(v) for v in zip(*out, strict=True))
        return pa.table({"query_id": q, "id": c, "score": x})

    kinds = "query_id bigint, id bigint, score double"
    found = rows.mapInArrow(dealt, f"cell bigint, q boolean, id bigint, v {kind}").groupBy("cell").applyInArrow(best, kinds)
    pairs = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
