"""Whitening of embeddings by a tiled covariance.

The rows that are fitted, distinct vectors, are cut into row blocks, and each row block into column blocks of a bounded
number of dimensions, centred. Column blocks are shuffled by their row block, so that those of one row block meet; each
pair (i, j), i <= j, of them is multiplied, and the products are summed by the tile (i, j), inside of tasks first. The
assembled matrix of d x d numbers, which doesn't grow with the rows, is decomposed on the driver. No task holds more than a
row block and the tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointframe.llm.common import cut, table
from pointframe.llm.vectors import matrix, whole_vectors

COMPONENTS = 4
BLOCK_BYTES = 1 << 20  # of a column block, about
LEAST_TILE, TILES = 32, 8  # dimensions of a tile at least; column blocks at most
RANK = 1e-12  # an eigenvalue at most this share of the largest is none
LONG = 2**63

SUMS = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("high", T.LongType()), T.StructField("low", T.LongType())])
BLOCK = T.StructType([T.StructField("row_block", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("data", T.BinaryType())])
TILE = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("data", T.BinaryType())])


def dimension_sums(fit: DataFrame, d: int) -> list[int]:
    """The sum of each dimension of x, exact: halves of 32 bits are summed apart, so that no sum of a task leaves a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)
        for b in batches:
            x = matrix(b.column("x"), d)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(high), pa.array(low)], names=SUMS.names)

    wide = {c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")}
    rows = fit.mapInArrow(run, SUMS).groupBy("dim").agg(*wide.values()).collect()
    return [(int(r["high"]) << 32) + int(r["low"]) for r in sorted(rows, key=lambda r: r["dim"])]


def column_blocks(fit: DataFrame, mean: np.ndarray, tile: int) -> DataFrame:
    """(row_block, k, n, data): n centred rows of the dimensions k * tile and on, as doubles.

    fit is a written table: a task that runs again cuts the same rows into the same blocks.
    """
    d = len(mean)
    rows = max(1, BLOCK_BYTES // (8 * tile))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, b.num_rows, rows):
                y = matrix(b.column("x").slice(at, rows), d) - mean
                parts = [np.ascontiguousarray(y[:, k : k + tile]).tobytes() for k in range(0, d, tile)]
                k = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([block] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array([len(y)] * k, pa.int32()), pa.array(parts, pa.binary())], names=BLOCK.names)
                block += 1

    return fit.mapInArrow(run, BLOCK)


def _emit(tiles: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (i, j), m in tiles.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=TILE.names)


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The product of each pair of column blocks, summed by tile within the task."""
    tiles: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for i, j, n, left, right in zip(*(b.column(c) for c in ("i", "j", "n", "left", "right")), strict=True):
            pair = i.as_py(), j.as_py()
            p = np.frombuffer(left.as_buffer()).reshape(n.as_py(), -1).T @ np.frombuffer(right.as_buffer()).reshape(n.as_py(), -1)
            tiles[pair] = tiles[pair] + p if pair in tiles else p
    yield from _emit(tiles)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tiles: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for i, j, data in zip(*(b.column(c) for c in TILE.names), strict=True):
            pair, p = (i.as_py(), j.as_py()), np.frombuffer(data.as_buffer())
            tiles[pair] = tiles[pair] + p if pair in tiles else p.copy()
    yield from _emit(tiles)


def covariance(fit: DataFrame, mean: np.ndarray, n: int) -> np.ndarray:
    """The covariance of the rows of fit, divisor n."""
    d = len(mean)
    tile = max(LEAST_TILE, -(-d // TILES))
    blocks = column_blocks(fit, mean, tile)
    left = blocks.select("row_block", "n", F.col("k").alias("i"), F.col("data").alias("left"))
    right = blocks.select("row_block", F.col("k").alias("j"), F.col("data").alias("right"))
    pairs = left.hint("merge").join(right, "row_block").filter("i <= j").select("i", "j", "n", "left", "right")
    out = np.zeros((d, d))
    for r in pairs.mapInArrow(_multiply, TILE).repartition("i", "j").mapInArrow(_add, TILE).collect():
        a, b = r["i"] * tile, r["j"] * tile
        m = np.frombuffer(r["data"]).reshape(min(tile, d - a), min(tile, d - b))
        out[a : a + tile, b : b + tile] = m
        out[b : b + tile, a : a + tile] = m.T
    return out / n


@dataclass
class Whitening:
    """What whitens a vector: n and exact sums of the fitted rows, unit eigenvectors as columns by falling eigenvalue, the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def sound(self) -> np.ndarray:
        """The components that vary."""
        return (self.values > 0) & (self.values > RANK * self.values.max(initial=0.0))

    def project(self, x: np.ndarray) -> np.ndarray:
        """(x - mean) on each component over the root of its eigenvalue; nan where nothing varies."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.sound, ((x - self.mean) @ self.vectors) / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - S)^2, exact; none where it is beyond a long."""
        top = self.n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + max(map(abs, self.sums))
        kind = np.int64 if len(self.sums) * top * top < LONG else object
        y = x.astype(kind) * self.n - np.array(self.sums, kind)
        return [int(v) if v < LONG else None for v in (y * y).sum(1)]


def fit_whitening(vectors: DataFrame, d: int, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """(the whitening of the distinct x of vectors, the distinct x); copies are dropped before the shuffle, so none is hot."""
    fit = cut(vectors.select("x").distinct())
    n = fit.count()
    if not n:
        return None, fit
    sums = dimension_sums(fit, d)
    v = covariance(fit, np.array([s / n for s in sums]), n)
    values, vecs = np.linalg.eigh(v)
    best = np.argsort(-values, kind="stable")[:components]
    u = vecs[:, best]
    u = u * np.where(u[np.abs(u).argmax(0), range(len(best))] < 0, -1.0, 1.0)  # the largest entry is positive
    return Whitening(n, sums, u, np.maximum(values[best], 0.0), float(np.trace(v))), fit


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of (covariance of the whitened rows - identity), over the components that vary."""
    k = int(model.sound.sum())
    if not k:
        return 0.0
    shared = fit.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            w = np.insert(m.project(matrix(b.column("x"), len(m.sums)))[:, m.sound], k, 1.0, axis=1)
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["at", "v"])

    total = np.zeros((k + 1) ** 2)
    for r in fit.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        total[r["at"]] = r["v"]
    total = total.reshape(k + 1, k + 1) / model.n
    mean = total[:k, k]
    return float(np.abs(total[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


WHITE = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened) of each row (vec_id, x); null entries of whitened where a component doesn't vary."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # d x components numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            x = matrix(b.column("x"), len(m.sums))
            w = m.project(x)
            flat = pa.array(w.ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(m.deviations(x), pa.int64()), lists], names=WHITE.names)

    return vectors.select("vec_id", "x").mapInArrow(run, WHITE)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sound row of embeddings on the first components of the covariance of the distinct vectors.

    Which rows take part: whole_vectors(). With fewer dimensions than components there are as many rows as dimensions. A
    component of eigenvalue 0 (one vector, or vectors in a plane) has whitened null and no part in identity_error;
    explained is null where nothing varies. A deviation beyond a long is null.
    """
    vectors, d = whole_vectors(table(spark, sf_dir, "embeddings"))
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model, fit = fit_whitening(vectors, d)
    if model is None:
        return spark.createDataFrame([], out)
    error = identity_error(fit, model)
    explained = [float(v) / model.trace if model.trace > 0 else None for v in model.values]
    each = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    share = F.array(*(F.lit(e).cast("double") for e in explained))
    return each.select("vec_id", (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"))
