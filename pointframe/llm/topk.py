"""Exact search for the highest inner products by a table of distances to pivots.

Vectors of length at most M are lifted onto a sphere, x' = (x, sqrt(M^2 - |x|^2)), and queries are q' = (q, 0), so that
q.x = (|q|^2 + M^2 - |q' - x'|^2) / 2 and the nearest vector has the highest product. The table holds the distance of each
x' to some pivots p'; by the triangle inequality the largest |d(q', p') - d(x', p')| is a lower bound of d(q', x'), hence an
upper bound of the product. Candidates are evaluated in the order of their bounds until no bound left reaches the k-th
product found: what is left cannot enter the result. Bounds are taken with room for rounding, products are exact.

Equal vectors are one candidate with its least ids, so a frequent vector costs one evaluation. Candidates are dealt by
ranges of (nearest pivot, distance) into parts of bounded size, and packed into blocks. The queries of a block are packed
with it and evaluate it first; with the product found there, each goes only to the parts whose intervals of distances it
can't rule out. A part's blocks meet the queries in slices of bounded size. Results never depend on pivots or parts.
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
from pointframe.llm.graph import lookup
from pointframe.llm.vectors import SCALE, matrix, whole_vectors

K = 5
QUERY_IDS = 50  # queries are ids divisible by this
PIVOTS = 24
PIVOT_SAMPLE = 2_000  # distinct vectors that pivots are chosen from; which are taken changes speed only
BLOCK = 1024  # candidates of a block
PART_BYTES = 24 << 20  # of the candidates of a part, about
MOST_PARTS = 4096  # beyond that parts grow
SLICE = 20_000  # queries that meet a part at once, about
FIRST = 32  # candidates that a query evaluates at first
NO_ID = 2**63 - 1  # stands for a null id, after all others
LONG = 2**63 - 1
LOWEST = np.iinfo(np.int64).min

PACKED = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("block", T.LongType()),
        T.StructField("x", T.BinaryType()),  # rows of whole numbers
        T.StructField("dist", T.BinaryType()),  # their distances to the pivots
        T.StructField("ids", T.BinaryType()),
        T.StructField("n_ids", T.BinaryType()),
        T.StructField("low", T.ArrayType(T.DoubleType())),
        T.StructField("high", T.ArrayType(T.DoubleType())),
        T.StructField("q", T.BinaryType()),  # rows of x that are queries
        T.StructField("q_dist", T.BinaryType()),
        T.StructField("q_least", T.BinaryType()),  # the product that a candidate must reach
    ]
)
FOUND = T.StructType([T.StructField("x", T.ArrayType(T.LongType())), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("scores", T.ArrayType(T.LongType())), T.StructField("same", T.LongType())])


@dataclass
class Table:
    """Pivots, the largest squared length of a vector, and how vectors are stored."""

    pivots: np.ndarray  # as doubles
    most: float  # M^2
    d: int
    kind: str  # numpy type that holds each entry
    exact: bool  # products are whole numbers below 2^53 in doubles

    @property
    def row_bytes(self) -> int:
        return self.d * np.dtype(self.kind).itemsize

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - np.einsum("ij,ij->i", x, x), 0.0))

    def distances(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Of each row of x (as doubles), lifted as a candidate or as a query, to each pivot."""
        p = self.pivots
        own = np.zeros(len(x)) if query else self.lifted(x)
        square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", p, p) - 2 * (x @ p.T) + (own[:, None] - self.lifted(p)) ** 2
        return np.sqrt(np.maximum(square, 0.0))

    def bounds(self, square: float, gap: np.ndarray) -> np.ndarray:
        """The most that a product can be where |q|^2 is square and the distance is gap at least, with room for rounding."""
        reach = square + self.most
        return (reach - gap * gap) / 2 + 1e-6 * reach + 1

    def products(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact; what is beyond a long is the largest or smallest long."""
        if self.exact:
            return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
        return np.array([min(max(int(v), -LONG - 1), LONG) for v in x.astype(object) @ q.astype(object)], np.int64)


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, ties to smaller ids."""
    order = np.lexsort((ids, ~scores))[:k]
    return scores[order], ids[order]


class Search:
    """The k best rows (score, id) of one query, over candidates in the order of their bounds."""

    def __init__(self, t: Table, q: np.ndarray, dist: np.ndarray, k: int, least: int = LOWEST):
        self.t, self.q, self.dist, self.k, self.least = t, q, dist, k, least
        f = q.astype(np.float64)
        self.square = float(f @ f)
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def rules_out(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether no candidate with distances from low to high to the pivots, one interval or rows of them, reaches the result."""
        gap = np.maximum(np.maximum(low - self.dist, self.dist - high).max(-1), 0.0)
        return self.t.bounds(self.square, gap) < self.least

    def visit(self, x: np.ndarray, dist: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        """Candidates x with distances by pivot (pivots x candidates); the ids of candidate c are ids[at[c]:at[c + 1]]."""
        gap = np.abs(dist[0] - self.dist[0])
        for row, own in zip(dist[1:], self.dist[1:], strict=True):
            np.maximum(gap, np.abs(row - own), out=gap)
        most = self.t.bounds(self.square, gap)
        open_ = np.flatnonzero(most >= self.least)
        order = open_[np.argsort(-most[open_], kind="stable")]
        done, step = 0, FIRST
        while done < len(order) and most[order[done]] >= self.least:
            now = order[done : done + step]
            self._take(self.t.products(x[now], self.q), now, ids, at)
            done, step = done + step, step * 4

    def _take(self, products: np.ndarray, now: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        reach = np.flatnonzero(products >= self.least)
        if not len(reach):
            return
        products, now = products[reach], now[reach]
        if len(now) > self.k:  # only candidates that can be among the k best by product
            limit = np.partition(products, len(products) - self.k)[len(products) - self.k]
            reach = np.flatnonzero(products >= limit)
            products, now = products[reach], now[reach]
        n = at[now + 1] - at[now]
        rows = np.repeat(at[now] - np.cumsum(n) + n, n) + np.arange(n.sum())
        self.scores, self.ids = best_rows(np.concatenate([self.scores, np.repeat(products, n)]), np.concatenate([self.ids, ids[rows]]), self.k)
        if len(self.scores) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


def candidates(vectors: DataFrame, k: int, is_query) -> DataFrame:
    """(h, x, ids, query): distinct vectors, the k least of their ids, and whether any row of them is a query.

    Before the shuffle each task keeps k rows of a vector, so a frequent vector is not hot; that any row is a query is
    known from the rows of ids that are queries, of which one a vector is kept as well.
    """
    rows = vectors.select(F.xxhash64("x").alias("h"), "x", F.coalesce("vec_id", F.lit(NO_ID)).alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"))
    first = rows.withColumn("_n", F.expr("row_number() OVER (PARTITION BY h, x ORDER BY id)")).filter(F.col("_n") <= k).groupBy("h", "x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = rows.filter("query").select("h", "x").distinct().withColumn("query", F.lit(True))
    return first.join(asked, ["h", "x"], "left").withColumn("query", F.coalesce("query", F.lit(False)))


def choose_pivots(distinct: DataFrame, d: int, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Vectors of a bounded sample by hash, each the farthest from those chosen before."""
    rows = distinct.select("h", "x").orderBy("h").limit(sample).toArrow()
    x = matrix(rows.column("x").combine_chunks(), d).astype(np.float64)
    far, out = np.full(len(x), np.inf), []
    at = 0
    for _ in range(min(pivots, len(x))):
        out.append(x[at])
        far = np.minimum(far, ((x - x[at]) ** 2).sum(1))
        at = int(far.argmax())
    return np.array(out)


def pack(distinct: DataFrame, t: Table, k: int, parts: int) -> DataFrame:
    """The candidates as blocks, near ones together, with the queries among them and what those reach in their own block."""
    shared = distinct.sparkSession.sparkContext.broadcast(t)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dist = shared.value.distances(matrix(b.column("x"), t.d).astype(np.float64))
            near = dist.argmin(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near), pa.array(dist[np.arange(len(dist)), near])], names=[*b.schema.names, "near", "away"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, part, seq = shared.value, TaskContext.get().partitionId(), 0
        for b in batches:
            for s in (b.slice(i, BLOCK) for i in range(0, b.num_rows, BLOCK)):
                x = matrix(s.column("x"), m.d)
                f = x.astype(np.float64)
                dist, lists = m.distances(f), s.column("ids")
                ids, n_ids = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
                at = np.concatenate([[0], np.cumsum(n_ids)])
                asked = np.flatnonzero(s.column("query").to_numpy(zero_copy_only=False))
                q_dist, least = m.distances(f[asked], query=True), []
                for q, own in zip(x[asked], q_dist, strict=True):
                    search = Search(m, q, own, k)
                    search.visit(x, dist.T, ids, at)
                    least.append(search.least)
                stored = x.astype(m.kind)
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "part": part, "block": (part << 32) + seq, "x": stored.tobytes(), "dist": dist.T.tobytes(), "ids": ids.tobytes(), "n_ids": n_ids.astype(np.int32).tobytes(),
                            "low": dist.min(0).tolist(), "high": dist.max(0).tolist(), "q": stored[asked].tobytes(), "q_dist": q_dist.tobytes(), "q_least": np.array(least, np.int64).tobytes(),
                        }
                    ],
                    schema=ARROW,
                )
                seq += 1

    placed = distinct.mapInArrow(place, T.StructType([*distinct.schema.fields, T.StructField("near", T.IntegerType()), T.StructField("away", T.DoubleType())]))
    return cut(placed.repartitionByRange(parts, "near", "away", "h").sortWithinPartitions("near", "away", "h").mapInArrow(blocks, PACKED))


ARROW = pa.schema(
    [("part", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("x", "dist", "ids", "n_ids")), *((c, pa.list_(pa.float64())) for c in ("low", "high")), *((c, pa.binary()) for c in ("q", "q_dist", "q_least"))]
)


def _asked(m: Table, row: dict, k: int) -> list[Search]:
    """The queries of a packed row, to be searched anew from what they reached in their own block."""
    q = np.frombuffer(row["q"], m.kind).reshape(-1, m.d)
    dist = np.frombuffer(row["q_dist"]).reshape(len(q), -1)
    return [Search(m, x, own, k, int(least)) for x, own, least in zip(q, dist, np.frombuffer(row["q_least"], np.int64), strict=True)]


def search_parts(packed: DataFrame, t: Table, k: int) -> DataFrame:
    """(x, ids, scores): for each query vector and each part that it can't rule out, the k best rows there."""
    spark = packed.sparkSession
    ends = packed.select("part", F.posexplode(F.arrays_zip("low", "high")).alias("p", "e")).groupBy("part", "p").agg(F.min("e.low").alias("low"), F.max("e.high").alias("high")).collect()
    parts = sorted({r["part"] for r in ends})  # at most MOST_PARTS of a few pivots each
    low, high = (np.zeros((len(parts), len(t.pivots))) for _ in range(2))
    where = {p: i for i, p in enumerate(parts)}
    for r in ends:
        low[where[r["part"]], r["p"]], high[where[r["part"]], r["p"]] = r["low"], r["high"]
    shared = spark.sparkContext.broadcast((t, parts, low, high))
    asking = packed.filter(F.length("q") > 0)
    bytes_asked = asking.agg(F.sum(F.length("q"))).first()[0] or 0
    slices = max(1, -(-bytes_asked // (t.row_bytes * SLICE)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, names, lo, hi = shared.value
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                need = np.zeros(len(names), bool)
                for s in _asked(m, row, k):
                    need |= ~s.rules_out(lo, hi)
                visits = [names[j] for j in np.flatnonzero(need)]
                yield pa.RecordBatch.from_arrays([pa.array(visits, pa.int32()), *(pa.array([row[c]] * len(visits), b.schema.field(c).type) for c in b.schema.names)], names=["to", *b.schema.names])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        m = shared.value[0]
        out: tuple[list, ...] = ([], [], [], [])
        if left.num_rows and right.num_rows:
            held = []
            for r in left.to_pylist():
                x = np.frombuffer(r["x"], m.kind).reshape(-1, m.d)
                at = np.concatenate([[0], np.cumsum(np.frombuffer(r["n_ids"], np.int32))])
                held.append((r["block"], x, np.frombuffer(r["dist"]).reshape(-1, len(x)), np.frombuffer(r["ids"], np.int64), at, np.array(r["low"]), np.array(r["high"])))
            for row in right.to_pylist():
                for s in _asked(m, row, k):
                    # The block whose middle is nearest comes first.
                    for _, x, dist, ids, at, lo, hi in sorted(held, key=lambda h: (float(np.abs(s.dist - (h[5] + h[6]) / 2).max()), h[0])):
                        if not s.rules_out(lo, hi):
                            s.visit(x, dist, ids, at)
                    if len(s.ids):
                        for o, v in zip(out, (s.q.astype(np.int64), s.ids, s.scores, int(m.products(s.q[None], s.q)[0])), strict=True):
                            o.append(v)
        return pa.table({n: pa.array(o, pa.int64() if n == "same" else pa.list_(pa.int64())) for n, o in zip(FOUND.names, out, strict=True)})

    blocks = packed.select("part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "block", "x", "dist", "ids", "n_ids", "low", "high")
    queries = asking.select("block", "q", "q_dist", "q_least").mapInArrow(route, "to int, block long, q binary, q_dist binary, q_least binary")
    queries = queries.select(F.col("to").alias("part"), F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int").alias("slice"), "q", "q_dist", "q_least")
    return blocks.groupBy("part", "slice").cogroup(queries.groupBy("part", "slice")).applyInArrow(meet, FOUND)


def nearest(vectors: DataFrame, d: int, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest products of each query row of vectors (vec_id, x) with all other rows.

    Ties go to smaller ids, null ids last. Rows of the same vector are rows of their own, as are repeated rows; a query
    leaves out one row of its own id and vector. Fewer than k other rows give fewer; no other row or no query gives none.
    """
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score long"
    if not d:
        return spark.createDataFrame([], out)
    each = k + 1  # its own row is among them
    distinct = cut(candidates(vectors, each, is_query))
    f = F.transform("x", lambda c: c.cast("double"))
    size = distinct.agg(F.count("*").alias("n"), F.max(F.aggregate(f, F.lit(0.0), lambda a, c: a + c * c)).alias("most"), F.max(F.array_max(F.transform(f, F.abs))).alias("entry")).first()
    kind = next(t for t, top in (("int16", 2.0**15), ("int32", 2.0**31), ("int64", np.inf)) if size["entry"] < top)
    # Pairs of integers up to the largest entry, d of them, in any order of summing.
    t = Table(choose_pivots(distinct, d), size["most"], d, kind, d * size["entry"] ** 2 < 2**53)
    parts = min(MOST_PARTS, max(-(-size["n"] * (t.row_bytes + 8 * PIVOTS) // PART_BYTES), 2 * spark.sparkContext.defaultParallelism))
    found = search_parts(pack(distinct, t, each, parts), t, each)
    zipped = found.select("x", "same", F.explode(F.arrays_zip("ids", "scores")).alias("r"))
    # ~score falls as the score rises, for every long.
    rows = zipped.select(F.xxhash64("x").alias("h"), "x", "same", F.struct(F.bitwise_not("r.scores").alias("down"), F.col("r.ids").alias("id"), F.col("r.scores").alias("score")).alias("r"))
    # A query vector has k + 1 rows of a part at most, and parts are bounded in number.
    tops = rows.groupBy("h", "x").agg(F.slice(F.sort_array(F.collect_list("r")), 1, each).alias("tops"), F.first("same").alias("same"))
    asking = vectors.filter(F.coalesce(is_query, F.lit(False))).select("vec_id", F.struct(F.xxhash64("x").alias("h"), "x").alias("key"))
    met = lookup(asking, tops.select(F.struct("h", "x").alias("key"), "tops", "same"), "key", "vec_id")
    own = F.array_position(F.transform("tops", lambda r: (r["id"] == F.col("vec_id")) & (r["score"] == F.col("same"))), True)  # 0 where it isn't among them
    others = F.filter("tops", lambda r, i: i + 1 != own)
    return (
        met.select("vec_id", F.slice(others, 1, k).alias("others"))
        .select(F.col("vec_id").alias("query_id"), F.posexplode("others").alias("at", "r"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.nullif(F.col("r.id"), F.lit(NO_ID)).alias("vec_id"), F.col("r.score").alias("score"))
    )


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest products of each row of embeddings whose id is divisible by 50; which rows take part: whole_vectors()."""
    vectors, d = whole_vectors(table(spark, sf_dir, "embeddings"))
    return nearest(vectors, d, F.col("vec_id") % QUERY_IDS == 0)


OP13_SQL = f"""
WITH sound AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT q.row AS q_row, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM sound q JOIN sound c ON c.row <> q.row AND len(c.x) = len(q.x) WHERE q.vec_id % {QUERY_IDS} = 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY q_row ORDER BY score DESC, vec_id NULLS LAST) AS n FROM scored
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM numbered WHERE n <= {K}
"""
