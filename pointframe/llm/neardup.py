"""Near-duplicate classes by DartMinHash over weighted word shingles.

A text is the weighted set of its shingles of WORDS words (weight: how often a shingle occurs). Darts are thrown into the
plane of weight x rank of every element, at places that hashes of the element fix; those below the element's weight
and below a rank that gives about COORDS * (ln COORDS + 4) darts in all are kept, each falls to one of COORDS
coordinates, and a coordinate keeps its dart of least rank. Two sets agree in a coordinate with the probability of
their weighted Jaccard similarity, at a cost that follows elements plus darts rather than elements times coordinates.

Signatures are cut into bands of ROWS coordinates. Texts that share a band form a bucket, inside of which links are found
by exact similarities (see buckets). Exact copies are one node throughout.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointframe.llm.buckets import link_buckets, linked
from pointframe.llm.common import append_columns, claim, cut, read_documents
from pointframe.llm.graph import lookup

WORDS = 5
SIMILARITY = 0.8
ROWS, BANDS = 6, 40  # a pair of similarity 0.8 shares no band once in 190,000 times, one of 0.5 shares one in 0.47 of all cases
COORDS = ROWS * BANDS
BROADCAST_IDS = 500_000  # ids up to which the wanted documents are found by a broadcast

_WORD = re.compile(r"\w+")
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(np.float64) / float(1 << 53)


class _Hashes(dict):
    """64-bit hashes of words, kept by each worker."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


_hashes = _Hashes()


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, weights) of the distinct shingles of a text; a text of fewer than WORDS words is one shingle, one of none has none."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):  # the words' hashes are even over 64 bits, so a polynomial of them is
        h = h * _STEP + w[k : k + len(h)]
    h, c = np.unique(_mix(h), return_counts=True)
    return h, c.astype(np.float64)


_poisson: dict[int, np.ndarray] = {}


def _darts_in(mean: int) -> np.ndarray:
    """Cumulative Poisson probabilities."""
    if mean not in _poisson:
        k = np.arange(0, mean + int(12 * math.sqrt(mean)) + 12)
        _poisson[mean] = np.cumsum(np.exp(k * math.log(mean) - mean - np.array([math.lgamma(x + 1) for x in k])))
    return _poisson[mean]


def signature(h: np.ndarray, w: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """The dart that each coordinate keeps, for a non-empty weighted set.

    The plane is cut into regions: weights [2^v - 1, 2^(v+1) - 1) by ranks [(2^r - 1) / 2^v, (2^(r+1) - 1) / 2^v), each
    with a Poisson number of darts of mean 2^r. All darts of rank below a bound are kept; if a coordinate gets none, the
    bound is doubled, which changes none of the darts of least rank that were found.
    """
    bound = coords * (math.log(coords) + 4) / float(w.sum())
    top = float(w.max())
    while True:
        darts, ranks = [], []
        v = 0
        while (1 << v) - 1 < top:
            some = np.flatnonzero(w > (1 << v) - 1) if v else slice(None)
            hv, wv = h[some], w[some]
            regions = range(next(r for r in range(64) if ((1 << r) - 1) / (1 << v) >= bound))
            seed = _mix(hv + np.array([((v << 8 | r) + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF for r in regions], np.uint64)[:, None])
            even = _unit(seed)
            count = np.concatenate([np.searchsorted(_darts_in(1 << r), even[r], "right") for r in regions])
            at = np.repeat(np.arange(len(count)), count)
            j = np.arange(1, len(at) + 1) - np.repeat(np.cumsum(count) - count, count)
            dart = _mix(seed.ravel()[at] + j.astype(np.uint64) * _U(0xA0761D6478BD642F))
            width = np.repeat([float(1 << r) for r in regions], len(hv))[at]
            rank = (width - 1 + width * _unit(_mix(dart + _U(0x8EBC6AF09C88C6E3)))) / (1 << v)
            keep = rank < bound
            if v:  # an element's weight reaches over all of the first region
                keep &= (1 << v) * (1 + _unit(_mix(dart + _U(0xE7037ED1A0B428DB)))) - 1 < np.tile(wv, len(regions))[at]
            darts.append(dart[keep])
            ranks.append(rank[keep])
            v += 1
        dart, rank = np.concatenate(darts), np.concatenate(ranks)
        order = np.argsort(-rank)
        out, hit = np.zeros(coords, np.uint64), np.zeros(coords, bool)
        place = (dart[order] % _U(coords)).astype(np.int64)
        out[place], hit[place] = dart[order], True  # the last one written has the least rank
        if hit.all():
            return out
        bound *= 2


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each band."""
    rows, out = sig.reshape(BANDS, ROWS), np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = out * _STEP + rows[:, k]
    return _mix(out).view(np.int64)


def occurrences(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The set of (shingle, k-th occurrence) as sorted 32-bit hashes: its Jaccard similarity is the weighted one of the shingles."""
    at = np.repeat(np.arange(len(h)), w.astype(np.int64))
    k = np.arange(len(at)) - np.repeat(np.cumsum(w).astype(np.int64) - w.astype(np.int64), w.astype(np.int64))
    return np.unique((_mix(h[at] + k.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)) >> _U(32)).astype(np.uint32))


def similarity(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


Name = Callable[[str], tuple[int, int]]


def name_of(text: str) -> tuple[int, int]:
    """Two 64-bit halves of a hash of a whole text: its node, and what tells texts of one node apart."""
    a, b = struct.unpack("<qq", hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
    return a, b


_NAMES = [T.StructField("node", T.LongType()), T.StructField("half", T.LongType())]


def _names(texts: list[str], name: Name) -> list[pa.Array]:
    return [pa.array(x, pa.int64()) for x in (zip(*map(name, texts), strict=True))]


def with_signatures(docs: DataFrame, text_col: str = "text", name: Name = name_of) -> DataFrame:
    """docs with node, half (see name_of), bands and size; a null text counts as empty, one without words has no bands."""

    def make():
        claim("neardup", _hashes.clear)

        def fn(texts: list[str]) -> list[pa.Array]:
            band, size = [], []
            for t in texts:
                h, w = shingles(t)
                size.append(int(w.sum()))
                if len(h):
                    band.append(bands(signature(h, w)))
            starts = np.concatenate([[0], np.cumsum([BANDS * (n > 0) for n in size])])
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *band])), mask=pa.array([n == 0 for n in size]))
            return [*_names(texts, name), lists, pa.array(size, pa.int32())]

        return fn

    return append_columns(docs, text_col, [*_NAMES, T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("size", T.IntegerType())], make)


def with_occurrences(docs: DataFrame, text_col: str = "text", name: Name = name_of) -> DataFrame:
    """docs with node, half and occurrences, the set that exact similarities are taken of."""

    def make():
        claim("neardup", _hashes.clear)
        return lambda texts: [*_names(texts, name), pa.array([occurrences(*shingles(t)).tobytes() for t in texts], pa.binary())]

    return append_columns(docs, text_col, [*_NAMES, T.StructField("occurrences", T.BinaryType())], make)


def _apart(rows: DataFrame, clashes: list[int]) -> DataFrame:
    """rows with nodes that stand for several texts replaced by a hash of both halves."""
    return rows.withColumn("node", F.when(F.col("node").isin(clashes), F.xxhash64("node", "half")).otherwise(F.col("node"))) if clashes else rows


def _sets_of(docs: DataFrame, members: DataFrame, nodes: DataFrame, name: Name, clashes: list[int]) -> DataFrame:
    """(node, occurrences) of the members, read from one document of each."""
    wanted = cut(members.select("node").distinct().join(nodes.select("node", F.col("rep").alias("id")), "node").select("id").distinct())
    hint = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    texts = docs.join(hint, docs["id"].eqNullSafe(hint["id"]), "left_semi")
    return cut(_apart(with_occurrences(texts, name=name), clashes).select("node", "occurrences").dropDuplicates(["node"]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, name: Name = name_of) -> DataFrame:
    """(id, class_id) of every row: rows of equal or chained near-equal texts share a class, named by its least id.

    Null and empty texts are copies of each other; texts without words are classes of their own copies; a text of fewer
    than WORDS words is one shingle. Repeated rows stay; a class whose ids are all null has a null class_id; an empty
    table gives an empty result. Other columns don't matter, whatever their names.

    Texts are told apart by 128 bits; similarities are of sets of 32-bit hashes, where two texts of n shingles share
    n * n / 2^32 by chance (0.1 of 20,000), so a similarity is off by less than 1e-5.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = cut(with_signatures(docs, name=name).drop("text"))
    clashes = [r["node"] for r in rows.groupBy("node").agg(F.min("half").alias("x"), F.max("half").alias("y")).filter("x <> y").collect()]  # rows^2 / 2^65
    rows = _apart(rows, clashes)
    nodes = cut(rows.groupBy("node").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("size").alias("size")))
    some = nodes.filter(F.col("bands").isNotNull())
    spread = some.select("node", "size", F.posexplode("bands").alias("band", "hash")).select(F.xxhash64("band", "hash").alias("bucket"), "node", "size")
    label = cut(link_buckets(spread, some.count(), lambda members: _sets_of(docs, members, nodes, name, clashes), linked, least))
    reps = cut(label.join(nodes.select("node", "rep"), "node"))
    named = lookup(reps, reps.groupBy("label").agg(F.min("rep").alias("class_id")), "label", "node").select("node", "class_id")
    classes = nodes.select("node", "rep").join(named, "node", "left").select("node", F.coalesce("class_id", "rep").alias("class_id"))
    return lookup(rows.select("id", "node"), classes, "node", F.coalesce("id", F.lit(0))).select(F.col("id").alias(id_col), "class_id")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(read_documents(spark, sf_dir))
