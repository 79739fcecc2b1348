"""Importance resampling of documents towards a target, by hashed features of words.

Features are runs of consecutive words, hashed by crc32 into buckets. A bucket's gain is the log of its share among the
features of the target over its share among those of all documents; a document's weight is the sum of its gains, and
noise by the document's id turns the highest scores into a draw without replacement in proportion to exp(weight).

The words of an Arrow batch are read as one byte-automaton, without a Python string: a lookup table classifies (and
lower-cases) all bytes of the UTF-8 buffer, word boundaries are where the class differs from the byte before, and the
table-driven CRC advances over all features at once, a byte a step. A feature of more than PIECE bytes is cut into
pieces that advance beside the others and are then joined by a table of PIECE zero bytes, so that one word of millions
of bytes takes no loop of as many steps.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointframe.llm.common import claim, cut, read_documents, table
from pointframe.llm.common import chunks as slices

BUCKETS = 10_000
MAX_RUN = 1  # words of a feature at most
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
PIECE = 64

_POLY = 0xEDB88320  # of crc32, bits reversed


@functools.cache
def byte_table() -> np.ndarray:
    """The word byte that a byte is read as (A-Z as a-z), or 0 for a byte that ends a word.

    All bytes from 0x80 on belong to characters beyond 0x7F, which are word characters.
    """
    out = np.zeros(256, np.uint8)
    for low, high, shift in ((0x30, 0x39, 0), (0x41, 0x5A, 32), (0x61, 0x7A, 0), (0x80, 0xFF, 0)):
        out[low : high + 1] = np.arange(low, high + 1) + shift
    return out


@functools.cache
def crc_table() -> np.ndarray:
    """The CRC register after one byte."""
    r = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        r = np.where(r & 1, (r >> np.uint32(1)) ^ np.uint32(_POLY), r >> np.uint32(1))
    return r


@functools.cache
def zeros_table() -> np.ndarray:
    """The register after PIECE zero bytes, for each value of each of its four bytes; the register is linear in them."""
    r = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for _ in range(PIECE):
        r = crc_table()[r & 0xFF] ^ (r >> np.uint32(8))
    return r


def _advance(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, register: np.ndarray) -> np.ndarray:
    """Registers after the bytes of each slice, all slices a byte a step."""
    order = np.argsort(-lengths, kind="stable")
    left, reg, steps = lengths[order], register[order], crc_table()
    at = starts[order].astype(np.int64)
    # How many slices have more than k bytes, for each k.
    active = len(left) - np.searchsorted(left[::-1], np.arange(left[0] if len(left) else 0), side="right")
    for n in active.tolist():
        r = reg[:n]
        reg[:n] = steps[(r ^ data[at[:n]]) & 0xFF] ^ (r >> np.uint32(8))
        at[:n] += 1
    out = np.empty_like(reg)
    out[order] = reg
    return out


def crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of each slice of data, of one byte or more."""
    ones = np.uint32(0xFFFFFFFF)
    pieces = -(-lengths // PIECE)
    first = lengths - (pieces - 1) * PIECE  # the odd piece comes first, so that what follows is whole
    reg = _advance(data, starts, first, np.full(len(starts), ones))
    long = np.flatnonzero(pieces > 1)
    if len(long):
        long = long[np.argsort(-pieces[long], kind="stable")]
        more = pieces[long] - 1
        base = np.cumsum(more) - more
        at = np.repeat(starts[long] + first[long] - base * PIECE, more) + np.arange(more.sum()) * PIECE
        rest = _advance(data, at, np.full(len(at), PIECE), np.zeros(len(at), np.uint32))
        r, zeros = reg[long], zeros_table()
        active = len(more) - np.searchsorted(more[::-1], np.arange(more[0]), side="right")
        for k, n in enumerate(active.tolist()):
            x = r[:n]
            r[:n] = zeros[0][x & 0xFF] ^ zeros[1][(x >> 8) & 0xFF] ^ zeros[2][(x >> 16) & 0xFF] ^ zeros[3][x >> 24] ^ rest[base[:n] + k]
        reg[long] = r
    return reg ^ ones


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each), without a copy of the texts; a null has no byte."""
    wide = pa.types.is_large_string(texts.type)
    if not wide and not pa.types.is_string(texts.type):
        texts, wide = texts.cast(pa.large_string()), True
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if wide else np.int32
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends, counts): the lower-cased words in data, one space behind a word that is followed by anything; words of each text."""
    raw, offsets = _bytes(texts)
    low = byte_table()[raw]
    word = low != 0
    before = np.concatenate([[False], word[:-1]]) if len(word) else word
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    before[inner] = False  # a text doesn't go on with the words of the text before
    begin = np.flatnonzero(word & ~before)
    after = np.concatenate([word[1:], [False]]) if len(word) else word.copy()
    after[inner - 1] = False
    end = np.flatnonzero(word & ~after) + 1
    counts = np.diff(np.searchsorted(begin, offsets))
    keep = word.copy()
    gap = end[end < len(raw)]
    gap = gap[~word[gap]]
    keep[gap] = True
    low[gap] = 0x20
    place = np.concatenate([[0], np.cumsum(keep)])
    return low[keep], place[begin], place[end], counts


def features(texts: pa.Array, buckets: int = BUCKETS, max_run: int = MAX_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket of each feature, words of each text). Texts are numbered from 0; all runs of 1 to max_run words."""
    data, starts, ends, counts = words_of(texts)
    # Words of a run stand side by side in data; where two words aren't parted by one space (the next text), no run goes on.
    owner = np.repeat(np.arange(len(counts)), counts)
    docs, hashed = [], []
    for run in range(1, max_run + 1):
        n = len(starts) - run + 1
        if n <= 0:
            break
        whole = np.flatnonzero(owner[:n] == owner[run - 1 :])
        hashed.append(crcs(data, starts[whole], ends[whole + run - 1] - starts[whole]) % np.uint32(buckets))
        docs.append(owner[whole])
    if not docs:
        return np.empty(0, np.int64), np.empty(0, np.int64), counts
    return np.concatenate(docs), np.concatenate(hashed).astype(np.int64), counts


COUNT = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])


def bucket_counts(rows: DataFrame, text_col: str = "text", buckets: int = BUCKETS, max_run: int = MAX_RUN) -> np.ndarray:
    """Features of all rows by bucket: each task counts its own, so a task hands on one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("resampling", lambda: None)
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in slices(batch, "text"):
                total += np.bincount(features(b.column("text"), buckets, max_run)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=COUNT.names)

    out = np.zeros(buckets, np.int64)
    for r in rows.select(F.col(text_col).alias("text")).mapInArrow(run, COUNT).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the target's share of a bucket over the source's), each bucket counting once more than found."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", max_run: int = MAX_RUN) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row; a null or empty text has none and weighs 0. Other columns go."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("resampling", lambda: None)
        g = shared.value
        for batch in batches:
            for b in slices(batch, "text"):
                owner, bucket, words = features(b.column("text"), len(g), max_run)
                # Sums of whole numbers in doubles are exact below 2^53.
                weight = np.bincount(owner, g[bucket], len(words)).astype(np.int64)
                columns = [words.astype(np.int64), np.bincount(owner, minlength=len(words)), weight]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: str = SEED) -> Column:
    """floor(1000 * a Gumbel number) by the id; a null id counts as the empty string."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """rows (doc_id, score, ...) with rank 1, 2, ... of the percent of the eligible rows that have the highest scores.

    Ties go to smaller ids, and to a null id last. Rows are dealt out by ranges of score and id, of which only the sizes
    reach the driver; each part numbers its rows from where the part before ends. Nothing is sorted in one task.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.when(eligible, F.col("score"))
    order = [F.col("_key").desc_nulls_last(), F.col("doc_id").asc_nulls_last()]
    dealt = cut(rows.withColumn("_key", key).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["n"] for r in dealt.filter(F.col("_key").isNotNull()).groupBy("_part").agg(F.count("*").alias("n")).collect()}
    drawn = sum(sizes.values()) * percent // 100
    first, at = {}, 0
    for part in sorted(sizes):
        first[part], at = at, at + sizes[part]
    names = rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for b in batches:
            if not b.num_rows:
                continue
            if done is None:  # a task is one part
                done = first.get(b.column("_part")[0].as_py(), 0)
            rank = np.arange(done + 1, done + b.num_rows + 1)
            done += b.num_rows
            out = np.asarray(b.column("_key").is_null()) | (rank > drawn)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(rank, pa.int64(), mask=out)], names=[*names, "rank"])

    return dealt.mapInArrow(number, T.StructType([*rows.schema.fields, T.StructField("rank", T.LongType())]))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, max_run: int = MAX_RUN, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text); rank is null where it isn't drawn.

    target has a column text. Null and empty texts have no feature; repeated rows count and are ranked each; an empty
    table of documents stays empty, an empty target makes rare buckets gain; other columns go.
    """
    gain = gains(bucket_counts(docs, buckets=buckets, max_run=max_run), bucket_counts(target, buckets=buckets, max_run=max_run))
    # Four numbers a row, written once: dealing rows out by ranges reads them twice.
    scored = cut(weigh(docs, gain, max_run=max_run)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(scored, F.col("n_words") >= least_words, percent).drop("n_words")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents resampled towards the texts of benchmark."""
    return resample(read_documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
