"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are token sequences. A document is compared with an item if they share a seed (a run of
SEED tokens; shorter items are seeds as a whole). Tiling then repeatedly marks the longest match of unmarked tokens,
found by running Karp-Rabin hashing with a halving match length, until no match of SEED tokens is left; the tiles never
overlap, and they may stand in any order. A document is contaminated by an item if its tiles cover at least COVERAGE of
the item's tokens.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointframe.llm.common import chunks, claim, cut, read_documents, table, texts_of

SEED = 5
COVERAGE = 0.5
BLOCK_CHARS = 32_000_000  # benchmark text that a task holds at a time; more of it is gone through in blocks

_TOKEN = re.compile(r"[^\W_]+")
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def tile(doc: list[int], item: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token sequences: (start in doc, start in item, length) of each tile.

    Longest tiles first; of equal lengths the first in the item, then in the document. The search length starts at the
    item's and is halved when nothing of that length is left, down to `least`; a match of twice the length searched for
    restarts the search at its length.
    """
    least = min(least, len(item)) or 1
    free_d, free_i = [True] * len(doc), [True] * len(item)
    tiles: list[tuple[int, int, int]] = []

    def runs(free: list[bool], length: int):
        start = None
        for k in range(len(free) + 1):
            if k < len(free) and free[k]:
                start = k if start is None else start
            elif start is not None:
                if k - start >= length:
                    yield start, k
                start = None

    def rolling(seq: list[int], free: list[bool], length: int):
        """(hash, start) of the runs of unmarked tokens of this length."""
        lead = pow(_BASE, length - 1, _MOD)
        for a, b in runs(free, length):
            h = 0
            for k in range(a, b):
                if k - a >= length:
                    h = (h - (seq[k - length] + 1) * lead) % _MOD
                h = (h * _BASE + seq[k] + 1) % _MOD
                if k - a >= length - 1:
                    yield h, k - length + 1

    def scan(length: int) -> tuple[int, list[tuple[int, int, int]]]:
        """The longest match of unmarked tokens and, if none is twice as long, all maximal matches of at least length."""
        index: dict[int, list[int]] = defaultdict(list)
        for h, at in rolling(doc, free_d, length):
            index[h].append(at)
        found, best = [], 0
        for h, i in rolling(item, free_i, length):
            for d in index.get(h, ()):
                if i and d and free_i[i - 1] and free_d[d - 1] and item[i - 1] == doc[d - 1]:
                    continue  # part of a longer match, so never the longest
                k = 0
                while d + k < len(doc) and i + k < len(item) and free_d[d + k] and free_i[i + k] and doc[d + k] == item[i + k]:
                    k += 1
                if k < length:
                    continue  # a collision of hashes
                best = max(best, k)
                if k >= 2 * length:
                    return k, []
                found.append((k, i, d))
        return best, found

    length = max(least, len(item))
    while any(free_i):
        best, found = scan(length)
        if best >= 2 * length:
            length = best
        elif found:
            # All matches of the greatest length; those that these cut into are found again by the next scan.
            for k, i, d in sorted(m for m in found if m[0] == best):
                if all(free_d[d : d + k]) and all(free_i[i : i + k]):
                    tiles.append((d, i, k))
                    free_d[d : d + k] = [False] * k
                    free_i[i : i + k] = [False] * k
        elif length == least:
            return tiles
        else:
            length = max(least, length // 2)
    return tiles


@dataclass
class Bench:
    """Items as token ids, and their seeds: sorted seed hashes with the item of each."""

    ids: list
    items: list[list[int]]
    vocab: dict[str, int]
    seed_hash: np.ndarray
    seed_item: np.ndarray
    short: dict[int, list[int]]

    @staticmethod
    def build(rows: list[tuple[object, str]]) -> Bench:
        vocab: dict[str, int] = {}
        ids, items = [], []
        for key, text in rows:
            t = [vocab.setdefault(w, len(vocab)) for w in tokens(text)]
            if t:
                ids.append(key)
                items.append(t)
        hashes, owner = [], []
        short: dict[int, list[int]] = defaultdict(list)
        for k, t in enumerate(items):
            if len(t) < SEED:
                short[t[0]].append(k)
            else:
                h = np.unique(seed_hashes(np.array(t, np.int64)))
                hashes.append(h)
                owner.append(np.full(len(h), k, np.int64))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        o = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        return Bench(ids, items, vocab, h[order], o[order], dict(short))

    def matches(self, text: str) -> list[tuple[object, float, int, list[tuple[int, int, int]]]]:
        """(item id, coverage, item tokens, tiles) for each item that shares a seed with a text."""
        get = self.vocab.get
        seq = np.fromiter((get(w, -1) for w in tokens(text)), np.int64)
        if not len(seq):
            return []
        places: dict[int, list[int]] = defaultdict(list)
        if len(seq) >= SEED and len(self.seed_hash):
            known = np.convolve(seq >= 0, np.ones(SEED, np.int64), "valid") == SEED
            at = np.flatnonzero(known)
            if len(at):
                h = seed_hashes(seq)[at]
                left, right = np.searchsorted(self.seed_hash, h, "left"), np.searchsorted(self.seed_hash, h, "right")
                for p, a, b in zip(at[right > left].tolist(), left[right > left].tolist(), right[right > left].tolist(), strict=True):
                    for k in self.seed_item[a:b].tolist():
                        places[k].append(p)
        for first in self.short.keys() & set(seq.tolist()) if self.short else ():
            starts = np.flatnonzero(seq == first).tolist()
            for k in self.short[first]:
                n = len(self.items[k])
                hit = [p for p in starts if seq[p : p + n].tolist() == self.items[k]]
                if hit:
                    places[k] += hit
        out = []
        for k, where in sorted(places.items()):
            item = self.items[k]
            # A tile holds a seed and is no longer than the item: what is further from all seeds can't be in one.
            part, place = [], []
            for a, b in stretches(sorted(where), len(item), len(seq)):
                part += [*seq[a:b].tolist(), -2]
                place += range(a, b + 1)
            got = [(place[d], i, n) for d, i, n in tile(part, item)]
            out.append((self.ids[k], sum(n for *_, n in got) / len(item), len(item), got))
        return out


def seed_hashes(seq: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the SEED token ids that begin at each place."""
    h = np.zeros(len(seq) - SEED + 1, np.uint64)
    for k in range(SEED):
        h = (h ^ (seq[k : k + len(h)].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def stretches(where: list[int], n: int, end: int) -> list[tuple[int, int]]:
    """The parts of a document of `end` tokens within n tokens of a seed, which don't overlap."""
    out: list[list[int]] = []
    for p in where:
        a, b = max(0, p - n), min(end, p + n + SEED)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


RESULT = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("coverage", T.DoubleType()),
        T.StructField("item_tokens", T.LongType()),
        T.StructField("tiles", T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("doc_token", "item_token", "tokens")]))),
    ]
)
HITS = T.ArrayType(RESULT)


def blocks(items: DataFrame, id_col: str, text_col: str, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """The distinct items in blocks of about so many characters; streamed to the driver one partition at a time."""
    block: list[tuple[object, str]] = []
    size = 0
    for r in items.select(id_col, text_col).filter(F.col(text_col).isNotNull()).distinct().orderBy(id_col, text_col).toLocalIterator():
        if size + len(r[1]) > chars and block:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    yield block


def contaminations(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, hits_col: str = "hits") -> DataFrame:
    """docs with hits: (item_id, coverage, item_tokens, tiles) of each item whose tokens are covered to `coverage` or more.

    Every item is held against every whole text. A benchmark of more than BLOCK_CHARS characters is gone through in blocks:
    the driver and the tasks hold one block at a time, and docs with the hits so far is written once for each block but the
    last. Null, empty and wordless texts and items match nothing; items that occur twice under one id count once; an item
    of fewer than SEED tokens must occur whole; repeated documents stay; an empty table of either kind gives no hit; an
    existing column named as the new one is replaced. Item ids must be whole numbers; null is one of them.
    """
    if not isinstance(items.schema[item_id].dataType, T.IntegralType):
        raise ValueError(f"{item_id} must be a whole number")
    spark = docs.sparkSession
    items = items.withColumn(item_id, F.col(item_id).cast("long"))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("item_tokens", pa.int64()), ("tiles", pa.list_(pa.struct([(x, pa.int64()) for x in ("doc_token", "item_token", "tokens")])))]))
    out = docs.drop(*[c for c in docs.columns if c.lower() == hits_col.lower()]).withColumn(hits_col, F.array().cast(HITS))
    held = None
    for block in blocks(items, item_id, item_text):
        if held is not None:
            out = cut(out)
            held.destroy()
        held = spark.sparkContext.broadcast(block)
        out = _searched(out, held, uuid.uuid4().hex, text_col, hits_col, coverage, kind)
    return out


_built: dict[str, Bench] = {}


def _searched(docs: DataFrame, bench, key: str, text_col: str, hits_col: str, coverage: float, kind: pa.DataType) -> DataFrame:
    names = docs.columns

    def run(batches):
        claim("tiling", _built.clear)
        b = _built.get(key)
        if b is None:  # kept by each Python worker between tasks
            _built.clear()
            b = _built[key] = Bench.build(bench.value)
        for batch in (part for whole in batches for part in chunks(whole, text_col)):
            found = []
            for text, had in zip(texts_of(batch, text_col), batch.column(hits_col).to_pylist(), strict=True):
                got = [
                    {"item_id": key, "coverage": c, "item_tokens": n, "tiles": [{"doc_token": d, "item_token": i, "tokens": k} for d, i, k in tiles]}
                    for key, c, n, tiles in b.matches(text)
                    if c >= coverage
                ]
                found.append((had or []) + got)
            yield pa.RecordBatch.from_arrays([pa.array(found, kind) if n == hits_col else batch.column(n) for n in names], names=names)

    return docs.mapInArrow(run, docs.schema)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents: one row for each document and benchmark item that it holds."""
    hits = contaminations(read_documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    each = hits.filter(F.size("hits") > 0).select("doc_id", F.explode("hits").alias("h"))
    return each.select("doc_id", F.col("h.item_id").alias("item_id"), F.col("h.coverage").alias("coverage"), F.size("h.tiles").cast("long").alias("n_tiles"), F.aggregate("h.tiles", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("n_tokens"))
