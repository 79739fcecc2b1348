"""Toxicity by maximum-scoring segments.

Tokens are lower-cased words. A token's score is its log-odds between toxic and clean labelled documents under a Dirichlet
prior of PRIOR documents, shared as the word's stem suggests: the toxic share of the distinct words that begin alike, each
counting once, under a prior of STEM_PRIOR words shared as the next shorter stem suggests, and so on down to the overall
share. So every token has a score, negative ones too; a rare word is drawn to its stem and an unseen one has its stem's
odds (and one frequent word lends its stem nothing). Tallies of words and stems are kept in HASHED buckets each; words of
one bucket are tallied together. A constant drift below zero is added, and a linear-time scan finds
every maximal-scoring segment. A text's best segment is judged by extreme-value statistics: among clean labelled
texts the best score of n tokens follows a Gumbel law whose location grows with log n, and the final score
is a logistic function of the surprise (minus the log of the tail probability) fitted on the labelled documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointframe.llm.common import append_columns, claim, cut, read_documents, texts_of
from pointframe.llm.labelled import FIT_ROWS, held_out, label_sample

HASHED = 1 << 20  # buckets of words and of stems
PRIOR = 10.0  # mass of a word's Dirichlet prior, in documents
STEM_PRIOR = 5.0  # mass of a stem's, in words
STEMS = range(3, 9)  # lengths of the stems
DRIFT = -2.0  # added to every token
SHARES = 1_000_000  # a word's toxic share is summed as so many parts
TAIL = 0.05  # a segment as good as this in a clean text of the same length is not significant
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W_]+")


def segments(scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, end, score), in order, for tokens of scores[i] + drift.

    A linear-time scan with a stack of candidates: each has the cumulative sum before and after it, and a link to the
    nearest candidate to its left that begins at a smaller sum, so that no candidate is passed over twice. A new one absorbs
    those that it tops; where none begins at a smaller sum, all that are kept are final. Runs of non-positive tokens are
    summed at once.
    """
    total = np.cumsum(scores + drift)
    done: list[tuple] = []
    kept: list[tuple[int, int, float, float, int]] = []  # first, end, cumulative before, cumulative after, link
    for i in np.flatnonzero(scores + drift > 0).tolist():
        first, before, after = i, float(total[i - 1]) if i else 0.0, float(total[i])
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0:
                done += kept
                kept = [(first, i + 1, before, after, -1)]
                break
            if kept[j][3] >= after:
                kept.append((first, i + 1, before, after, j))
                break
            first, _, before, _, link = kept[j]
            del kept[j:]
            j = link
    return [(a, b, y - x) for a, b, x, y, _ in done + kept]


def bucket_of(word: str) -> int:
    """The bucket that xxhash64 of Spark's functions gives a word or stem."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), seed=42) & (HASHED - 1)


class _Scores(dict):
    """Word scores, filled as words turn up; emptied when large, which changes speed only."""

    def __init__(self, model: ToxicModel):
        super().__init__()
        self.model = model
        self.tallies = [memoryview(x) for x in (model.words, model.toxic, model.stems, model.shares)]

    def __missing__(self, word: str) -> float:
        if len(self) > 200_000:
            self.clear()
        words, toxic, stems, shares = self.tallies
        base = share = self.model.base
        if base in (0.0, 1.0):  # nothing to tell apart
            return 0.0
        for k in STEMS:
            if len(word) > k:
                at = bucket_of(word[:k])
                share = (shares[at] / SHARES + STEM_PRIOR * share) / (stems[at] + STEM_PRIOR)
        at = bucket_of(word)
        hits, n = toxic[at], words[at]
        self[word] = s = math.log((hits + PRIOR * share) / (n - hits + PRIOR * (1 - share)) * (1 - base) / base)
        return s


def _none() -> np.ndarray:
    return np.zeros(HASHED, np.int64)


@dataclass
class ToxicModel:
    """Tallies by bucket: documents with a word and toxic ones among them; words with a stem and the sum of their toxic shares."""

    base: float = 0.0
    words: np.ndarray = field(default_factory=_none)
    toxic: np.ndarray = field(default_factory=_none)
    stems: np.ndarray = field(default_factory=_none)
    shares: np.ndarray = field(default_factory=_none)
    drift: float = DRIFT

    def __post_init__(self) -> None:
        self._cache = _Scores(self)

    def __reduce__(self):
        return ToxicModel, (self.base, self.words, self.toxic, self.stems, self.shares, self.drift)

    def token_scores(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self._cache.__getitem__, words), float, len(words))

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """(number of tokens, maximal segments as (start, end, score) in code points)."""
        low = text.lower()
        words = _WORD.findall(low)
        found = segments(self.token_scores(words), self.drift) if words else []
        if not found:
            return len(words), []
        # Lower-casing may change a text's length; spans are given in the text itself.
        at = [m.span() for m in _WORD.finditer(text if len(low) == len(text) else low)]
        clip = len(text)
        return len(words), [(min(at[a][0], clip), min(at[b - 1][1], clip), v) for a, b, v in found]


COUNTS = T.StructType([T.StructField("word", T.StringType()), T.StructField("copies", T.LongType()), T.StructField("clean", T.LongType()), T.StructField("toxic", T.LongType())])


def with_copies(rows: DataFrame) -> DataFrame:
    """rows (text, y) with copies, the number of rows of the same text and label; null counts as the empty text.

    Only hashes of texts are shuffled, summed before; the texts that occur twice or more are at most half of the rows,
    of which a fit reads about FIT_ROWS, so they are broadcast.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = rows.select("text", "y", F.xxhash64(text).alias("_a"), F.hash(text).alias("_b"))
    many = keyed.groupBy("_a", "_b", "y").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
    return keyed.join(F.broadcast(many), ["_a", "_b", "y"], "left").select("text", "y", F.coalesce("_n", F.lit(1)).cast("long").alias("copies"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word in a batch and each number of copies, the number of clean and toxic rows that hold it."""
    for b in batches:
        sides: dict[int, tuple[Counter, Counter]] = {}
        alike = Counter(zip(texts_of(b, "text"), b.column("y").to_pylist(), b.column("copies").to_pylist(), strict=True))
        for (t, y, n), k in alike.items():
            side = sides.setdefault(n, (Counter(), Counter()))[y]
            for w in {"", *_WORD.findall(t.lower())}:
                side[w] += k
        for n, (clean, toxic) in sides.items():
            words = list(clean.keys() | toxic.keys())
            columns = ([n] * len(words), [clean[w] for w in words], [toxic[w] for w in words])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=COUNTS.names)


def count_words(rows: DataFrame) -> DataFrame:
    """(word, clean, toxic): the distinct clean and toxic texts of all rows that hold a word, and under the empty word all.

    The rows of a text of n copies are n over all batches together, so the sum over texts of n copies is a multiple of
    n, however the rows are dealt out.
    """
    each = with_copies(rows).mapInArrow(_count, COUNTS).groupBy("word", "copies").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    return each.groupBy("word").agg(*(F.sum(F.expr(f"{c} div copies")).alias(c) for c in ("clean", "toxic")))


def _tally(counts: DataFrame, n, hits) -> tuple[np.ndarray, np.ndarray]:
    """The sums of n and hits by the bucket of `key`: at most HASHED rows, whatever the number of words."""
    by = counts.groupBy(F.xxhash64("key").bitwiseAND(F.lit(HASHED - 1)).cast("int").alias("at")).agg(F.sum(n).alias("n"), F.sum(hits).alias("hits")).toArrow()
    out = _none(), _none()
    for x, c in zip(out, ("n", "hits"), strict=True):
        x[by.column("at").to_numpy()] = by.column(c).to_numpy()
    return out


def fit_words(rows: DataFrame) -> ToxicModel:
    """A model of rows (text, y). Without rows of both labels it finds nothing.

    Null texts count as empty; texts that occur several times under one label count once; an empty table has no label.
    All tallies are sums of whole numbers, so the model doesn't depend on how rows are dealt out or batched.
    """
    counts = cut(count_words(rows.select("text", "y")))
    size = counts.filter(F.col("word") == "").collect()
    n0, n1 = (size[0]["clean"], size[0]["toxic"]) if size else (0, 0)
    if not n0 or not n1:
        return ToxicModel()
    words = counts.filter(F.col("word") != "").select("word", F.col("word").alias("key"), "toxic", (F.col("clean") + F.col("toxic")).alias("n"))
    each = words.select("toxic", "n", "word", F.explode(F.array(*(F.lit(k) for k in STEMS))).alias("k")).filter(F.length("word") > F.col("k"))
    stems = each.select(F.expr("substring(word, 1, k)").alias("key"), F.expr(f"{SHARES} * toxic div n").alias("share"))
    return ToxicModel(n1 / (n0 + n1), *_tally(words, F.col("n"), F.col("toxic")), *_tally(stems, F.lit(1), F.col("share")))


PASSAGE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])


def find_passages(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """docs with n_tokens and passages (start, end, score), the maximal-scoring segments of each whole text.

    A null or empty text has no token and no passage; repeated rows stay; an empty table stays empty; existing columns
    of these names are replaced. The model is 4 x HASHED numbers, so its broadcast doesn't grow with the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def make():
        m = shared.value
        claim("toxicity", m._cache.clear)

        def fn(texts: list[str]) -> list[pa.Array]:
            got = [m.passages(t) for t in texts]
            return [pa.array([n for n, _ in got], pa.int64()), pa.array([[dict(zip(("start", "end", "score"), p, strict=True)) for p in ps] for _, ps in got], kind)]

        return fn

    return append_columns(docs, text_col, [T.StructField("n_tokens", T.LongType()), T.StructField("passages", T.ArrayType(PASSAGE))], make)


@dataclass
class Calibration:
    """Gumbel law of the best score of clean texts, (s - mu - log(n) / lam) * lam, and the logistic on the surprise."""

    lam: float = 1.0
    mu: float = 0.0
    bias: float = -3.0
    slope: float = 1.0

    def surprise(self, best, n):
        """-log of the chance that a clean text of n tokens has as good a segment; 0 without a segment."""
        x = F.lit(self.lam) * (best - F.lit(self.mu)) - F.log(F.greatest(n, F.lit(1)).cast("double"))
        # -log(1 - exp(-e^-x)): x for a large x.
        tail = F.when(x > 30, x).otherwise(-F.log(F.greatest(-F.expm1(-F.exp(-F.greatest(x, F.lit(-5.0)))), F.lit(1e-300))))
        return F.when(best > 0, tail).otherwise(F.lit(0.0))

    def score(self, surprise):
        return 1 / (1 + F.exp(-(F.lit(self.bias) + F.lit(self.slope) * surprise)))


def fit_calibration(rows: list[tuple[float, int, int]]) -> Calibration:
    """From (best score, tokens, label) of labelled documents.

    Moments of the clean texts' positive scores give the Gumbel law (a prior of ten unit scores keeps it defined when
    clean texts have none); the logistic is fitted by Newton steps with a ridge.
    """
    cal = Calibration()
    rows = sorted(rows)  # sums of floats in one order
    clean = np.array([(s, max(n, 1)) for s, n, y in rows if y == 0 and s > 0]).reshape(-1, 2)
    s = np.concatenate([clean[:, 0], np.linspace(0.5, 1.5, 10)])
    cal.lam = min(math.pi / math.sqrt(6) / max(float(s.std()), 0.3), 3.0)
    n_mean = np.mean([math.log(max(n, 1)) for _, n, y in rows if y == 0] or [0.0])
    cal.mu = float(s.mean()) - 0.5772 / cal.lam - float(n_mean) / cal.lam
    if not rows:
        return cal
    a = np.array(rows, dtype=float)
    x = cal.lam * (a[:, 0] - cal.mu) - np.log(np.maximum(a[:, 1], 1))
    tail = np.where(x > 30, x, -np.log(np.maximum(-np.expm1(-np.exp(-np.maximum(x, -5.0))), 1e-300)))
    v = np.where(a[:, 0] > 0, tail, 0.0)
    m, y, b = np.stack([np.ones(len(v)), np.minimum(v, 12.0)], 1), a[:, 2], np.array([cal.bias, cal.slope])
    ridge, at = np.diag([0.01, 0.05]), np.array([-3.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-m @ b))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + ridge, m.T @ (y - p) - ridge @ (b - at))
        b = b + np.clip(step, -2, 2)
    cal.bias, cal.slope = float(b[0]), max(float(b[1]), 0.05)
    return cal


def op10_toxicity(spark: SparkSession, sf_dir: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """score, predicted and the significant passages of every document."""
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    labels = cut(label_sample(spark, sf_dir, "toxic", fit_rows))  # at most about fit_rows rows of 12 bytes: small enough to broadcast
    model = fit_words(docs.join(F.broadcast(labels), "doc_id"))
    found = cut(find_passages(docs, model).select("doc_id", "n_tokens", "passages"))
    best = F.coalesce(F.array_max(F.transform("passages", lambda p: p["score"])), F.lit(0.0))
    known = found.join(F.broadcast(labels), "doc_id").select(best.alias("s"), "n_tokens", "y").toPandas()
    cal = fit_calibration(list(known.itertuples(index=False, name=None)))
    surprise = cal.surprise(best, F.col("n_tokens"))
    significant = F.filter("passages", lambda p: cal.surprise(p["score"], F.col("n_tokens")) > -math.log(TAIL))
    return (
        found.withColumn("surprise", surprise)
        .withColumn("score", cal.score(F.least(F.col("surprise"), F.lit(12.0))))
        .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "surprise", significant.alias("passages"))
    )
