"""Language identification with error-correcting output codes over binary n-gram classifiers.

Every language has a codeword of bits. For each bit a binary classifier tells the languages with that bit from the
others: the mean, over the hashed character n-grams (n = 1, 2, 3) of the lower-cased letters, of the log-odds
of the gram between the two sides, each language weighing alike. A text goes to the codeword of least logistic loss
against the bits' margins, each bit weighted by how well it separated the training counts; a small gap between the
best and the second codeword marks the prediction as ambiguous.

Training reads at most about `fit_rows` labelled documents per language (a sample by hash, whole texts); n-gram counts and
the shares on either side of each bit are summed by Spark, and only buckets x bits and languages x bits numbers reach the
driver.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointframe.llm.common import append_columns, claim, crc_fold, cut, read_documents, texts_of

BUCKETS = 1 << 15
FIT_ROWS = 20_000  # labelled documents per language that training reads, about
MAX_LANGS = 8192  # more values than this are no languages
WIDE = 1024  # languages up to which the best of many codes is looked for
SCALE = 1 << 49  # shares are summed as whole numbers of so many parts
PREDICTED = 1 << 22  # texts x languages x bits that are in memory at once
AMBIGUOUS = 0.05  # gap of the normalised losses of the best two codewords
SHARPNESS = 40.0  # turns a mean log-odds into a margin
FEW = 30  # a text of this many grams counts half as sure as a long one
CHUNK = 1 << 19
UND = "und"

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point, itself if it is a letter, else 0."""
    global _letters
    if _letters is None:
        t = np.arange(sys.maxunicode + 1, dtype=np.uint32)
        t[[i for i in range(sys.maxunicode + 1) if not chr(i).isalpha()]] = 0
        _letters = t
    return _letters


def gram_buckets(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3: (hash bucket, whether it counts) of the gram that begins at each place; grams of no letter don't count."""
    c = codes.astype(np.uint32)
    h = c * np.uint32(0x9E3779B1)
    live = c > 0
    yield (h ^ (h >> 15)) % BUCKETS, live
    for n in (2, 3):
        h = h[: len(c) - n + 1] * np.uint32(0x85EBCA6B) + c[n - 1 :] * np.uint32(0xC2B2AE35) + np.uint32(n)
        live = live[: len(c) - n + 1] | (c[n - 1 :] > 0)
        yield (h ^ (h >> 13)) % BUCKETS, live


def chunks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, owner text of each piece, start of each piece) for runs of whole texts; very long texts come in pieces."""
    table = letter_table()
    parts, owner, starts, size = [], [], [], 0
    for i, t in enumerate(texts):
        t = t.lower()
        for at in range(0, max(len(t), 1), CHUNK):
            raw = np.frombuffer(t[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            starts.append(size)
            owner.append(i)
            parts += [table[raw], np.zeros(3, np.uint32)]
            size += len(raw) + 3
            if size >= CHUNK:
                yield np.concatenate(parts), np.array(owner), np.array(starts)
                parts, owner, starts, size = [], [], [], 0
    if parts:
        yield np.concatenate(parts), np.array(owner), np.array(starts)


def code_matrix(k: int) -> np.ndarray:
    """k codewords of +-1: the exhaustive code for up to six languages, else rows drawn with a fixed seed until they differ widely."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 6:
        rows = [(1, *bits) for bits in itertools.product((1, -1), repeat=k - 1)][1:]  # one of each complementary pair
        return np.array(rows).T.astype(float)
    width = max(24, 10 * int(np.ceil(np.log2(k))))
    rng, best, gap = np.random.default_rng(7), None, -1
    while k > WIDE:  # wide enough to differ by any draw, or nearly
        best = rng.choice([-1.0, 1.0], size=(k, width))
        if len(np.unique(best, axis=0)) == k:
            return best
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], size=(k, width))
        m = m[:, np.abs(m.sum(0)) < k]
        d = (m.shape[1] - m @ m.T) / 2
        np.fill_diagonal(d, width)
        if d.min() > gap:
            best, gap = m, d.min()
    return best


@dataclass
class LanguageModel:
    langs: list[str]
    codes: np.ndarray  # language x bit
    weights: np.ndarray  # bit x bucket: log-odds
    trust: np.ndarray  # bit: weight of its loss

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(mean log-odds of each text and bit, number of letters)."""
        total = np.zeros((len(texts), len(self.weights)))
        grams, letters = np.zeros(len(texts)), np.zeros(len(texts))
        for codes, owner, starts in chunks(texts):
            for n, (h, live) in enumerate(gram_buckets(codes)):
                s = np.minimum(starts, len(h) - 1)
                count = np.add.reduceat(live.astype(np.float64), s)
                if n == 0:
                    np.add.at(letters, owner, count)
                np.add.at(grams, owner, count)
                h = np.where(live, h, BUCKETS)
                for b, w in enumerate(self.weights):
                    np.add.at(total[:, b], owner, np.add.reduceat(w[h], s, dtype=np.float64))
        return total / (grams + FEW)[:, None], letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score from 0 to 1, whether ambiguous) of each text."""
        some = max(1, PREDICTED // self.codes.size)
        if len(texts) > some:
            parts = [self.predict(texts[i : i + some]) for i in range(0, len(texts), some)]
            return [x for p in parts for x in p[0]], np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        margins, letters = self.margins(texts)
        x = np.clip(SHARPNESS * margins[:, None, :] * self.codes[None, :, :], -500, 500)
        loss = (np.logaddexp(0, -x) * self.trust).sum(2) / self.trust.sum()  # text x language
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        p = np.exp(-(loss - loss.min(1, keepdims=True)) * len(self.trust))
        score = (1 / p.sum(1)) if len(self.langs) > 1 else np.ones(len(texts))
        gap = np.take_along_axis(loss, order[:, 1:2], 1)[:, 0] - loss[np.arange(len(texts)), best] if len(self.langs) > 1 else np.ones(len(texts))
        none = letters == 0
        return [UND if none[i] else self.langs[k] for i, k in enumerate(best)], np.where(none, 0.0, score), none | (gap < AMBIGUOUS)


COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gram counts of each language in one partition, or in parts of it if it has many languages."""
    total: dict[str, np.ndarray] = {}

    def counted() -> Iterator[pa.RecordBatch]:
        for lang, acc in total.items():
            at = np.flatnonzero(acc)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(acc[at], pa.int64())], names=["lang", "bucket", "n"])
        total.clear()

    for b in batches:
        langs, texts = b.column("lang").to_pylist(), texts_of(b, "text")
        for lang in sorted(set(langs)):
            acc = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for codes, *_ in chunks([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                for h, live in gram_buckets(codes):
                    acc += np.bincount(h[live], minlength=BUCKETS)
            if len(total) >= 64:
                yield from counted()
    yield from counted()


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS) -> LanguageModel:
    """A model of the rows' (doc_id, text, lang).

    Rows with a null language and texts without letters teach nothing; with no row at all the model knows no
    language and predicts `und`. If a language has more than about fit_rows rows, a sample of them by hash is taken. A table
    of more than MAX_LANGS languages is refused with an error, since codewords of all of them are held.
    """
    rows = rows.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull())
    large = rows.groupBy("lang").agg(F.count("*").alias("n")).filter(F.col("n") > fit_rows)  # fewer than rows / fit_rows
    share = F.coalesce(F.lit(float(fit_rows)) / F.col("n"), F.lit(1.0))
    picked = rows.join(F.broadcast(large), "lang", "left").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30)).drop("n")
    sums = cut(picked.mapInArrow(_count, COUNTS).groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    total = sums.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").limit(MAX_LANGS + 1).collect()
    if len(total) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    return from_counts(sums, [(r["lang"], r["n"]) for r in total])


def from_counts(sums: DataFrame, total: list[tuple[str, int]]) -> LanguageModel:
    """The model of counts (lang, bucket, n), whose sums by language are given in order of the languages.

    A language's share of a bucket is of its grams, with half a gram more in each bucket; a bit's weight is the log of the
    mean share of the languages with the bit over that of those without, and its trust the least expected margin of a language.
    """
    langs = [x for x, _ in total]
    codes = code_matrix(len(langs))
    bits = range(codes.shape[1])
    weights, trust = np.zeros((len(bits), BUCKETS + 1), np.float32), np.ones(len(bits))
    if len(langs) < 2:
        return LanguageModel(langs, codes, weights, trust)
    mass = np.array([n + 0.5 * BUCKETS for _, n in total])
    spark = sums.sparkSession
    known = F.broadcast(spark.createDataFrame([(x, float(m), [int(c > 0) for c in row]) for (x, _), m, row in zip(total, mass, codes, strict=True)], "lang string, mass double, bits array<int>"))
    part = (F.col("n") * F.lit(float(SCALE)) / F.col("mass")).cast("long")
    each = sums.join(known, "lang").select("lang", "bucket", part.alias("p"), "bits")
    got = each.groupBy("bucket").agg(F.sum("p").alias("all"), *(F.sum(F.col("p") * F.col("bits")[b]).alias(f"b{b}") for b in bits)).toArrow()
    at = got.column("bucket").to_numpy()
    rest = (0.5 / mass) @ (codes > 0), (0.5 / mass) @ (codes < 0)
    for b in bits:
        yes, no = np.full(BUCKETS, rest[0][b]), np.full(BUCKETS, rest[1][b])
        with_bit = got.column(f"b{b}").to_numpy()
        yes[at] += with_bit / SCALE
        no[at] += (got.column("all").to_numpy() - with_bit) / SCALE
        weights[b, :BUCKETS] = np.log(yes / (codes[:, b] > 0).sum()) - np.log(no / (codes[:, b] < 0).sum())
    # Expected margins: weights in whole numbers too, so that sums don't depend on their order.
    whole = np.round(weights[:, :BUCKETS].T.astype(float) * (1 << 20)).astype(np.int64)
    odds = F.broadcast(spark.createDataFrame(pa.table({"bucket": pa.array(np.arange(BUCKETS), pa.int32()), "w": pa.array(list(whole), pa.list_(pa.int64()))})))
    sides = sums.join(odds, "bucket").groupBy("lang").agg(*(F.sum(F.col("n") * F.col("w")[b]).alias(f"b{b}") for b in bits)).orderBy("lang").collect()
    flat = weights[:, :BUCKETS].astype(float).sum(1)
    side = np.array([[r[f"b{b}"] / (1 << 20) for b in bits] for r in sides])
    trust = np.maximum(((side + 0.5 * flat) / mass[:, None] * codes).min(0), 1e-3)
    return LanguageModel(langs, codes, weights, trust / trust.mean())


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", names: Sequence[str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """docs with lang_pred, score and ambiguous, or as names has it.

    A null text or one without letters gets `und`, score 0 and ambiguous; repeated rows stay; an empty table stays
    empty; existing columns of these names are replaced. The model is languages x buckets numbers, whatever the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        claim("language", lambda: None)

        def fn(texts: list[str]) -> list[pa.Array]:
            if not m.langs:
                return [pa.array([UND] * len(texts)), pa.array([0.0] * len(texts)), pa.array([True] * len(texts))]
            lang, score, ambiguous = m.predict(texts)
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())]

        return fn

    fields = [T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)]
    return append_columns(docs, text_col, fields, make)


def held_out(doc_id="doc_id"):
    return crc_fold(F.col(doc_id), 4) == 2


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; rows of fold 2 of 4 teach nothing."""
    docs = read_documents(spark, sf_dir)
    model = fit(docs.filter(~held_out()))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
