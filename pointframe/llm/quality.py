"""Quality scores by regularised quadratic discriminant analysis over transformed document statistics.

Statistics of a whole text (shares of character classes, repetition, shape of words and lines) are transformed by logs
and standardised. Each class gets a mean and a covariance; covariances are shrunk towards the pooled one and
towards a multiple of the identity, and kept as Cholesky factors. The score is a logistic function of the
difference of the two Mahalanobis log-densities plus the log prior odds, its temperature fitted on the same rows.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointframe.llm.common import append_columns, claim, cut, read_documents
from pointframe.llm.labelled import held_out, label_sample

FIT_ROWS = 50_000  # labelled documents that the fit reads, about
POOLED = 0.1  # weight of the pooled covariance in a class's
SPHERE = 0.02  # weight of the identity
THRESHOLD = 0.5
CHARS, WORDS = 200, 30  # code points and words of ordinary text that are added to the counts, so that short texts are judged mildly

LETTER, UPPER, DIGIT, SPACE, STOP, SYMBOL, OTHER = range(7)
NAMES = (
    "chars", "letters", "upper", "digits", "space", "stops", "symbols", "other", "word_length", "long_words", "types",
    "adjacent_repeats", "bigram_types", "top_word", "bare_tokens", "line_length", "repeated_lines", "closed_lines",
    "sentence_length", "symbol_tokens",
)

_classes: np.ndarray | None = None


def class_table() -> np.ndarray:
    """The character class of each code point."""
    global _classes
    if _classes is None:
        t = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        for i in range(0x20000):
            c, cat = chr(i), unicodedata.category(chr(i))
            if cat[0] == "L":
                t[i] = UPPER if cat in ("Lu", "Lt") else LETTER
            elif cat[0] == "N":
                t[i] = DIGIT
            elif c.isspace():
                t[i] = SPACE
            elif c in ".,;:?!'\"()-–—“”‘’…":
                t[i] = STOP
            elif cat[0] in "PS":
                t[i] = SYMBOL
        t[0x20000:0x3FFFF] = LETTER
        _classes = t
    return _classes


_HAS = re.compile(r"\w")


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text, as NAMES lists them; an empty text has defined values too."""
    n = len(text)
    if n <= 1 << 22:
        c = np.bincount(class_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=7)
    else:
        c = sum(np.bincount(class_table()[np.frombuffer(text[i : i + (1 << 22)].encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=7) for i in range(0, n, 1 << 22))
    share = lambda k, usual=0.0: float(c[k] + CHARS * usual) / (n + CHARS)
    words = text.split()
    m = len(words)
    of_words = lambda k, usual=0.0: (k + WORDS * usual) / (m + WORDS)
    low = [w.casefold() for w in words]
    counts = Counter(low)
    lines = [x for x in text.split("\n") if x.strip()]
    repeats = sum(map(eq, low[1:], low))
    bigrams = len(set(zip(low, low[1:], strict=False)))
    bare = sum(v for w, v in counts.items() if not _HAS.search(w))
    odd = sum(v for w, v in counts.items() if len(w) > 2 and not w[-1].isalnum() and not w[-2].isalnum())
    long_words = sum(v for w, v in counts.items() if len(w) > 14)
    ends = sum(text.count(x) for x in ".?!")
    closed = sum(x.rstrip()[-1] in ".?!…\"'”" for x in lines)
    little = lambda x, k=100.0: math.log1p(k * x)  # noqa: E731  spreads shares near 0
    return [
        math.log1p(n),
        share(LETTER, 0.80) + share(UPPER, 0.02),
        little(share(UPPER, 0.02)),
        little(share(DIGIT)),
        share(SPACE, 0.155),
        little(share(STOP, 0.025)),
        little(share(SYMBOL), 300.0),
        little(share(OTHER), 300.0),
        math.log1p((n - float(c[SPACE]) + 5.5 * WORDS) / (m + WORDS)),
        little(of_words(long_words)),
        math.log((len(counts) + WORDS) / (m + WORDS)) / math.log(m + WORDS),
        little(of_words(repeats), 300.0),
        math.log((bigrams + WORDS) / (m + WORDS)),
        little((counts.most_common(1)[0][1] if m else 0) / (m + WORDS)),
        little(of_words(bare), 300.0),
        math.log1p((n + CHARS) / (len(lines) + 1)),
        little((len(lines) - len(set(lines))) / (len(lines) + 4)),
        (closed + 4) / (len(lines) + 4),
        math.log1p((m + WORDS) / (ends + 4)),
        little(of_words(odd), 300.0),
    ]


@dataclass
class Discriminant:
    """Standardisation, and for each class its mean, inverse Cholesky factor, log-determinant and log prior."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    inverse_factors: list[np.ndarray]
    log_dets: list[float]
    log_priors: list[float]
    temperature: float = 1.0
    bias: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, with the priors."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        side = [lp - 0.5 * (((z - m) @ f.T) ** 2).sum(1) - 0.5 * ld for m, f, ld, lp in zip(self.means, self.inverse_factors, self.log_dets, self.log_priors, strict=True)]
        return side[1] - side[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.temperature * self.difference(x) + self.bias, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pooled: float = POOLED, sphere: float = SPHERE) -> Discriminant | None:
    """The discriminant of rows x with labels y; None if a class has no row, in which case nothing can be told."""
    if not (y == 0).any() or not (y == 1).any():
        return None
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - centre) / scale, -8, 8)
    d = z.shape[1]
    groups = [z[y == k] for k in (0, 1)]
    spread = [(g - g.mean(0)).T @ (g - g.mean(0)) for g in groups]
    common = sum(spread) / len(z)
    out = Discriminant(centre, scale, [], [], [], [])
    for g, s in zip(groups, spread, strict=True):
        cov = (s + 10 * common) / (len(g) + 10)  # ten rows' worth of the pooled one keep small classes defined
        cov = (1 - pooled) * cov + pooled * common
        cov = (1 - sphere) * cov + sphere * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        out.means.append(g.mean(0))
        out.inverse_factors.append(np.linalg.inv(factor))
        out.log_dets.append(2 * float(np.log(np.diag(factor)).sum()))
        out.log_priors.append(math.log(len(g) / len(z)))
    # Temperature and bias: logistic regression on the clipped difference, by Newton steps with a ridge.
    v = np.clip(out.difference(x), -30, 30)
    m, b = np.stack([v, np.ones(len(v))], 1), np.array([0.3, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ b, -40, 40)))
        h = (m * (p * (1 - p))[:, None]).T @ m + np.diag([0.1, 0.1])
        b = b + np.clip(np.linalg.solve(h, m.T @ (y - p) - 0.1 * (b - [0.3, 0.0])), -1, 1)
    out.temperature, out.bias = max(float(b[0]), 0.01), float(b[1])
    return out


def with_statistics(docs: DataFrame, text_col: str = "text", stats_col: str = "stats") -> DataFrame:
    """docs with the array of statistics of each whole text; a null text counts as empty, repeated rows stay."""

    def make():
        claim("quality", lambda: None)

        def fn(texts: list[str]) -> list[pa.Array]:
            flat = np.array([statistics(t) for t in texts], dtype=float).reshape(-1)
            return [pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, len(NAMES)), pa.int32()), pa.array(flat))]

        return fn

    return append_columns(docs, text_col, [T.StructField(stats_col, T.ArrayType(T.DoubleType()))], make)


def score_statistics(stats: DataFrame, model: Discriminant | None, stats_col: str = "stats") -> DataFrame:
    """stats with score; without a model every score is 0.5. Repeated rows stay; an empty table stays empty; an existing score is replaced."""
    fields = T.StructType([f for f in stats.schema.fields if f.name != "score"] + [T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(stats_col).flatten()).reshape(b.num_rows, -1)
                score = model.score(x) if model is not None else np.full(b.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in fields.names[:-1]), pa.array(score)], names=fields.names)

    return stats.mapInArrow(run, fields)


def op4_quality(spark: SparkSession, sf_dir: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """score and predicted of every document."""
    stats = cut(with_statistics(read_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "stats"))
    labels = label_sample(spark, sf_dir, "quality", fit_rows)  # at most about fit_rows rows: small enough to broadcast
    known = stats.join(F.broadcast(labels), "doc_id").select("stats", "y").toPandas()
    x = np.stack(known["stats"].to_list()) if len(known) else np.zeros((0, len(NAMES)))
    y = known["y"].to_numpy(dtype=int)
    order = np.lexsort([y, *x.T])  # sums of floats in one order, however rows arrive
    model = fit(x[order], y[order])
    scored = score_statistics(stats, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
