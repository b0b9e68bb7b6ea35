"""Document quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - score): one set of weights on hashed text features for all grades, and ordered
thresholds. A document's features are shares of its tokens (runs of non-space characters): each token counts for its
lower-case form, for its shape, in which runs of small letters, capitals and digits are one sign each, and for being
the one before it once more. So the score is a mean over tokens, and scoring is one pass without a shuffle.

Fitting takes at most ``sample`` rated documents, one text and the lowest grade of an id: those whose
``doc_id`` comes first in a seeded hash order, and of those the texts of at most ``longest`` bytes. Their
hashed counts, not their texts, go to the driver; that is the only part that doesn't see all rows.

Results: the expected grade, the probability of at least grade ``at_least`` (the highest rated grade by default) and
whether that reaches ``keep_at``. Defined cases: null and empty texts have score 0, which is the ratings' common
level; null ratings, and ratings of documents that don't exist, are left out; with fewer than two different grades
nothing can be told apart, so the expected grade is the only one (or null) and every document is kept; a null
``doc_id`` stays null; repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens remembered per worker, those of up to so many characters.
REMEMBER, REMEMBER_CHARS = 250_000, 40
#: A document whose tokens all have a feature has this value of it.
SCALE = 10.0

_small, _large, _number = re.compile(r"[^\W\d_A-Z]+"), re.compile(r"[A-Z]+"), re.compile(r"[0-9]+")


def token_features(token: str, dims: int) -> tuple[int, int]:
    """The places of a token's lower-case form and of its shape; place 0 is for repeats."""
    shape = _number.sub("0", _large.sub("A", _small.sub("a", token)))
    half = dims // 2
    return 1 + zlib.crc32(token.lower().encode("utf-8", "replace")) % (half - 1), half + zlib.crc32(shape.encode("utf-8", "replace")) % half


def repeats(tokens: list[str]) -> int:
    """Tokens that equal the one before them."""
    return sum(map(eq, tokens, tokens[1:]))


@dataclass
class Ordinal:
    """``grades`` in order, ``thresholds`` between them, and the weights."""

    grades: list[float]
    thresholds: np.ndarray
    weights: np.ndarray

    def below(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for all but the last grade, one row per score."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))

    def expected(self, score: np.ndarray) -> np.ndarray:
        cdf = np.c_[self.below(score), np.ones(len(score))]
        return np.diff(np.c_[np.zeros(len(score)), cdf], axis=1) @ np.array(self.grades)

    def tail(self, score: np.ndarray, at_least: float) -> np.ndarray:
        k = sum(g < at_least for g in self.grades)
        if k == 0 or k > len(self.thresholds):
            return np.full(len(score), float(k == 0))
        return 1 - self.below(score)[:, k - 1]


def fit_ordinal(rows: np.ndarray, places: np.ndarray, values: np.ndarray, grade: np.ndarray, dims: int, steps: int = 200, ridge: float = 1e-4) -> Ordinal:
    """Adam on the mean log likelihood; entry (row, place) of the feature matrix is ``values``."""
    grades = sorted(set(grade.tolist()))
    y, n, k = np.searchsorted(grades, grade), len(grade), len(grades)
    share = np.cumsum(np.bincount(y, minlength=k))[:-1] / n
    first = np.log(share / (1 - share))
    raw = np.r_[first[:1], np.log(np.maximum(np.diff(first), 1e-3))]  # ordered whatever the steps do
    w = np.zeros(dims)
    mean, square = np.zeros(dims + k - 1), np.zeros(dims + k - 1)
    sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -60, 60)))
    for step in range(1, steps + 1):
        theta = np.cumsum(np.r_[raw[:1], np.exp(raw[1:])])
        score = np.bincount(rows, values * w[places], n)
        bounds = np.r_[-1e9, theta, 1e9]
        hi, lo = sig(bounds[y + 1] - score), sig(bounds[y] - score)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        d_score = (d_hi - d_lo) / n  # of the negative log likelihood
        d_theta = (np.bincount(y + 1, -d_hi, k + 1) + np.bincount(y, d_lo, k + 1))[1:k] / n
        d_raw = np.cumsum(d_theta[::-1])[::-1] * np.r_[1.0, np.exp(raw[1:])]
        grad = np.r_[np.bincount(places, values * d_score[rows], dims) + ridge * w, d_raw]
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, raw = w - move[:dims], raw - move[dims:]
    return Ordinal(grades, np.cumsum(np.r_[raw[:1], np.exp(raw[1:])]), w)


def counted(docs: DataFrame, dims: int) -> DataFrame:
    """``docs`` with ``places``, ``counts`` and the number of tokens ``n`` in place of ``text``."""
    keep = [c for c in docs.columns if c != "text"]

    def run(batches):
        for b in batches:
            places, counts, sizes = [], [], []
            for text in b.column("text").to_pylist():
                tokens = (text or "").split()
                found = np.array([p for t in tokens for p in token_features(t, dims)] + [0] * repeats(tokens), np.int64)
                at, n = np.unique(found, return_counts=True)
                places.append(at)
                counts.append(n)
                sizes.append(len(tokens))
            columns = [pa.array(places, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64())), pa.array(sizes, pa.int64())]
            yield pa.record_batch([*(b.column(c) for c in keep), *columns], names=[*keep, "places", "counts", "n"])

    schema = docs.select(*keep).schema.add("places", T.ArrayType(T.LongType())).add("counts", T.ArrayType(T.LongType())).add("n", T.LongType())
    return docs.select(*keep, "text").mapInArrow(run, schema)


def fit(docs: DataFrame, ratings: DataFrame, grade: str, dims: int = 1 << 16, sample: int = 6000, seed: int = 3, longest: int = 1 << 17) -> Ordinal | None:
    """The model from rated documents, or None with fewer than two different grades among them."""
    rated = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(grade).cast("double").alias("grade")).dropna()
    rated = rated.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    some = rated.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a broadcast of ``sample`` rows of two numbers at most
    one = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "grade")).alias("one"))
    short = one.select("one.text", "one.grade").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    pdf = counted(short, dims).toPandas()
    if pdf["grade"].nunique() < 2:
        return None
    rows = np.repeat(np.arange(len(pdf)), pdf["places"].map(len))
    total = np.maximum(1, pdf["n"].to_numpy())
    values = np.concatenate(pdf["counts"].to_numpy()) / total[rows] * SCALE
    return fit_ordinal(rows, np.concatenate(pdf["places"].to_numpy()), values, pdf["grade"].to_numpy(), dims)


def scores(texts: list[str | None], model: Ordinal, known: dict[str, float]) -> np.ndarray:
    dims, weights, out = len(model.weights), model.weights, np.zeros(len(texts))
    for i, text in enumerate(texts):
        tokens = text.split() if text else ()
        total = 0.0
        for t in tokens:
            if (v := known.get(t)) is None:
                a, b = token_features(t, dims)
                v = float(weights[a] + weights[b])
                if len(t) <= REMEMBER_CHARS:
                    if len(known) >= REMEMBER:
                        known.clear()
                    known[t] = v
            total += v
        if tokens:
            out[i] = (total + weights[0] * repeats(tokens)) * SCALE / len(tokens)
    return out


def judgement(spark: SparkSession, text: Column, model: Ordinal | None, at_least: float | None = None, keep_at: float = 0.5) -> Column:
    """A struct of ``expected_grade``, ``tail_probability`` and ``kept`` for a text column."""
    if model is None:
        return F.struct(F.lit(None).cast("double").alias("expected_grade"), F.lit(1.0).alias("tail_probability"), F.lit(True).alias("kept"))
    shared = spark.sparkContext.broadcast(model)  # ``dims`` numbers
    at_least = model.grades[-1] if at_least is None else at_least
    known: dict[str, float] = {}

    @F.pandas_udf("expected_grade double, tail_probability double, kept boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        s = scores(texts.tolist(), shared.value, known)
        tail = shared.value.tail(s, at_least)
        return pd.DataFrame({"expected_grade": shared.value.expected(s), "tail_probability": tail, "kept": tail >= keep_at})

    return judge(text.cast("string"))


def grade(docs: DataFrame, model: Ordinal | None, at_least: float | None = None, keep_at: float = 0.5) -> DataFrame:
    """``doc_id, expected_grade, tail_probability, kept`` for each document."""
    judged = judgement(docs.sparkSession, F.col("text"), model, at_least, keep_at)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), judged.alias("judged")).select("doc_id", "judged.*")


def keep(docs: DataFrame, model: Ordinal | None, at_least: float | None = None, keep_at: float = 0.5) -> DataFrame:
    """The documents that are kept, with all their columns."""
    return docs.where(judgement(docs.sparkSession, F.col("text"), model, at_least, keep_at)["kept"])
