"""Quality scores by Bradley-Terry ranking of document pairs.

A document is a vector of text statistics (rates of byte classes, of repeated and capital words, of symbols, word and line
shape), computed in one map pass over whole texts. Pairs of a preferred (label 1) and a rejected (label 0) document are drawn
from labelled rows; the probability that the first wins is the logistic of the difference of two linear scores, and the weights
minimise that logistic loss with a small ridge term. The decision threshold is the quantile of the scores at the share of
rejected labels, and a reported score is the logistic of the distance to it, so 0.5 is the threshold.

Scale: the model is fitted on at most ``max_labelled`` labelled rows (smallest hash of doc_id; a documented bound, a few MB on
the driver, whatever the corpus). Scoring is a map over all rows without a shuffle.

Null and empty texts have the vector of an empty text and are scored like any other. Unlabelled rows, rows with a null label and
duplicated labels are allowed: labels of one doc_id are averaged, a tie is no label. Without both labels all scores are 0.5.
Statistics see bytes only: never labels, lang, source or doc_id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import crc_fold, table, with_text_columns
from .words import GRAPHIC, words_of

MAX_LABELLED = 20_000
PAIRS = 8  # preference pairs for each document of the rarer label
_VECTOR = T.StructType([T.StructField("features_", T.ArrayType(T.FloatType()))])


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of statistics for each text."""
    n = len(bounds) - 1
    length = np.diff(bounds)
    row = np.repeat(np.arange(n), length)
    kinds = np.minimum(data, 128).astype(np.int64)
    seen = np.bincount(row * 129 + kinds, minlength=n * 129).reshape(n, 129)[:, 32:]
    rates = np.sqrt(seen / np.maximum(length, 1)[:, None])
    words = words_of(data, bounds, GRAPHIC)
    count, owner = words.counts, words.row
    many = np.maximum(count, 1)

    def share(flag):
        return np.bincount(owner[: len(flag)], flag, minlength=n) / many
    size = words.end - words.start
    upper = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 65) & (data <= 90), out=upper[1:])
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 33) & (data <= 47) | (data >= 58) & (data <= 64) | (data >= 91) & (data <= 96) | (data >= 123) & (data <= 126), out=marks[1:])
    caps = upper[words.end] - upper[words.start]
    signs = marks[words.end] - marks[words.start]
    same = (words.hash[1:] == words.hash[:-1]) & (owner[1:] == owner[:-1]) if len(owner) > 1 else np.zeros(0, bool)
    order = np.lexsort((words.hash, owner))
    first = np.ones(len(order), bool)
    if len(order) > 1:
        first[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][first], minlength=n) / many
    shape = np.stack([
        np.log1p(length), np.log1p(count), np.bincount(owner, size, minlength=n) / many / 10, share(size <= 2), share(size >= 12),
        share(caps >= 2), share((caps >= 2) & (caps + signs >= size)), share(signs >= 2), share(signs >= 3), share(signs == size), share(same), distinct,
        distinct * np.log1p(count), np.bincount(row, data == 10, minlength=n) / many,
        np.sqrt(share(caps >= 2)), np.sqrt(share(signs >= 2)), np.sqrt(share(signs == size)), np.sqrt(share(same)),
    ], 1)
    return np.concatenate([rates, shape], 1).astype(np.float32)


def fit(vectors: np.ndarray, labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and threshold from labelled vectors."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    weights = np.zeros(vectors.shape[1])
    if not len(good) or not len(bad):
        return weights, 0.0
    centre, spread = vectors.mean(0), vectors.std(0) + 1e-3
    scaled = (vectors - centre) / spread
    rng = np.random.default_rng(seed)
    n = PAIRS * min(len(good), len(bad)) + max(len(good), len(bad))
    winners, losers = good[np.arange(n) % len(good)], bad[rng.permutation(np.arange(n) % len(bad))]
    gap = scaled[winners] - scaled[losers]
    for _ in range(25):  # Newton steps on the logistic loss of the differences
        p = 1 / (1 + np.exp(np.clip(gap @ weights, -30, 30)))
        gradient = gap.T @ p / n - 1e-3 * weights
        curvature = (gap * (p * (1 - p))[:, None]).T @ gap / n + 1e-3 * np.eye(len(weights))
        step = np.linalg.solve(curvature, gradient)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    scores = scaled @ weights
    low, high = np.sort(scores)[[len(bad) - 1, len(bad)]]  # the quantile at the share of rejected labels
    weights = weights / spread
    return weights, float(centre @ weights + (low + high) / 2)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """A model from the labels whose crc32(doc_id) mod 3 is not 1."""
    known = labels.filter(crc_fold(F.col("doc_id"), 3) != 1).groupBy("doc_id").agg(F.avg("quality").alias("label_"))
    known = known.filter("label_ <> 0.5 and doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # the broadcast is bounded by max_labelled
    rows = rows.select((F.col("label_") > 0.5).cast("int").alias("label_"), "text")
    found = with_text_columns(rows, lambda r, d, b: [list(features(d, b))], _VECTOR, ["label_"]).toArrow()
    if not found.num_rows:
        return np.zeros(features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]), 0.0
    vectors = found.column(1).combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1).astype(float)
    order = np.lexsort(vectors.T)  # the same model in whatever order rows arrive
    return fit(vectors[order], found.column(0).to_numpy()[order])


def scored(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` columns and the score, 0 to 1."""
    weights, threshold = model

    def compute(rows, data, bounds):
        return [1 / (1 + np.exp(-np.clip(features(data, bounds) @ weights - threshold, -30, 30)))]
    return with_text_columns(docs, compute, T.StructType([T.StructField(name, T.DoubleType())]), keep)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model, ["doc_id"]).select(
        "doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
