"""Operator 2, quality classifier: Naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowfeat.llm._spark import table
from flowfeat.llm._text import flat, mix, release, runs, slices, span_hashes, word_points

BUCKETS, SAMPLE, SMOOTH, COST, ROUNDS, THRESHOLD = 1 << 18, 5_000, 1.0, 0.1, 12, 0.3
LONGEST_SHAPE = 4


def _ngrams(values: np.ndarray, off: np.ndarray, sizes: range, salt: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, hash) of every n-gram of each size that lies within one text."""
    n = len(values)
    count = np.diff(off)
    text = np.repeat(np.arange(len(count)), count)
    left = np.repeat(off[1:], count) - np.arange(n)
    acc = np.full(n, salt, np.uint64)
    out = []
    for k in range(sizes.stop - 1):
        at = np.minimum(np.arange(n) + k, max(n - 1, 0))
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + values[at]
        if k + 1 in sizes:
            ok = left > k
            out.append((text[ok], mix(acc[ok] + np.uint64(k))))
    return out


def features(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(features, offsets): the distinct hashed n-grams of each whole text.

    Three views: words (1, 2), in lower case; shapes, where a run of small letters, capitals or digits is one sign and any
    other character stands for itself (1 to ``LONGEST_SHAPE``); and repeats, the steps back to a word's last occurrence if
    it is one of the three words before (1 to 3).
    """
    points, off = flat(texts)
    is_word, low = word_points()
    n_texts = len(off) - 1
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(n_texts + 1, np.int64)
    word = is_word[points]
    s, e = runs(word, off)
    h = span_hashes(low[points], s, e) if len(s) else np.zeros(0, np.uint64)
    words = np.searchsorted(s, off)
    lower = low[points]
    sign = np.where(~word, points, np.where((points >= 48) & (points <= 57), 1, np.where(lower != points, 2, 3))).astype(np.uint64)
    head = np.ones(len(points), bool)
    head[1:] = (sign[1:] != sign[:-1]) | (sign[1:] > 3)
    inner = off[:-1][off[:-1] < len(points)]
    head[inner] = True
    shape, shape_off = sign[head], np.concatenate(([0], np.cumsum(head)))[off]
    back = np.zeros(len(h), np.uint64)
    begin = np.repeat(words[:-1], np.diff(words))
    for k in (3, 2, 1):
        at = np.arange(len(h)) - k
        back[(at >= begin) & (h[np.maximum(at, 0)] == h)] = k
    grams = _ngrams(h, words, range(1, 3), 1) + _ngrams(shape, shape_off, range(1, LONGEST_SHAPE + 1), 2) + _ngrams(back, words, range(1, 4), 3)
    text = np.concatenate([g[0] for g in grams])
    code = np.unique(text * buckets + (np.concatenate([g[1] for g in grams]) % np.uint64(buckets)).astype(np.int64))
    return code % buckets, np.searchsorted(code // buckets, np.arange(n_texts + 1))


def descend(x: np.ndarray, off: np.ndarray, scale: np.ndarray, y: np.ndarray, cost: float = COST, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Linear hinge-loss weights by dual coordinate descent.

    The dual has one variable per text, between 0 and ``cost``; a step sets one of them to its best value with the others
    fixed and moves the weights along that text. Values of a text's features are the scales, divided by its norm.
    """
    w, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(y))
    rows = [x[a:b] for a, b in zip(off[:-1], off[1:])]
    norm = np.array([max(np.sqrt((scale[r] ** 2).sum()), 1e-9) for r in rows])
    rng = np.random.default_rng(11)
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            r = rows[i]
            v = scale[r] / norm[i]
            gradient = y[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), cost)  # each text has norm 1 and a bias of 1
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def margins(x: np.ndarray, off: np.ndarray, scaled: np.ndarray, scale: np.ndarray, bias: float) -> np.ndarray:
    """w . v + bias of each text, v scaled to norm 1."""
    total = np.concatenate(([0.0], np.cumsum(scaled[x])))
    square = np.concatenate(([0.0], np.cumsum(scale[x] ** 2)))
    return (total[off[1:]] - total[off[:-1]]) / np.sqrt(np.maximum(square[off[1:]] - square[off[:-1]], 1e-18)) + bias


def calibrate(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to the share of label 1, by Newton's steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - y) * m).sum() + 1e-3 * a, (p - y).sum()])
        q = np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(q * m * m).sum() + 1e-3, (q * m).sum()], [(q * m).sum(), q.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


class Scorer(NamedTuple):
    """score = 1 / (1 + exp(-(slope * margin + shift))), where a text's margin is the sum of ``scaled`` over its distinct
    features, divided by the norm of their ``scale`` (log-count ratios), plus ``bias``."""

    scaled: np.ndarray
    scale: np.ndarray
    bias: float
    slope: float
    shift: float


def train(texts: list[str | None], labels: list[int], buckets: int = BUCKETS) -> Scorer:
    """A model of texts at hand."""
    parts = [features(texts[i:j], buckets) for i, j in slices(texts)]
    x = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    return solve(x, np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts])))) if parts else np.zeros(1, np.int64), np.array(labels, np.int64), buckets)


def solve(x: np.ndarray, off: np.ndarray, y: np.ndarray, buckets: int = BUCKETS) -> Scorer:
    """Log-count ratios of indicators, hinge-loss weights on 4 of 5 texts, the logistic curve on the fifth."""
    if len(set(y.tolist())) < 2:
        return Scorer(np.zeros(buckets), np.zeros(buckets), 0.0, 0.0, 30.0 if len(y) and y[0] else -30.0 if len(y) else 0.0)
    aside = np.arange(len(y)) % 5 == 4
    text = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(off))
    use = ~aside[text]
    p, q = (SMOOTH + np.bincount(x[use & (y[text] == k)], minlength=buckets) for k in (1, 0))
    scale = np.log((p / p.sum()) / (q / q.sum()))
    scale[(p + q) <= 2 * SMOOTH + 1] = 0  # a feature of one text tells nothing
    keep = scale[x] != 0
    x, off = x[keep], np.concatenate(([0], np.cumsum(keep)))[off]
    fit = np.flatnonzero(~aside)
    rows = np.concatenate([x[off[i] : off[i + 1]] for i in fit])
    w, bias = descend(rows, np.concatenate(([0], np.cumsum(np.diff(off)[fit]))), scale, 2.0 * y[fit] - 1)
    m = margins(x, off, w * scale, scale, bias)
    return Scorer(w * scale, scale, bias, *calibrate(m[aside], y[aside]))


def score(model: Scorer, texts: list[str | None]) -> np.ndarray:
    x, off = features(texts, len(model.scale))
    m = margins(x, off, model.scaled, model.scale, model.bias)
    return 1 / (1 + np.exp(-np.clip(model.slope * m + model.shift, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, buckets: int = BUCKETS) -> Scorer:
    """A model from whole texts, of any length, of at most ``sample`` labelled rows, those of least hash of the id.

    Features are made in tasks; the driver gets their numbers only, at most ``buckets`` for each of the rows. An id with several labels
    counts with its largest, one with several texts with that of least hash; null and other labels are void. Without both labels in the sample every
    score is the same.
    """
    drawn = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)

    def indicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in slices(texts):
                x, off = features(texts[i:j], buckets)
                yield pa.RecordBatch.from_arrays([b.column("h").slice(i, j - i), b.column("y").slice(i, j - i), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x.astype(np.int32)))], names=["h", "y", "x"])

    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    one = texts.join(F.broadcast(drawn), "id").groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))  # at most sample ids were drawn
    rows = one.select(F.xxhash64("id").alias("h"), "y", "text").mapInArrow(indicate, "h long, y int, x array<int>").toArrow().sort_by("h").combine_chunks()
    if not rows.num_rows:
        return solve(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), buckets)
    x = rows.column("x").combine_chunks()
    off = np.concatenate(([0], np.cumsum(x.value_lengths().to_numpy())))
    model = solve(x.flatten().to_numpy(), off, rows.column("y").to_numpy().astype(np.int64), buckets)
    release()
    return model


def quality_scores(docs: DataFrame, model: Scorer, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: the id, ``score`` (0 to 1, higher: label 1 likelier) of the whole text, and ``predicted``.

    No shuffle; the model is broadcast and its size fixed by the number of buckets. Null and empty texts have no features
    and get the score of the bias alone. Repeated rows give repeated rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model._replace(scaled=model.scaled.astype(np.float32), scale=model.scale.astype(np.float32)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            s = [score(held.value, texts[i:j]) for i, j in slices(texts, 600_000)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.concatenate(s) if s else np.zeros(0), pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(judge, f"`{id_col}` {kind}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit(docs.select("doc_id", "text"), labels.filter(~held_out).select("doc_id", "quality"))
    return quality_scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
