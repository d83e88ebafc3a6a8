"""Quality scores: random Fourier features over document statistics.

One pass over the texts writes a vector of statistics a document to the
shared folder; nothing after it reads texts again.  A Gaussian kernel over
the standardised statistics is approximated by random Fourier features; each
partition of the labelled rows sums its own normal equations, the sums are
added and solved as a ridge regression, and isotonic calibration (pooled
adjacent violators over score bins) turns the ridge scores into
probabilities, interpolated linearly between the pools.

The fit uses at most ``max_rows`` labelled rows (those with the least hash of
their id); standardisation, bins and the fit are over those rows, scores are
given to every document.  Neither id, source, language nor label is an input
of a score.

Defined results: null and empty texts have the statistics of an empty text
and a score like any other; repeated ids each get their own row, and are
labelled once each; labels that are null or not 0 or 1 are not learned; with
no label, or one class only, the score is that class's rate (0.5 with none);
an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import documents

#: Random features, kernel width on standardised statistics, ridge, score bins.
FEATURES, GAMMA, RIDGE, BINS = 192, 0.05, 1.0, 200
N_STATS = 18


def statistics(text: str) -> list[float]:
    """Statistics of a whole text, from its byte histogram, words and lines."""
    raw = text.encode("utf-8", "surrogatepass")
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, n_words, n_lines = max(len(raw), 1), max(len(words), 1), max(len(lines), 1)
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lower, upper, digits = int(h[97:123].sum()), int(h[65:91].sum()), int(h[48:58].sum())
    distinct = len(set(words))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    share = lambda *codes: sum(int(h[c]) for c in codes) / n
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        len(raw) / n_words,
        lower / n,
        upper / max(upper + lower, 1),
        digits / n,
        int(h[128:].sum()) / n,
        share(33),
        share(124),
        share(35, 36, 37, 38, 42, 60, 62),
        share(44, 46),
        share(10) * 10,
        distinct / n_words,
        1 - len(set(lines)) / n_lines if lines else 0.0,
        1 - len(set(windows)) / max(len(windows), 1) if windows else 0.0,
        np.log1p(len(words) / n_lines),
        np.log1p(max(map(len, words), default=0)),
        np.log1p(n_lines),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``stats`` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "stats"])

    typed = documents(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return typed.mapInArrow(run, "doc_id bigint, stats array<double>")


class Model:
    """Standardisation, random features, ridge weights and calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.freq = rng.normal(0, np.sqrt(2 * GAMMA), (len(mean), FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.knots = (np.array([0.0]), np.array([0.5]))

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.freq + self.phase), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.knots), 0, 1)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nondecreasing values nearest to ``values`` (pooled adjacent violators)."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools[-1]
            pools[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([p[0] for p in pools], [p[2] for p in pools])


def _stack(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column(0).values).reshape(len(batch), -1)


def fit(train: DataFrame, seed: int = 7, partitions: int = 8) -> Model:
    """A model from rows ``stats`` and ``label`` (0 or 1)."""
    train = train.select("stats", F.col("label").cast("double").alias("label")).repartition(partitions)
    n, positive = train.agg(F.count("*"), F.sum("label")).first()
    if not n or positive in (0, n):
        model = Model(np.zeros(N_STATS), np.ones(N_STATS), seed)
        model.knots = (np.array([0.0]), np.array([positive / n if n else 0.5]))
        return model
    columns = [F.col("stats")[i] for i in range(N_STATS)]
    moments = train.agg(*[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    mean, scale = np.array(moments[:N_STATS]), np.array(moments[N_STATS:])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), seed)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            if len(batch):
                x = model.features(_stack(batch))
                a += x.T @ x
                b += x.T @ np.asarray(batch.column(1))
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()])], ["a", "b"])

    a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
    for row in train.mapInArrow(equations, "a binary, b binary").collect():  # a row a partition
        a += np.frombuffer(row.a).reshape(a.shape)
        b += np.frombuffer(row.b)
    model.weights = np.linalg.solve(a + RIDGE * np.diag([1.0] * FEATURES + [1e-6]), b)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(_stack(batch))), batch.column(1)], ["raw", "label"])

    scored = train.mapInArrow(scores, "raw double, label double")
    cell = F.least(F.greatest(F.floor((F.col("raw") + 0.5) * (BINS / 2)), F.lit(0)), F.lit(BINS - 1))
    bins = scored.groupBy(cell.alias("cell")).agg(F.avg("raw").alias("x"), F.avg("label").alias("y"), F.count("*").alias("n"))
    found = sorted(bins.collect(), key=lambda r: r.x)  # at most BINS rows
    x, y, w = (np.array([r[k] for r in found], float) for k in ("x", "y", "n"))
    model.knots = (x, isotonic(y, w))
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of each row of statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(model.score(_stack(batch)))], ["doc_id", "score"])

    return stats.select("stats", "doc_id").mapInArrow(run, "doc_id bigint, score double")


def learn_and_score(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", max_rows: int = 40_000) -> DataFrame:
    """``doc_id`` and ``score`` of every document.

    ``labels`` has ``doc_id`` and ``label_col``; its rows where ``learn``
    holds are the training rows, at most ``max_rows`` of them.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "statistics")
    with_statistics(docs).write.parquet(path)
    stats = spark.read.parquet(path)
    known = labels.where(learn & F.col(label_col).isin(0, 1)).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).alias("label"))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    model = fit(stats.join(F.broadcast(known), "doc_id"))  # at most max_rows small rows
    return scored(stats, model)
