"""Hard negatives by segment summary filtering.

A vector's components times ``scale``, rounded down, are its integers; a
score is the integer inner product of an anchor with another row.  An anchor's
positives are its highest-scoring rows of the same label; for each positive the
negatives are the highest-scoring rows of other labels whose score lies within
two shares of the positive's.  Equal scores go by ascending id.

Summaries: a vector is cut into segments, ``LEVELS`` of them, each level finer
than the one before.  Of each segment the mean m and the deviation d (root of
the summed squared differences from the mean) are stored beside the vector.
For a segment of length n the inner product lies within n m m' - d d' and
n m m' + d d', so the sums over a level's segments bound the score from both
sides.  A task takes the coarsest level for a block of anchors and a run of
rows as two small matrix products, drops the rows and anchors whose bounds fit no
anchor's interval of scores still wanted, refines what is left by the next
level, and computes exact scores of the rest.

Work: the integers and summaries are written once.  Anchors come in blocks of
``BLOCK_BYTES``; each block travels with its jobs, which pass over all rows and
keep the best of each anchor in a task.  The anchors among themselves are
searched first: their scores are those of rows, so the last wanted one
bounds the answer from below, and tasks send only what can still be in it.
A block's answer is written before the next block begins.

Defined results: rows without an id, a label or a vector, or with a null or
non-finite component, take no part; vectors of different lengths are compared on their
common first components; an empty vector scores 0 with all; repeated rows
are rows of their own (several places, none among those of its own id); an anchor id on several
rows is one anchor (its least label, then vector); an anchor without another row of its label
has no positives and no result; an empty table gives an empty result; further columns are left
out.  Scores and integers have to fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import drop_path, scratch_path

#: Segments of a vector, level by level (at most one a component).
LEVELS = (1, 4, 16)
#: Bytes of anchors searched for in one pass over the rows, about.
BLOCK_BYTES = 8 << 20
#: Scores of anchors and rows computed at once.
CELLS = 2_000_000
#: Candidates after which a task keeps only the best.
POOL = 500_000
FAR = 2**62

_STORED = "vec_id bigint, label bigint, anchor boolean, ints array<bigint>, summary array<float>"


def segments(length: int) -> list[np.ndarray]:
    """The cuts of a vector of ``length`` components, for each level that it has."""
    return [np.arange(n + 1) * length // n for n in LEVELS if n <= length]


def summaries(ints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of rows of one length, by level: means times the root of the segment's length, and deviations."""
    out = []
    for cuts in segments(ints.shape[1]):
        n = np.diff(cuts)
        total = np.add.reduceat(ints.astype(np.float64), cuts[:-1], axis=1)
        square = np.add.reduceat(np.square(ints.astype(np.float64)), cuts[:-1], axis=1)
        mean = total / np.sqrt(n)
        out.append((mean, np.sqrt(np.maximum(square - np.square(mean), 0))))
    return out


def stored(vectors: DataFrame, is_anchor: Column, scale: float) -> DataFrame:
    """The rows that take part, with their integers and summaries (level by level, means before deviations)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.diff(batch.column(3).offsets.to_numpy())
            begin = np.cumsum(length) - length
            ints = np.floor(scale * batch.column(3).flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                own = ints[begin[rows][:, None] + np.arange(n)]
                flat = [np.concatenate(x, axis=1) for x in summaries(own)]
                flat = np.concatenate([np.zeros((len(rows), 0)), *flat], axis=1).astype(np.float32)
                lists = [pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel())) for x in (own, flat)]
                kept = [batch.column(c).take(pa.array(rows)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*kept, *lists], ["vec_id", "label", "anchor", "ints", "summary"])

    fine = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    takes_part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(fine, F.lit(False))
    typed = vectors.where(takes_part).select(
        F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col("vector").cast("array<double>")
    )
    return typed.mapInArrow(run, _STORED)


class Rows:
    """Rows of one length: ids, labels, integers and the summaries of each level."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, ints: np.ndarray, flat: np.ndarray):
        self.ids, self.labels, self.ints = ids, labels, ints
        self.levels, at = [], 0
        for cuts in segments(ints.shape[1]):
            n = len(cuts) - 1
            self.levels.append((flat[:, at : at + n], flat[:, at + n : at + 2 * n]))
            at += 2 * n
        # Rounding of the stored summaries stays far below this share of the two lengths' product.
        self.norm = np.sqrt(np.square(ints.astype(np.float64)).sum(axis=1)) * np.sqrt(1e-5)

    @staticmethod
    def of(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[np.ndarray, Rows]]:
        """The rows of each length (columns vec_id, label, ints, summary) and their numbers."""
        ids, labels = (table.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
        columns = [table.column(c) for c in ("ints", "summary")]
        ints, flat = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns)
        sizes = [np.diff(c.offsets.to_numpy()) for c in (ints, flat)]
        begins = [np.cumsum(s) - s for s in sizes]
        values = [c.flatten().to_numpy(zero_copy_only=False) for c in (ints, flat)]
        for n in np.unique(sizes[0]):
            rows = np.flatnonzero(sizes[0] == n)
            width = int(sizes[1][rows[0]])
            own = [v[b[rows][:, None] + np.arange(w)] for v, b, w in zip(values, begins, (n, width), strict=True)]
            yield rows, Rows(ids[rows], labels[rows], *own)

    def some(self, which: np.ndarray) -> Rows:
        out = object.__new__(Rows)
        out.ids, out.labels, out.ints, out.norm = self.ids[which], self.labels[which], self.ints[which], self.norm[which]
        out.levels = [(m[which], d[which]) for m, d in self.levels]
        return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows on their common first components, as 64-bit integers."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    if n and a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * n >= 2.0**53:
        return a @ b.T
    return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)


class Best:
    """The ``k`` best rows of each slot (an anchor's interval of scores), from rows given in any order."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low.copy(), high, k
        self.slot = self.score = self.row = np.zeros(0, np.int64)
        self.pool: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, anchors: np.ndarray, ids: np.ndarray, found: np.ndarray, allowed: np.ndarray) -> None:
        """``found``: scores of ``anchors`` with rows in ascending order of ``ids``, where ``allowed``."""
        width = self.low.shape[1]
        for nth in range(width):
            fits = allowed & (found >= self.low[anchors, nth][:, None]) & (found <= self.high[anchors, nth][:, None])
            full = np.flatnonzero(np.count_nonzero(fits, axis=1) > self.k)
            if len(full) and np.abs(found).max() < FAR // max(found.shape[1], 1):
                # Score and place as one number: the k greatest are the answer of these rows.
                key = np.where(fits[full], found[full] * found.shape[1] - np.arange(found.shape[1]), -2 * FAR)
                least = np.partition(key, -self.k, axis=1)[:, -self.k]
                fits[full] &= key >= least[:, None]
            x, y = np.nonzero(fits)
            if len(x):
                self.pool.append((anchors[x] * width + nth, found[x, y], ids[y]))
                self.size += len(x)
        if self.size > POOL:
            self.settle()

    def settle(self) -> None:
        """Only the best of each slot stay; the last one raises what is wanted."""
        self.slot, self.score, self.row = (np.concatenate(x) for x in zip((self.slot, self.score, self.row), *self.pool, strict=True))
        order = np.lexsort((self.row, -self.score, self.slot))
        own = self.slot[order]
        nth = np.arange(len(own)) - np.searchsorted(own, own)
        last = order[nth == self.k - 1]
        flat = self.low.reshape(-1)
        flat[self.slot[last]] = np.maximum(flat[self.slot[last]], self.score[last])
        order = order[nth < self.k]
        self.slot, self.score, self.row = self.slot[order], self.score[order], self.row[order]
        self.pool, self.size = [], 0


def search(anchors: Rows, numbers: np.ndarray, rows: Rows, same: bool, best: Best) -> None:
    """Gives ``best`` the scores of the anchors (at ``numbers`` in their block) with rows of the same or other labels that the bounds leave."""
    by_id = np.argsort(rows.ids, kind="stable")
    step = max(CELLS // max(len(numbers), 1), 1)
    for k in range(0, len(by_id), step):
        some = rows.some(by_id[k : k + step])
        if same:
            for label in np.intersect1d(some.labels, anchors.labels):
                which = np.flatnonzero(anchors.labels == label)
                _refined(anchors.some(which), numbers[which], some.some(np.flatnonzero(some.labels == label)), same, best)
        else:
            _refined(anchors, numbers, some, same, best)


def _refined(a: Rows, numbers: np.ndarray, b: Rows, same: bool, best: Best) -> None:
    if a.ints.shape[1] == b.ints.shape[1]:
        for level in range(len(a.levels)):
            (mean, dev), (mean_b, dev_b) = a.levels[level], b.levels[level]
            middle = mean @ mean_b.T
            reach = dev @ dev_b.T + a.norm[:, None] * b.norm[None, :] + 1
            low, high = best.low[numbers].min(axis=1), best.high[numbers].max(axis=1)
            live = (middle + reach >= low[:, None]) & (middle - reach <= high[:, None])
            if not same:
                live &= a.labels[:, None] != b.labels[None, :]
            x, y = np.flatnonzero(live.any(axis=1)), np.flatnonzero(live.any(axis=0))
            if not len(x):
                return
            a, numbers, b = a.some(x), numbers[x], b.some(y)
    allowed = a.ids[:, None] != b.ids[None, :]
    if not same:
        allowed &= a.labels[:, None] != b.labels[None, :]
    best.add(numbers, b.ids, scores(a.ints, b.ints), allowed)


def _found(rows: DataFrame, block: list[tuple[np.ndarray, Rows]], ids: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> DataFrame:
    """The ``k`` best rows (``row_id``, ``score``, ``rank``) of each slot (``anchor_id``, ``nth``) of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(low, high, k)
        for batch in batches:
            for _, own in Rows.of(batch):
                for numbers, anchors in block:
                    search(anchors, numbers, own, same, best)
        best.settle()
        anchor, nth = np.divmod(best.slot, low.shape[1])
        columns = [ids[anchor], nth, best.score, best.row]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "nth", "score", "row_id"])

    found = rows.select("vec_id", "label", "ints", "summary").mapInArrow(run, "anchor_id bigint, nth bigint, score bigint, row_id bigint")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "nth").orderBy(F.desc("score"), "row_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _by_slot(found: DataFrame, ids: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and rows of ``found`` (at most ``k`` for each slot of a block) by anchor, place and rank; ``-FAR`` where there is none."""
    table = found.select("anchor_id", "nth", "rank", "score", "row_id").toArrow()
    anchor, nth, rank, score, row = (table.column(c).to_numpy() for c in range(5))
    out, own = np.full((len(ids), width, k), -FAR), np.zeros((len(ids), width, k), np.int64)
    at = (np.searchsorted(ids, anchor), nth, rank - 1)
    out[at], own[at] = score, row
    return out, own


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, scale: float = 256.0
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``vectors`` has ``vec_id``, ``label`` and ``vector``; ``is_anchor`` tells
    the anchors.  A negative fits a positive if its score is from ``least`` to
    ``most`` hundredths of the positive's.
    """
    spark = vectors.sparkSession
    paths = [scratch_path(spark, name) for name in ("vectors", "anchors", "negatives")]
    stored(vectors, is_anchor, scale).write.parquet(paths[0])
    rows = spark.read.parquet(paths[0])
    alike = F.min(F.struct("label", "ints", "summary")).alias("own")
    rows.where("anchor").groupBy("vec_id").agg(alike).select("vec_id", "own.*").write.parquet(paths[1])
    anchors = spark.read.parquet(paths[1])
    size = anchors.agg(F.sum(8 * F.size("ints") + 4 * F.size("summary") + 64)).first()[0] or 0
    n = int(size // BLOCK_BYTES) + 1
    for k in range(n):
        table = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == k).orderBy("vec_id").toArrow()
        _mined(rows, anchors, table, positives, negatives, least, most).write.mode("append").parquet(paths[2])
    for path in paths[:2]:
        drop_path(spark, path)
    return spark.read.parquet(paths[2])


def _mined(rows: DataFrame, anchors: DataFrame, table: pa.Table, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    """The result for the anchors in ``table``, one block."""
    ids, block = table.column("vec_id").to_numpy(), list(Rows.of(table))

    def best(same: bool, low: np.ndarray, high: np.ndarray, k: int) -> DataFrame:
        # First among the anchors: their last wanted score bounds the answer from below.
        seen, _ = _by_slot(_found(anchors, block, ids, same, low, high, k), ids, low.shape[1], k)
        return _found(rows, block, ids, same, np.maximum(low, seen[:, :, k - 1]), high, k)

    wide = (len(ids), 1)
    score, row = _by_slot(best(True, np.full(wide, -FAR), np.full(wide, FAR), positives), ids, 1, positives)
    score, row = score[:, 0], row[:, 0]
    some = score > -FAR
    low = np.where(some, -(-least * np.where(some, score, 0) // 100), FAR)
    high = np.where(some, most * np.where(some, score, 0) // 100, -FAR)
    found = best(False, low, high, negatives)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, nth, rank, score_, row_ = (batch.column(c) for c in range(5))
            at = (np.searchsorted(ids, anchor.to_numpy()), nth.to_numpy())
            columns = [anchor, pa.array(row[at]), rank, row_, pa.array(score[at]), score_]
            yield pa.RecordBatch.from_arrays(columns, ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return found.select("anchor_id", "nth", "rank", "score", "row_id").mapInArrow(named, schema)


def brute_force(vectors: list[tuple], anchors: set, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100) -> list[tuple]:
    """The result for (id, label, integers) rows, by all scores; for tests."""
    out = []
    for a in sorted(anchors):
        _, label, own = min(v for v in vectors if v[0] == a)
        scored = [(sum(x * y for x, y in zip(own, v, strict=False)), i, other) for i, other, v in vectors if i != a]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, i, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and least * p <= 100 * s[0] <= most * p][:negatives]
            out += [(a, i, k, j, p, s) for k, (s, j, _) in enumerate(fit, 1)]
    return out
