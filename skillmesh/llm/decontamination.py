"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are normalised: lower case, every run of ASCII characters
but letters and digits is one space, UTF-8 bytes; all characters beyond ASCII stay, so
curly quotes and dashes cost edits against plain ones.  An item is cut into
segments of ``SEGMENT`` bytes, one every ``STEP``, and of ``PART`` bytes, one
every half of that (an item of up to ``PART`` bytes is a segment as a whole); a
document holds an item if some segment lies in it within the segment's edit
budget (one edit in ten bytes).  So an unchanged run of ``SEGMENT`` bytes is
found wherever it begins.  Items under ``LEAST`` bytes are held if they lie in
the document unchanged, from word border to word border.

By the q-gram lemma a segment of L bytes within k edits of a region shares at
least L - q + 1 - k q of its q-grams with it, on diagonals at most k apart.
In each run of texts, as many of a segment's q-grams are left out, those that
the texts hold most often, as leave a bound of ``SHARED``; a segment with fewer
of its q-grams in all the texts than its bound is left out as a whole.
Each task counts the q-grams that a text shares with a segment in bands of
diagonals twice as wide as that and overlapping by half, keeps the bands that
meet the bound, and verifies them by an edit distance inside the band.

The benchmark is put into blocks of bounded size; each block's q-gram index
travels with the job, and every whole text is searched for every block.
Nothing is shuffled.

Defined results: null and empty texts and items hold nothing; alignments do
not pass from one text to the next; an item under ``LEAST`` bytes counts as one
segment without edits; repeated documents each get their own rows; items with one text each match (ties stay);
repeated item ids count as one item with several texts, repeated rows as one; empty tables give an
empty result; further columns are left out by ``find``, kept by ``remove``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, gives_back, mix64

Q, SEGMENT, STEP, PART, LEAST = 8, 64, 12, 128, 40
#: Bytes of segment for each edit of the budget.
BYTES_AN_EDIT = 10
#: Q-grams that a segment has to share at least after the commonest are left out.
SHARED = 8
#: Half the width of a band of diagonals.
HALF = PART // BYTES_AN_EDIT + 1
#: Bytes of benchmark text in a block, on average.
BLOCK_BYTES = 4_000_000
#: Bytes of documents searched at once.
AT_ONCE = 700_000

_KEPT = np.full(256, 32, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _KEPT[_c] = _c
_KEPT[128:] = np.arange(128, 256)
_KEPT[0] = 0


def normalised(texts: list[str]) -> np.ndarray:
    """The normalised bytes of the texts, a zero byte before each."""
    clean = [t.replace("\0", " ") if "\0" in t else t for t in texts]
    raw = ("\0" + "\0".join(clean)).lower().encode("utf-8", "surrogatepass")
    b = _KEPT[np.frombuffer(raw, np.uint8)]
    return b[(b != 32) | (np.concatenate([[0], b[:-1]]) != 32)]


def grams(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``Q`` bytes from each position on."""
    n = len(b) - Q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    one = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        two = b[:-1] * one + b[1:]
        four = two[:-2] * (one * one) + two[2:]
        return mix64(four[:n] * (one ^ np.uint64(0x5BD1E995)) + four[4 : 4 + n])


def _packed(b: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes (8 at most) from each place on as one number."""
    out = np.zeros(len(at), np.uint64)
    for i in range(width):
        out = out << np.uint64(8) | b[at + i].astype(np.uint64)
    return out


class Index:
    """The q-grams of the segments of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        segments: list[tuple[int, bytes]] = []
        short: set[tuple[int, bytes]] = set()
        for item, text in items:
            b = normalised([text])[1:].tobytes().strip()
            if len(b) < LEAST:
                short |= {(item, b)} if b else set()
                continue
            own = set()
            for width, step in ((SEGMENT, STEP), (PART, PART // 2)):
                cuts = range(0, max(len(b) - width, 0) + 1, step)
                own |= {b[c : c + width] for c in cuts} | {b[-width:]}
            segments += [(item, s) for s in sorted(own)]
        self.short = sorted(short)
        self.short_length = np.array([len(s) for _, s in self.short], np.int64)
        self.short_bytes = np.zeros((len(self.short), LEAST), np.uint8)
        for k, (_, s) in enumerate(self.short):
            self.short_bytes[k, : len(s)] = np.frombuffer(s, np.uint8)
        self.item = np.array([i for i, _ in segments], np.int64)
        self.length = np.array([len(s) for _, s in segments], np.int64)
        self.bytes = np.zeros((len(segments), PART), np.uint8)
        gram, of, at = [], [], []
        for k, (_, s) in enumerate(segments):
            self.bytes[k, : len(s)] = np.frombuffer(s, np.uint8)
            g = grams(np.frombuffer(s, np.uint8))
            gram.append(g)
            of.append(np.full(len(g), k))
            at.append(np.arange(len(g)))
        self.budget = self.length // BYTES_AN_EDIT
        self.bound = self.length - Q + 1 - self.budget * Q
        # The lemma needs a bound of one q-gram at least.
        low = self.bound < 1
        self.budget[low] = (self.length[low] - Q) // Q
        self.bound = self.length - Q + 1 - self.budget * Q
        gram = np.concatenate(gram) if gram else np.zeros(0, np.uint64)
        of = np.concatenate(of) if of else np.zeros(0, np.int64)
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.gram, first = np.unique(gram[order], return_index=True)
        self.first = np.append(first, len(gram))
        self.of, self.at = of[order], at[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.gram >> np.uint64(42)).astype(np.int64)] = True

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """Text number, item, its segments found and their fewest edits."""
        if not texts:
            return []
        b = normalised(texts)
        starts = np.flatnonzero(b == 0)
        found: dict[tuple[int, int], tuple[set, int]] = {}
        for where, number, item, edits in (self._segments(b), self._shorts(b)):
            text = np.searchsorted(starts, where, side="right") - 1
            for t, s, i, e in zip(text.tolist(), number.tolist(), item.tolist(), edits.tolist(), strict=True):
                own, least = found.get((t, i), (set(), e))
                own.add(s)
                found[t, i] = own, min(least, e)
        return [(t, i, len(own), e) for (t, i), (own, e) in sorted(found.items())]

    def _shorts(self, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Place, number (negative), item and edits (0) of the short items, each between word borders."""
        where, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if self.short:
            b = np.concatenate([b, np.zeros(LEAST + 1, np.uint8)])
            border = (b == 0) | (b == 32)
            begins = np.flatnonzero(border[:-1] & ~border[1:]) + 1
        head = np.minimum(self.short_length, 8)
        for width in np.unique(head):
            rows = np.flatnonzero(head == width)
            heads = _packed(self.short_bytes.ravel(), rows * LEAST, width)
            rows = rows[np.argsort(heads, kind="stable")]
            keys = np.sort(heads)
            own = _packed(b, begins, width)
            low = np.searchsorted(keys, own)
            n = np.searchsorted(keys, own, side="right") - low
            place = np.repeat(begins, n)
            of = rows[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
            for k in range(0, len(of), 65536):
                p, o = place[k : k + 65536], of[k : k + 65536]
                step = np.arange(LEAST)
                same = (b[p[:, None] + step] == self.short_bytes[o]) | (step >= self.short_length[o, None])
                on = same.all(axis=1) & border[p + self.short_length[o]]
                where.append(p[on])
                which.append(o[on])
        which = np.concatenate(which)
        item = np.array([i for i, _ in self.short], np.int64)
        return np.concatenate(where), -1 - which, item[which], np.zeros(len(which), np.int64)

    def _segments(self, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Place (its middle), number, item and edits of the segments within their budget."""
        nothing = (np.zeros(0, np.int64),) * 4
        if not len(self.item):
            return nothing
        g = grams(b)
        hit = np.flatnonzero(self.bits[(g >> np.uint64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.gram, g[hit]), len(self.gram) - 1)
        same = self.gram[at] == g[hit]
        hit, at = hit[same], at[same]
        if not len(hit):
            return nothing
        # Of the q-grams that the texts hold, those left out of each segment.
        times = np.bincount(at, minlength=len(self.gram))
        row = np.flatnonzero(np.repeat(times > 0, np.diff(self.first)))
        often = np.repeat(times, np.diff(self.first))[row]
        row = row[np.lexsort((-often, self.of[row]))]
        own, begin, n = np.unique(self.of[row], return_index=True, return_counts=True)
        nth = np.arange(len(row)) - np.repeat(begin, n)
        fewer = np.maximum(self.bound - SHARED, 0)
        row = np.sort(row[(nth >= np.repeat(fewer[own], n)) & np.repeat(n >= self.bound[own], n)])
        first = np.searchsorted(row, self.first)
        n = first[at + 1] - first[at]
        place = row[np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        where, segment = np.repeat(hit, n), self.of[place]
        # Diagonals, shifted so that none is negative; two overlapping bands hold each.
        diagonal = where - self.at[place] + PART
        bands = (len(b) + 2 * PART) // HALF + 3
        half, need = segment * bands + diagonal // HALF, np.minimum(self.bound, SHARED).astype(np.uint8)
        # Most halves of bands are too thin beside either neighbour: counts by slot, up to
        # ``SHARED`` each, are never too low.
        slots = 1 << len(half).bit_length()
        slot = half & (slots - 1)
        thick = np.minimum(np.bincount(slot, minlength=slots), SHARED).astype(np.uint8)
        thick += np.maximum(np.roll(thick, 1), np.roll(thick, -1))
        likely = np.flatnonzero(thick[slot] >= need[segment])
        # A q-gram counts once in a band, wherever it stands in it.
        key = half[likely] * PART + self.at[place[likely]]
        twice = np.sort(np.concatenate([key, key + PART]))
        twice = twice[np.diff(twice, prepend=-1) > 0] // PART
        begins = np.flatnonzero(np.diff(twice, prepend=-1))
        keys, shared = twice[begins], np.diff(begins, append=len(twice))
        segment, band = keys // bands, keys % bands
        on = shared >= need[segment]
        segment, band = segment[on], band[on]
        if not len(segment):
            return nothing
        edits = self._edits(b, segment, (band - 1) * HALF - PART)
        good = edits <= self.budget[segment]
        segment, band = segment[good], band[good]
        middle = np.clip((band - 1) * HALF - PART + HALF + self.length[segment] // 2, 0, len(b) - 1)
        return middle, segment, self.item[segment], edits[good]

    def _edits(self, b: np.ndarray, segment: np.ndarray, first: np.ndarray, group: int = 8192) -> np.ndarray:
        """Edits between each segment and the text on the diagonals from ``first`` on, a band wide.

        The region's ends are free; a cell is (position in segment, diagonal).
        Diagonals reach as far to both sides as the budget, so that alignments
        that start or end at the band's edge fit.
        """
        reach = PART // BYTES_AN_EDIT
        width = 2 * HALF + 2 * reach
        far = np.int32(10 * PART)
        # Bands reach beyond both ends of the texts.
        beyond = np.zeros(4 * PART, np.uint8)
        b = np.concatenate([beyond, b, beyond])
        step = np.arange(width)
        out = np.empty(len(segment), np.int64)
        order = np.argsort(self.length[segment], kind="stable")
        for k in range(0, len(segment), group):
            own = order[k : k + group]
            s, base = segment[own], first[own, None] - reach + step + len(beyond)
            cost = np.zeros((len(s), width), np.int32)
            for i in range(self.length[s[-1]]):
                here = b[base + i]
                # No alignment passes the byte between two texts.
                between = np.where(here == 0, far, np.int32(0))
                down = np.concatenate([cost[:, 1:], np.full((len(s), 1), far)], axis=1) + np.int32(1)
                new = np.minimum(cost + (here != self.bytes[s, i][:, None]) + between, down)
                walked = np.cumsum(between + np.int32(1), axis=1, dtype=np.int32)
                new = np.minimum.accumulate(new - walked, axis=1) + walked
                cost = np.where((i < self.length[s])[:, None], new, cost)
            out[own] = cost.min(axis=1)
        return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes of the benchmark, some ``BLOCK_BYTES`` of text each."""
    items = documents(benchmark, id_col, text_col).where(F.col("doc_id").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 1
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) == k)
        yield Index([(int(r.doc_id), r.text) for r in own.orderBy("doc_id", "text").collect()])


def _parts(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``AT_ONCE`` characters, with the first one's number."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= AT_ONCE:
            yield first, texts[first : k + 1]
            first, size = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``segments`` (found) and ``edits`` (fewest) of each item in each document."""
    typed = documents(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))

    def searched(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for first, texts in _parts(batch.column(1).to_pylist()):
                    rows = [(ids[first + t], i, n, e) for t, i, n, e in index.search(texts)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["doc_id", "item_id", "segments", "edits"]
                    )

        return typed.mapInArrow(gives_back(run), "doc_id bigint, item_id bigint, segments bigint, edits bigint")

    found = [searched(index) for index in blocks(benchmark)]
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    if len(found) > 1:  # texts of one item id may lie in several blocks
        out = out.groupBy("doc_id", "item_id").agg(F.sum("segments").alias("segments"), F.min("edits").alias("edits"))
    return out


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the documents that hold an item."""
    out = docs
    for index in blocks(benchmark):

        def holds(texts, index=index):
            import pandas as pd

            found = np.zeros(len(texts), bool)
            for first, part in _parts([t or "" for t in texts]):
                found[[first + t for t, *_ in index.search(part)]] = True
            return pd.Series(found)

        out = out.where(~F.pandas_udf(gives_back(holds), "boolean")(F.col(text_col)))
    return out
