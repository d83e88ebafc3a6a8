r"""Substring dedup: prefix-partitioned suffix trees over words.

Words are ``[^\x20\x09-\x0D]+``, unchanged.  A window is ``WINDOW`` consecutive
words of a document; a word is removed if a window covers it whose word
sequence also starts anywhere else.  Windows are judged on the input.

The suffixes that can share ``WINDOW`` words are found by a first prefix: of
the ``GRAM``-word sequences inside a window the one with the least hash (the
leftmost on ties) is its anchor, which equal windows share at the same
offset.  Anchors whose sequence occurs once in the corpus are dropped: their
windows are unique.  The windows of the others, suffixes cut at ``WINDOW``
words, are dealt by the anchor's sequence, so that a task gets whole groups of
bounded size.  A task sorts the suffixes of its groups word by word (ranks of 1, 2, 4 .. words, each from
the two halves' ranks); neighbours that share ``WINDOW`` words lie below one
internal node of the tree at that depth, and the nodes with several leaves are the
repeats (neighbouring ones form the maximal repeats).

Groups of more than ``GROUP`` anchors get a longer prefix: each of their suffixes is dealt
by its first ``LONGER`` words, and sorted as above where that group fits.  Where it does not,
the prefix is lengthened to all words of the window: the subtree is then a single node,
and counting its leaves, with partial aggregation, decides.

Tasks compare the words themselves; only the nodes of the longest prefix are told by a
128-bit digest of their words.

Defined results: null, empty and short texts (fewer than ``WINDOW`` words)
lose nothing; very long texts are one row; repeated rows, also of one id or
without an id, are documents of their own, so all windows of rows that are equal in
id and text repeat (they are searched once); an empty table gives an empty result; further
columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import WordHashes, documents, mix64, slots, split_words

WINDOW, GRAM = 35, 8
#: Anchors of one sequence up to which their suffixes go to one task.
GROUP = 2048
#: Words of the next longer prefix.
LONGER = 20
#: Suffixes sorted at once, at least (a group is never divided).
AT_ONCE = 200_000


def rolled(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit polynomial hash of the ``width`` values from each position on."""
    n = max(len(values) - width + 1, 0)
    out = values[:n].copy()
    for k in range(1, width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += values[k : k + n]
    return out


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors' sequence hashes, and the first and last window start that each anchors."""
    none = np.zeros(0, np.int64)
    if len(hashes) < WINDOW:
        return none.astype(np.uint64), none, none
    n = len(hashes) - GRAM + 1
    gram = mix64(rolled(hashes, GRAM))
    span = WINDOW - GRAM + 1
    least = np.lib.stride_tricks.sliding_window_view(gram, span)
    at = np.concatenate([least[k : k + 65536].argmin(axis=1) for k in range(0, len(least), 65536)]) + np.arange(len(least))
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return gram[at[first]], first, np.append(first[1:], len(at)) - 1


def ranked(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of several lists one after another as numbers in the words' order, and each list's first place.

    Each list ends in a number of its own, so that no suffix is equal to one beyond its list's end.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = {w: k for k, w in enumerate(sorted({w for own in words for w in own}))}
    begins = np.cumsum(size + 1) - size - 1
    out = np.empty(int(size.sum()) + len(words), np.int64)
    inner = np.ones(len(out), bool)
    inner[begins + size] = False
    out[inner] = np.fromiter((order[w] for own in words for w in own), np.int64, int(size.sum()))
    out[~inner] = len(order) + np.arange(len(words))
    return out, begins


def deep_nodes(numbers: np.ndarray, at: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """For each suffix (from each place of ``at`` on, ``depth`` words long) the number of its tree node of that depth.

    Ranks of suffixes by their first 1, 2, 4 .. words come from the ranks of
    their halves; suffixes of one rank are neighbours in the sorted order that share
    so many words.  Numbers ascend with the words.
    """

    def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1]

    rank, width = np.unique(numbers, return_inverse=True)[1], 1
    while 2 * width <= depth:
        # Beyond the end there is nothing, which comes first.
        later = np.concatenate([rank[width:] + 1, np.zeros(min(width, len(rank)), rank.dtype)])
        rank, width = paired(rank, later), 2 * width
    return paired(rank[at], rank[at + depth - width])


def repeated_suffixes(numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the suffixes share a node of depth ``WINDOW`` with another."""
    node = deep_nodes(numbers, at)
    return np.bincount(node, minlength=1)[node] > 1


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` (tells texts of one id apart) and ``text``; a null id is a value of its own."""
    typed = documents(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return typed.select(F.coalesce("doc_id", F.lit(-(2**63)).cast("bigint")).alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), "text")


def _equal_rows(keyed: DataFrame) -> DataFrame | None:
    """``doc_id`` and ``key`` of rows that are there more than once, written; None if there are none."""
    path = scratch_path(keyed.sparkSession, "equal-rows")
    keyed.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "key").write.parquet(path)
    equal = keyed.sparkSession.read.parquet(path)
    return equal if equal.head(1) else None


def _once(keyed: DataFrame, equal: DataFrame | None) -> DataFrame:
    """``keyed`` with one row of equal ones; only these are shuffled for it."""
    if equal is None:
        return keyed
    some = keyed.join(equal, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])
    return keyed.join(equal, ["doc_id", "key"], "left_anti").unionByName(some)


_ANCHORS = "doc_id bigint, key bigint, gram bigint, lo int, hi int"


def _anchor_rows(keyed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for k in range(0, len(batch), 512):
                some = batch.slice(k, 512)
                found = [anchors(hashes.of(split_words(t))) for t in some.column(2).to_pylist()]
                row = pa.array(np.repeat(np.arange(len(found)), [len(g) for g, _, _ in found]))
                gram, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
                columns = [some.column(0).take(row), some.column(1).take(row), pa.array(gram.view(np.int64))]
                columns += [pa.array(x.astype(np.int32)) for x in (lo, hi)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "gram", "lo", "hi"])

    return keyed.mapInArrow(run, _ANCHORS)


_LIST = "array<struct<gram: bigint, lo: int, hi: int>>"


def _suffix_rows(marked: DataFrame) -> DataFrame:
    """A row for each text and differing word list of its listed anchors: the places, and the words of all windows (joined by a space).

    Places of one text with one word list (a line said again and again) are
    one row, so that shuffles and joins get a row a text and list at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                some = batch.slice(k, 256)
                row, lists, places = [], [], []
                for i, (text, listed) in enumerate(zip(some.column(2).to_pylist(), some.column(3), strict=True)):
                    own = split_words(text)
                    at: dict[tuple[int, bytes], list[int]] = {}
                    for g, a, b in zip(*(listed.values.field(c).to_pylist() for c in ("gram", "lo", "hi")), strict=True):
                        at.setdefault((g, b" ".join(own[a : b + WINDOW])), []).append(a)
                    row += [i] * len(at)
                    lists += at.keys()
                    places += at.values()
                of = pa.array(row, pa.int32())
                gram, words = zip(*lists, strict=True) if lists else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(of), some.column(1).take(of), pa.array(gram, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(words, pa.binary())],
                    ["doc_id", "key", "gram", "los", "words"],
                )

    return marked.select("doc_id", "key", "text", "listed").mapInArrow(run, "doc_id bigint, key bigint, gram bigint, los array<int>, words binary")


_RANGE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_RANGES = "doc_id bigint, key bigint, ranges array<struct<first: int, last: int>>"


def _solved(rows: list[tuple]) -> pa.RecordBatch:
    """Ranges of repeated window starts of rows of ``_suffix_rows``, whole groups."""
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(r[4], len(number)) for r in rows])
    times = np.bincount(which, weights=[len(r[3]) for r in rows])
    words = [x.split() for x in number]
    numbers, begins = ranked(words)
    n = np.fromiter(map(len, words), np.int64, len(words)) - WINDOW + 1
    owner = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    # Equal word lists in several places repeat in whole.
    flags = repeated_suffixes(numbers, begins[owner] + offset) | (times[owner] > 1)
    begins = np.flatnonzero(flags & (np.concatenate([[True], ~flags[:-1]]) | (offset == 0)))
    stops = np.flatnonzero(flags & (np.concatenate([~flags[1:], [True]]) | (offset == n[owner] - 1)))
    found: dict[int, list[tuple[int, int]]] = {}
    for o, a, b in zip(owner[begins].tolist(), offset[begins].tolist(), offset[stops].tolist(), strict=True):
        found.setdefault(o, []).append((a, b))
    ids, keys, ranges = [], [], []
    for r, w in zip(rows, which.tolist(), strict=True):
        if w in found:
            ids.append(r[0])
            keys.append(r[1])
            ranges.append([{"first": lo + a, "last": lo + b} for lo in r[3] for a, b in found[w]])
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(ranges, _RANGE)], ["doc_id", "key", "ranges"])


def _repeats(suffixes: DataFrame) -> DataFrame:
    """Ranges of window starts that repeat inside the groups of one sequence; whole groups are in one partition, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if size >= AT_ONCE and r[2] != last:
                    yield _solved(rows)
                    rows, size = [], 0
                rows.append(r)
                size += r[4].count(b" ") + 2 - WINDOW
                last = r[2]
        if rows:
            yield _solved(rows)

    dealt = suffixes.repartition(slots(suffixes.sparkSession), "gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, _RANGES)


_WINDOWS = "d1 bigint, d2 bigint, n bigint, at int, prefix bigint, w1 bigint, w2 bigint, words binary"


def _longer_prefixes(suffixes: DataFrame) -> DataFrame:
    """As ``_repeats`` for groups of any size, by longer prefixes; nothing is gathered by group.

    Places with one word list are counted first (once a text already); the
    windows of the differing lists, with those counts, are then dealt by their first
    ``LONGER`` words, or counted by all their words where that group is too large as well.
    """
    spark = suffixes.sparkSession

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            if len(batch):
                digests = b"".join(map(xxhash.xxh3_128_digest, batch.column(4).to_pylist()))
                d = np.frombuffer(digests, np.int64).reshape(-1, 2)
                columns = [*(batch.column(c) for c in (0, 1, 3, 4)), *(pa.array(np.ascontiguousarray(d[:, c])) for c in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "los", "words", "d1", "d2"])

    path = scratch_path(spark, "lists")
    suffixes.mapInArrow(told, "doc_id bigint, key bigint, los array<int>, words binary, d1 bigint, d2 bigint").write.parquet(path)
    places = spark.read.parquet(path)
    lists = places.groupBy("d1", "d2").agg(F.first("words").alias("words"), F.sum(F.size("los")).alias("n"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for k in range(0, len(batch), 1024):
                some = batch.slice(k, 1024)
                row, at, prefix, windows = [], [], [], []
                for i, own in enumerate(x.split() for x in some.column(2).to_pylist()):
                    for j in range(len(own) - WINDOW + 1):
                        row.append(i)
                        at.append(j)
                        prefix.append(xxhash.xxh3_64_intdigest(b" ".join(own[j : j + LONGER])))
                        windows.append(b" ".join(own[j : j + WINDOW]))
                both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, windows)), np.int64).reshape(-1, 2)
                of = pa.array(row, pa.int32())
                columns = [*(some.column(c).take(of) for c in (0, 1, 3)), pa.array(at, pa.int32()), pa.array(np.array(prefix, np.uint64).view(np.int64))]
                columns += [*(pa.array(np.ascontiguousarray(both[:, c])) for c in (0, 1)), pa.array(windows, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["d1", "d2", "n", "at", "prefix", "w1", "w2", "words"])

    path = scratch_path(spark, "windows")
    lists.select("d1", "d2", "words", "n").mapInArrow(cut, _WINDOWS).write.parquet(path)
    windows = spark.read.parquet(path)
    path = scratch_path(spark, "prefixes")
    windows.groupBy("prefix").agg(F.count("*").alias("size"), F.max("n").alias("most")).where("size > 1 OR most > 1").write.parquet(path)
    prefixes = spark.read.parquet(path)

    def sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The repeats of whole groups, which are in one partition, in order."""

        def solved(table: pa.Table) -> list[pa.RecordBatch]:
            numbers, begins = ranked([x.split() for x in table.column("words").to_pylist()])
            again = repeated_suffixes(numbers, begins) | (table.column("n").to_numpy() > 1)
            return table.select(["d1", "d2", "at"]).filter(pa.array(again)).combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            own = batch.column("prefix").to_numpy()
            if sum(map(len, held)) >= AT_ONCE // 8 and own[0] != own[-1]:
                last = int(np.searchsorted(own, own[-1]))
                held[-1] = batch.slice(0, last)
                yield from solved(pa.Table.from_batches(held))
                held = [batch.slice(last)]
        if held:
            yield from solved(pa.Table.from_batches(held))

    fitting = windows.join(prefixes.where(f"size <= {GROUP}").select("prefix"), "prefix").select("prefix", "d1", "d2", "n", "at", "words")
    dealt = fitting.repartition(slots(spark), "prefix").sortWithinPartitions("prefix")
    marked = dealt.mapInArrow(sorted_out, "d1 bigint, d2 bigint, at int")
    larger = windows.drop("words").join(prefixes.where(f"size > {GROUP}").select("prefix"), "prefix")
    several = larger.groupBy("w1", "w2").agg(F.sum("n").alias("times")).where("times > 1").select("w1", "w2")
    marked = marked.unionAll(larger.join(several, ["w1", "w2"]).select("d1", "d2", "at"))
    marked = marked.groupBy("d1", "d2").agg(F.collect_list("at").alias("ats"))
    ranges = F.transform("los", lambda lo: F.transform("ats", lambda at: F.struct((lo + at).alias("first"), (lo + at).alias("last"))))
    return places.drop("words").join(marked, ["d1", "d2"]).select("doc_id", "key", F.flatten(ranges).alias("ranges"))


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` and ``ranges`` (first and last start) of windows that repeat in texts other than equal rows, a row a text and word list."""
    keyed = _keyed(docs)
    return _repeats_of(_once(keyed, _equal_rows(keyed)))


def _repeats_of(keyed: DataFrame) -> DataFrame:
    spark = keyed.sparkSession
    path = scratch_path(spark, "anchors")
    _anchor_rows(keyed).write.parquet(path)
    found = spark.read.parquet(path)
    path = scratch_path(spark, "sequences")
    found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").write.parquet(path)
    counts = spark.read.parquet(path)

    def suffixes(which: str) -> DataFrame:
        some = found.join(counts.where(which).select("gram"), "gram")
        listed = some.groupBy("doc_id", "key").agg(F.collect_list(F.struct("gram", "lo", "hi")).alias("listed"))
        return _suffix_rows(keyed.join(listed, ["doc_id", "key"]))

    out = _repeats(suffixes(f"n <= {GROUP}"))
    if counts.where(f"n > {GROUP}").head(1):
        out = out.unionAll(_longer_prefixes(suffixes(f"n > {GROUP}")))
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the kept words joined by one space) of each document."""
    keyed = _keyed(docs)
    equal = _equal_rows(keyed)
    ranges = _repeats_of(_once(keyed, equal)).groupBy("doc_id", "key").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    if equal is None:
        ranges = ranges.withColumn("whole", F.lit(False))
    else:
        # Of a text that is there again under its id every window repeats.
        ranges = ranges.join(equal.withColumn("whole", F.lit(True)), ["doc_id", "key"], "full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 512):
                some = batch.slice(k, 512)
                total, removed, kept = [], [], []
                for text, own, whole in zip(*(some.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                    words = split_words(text)
                    total.append(len(words))
                    if whole and len(words) >= WINDOW:
                        words = []
                    elif own:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, [r["first"] for r in own], 1)
                        np.add.at(edge, [r["last"] + WINDOW for r in own], -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                    removed.append(total[-1] - len(words))
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    joined = keyed.join(ranges, ["doc_id", "key"], "left").select("doc_id", "text", "ranges", "whole")
    out = joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") > -(2**63), F.col("doc_id")))


def digests(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(texts: list[str]) -> list[tuple[int, int, str]]:
    """Words, removed words and digest of each text, by a dictionary of all windows; for tests."""
    words = [split_words(t) for t in texts]
    seen: dict[tuple, int] = {}
    for own in words:
        for i in range(len(own) - WINDOW + 1):
            w = tuple(own[i : i + WINDOW])
            seen[w] = seen.get(w, 0) + 1
    out = []
    for own in words:
        gone = {j for i in range(len(own) - WINDOW + 1) if seen[tuple(own[i : i + WINDOW])] > 1 for j in range(i, i + WINDOW)}
        kept = b" ".join(w for j, w in enumerate(own) if j not in gone)
        out.append((len(own), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
