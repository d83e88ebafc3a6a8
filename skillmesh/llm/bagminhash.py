"""Near duplicates by BagMinHash signatures over weighted word shingles.

A document is the multiset of its shingles of ``SHINGLE`` words (a shorter
text with words is one shingle), whitespace-separated and unchanged; a shingle's
weight is its count.  Two documents are near duplicates from a weighted
Jaccard similarity (overlap over union of the multisets) of ``THRESHOLD`` on.

Signatures: each shingle owns Poisson processes on weight intervals 0 to 1, 1
to 2, 2 to 4, 4 to 8 and so on, with a rate equal to the interval's length.
A point has a time, one of the signature's components and a place in its
interval; it counts if its place lies below the shingle's weight, so the
points of a shingle have its weight as rate.  A component keeps its earliest
point; a process ends once its next point is later than all components.  The
share of equal components estimates the weighted Jaccard similarity without
bias.

Groups: documents with one multiset are a class, told by a 128-bit digest;
classes that agree on a band of components meet under the band's hash.  In
each bucket every class is paired with the bucket's least one and with its
neighbour in the order of the components that follow the band (which the bucket's rows carry), and in buckets of at most
``ALL_PAIRS`` classes with all others.  Pairs whose signatures agree on less than
``LEAST_AGREEING`` of their components are left out (at the threshold a pair does so with a chance below
1e-10); the others are verified by the exact overlap of the multisets, and what is linked is merged.  Larger buckets
that then still hold several roots keep one member a root and are paired again in another order,
until a round links nothing.  No bucket is gathered and none gives more than a few pairs a member and round.
The classes of larger buckets that then still have several roots are joined
exactly: two multisets at the threshold share an element among the first of
each in an order by rarity (prefix filter), at places that leave room for the
overlap needed, so all other pairs are excluded and these are verified.

Texts are moved only for the classes that meet others, and for a pair only its own
two; sides of joins are broadcast up to ``BROADCAST_ROWS`` rows, by count.  All
intermediate tables lie in one scratch folder, which is deleted once the result is written.

Defined results: null texts and texts without words are alike (one class of
empty multisets); ties are broken by the least id; an empty table gives an empty result.
``near_duplicates``: a repeated id is one document with the least of its texts; rows without
an id have no class; further columns are left out.  ``keep_one``: every row counts with its own text, so
a repeated id with several texts is several documents; the row of the least id of a class stays
(rows without an id come last), and of rows with one id and one text one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_path, scratch_path
from .common import WordHashes, documents, gives_back, mix64, split_words, whole_text

SHINGLE, THRESHOLD = 5, 0.8
#: Components a band and bands: a pair at the threshold misses all bands with probability 3e-6.
ROWS, BANDS = 4, 24
COMPONENTS = ROWS * BANDS
#: Classes of a bucket up to which all pairs are taken.
ALL_PAIRS = 8
#: Components on which the signatures of a pair have to agree to be verified.
LEAST_AGREEING = COMPONENTS // 2
#: Components after a band that order the classes of its bucket.
ORDER = 8
#: Rounds over the larger buckets; they end before when nothing new is linked.
MOST_ROUNDS = 3
#: Rows of ids (8 bytes) or pairs (16 bytes) up to which they are broadcast.
BROADCAST_ROWS = 1_000_000
#: Counters by which the exact join orders elements; several elements may share one.
COUNTERS = 1 << 20


def shingles(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (64-bit) of a text's word hashes, ascending, and their counts."""
    if not len(hashes):
        return hashes, np.zeros(0, np.int64)
    width = min(SHINGLE, len(hashes))
    n = len(hashes) - width + 1
    own = np.full(n, width, np.uint64)
    for k in range(width):
        own = mix64(own * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return np.unique(own, return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of ``COMPONENTS`` 64-bit values for each multiset: its components' earliest points."""
    m = COMPONENTS
    doc = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
    if not len(doc):
        return np.zeros((len(sets), m), np.uint64)
    item = np.concatenate([s for s, _ in sets])
    weight = np.concatenate([w for _, w in sets])
    # One process a shingle and interval: 0 is (0, 1], p is (2^(p-1), 2^p].
    levels = np.ceil(np.log2(weight)).astype(np.int64) + 1
    doc, item, weight = (np.repeat(x, levels) for x in (doc, item, weight))
    level = np.arange(len(doc)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    span = np.where(level > 0, low, 1)
    state = mix64(item ^ mix64(level.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
    time = np.zeros(len(doc))
    best = np.full(len(sets) * m, np.inf)
    value = np.zeros(len(sets) * m, np.uint64)
    while len(doc):
        state = state + np.uint64(0x9E3779B97F4A7C15)
        draw = mix64(state)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / span
        draw = mix64(draw ^ np.uint64(0xD1B54A32D192ED03))
        component = ((draw >> np.uint64(40)) % np.uint64(m)).astype(np.int64)
        place = ((draw & np.uint64(0xFFFFFFFFFF)) % span.astype(np.uint64)).astype(np.int64)
        counts = np.flatnonzero(low + place < weight)
        at, when = doc[counts] * m + component[counts], time[counts]
        earlier = when < best[at]
        at, when, of = at[earlier], when[earlier], draw[counts][earlier]
        # The earliest point of a component last, so that it stays.
        order = np.lexsort((of, -when))
        best[at[order]] = when[order]
        value[at[order]] = of[order]
        last = best.reshape(len(sets), m).max(axis=1)
        on = np.flatnonzero(time <= last[doc])
        doc, state, time, low, span, weight = (x[on] for x in (doc, state, time, low, span, weight))
    return value.reshape(len(sets), m)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets; 1 for two empty ones."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (total - shared)


def _texts(batch: pa.RecordBatch, column: int, step: int = 1024) -> Iterator[tuple[int, list[str]]]:
    for k in range(0, len(batch), step):
        yield k, batch.column(column).slice(k, step).to_pylist()


_SIGNED = "doc_id bigint, digest binary, bands array<bigint>, keys array<bigint>, rest binary"


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id``, the multiset's ``digest``, each band's hash and the ``ORDER`` components after it, and the signature as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for batch in batches:
            for k, texts in _texts(batch, 1):
                sets = [shingles(hashes.of(split_words(t))) for t in texts]
                digests = [xxhash.xxh3_128_digest(s.tobytes() + w.tobytes()) for s, w in sets]
                values = signatures(sets)
                bands = np.full((len(sets), BANDS), 1, np.uint64)
                for r in range(ROWS):
                    bands = mix64(bands * np.uint64(0x9E3779B97F4A7C15) + values.reshape(-1, BANDS, ROWS)[:, :, r])
                bands = mix64(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                # One byte a component is enough to order classes and to compare two signatures.
                low = (values & np.uint64(255)).astype(np.uint8)
                turned = np.concatenate([low, low[:, :ORDER]], axis=1)
                keys = [turned[:, at : at + ORDER] for at in np.arange(1, BANDS + 1) * ROWS % COMPONENTS]
                keys = np.ascontiguousarray(np.stack(keys, axis=1)).view(np.int64)
                lists = [pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, x.ravel()) for x in (bands, keys)]
                columns = [
                    batch.column(0).slice(k, len(texts)),
                    pa.array(digests, pa.binary()),
                    *lists,
                    pa.array([v.tobytes() for v in low], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "bands", "keys", "rest"])

    typed = documents(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return typed.mapInArrow(gives_back(run), _SIGNED)


class Scratch:
    """Intermediate tables in one folder, deleted as a whole."""

    def __init__(self, spark):
        self.spark, self.root, self.n = spark, scratch_path(spark, "near-duplicates"), 0

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def drop(self) -> None:
        drop_path(self.spark, self.root)


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    """A written table of ids or pairs, broadcast if its count allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def verified(pairs: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The ``pairs`` (columns ``a`` and ``b``, ids; a written table) whose texts are near duplicates.

    Only the texts of the pairs are moved, to the place of ``a``; AQE splits
    an ``a`` that stands in very many pairs.
    """
    texts, pairs = docs.select("doc_id", "text"), _maybe_broadcast(pairs)
    second = texts.join(pairs, F.col("doc_id") == F.col("b")).select("a", "b", F.col("text").alias("text_b"))
    first = texts.join(pairs.select("a"), F.col("doc_id") == F.col("a"), "left_semi")
    both = second.join(first.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        center, center_set = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(*(batch.column(c) for c in (0, 2, 3)), strict=True):
                if a != center:
                    center, center_set = a, shingles(hashes.of(split_words(x.as_py())))
                keep.append(overlap(center_set, shingles(hashes.of(split_words(y.as_py())))) >= threshold)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(gives_back(run), "a bigint, b bigint")


def _agreeing(pairs: DataFrame, orders: DataFrame) -> DataFrame:
    """The ``pairs`` whose signatures (``id``, ``rest``) agree on ``LEAST_AGREEING`` components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COMPONENTS) for c in (2, 3)]
            yield batch.select(["a", "b"]).filter(pa.array((both[0] == both[1]).sum(axis=1) >= LEAST_AGREEING))

    x = orders.select(F.col("id").alias("a"), F.col("rest").alias("x"))
    y = orders.select(F.col("id").alias("b"), F.col("rest").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _star_round(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step on edges (``u`` > ``v``): the same components, closer to stars."""
    sides = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return small.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node has two edges upwards and none above another has one."""
    below = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = below.unionAll(edges.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.where("up > 1 OR (up = 1 AND down = 1)").count()


def merged(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and the least node it is linked to, directly or not, as ``root``, of ``links`` (``a`` < ``b``).

    Rounds aggregate partially and are written to the shared folder.
    """
    edges = links.select(F.col("b").alias("u"), F.col("a").alias("v")).where("u != v")
    while not _are_stars(edges):
        edges = scratch.written(_star_round(edges), "edges")
    return scratch.written(edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node"), "roots")


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``rows`` (``id``) with the root of each id."""
    if roots is None:
        return rows.withColumn("root", F.col("id"))
    joined = rows.drop("root").join(roots.withColumnRenamed("node", "id"), "id", "left")
    return joined.withColumn("root", F.coalesce("root", "id"))


def _live(rows: DataFrame) -> DataFrame:
    """Of the members of buckets (``band``, ``n``, ``key``, ``id``, ``root``) one a root (the least id), where a bucket has several."""
    one = rows.groupBy("band", "root").agg(F.max("n").alias("n"), F.min("id").alias("id"), F.min("key").alias("key"))
    least = one.groupBy("band").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("band")
    return one.join(least, "band", "left_semi")


def _candidates(live: DataFrame, seed: int) -> DataFrame:
    """Pairs ``a`` < ``b`` inside buckets of members with different roots.

    No bucket is gathered: each member meets the bucket's least member (by id, later by
    a hash), which an aggregate finds, and its neighbour in the order by ``key``, which a
    range partitioning gives that may cut a bucket.
    """
    order = F.xxhash64("id", F.lit(seed)) if seed else F.lit(0).cast("bigint")
    seeded = live.withColumn("order", order)
    least = seeded.groupBy("band").agg(F.min(F.struct("order", "id")).alias("least"))
    pairs = seeded.join(least, "band").where(F.col("id") != F.col("least.id")).select(F.col("least.id").alias("x"), F.col("id").alias("y"))
    if not seed:
        few = live.where((F.col("n") > 2) & (F.col("n") <= ALL_PAIRS)).select("band", F.col("id").alias("x"))
        pairs = pairs.unionAll(few.join(few.withColumnRenamed("x", "y"), "band").where("x < y").select("x", "y"))
    placed = seeded.where(F.col("n") > ALL_PAIRS).select("band", F.col("order" if seed else "key").alias("key"), "id")
    pairs = pairs.unionAll(_neighbours(placed))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _neighbours(placed: DataFrame) -> DataFrame:
    """Pairs of neighbours in each bucket's order by ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((2, 0), np.int64)
        for batch in batches:
            band, own = (np.concatenate([before, batch.column(c).to_numpy()]) for c, before in enumerate(last))
            near = np.flatnonzero(band[1:] == band[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(own[near]), pa.array(own[near + 1])], ["x", "y"])
            last = np.array([band[-1:], own[-1:]])

    ordered = placed.repartitionByRange("band", "key", "id").sortWithinPartitions("band", "key", "id")
    return ordered.select("band", "id").mapInArrow(run, "x bigint, y bigint")


def _elements(sets: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A multiset as a set: an element for each time that a shingle occurs."""
    items, counts = sets
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix64(np.repeat(items, counts) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _exact_pairs(texts: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Pairs ``a`` < ``b`` with different roots of ``texts`` (``id``, ``root``, ``text``), among them all near duplicates."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = WordHashes(), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, own in _texts(batch, 0):
                found = np.concatenate([_elements(shingles(hashes.of(split_words(t)))) for t in own])
                total += np.bincount((found % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["counter", "times"])

    counted = texts.select("text").mapInArrow(gives_back(tally), "counter bigint, times bigint").groupBy("counter").agg(F.sum("times").alias("times")).toArrow()
    times = np.zeros(COUNTERS, np.int64)
    times[counted.column("counter").to_numpy()] = counted.column("times").to_numpy()

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for k, own in _texts(batch, 2):
                sets = [_elements(shingles(hashes.of(split_words(t)))) for t in own]
                size = np.array([len(x) for x in sets], np.int64)
                # The least overlap with any other multiset is the threshold's share of the own size.
                first = np.where(size > 0, size - np.ceil(threshold * size - 1e-6).astype(np.int64) + 1, 0)
                head = [x[np.lexsort((x, times[(x % np.uint64(COUNTERS)).astype(np.int64)]))][:n] for x, n in zip(sets, first, strict=True)]
                row = np.repeat(np.arange(len(sets)), first)
                columns = [
                    pa.array(np.concatenate(head).view(np.int64)),
                    batch.column(0).slice(k, len(own)).take(pa.array(row)),
                    batch.column(1).slice(k, len(own)).take(pa.array(row)),
                    pa.array(size[row]),
                    pa.array(np.arange(len(row)) - np.repeat(np.cumsum(first) - first, first) + 1),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["element", "id", "root", "size", "at"])

    heads = scratch.written(texts.select("id", "root", "text").mapInArrow(gives_back(prefixes), "element bigint, id bigint, root bigint, size bigint, at bigint"), "heads")
    several = heads.groupBy("element").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("element")
    heads = scratch.written(heads.join(several, "element", "left_semi"), "heads")
    x = heads.select("element", *[F.col(c).alias(f"{c}_x") for c in ("id", "root", "size", "at")])
    y = heads.select("element", *[F.col(c).alias(f"{c}_y") for c in ("id", "root", "size", "at")])
    least = F.lit(threshold / (1 + threshold)) * (F.col("size_x") + F.col("size_y")) - 1e-6
    fits = (F.col("size_x") >= F.lit(threshold) * F.col("size_y") - 1e-6) & (
        F.least(F.col("size_x") - F.col("at_x"), F.col("size_y") - F.col("at_y")) + 1 >= least
    )
    ordered = "root_x != root_y AND (size_x < size_y OR size_x = size_y AND id_x < id_y)"
    pairs = x.join(y, "element").where(ordered).where(fits)
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def classes_of(texts: DataFrame, sketches: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """``doc_id`` and ``class_id`` (the least id of its class) of ``texts``, whose ids are not null and not repeated, with their written ``signed`` table."""
    first = sketches.groupBy("digest").agg(F.min("doc_id").alias("id"))
    members = scratch.written(sketches.select("doc_id", "digest").join(first, "digest").select("doc_id", "id"), "members")
    classes = sketches.join(members.where("doc_id = id").select("id"), F.col("doc_id") == F.col("id"), "left_semi")
    classes = classes.withColumnRenamed("doc_id", "id")
    banded = classes.select("id", F.inline(F.arrays_zip("bands", "keys")).alias("band", "key"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    buckets = scratch.written(banded.join(shared, "band"), "buckets")
    # From here on only classes that meet others, and their texts.
    meeting = _maybe_broadcast(scratch.written(buckets.select("id").distinct(), "meeting"))
    orders = scratch.written(classes.select("id", "rest").join(meeting, "id", "left_semi"), "orders")
    texts = scratch.written(texts.join(meeting, F.col("doc_id") == F.col("id"), "left_semi").select("doc_id", "text"), "texts")
    live, roots, links, tried, seed = _live(_rooted(buckets, None)), None, None, None, 0
    while True:
        live = scratch.written(live, "live")
        pairs = _candidates(live, seed)
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.written(_agreeing(pairs, orders), "pairs")
        tried = pairs if tried is None else tried.unionAll(pairs)
        new = scratch.written(verified(pairs, texts, threshold), "links")
        linked = bool(new.head(1))
        if linked:
            links = new if links is None else links.unionAll(new)
            roots = merged(links, scratch)
        # What is merged stays so: only buckets that still have several roots go on.
        live = _live(_rooted(live.where(F.col("n") > ALL_PAIRS), roots))
        if not linked or seed == MOST_ROUNDS:
            break
        seed += 1
    open_ = scratch.written(live.select("id", "root").distinct(), "open")
    if open_.head(1):
        # The members that stand for their roots are not all: the exact join takes each class of those buckets.
        bands = live.select("band").distinct()
        whole = _rooted(buckets.join(bands, "band", "left_semi").select("id").distinct(), roots)
        pairs = _exact_pairs(whole.join(texts.withColumnRenamed("doc_id", "id"), "id"), threshold, scratch)
        new = scratch.written(verified(scratch.written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs"), texts, threshold), "links")
        if new.head(1):
            roots = merged(new if links is None else links.unionAll(new), scratch)
    found = _rooted(members.select("doc_id", "id"), roots)
    return found.select("doc_id", F.col("root").alias("class_id"))


def _typed(docs: DataFrame) -> DataFrame:
    return documents(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id`` and ``class_id`` (the least id of its near-duplicate class) of each distinct id."""
    spark = docs.sparkSession
    scratch, out = Scratch(spark), scratch_path(spark, "classes")
    texts = _typed(docs).where(F.col("doc_id").isNotNull())
    sketches = scratch.written(signed(texts), "signatures")
    repeated = sketches.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.head(1):
        several = texts.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        texts = scratch.written(texts.join(repeated, "doc_id", "left_anti").select("doc_id", "text").unionAll(several), "texts")
        sketches = scratch.written(signed(texts), "signatures")
    classes_of(texts, sketches, scratch, threshold).write.parquet(out)
    scratch.drop()
    return spark.read.parquet(out)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, with one row of each class, that of the least id."""
    spark = docs.sparkSession
    scratch, out = Scratch(spark), scratch_path(spark, "gone")
    texts = _typed(docs)
    sketches = scratch.written(signed(texts), "signatures")
    own_id, gone_id = F.col("doc_id").cast("bigint"), F.col("_near_gone")
    repeated = sketches.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id")
    if not repeated.head(1):
        found = classes_of(texts, sketches, scratch, threshold)
        found.where("doc_id != class_id").select(F.col("doc_id").alias("_near_gone")).write.parquet(out)
        scratch.drop()
        return docs.join(spark.read.parquet(out), own_id == gone_id, "left_anti")
    # Rows whose id is null or repeated are told apart by id and text.
    repeated = scratch.written(repeated.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_near_twice")), "repeated")
    node = F.when(F.col("doc_id").isNull() | F.col("_near_twice").isNotNull(), F.xxhash64(own_id, whole_text(), F.lit("row"))).otherwise(own_id)

    def noded(rows: DataFrame) -> DataFrame:
        return rows.join(repeated, own_id == F.col("_near_twice"), "left").withColumn("_near_node", node)

    nodes = scratch.written(noded(texts).dropDuplicates(["_near_node"]).select(F.col("_near_node").alias("doc_id"), "text", own_id.alias("own")), "nodes")
    found = classes_of(nodes, scratch.written(signed(nodes), "signatures"), scratch, threshold)
    found = scratch.written(found.join(nodes.drop("text"), "doc_id"), "classes")
    least = found.groupBy("class_id").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", F.col("doc_id").alias("node"))).alias("least"))
    kept = found.join(least, "class_id").where(F.col("doc_id") == F.col("least.node")).select(F.col("doc_id").alias("_near_kept"))
    kept.write.parquet(out)
    rows = noded(docs).join(spark.read.parquet(out), F.col("_near_node") == F.col("_near_kept"), "left_semi")
    odd = F.col("doc_id").isNull() | F.col("_near_twice").isNotNull()
    whole = rows.where(~odd).unionAll(rows.where(odd).dropDuplicates(["_near_node"])).select(*docs.columns)
    result = scratch_path(spark, "kept")
    whole.write.parquet(result)
    scratch.drop()
    return spark.read.parquet(result)
