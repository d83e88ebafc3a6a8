r"""Ranked lexical search: documents scanned by an automaton of all items' terms.

Terms are the maximal runs of letters and digits of ASCII and of all other
characters from U+0080 on, A-Z lower-cased.  There is no index of the documents: an
Aho-Corasick automaton of the items' distinct terms, each between two
boundary characters, runs over the whole texts, in which every run of
other characters ends in a boundary, and its outputs are counted as term
frequencies.  An output maps to the items that hold the term, and how often.

Scores, in 64-bit integers (``div`` rounds down): with N documents that have a term, L
terms in all, n terms in a document, df documents with a term and tf
of it in one, w = floor(1000 ln((2 N + 2) / (2 df + 1))) and
m = 25 + (75 n N) div L, a document's score is the sum over the item's terms, repeats
included, of w (10^9 tf) div (1000 tf + 8 m).

Work: one pass over the texts writes each document's length and its
counts of item terms, which is all that the rest needs: N, L and df are
sums of partial counts, and each task scores its documents for a block of items as products of small
matrices and keeps the ``k`` best of each item, so that only those are
shuffled, in two steps.  The automaton of a block has at most ``TERM_BYTES`` bytes of
terms (proved by a count; only a single item's terms may be more); an items table with more is searched in several blocks, each with
its own pass and written before the next.

Defined results: null texts and items have no terms; documents
without an id count in N, L and df but are not ranked; items without an id
are left out; an item id on several rows is one item with the terms of all
its distinct texts; repeated documents each have their own rank; items without terms or without a
document have no row; empty tables give an empty result; further columns are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import drop_path, scratch_path
from .common import documents

#: A term, as a Java regex over the lower-cased text.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of distinct terms in an automaton.
TERM_BYTES = 8 << 20
#: Bytes of text scanned at once.
AT_ONCE = 2 << 20
#: Cells of a matrix in scoring.
CELLS = 2_000_000
#: Candidates after which a task keeps only the best of each item.
POOL = 400_000
#: Groups in which an item's candidates are cut before they meet.
SALTS = 16

#: Bytes of terms stay, lower-cased; all others are the boundary.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def automaton(terms: list[str]):
    """Finds ``terms`` (any order; values are their places) between two boundaries, in bytes read as Latin-1."""
    import ahocorasick

    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for place, term in enumerate(terms):
        out.add_word(f" {term.encode().decode('latin-1')} ", place)
    out.make_automaton()
    return out


def _runs(texts: Iterator[bytes], most: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Runs of about ``most`` folded bytes: text numbers and parts; a longer text is cut at boundaries."""
    rows: list[int] = []
    parts: list[bytes] = []
    size = 0
    for row, text in enumerate(texts):
        folded, begin = text.translate(FOLDED), 0
        while begin < len(folded):
            end = len(folded)
            if end - begin > most:
                cut = folded.find(b" ", begin + most)
                end = end if cut < 0 else cut
            rows.append(row)
            parts.append(folded[begin:end])
            size += end - begin
            begin = end + 1
            if size >= most:
                yield rows, parts
                rows, parts, size = [], [], 0
    if parts:
        yield rows, parts


def frequencies(texts: Iterator[bytes], found, n_terms: int, n_texts: int, most: int = AT_ONCE) -> tuple[np.ndarray, ...]:
    """Each text's number of terms; then text, term and count of the automaton's terms, by text and term."""
    length = np.zeros(n_texts, np.int64)
    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for rows, parts in _runs(texts, most):
        raw = b" " + b" ".join(parts) + b" "
        row = np.array(rows)
        starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
        within = np.frombuffer(raw, np.uint8) != 32
        begins = np.cumsum(within[1:] & ~within[:-1])
        upto = np.concatenate([[0], begins])[starts]
        np.add.at(length, row, np.diff(upto))
        hits = np.fromiter((x for hit in found.iter(raw.decode("latin-1")) for x in hit), np.int64).reshape(-1, 2)
        # A term's last boundary may be the first one of the next part.
        part = np.searchsorted(starts, hits[:, 0]) - 1
        key, n = np.unique(row[part] * n_terms + hits[:, 1], return_counts=True)
        keys.append(key)
        times.append(n)
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(inverse, weights=np.concatenate(times), minlength=len(key)).astype(np.int64)
    return length, *np.divmod(key, max(n_terms, 1)), count


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id``, ``term`` and ``times`` of each item."""
    named = documents(items, "item_id").where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("item_id"), "text")
    terms = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return named.distinct().select("item_id", F.explode(terms).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


def _blocks(terms: DataFrame, most: int) -> Iterator[DataFrame]:
    """``terms`` by blocks of whole items with at most ``most`` bytes of distinct terms, as far as an item allows."""
    n_items, n = terms.select("item_id").distinct().count(), 1
    while True:
        block = F.pmod(F.xxhash64("item_id"), F.lit(n))
        sizes = terms.select(block.alias("block"), "term").distinct().groupBy("block").agg(F.sum(F.octet_length("term")).alias("size"))
        found = sizes.collect()  # a row a block
        largest = max((r["size"] for r in found), default=0)
        if largest <= most or n >= 2 * n_items:
            break
        n = min(2 * n_items, n * max(2, -(-largest // most)))
    for r in sorted(found, key=lambda r: r["block"]):
        yield terms.where(block == r["block"])


def _scanned(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``doc_id``, its number of terms ``n``, and numbers and counts of the listed terms it holds; documents without terms are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(terms)
        for batch in batches:
            texts = (x.as_buffer().to_pybytes() for x in batch.column(1))
            length, text, term, count = frequencies(texts, found, len(terms), len(batch))
            offsets = np.searchsorted(text, np.arange(len(batch) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, count)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(length), *lists], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(length > 0))

    typed = documents(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return typed.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


def _statistics(scanned: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the df of each term, from partial counts of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            out[:n_terms] += np.bincount(batch.column(1).flatten().to_numpy(), minlength=n_terms)
            out[n_terms] += len(batch)
            out[n_terms + 1] += batch.column(0).to_numpy().sum()
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["place", "times"])

    counted = scanned.select("n", "terms").mapInArrow(run, "place bigint, times bigint")
    table = counted.groupBy("place").agg(F.sum("times").alias("times")).toArrow()  # a row a term of the block
    out = np.zeros(n_terms + 2, np.int64)
    out[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return int(out[n_terms]), int(out[n_terms + 1]), out[:n_terms]


class Items:
    """The items of a block as small matrices (item by term), and the weights of the terms."""

    def __init__(self, ids: np.ndarray, item: np.ndarray, term: np.ndarray, times: np.ndarray, n_docs: int, n_all: int, df: np.ndarray):
        self.ids, self.n_docs, self.n_all = ids, n_docs, n_all
        self.weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        order = np.argsort(item, kind="stable")
        item, term, times = item[order], term[order], times[order]
        size = np.bincount(item, minlength=len(ids))
        first, cells = 0, 0
        ends = np.cumsum(size)
        for k in range(len(ids) + 1):
            cells += size[k] if k < len(ids) else 0
            if k > first and (k == len(ids) or (k + 1 - first) * cells > CELLS):
                rows = slice(ends[first] - size[first], ends[k - 1])
                own, at = np.unique(term[rows], return_inverse=True)
                matrix = np.zeros((k - first, len(own)), np.int64)
                matrix[item[rows] - first, at] = times[rows]
                self.groups.append((np.arange(first, k), own, matrix))
                first, cells = k, size[k] if k < len(ids) else 0

    def gains(self, n: np.ndarray, tf: np.ndarray, term: np.ndarray) -> np.ndarray:
        """What one occurrence in an item adds for each (document length, tf, term)."""
        if len(n) and int(n.max()) * self.n_docs >= 2**56:  # Python's integers do not overflow
            m = np.array([25 + 75 * int(x) * self.n_docs // self.n_all for x in n], np.int64)
        else:
            m = 25 + 75 * n * self.n_docs // self.n_all
        return self.weight[term] * (10**9 * tf // (1000 * tf + 8 * m))

    def scored(self, n_docs: int, doc: np.ndarray, term: np.ndarray, gain: np.ndarray) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
        """Items, documents and their scores (documents by items), in blocks."""
        for items, own, matrix in self.groups:
            at = np.minimum(np.searchsorted(own, term), len(own) - 1)
            held = own[at] == term
            step = max(1, CELLS // max(len(own), len(items)))
            exact = float(matrix.sum(axis=1).max()) * float(gain.max(initial=0)) < 2.0**53
            turned = matrix.T.astype(np.float64) if exact else matrix.T
            for k in range(0, n_docs, step):
                a, b = np.searchsorted(doc, [k, k + step])
                own_rows = np.flatnonzero(held[a:b]) + a
                grid = np.zeros((min(step, n_docs - k), len(own)), turned.dtype)
                grid[doc[own_rows] - k, at[own_rows]] = gain[own_rows]
                yield items, slice(k, k + step), (grid @ turned).astype(np.int64)


def _best(scanned: DataFrame, items: Items, k: int) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the ``k`` best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.ones(len(items.ids), np.int64)
        kept = [np.zeros(0, np.int64)] * 3
        pool, size = [], 0

        def settled() -> list[np.ndarray]:
            item, score, doc = (np.concatenate(x) for x in zip(kept, *pool, strict=True))
            order = np.lexsort((doc, -score, item))
            nth = np.arange(len(order)) - np.searchsorted(item[order], item[order])
            last = order[nth == k - 1]
            least[item[last]] = np.maximum(least[item[last]], score[last])
            order = order[nth < k]
            return [item[order], score[order], doc[order]]

        for batch in batches:
            ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            terms, tfs = batch.column(2), batch.column(3)
            doc = np.repeat(np.arange(len(batch)), np.diff(terms.offsets.to_numpy()))
            term, tf = (c.flatten().to_numpy().astype(np.int64) for c in (terms, tfs))
            for own, rows, scores in items.scored(len(batch), doc, term, items.gains(n[doc], tf, term)):
                x, y = np.nonzero(scores >= least[own][None, :])
                pool.append((own[y], scores[x, y], ids[rows][x]))
                size += len(x)
                if size > POOL:
                    kept, pool, size = settled(), [], 0
        item, score, doc = settled()
        columns = [pa.array(items.ids[item]), pa.array(doc), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])

    found = scanned.where(F.col("doc_id").isNotNull()).mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")
    order = [F.desc("score"), F.asc("doc_id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, term_bytes: int = TERM_BYTES) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` (above 0) of the ``k`` best documents of each item; ties by ascending id."""
    spark = docs.sparkSession
    terms_path, out = scratch_path(spark, "item-terms"), scratch_path(spark, "ranked")
    item_terms(items).write.parquet(terms_path)
    for block in _blocks(spark.read.parquet(terms_path), term_bytes):
        own = block.toArrow()
        terms, place = np.unique(np.array(own.column("term").to_pylist(), object), return_inverse=True)
        if not len(terms):
            continue
        path = scratch_path(spark, "term-counts")
        _scanned(docs, terms.tolist()).write.parquet(path)
        scanned = spark.read.parquet(path)
        n_docs, n_all, df = _statistics(scanned, len(terms))
        if n_docs:
            ids, item = np.unique(own.column("item_id").to_numpy(), return_inverse=True)
            block_items = Items(ids, item, place, own.column("times").to_numpy(), n_docs, n_all, df)
            _best(scanned, block_items, k).write.mode("append").parquet(out)
        drop_path(spark, path)
    drop_path(spark, terms_path)
    schema = "item_id bigint, rank int, doc_id bigint, score bigint"
    spark.createDataFrame([], schema).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def brute_force(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    """The result, with all terms of all documents; for tests."""
    import math
    import re
    from collections import Counter

    def of(text: str | None) -> list[str]:
        return re.findall(TERM, (text or "").translate(str.maketrans(UPPER, LOWER)))

    counted = [(i, Counter(of(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_all = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    held: dict[int, list[str]] = {}
    for i, t in sorted({(i, t or "") for i, t in items if i is not None}):
        held.setdefault(i, []).extend(of(t))
    out = []
    for item, terms in held.items():
        scored = []
        for i, c, n in counted:
            m = 25 + 75 * n * n_docs // n_all
            w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms}
            score = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms)
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out
