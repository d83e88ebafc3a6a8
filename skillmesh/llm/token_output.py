"""Token ids written as patched frame-of-reference blocks, and read back.

``write_tokens`` encodes each document with a tokenizers vocabulary, appends
an end id and cuts the ids into blocks of ``BLOCK`` ids.  A block stores its
minimum, subtracts it, packs the differences at the width that the given
percentile of them needs, and keeps the larger ones in an exception list
(positions and high parts).  Each document's record has an index of where its
blocks start, so a block can be read without those before it.

The files are Parquet in ``path``/shard=N/: one row a document with its id,
number of tokens, block index and packed bytes; shards hold ascending ranges
of doc_id and each is sorted, so reading shards by number gives ascending
doc_id order.  An id with a very large number of rows is divided among several shards by
hash of its ids.  Parquet is the container so that any store Spark writes to
works and a lost task's partial output never shows.  Shard bounds come from
the id column alone; the ids are packed before the one shuffle, which moves
the packed bytes.

Defined results: null and empty texts hold the end id only; null ids come
first; repeated ids follow each other by number of tokens, then bytes (inside a shard), each
with its own start; strings of special tokens in a text are handled as the library does by default; an empty table writes no shard and reads as an empty
table; further columns are left out.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .bpe import take_runs
from .common import documents, slots

BLOCK = 128
#: Share of a block's differences that the packed width must hold.
PERCENTILE = 0.9
#: Words whose ids a task remembers, about.
CACHED_WORDS = 400_000

RECORD = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("block_starts", T.BinaryType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack(ids: np.ndarray, counts: np.ndarray, percentile: float = PERCENTILE) -> tuple[list[bytes], list[bytes]]:
    """Block indexes (uint32 offsets) and packed bytes of several documents.

    ``ids`` has their ids one after another, ``counts`` the number of each.
    A block is: minimum (uint32), width (uint8), number of ids (uint8),
    number of exceptions (uint8), one zero byte, the packed low bits, the
    exceptions' positions (uint8 each), their high parts (uint32 each).
    """
    per_doc = -(-counts // BLOCK)
    n = int(per_doc.sum())
    doc = np.repeat(np.arange(len(counts)), per_doc)
    nth = np.arange(n) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    size = np.minimum(counts[doc] - nth * BLOCK, BLOCK)
    begin = (np.cumsum(counts) - counts)[doc] + nth * BLOCK
    at = np.arange(BLOCK)
    real = at[None, :] < size[:, None]
    kind = np.int32 if not len(ids) or ids.max() < 2**31 else np.int64
    grid, none = ids.astype(kind)[np.minimum(begin[:, None] + at[None, :], max(len(ids) - 1, 0))], np.iinfo(kind).max
    least = np.where(real, grid, none).min(axis=1)
    grid = np.where(real, grid - least[:, None], 0)
    ranked = np.sort(np.where(real, grid, none), axis=1)
    width = _widths(ranked[np.arange(n), np.ceil(size * percentile).astype(np.int64) - 1])
    high = grid >> width[:, None].astype(kind)
    odd = (high > 0) & real
    low = grid & ((np.int64(1) << width) - 1)[:, None].astype(kind)
    n_odd, n_bytes = odd.sum(axis=1), (size * width + 7) // 8
    length = 8 + n_bytes + 5 * n_odd
    start = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), np.uint8)
    head = np.zeros((n, 8), np.uint8)
    head[:, :4] = least.astype("<u4").view(np.uint8).reshape(n, 4)
    head[:, 4], head[:, 5], head[:, 6] = width, size, n_odd
    out[start[:, None] + np.arange(8)] = head
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        bits = ((low[rows][:, :, None] >> np.arange(w, dtype=kind)[None, None, :]) & 1).astype(np.uint8)
        own = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        span = np.arange(own.shape[1])
        held = span < n_bytes[rows][:, None]
        out[((start[rows] + 8)[:, None] + span)[held]] = own[held]
    block, where = np.nonzero(odd)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_odd) - n_odd, n_odd)
    exceptions = (start + 8 + n_bytes)[block]
    out[exceptions + nth] = where
    over = high[odd].astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(exceptions + n_odd[block] + 4 * nth)[:, None] + np.arange(4)] = over
    last = np.cumsum(per_doc)
    ends = np.append(start, len(out))
    begins = ends[last - per_doc]
    indexes = np.split((start - np.repeat(begins, per_doc)).astype("<u4"), last[:-1])
    raw = out.tobytes()
    payloads = [raw[i:j] for i, j in zip(begins.tolist(), ends[last].tolist(), strict=True)]
    return [x.tobytes() for x in indexes], payloads


def unpack_block(payload: bytes, start: int) -> np.ndarray:
    """The ids of the block that begins at byte ``start``."""
    least = int.from_bytes(payload[start : start + 4], "little")
    width, size, n_odd = payload[start + 4 : start + 7]
    at = start + 8
    n_bytes = (size * width + 7) // 8
    out = np.full(size, least, np.int64)
    if width:
        bits = np.unpackbits(np.frombuffer(payload, np.uint8, n_bytes, at), count=size * width, bitorder="little")
        out += bits.reshape(size, width) @ (1 << np.arange(width))
    at += n_bytes
    where = np.frombuffer(payload, np.uint8, n_odd, at)
    over = np.frombuffer(payload[at + n_odd : at + 5 * n_odd], "<u4")
    out[where] += over.astype(np.int64) << width
    return out


def unpack_many(payloads: list[bytes], indexes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of several documents, one after another, and the number of each; by width, not block by block."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    lengths = np.fromiter(map(len, payloads), np.int64, len(payloads))
    own = [np.frombuffer(x, "<u4").astype(np.int64) for x in indexes]
    per_doc = np.fromiter(map(len, own), np.int64, len(own))
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(payloads), np.int64)
    begin = np.concatenate(own) + np.repeat(np.cumsum(lengths) - lengths, per_doc)
    least = (data[begin[:, None] + np.arange(4)].astype(np.int64) << (8 * np.arange(4))).sum(axis=1)
    width, size, n_odd = (data[begin + k].astype(np.int64) for k in (4, 5, 6))
    n_bytes = (size * width + 7) // 8
    grid = np.repeat(least[:, None], BLOCK, axis=1)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        span = np.arange(BLOCK * w // 8)
        raw = data[np.minimum(begin[rows][:, None] + 8 + span, len(data) - 1)]
        bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
        value = np.zeros((len(rows), BLOCK), np.int64)
        for k in range(w):
            value += bits[:, :, k].astype(np.int64) << k
        grid[rows] += value
    block = np.repeat(np.arange(len(begin)), n_odd)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_odd) - n_odd, n_odd)
    exceptions = (begin + 8 + n_bytes)[block]
    high = exceptions + n_odd[block] + 4 * nth
    over = (data[high[:, None] + np.arange(4)].astype(np.int64) << (8 * np.arange(4))).sum(axis=1)
    grid[block, data[exceptions + nth]] += over << width[block]
    doc = np.repeat(np.arange(len(payloads)), per_doc)
    counts = np.bincount(doc, weights=size, minlength=len(payloads)).astype(np.int64)
    return grid[np.arange(BLOCK)[None, :] < size[:, None]], counts


#: Texts and parts of these characters are cut into words here: their lower case and classes do not depend on the Unicode version.
_PLAIN = re.compile("[ -~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF\t\n\r]*")
#: Marks in the stream of words: a text's end, a part that the library's whole tokenizer takes.
_END, _ODD = "\x00", "\x02"
#: Fixed value: what the vocabulary's pattern matches in lower-cased plain text; and the marks.
_WORDS = re.compile("[a-zß-öø-ÿ]+|[0-9\x00\x02]|'(?:s|t|re|ve|m|ll|d)|[^\\sa-z0-9ß-öø-ÿ\x00\x02]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable in Latin-1, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def plain_file(vocabulary: str) -> bool:
    """Whether the file's steps before its BPE model are those that ``WordEncoder`` takes by itself for plain texts."""
    file = json.loads(vocabulary)
    steps = [*(file.get("normalizer") or {}).get("normalizers", []), *(file.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    kinds = [(x.get("type"), (x.get("pattern") or {}).get("Regex"), x.get("behavior"), x.get("invert"), x.get("use_regex"), x.get("add_prefix_space")) for x in steps]
    pattern = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"  # fixed value
    return kinds == [
        ("NFC", None, None, None, None, None),
        ("Replace", "\\s+", None, None, None, None),
        ("Lowercase", None, None, None, None, None),
        ("Split", pattern, "Removed", True, None, None),
        ("ByteLevel", None, None, None, False, False),
    ] and not file["model"].get("dropout") and all("<|" in t["content"] for t in file.get("added_tokens") or [])


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space.

    Plain texts are cut into words, which go straight to the library's BPE
    model, each once; of other texts, and those that may hold the string of a special
    token, each part between spaces that is not plain goes through the library's whole tokenizer.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # cores belong to Spark's tasks
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model, self.plain_file, self.letters = self.tokenizer.model, plain_file(vocabulary), byte_letters()
        self.clear()

    def clear(self) -> None:
        """Forgets all words; the first two are the marks, whose ids are set by ``encode``."""
        self.words = {_END: 0, _ODD: 1}
        self.ids, self.counts = array("q", [0]), array("q", [1, 0])

    def _learn(self, words: Iterable[str]) -> None:
        """The ids of new words."""
        known, letters, tokenize = self.words, self.letters, self.model.tokenize
        for word in words:
            if word not in known:
                if word[0] == _ODD:
                    ids = self.tokenizer.encode(word[1:], add_special_tokens=False).ids if word[1:] else []
                elif word.isascii():
                    ids = [t.id for t in tokenize(word)]
                else:
                    ids = [t.id for t in tokenize("".join([letters[b] for b in word.encode()]))]
                known[word] = len(known)
                self.ids.extend(ids)
                self.counts.append(len(ids))

    def _is_plain(self, text: str) -> bool:
        return self.plain_file and _PLAIN.fullmatch(text) is not None and "<|" not in text

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, each with ``end`` after them, and the number of ids of each."""
        if len(self.words) > CACHED_WORDS:
            self.clear()
        self.ids[0] = end
        odd: list[str] = []
        stream: list[str] = []
        for text in texts:
            if not self._is_plain(text):
                parts = text.split(" ")
                fits = [self._is_plain(p) for p in parts]
                odd += [_ODD + p for p, fit in zip(parts, fits, strict=True) if not fit]
                text = " ".join([p if fit else _ODD for p, fit in zip(parts, fits, strict=True)])
            stream.append(text)
        found = _WORDS.findall(_END.join([*stream, ""]).lower())
        self._learn(dict.fromkeys(chain(found, odd)))
        number = self.words.__getitem__
        which = np.fromiter(map(number, found), np.int64, len(found))
        which[which == 1] = np.fromiter(map(number, odd), np.int64, len(odd))
        ids, counts = (np.array(np.frombuffer(x, np.int64)) for x in (self.ids, self.counts))
        ends = np.flatnonzero(which == 0)
        n = np.diff(np.cumsum(counts[which])[ends], prepend=0)
        return take_runs(ids, counts, which), n


def encode(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """A packed record (``RECORD``) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(vocabulary)
        for batch in batches:
            for some in _slices(batch, batch.column(1)):
                ids, counts = encoder.encode(some.column(1).to_pylist(), end_id)
                indexes, payloads = pack(ids, counts)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(counts), pa.array(indexes, pa.binary()), pa.array(payloads, pa.binary())],
                    RECORD.names,
                )

    typed = documents(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return typed.mapInArrow(run, RECORD)


def _slices(batch: pa.RecordBatch, column: pa.Array, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of ``column``, at least a row each."""
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in column], np.int64)
    group = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int = 1, shards: int | None = None) -> None:
    """Writes the ids of ``docs`` to ``path`` in ascending doc_id order."""
    n = shards or slots(docs.sparkSession)
    typed = documents(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    place = F.coalesce("doc_id", F.lit(-(2**63)))
    bounds = sorted(typed.select(place.alias("place")).approxQuantile("place", [i / n for i in range(1, n)], 0.2 / n))
    cuts = F.array(*[F.lit(int(b)) for b in bounds]).cast("array<bigint>")
    below = F.size(F.filter(cuts, lambda b: b < place))
    # Rows of an id that is a cut itself, or several, are dealt to the shards around it by hash.
    equal = F.size(F.filter(cuts, lambda b: b == place))
    share = F.pmod(F.col("hash"), F.lit(2**31)) / F.lit(2.0**31)
    shard = (below + F.floor(share * (equal + 1)).cast("int")).cast("int")
    packed = encode(typed, vocabulary, end_id).withColumn("hash", F.xxhash64("payload")).withColumn("shard", shard)
    dealt = packed.repartitionById(n, "shard").drop("hash")
    dealt.sortWithinPartitions("shard", "doc_id", "n_tokens", "payload").write.partitionBy("shard").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written records with their ``shard``."""
    schema = T.StructType([*RECORD.fields, T.StructField("shard", T.IntegerType())])
    return spark.read.schema(schema).parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` of each written document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch, batch.column(2)):
                ids, counts = unpack_many(some.column(2).to_pylist(), some.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(offsets, ids)], ["doc_id", "ids"])

    records = read_tokens(spark, path).select("doc_id", "block_starts", "payload")
    return records.mapInArrow(run, "doc_id bigint, ids array<bigint>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of each document, from the written files.

    The starts are sums inside a shard (small rows, shards of equal size) on
    top of the totals of the shards before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch, batch.column(3)):
                ids, counts = unpack_many(some.column(3).to_pylist(), some.column(2).to_pylist())
                raw, ends = ids.astype("<u4"), np.cumsum(counts)
                sums = [zlib.crc32(raw[e - n : e].tobytes()) for n, e in zip(counts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(counts), pa.array(sums, pa.int64())],
                    ["shard", "doc_id", "n_tokens", "ids_crc32"],
                )

    records = read_tokens(spark, path).select("shard", "doc_id", "block_starts", "payload")
    read = records.mapInArrow(run, "shard int, doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    totals = read_tokens(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select(
        "shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before")
    )
    inside = Window.partitionBy("shard").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = read.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(F.broadcast(before), "shard").select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
