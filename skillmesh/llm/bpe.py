"""Byte-level BPE encoding and decoding.

Texts are packed, partition by partition and without a shuffle, into blocks
of a bounded number of characters.  A block's distinct words (the matches of
the tokenizer's pattern) are found once, the ranked merges are folded over
the byte arrays of all of them together, and the ids of the words are put
back into the documents.  Nothing grows with the corpus but the number of
blocks.  Decoding looks each id's bytes up in a literal array with Spark's
higher-order functions and concatenates them.

The fold takes one merge a word and step: the pair of least rank, leftmost
first, in arrays over all words of one byte length.  Words of more than
``LONG_WORD`` bytes (rare runs without a break) are merged by the same rule
with a heap, which is not quadratic in the word.  (A fold by Spark's
higher-order functions gave the same ids at about a hundred times the CPU
time; see README.)

Defined results: null and empty texts have no ids and decode to no bytes; very
long texts make a block of their own; repeated rows (also of one id, or of a
null id) each get their own result; an empty table gives an empty result;
further columns are left out.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, gives_back

#: Characters after which a block is closed.
BLOCK_CHARS = 3_000_000
#: Bytes of a word beyond which its merges use a heap.
LONG_WORD = 64
NO_RANK = 2**31 - 1

Ranks = dict[bytes, int]


def read_ranks(path: str) -> Ranks:
    """Pieces and ranks of a rank file (base64 piece, space, rank on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def merge_long(word: bytes, ranks: Ranks) -> list[int]:
    """Merges the pair of least rank, leftmost first, until none has a rank."""
    end = [i + 1 for i in range(len(word))]
    before = list(range(-1, len(word) - 1))
    alive = [True] * len(word)
    queue: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if i >= 0 and j < len(word) and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(queue, (rank, i, j, end[j]))

    for i in range(len(word)):
        offer(i)
    while queue:
        _, i, j, stop = heapq.heappop(queue)
        if alive[i] and end[i] == j and alive[j] and end[j] == stop:
            alive[j], end[i] = False, stop
            if stop < len(word):
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
    return [ranks[word[i : end[i]]] for i in range(len(word)) if alive[i]]


class Merges:
    """The ranks of all adjacent pairs of pieces, for arrays of pieces."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        pairs = []
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    pairs.append((left << 32 | right, rank))
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.of = np.array([r for _, r in pairs] or [NO_RANK], np.int32)
        self.byte = np.array([ranks.get(bytes([b]), NO_RANK) for b in range(256)], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.of[at], NO_RANK)

    def fold(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a row a word, ``NO_RANK`` after its end) and their number, for words of one length (a row of bytes each)."""
        ids = self.byte[words]
        n, width = ids.shape
        rank = np.full((n, width), NO_RANK, np.int32)
        if width > 1:
            rank[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        count = np.full(n, width)
        todo = np.arange(n)
        while len(todo):
            at = rank[todo].argmin(axis=1)
            best = rank[todo, at]
            todo, at, best = (x[best < NO_RANK] for x in (todo, at, best))
            if not len(todo):
                break
            # Close the gap behind the merged pair, then rank its two new neighbours.
            behind = np.arange(width - 1)[None, :] > at[:, None]
            for m in (ids, rank):
                own = m[todo]
                own[:, :-1] = np.where(behind, own[:, 1:], own[:, :-1])
                own[:, -1] = NO_RANK
                m[todo] = own
            ids[todo, at] = best
            rank[todo, at] = NO_RANK
            count[todo] -= 1
            more = at + 1 < count[todo]
            rows, cols = todo[more], at[more]
            rank[rows, cols] = self.rank(ids[rows, cols], ids[rows, cols + 1])
            less = at > 0
            rows, cols = todo[less], at[less]
            rank[rows, cols - 1] = self.rank(ids[rows, cols - 1], ids[rows, cols])
        return ids, count

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the number of ids of each word."""
        count = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ranks = self.ranks
        whole = np.fromiter((ranks.get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(whole >= 0)
        count[known] = 1
        parts.append((known, whole[known]))
        lengths[known] = 0
        for width in np.unique(lengths[lengths > 0]):
            rows = np.flatnonzero(lengths == width)
            if width > LONG_WORD:
                for i in rows:
                    ids = merge_long(words[i], ranks)
                    count[i] = len(ids)
                    parts.append((np.full(len(ids), i), np.array(ids, np.int64)))
                continue
            own = np.frombuffer(b"".join([words[i] for i in rows]), np.uint8).reshape(len(rows), width)
            ids, n = self.fold(own)
            count[rows] = n
            parts.append((np.repeat(rows, n), ids[np.arange(width)[None, :] < n[:, None]].astype(np.int64)))
        word = np.concatenate([w for w, _ in parts])
        ids = np.concatenate([i for _, i in parts])
        return ids[np.argsort(word, kind="stable")], count


def take_runs(values: np.ndarray, counts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of ``values`` (run i has ``counts[i]`` of them), one after another."""
    starts = np.cumsum(counts) - counts
    n = counts[which]
    ends = np.cumsum(n)
    return values[np.repeat(starts[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class _Numbers(dict):
    """Numbers its keys as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class _Block:
    """Texts as parts, parts as words, words as ids."""

    def __init__(self, merges: Merges, pattern: str):
        import regex

        # Explicit property: the white space of the Unicode standard.
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.unclear = regex.compile(r"\p{White_Space} ").search
        self.merges = merges
        self.clear()

    def clear(self) -> None:
        self.docs: list[tuple[int | None, str | None, list[str]]] = []
        self.chars = 0

    def add(self, doc_id: int | None, text: str) -> None:
        # A space after anything but white space starts a new match, so such a
        # text may be cut there and each distinct part matched once.
        if self.unclear(text):
            self.docs.append((doc_id, text, []))
        else:
            first, *rest = text.split(" ")
            self.docs.append((doc_id, first, rest))
        self.chars += len(text)

    def rows(self) -> pa.RecordBatch:
        words = _Numbers()
        parts = _Numbers()
        using: list[np.ndarray] = []
        for _, _, rest in self.docs:
            using.append(np.fromiter(map(parts.__getitem__, rest), np.int64, len(rest)))
        # A part without white space at its ends begins with the only space in it,
        # which begins its first match, so all of these are matched at once; the
        # others would meet across their borders and are matched one by one.
        alone = np.fromiter((not p or p[0].isspace() or p[-1].isspace() for p in parts), bool, len(parts))
        place = np.empty(len(parts), np.int64)
        place[np.argsort(alone, kind="stable")] = np.arange(len(parts))
        using = [place[u] for u in using]
        found = self.find("".join([" " + p for p, a in zip(parts, alone, strict=True) if not a]))
        codes = [np.fromiter(map(words.__getitem__, found), np.int64, len(found))]
        begins = np.flatnonzero(np.fromiter((w[0] == " " for w in found), bool, len(found)))
        n_words = [np.diff(begins, append=len(found))]
        for part in [p for p, a in zip(parts, alone, strict=True) if a]:
            own = [words[w] for w in self.find(" " + part)]
            codes.append(np.array(own, np.int64))
            n_words.append(np.array([len(own)]))
        for first in [x for _, x, _ in self.docs]:
            own = [words[w] for w in self.find(first)] if first else []
            codes.append(np.array(own, np.int64))
            n_words.append(np.array([len(own)]))
        ids, n_ids = self.merges.encode([w.encode("utf-8", "surrogatepass") for w in words])
        # Ids of each part, then of each document: its first part and the rest.
        word_of = np.concatenate(codes)
        part_words = np.concatenate(n_words)
        part_ids = take_runs(ids, n_ids, word_of)
        ends = np.concatenate([[0], np.cumsum(n_ids[word_of])])[np.cumsum(part_words)]
        part_n = np.diff(ends, prepend=0)
        order = np.concatenate([x for i, u in enumerate(using) for x in (np.array([len(parts) + i]), u)])
        out = take_runs(part_ids, part_n, order)
        of_parts = np.concatenate([[0], np.cumsum(part_n[order])])
        offsets = of_parts[np.concatenate([[0], np.cumsum([len(u) + 1 for u in using])])]
        lists = pa.ListArray.from_arrays(offsets.astype(np.int32), out.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array([d for d, _, _ in self.docs], pa.int64()), lists], ["doc_id", "ids"])


def encode(docs: DataFrame, ranks: Ranks, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of each text, without special tokens."""

    merges = Merges(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(merges, pattern)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                block.add(doc_id.as_py(), text.as_py())
                if block.chars >= block_chars:
                    yield block.rows()
                    block.clear()
        if block.docs:
            yield block.rows()

    typed = documents(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return typed.mapInArrow(gives_back(run), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, ranks: Ranks, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the pieces of the ids, one after another."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    joined = F.array_join(F.transform(F.coalesce(ids_col, F.array()), lambda i: F.get(table, i)), "")
    return encoded.withColumn("decoded", F.unhex(joined))


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id``, ``n_tokens``, and SHA-256 of the ids as text and of the decoded bytes."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
