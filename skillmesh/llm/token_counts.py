"""Token counts: batches of texts encoded in Arrow functions that return lengths only.

Texts are taken from Arrow batches and put into encoding batches of about
``BATCH_BYTES`` bytes of UTF-8, however many texts that is; a text of more
than ``PIECE_BYTES`` is cut into pieces first, which may lie in several batches
and whose counts are added up.  So a call of the tokenizer holds a bounded
number of tokens, whatever the texts' lengths, and nothing but the counts
leaves the task.  Nothing is shuffled.

Safe boundaries: a text is cut before an ASCII white-space character that
follows a printable ASCII one.  No match of the byte-level pattern crosses
such a place (a match holds white space only at its beginning), none looks
behind itself, and a look ahead from white space sees the same run in its own
piece.  Added tokens must have no white space and strip none.  ``cuts_safely`` proves
this from the vocabulary file; with any other file (sentencepiece models,
other patterns, normalisers) every text is encoded whole.  A long run without
such a place stays one piece.

Defined results: null and empty texts have 0 bytes and 0 tokens; strings of
added tokens inside a text are handled as the library does by default; repeated
rows, also of one id or of a null id, each get their own row; an empty
table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

#: Bytes of text encoded in one call.
BATCH_BYTES = 1 << 20
#: Bytes of a text from which on it is cut at the next safe boundary.
PIECE_BYTES = 1 << 17

_BOUNDARY = re.compile(rb"[\x21-\x7E](?=[\x20\x09-\x0D])")


def cuts_safely(vocabulary: bytes) -> bool:
    """Whether texts may be cut at ``_BOUNDARY`` without changing their tokens by this file."""
    try:
        file = json.loads(vocabulary)
    except ValueError:
        return False
    pattern, model, after = file.get("pre_tokenizer") or {}, file.get("model") or {}, file.get("post_processor")
    plain = file.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout")
    own_pattern = pattern.get("type") == "ByteLevel" and pattern.get("use_regex", True) and not pattern.get("add_prefix_space")
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])) for t in file.get("added_tokens") or [])
    return plain and own_pattern and added and (after is None or after.get("type") == "ByteLevel")


def counter(vocabulary: bytes) -> Callable[[list[str]], list[int]]:
    """Numbers of tokens of texts: by tokenizers for a JSON file, else by sentencepiece."""
    if not vocabulary.lstrip()[:1] == b"{":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=vocabulary)
        return lambda texts: [len(ids) for ids in model.encode(texts, add_bos=False, add_eos=False, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary.decode("utf-8"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def pieces(text: bytes, most: int = PIECE_BYTES) -> Iterator[bytes]:
    """The text in pieces of ``most`` bytes, each up to the next safe boundary; all of them joined are the text."""
    begin = 0
    while len(text) - begin > most:
        cut = _BOUNDARY.search(text, begin + most - 1)
        if cut is None:
            break
        yield text[begin : cut.end()]
        begin = cut.end()
    yield text[begin:]


def _balanced(texts: Iterator[bytes], cut: bool, batch: int, piece: int) -> Iterator[tuple[list[int], list[str]]]:
    """Batches of about ``batch`` bytes: the texts' numbers and the pieces."""
    rows: list[int] = []
    own: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        for part in pieces(text, piece) if cut else (text,):
            if part:
                rows.append(row)
                own.append(part.decode("utf-8", "replace"))
                size += len(part)
            if size >= batch:
                yield rows, own
                rows, own, size = [], [], 0
    if own:
        yield rows, own


def counts(docs: DataFrame, vocabulary: bytes, batch_bytes: int = BATCH_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of each document by the content of a vocabulary file."""
    cut = cuts_safely(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        # Cores belong to Spark's tasks, not to threads of the library.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = counter(vocabulary)
        for batch in batches:
            texts = batch.column(1)
            n = np.zeros(len(batch), np.int64)
            for rows, own in _balanced((x.as_buffer().to_pybytes() for x in texts), cut, batch_bytes, piece_bytes):
                np.add.at(n, rows, count(own))
            n_bytes = pa.array([len(x.as_buffer()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    typed = documents(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return typed.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")


def within_limit(docs: DataFrame, vocabulary: bytes, limit: int) -> DataFrame:
    """``counts`` with ``over_limit``: whether a document has more than ``limit`` tokens."""
    return counts(docs, vocabulary).withColumn("over_limit", F.col("n_tokens") > limit)
