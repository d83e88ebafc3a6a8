"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Texts are folded: lower case, compatibility forms and look-alike letters of
other alphabets to Latin ones, digits and signs that stand for letters to
those letters (signs only inside a word), ``l`` and ``i`` to one class.  Terms
match whole words of the folded text; a match inside an exception phrase does
not count.  The weights of the matches, normalised by the length of the text,
go through a logistic curve.

``learn`` takes the lexicon from labelled texts: a word's weight is the log
ratio of its odds in toxic and other texts, kept where it is significant;
one part of the labelled rows gives the lexicon, the other part, on which the
words were not chosen, gives the logistic curve.  It uses at most
``max_rows`` labelled rows (least hash of the id) and ``max_terms`` terms;
every whole text is scored.

Defined results: null and empty texts have no match and the curve's score for
none; repeated ids each get their own row; labels that are null or not 0 or 1
are not learned; without a toxic label there is no lexicon and every score is
0; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_path, scratch_path
from .common import crc_mod, documents, gives_back

#: Letters of other alphabets that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k",
    "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w",
    "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ℓ": "l", "ø": "o", "ꜱ": "s", "ſ": "s",
}
#: Digits and signs written for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}
#: Harmless phrases with words that can be terms.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "clown nose")

_HIDDEN = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
_TABLE = str.maketrans(LOOK_ALIKES | DIGITS) | _HIDDEN
_SIGN = re.compile(r"(?<=\w)[@$!|€+](?=\w)")
_WORD = re.compile(r"\w+")


def fold(text: str) -> str:
    """The folded text; what is done to terms and texts alike."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower().translate(_TABLE)
    # Look-alikes of capitals come out of lower() as small letters of their alphabet.
    if _SIGN.search(text):
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return text


class Lexicon:
    """Weights of folded terms, exception phrases, and the curve over what they add up to."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.weights = {fold(t): w for t, w in weights.items()}
        self.exceptions = tuple(fold(x) for x in exceptions)
        self.curve = np.array([-4.0, 2.0, 2.0, 0.0])
        self.machine = None

    def _automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            machine.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            machine.add_word(phrase, (len(phrase), self.weights.get(phrase, None)))
        machine.make_automaton()
        return machine

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """Start, end and weight of each term in a folded text, outside of exception phrases."""
        if not self.weights:
            return []
        if self.machine is None:
            self.machine = self._automaton()
        found, excepted = [], []
        for last, (length, weight) in self.machine.iter(folded):
            start, end = last - length + 1, last + 1
            if (start and _word(folded[start - 1])) or (end < len(folded) and _word(folded[end])):
                continue
            if weight is None:
                excepted.append((start, end))
            else:
                found.append((start, end, weight))
        if excepted:
            # Of the exceptions that begin no later than a match, the one that reaches furthest.
            begins, ends = zip(*sorted(excepted), strict=True)
            reach = list(accumulate(ends, max))
            found = [x for x in found if not (k := bisect_right(begins, x[0])) or reach[k - 1] < x[1]]
        return found

    def features(self, text: str) -> tuple[float, float, float, float]:
        """A constant, the summed weight, that weight a hundred words, and the differing terms' count, on log scales."""
        folded = fold(text)
        found = self.matches(folded)
        if not found:
            return 1.0, 0.0, 0.0, 0.0
        total = sum(w for _, _, w in found)
        words = folded.count(" ") + folded.count("\n") + 1
        differing = len({folded[a:b] for a, b, _ in found})
        return 1.0, np.log1p(total), np.log1p(100 * total / (words + 20)), np.log(differing + 0.5)

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(features @ self.curve, -30, 30)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"machine": None}


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression, by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, train: Column, label_col: str = "toxic", max_rows: int = 30_000, max_terms: int = 3_000, least_z: float = 3.5) -> Lexicon:
    """A lexicon from labelled texts; ``train`` tells which rows of ``labels`` may be learned from."""
    known = labels.where(train & F.col(label_col).isin(0, 1)).groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    known = known.agg(F.max(label_col).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # Three quarters choose the words, one quarter fits the curve.
    known = known.withColumn("curve", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4)) == 0)
    texts = documents(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")).join(F.broadcast(known), "doc_id")
    path = scratch_path(docs.sparkSession, "labelled")
    texts.select("text", "label", "curve").write.parquet(path)  # the sample, read by the passes below
    try:
        return _learned(docs.sparkSession.read.parquet(path), max_terms, least_z)
    finally:
        drop_path(docs.sparkSession, path)


def _learned(texts: DataFrame, max_terms: int, least_z: float) -> Lexicon:

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                own = {w for w in _WORD.findall(fold(text.as_py())) if 2 < len(w) < 60}
                counts[label.as_py()].update(own | {""})  # "" counts the texts
        found = sorted(counts[0] | counts[1])
        for k in range(0, len(found), 50_000):
            some = found[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array([c[w] for w in some], pa.int64()) for c in counts)], ["word", "other", "toxic"])

    counted = texts.where(~F.col("curve")).select("text", "label").mapInArrow(words, "word string, other bigint, toxic bigint")
    counted = counted.groupBy("word").agg(F.sum("other").alias("o"), F.sum("toxic").alias("t")).where("t >= 2")
    n = counted.where("word = ''").first()
    if n is None:
        return Lexicon({})
    odds = F.log((F.col("t") + 0.5) / (n.t - F.col("t") + 0.5)) - F.log((F.col("o") + 0.5) / (n.o - F.col("o") + 0.5))
    z = odds / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("o") + 0.5))
    chosen = counted.where("word != ''").select("word", odds.alias("weight"), z.alias("z")).where((F.col("z") >= least_z) & (F.col("weight") >= 2))
    lexicon = Lexicon({r.word: r.weight for r in chosen.orderBy(F.desc("z"), "word").limit(max_terms).collect()})

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [lexicon.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), batch.column(1)], ["f", "label"])

    rows = texts.where("curve").select("text", "label").mapInArrow(features, "f array<double>, label int").collect()  # at most max_rows
    if rows and 0 < sum(r.label for r in rows) < len(rows):
        lexicon.curve = _logistic(np.array([r.f for r in rows]), np.array([r.label for r in rows], float))
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id`` and ``score`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                f = np.array([lexicon.features(t.as_py()) for t in batch.column(1)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lexicon.score(f))], ["doc_id", "score"])

    typed = documents(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return typed.mapInArrow(gives_back(run), "doc_id bigint, score double")


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """``docs``, all columns, without the texts that score ``threshold`` or more."""

    def score(texts):
        import pandas as pd

        return pd.Series(lexicon.score(np.array([lexicon.features(t or "") for t in texts]).reshape(-1, 4)))

    return docs.where(F.pandas_udf(gives_back(score), "double")(F.col("text")) < threshold)


def not_held_out(mod: int, remainder: int, col: str = "doc_id") -> Column:
    """True for rows whose crc32 of the id as text does not leave ``remainder``."""
    return F.coalesce(crc_mod(col, mod) != remainder, F.lit(True))
