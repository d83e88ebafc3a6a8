"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import inspect

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and U+0009 to U+000D (as a Java regex class).
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), named ``doc_id`` and ``text``.

    Further columns, whatever their names, are left out of the work, so they
    cannot clash with the operators' own columns.
    """
    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _trim() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def gives_back(run):
    """``run`` (for ``mapInArrow``, or a function of a series), after which the worker returns freed memory to the system.

    Python workers stay alive between stages; what they keep would count against the next stage's executors.
    """

    def batches(own):
        try:
            yield from run(own)
        finally:
            _trim()

    def series(own):
        out = run(own)
        _trim()
        return out

    return batches if inspect.isgeneratorfunction(run) else series


def slots(spark: SparkSession) -> int:
    """Partitions for a shuffle that AQE does not resize."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(mod))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix constants): scatters consecutive values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash; forgets all words beyond ``most`` to bound memory."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(text: str) -> list[bytes]:
    """Words between runs of U+0020 and U+0009 to U+000D, unchanged, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()
