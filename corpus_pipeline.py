"""From raw documents to token ids: five stages, each on all that the one before it kept.

Toxic documents go, one document of each near-duplicate class stays,
documents that hold a benchmark passage go, personal data is masked, and what
is left is encoded (and decoded again as a check).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillmesh.llm import bagminhash, bpe, decontamination, pii, toxicity
from skillmesh.llm.common import table
from skillmesh.session import scratch_path


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores under 0.3; null and empty texts score as harmless and stay, repeated rows each by themselves.

    The lexicon is learned from the labels of all ids of which crc32 modulo 4 is not 2.
    """
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), toxicity.not_held_out(4, 2))
    return toxicity.keep_clean(docs, lexicon, threshold=0.3)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: the least id's, rows without an id last; texts without words are one class.

    Rows count by id and text: an id with several texts is several documents.
    """
    return bagminhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no item of ``benchmark``; null and empty texts hold none."""
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in the text replaced by its kind; ``n_chars`` is the new text's length, null for a null text."""
    return pii.mask(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast("long"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, number of ids, the ids and the digest of the decoded bytes of all rows; null texts are empty."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    decoded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("near_duplicates", one_of_each_class),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("byte_bpe", token_ids),
]

#: SQL cannot express the stages; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, out, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
    return out
