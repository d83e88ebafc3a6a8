"""Inverted index for "has all skills" requests.

``write_skill_index`` stores the postings once more in blocks and, for each
skill, the lists of the postings that have it.  A request then reads the lists
of its own skills, intersects them from the rarest skill on, and reads only the
blocks of postings that are left, in place of testing every posting.

Layout under ``path``:

* ``postings``: the rows with a row number, partitioned by ``block``.  Numbers are
  given while writing, without a shuffle; the lists come from what was written.
* ``lists``: a row a skill and chunk of ``2**CHUNK_BITS`` consecutive numbers, with the
  sorted places inside the chunk, so that no list holds more than a chunk however
  common the skill; partitioned by a hash of the skill, sorted by skill.
* ``skills``: each skill's number of postings, partitioned alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillmesh.functions.text import country_equals, skills_lower
from skillmesh.operators.recommend import required_skills

#: A chunk of a list covers 2**20 row numbers.
CHUNK_BITS = 20
#: Row numbers hold the number of the writing task above these bits.
TASK_BITS = 33
#: Directories of postings and of lists.
BLOCKS, BUCKETS = 4096, 64

_ROW, _BLOCK = "_index_row", "_index_block"


def _bucket(skill: Column) -> Column:
    return F.pmod(F.xxhash64(skill), F.lit(BUCKETS)).cast("int")


def _block_of(chunk: Column) -> Column:
    return F.pmod(F.shiftright(chunk, TASK_BITS - CHUNK_BITS), F.lit(BLOCKS)).cast("int")


def write_skill_index(postings: DataFrame, path: str) -> None:
    """Writes the index of ``postings`` (any columns, ``job_skills`` among them) to ``path``."""
    spark = postings.sparkSession
    numbered = postings.withColumn(_ROW, F.monotonically_increasing_id())
    chunk = F.shiftright(F.col(_ROW), CHUNK_BITS)
    blocked = numbered.withColumn(_BLOCK, _block_of(chunk))
    blocked.where("false").write.parquet(f"{path}/columns")
    blocked.write.partitionBy(_BLOCK).parquet(f"{path}/postings")
    written = _postings(spark, path)
    skills = F.explode(F.array_distinct(skills_lower("job_skills"))).alias("skill")
    pairs = written.select(chunk.alias("chunk"), F.col(_ROW).bitwiseAND(2**CHUNK_BITS - 1).cast("int").alias("place"), skills)
    lists = pairs.groupBy("skill", "chunk").agg(F.sort_array(F.collect_list("place")).alias("places"))
    bucketed = lists.withColumn("bucket", _bucket(F.col("skill")))
    ordered = bucketed.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "skill", "chunk")
    ordered.write.partitionBy("bucket").parquet(f"{path}/lists")
    counts = spark.read.schema(_LISTS).parquet(f"{path}/lists").groupBy("bucket", "skill").agg(F.sum(F.size("places")).alias("n"))
    counts.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "skill").write.partitionBy("bucket").parquet(f"{path}/skills")


_LISTS = "skill string, chunk bigint, places array<int>, bucket int"
_COUNTS = "skill string, n bigint, bucket int"


def _postings(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; also those of an empty table have all columns."""
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/postings")


def _of_skill(table: DataFrame, skill: str) -> DataFrame:
    """The rows of one skill: one directory, and in it the row groups that hold the skill."""
    return table.where((F.col("bucket") == _bucket(F.lit(skill))) & (F.col("skill") == F.lit(skill)))


def matching_rows(spark: SparkSession, path: str, skills) -> DataFrame | None:
    """``chunk`` and ``places`` of the postings that have all ``skills``; None if some skill is nowhere.

    The lists of one chunk meet in a join on the chunk; chunks that the rarer
    skills leave empty are gone before the next list is read.
    """
    wanted = [s.lower() for s in required_skills(skills)]
    table = spark.read.schema(_COUNTS).parquet(f"{path}/skills")
    found = table.where("false").select("skill", "n")
    for skill in wanted:
        found = found.unionAll(_of_skill(table, skill).select("skill", "n"))
    times = {r.skill: r.n for r in found.collect()}  # a row a wanted skill
    if any(s not in times for s in wanted):
        return None
    lists = spark.read.schema(_LISTS).parquet(f"{path}/lists")
    out = None
    for skill in sorted(set(wanted), key=lambda s: (times[s], s)):
        own = _of_skill(lists, skill).select("chunk", "places")
        if out is None:
            out = own
            continue
        met = out.join(own.withColumnRenamed("places", "other"), "chunk")
        out = met.select("chunk", F.array_intersect("places", "other").alias("places")).where(F.size("places") > 0)
    return out


def postings_with_all_skills(spark: SparkSession, path: str, skills, country: str | None = None) -> DataFrame:
    """As ``filter_has_all_skills`` on the indexed postings; without a ``country``, those of all countries."""
    postings = _postings(spark, path)
    matched = matching_rows(spark, path, skills)
    if matched is None:
        rows = postings.limit(0)
    else:
        blocks = [r[0] for r in matched.select(_block_of(F.col("chunk"))).distinct().collect()]  # at most BLOCKS numbers
        places = matched.select("chunk", F.explode("places").alias("place"))
        wanted = places.select((F.shiftleft("chunk", CHUNK_BITS) + F.col("place")).alias(_ROW))
        rows = postings.where(F.col(_BLOCK).isin(blocks)).join(wanted, _ROW, "left_semi")
    if country is not None:
        rows = rows.where(country_equals(rows, country))
    return rows.drop(_ROW, _BLOCK).withColumn("skills", skills_lower("job_skills"))
