"""Readers and writers for postings and summary files.

Readers take any Hadoop-compatible path (local, HDFS, object stores); none
of them infers types from the data, so opening a large input costs at most
a look at its header.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillmesh.functions.text import COUNTRY_KEY, COUNTRY_SIGN

POSTING_COLUMNS = ("job_title", "search_country", "job_skills")


def read_postings(spark: SparkSession, path, fmt: str = "csv", columns=POSTING_COLUMNS) -> DataFrame:
    """Postings with every column as text.

    CSV is read with its header row and no type inference; only the named
    columns, and ``month_year`` where the file has it, are kept, so later
    scans read nothing else.  ``fmt="parquet"``
    reads a columnar copy instead.
    """
    if fmt == "csv":
        df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"postings at {path} lack columns {missing}")
    if "month_year" in df.columns and "month_year" not in columns:
        columns = (*columns, "month_year")
    cols = [F.col(c).cast("string").alias(c) for c in columns]
    if COUNTRY_KEY in df.columns and COUNTRY_KEY not in columns:
        # partition column of a country-keyed table: keep it so country
        # filters prune directories
        cols.append(F.col(COUNTRY_KEY))
    return df.select(*cols)


def read_counts(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """JSON Lines with a declared schema (S2, S3); absent fields read as NULL."""
    return spark.read.schema(schema).json(path)


def load_or_empty(spark: SparkSession, path, schema: T.StructType, losses: Observation | None = None) -> DataFrame:
    """Tolerant JSON Lines load (S4): an absent path gives an empty table of
    ``schema``; lines that do not parse or have a value of the wrong type are
    dropped, and of a list only the bad elements are.  Every record is parsed
    whole before any column is dropped, so the rows do not depend on the
    columns that are read.  ``losses`` counts what was lost while the first action on the
    table runs: ``losses.get`` then has ``lines`` (not blank),
    ``dropped_lines`` and ``dropped_elements`` (an absent path counts nothing).
    :func:`rejected_lines` lists the lines themselves.  Other failures raise."""
    parsed = _parsed_lines(spark, path, schema)
    if parsed is None:
        return spark.createDataFrame([], schema)
    if losses is not None:
        parsed = parsed.observe(
            losses,
            F.count(F.lit(1)).alias("lines"),
            F.count_if(~F.col("ok")).alias("dropped_lines"),
            F.coalesce(F.sum(F.when(F.col("ok"), _bad_elements(schema))), F.lit(0)).alias("dropped_elements"),
        )
    return parsed.filter(F.col("ok")).select(*[_kept(F.col("record")[f.name], f.dataType).alias(f.name) for f in schema])


def _bad_elements(schema: T.StructType) -> Column:
    """The number of elements of a parsed line's record lists that do not fit."""

    def of(f: T.StructField) -> Column:
        bad = F.filter(F.col("record")[f.name], lambda e: e.isNotNull() & ~_is_good(e, f.dataType.elementType))
        return F.coalesce(F.size(bad), F.lit(0))

    return sum((of(f) for f in schema if _is_record_list(f.dataType)), F.lit(0))


def rejected_lines(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """``line`` and ``elements_only`` of each line that :func:`load_or_empty`
    drops (false) or takes without some bad list elements (true)."""
    parsed = _parsed_lines(spark, path, schema)
    if parsed is None:
        return spark.createDataFrame([], "line string, elements_only boolean")
    some = _bad_elements(schema) > 0
    return parsed.filter(~F.col("ok") | some).select("line", F.col("ok").alias("elements_only"))


_BAD = "_bad_record"


def _is_record_list(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)


def _parse(text, schema: T.StructType):
    """The text as a record, with the text itself in ``_BAD`` where it does not fit."""
    whole = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    return F.from_json(text, whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})


def _is_good(text, schema: T.StructType):
    record = _parse(text, schema)
    return record.isNotNull() & record[_BAD].isNull()


def _kept(value, kind: T.DataType):
    """A parsed column; of a list of records the elements that fit."""
    if not _is_record_list(kind):
        return value
    fields = kind.elementType.fields
    good = F.filter(F.transform(value, lambda e: _parse(e, kind.elementType)), lambda r: r.isNull() | r[_BAD].isNull())
    return F.transform(good, lambda r: F.when(r.isNotNull(), F.struct(*[r[f.name].alias(f.name) for f in fields])))


def _parsed_lines(spark: SparkSession, path, schema: T.StructType) -> DataFrame | None:
    """``line``, ``record`` and ``ok`` of each non-blank line; None for an absent path.

    Lists of records are taken as lists of texts, parsed one by one later.
    """
    loose = T.StructType(
        [T.StructField(f.name, T.ArrayType(T.StringType()) if _is_record_list(f.dataType) else f.dataType) for f in schema]
    )
    try:
        lines = spark.read.text(path)
        # Resolving the file index raises for an absent path.
        lines.inputFiles()
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in (exc.getCondition() or "") or "Path does not exist" in str(exc):
            return None
        raise
    lines = lines.select(F.col("value").alias("line")).filter(F.trim("line") != "")
    return lines.withColumn("record", _parse(F.col("line"), loose)).withColumn(
        "ok", F.col("record").isNotNull() & F.col(f"record.{_BAD}").isNull()
    )


def persist_postings(postings: DataFrame) -> DataFrame:
    """Keep the posting columns the queries use (and ``month_year`` when
    present, for the monthly summary) in memory, spilling to disk, for
    repeated queries (S5).  Call ``unpersist()`` when done."""
    from pyspark import StorageLevel

    keep = [c for c in (*POSTING_COLUMNS, "month_year", COUNTRY_KEY) if c in postings.columns]
    return postings.select(*keep).persist(StorageLevel.MEMORY_AND_DISK)


def with_country_key(df: DataFrame) -> DataFrame:
    """Adds the partition key: ``=`` and the lower-cased ``search_country``.

    The sign keeps a blank country apart from NULL and a numeric one text.
    """
    return df.withColumn(COUNTRY_KEY, F.concat(F.lit(COUNTRY_SIGN), F.lower("search_country")))


def write_country_keyed(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by the country key.

    Country lookups on such a table (equality or substring, any case) prune
    to the matching partitions instead of scanning every file.  Rows are
    rebalanced by the key before writing: each task writes few files, and
    AQE splits a large country by size, however large it is.
    """
    keyed = with_country_key(df).hint("rebalance", F.col(COUNTRY_KEY))
    keyed.write.mode(mode).partitionBy(COUNTRY_KEY).parquet(path)


def read_country_keyed(spark: SparkSession, path: str) -> DataFrame:
    """A table written by :func:`write_country_keyed`; keeps the
    country key, as text whatever its values look like."""
    found = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, T.StringType()) if f.name == COUNTRY_KEY else f for f in found]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row in column ``json``; NULL fields omitted."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write rows as JSON Lines (the summaries' file format)."""
    df.write.mode(mode).json(path)


def write_postings_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV; leading and trailing spaces of values are kept."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
