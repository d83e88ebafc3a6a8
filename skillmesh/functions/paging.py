"""Pages of a sorted table.

A page near the beginning is a distributed top-k.  A deep page, or one counted from
the end, would make one task hold all rows before it; instead the table is
range-partitioned by the order once and written, the rows of each partition are counted, and
running sums of these counts tell which partitions hold the page.  Only they are
read, and each is sorted by itself.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillmesh.session import scratch_path

#: Pages that end within so many rows are taken as a top-k.
TOP_ROWS = 10_000

_PART, _PLACE = "_page_part", "_page_place"


class OrderedTable:
    """A table in the order of ``order`` (which must tell all rows apart), in partitions of known sizes."""

    def __init__(self, df: DataFrame, order: list[Column]):
        spark = df.sparkSession
        path = scratch_path(spark, "ordered")
        df.repartitionByRange(*order).withColumn(_PART, F.spark_partition_id()).write.parquet(path)
        self.columns, self.order, self.rows = df.columns, order, spark.read.parquet(path)
        counted = self.rows.groupBy(_PART).agg(F.count(F.lit(1)).alias("n")).orderBy(_PART).collect()  # a row a partition
        ends = list(accumulate(r.n for r in counted))
        #: Partition, rows before it and rows up to its end.
        self.parts = [(r[_PART], end - r.n, end) for r, end in zip(counted, ends, strict=True)]
        self.total = ends[-1] if ends else 0

    def slice(self, start: int, stop: int | None) -> DataFrame:
        """Rows ``[start:stop]`` with Python's slice meaning, in order."""
        start, stop, _ = slice(start, stop).indices(self.total)
        held = [(part, before) for part, before, end in self.parts if before < stop and end > start]
        pairs = [F.lit(x).cast("bigint") for part in held for x in part]
        before = F.create_map(*pairs)[F.col(_PART).cast("bigint")] if held else F.lit(0)
        own = self.rows.where(F.col(_PART).isin([part for part, _ in held]))
        nth = F.row_number().over(Window.partitionBy(_PART).orderBy(*self.order))
        placed = own.withColumn(_PLACE, nth + before - 1)
        page = placed.where((F.col(_PLACE) >= start) & (F.col(_PLACE) < stop))
        return page.orderBy(_PLACE).select(*self.columns)


def is_shallow(start: int, stop: int | None, top_rows: int = TOP_ROWS) -> bool:
    return start >= 0 and stop is not None and 0 <= stop <= top_rows


def slice_ordered(df: DataFrame, order: list[Column], start: int, stop: int | None, top_rows: int | None = None) -> DataFrame:
    """Rows ``[start:stop]`` of ``df`` in ``order``, with Python's slice meaning."""
    if start == 0 and stop is None:
        return df.orderBy(*order)
    if is_shallow(start, stop, TOP_ROWS if top_rows is None else top_rows):
        out = df.orderBy(*order).limit(max(start, stop))
        return out.offset(start) if start else out
    return OrderedTable(df, order).slice(start, stop)
