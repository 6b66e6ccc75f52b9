"""Deep pages by an index: a table in range partitions of its order, and the number of rows before each partition.

A page far from the start would sort all that comes before it. Here the rows are dealt by ranges of the order once,
each range in a folder of its own, and counted; page N then reads the one or two ranges that its rows lie in, and the
totals come from the counts. The counts are one row for each range, whatever the number of mappings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapweave.sources.folders import new_folder


@dataclass(frozen=True)
class PageIndex:
    """rows: the table with its range in _part. ranges: (range, number of rows), in order."""

    rows: DataFrame
    ranges: list[tuple[int, int]]
    order: str

    @property
    def total(self) -> int:
        return sum(n for _, n in self.ranges)

    def total_pages(self, limit: int) -> int:
        return -(-self.total // limit)

    def page(self, number: int, limit: int = 25) -> DataFrame:
        """Page number (1-based); an empty page beyond the last. Rows with equal order come in any order among themselves."""
        if limit < 1 or number < 1:
            raise ValueError("limit and page start at 1")
        first, last = (number - 1) * limit, number * limit
        before, parts, skip = 0, [], 0
        for part, n in self.ranges:
            if before < last and before + n > first:
                skip = skip if parts else first - before
                parts.append(part)
            before += n
        found = self.rows.filter(F.col("_part").isin(parts) if parts else F.lit(False)).drop("_part")
        return found.orderBy(self.order).offset(skip).limit(limit)


def build(rows: DataFrame, path: str | None = None, partitions: int | None = None, order: str = "uuid") -> PageIndex:
    """Write rows in ranges of order below path (a new folder if none is given). partitions: how many, else as Spark deals them."""
    path = path or new_folder(rows.sparkSession, "pages")
    dealt = rows.repartitionByRange(*([partitions] if partitions else []), order).withColumn("_part", F.spark_partition_id())
    dealt.sortWithinPartitions("_part", order).write.partitionBy("_part").parquet(path)
    return load(rows.sparkSession, path, order, rows.schema)


def load(spark: SparkSession, path: str, order: str = "uuid", schema: T.StructType | None = None) -> PageIndex:
    """The index in path. schema: the rows' columns, which a folder without rows doesn't tell."""
    reader = spark.read if schema is None else spark.read.schema(T.StructType([*schema, T.StructField("_part", T.IntegerType())]))
    rows = reader.parquet(path)
    counted = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each range
    return PageIndex(rows, sorted((r["_part"], r["n"]) for r in counted), order)
