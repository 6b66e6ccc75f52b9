"""Facet counts from stored bitmaps, without the mappings.

The index numbers the mappings and keeps, for each facet and value, the set of their numbers as bitmaps of 32,768 rows
each. Selected values of a facet are joined by OR, facets by AND, and a count is the number of bits that are left. The
entities' rows are kept as a list of numbers sorted by entity, as most entities have few; a search's identifiers and
confidence range become a bitmap of their own when it is made. A row counts once for a value; nulls don't count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapweave.operators.predicates import confidence_between
from mapweave.plans.search import EntitySearch
from mapweave.schema import FACETS
from mapweave.sources.folders import new_folder


def _bits() -> Column:
    return F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")


def _pairs(facet: str, kind: T.DataType) -> Column:
    """The facet with each of a row's values."""
    values = F.array_distinct(facet) if isinstance(kind, T.ArrayType) else F.array(F.col(facet).cast("string"))
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))


@dataclass(frozen=True)
class BitmapIndex:
    """values: facet, value, bucket, bits. rows: entity, number, confidence."""

    values: DataFrame
    rows: DataFrame

    def selection(self, search: EntitySearch, without: str | None = None) -> DataFrame:
        """(bucket, bits): the rows that a search finds; without: a facet whose own selection doesn't count."""
        ids = [i for i in dict.fromkeys(search.curies) if i]
        found = self.rows.filter(F.col("entity").isin(ids) if ids else F.lit(False)).filter(confidence_between(*search.confidence))
        parts = [found.groupBy(F.bitmap_bucket_number("number").alias("bucket")).agg(_bits())]
        for facet, values in search.facets.items():
            if values is None or facet in ("curies", "confidence", without):
                continue
            chosen = self.values.filter((F.col("facet") == facet) & (F.col("value").isin(values) if values else F.lit(False)))
            parts.append(chosen.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")))
        every = parts[0].withColumn("part", F.lit(0))
        for i, part in enumerate(parts[1:], 1):
            every = every.union(part.withColumn("part", F.lit(i)))
        # a bucket that one of the parts lacks has no common rows
        return every.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(parts)).drop("n")

    def counts(self, search: EntitySearch, facets: tuple[str, ...] = FACETS, exclude_self: bool = False) -> DataFrame:
        """(facet, value, count) of what the search finds; exclude_self: each facet is counted under the other facets' selections only."""
        facets = tuple(f for f in facets if f.lower() != "confidence")
        own = [f for f in facets if exclude_self and search.facets.get(f) is not None]
        rest = [f for f in facets if f not in own]
        out = None
        for group, without in [*(([f], f) for f in own), (rest, None)]:
            if group:
                found = self._counted(self.values.filter(F.col("facet").isin(group)), self.selection(search, without))
                out = found if out is None else out.union(found)
        return out

    def total(self, search: EntitySearch) -> DataFrame:
        """One row: total_items."""
        return self.selection(search).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("total_items"))

    @staticmethod
    def _counted(values: DataFrame, chosen: DataFrame) -> DataFrame:
        both = values.join(chosen.select("bucket", F.col("bits").alias("_bits")), "bucket").select("facet", "value", "bucket", F.explode(F.array("bits", "_bits")).alias("bits"))
        left = both.groupBy("facet", "value", "bucket").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n"))
        return left.groupBy("facet", "value").agg(F.sum("n").alias("count")).filter("count > 0")


def build(mappings: DataFrame, facets: tuple[str, ...] = FACETS, path: str | None = None) -> BitmapIndex:
    """Write the index below path (a new folder if none is given): one pass over the mappings, which are numbered and written first."""
    spark, path = mappings.sparkSession, path or new_folder(mappings.sparkSession, "bitmaps")
    facets = tuple(f for f in facets if f.lower() != "confidence")
    ids = F.array_distinct(F.filter(F.array("subject_id_curie", "object_id_curie"), lambda x: x != ""))
    pairs = F.concat(*(_pairs(f, mappings.schema[f].dataType) for f in facets))
    mappings.select((F.monotonically_increasing_id() + 1).alias("number"), "confidence", ids.alias("ids"), pairs.alias("pairs")).write.parquet(f"{path}/numbered")
    numbered = spark.read.parquet(f"{path}/numbered")
    bits = numbered.select("number", F.inline("pairs")).filter("value is not null").groupBy("facet", "value", F.bitmap_bucket_number("number").alias("bucket")).agg(_bits())
    bits.repartitionByRange("facet", "value", "bucket").sortWithinPartitions("facet", "value").write.parquet(f"{path}/values")
    rows = numbered.select(F.explode("ids").alias("entity"), "number", "confidence")
    rows.repartitionByRange("entity").sortWithinPartitions("entity").write.parquet(f"{path}/rows")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> BitmapIndex:
    return BitmapIndex(spark.read.parquet(f"{path}/values"), spark.read.parquet(f"{path}/rows"))
