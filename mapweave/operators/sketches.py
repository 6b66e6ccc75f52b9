"""Statistics that can be merged: sketches of the sets, providers and entities of each group of mappings.

A sketch (HyperLogLog, 2^lg registers) is made once for each group, such as a day or a provider; the statistics of any
selection of groups, and of groups that come later, are unions of sketches, without the mappings. Counts of mappings
are exact. Counts of distinct values have a relative standard error of 1.04 / sqrt(2^lg) (1.6 % for 12) and are nearly
exact up to about 2^lg / 10 values. Empty and null identifiers don't count.

Where all counts have to be exact, sets and exact_stats do the same with the different values themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sketched columns and what they are made of.
KINDS = {"sets": ("mapping_set_id",), "providers": ("mapping_provider",), "entities": ("subject_id_curie", "object_id_curie")}


def build(mappings: DataFrame, by: tuple[str, ...] = ("mapping_date",), lg: int = 12) -> DataFrame:
    """by, nb_mapping and a sketch for each of KINDS; one aggregation. A null is a group of its own."""

    def sketch(columns: tuple[str, ...]) -> Column:
        parts = [F.hll_sketch_agg(F.when(F.col(c) != "", F.col(c)), lg) for c in columns]
        return parts[0] if len(parts) == 1 else F.hll_union(*parts)

    return mappings.groupBy(*by).agg(F.count(F.lit(1)).alias("nb_mapping"), *(sketch(c).alias(k) for k, c in KINDS.items()))


def merged(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The sketches of a selection made one for each value of by, such as months of days, or one row."""
    return sketches.groupBy(*by).agg(F.sum("nb_mapping").alias("nb_mapping"), *(F.hll_union_agg(k).alias(k) for k in KINDS))


def stats(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, nb_mapping (exact), nb_mapping_set, nb_mapping_provider, nb_entity (estimated) of the union of sketches."""
    names = {"sets": "nb_mapping_set", "providers": "nb_mapping_provider", "entities": "nb_entity"}
    return merged(sketches, by).select(*by, F.coalesce("nb_mapping", F.lit(0)).alias("nb_mapping"), *(F.coalesce(F.hll_sketch_estimate(k), F.lit(0)).alias(n) for k, n in names.items()))


def sets(mappings: DataFrame, by: tuple[str, ...] = ("mapping_date",)) -> DataFrame:
    """by, kind, value and n: the different values of KINDS in each group and how many mappings have them; of kind nb_mapping, all mappings."""
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    each = [one("nb_mapping", F.lit("")), *(one(k, F.col(c)) for k, columns in KINDS.items() for c in columns)]
    rows = mappings.select(*by, F.inline(F.filter(F.array(*each), lambda x: (x["kind"] == "nb_mapping") | (x["value"] != ""))))
    return rows.groupBy(*by, "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def exact_stats(values: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """As stats, all exact, of the union of sets."""
    names = {"sets": "nb_mapping_set", "providers": "nb_mapping_provider", "entities": "nb_entity"}
    merged_sets = values.groupBy(*by, "kind", "value").agg(F.sum("n").alias("n"))
    counts = [F.count_if(F.col("kind") == k).alias(n) for k, n in names.items()]
    return merged_sets.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("kind") == "nb_mapping", F.col("n"))), F.lit(0).cast("long")).alias("nb_mapping"), *counts)
