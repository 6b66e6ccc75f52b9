"""Facet counts and the selection of facet values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapweave.operators.predicates import facets_match
from mapweave.schema import FACETS


def facet_counts(rows: DataFrame, facets: tuple[str, ...] = FACETS, when: dict[str, Column] | None = None) -> DataFrame:
    """(facet, value, count): one pass over rows and one aggregation. A row counts once for a value; nulls don't count.

    when: for a facet, the condition on which a row counts for it.
    """
    keys = [k for k in facets if k.lower() != "confidence"]
    pairs = F.concat(*(_pairs(k, rows.schema[k].dataType, (when or {}).get(k)) for k in keys))
    return rows.select(F.inline(pairs)).filter("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"))


def _pairs(key: str, kind: T.DataType, on: Column | None) -> Column:
    values = F.array_distinct(key) if isinstance(kind, T.ArrayType) else F.array(F.col(key).cast("string"))
    values = values if on is None else F.when(on, values)
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(key).alias("facet"), v.alias("value")))


def counts_without_own(rows: DataFrame, selected: dict, facets: tuple[str, ...] = FACETS) -> DataFrame:
    """As facet_counts, each facet counted under the other facets' selections only; still one pass."""
    return facet_counts(rows, facets, {f: facets_match({k: v for k, v in selected.items() if k != f}, rows.schema) for f in facets})


def as_map(counts: DataFrame) -> DataFrame:
    """One row: map of facet to map of value to count."""
    inner = counts.groupBy("facet").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "count")))).alias("values"))
    return inner.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("facet", F.to_json("values").alias("values"))))).alias("facets"))


def ordered(counts: DataFrame) -> DataFrame:
    """Facets without regard to case, then values by count."""
    return counts.orderBy(F.upper("facet"), "facet", F.desc("count"), "value")


def checked(selected: Column, value: Column) -> Column:
    """Whether a facet's value is shown as selected; selected: array of the facet's values or null. Empty values never are."""
    return F.coalesce(F.array_contains(selected, value) & (value != ""), F.lit(False))


def toggled(selected: Column, value: Column) -> Column:
    """toggle() of one facet, for columns: the array after a click on value, null where none is left."""
    left = F.array_remove(selected, value)
    return F.when(selected.isNull(), F.array(value)).when(~checked(selected, value), selected).when(F.size(left) > 0, left)


def toggle(selected: dict[str, list[str]], key: str, value: str) -> dict[str, list[str]]:
    """The selection after a click on value: set where nothing is, removed where it is, else unchanged."""
    now = selected.get(key)
    if not isinstance(now, list):
        return {**selected, key: [value]}
    if value not in now:
        return dict(selected)
    left = [v for v in now if v != value]
    return {**{k: v for k, v in selected.items() if k != key}, **({key: left} if left else {})}
