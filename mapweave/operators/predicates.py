"""Filters of the search requests, as columns that Catalyst can push down."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longer identifier lists are joined rather than listed in the predicate.
LIST_LIMIT = 1000
SIDES = ("subject_id_curie", "object_id_curie")


def entity_in(ids: list[str]) -> Column:
    """Either side is one of ids. Empty identifiers never match; no ids: no rows."""
    ids = [i for i in dict.fromkeys(ids) if i]
    return (F.col(SIDES[0]).isin(ids) | F.col(SIDES[1]).isin(ids)) if ids else F.lit(False)


def filter_entities(mappings: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """Rows with either side in ids: a list, or a one-column DataFrame of any size. A row comes once."""
    if isinstance(ids, list):
        if len(ids) <= LIST_LIMIT:
            return mappings.filter(entity_in(ids))
        ids = mappings.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    ids = ids.toDF("_id").filter("_id <> ''").distinct()
    by_subject = mappings.join(ids, F.col(SIDES[0]) == F.col("_id"), "left_semi")
    rest = mappings.join(ids, F.col(SIDES[0]) == F.col("_id"), "left_anti")
    return by_subject.union(rest.join(ids, F.col(SIDES[1]) == F.col("_id"), "left_semi"))


def confidence_between(low: float = 0.0, high: float = 1.0) -> Column:
    """Inclusive range; null passes only the full range 0..1 ("show all")."""
    if low > high:
        raise ValueError("low is above high")
    inside = F.col("confidence").between(low, high)
    return inside | F.col("confidence").isNull() if (low, high) == (0, 1) else inside


def facets_match(facets: dict[str, list[str] | None], schema: T.StructType) -> Column:
    """Any value within a facet, all facets together; array facets match with any element. None: no condition."""
    kind = lambda k: schema[k].dataType
    one = lambda k, vs: F.arrays_overlap(k, F.array(*map(F.lit, vs))) if isinstance(kind(k), T.ArrayType) else F.col(k).isin(vs)
    return reduce(and_, (one(k, vs) if vs else F.lit(False) for k, vs in facets.items() if vs is not None and k not in ("curies", "confidence")), F.lit(True))


def triple_match(subject: str | None = None, predicate: str | None = None, obj: str | None = None) -> Column:
    """Each given part equals the CURIE or the IRI; empty and missing parts are no condition."""
    parts = {"subject": subject, "predicate": predicate, "object": obj}
    return reduce(and_, ((F.col(f"{k}_id_curie") == v) | (F.col(f"{k}_id") == v) for k, v in parts.items() if v), F.lit(True))


def other_justification(current: str | None) -> Column:
    """Rows whose justification is another one; null differs from any value."""
    return ~F.col("mapping_justification").eqNullSafe(F.lit(current))
