"""Search requests and their plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.operators import facets as fc
from mapweave.operators import paging
from mapweave.operators.predicates import confidence_between, facets_match, filter_entities, triple_match
from mapweave.schema import FACETS


@dataclass(frozen=True)
class Page:
    """Lazy results of one request: the rows of the page, the totals (one row) and the facet counts."""

    data: DataFrame
    pagination: DataFrame
    facets: DataFrame | None = None


@dataclass(frozen=True)
class EntitySearch:
    curies: list[str]
    facets: dict[str, list[str] | None] = field(default_factory=dict)
    confidence: tuple[float, float] = (0.0, 1.0)
    limit: int = 25
    page: int = 1

    def rows(self, mappings: DataFrame) -> DataFrame:
        """All matches, before paging."""
        return filter_entities(mappings, self.curies).filter(confidence_between(*self.confidence)).filter(facets_match(self.facets, mappings.schema))

    def run(self, mappings: DataFrame, facet_keys: tuple[str, ...] = FACETS, exclude_self: bool = False) -> Page:
        rows = self.rows(mappings)
        base = filter_entities(mappings, self.curies).filter(confidence_between(*self.confidence))
        counts = fc.counts_without_own(base, self.facets, facet_keys) if exclude_self else fc.facet_counts(rows, facet_keys)
        return Page(paging.page(rows, self.limit, self.page), paging.summary(rows, self.limit, self.page), counts)


@dataclass(frozen=True)
class TripleSearch:
    subject: str | None = None
    predicate: str | None = None
    object: str | None = None
    limit: int = 100
    page: int = 1

    def rows(self, mappings: DataFrame) -> DataFrame:
        return mappings.filter(triple_match(self.subject, self.predicate, self.object))

    def run(self, mappings: DataFrame) -> Page:
        rows = self.rows(mappings)
        return Page(paging.page(rows, self.limit, self.page), paging.summary(rows, self.limit, self.page))


def mapping_by_id(mappings: DataFrame, uuid: str) -> DataFrame:
    return mappings.filter(F.col("uuid") == uuid).limit(1)


def require(rows: DataFrame) -> DataFrame:
    """rows, which must not be empty (a lookup of an unknown mapping is an error)."""
    if rows.isEmpty():
        raise LookupError("no such mapping")
    return rows
