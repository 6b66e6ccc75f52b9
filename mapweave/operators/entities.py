"""Entities: their view, labels, statistics and neighbourhoods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapweave.functions.text import packed, unpacked
from mapweave.operators import paging
from mapweave.operators.predicates import LIST_LIMIT, confidence_between, entity_in
from mapweave.sources.folders import staged

MAX_HOPS = 3


def entity_view(mappings: DataFrame, entity: str, limit: int | None = paging.TOP) -> DataFrame:
    """The first mappings of an entity by uuid (all with limit None), with the side that it is on; rows with it as subject come first."""
    sides = [F.coalesce(F.col(f"{k}_id_curie") == entity, F.lit(False)).alias(f"is_{k}") for k in ("subject", "object")]
    found = mappings.filter(entity_in([entity])).filter(confidence_between())
    found = found if limit is None else paging.page(found, limit, 1)
    return found.select("*", *sides).orderBy(F.desc("is_subject"), "uuid")


def entity_views(mappings: DataFrame, limit: int = paging.TOP) -> DataFrame:
    """entity_view of every entity at once: entity, place, is_subject, is_object and the mapping's columns.

    Rows are ranked within each entity, and the limit goes below the shuffle: a task sends at most limit rows of an
    entity, however many it has. A mapping with the entity on both sides comes once, with both flags. Through sort and
    shuffle uuid goes packed, in half its bytes.
    """
    one = lambda e, s, o: F.struct(F.col(e).alias("entity"), s.alias("is_subject"), o.alias("is_object"))
    same, yes, no = F.col("subject_id_curie").eqNullSafe(F.col("object_id_curie")), F.lit(True), F.lit(False)
    first, second = one("subject_id_curie", yes, same), one("object_id_curie", no, yes)
    sides = F.filter(F.when(same, F.array(first)).otherwise(F.array(first, second)), lambda x: x["entity"] != "")
    rows = mappings.filter(confidence_between()).withColumn("uuid", packed(F.col("uuid"))).select(F.inline(sides), *mappings.columns)
    of = Window.partitionBy("entity")
    kept = rows.withColumn("_rank", F.row_number().over(of.orderBy("uuid"))).filter(F.col("_rank") <= limit)
    placed = kept.withColumn("place", F.row_number().over(of.orderBy(F.desc("is_subject"), "uuid")))
    return placed.withColumn("uuid", unpacked(F.col("uuid"))).select("entity", "place", "is_subject", "is_object", *mappings.columns)


def entities(mappings: DataFrame) -> DataFrame:
    """Distinct identifiers of both sides with a label, category and source (the least, where rows differ)."""
    fields = ("id_curie", "label", "category", "source")
    side = lambda k: F.struct(*(F.col(f"{k}_{f}").alias(f) for f in fields))
    both = mappings.select(F.inline(F.array(side("subject"), side("object")))).filter("id_curie <> ''")
    return both.groupBy(F.col("id_curie").alias("entity")).agg(*(F.min(f).alias(f) for f in fields[1:]), F.count(F.lit(1)).alias("n_mappings"))


def distinct_entities(mappings: DataFrame) -> DataFrame:
    return mappings.select(F.explode(F.array("subject_id_curie", "object_id_curie")).alias("entity")).filter("entity <> ''").distinct()


def stats(mappings: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: nb_mapping, nb_mapping_set, nb_mapping_provider, nb_entity."""
    number = F.approx_count_distinct if approximate else F.countDistinct
    rows = mappings.agg(F.count(F.lit(1)).alias("nb_mapping"), number("mapping_set_id").alias("nb_mapping_set"), number("mapping_provider").alias("nb_mapping_provider"))
    ids = mappings.select(F.explode(F.array("subject_id_curie", "object_id_curie")).alias("entity")).filter("entity <> ''")
    return rows.crossJoin(ids.agg(number("entity").alias("nb_entity")))  # one row each


def edges(mappings: DataFrame) -> DataFrame:
    """Undirected neighbours, in both directions, as often as mappings name them."""
    pair = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = mappings.filter("subject_id_curie <> '' and object_id_curie <> ''")
    return both.select(F.inline(F.array(pair("subject_id_curie", "object_id_curie"), pair("object_id_curie", "subject_id_curie"))))


def inverted(mappings: DataFrame) -> DataFrame:
    """Each mapping the other way round: subject and object change places."""
    other = lambda c: c.replace("subject", "object") if "subject" in c else c.replace("object", "subject")
    return mappings.select(*(F.col(other(c)).alias(c) for c in mappings.columns))


#: A frontier of so many entities at most is sent along with each task of a join.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def as_links(mappings: DataFrame | None, links: DataFrame | None = None) -> DataFrame:
    """(src, dst): the edges of mappings, or of the table that write_edges or write_bucketed_edges has written."""
    if links is None:
        return edges(mappings)
    return links.select(F.col("entity").alias("src"), F.col("other").alias("dst")).filter("dst <> ''")


def beyond(frontier: DataFrame, mappings: DataFrame | None, links: DataFrame | None, few: int = LIST_LIMIT, most: int = BROADCAST_ROWS) -> DataFrame:
    """The entities one edge away from a stored frontier (entity), as often as edges lead there.

    Few identifiers go into the filter of the scan; more are broadcast, if their number and size are within bounds;
    beyond that both sides are joined by shuffle, or in place where the links are bucketed by entity.
    """
    n, size = frontier.agg(F.count(F.lit(1)), F.sum(F.octet_length("entity"))).first()
    if n <= few:
        ids = [r[0] for r in frontier.collect()]
        every = as_links(None if mappings is None else mappings.filter(entity_in(ids)), links)
        return every.filter(F.col("src").isin(ids)).select(F.col("dst").alias("entity"))
    near = frontier.select(F.col("entity").alias("src"))
    near = F.broadcast(near) if n <= most and size <= BROADCAST_BYTES else near.hint("merge")
    return as_links(mappings, links).join(near, "src").select(F.col("dst").alias("entity"))


def neighbourhood(
    mappings: DataFrame | None, start: str, hops: int = 1, links: DataFrame | None = None, few: int = LIST_LIMIT, most: int = BROADCAST_ROWS,
) -> DataFrame:
    """(entity, distance) of what is within hops of start; each entity once, at its least distance.

    Hop by hop, only from the frontier: the entities that the last hop has found, without those found before. Each
    frontier is written to the shared folder, so no hop is computed twice. links is the table of write_edges or
    write_bucketed_edges; without it mappings are turned into edges.
    """
    if not 1 <= hops <= MAX_HOPS:
        raise ValueError(f"hops go from 1 to {MAX_HOPS}")
    here = mappings.filter(entity_in([start])) if links is None else links.filter(F.col("entity") == start)
    levels = [staged(here.limit(1).select(F.lit(start).alias("entity")))]
    for _ in range(hops):
        found = beyond(levels[-1], mappings, links, few, most).distinct()
        for level in levels:  # the frontiers are all that has been seen
            found = found.join(level, "entity", "left_anti")
        levels.append(staged(found))
    return reduce(DataFrame.union, (level.select("entity", F.lit(d).alias("distance")) for d, level in enumerate(levels)))
