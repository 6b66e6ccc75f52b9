"""Distances from many entities at once, and edges laid out so that hops don't move them.

Breadth-first search from many starts: each start is one bit of a 64-bit word, so a hop carries the starts of a word
together. A node's words are combined with bit_or, and what it had before is masked out; each hop reads the edges once,
whatever the number of starts. Repeated edges combine before the shuffle.

Starts that no mapping has as an entity reach nothing, not even themselves; empty and null starts are passed over, and
repeated ones count once. An entity is at distance 0 from itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.operators.entities import BROADCAST_BYTES, BROADCAST_ROWS, MAX_HOPS, as_links
from mapweave.operators.predicates import LIST_LIMIT, entity_in
from mapweave.sources.folders import new_folder, staged

#: Starts go to the driver's plan as literals, so their number is bounded.
MOST_STARTS = 100_000
#: Edges of a bucket where no number of buckets is given.
BUCKET_ROWS = 2_000_000


def neighbours_many(mappings: DataFrame | None, starts: Iterable[str], hops: int = 1, links: DataFrame | None = None) -> DataFrame:
    """(start, entity, distance): the least distance of each entity within hops of each start."""
    if not 1 <= hops <= MAX_HOPS:
        raise ValueError(f"hops go from 1 to {MAX_HOPS}")
    starts = [s for s in dict.fromkeys(starts) if s]
    if len(starts) > MOST_STARTS:
        raise ValueError(f"at most {MOST_STARTS} starts at once")
    spark = (mappings if links is None else links).sparkSession
    number = spark.createDataFrame([(s, i >> 6, i & 63) for i, s in enumerate(starts)], "start string, word int, bit int")
    bits = number.select(F.col("start").alias("entity"), "word", F.expr("shiftleft(1L, bit)").alias("bits"))
    levels = [staged(_present(bits, mappings, links, starts))]
    for _ in range(hops):
        last = levels[-1]
        n, size = last.agg(F.count(F.lit(1)), F.sum(F.octet_length("entity"))).first()
        few = last.select(F.col("entity").alias("src"), "word", "bits")
        few = F.broadcast(few) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else few.hint("merge")
        reached = as_links(mappings, links).join(few, "src").groupBy(F.col("dst").alias("entity"), "word").agg(F.bit_or("bits").alias("bits"))
        seen = reduce(DataFrame.union, levels).groupBy("entity", "word").agg(F.bit_or("bits").alias("seen"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long"))))
        levels.append(staged(reached.join(seen, ["entity", "word"], "left").select("entity", "word", fresh.alias("bits")).filter("bits <> 0")))
    every = reduce(DataFrame.union, (x.withColumn("distance", F.lit(d)) for d, x in enumerate(levels)))
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
    return every.select("entity", "word", F.explode(set_bits).alias("bit"), "distance").join(number, ["word", "bit"]).select("start", "entity", "distance")


def _present(bits: DataFrame, mappings: DataFrame | None, links: DataFrame | None, starts: list[str]) -> DataFrame:
    """The starts that are entities, in one pass; few of them go into the scan's filter."""
    small = len(starts) <= LIST_LIMIT
    if links is None:
        rows = mappings.filter(entity_in(starts)) if small else mappings
        ids = rows.select(F.explode(F.array("subject_id_curie", "object_id_curie")).alias("entity"))
    else:
        ids = (links.filter(F.col("entity").isin(starts)) if small and starts else links).select("entity")
    return ids.join(F.broadcast(bits), "entity").distinct()


def write_bucketed_edges(mappings: DataFrame, buckets: int | None = None, name: str | None = None) -> str:
    """The table of write_edges, bucketed and sorted by entity; its name. Its files are in a new shared folder.

    Joins and aggregations by entity take the buckets as they lie: only the other side moves. Files are one a bucket,
    so take as many buckets as tasks are to read the table; without a number, one for every BUCKET_ROWS edges, 16 at least.
    """
    buckets = buckets or max(16, -(-2 * mappings.count() // BUCKET_ROWS))
    name = name or f"edges_{uuid.uuid4().hex}"
    side = lambda a, b, s: F.struct(F.col(f"{a}_id_curie").alias("entity"), F.col(f"{b}_id_curie").alias("other"), F.lit(s).alias("side"))
    edges = mappings.select("uuid", F.inline(F.array(side("subject", "object", "subject"), side("object", "subject", "object")))).filter("entity <> ''")
    edges = edges.repartition(buckets, "entity")
    edges.write.bucketBy(buckets, "entity").sortBy("entity").option("path", new_folder(mappings.sparkSession, "edges")).saveAsTable(name)
    return name
