"""Justifications of one assertion: the same subject, predicate and object.

A part of an assertion is known by its CURIE, or by its IRI where the CURIE is empty or null, so that subjects without a
CURIE are told apart. Rows that have neither for some part have a null there: they are no one's other justification.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions import text as tx
from mapweave.operators import paging
from mapweave.operators.predicates import other_justification, triple_match

#: Parts of an assertion, and the names of their identifiers by CURIE or IRI.
PARTS = ("subject", "predicate", "object")


def triple() -> list[Column]:
    """The three parts, each by CURIE or IRI."""
    return [tx.curie_or_iri(F.col(f"{k}_id_curie"), F.col(f"{k}_id")).alias(k) for k in PARTS]


def _matches() -> list[Column]:
    fields = {"subject_match_field": "subject_matches", "object_match_field": "object_matches", "match_string": "match_strings"}
    return [tx.join(F.col(c)).alias(name) for c, name in fields.items()]


def view(rows: DataFrame) -> DataFrame:
    """uri, confidence, provider and the match fields as text."""
    return rows.select(
        "uuid",
        F.col("mapping_justification").alias("uri"),
        "confidence",
        F.col("mapping_provider").alias("provider"),
        *_matches(),
    )


def drawer(rows: DataFrame) -> DataFrame:
    """Parameters of a row's drawer: identifiers by CURIE or IRI, the rest as text, falsy values empty."""
    ids = [part.alias(f"{k}_id") for k, part in zip(PARTS, triple(), strict=True)]
    conf = F.col("confidence")
    return rows.select(
        "uuid",
        *ids,
        tx.or_empty(F.col("mapping_justification")).alias("uri"),
        F.when(tx.present(conf, rows.schema["confidence"].dataType), tx.number_text(conf)).otherwise("").alias("confidence"),
        tx.or_empty(F.col("mapping_provider")).alias("provider"),
        *_matches(),
    )


#: Fields of a drawer's request and the columns of drawer() that they hold.
REQUEST = {
    "subject_id": "subject_id", "predicate_id": "predicate_id", "object_id": "object_id", "justif_uri": "uri", "justif_confidence": "confidence",
    "justif_provider": "provider", "justif_subject_matches": "subject_matches", "justif_object_matches": "object_matches", "justif_match_strings": "match_strings",
}


def requests(rows: DataFrame) -> DataFrame:
    """(uuid, query): the text of the request that a row's drawer makes."""
    d = drawer(rows)
    return d.select("uuid", tx.to_query({k: d[c] for k, c in REQUEST.items()}).alias("query"))


def read_requests(texts: DataFrame) -> DataFrame:
    """The fields of each request's text, under drawer()'s names; confidence as a number, 0 for none."""
    field = lambda k: tx.or_empty(F.col(k))
    return tx.from_queries(texts, F.col("query"), list(REQUEST), ["uuid"]).select("uuid", *((tx.to_number(field(k)) if c == "confidence" else field(k)).alias(c) for k, c in REQUEST.items()))


def drawer_page(mappings: DataFrame, request: Mapping[str, str | None], limit: int = 25, number: int = 1) -> DataFrame:
    """The drawer of a request (fields as in REQUEST): a page of the triple's justifications by uuid, and of that page those under another uri.

    Parts that the request leaves out or has empty are no condition, as in a triple search. A row without a justification
    differs from any uri, also from an empty one. The page is cut before its own rows are left out, so it may be shorter.
    """
    found = mappings.filter(triple_match(*(request.get(f"{k}_id") for k in PARTS)))
    return view(paging.page(found, limit, number)).filter(~F.col("uri").eqNullSafe(F.lit(request.get("justif_uri") or "")))


def others_of(mappings: DataFrame, uuid: str, limit: int = paging.TOP) -> DataFrame:
    """Other justifications of the mapping with this uuid, among the first of its triple by uuid; no rows if there is no such mapping.

    The triple is asked for by its CURIEs; a part whose CURIE is empty or null is no condition. The mapping is looked up
    first (one row), so both filters reach the scan of stored mappings.
    """
    one = mappings.filter(F.col("uuid") == uuid).select(*(f"{k}_id_curie" for k in PARTS), "mapping_justification").first()
    if one is None:
        return mappings.limit(0)
    first = paging.page(mappings.filter(triple_match(*one[:3])), limit, 1)
    return first.filter(other_justification(one[3]))


def of_triple(mappings: DataFrame, subject: str, predicate: str, obj: str, current: str | None) -> DataFrame:
    return view(mappings.filter(triple_match(subject, predicate, obj)).filter(other_justification(current)))


def of_drawer(mappings: DataFrame, subject: str, predicate: str, obj: str, limit: int = 25, number: int = 1) -> DataFrame:
    """A page of the justifications of a triple that its drawer shows, its own too."""
    return view(paging.page(mappings.filter(triple_match(subject, predicate, obj)), limit, number))


def by_triple(mappings: DataFrame) -> DataFrame:
    """All triples with their justifications, counted in one aggregation instead of a self-join."""
    every = mappings.groupBy(*triple()).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("mapping_justification")).alias("justifications"))
    return every.select(*PARTS, "n", F.size("justifications").cast("long").alias("n_justifications"), "justifications")


def pairs(selected: DataFrame, mappings: DataFrame) -> DataFrame:
    """(uuid, other_uuid): each of the selected mappings with those of its triple under another justification.

    All pairs of a triple; links() gives their numbers only. Of a table with itself, both sides are the same five columns,
    so they are shuffled once and read twice, and a hot triple is split in the join.
    """
    keys = selected.select("uuid", "mapping_justification", *triple())
    o = mappings.select(F.col("uuid").alias("other_uuid"), F.col("mapping_justification").alias("_j"), *triple())
    return keys.join(o, list(PARTS)).filter(~F.col("mapping_justification").eqNullSafe(F.col("_j"))).select("uuid", "other_uuid")


def links(mappings: DataFrame) -> DataFrame:
    """Each mapping's class (the least uuid of its triple) and how many mappings of the class have another justification.

    Two aggregations, the second over the first, and a join whose other side has one row for each triple and justification:
    no pairs are made, and rows of a hot triple can be split in the join.
    """
    rows = mappings.select("uuid", F.col("mapping_justification").alias("why"), *triple())
    own = rows.groupBy(*PARTS, "why").agg(F.count(F.lit(1)).alias("n"), F.min("uuid").alias("least"))
    whole = own.groupBy(*PARTS).agg(F.sum("n").alias("total"), F.min("least").alias("class_id"))
    counted = own.join(whole, list(PARTS)).select(*(F.col(k).alias(f"_{k}") for k in PARTS), F.col("why").alias("_why"), "class_id", (F.col("total") - F.col("n")).alias("n_others"))
    same = [F.col(k) == F.col(f"_{k}") for k in PARTS] + [F.col("why").eqNullSafe(F.col("_why"))]
    joined = rows.join(counted, same, "left")
    return joined.select("uuid", F.coalesce("class_id", "uuid").alias("class_id"), F.coalesce("n_others", F.lit(0)).alias("n_others"))


def section_flags(mappings: DataFrame) -> DataFrame:
    """(triple, shown): the section of other justifications has a header where a triple has several rows."""
    return mappings.groupBy(*triple()).agg((F.count(F.lit(1)) > 1).alias("shown"))
