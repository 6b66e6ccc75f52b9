"""Page documents as untyped objects: what has the wrong type or can't be read is kept beside the mappings, not lost.

A document is {data: [mapping, ...], pagination, facets}. It is parsed to a VARIANT, its records are taken out of data,
and each field is read with its own type. Nothing of a document fails the job: a record's fields of another type are
null in the mapping and keep their JSON text in _wrong; records that are no objects, documents without a list of data
and text that is no JSON are rows with nulls only and the text in _rejected. Numbers may be written as whole or decimal
numbers; lists may hold nulls. Fields that a mapping doesn't have are left out. Empty documents and empty lists give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapweave.schema import MAPPING

#: Rows of a file of written documents, at most: a gzipped file can't be split and is read by one task.
FILE_ROWS = 50_000


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(value): the texts of the documents in path: a file each, or a line each."""
    if lines:
        return spark.read.text(path)
    return spark.read.format("binaryFile").load(path).select(F.col("content").cast("string").alias("value"))


def decode(texts: DataFrame, schema: T.StructType = MAPPING) -> DataFrame:
    """The mappings in documents (value), with _wrong (map of field to JSON text, empty if all is well) and _rejected (null if it is one)."""
    text, names = F.col("value"), ["`" + f.name.replace("`", "``") + "`" for f in schema]
    parsed = texts.filter(F.trim(text) != "").select(text, F.try_variant_get(F.try_parse_json(text), "$.data", "array<variant>").alias("data"))
    found = parsed.select(F.when(F.col("data").isNull(), text).alias("lost"), F.explode_outer("data").alias("record"), (F.size("data") == 0).alias("none"))
    # all fields of a record are taken out at once; what is no object has none
    found = found.filter(~F.coalesce("none", F.lit(False))).select("lost", "record", F.try_variant_get("record", "$", f"struct<{','.join(f'{n}:variant' for n in names)}>").alias("fields"))
    fits = [f"fits{i}" for i in range(len(schema))]
    raw = found.select("*", *(_fits(F.col(f"fields.{n}"), f.dataType).alias(fit) for n, f, fit in zip(names, schema, fits, strict=True)))
    # concat, as a filter of an array isn't compiled
    wrong = [F.when(F.col(fit), F.array().cast(_WRONG)).otherwise(F.array(F.struct(F.lit(f.name).alias("key"), F.to_json(f"fields.{n}").alias("value")))) for n, f, fit in zip(names, schema, fits, strict=True)]
    rejected = F.coalesce("lost", F.when(F.col("fields").isNull(), F.coalesce(F.to_json("record"), F.lit("null"))))
    typed = [F.when(F.col(fit), F.try_variant_get(f"fields.{n}", "$", f.dataType.simpleString())).alias(f.name) for n, f, fit in zip(names, schema, fits, strict=True)]
    return raw.select(*typed, F.map_from_entries(F.concat(*wrong)).alias("_wrong"), rejected.alias("_rejected"))


_WRONG = "array<struct<key:string,value:string>>"


def _fits(value: Column, kind: T.DataType) -> Column:
    """Whether a field has its type or is absent or null. Lists may hold nulls."""
    said = F.schema_of_variant(value)
    if isinstance(kind, T.StringType):
        fit = said.isin("VOID", "STRING")
    elif isinstance(kind, T.ArrayType):
        fit = said.isin("VOID", "ARRAY<STRING>", "ARRAY<VOID>")
    else:
        fit = said.isin("VOID", "BIGINT", "DOUBLE", "FLOAT") | F.startswith(said, F.lit("DECIMAL("))
    return F.coalesce(fit, F.lit(True))


def write_documents(mappings: DataFrame, path: str, size: int = 100, each: bool = False) -> None:
    """Page documents of at most size mappings each, a line each (or with each, a file each), gzipped; absent fields are left out.

    A document takes rows that follow each other in a partition, so nothing is shuffled.
    """
    documents(mappings, size).write.option("compression", "gzip").option("maxRecordsPerFile", 1 if each else max(1, FILE_ROWS // size)).text(path)


def documents(mappings: DataFrame, size: int) -> DataFrame:
    """(value): documents of size mappings, the last one of a partition with what is left."""

    def made(rows: pa.Array, n: int) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array([*range(0, len(rows), n), len(rows)], pa.int32()), rows)
        return pa.RecordBatch.from_arrays([pc.binary_join_element_wise('{"data":[', pc.binary_join(lists, ","), "]}", "")], ["value"])

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.array([], pa.string())
        for batch in batches:
            held = pa.concat_arrays([held, batch.column(0).cast(pa.string())])
            if full := len(held) // size * size:
                yield made(held[:full], size)
                held = held[full:]
        if len(held):
            yield made(held, size)

    return mappings.select(F.to_json(F.struct(*mappings.columns)).alias("value")).mapInArrow(pages, "value string")
