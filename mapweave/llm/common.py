"""Shared storage and small helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders that shared_dir has named, by application.
_MADE: dict[str, list[str]] = {}
#: The white space that separates words: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share.

    Only where the session has no such setting and runs in one process (tests) a temporary folder is made and set.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (spark.master is {master!r})")
        top = "file://" + tempfile.mkdtemp(prefix="mapweave-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_staged(spark: SparkSession) -> int:
    """Delete the intermediate tables that this application has written so far; how many there were.

    For callers that have written or read their results: DataFrames of the operators are lazy and read these tables.
    """
    paths, jvm = _MADE.pop(spark.sparkContext.applicationId, []), spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def stage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Blocks of bitmaps (4,096 bytes each) that are sent along with each task at most.
MOST_BLOCKS = 16_000


def with_numbers(rows: DataFrame, number: str, some: DataFrame) -> DataFrame:
    """The rows whose number (monotonically_increasing_id, stored) is in the one column of some; they stay where they are.

    A bit for each row is sent along, not the numbers, so whole rows aren't shuffled to be told apart. Over MOST_BLOCKS
    blocks of 32,768 rows they are joined by shuffle.
    """
    some = some.toDF("row")
    marks = stage(some.groupBy(F.bitmap_bucket_number("row").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bits")))
    own = rows.select(F.struct("*").alias("d"), named(number).alias("row"))
    if marks.count() > MOST_BLOCKS:
        return own.join(some.hint("merge"), "row", "left_semi").select("d.*")
    own = own.select("d", F.bitmap_bucket_number("row").alias("block"), F.bitmap_bit_position("row").alias("bit"))
    byte = F.conv(F.hex(F.substr("bits", (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return own.join(F.broadcast(marks), "block").filter(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1).select("d.*")


def named(column: str) -> Column:
    """The column of this name, which may have dots and backticks in it."""
    return F.col(f"`{column.replace('`', '``')}`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like name that df hasn't, in any spelling of upper and lower case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """Lower-case A-Z only. lower() is right, and much faster, where no other character has a lower-case form."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = (F.octet_length(col) == F.length(col)) | ~F.rlike(col, F.lit(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"))
    return F.when(plain, F.lower(col)).otherwise(F.translate(col, upper, lower))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that few whole texts are Python objects at once.

    What Arrow holds from earlier work of the same worker is given back first.
    """
    pa.default_memory_pool().release_unused()
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def texts_of(batch: pa.RecordBatch, column: str | int = "text") -> list[str]:
    """The column's texts; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], fields: list[T.StructField]) -> DataFrame:
    """df.mapInArrow(run) with columns told by their place, so that names with dots and quotes and repeated names pass."""
    plain = lambda kinds: T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kinds)])
    inside = plain(fields)

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out.rename_columns(inside.names)

    return df.toDF(*plain(df.schema).names).mapInArrow(renamed, inside).toDF(*(f.name for f in fields))


def with_made(df: DataFrame, column: str, make: Callable[[pa.RecordBatch, int], list[pa.Array]], fields: list[T.StructField], rows: int = 1000) -> DataFrame:
    """df's columns and those that make gives for a slice of so many rows, in which column has the place that it gets told."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows):
            out = [*batch.columns, *make(batch, at)]
            yield pa.RecordBatch.from_arrays(out, [str(i) for i in range(len(out))])

    return in_batches(df, run, [*df.schema.fields, *fields])
