"""Readers and writers of mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapweave.functions import text as tx
from mapweave.schema import MAPPING, MAPPING_SET
from mapweave.sources.folders import drop, new_folder


#: Rows of a file of an export, rows of an unsorted file and bytes of what one task sorts, at most.
FILE_ROWS, SORTED_ROWS, PART_BYTES = 200_000, 500_000, str(16 << 20)


def conform(df: DataFrame, schema: T.StructType = MAPPING) -> DataFrame:
    """df's columns in the schema's order and types; missing ones are null, others are left out."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def read_mappings(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Mappings from Parquet, or from JSON objects (one a line, or lists of them with kind="json-array")."""
    if kind == "parquet":
        return conform(spark.read.parquet(path))
    return spark.read.schema(MAPPING).option("multiLine", kind == "json-array").json(path)


def read_mapping_sets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MAPPING_SET).json(path)


def decode_page(spark: SparkSession, path: str) -> DataFrame:
    """The mappings in page documents {data: [...], pagination, facets}, one row each."""
    pages = spark.read.schema(T.StructType([T.StructField("data", T.ArrayType(MAPPING))])).option("multiLine", True).json(path)
    return pages.select(F.inline("data"))


def write_mappings(mappings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, sorted by subject within files so that lookups skip row groups.

    The rows are written as they come first and sorted from there in small parts: a partition of whole rows, which Spark
    sizes by the narrower rows that they are made of, would spill while it is sorted.
    """
    spark, most = mappings.sparkSession, "spark.sql.files.maxPartitionBytes"
    first, was = new_folder(spark, "unsorted"), spark.conf.get(most)
    conform(mappings).write.option("maxRecordsPerFile", SORTED_ROWS).parquet(first)
    try:
        spark.conf.set(most, PART_BYTES)
        spark.read.schema(MAPPING).parquet(first).sortWithinPartitions("subject_id_curie", "uuid").write.mode(mode).parquet(path)
    finally:
        spark.conf.set(most, was)
    drop(spark, first)


def write_edges(mappings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Both directions of each mapping (entity, other, side, uuid), range-partitioned by entity: a lookup reads few files."""
    edges = mappings.select("uuid", F.inline(F.array(*(F.struct(F.col(a).alias("entity"), F.col(b).alias("other"), F.lit(s).alias("side")) for a, b, s in (("subject_id_curie", "object_id_curie", "subject"), ("object_id_curie", "subject_id_curie", "object"))))))
    edges.filter("entity <> ''").repartitionByRange("entity").sortWithinPartitions("entity", "uuid").write.mode(mode).parquet(path)


def flat(mappings: DataFrame) -> DataFrame:
    """Arrays joined with ', ', for formats without arrays."""
    return mappings.select(*(tx.join(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in mappings.schema))


def export(mappings: DataFrame, path: str, kind: str = "csv", mode: str = "errorifexists", compression: str = "none") -> None:
    """CSV or TSV with a header. Fields with separators, quotes or line ends are quoted, quotes in them are doubled; spaces stay.

    Files have at most FILE_ROWS rows, as a file with line ends in its fields can't be split and is read by one task.
    With compression "gzip" they take an eighth of the space, as most of the 45 columns are empty or repeat themselves.
    """
    out = flat(mappings).write.mode(mode).option("compression", compression).option("maxRecordsPerFile", FILE_ROWS).option("header", True).option("sep", {"csv": ",", "tsv": "\t"}[kind]).option("escape", '"')
    out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_export(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """What export has written, all columns as text; absent and empty texts are both null."""
    return spark.read.option("header", True).option("sep", {"csv": ",", "tsv": "\t"}[kind]).option("escape", '"').option("multiLine", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def sets_from_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping sets of from_line_items' mappings, with the address of each one's mappings."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    named = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.concat(F.lit("set-"), (F.col("s_suppkey") % 5).cast("string")).alias("uuid")
    sets = named.groupBy(key).agg(F.min("n_name").alias("mapping_provider"), F.sort_array(F.collect_set("n_name")).alias("mapping_set_source"))
    return conform(sets.withColumn("mappings", F.struct(F.concat(F.lit("/sets/"), "uuid", F.lit("/mappings")).alias("href"))), MAPPING_SET)


def stored(mappings: DataFrame, path: str | None = None) -> DataFrame:
    """Mappings written once to path (a new folder if none is given) and read from there, so that filters reach the files.

    A folder that has files already is left alone and raises an error, so results that read it stay right."""
    path = path or new_folder(mappings.sparkSession, "mappings")
    write_mappings(mappings, path)
    return read_mappings(mappings.sparkSession, path)


def of_sets(sets: DataFrame, mappings: DataFrame) -> DataFrame:
    """Each mapping with the set whose address names its mapping_set_id: set's uuid and provider, then the mapping's columns."""
    named = sets.select(F.col("uuid").alias("set_uuid"), F.col("mapping_provider").alias("set_provider"), F.split_part("mappings.href", F.lit("/"), F.lit(3)).alias("set_id"))
    return named.join(mappings, F.col("set_id") == F.col("mapping_set_id")).drop("set_id")


def from_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mapping for each line item of an order schema: part -> relation -> supplier."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    part, supplier, nation = t("part"), t("supplier"), t("nation")
    rows = t("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    s = lambda c: F.col(c).cast("string")
    relation = F.when(F.col("l_returnflag") == "R", "exactMatch").when(F.col("l_returnflag") == "A", "closeMatch").otherwise("broadMatch")
    reason = F.when(F.col("l_linestatus") == "O", "LexicalMatching").otherwise("ManualMappingCuration")
    day, words = F.col("l_shipdate").cast("date").cast("string"), F.split("p_name", " ")
    made = rows.select(
        F.md5(F.concat_ws("|", s("l_orderkey"), s("l_linenumber"), s("l_partkey"), s("l_suppkey"), day, F.col("l_quantity").cast("bigint").cast("string"))).alias("uuid"),
        F.concat(F.lit("http://example.org/part#"), s("l_partkey")).alias("subject_id"),
        F.when(F.col("l_partkey") % 11 == 0, "").otherwise(F.concat(F.lit("PART:"), s("l_partkey"))).alias("subject_id_curie"),
        F.when(F.col("l_partkey") % 7 != 0, F.col("p_name")).alias("subject_label"),
        F.col("p_type").alias("subject_category"),
        F.col("p_brand").alias("subject_source"),
        F.concat(F.lit("http://example.org/rel#"), relation).alias("predicate_id"),
        F.concat(F.lit("rel:"), relation).alias("predicate_id_curie"),
        F.concat(F.lit("http://example.org/supp#"), s("l_suppkey")).alias("object_id"),
        F.concat(F.lit("SUPP:"), s("l_suppkey")).alias("object_id_curie"),
        F.col("s_name").alias("object_label"),
        F.col("n_name").alias("object_category"),
        F.concat(F.lit("http://example.org/just/"), reason).alias("mapping_justification"),
        F.concat(F.lit("just:"), reason).alias("mapping_justification_curie"),
        F.when(F.col("l_linenumber") == 4, None).when(F.col("l_linenumber") == 5, 0.0).otherwise(F.col("l_quantity") / 50.0).alias("confidence"),
        F.col("n_name").alias("mapping_provider"),
        F.concat(F.lit("set-"), (F.col("l_suppkey") % 5).cast("string")).alias("mapping_set_id"),
        day.alias("mapping_date"),
        words.alias("subject_match_field"),
        F.when(F.col("l_linenumber") != 2, words).alias("match_string"),
    )
    return conform(made)
