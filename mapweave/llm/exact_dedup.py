"""Exact deduplication by stateful streaming.

A batch step lists, for each row, the SHA-256 digest of its normalised text, its doc_id and its content locator
(file path and row index). A Structured Streaming query over that list keeps one state entry for each digest, in
RocksDB on disk and without expiry: the largest (doc_id, locator) seen so far and the number of rows. Later
batches of files can go on from the same state. Rows of a digest with several rows are hits; their whole texts
are then compared with the text that the kept locator points to. Rows that differ from it in spite of an equal
digest are grouped anew by digest and whole text.

Only DataFrame operations run on the executors. The rows of large groups are dealt out by a salt, with the kept
text once for each salt value.

Null texts count as empty. Texts are equal when identical after lower-casing A-Z only. Of equal texts, the row
with the largest doc_id stays (null is smallest; rows that also share the doc_id: the largest locator stays).
An empty table gives an empty result; extra columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, shared_dir, stage, table

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition's store reserves megabytes
}


#: Steps of a plan that give each row of a file once at most.
_SINGLE = {"LogicalRelation", "Relation", "SubqueryAlias", "View", "Filter", "Project"}


def once_each(docs: DataFrame) -> bool:
    """Whether docs is a scan of different files with filters and projections only, so that no row of a file comes twice."""
    plan = docs._jdf.queryExecution().analyzed()
    while True:
        if plan.getClass().getSimpleName() not in _SINGLE:
            return False
        if not plan.children().size():
            paths = [p for p in docs._jdf.inputFiles()]
            return len(set(paths)) == len(paths) and not _listed_twice(plan)
        plan = plan.children().apply(0)


def _listed_twice(relation) -> bool:
    try:
        roots = relation.relation().location().rootPaths()
    except Exception:  # no table of files
        return True
    paths = [f"{roots.apply(i).toString().rstrip('/')}/" for i in range(roots.size())]
    return any(a.startswith(b) for i, a in enumerate(paths) for j, b in enumerate(paths) if i != j)


def located(docs: DataFrame) -> DataFrame:
    """The struct d of docs' columns and the struct at: path and row of its file.

    Rows that come from no file, or that a step before may have repeated (explode, sampling with replacement, joins),
    are written to files first.
    """

    def at(df: DataFrame) -> DataFrame:
        own = df.metadataColumn("_metadata")  # also where a column has that name
        return df.select(F.struct("*").alias("d"), F.struct(own["file_path"].alias("path"), own["row_index"].alias("row")).alias("at"))

    if once_each(docs):
        try:
            out = at(docs)
            _ = out.schema
            return out
        except AnalysisException:  # no hidden file columns
            pass
    return at(stage(docs))


def keep_state(log: DataFrame, state_dir: str) -> DataFrame:
    """Stream the rows (digest, id, at) of log through the keyed state: (digest, best, size) of all rows so far.

    state_dir holds the stream's checkpoint and its input; a later call with the same one goes on from its state.
    """
    spark, source, changes = log.sparkSession, f"{state_dir}/log", f"{state_dir}/changes"
    log.write.mode("append").parquet(source)
    of_digest = F.max(F.struct("id", "at")).alias("best"), F.count(F.lit(1)).alias("size")
    log.limit(0).groupBy("digest").agg(*of_digest).write.mode("overwrite").parquet(f"{changes}/batch=-1")  # there is a table even if no row comes
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        (
            spark.readStream.schema(log.schema).parquet(source)
            .groupBy("digest").agg(*of_digest)
            .writeStream.outputMode("update").option("checkpointLocation", f"{state_dir}/checkpoint")
            .foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{changes}/batch={n}"))
            .trigger(availableNow=True).start().awaitTermination()
        )
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    # each batch leaves the entries that it changed; both fields only ever grow
    return spark.read.parquet(changes).groupBy("digest").agg(F.max("best").alias("best"), F.max("size").alias("size"))


def _deduped(docs: DataFrame, text: str, id_col: str, digest: Column | None, rows_per_salt: int, state_dir: str | None, earlier: DataFrame | None) -> DataFrame:
    """The struct d of docs' columns and the struct x: digest, keep_id, group_size, kept; so no names meet."""
    of = lambda name: F.col("d").getField(name)
    body = ascii_lower(F.coalesce(of(text), F.lit("")))
    made = F.sha2(body, 256) if digest is None else digest
    whole = located(docs).withColumn("digest", made)
    if earlier is not None:  # rows of batches that the state has already seen, for their texts
        old = located(earlier).withColumn("digest", made)
    state = keep_state(whole.select("digest", of(id_col).alias("id"), "at"), state_dir or shared_dir(docs.sparkSession))
    hits = stage(state.filter("size > 1"))

    s = hits.select(F.col("digest").alias("d_"), "best", "size")
    beside = lambda rows: rows.join(s.hint("merge"), F.col("digest") == F.col("d_"), "left").drop("d_")  # noqa: E731  one plan at every size: the state grows with the input
    joined = beside(whole)
    me = F.struct(of(id_col).alias("id"), "at")
    at_best = F.col("best").eqNullSafe(me)

    # the whole texts of hits against the kept one; the salt spreads the rows of a group
    texts = lambda rows: rows.filter("size > 1").select("digest", "at", "size", at_best.alias("first"), of(id_col).alias("id"), body.alias("body"))
    several = texts(joined) if earlier is None else texts(joined).union(texts(beside(old)))
    salts = F.ceil(F.col("size") / rows_per_salt)
    several = stage(several.withColumn("salt", F.pmod(F.xxhash64("at"), salts)))
    first = several.filter("first").select("digest", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.col("body").alias("kept_body"))
    other = stage(several.join(first, ["digest", "salt"]).filter("body <> kept_body").select("digest", "at", "id", "body"))
    if other.isEmpty():
        size, keep, kept = F.coalesce("size", F.lit(1).cast("long")), F.when(F.col("size") > 1, F.col("best.id")).otherwise(of(id_col)), F.col("size").isNull() | at_best
        return joined.select("d", F.struct("digest", keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept")).alias("x"))
    # unequal texts with one digest: exact groups of those rows, and the first group without them
    exact = other.groupBy("digest", "body").agg(F.max(F.struct("id", "at")).alias("best2"), F.count(F.lit(1)).alias("size2"))
    mine = other.join(exact, ["digest", "body"]).select(F.col("digest").alias("d2"), F.col("at").alias("at2"), "best2", "size2")
    gone = other.groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
    joined = joined.join(mine, (F.col("digest") == F.col("d2")) & (F.col("at") == F.col("at2")), "left").join(gone, "digest", "left")
    best, size = F.coalesce("best2", "best", me), F.coalesce(F.col("size2"), F.col("size") - F.coalesce("gone", F.lit(0)), F.lit(1).cast("long"))
    return joined.select("d", F.struct("digest", best["id"].alias("keep_id"), size.alias("group_size"), best.eqNullSafe(me).alias("kept")).alias("x"))


def dedup(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", digest: Column | None = None, rows_per_salt: int = 1000,
    state_dir: str | None = None, earlier: DataFrame | None = None,
) -> DataFrame:
    """docs' columns and the struct _dedup (see fresh() for clashing names): digest, keep_id, group_size, kept.

    With state_dir (a folder that driver and executors share) the state stays there: a later call with other docs, the
    same state_dir and the documents of the calls before as ``earlier`` goes on from it. Its group sizes and kept rows
    are those of all documents so far; a row that an earlier call kept may be superseded by one with a larger id.
    """
    found = _deduped(docs, text, id_col, digest, rows_per_salt, state_dir, earlier)
    return found.select("d.*", F.col("x").alias(fresh(docs, "_dedup")))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another row has that stays."""
    return _deduped(docs, "text", "doc_id", None, 1000, None, None).filter("x.kept").select("d.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return dedup(docs).select("doc_id", "_dedup.keep_id", "_dedup.group_size", "_dedup.kept", F.col("_dedup.digest").alias("text_sha256"))


ORACLE_SQL = """
with t as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h from documents
)
select doc_id, max(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
  doc_id = max(doc_id) over (partition by h) as kept, h as text_sha256
from t
"""
