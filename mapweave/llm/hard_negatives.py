"""Hard negatives by blocked products of vectors.

Anchors come in blocks of at most ``block_bytes`` of float64 (a bound that does not grow with the data). Each block is
broadcast and meets every candidate, tile by tile, in one matrix product. Components are whole numbers, so products are
exact in float64 as long as they stay below 2^53; where the lengths of two vectors allow more, they are multiplied in
Python's integers and cut off at 64 bits. Each task keeps the ``positives`` best rows of an anchor's label, whatever the
number of its rows; the tasks' rows merge by rank (Spark limits each group before the shuffle and after it). A second
pass over the candidates keeps, for each anchor and positive, the ``negatives`` best rows of another label whose scores
lie in the window below the positive's.

Rows with a null id, label or vector, or with a null, NaN or infinite component, take no part. A vector shorter than
others counts as filled up with zeros. Every row is a candidate of its own, also where rows are repeated, and every
anchor row has its own result; rows with the anchor's id are not its partners. Scores tie by the smaller id. An anchor
without another row of its label, and a positive without a row in its window, have no result. Empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, stage, table

LEAST = np.iinfo(np.int64).min  # the score of no row
TILE = 1024
_PICKED = "anchor long, place int, score long, id long"
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def sound(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def rows_of(lists: pa.ListArray, scale: float) -> np.ndarray:
    """The lists' components, each floor(scale * x), as rows of whole float64 numbers; short lists get zeros at the end."""
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of a and of b as int64: exact, cut off at 64 bits."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (a, b))
    far = [np.linalg.norm(x, axis=1) for x in (a, b)]
    if far[0].max(initial=0) * far[1].max(initial=0) < 2.0**52:  # bounds every partial sum
        return np.rint(a @ b.T).astype(np.int64)
    small = [x < 2.0**26 for x in far]
    out = np.zeros((len(a), len(b)), np.int64)
    out[np.ix_(small[0], small[1])] = np.rint(a[small[0]] @ b[small[1]].T).astype(np.int64)
    whole = lambda row: [int(x) for x in row]
    cut = lambda x: min(max(x, LEAST + 1), -(LEAST + 1))
    for i, j in zip(*np.nonzero(~(small[0][:, None] & small[1])), strict=True):
        out[i, j] = cut(sum(x * y for x, y in zip(whole(a[i]), whole(b[j]), strict=True)))
    return out


class Best:
    """For each of n keys the k best (score, id) that were offered: higher scores first, ties by the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), LEAST), np.zeros((n, k), np.int64)

    def offer(self, first: int, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """scores of the keys from first on (rows) and of rows with these ids (columns), where allowed."""
        last, k = first + len(scores), self.k
        hit = allowed & (scores >= self.scores[first:last, [k - 1]])
        if hit.sum() > 8 * k * len(scores) and scores.shape[1] > k:  # no more than the tile's own best, and those that tie with them
            mine = np.where(hit, scores, LEAST)
            hit &= mine >= np.partition(mine, -k, axis=1)[:, [-k]]
        r, c = np.nonzero(hit)
        if not len(r):
            return
        new = np.unique(r)
        key = np.concatenate((r, np.repeat(new, k)))
        score = np.concatenate((scores[r, c], self.scores[first + new].ravel()))
        who = np.concatenate((ids[c], self.ids[first + new].ravel()))
        order = np.lexsort((who, ~score, key))
        key = key[order]
        picked = order[np.arange(len(key)) - np.searchsorted(key, key) < k]
        self.scores[first + new], self.ids[first + new] = score[picked].reshape(-1, k), who[picked].reshape(-1, k)

    def batch(self, anchors: np.ndarray, places: int) -> pa.RecordBatch:
        """What was found; keys are anchor by anchor, with so many places each."""
        at, rank = np.nonzero(self.scores > LEAST)
        arrays = [pa.array(anchors[at // places]), pa.array((at % places).astype(np.int32)), pa.array(self.scores[at, rank]), pa.array(self.ids[at, rank])]
        return pa.RecordBatch.from_arrays(arrays, ["anchor", "place", "score", "id"])


def _tiles(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            part = batch.slice(at, TILE)
            rows = rows_of(part.column(2), scale)
            good = np.isfinite(rows).all(axis=1)  # null components are NaN here
            yield part.column(0).to_numpy()[good], part.column(1).to_numpy()[good], rows[good]


def _positives(sent, k: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, labels, vectors = sent.value
        best = Best(len(ids), k)
        for own, kinds, rows in _tiles(batches, scale):
            for at in range(0, len(ids), TILE):
                part = slice(at, at + TILE)
                best.offer(at, products(vectors[part], rows), (labels[part, None] == kinds) & (ids[part, None] != own), own)
        yield best.batch(number, 1)

    return run


def _negatives(sent, k: int, scale: float, low: tuple[int, int]):
    """low: the window's lower end as numerator and denominator of a share of the positive's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, labels, vectors, tops = sent.value  # tops: positive scores of each anchor, LEAST where there is none
        places = tops.shape[1]
        least = np.array([[-((-low[0] * int(x)) // low[1]) if x > LEAST else 0 for x in row] for row in tops], object).clip(LEAST + 1, -(LEAST + 1)).astype(np.int64)
        best = Best(len(ids) * places, k)
        for own, kinds, rows in _tiles(batches, scale):
            step = max(1, TILE // places)
            for at in range(0, len(ids), step):
                part = slice(at, at + step)
                scores = products(vectors[part], rows)
                other = (labels[part, None] != kinds) & (ids[part, None] != own)
                near = (scores[:, None] >= least[part, :, None]) & (scores[:, None] <= tops[part, :, None]) & other[:, None]
                best.offer(at * places, np.repeat(scores, places, axis=0), near.reshape(-1, len(own)), own)
        yield best.batch(number, places)

    return run


def _merged(found: DataFrame, k: int, place: str = "rank") -> DataFrame:
    order = W.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    return found.withColumn(place, F.row_number().over(order)).filter(F.col(place) <= k)


def mine(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 5,
    window: tuple[int, int] = (4, 5), scale: float = 256.0, block_bytes: int = 16 << 20,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which is_anchor holds.

    window: numerator and denominator of the least share of the positive's score that a negative may have.
    """
    spark = rows.sparkSession
    there = F.col(id_col).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()
    plain = rows.filter(there).select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"), is_anchor.alias("anchor"))
    every = plain.select("id", "label", "vector")
    # anchors get running numbers (task and row in it), so that blocks of them can be read back one by one
    dealt = stage(plain.filter(F.col("anchor") & sound(F.col("vector"))).select(F.monotonically_increasing_id().alias("number"), "id", "label", "vector"))
    sizes = dealt.groupBy(F.shiftright("number", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).orderBy("part").collect()  # a row for each task
    per_block = max(1, block_bytes // (8 * max([1, *(r["width"] for r in sizes)])))
    path = shared_dir(spark)
    spark.createDataFrame([], _OUT).write.parquet(path)
    for near in _blocks([(r["part"], r["n"]) for r in sizes], per_block):
        inside = reduce(or_, (F.col("number").between((part << 33) + low, (part << 33) + high - 1) for part, low, high in near))
        block = dealt.filter(inside).orderBy("number").toArrow().combine_chunks()
        number, ids, labels = (block.column(c).to_numpy() for c in ("number", "id", "label"))
        vectors = rows_of(block.column("vector").combine_chunks(), scale)
        sent = spark.sparkContext.broadcast((number, ids, labels, vectors))
        first = stage(_merged(every.mapInArrow(_positives(sent, positives, scale), _PICKED), positives, "at"))
        got = first.select("anchor", "at", "score").toArrow()  # so many rows for each anchor of the block at most
        tops = np.full((len(ids), positives), LEAST)
        tops[np.searchsorted(number, got.column("anchor").to_numpy()), got.column("at").to_numpy() - 1] = got.column("score").to_numpy()
        sent = spark.sparkContext.broadcast((number, ids, labels, vectors, tops))
        second = _merged(every.mapInArrow(_negatives(sent, negatives, scale, window), _PICKED), negatives)
        named = dealt.filter(inside).select(F.col("number").alias("anchor"), F.col("id").alias("anchor_id"))
        pairs = first.select("anchor", (F.col("at") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = second.select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["anchor", "place"]).join(named, "anchor")
        out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
    return spark.read.schema(_OUT).parquet(path)


def _blocks(sizes: list[tuple[int, int]], per_block: int) -> Iterator[list[tuple[int, int, int]]]:
    """Blocks of (part, from, to), together at most per_block anchors each."""
    block, left = [], per_block
    for part, n in sizes:
        at = 0
        while at < n:
            end = min(n, at + left)
            block.append((part, at, end))
            left -= end - at
            at = end
            if not left:
                yield block
                block, left = [], per_block
    if block:
        yield block


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), "embedding"), F.pmod("vec_id", F.lit(100)) == 0)


ORACLE_SQL = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select a.vec_id as anchor_id, a.label = c.label as same, c.vec_id, cast(list_inner_product(a.v, c.v) as bigint) as score
  from e a join e c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id
),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank,
  vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5
"""
