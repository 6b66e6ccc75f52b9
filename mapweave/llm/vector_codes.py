"""Product codes of vectors, their codebooks fitted by the filtering form of Lloyd's algorithm.

Vectors are cut into equal parts and each part position has a codebook of its own. Every partition turns its vectors,
``tree_rows`` at a time (a bound on what a task holds), into one kd-tree for each part position; a node keeps the box,
the sum and the number of its parts. The trees are written once to the shared folder and read in each round. From the
root down, the entry nearest to a box's middle is held against the others: an entry that no point of the box can be
nearer to is out, and where one entry is left the whole subtree is assigned at once by its sum and number; only the
parts of undecided leaves are compared one by one. The driver gets sums and numbers of the entries, which are as many at
any size of the table. Components are whole numbers and compared in whole numbers, so codes don't depend on how the
rows are dealt out.

Rows whose vector is null or has a null, NaN or infinite component are dropped. Vectors shorter than the longest (or
than a multiple of the number of parts) count as filled up with zeros. The first entries are those of the smallest ids;
null ids come last, equal ones by their vectors. With fewer rows than entries, codebooks have as many entries as rows.
Repeated rows count as often as they come. Components of 2^20 and more are compared one by one in Python's integers, and
errors are cut off at 64 bits. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .hard_negatives import rows_of, sound

LEAF = 16
#: Parts whose components are all below it are compared in 64-bit integers.
LARGE = 1 << 20
MOST = (1 << 63) - 1
_TREES = "ids array<long>, labels array<long>, points binary, orders binary, lows binary, highs binary, sums binary"
_SUMS = "part int, entry int, n long, sums array<decimal(38,0)>"
_CODES = "id long, label long, code string, error long"


def levels_of(n: int) -> int:
    """Levels of halving until no node of n points has more than LEAF."""
    return max(0, (max(n, 1) - 1) // LEAF).bit_length()


def bounds(n: int, level: int) -> np.ndarray:
    """First points of a level's nodes, in the tree's order, and n at the end."""
    at = np.array([0, n])
    for _ in range(level):
        at = np.insert(at, np.arange(1, len(at)), (at[:-1] + at[1:]) // 2)
    return at


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The points' order in a balanced kd-tree; lower and upper corners and sums of all nodes, level after level."""
    n, order = len(points), np.arange(len(points))
    lows, highs, sums = [], [], []
    for level in range(levels_of(n) + 1):
        at = bounds(n, level)
        ranged = points[order]
        lows.append(np.minimum.reduceat(ranged, at[:-1]))
        highs.append(np.maximum.reduceat(ranged, at[:-1]))
        sums.append(np.add.reduceat(ranged, at[:-1]))
        node = np.repeat(np.arange(len(at) - 1), np.diff(at))
        widest = (highs[-1] - lows[-1]).argmax(axis=1)[node]
        order = order[np.lexsort((ranged[np.arange(n), widest], node))]
    return order, np.concatenate(lows), np.concatenate(highs), np.concatenate(sums)


def nearest(points: np.ndarray, book: np.ndarray, open_: np.ndarray | None = None) -> np.ndarray:
    """Index of each point's nearest entry, the first of equally near ones; open_: the entries to look at."""
    far = ((points[:, None] - book) ** 2).sum(axis=2)
    if open_ is not None:
        far = np.where(open_, far, MOST)
    return far.argmin(axis=1)


def filtered(tree: tuple, points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of points and their sums for each entry, and the entry of each point."""
    order, lows, highs, sums = tree
    n, k = len(points), len(book)
    depth = levels_of(n)
    count, total, entry = np.zeros(k, np.int64), np.zeros((k, book.shape[1]), np.int64), np.zeros(n, np.int64)
    nodes, open_, first = np.array([0]), np.ones((1, k), bool), 0
    for level in range(depth + 1):
        at = bounds(n, level)
        low, high = lows[first + nodes], highs[first + nodes]
        # twice the distance to twice the middle stays whole
        middle = ((2 * book - (low + high)[:, None]) ** 2).sum(axis=2)
        best = np.where(open_, middle, MOST).argmin(axis=1)
        star = book[best][:, None]
        corner = np.where(book > star, high[:, None], low[:, None])
        more = ((book - star) * (book + star - 2 * corner)).sum(axis=2)  # how much farther the entry is, in the corner that favours it most
        out = (more > 0) | (more == 0) & (np.arange(k) > best[:, None])
        open_ = open_ & ~out
        open_[np.arange(len(nodes)), best] = True
        done = open_.sum(axis=1) == 1
        np.add.at(count, best[done], np.diff(at)[nodes[done]])
        np.add.at(total, best[done], sums[first + nodes[done]])
        for node, e in zip(nodes[done], best[done], strict=True):
            entry[order[at[node] : at[node + 1]]] = e
        nodes, open_ = nodes[~done], open_[~done]
        if level == depth or not len(nodes):
            break
        first += len(at) - 1
        nodes, open_ = np.stack((2 * nodes, 2 * nodes + 1), axis=1).ravel(), np.repeat(open_, 2, axis=0)
    if len(nodes):
        left = np.concatenate([np.arange(at[x], at[x + 1]) for x in nodes])
        mine = np.repeat(open_, np.diff(at)[nodes], axis=0)
        entry[order[left]] = found = nearest(points[order[left]], book, mine)
        np.add.at(count, found, 1)
        np.add.at(total, found, points[order[left]])
    return count, total, entry


class Trees:
    """One stored row: its ids and labels, the points of each part, and the parts' trees; without trees where components are large."""

    def __init__(self, row: dict, parts: int, width: int):
        self.ids, self.labels = row["ids"], row["labels"]
        n = len(self.ids)
        if row["orders"] is None:
            self.points = np.array([int(x) for x in row["points"].split(b",")], object).reshape(parts, n, width)
            self.trees = None
            return
        self.points = np.frombuffer(row["points"], np.int32).reshape(parts, n, width).astype(np.int64)
        read = lambda name, kind: np.frombuffer(row[name], kind).reshape(parts, -1, width).astype(np.int64)
        orders = np.frombuffer(row["orders"], np.int32).reshape(parts, n)
        self.trees = list(zip(orders, read("lows", np.int32), read("highs", np.int32), read("sums", np.int64), strict=True))

    def assign(self, part: int, book: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points = self.points[part]
        if self.trees is not None and max(abs(x) for e in book for x in e) < LARGE:
            return filtered(self.trees[part], points, np.array(book, np.int64))
        whole = np.array(book, object)
        far = [[sum((p - e) ** 2) for e in whole] for p in points.astype(object)]
        entry = np.array([min(range(len(whole)), key=row.__getitem__) for row in far], np.int64)
        total = np.array([[sum(points[entry == e, d].astype(object)) for d in range(whole.shape[1])] for e in range(len(whole))], object)
        return np.bincount(entry, minlength=len(whole)), total, entry


def _grown(parts: int, width: int, scale: float, tree_rows: int):
    def blob(arrays: list[np.ndarray], kind) -> bytes:
        return np.ascontiguousarray(np.stack(arrays), kind).tobytes()

    def made(ids: list[np.ndarray], labels: list, rows: list[np.ndarray]) -> pa.RecordBatch:
        cut = np.concatenate(rows).reshape(-1, parts, width)
        row = {"ids": np.concatenate(ids), "labels": pa.concat_arrays(labels)}
        if np.abs(cut).max(initial=0) < LARGE:
            each = [np.ascontiguousarray(cut[:, p]).astype(np.int64) for p in range(parts)]
            trees = list(zip(*map(build, each), strict=True))
            blobs = [blob(each, np.int32), *(blob(t, kind) for t, kind in zip(trees, (np.int32, np.int32, np.int32, np.int64), strict=True))]
        else:
            blobs = [",".join(str(int(x)) for x in cut.swapaxes(0, 1).ravel()).encode(), None, None, None, None]
        arrays = [pa.array([x], pa.list_(pa.int64())) for x in (row["ids"], row["labels"].to_pylist())] + [pa.array([b], pa.binary()) for b in blobs]
        return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _TREES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, rows, held = [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, tree_rows // 4):
                part = batch.slice(at, tree_rows // 4)
                values = rows_of(part.column(2), scale)
                ids.append(part.column(0).to_pylist())
                labels.append(part.column(1))
                rows.append(np.pad(values, ((0, 0), (0, parts * width - values.shape[1]))))
                held += len(values)
                if held >= tree_rows:
                    yield made([np.array(x, object) for x in ids], labels, rows)
                    ids, labels, rows, held = [], [], [], 0
        if held:
            yield made([np.array(x, object) for x in ids], labels, rows)

    return run


def _counted(parts: int, width: int, books: list[list[list[int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(books[0])
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), object)
        for batch in batches:
            for at in range(batch.num_rows):
                trees = Trees(batch.slice(at, 1).to_pylist()[0], parts, width)
                for p in range(parts):
                    n, sums, _ = trees.assign(p, books[p])
                    count[p] += n
                    total[p] += sums
        rows = [(p, e, int(count[p, e]), [Decimal(int(x)) for x in total[p, e]]) for p in range(parts) for e in range(k) if count[p, e]]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["part", "entry", "n", "sums"])

    return run


def _coded(parts: int, width: int, books: list[list[list[int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                trees = Trees(batch.slice(at, 1).to_pylist()[0], parts, width)
                entries = np.stack([trees.assign(p, books[p])[2] for p in range(parts)])
                error = 0
                for p in range(parts):
                    exact = np.int64 if trees.trees is not None and max(abs(x) for e in books[p] for x in e) < LARGE else object
                    error = error + ((trees.points[p].astype(exact) - np.array(books[p], exact)[entries[p]]) ** 2).sum(axis=1)
                codes = ["".join(f"{e:02x}" for e in column) for column in entries.T]
                arrays = [pa.array(trees.ids, pa.int64()), pa.array(trees.labels, pa.int64()), pa.array(codes), pa.array([min(int(x), MOST) for x in error], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "label", "code", "error"])

    return run


def encode(
    rows: DataFrame, id_col: str = "vec_id", label: str = "label", vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6,
    scale: float = 4096.0, tree_rows: int = 4096,
) -> tuple[DataFrame, list[list[list[int]]]]:
    """(id, label, code, error) of each kept row, and the codebooks: part, entry, component. At most 256 entries a part."""
    used = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector")).filter(sound(F.col("vector")))
    longest = used.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    seeds = used.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).toArrow().combine_chunks()
    first = rows_of(seeds.column("vector").combine_chunks(), scale) if len(seeds) else np.zeros((0, 0))
    first = np.pad(first, ((0, 0), (0, parts * width - first.shape[1])))
    books = [[[int(x) for x in row[p * width : (p + 1) * width]] for row in first] for p in range(parts)]
    trees = stage(used.mapInArrow(_grown(parts, width, scale, tree_rows), _TREES))
    for _ in range(rounds if len(first) else 0):
        sums = trees.mapInArrow(_counted(parts, width, books), _SUMS).select("part", "entry", "n", F.posexplode("sums").alias("at", "x"))
        for r in sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():  # parts x entries x width rows
            books[r["part"]][r["entry"]][r["at"]] = int(r["x"]) // r["n"]
    return trees.mapInArrow(_coded(parts, width, books), _CODES), books


def with_sum(rows: DataFrame, key: str, value: str, name: str, most: int = 100_000) -> DataFrame:
    """rows and the sum of value over the rows with an equal key, nulls together. Sums are broadcast where they are at most so many."""
    sums = stage(rows.groupBy(key).agg(F.sum(value).alias(name)).withColumnRenamed(key, "_key"))
    sums = F.broadcast(sums) if sums.count() <= most else sums.hint("merge")
    return rows.join(sums, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    found = with_sum(stage(coded), "label", "error", "label_error")
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """Six rounds of assigning and replacing, written out one after another."""
    sql = """
with k as (
  select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
p as materialized (select r, vec_id, label, part, v[part * 8 + 1 : part * 8 + 8] as v from k, range(0, 8) t(part)),
c0 as materialized (select part, v, row_number() over (partition by part order by vec_id) - 1 as entry from p qualify entry < 16)"""
    for t in range(1, 8):
        sql += f""",
n{t} as materialized (
  select p.r, p.part, p.v, min(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 16 + c.entry) as best
  from p join c{t - 1} c using (part) group by p.r, p.part, p.v
)"""
        if t < 7:
            sql += f""",
s{t} as (select part, best % 16 as entry, i, sum(v[i]) as x, count(*) as n from n{t}, range(1, 9) d(i) group by all),
f{t} as (select part, entry, list(cast((x - ((x % n) + n) % n) // n as bigint) order by i) as v from s{t} group by part, entry),
c{t} as materialized (select c.part, c.entry, coalesce(f.v, c.v) as v from c{t - 1} c left join f{t} f on c.part = f.part and c.entry = f.entry)"""
    return sql + """,
e as (
  select r, string_agg(printf('%02x', cast(best % 16 as integer)), '' order by part) as code, cast(sum(best // 16) as bigint) as error from n7 group by r
),
h as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as codebooks_sha256 from c6)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from k join e using (r), h
"""


ORACLE_SQL = _oracle()
