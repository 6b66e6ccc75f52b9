"""Product codes against plain k-means in Python's integers: ties, few rows, huge components, unsound and short vectors."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from mapweave.llm import vector_codes as vc

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("code", T.StringType())])


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    used = [(i, y, v) for i, y, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max([0, *(len(v) for _, _, v in used)]) // parts))
    whole = lambda v: [math.floor(scale * x) for x in v] + [0] * (parts * width - len(v))
    points = [[whole(v)[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in used]
    first = sorted(range(len(used)), key=lambda j: (used[j][0] is None, used[j][0] or 0, used[j][2]))[:entries]
    books = [[points[j][p] for j in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for x in points:
                groups.setdefault(near(x[p], books[p]), []).append(x[p])
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else old for e, old in enumerate(books[p])]
    out = []
    for (i, y, _), x in zip(used, points, strict=True):
        codes = [near(x[p], books[p]) for p in range(parts)]
        out.append((i, y, "".join(f"{c:02x}" for c in codes), min(2**63 - 1, sum(far(x[p], books[p][c]) for p, c in enumerate(codes)))))
    return out, books


def same(spark, rows, tree_rows=4096, slices=3):
    got, books = vc.encode(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(slices), tree_rows=tree_rows)
    want, own = brute(rows)
    assert books == own
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("tree_rows", [4096, 64])
def test_against_plain_rounds(spark, tree_rows):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((300, 16)).astype(np.float32)
    vectors[::3] = vectors[5]  # a very common vector, so several first entries are equal
    vectors[1::7] = np.round(vectors[1::7])  # ties
    rows = [(i, None if i % 11 == 0 else i % 4, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [rows[9], rows[9], (None, 1, rows[8][2]), (400, 1, None), (401, 2, [1.0, None] * 8), (402, 2, [math.nan] * 16), (403, 1, [math.inf] * 16), (404, 3, [0.5] * 5), (405, 3, [])]
    same(spark, rows, tree_rows)


def test_huge_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, [float(np.float32(x)) for x in rng.standard_normal(8) * 10.0 ** rng.integers(0, 6)]) for i in range(60)]
    same(spark, rows + [(90, 1, [float(np.float32(1e30))] * 8), (91, 1, [-1e9] * 8)], 16)


def test_few_rows_and_none(spark):
    same(spark, [(i, 0, [float(i)] * 3) for i in range(5)])
    same(spark, [(1, None, [])])
    got, books = vc.encode(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and books == [[]] * 8


def test_filtering_assigns_whole_subtrees():
    rng = np.random.default_rng(5)
    centres = rng.integers(-100_000, 100_000, (16, 8))
    points = centres[rng.integers(0, 16, 4000)] + rng.integers(-50, 50, (4000, 8))
    looked = []
    old, vc.nearest = vc.nearest, lambda p, *a: looked.append(len(p)) or old(p, *a)
    try:
        count, total, entry = vc.filtered(vc.build(points), points, centres)
    finally:
        vc.nearest = old
    want = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    assert (entry == want).all() and (count == np.bincount(want, minlength=16)).all() and sum(looked) < 1000
    assert all((total[e] == points[want == e].sum(axis=0)).all() for e in range(16))


def test_sums_of_labels(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), (3, 5)], "label long, error long")
    for most in (100, 0):
        assert sorted(map(repr, map(tuple, vc.with_sum(rows, "label", "error", "s", most).collect()))) == sorted(map(repr, [(None, 1, 3), (None, 2, 3), (3, 5, 5)]))


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view embeddings as from '{sf}/embeddings.parquet'")
    got, want = vc.op13_vector_codes(spark, sf), con.sql(vc.ORACLE_SQL)
    rows = sorted(map(tuple, got.collect()))
    assert got.columns == want.columns and rows == sorted(want.fetchall())
    _, books = vc.encode(spark.read.parquet(f"{sf}/embeddings.parquet"))
    assert rows[0][4] == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
