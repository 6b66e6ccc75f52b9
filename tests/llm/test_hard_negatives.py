"""Hard negatives against brute force: ties, repeated rows, blocks, huge components, unsound vectors."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapweave.llm import hard_negatives as hn

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType()), T.StructField("a.b", T.StringType())])


def brute(rows, anchors, low=(4, 5), scale=256, k=5, keep=5):
    used = [(i, y, [math.floor(scale * x) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = lambda x: min(max(x, -(2**63) + 1), 2**63 - 1)
    out = []
    for a, y, v in used:
        if not anchors(a):
            continue
        scored = sorted((-cut(sum(p * q for p, q in zip(v, w, strict=False))), i, z) for i, z, w in used if i != a)
        for s, p, _ in [x for x in scored if x[2] == y][:k]:
            near = [(i, -t) for t, i, z in scored if z != y and low[0] * -s <= low[1] * -t and -t <= -s][:keep]
            out += [(a, p, r + 1, i, -s, t) for r, (i, t) in enumerate(near)]
    return sorted(out)


def rows_of(n, seed, width=6):
    rng = np.random.default_rng(seed)
    vectors = rng.standard_normal((n, width)).astype(np.float32)
    vectors[rng.random(n) < 0.3] = vectors[0]  # one very common vector
    return [(i, int(rng.integers(3)), [float(x) for x in v]) for i, v in enumerate(vectors)]


def frame(spark, rows, slices=3):
    return spark.createDataFrame([(*r, "clash", "dot") for r in rows], SCHEMA).repartition(slices)


@pytest.mark.parametrize("block_bytes", [16 << 20, 6 * 8 * 3])
def test_against_brute_force(spark, block_bytes):
    rows = rows_of(150, 1)
    rows += [rows[20], rows[20], (7, 1, rows[7][2])]  # repeated rows, also with another label
    rows += [(1000, None, [1.0] * 6), (1010, 1, None), (1020, 1, [1.0, None] * 3), (1030, 2, [math.nan] * 6), (1040, 0, [math.inf] * 6), (None, 1, [1.0] * 6), (1050, 1, [1.0, 2.0]), (1060, 2, [])]
    got = hn.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, block_bytes=block_bytes)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0)


def test_huge_components_are_exact(spark):
    rng, far = np.random.default_rng(2), float(np.float32(3e38))
    rows = [(i, i % 2, [float(np.float32(x)) for x in rng.standard_normal(4) * 10.0 ** rng.integers(0, 14)]) for i in range(60)]
    rows += [(100, 0, [far, 1.0, 0.0, 0.0]), (101, 1, [far, -1.0, 0.0, 0.0]), (102, 0, [-far, 1.0, 0.0, 0.0])]
    got = hn.mine(frame(spark, rows), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 5 == 0)


def test_empty_table_and_lonely_anchor(spark):
    assert hn.mine(frame(spark, []), F.lit(True)).count() == 0
    assert hn.mine(frame(spark, [(0, 1, [1.0])]), F.lit(True)).count() == 0
    assert hn.mine(frame(spark, [(0, 1, [1.0]), (1, 2, [1.0])]), F.lit(None).cast("boolean")).count() == 0


def test_best_takes_ties_by_id():
    best, ids = hn.Best(1, 3), np.arange(3000)[::-1].copy()
    for at in range(0, 3000, 1000):
        best.offer(0, np.full((1, 1000), 5), np.ones((1, 1000), bool), ids[at : at + 1000])
    assert best.ids.tolist() == [[0, 1, 2]] and best.scores.tolist() == [[5, 5, 5]]


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.sql(f"create view embeddings as from '{sf}/embeddings.parquet'")
    got, want = hn.op11_hard_negatives(spark, sf), con.sql(hn.ORACLE_SQL)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
