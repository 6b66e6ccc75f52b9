"""The pipeline's near-dedup stage against brute-force Jaccard similarity of five-word shingles."""

import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mapweave.llm import common, simhash


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def stay(rows):
    """Places of the rows that stay: the first by (no id, id) of each component of pairs with similarity 0.8 or more."""
    sets, root, where = [grams(t) for _, t in rows], list(range(len(rows))), {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for g in s for j in where[g] if j > i}:
            both = len(s & sets[j])
            if 5 * both >= 4 * (len(s) + len(sets[j]) - both):
                root[top(j)] = top(i)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    return {min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0)) for g in groups.values()}


def test_stage_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    first = {}
    for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        first.setdefault((r["text"] or "").lower(), r["doc_id"])
    rows = [(i, t) for t, i in first.items()]
    rng = np.random.default_rng(3)
    for n, (_, t) in enumerate([r for r in rows if 60 < len(r[1].split()) < 600][:40]):  # up to 2 % of the words differ: 0.8 and more, or just less
        w = t.split()
        for at in rng.integers(0, len(w), max(1, len(w) * (1 + n % 3) // 100)):
            w[at] = f"changed{n}"
        rows.append((10**6 + n, " ".join(w)))
    want = {rows[i][0] for i in stay(rows)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.near(spark, docs, sf).collect()]
    assert len(rows) - len(want) >= 20 and sorted(got) == sorted(want)


@pytest.mark.parametrize("tile", [1_000_000, 100])
def test_rows_are_told_apart_by_more_than_their_id(spark, tile):
    base = [f"word{i}" for i in range(80)]
    near = " ".join([*base[:40], "changed", *base[41:]])
    rows = [
        (1, " ".join(base), "a"), (2, near, "b"), (2, "a clean text with the id of a near copy", "c"),
        (5, "repeated rows are one group of copies", "d"), (5, "repeated rows are one group of copies", "d"),
        (None, "no id and no copy of it", "e"), (None, "two rows without an id are copies", "f"), (None, "two rows WITHOUT an id are copies", "g"),
        (None, near, "h"), (7, None, "i"), (8, "", "j"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    got = simhash.drop_near_copies(docs, tile=tile)
    assert got.columns == docs.columns
    left = sorted(r._row for r in got.collect())
    assert len(left) == 6 and [x for x in left if x not in "fg"] == ["a", "c", "d", "e", "i"]
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [4, 9, 16, 23, 40, 127, 363, 5793])
def test_pairs_at_the_least_similarity_share_a_block(n):
    rng, met = np.random.default_rng(n), 0
    sizes = [(a, b) for a in (n, n - 1) for b in range(a, 5 * a // 4 + 1) if a > 3] if n < 400 else [(n, n), (n, 5 * n // 4), (n - 1, n + 1)]
    for a, b in sizes:
        c = -(-4 * (a + b) // 9)  # the least number of common shingles
        if c > a:
            continue
        for _ in range(1 + 200 // len(sizes) if n < 400 else 4):
            x = rng.integers(0, 1 << 63, a + b - c, dtype=np.uint64)
            assert len(np.intersect1d(simhash.simhash_blocks(np.unique(x[:a])), simhash.simhash_blocks(np.unique(x[a - c :]))))
            met += 1
    assert met and all(y.blocks <= 52 for y in simhash.layouts(n)) and not len(simhash.simhash_blocks(np.arange(3, dtype=np.uint64)))


def test_similar_finds_all_components():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 10**6, 50, np.uint64)) for _ in range(12)]
    sets = [np.unique(np.concatenate((b[: rng.integers(40, len(b) + 1)], rng.integers(0, 10**6, rng.integers(0, 6), np.uint64)))) for b in base for _ in range(6)]
    near = lambda a, b: 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b))
    label = list(range(len(sets)))
    for _ in sets:
        label = [min(label[j] for j in range(len(sets)) if near(sets[i], sets[j])) for i in range(len(sets))]
    got = list(range(len(sets)))
    for _ in sets:
        for u, v in simhash.similar(sets):
            got[u] = got[v] = min(got[u], got[v])
    assert got == label and 12 <= len(set(label)) < len(sets)


def test_hot_blocks_are_dealt_out(spark):
    """A third of the texts copies of one, in cells of a few texts each."""
    rng = np.random.default_rng(10)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base = [word() for _ in range(60)]
    rows = []
    for i in range(60):
        w = base[:] if i % 3 == 0 else [word() for _ in range(60)]
        w[i % 60] = f"own{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (200, 1_000_000):
        got = sorted(r.doc_id for r in simhash.drop_near_copies(docs, tile=tile).collect())
        assert got == sorted(rows[i][0] for i in stay(rows)) and len(got) == 41


@pytest.mark.parametrize("apart", [False, True])
def test_chains_of_shared_blocks(spark, monkeypatch, apart):
    """Texts in a chain, each line in three of them, but none similar: at once, and block by block where the whole weighs more."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    lines = [" ".join(word() for _ in range(30)) for _ in range(42)]
    texts = [" ".join(lines[i : i + 3] + [word() for _ in range(12)]) for i in range(40)]
    rows = list(enumerate(texts + [t + " end" for t in texts[:5]]))
    seen = []
    tiles, weighed = simhash._in_tiles, simhash._weighed
    monkeypatch.setattr(simhash, "_in_tiles", lambda members, cells: seen.append(cells.count()) or tiles(members, cells))
    heavier = lambda members, cell, *more: weighed(members, cell, *more).withColumn("work", F.col("work") * (1000 if cell == "group" else 1))
    if apart:
        monkeypatch.setattr(simhash, "_weighed", heavier)
    got = sorted(r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), tile=300).collect())
    assert got == sorted(rows[i][0] for i in stay(rows)) == list(range(40))
    at_once, singly = seen
    assert (at_once == 0 < singly) if apart else (singly == 0 < at_once)


def test_members_of_different_roots_meet_in_a_cell(spark):
    rng = np.random.default_rng(12)
    rows = [(c, c * 1000 + i, int(rng.choice([7, 7, 7, *range(20, 30)])) if c else i % 2, int(rng.integers(1, 40))) for c in range(4) for i in range(60)]
    members = spark.createDataFrame(rows, "cell long, key long, root long, n long")
    cells = {}
    for r in simhash._in_tiles(members.select("cell", "key", "root"), simhash._weighed(members, "cell", 100)).collect():
        cells.setdefault((r.root, r.a, r.b), []).append(r.key)
    met = {(u, v) for x in cells.values() for u in x for v in x}
    assert all((x[1], y[1]) in met for x in rows for y in rows if x[0] == y[0] and x[2] != y[2])
    assert max(map(len, cells.values())) < 40


def test_texts_are_not_shuffled_to_tell_which_stay(spark):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(80))
    rows = [(i, words(i % 30) + (" more" if i >= 30 else ""), f"b{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string").repartition(3)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables larger than this, as they are at size
    try:
        left = simhash.drop_near_copies(docs)
        assert "Exchange hashpartitioning" not in left._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, left.collect())) == rows[:30]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.mark.parametrize("most", [16_000, 0])
def test_rows_by_number(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BLOCKS", most)
    rows = common.stage(spark.range(0, 200_000, 1, 3).select(F.col("id").alias("bits"), F.monotonically_increasing_id().alias("row")))
    some = rows.filter("bits % 7 = 0 or bits in (1, 32767, 32768, 32769, 199999)")
    assert common.with_numbers(rows, "row", some.select("row")).exceptAll(some).isEmpty() and some.count() == common.with_numbers(rows, "row", some.select("row")).count()
    assert common.with_numbers(rows, "row", some.select("row").limit(0)).isEmpty()


def test_groups_are_joined_by_text_not_by_block(spark):
    """Texts near one that most aren't similar to each other share many blocks; joins on the text take it a few times."""
    rng = np.random.default_rng(21)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base = [word() for _ in range(150)]
    rows = []
    for i in range(80):
        w = base[:]
        for at in rng.choice(len(w), 4, replace=False):
            w[at] = f"own{i}"
        rows.append((i, " ".join(w)))
    store = spark._jsparkSession.sharedState().statusStore()
    before = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == sorted(rows[i][0] for i in stay(rows))
    made, runs = 0, store.executionsList()
    for x in {runs.apply(i).executionId() for i in range(runs.size())} - before:
        nodes, values = store.planGraph(x).allNodes(), store.executionMetrics(x)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if re.search(r"Join \[key#\d+L?\], \[key#\d+L?\], Inner", node.desc()):
                ids = (node.metrics().apply(i) for i in range(node.metrics().size()))
                made += sum(int(values.get(m.accumulatorId()).get().replace(",", "")) for m in ids if m.name() == "number of output rows" and values.get(m.accumulatorId()).isDefined())
    assert made < 20 * len(rows)
