"""Searches from many starts, bucketed edges, bitmap counts, views of all entities, deep pages, sketches."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapweave.functions import text as tx
from mapweave.operators import bitmaps, entities, facets, page_index, reach, sketches
from mapweave.plans.search import EntitySearch
from mapweave.sources import mappings as source
from mapweave.sources.folders import clear, new_folder, staged


@pytest.fixture(scope="module")
def graph(spark):
    """A hub, a chain, a loop, repeated edges, and rows without a CURIE."""
    rng = np.random.default_rng(5)
    pairs = [("H", f"N{i}") for i in range(300)] + [(f"C{i}", f"C{i + 1}") for i in range(8)] + [("N0", "C0"), ("L", "L"), ("", "C3"), (None, "C4"), ("N1", None)]
    pairs += [(f"R{a}", f"R{b}") for a, b in rng.integers(0, 60, (90, 2))] + [("N0", "C0")] * 3
    rows = [(f"{i:05d}", s, o, ["p", "q", None][i % 3], "r:x" if i % 2 else "r:y", None if i % 7 == 0 else (i % 11) / 10, [["a", "b"], ["a", "a"], [], None][i % 4], f"2020-01-{1 + i % 9:02d}", f"s{i % 5}") for i, (s, o) in enumerate(pairs)]
    made = spark.createDataFrame(rows, "uuid string, subject_id_curie string, object_id_curie string, mapping_provider string, predicate_id_curie string, confidence double, subject_match_field array<string>, mapping_date string, mapping_set_id string")
    return staged(source.conform(made).repartition(5))


def reached(rows, start, hops):
    near = {}
    for r in rows:
        if r.subject_id_curie and r.object_id_curie:
            near.setdefault(r.subject_id_curie, set()).add(r.object_id_curie)
            near.setdefault(r.object_id_curie, set()).add(r.subject_id_curie)
    known = {r[c] for r in rows for c in ("subject_id_curie", "object_id_curie")}
    out, last = {start: 0} if start and start in known else {}, {start}
    for d in range(1, hops + 1):
        last = {x for s in last if s in out for x in near.get(s, ())} - out.keys()
        out |= dict.fromkeys(last, d)
    return out


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_many_starts(spark, graph, hops):
    rows = graph.collect()
    starts = ["H", "C0", "L", "nobody", "", None, "C0", *(f"R{i}" for i in range(60)), *(f"N{i}" for i in range(70))]
    want = {(s, e, d) for s in starts if s for e, d in reached(rows, s, hops).items()}
    got = reach.neighbours_many(graph, starts, hops).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    source.write_edges(graph, path := new_folder(spark, "edges"))
    assert {tuple(r) for r in reach.neighbours_many(None, starts, hops, spark.read.parquet(path)).collect()} == want
    assert reach.neighbours_many(graph, [], hops).count() == 0
    with pytest.raises(ValueError):
        reach.neighbours_many(graph, ["H"], 4)


def test_long_lists_of_starts(graph):
    rows, starts = graph.collect(), [f"none{i}" for i in range(1200)] + ["C2"]
    assert {tuple(r) for r in reach.neighbours_many(graph, starts, 2).collect()} == {("C2", e, d) for e, d in reached(rows, "C2", 2).items()}


def test_bucketed_edges_stay_where_they_lie(spark, graph):
    rows, links = graph.collect(), spark.table(reach.write_bucketed_edges(graph, 8))
    for start, hops in itertools.product(("H", "C0", "L", "nobody"), (1, 3)):
        got = entities.neighbourhood(None, start, hops, links, few=0, most=0).collect()
        assert {tuple(r) for r in got} == set(reached(rows, start, hops).items()) and len(got) == len(reached(rows, start, hops))
    frontier = staged(spark.createDataFrame([(f"C{i}",) for i in range(5)], "entity string"))
    plan = entities.beyond(frontier, None, links, 0, 0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1
    exchange, scan = plan.index("Exchange"), plan.index("Bucketed: true")
    below = plan[exchange : exchange + 600]
    assert "entity#" in below and "step-" in plan[exchange:] and scan >= 0  # what is exchanged is the frontier
    assert "other#" not in plan[exchange:] or plan.index("other#", exchange) > plan.index("Bucketed", 0) - 2000 and plan.index("Bucketed: true") < exchange


@pytest.mark.parametrize("search", [
    EntitySearch(["H", "C0", "C3"]), EntitySearch(["H"], {"mapping_provider": ["p"]}), EntitySearch(["H", "C1"], {"mapping_provider": ["p", "q"], "predicate_id_curie": ["r:x"]}, (0.2, 0.8)),
    EntitySearch(["H", "L"], {"subject_match_field": ["a"], "mapping_provider": None}), EntitySearch(["nobody"]), EntitySearch([]), EntitySearch(["H"], {"mapping_provider": []}), EntitySearch(["H"], {"mapping_provider": ["zz"], "confidence": ["x"]}),
])
def test_bitmap_counts(graph, search):
    keys = ("mapping_provider", "predicate_id_curie", "subject_match_field", "confidence")
    if not hasattr(test_bitmap_counts, "index"):
        test_bitmap_counts.index = bitmaps.build(graph, keys)
    index, same = test_bitmap_counts.index, lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(index.counts(search, keys), search.run(graph, keys).facets)
    assert index.total(search).first()[0] == search.rows(graph).count()
    base = EntitySearch(search.curies, {}, search.confidence).rows(graph)
    selected = {k: v for k, v in search.facets.items() if k != "confidence"}
    assert same(index.counts(search, keys, True), facets.counts_without_own(base, selected, keys[:3]))


def test_bitmap_counts_read_the_index_only(graph):
    index = bitmaps.build(graph, ("mapping_provider",))
    plan = index.counts(EntitySearch(["H"], {"mapping_provider": ["p"]}), ("mapping_provider",))._jdf.queryExecution().optimizedPlan().toString()
    assert "subject_id_curie" not in plan and "mapping_date" not in plan and "bitmap" in plan


def test_bitmaps_of_many_rows(spark):
    many = source.conform(spark.range(0, 150_000, 1, 3).select(F.col("id").cast("string").alias("uuid"), F.lit("E").alias("subject_id_curie"), F.when(F.col("id") % 5 == 0, "x").otherwise("y").alias("mapping_provider")))
    index = bitmaps.build(many, ("mapping_provider",))
    assert index.values.filter("value = 'x'").count() == 6  # two buckets for each part of 50,000 rows
    assert {tuple(r) for r in index.counts(EntitySearch(["E"]), ("mapping_provider",)).collect()} == {("mapping_provider", "x", 30_000), ("mapping_provider", "y", 120_000)}


def test_views_of_all_entities(spark, graph):
    views = entities.entity_views(graph, 20)
    got = {}
    for r in views.select("entity", "place", "uuid", "is_subject", "is_object").collect():
        got.setdefault(r.entity, []).append(tuple(r)[1:])
    names = {r[c] for r in graph.collect() for c in ("subject_id_curie", "object_id_curie")} - {"", None}
    assert got.keys() == names
    for e in ("H", "C0", "C3", "L", "N0", "R5"):
        want = [(i + 1, r.uuid, r.is_subject, r.is_object) for i, r in enumerate(entities.entity_view(graph, e, 20).collect())]
        assert sorted(got[e]) == want
    plan = views._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan[plan.index("Exchange") :]  # below the shuffle too


@pytest.mark.parametrize("partitions", [None, 7])
def test_deep_pages(graph, partitions):
    index, order = page_index.build(graph, partitions=partitions), sorted(r.uuid for r in graph.collect())
    assert index.total == len(order) and index.total_pages(25) == -(-len(order) // 25)
    for limit, number in [(25, 1), (25, 9), (25, index.total_pages(25)), (25, index.total_pages(25) + 1), (1, len(order)), (1000, 1), (1000, 2), (10, 17)]:
        assert [r.uuid for r in index.page(number, limit).collect()] == order[(number - 1) * limit : number * limit]
    with pytest.raises(ValueError):
        index.page(0)
    if partitions:
        plan = index.page(index.total_pages(25), 25)._jdf.queryExecution().executedPlan().toString()
        filters = plan[plan.index("PartitionFilters") :].split("]")[0]
        assert "_part#" in filters and str(index.ranges[-1][0]) in filters and "PushedFilters: []" in plan
    empty = page_index.build(graph.filter("false"))
    assert empty.total == 0 and empty.page(1).count() == 0


def test_sketches_merge(spark, graph):
    days = staged(sketches.build(graph, ("mapping_date", "mapping_provider")))
    for part, rows in (("true", graph), ("mapping_date > '2020-01-04'", graph.filter("mapping_date > '2020-01-04'")), ("mapping_provider = 'p'", graph.filter("mapping_provider = 'p'")), ("mapping_date < '2020'", graph.filter("false"))):
        assert tuple(sketches.stats(days.filter(part)).first()) == tuple(entities.stats(rows).first())
    many = source.conform(spark.range(60_000).select(F.concat(F.lit("E:"), F.col("id").cast("string")).alias("subject_id_curie"), F.concat(F.lit("F:"), (F.col("id") % 9000).cast("string")).alias("object_id_curie"), (F.col("id") % 30).cast("string").alias("mapping_date"), F.col("id").cast("string").alias("uuid")))
    kept = staged(sketches.build(many))
    for n in (1, 7, 30):
        some, exact = kept.filter(F.col("mapping_date").cast("int") < n), entities.stats(many.filter(F.col("mapping_date").cast("int") < n)).first()
        got = sketches.stats(some).first()
        assert got.nb_mapping == exact.nb_mapping and got.nb_entity == pytest.approx(exact.nb_entity, rel=3 * 1.04 / 64)


def test_folders_are_cleared(spark):
    kept = staged(spark.range(3))
    assert kept.count() == 3 and clear(spark) > 0
    with pytest.raises(Exception, match="does not exist|NOT_EXIST"):
        kept.collect()


def test_exact_statistics_of_many_entities(spark):
    many = spark.range(200_000).select(F.concat(F.lit("A:"), F.col("id").cast("string")).alias("subject_id_curie"), F.lit("").alias("object_id_curie"), F.lit("p").alias("mapping_provider"), F.lit(None).cast("string").alias("mapping_set_id"), (F.col("id") % 3).cast("string").alias("mapping_date"))
    days = staged(sketches.sets(many))
    assert tuple(sketches.exact_stats(days).first()) == (200_000, 0, 1, 200_000)
    assert tuple(sketches.exact_stats(days.filter("mapping_date = '1'")).first()) == (66_667, 0, 1, 66_667)


def test_buckets_by_the_number_of_edges(spark, monkeypatch):
    monkeypatch.setattr(reach, "BUCKET_ROWS", 100)
    rows = spark.range(1_000).select(F.col("id").cast("string").alias("uuid"), F.concat(F.lit("A:"), F.col("id").cast("string")).alias("subject_id_curie"), F.lit("B:1").alias("object_id_curie"))
    table = spark.table(reach.write_bucketed_edges(rows))
    assert table.count() == 2_000 and len(table.inputFiles()) > 16


def test_packed_texts_sort_as_they_are(spark):
    rng = random.Random(5)
    texts = {"", "0", "f", "g", "-", "é", "a" * 31, "a" * 32, "a" * 33, "a" * 31 + ":", "A" * 32, "0" * 32, "f" * 32, "f" * 32 + "\n", "ab9:", "ab99g", "ab9", "ab9" + "f" * 29, "ab9" + "f" * 28 + "g", "0" * 31 + "/", "日本", "\n", "a\nb"}
    texts |= {"".join(rng.choices("09af:`/gAé", (5, 5, 5, 5, 1, 1, 1, 1, 1, 1), k=rng.choice((1, 2, 3, 31, 32, 33)))) for _ in range(600)}
    texts |= {"".join(rng.choices("0123456789abcdef", k=32)) for _ in range(200)} | {"".join(rng.choices("9af", k=rng.choice((30, 31, 32, 33)))) for _ in range(200)}
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").withColumn("p", tx.packed(F.col("t"))).select("t", "p", tx.unpacked(F.col("p")).alias("back")).collect()
    assert all(r.back == r.t for r in rows) and [r.p for r in rows if r.t is None] == [None]
    known = [r for r in rows if r.t is not None]
    assert [r.t for r in sorted(known, key=lambda r: bytes(r.p))] == sorted(texts, key=lambda t: t.encode())
    assert {len(r.p) for r in known if re.fullmatch("[0-9a-f]{32}", r.t)} == {17}


def test_views_of_all_entities_move_packed_ids(spark):
    """Ids of 32 hex digits take half their bytes through the shuffle; others keep their order among them."""
    ids = [F.md5(F.col("id").cast("string")), F.concat(F.lit("x-"), F.col("id").cast("string")), F.lit(None).cast("string")]
    rows = spark.range(60).select(F.when(F.col("id") % 3 == 0, ids[1]).when(F.col("id") == 1, ids[2]).otherwise(ids[0]).alias("uuid"), F.lit("E").alias("subject_id_curie"), F.concat(F.lit("O"), F.col("id").cast("string")).alias("object_id_curie"))
    views = entities.entity_views(source.conform(rows), 20)
    plan = views._jdf.queryExecution().executedPlan().toString()
    assert "unhex" in plan[plan.index("Exchange") :]  # below the shuffle
    want = sorted((r.uuid for r in rows.collect()), key=lambda u: (u is not None, u or ""))[:20]
    assert [r.uuid for r in views.filter("entity = 'E'").orderBy("place").collect()] == want
