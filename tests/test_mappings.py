"""Sources, sinks, predicates, paging and facets on a few mappings with nulls, blanks and repeated rows."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from mapweave.functions import text as tx
from mapweave.operators import entities, facets, justifications, paging
from mapweave.operators.predicates import confidence_between, filter_entities, other_justification, triple_match
from mapweave.plans.search import EntitySearch, TripleSearch, mapping_by_id, require
from mapweave.schema import MAPPING, MAPPING_SET
from mapweave.sources import mappings as source

ROWS = [
    dict(uuid="u1", subject_id="http://a#1", subject_id_curie="A:1", predicate_id_curie="r:x", object_id_curie="B:1", confidence=0.5, mapping_provider="p", subject_match_field=["l", "l", "s"], mapping_justification="j/1"),
    dict(uuid="u2", subject_id_curie="A:1", predicate_id_curie="r:x", object_id_curie="B:1", confidence=None, mapping_provider="q", mapping_justification="j/2"),
    dict(uuid="u3", subject_id_curie="B:1", predicate_id_curie="r:y", object_id_curie="C:1", confidence=0.0, mapping_provider=None, mapping_justification=None),
    dict(uuid="u4", subject_id_curie="", subject_id="http://a#4", predicate_id_curie="r:x", object_id_curie="C:1", confidence=1.0, mapping_provider="p", match_string=["a,b", None]),
    dict(uuid="u5", subject_id_curie="C:1", predicate_id_curie="r:z", object_id_curie="D:1", confidence=0.25, mapping_provider="p"),
]


@pytest.fixture(scope="module")
def m(spark):
    return spark.createDataFrame([tuple(r.get(f.name) for f in MAPPING) for r in ROWS], MAPPING)


def uuids(df):
    return sorted(r.uuid for r in df.collect())


def test_parquet_and_json(spark, m, tmp_path):
    source.write_mappings(m, f"{tmp_path}/p")
    want = sorted(map(str, m.collect()))
    assert sorted(map(str, source.read_mappings(spark, f"{tmp_path}/p").collect())) == want
    m.write.json(f"{tmp_path}/j")
    assert sorted(map(str, source.read_mappings(spark, f"{tmp_path}/j", "json").collect())) == want
    m.select("uuid", "confidence").withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/few")
    few = source.read_mappings(spark, f"{tmp_path}/few")
    assert few.columns == MAPPING.names and few.filter("subject_id is not null").isEmpty()


def test_page_documents(spark, tmp_path):
    pages = [{"data": ROWS[:2], "pagination": {"total_items": 3}, "facets": {}}, {"data": []}, {"data": ROWS[2:3]}]
    for i, p in enumerate(pages):
        (tmp_path / f"{i}.json").write_text(json.dumps(p, indent=1))
    assert uuids(source.decode_page(spark, str(tmp_path))) == ["u1", "u2", "u3"]


def test_mapping_sets(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"uuid": "s", "creator_id": ["c"], "mappings": {"href": "h"}}))
    got = source.read_mapping_sets(spark, str(tmp_path))
    assert got.schema.names == MAPPING_SET.names and got.first().mappings.href == "h"


@pytest.mark.parametrize(("kind", "sep"), [("csv", ","), ("tsv", "\t")])
def test_export(spark, m, tmp_path, kind, sep):
    source.export(m, f"{tmp_path}/e", kind)
    got = {r.uuid: r for r in spark.read.option("header", True).option("sep", sep).csv(f"{tmp_path}/e").collect()}
    assert got.keys() == {r["uuid"] for r in ROWS} and got["u1"].subject_match_field == "l, l, s"
    with pytest.raises(KeyError):
        source.export(m, f"{tmp_path}/f", "xls")


def test_edge_layout(spark, m, tmp_path):
    source.write_edges(m, f"{tmp_path}/g")
    got = spark.read.parquet(f"{tmp_path}/g").collect()
    assert sorted((r.entity, r.side, r.uuid) for r in got) == sorted((r[f"{s}_id_curie"], s, r["uuid"]) for r in ROWS for s in ("subject", "object") if r[f"{s}_id_curie"])


def test_predicates(m):
    assert uuids(m.filter(confidence_between())) == ["u1", "u2", "u3", "u4", "u5"]
    assert uuids(m.filter(confidence_between(0.0, 0.5))) == ["u1", "u3", "u5"]
    with pytest.raises(ValueError):
        confidence_between(0.6, 0.5)
    assert uuids(m.filter(triple_match("http://a#1"))) == ["u1"] and len(uuids(m.filter(triple_match("", None)))) == 5
    assert uuids(m.filter(other_justification("j/1"))) == ["u2", "u3", "u4", "u5"] and uuids(m.filter(other_justification(None))) == ["u1", "u2"]
    ids = ["B:1", "", "C:1", "B:1"]
    want = ["u1", "u2", "u3", "u4", "u5"]
    assert uuids(filter_entities(m, ids)) == uuids(filter_entities(m, m.sparkSession.createDataFrame([(i,) for i in ids], "x string"))) == want
    assert uuids(filter_entities(m, [f"Z:{i}" for i in range(1500)] + ["D:1"])) == ["u5"]


def test_pages(m):
    assert [r.uuid for r in paging.page(m, 2, 2).collect()] == ["u3", "u4"] and paging.page(m, 2, 9).isEmpty()
    assert [r.uuid for r in paging.page_after(m, "u2", 2).collect()] == ["u3", "u4"] and paging.page_after(m, None, 1).first().uuid == "u1"
    assert tuple(paging.summary(m, 2, 2).first()) == ("?limit=2&page=3", "?limit=2&page=1", 2, 5, 3, 2)
    for bad in (lambda: paging.page(m, 0, 1), lambda: paging.page(m, 10, 0), lambda: paging.ui_page(m, 7, 0)):
        with pytest.raises(ValueError):
            bad()
    got = m.sparkSession.createDataFrame([(2, 90, 7), (1, 9, 9), (1, 20, 20), (1, 80, 80)], "p int, n int, s int").select(paging.initial_size(F.col("p"), F.col("n"), F.col("s")))
    assert [r[0] for r in got.collect()] == [7, 10, 25, 100]


def test_facets(m):
    keys = ("mapping_provider", "subject_match_field", "confidence")
    got = {(r.facet, r.value): r["count"] for r in facets.facet_counts(m, keys).collect()}
    assert got == {("mapping_provider", "p"): 3, ("mapping_provider", "q"): 1, ("subject_match_field", "l"): 1, ("subject_match_field", "s"): 1}
    own = {(r.facet, r.value): r["count"] for r in facets.counts_without_own(m, {"mapping_provider": ["q"], "predicate_id_curie": ["r:x"]}, ("mapping_provider", "predicate_id_curie")).collect()}
    assert own == {("mapping_provider", "p"): 2, ("mapping_provider", "q"): 1, ("predicate_id_curie", "r:x"): 1}
    assert json.loads(facets.as_map(facets.facet_counts(m, keys)).first().facets["mapping_provider"]) == {"p": 3, "q": 1}


def test_facet_selection():
    on = facets.toggle({}, "k", "a")
    assert on == {"k": ["a"]} and facets.toggle(on, "k", "a") == {} and facets.toggle(on, "k", "b") == on
    assert facets.toggle({"k": ["a", "b"], "z": ["y"]}, "k", "a") == {"k": ["b"], "z": ["y"]}


def test_searches(m):
    found = EntitySearch(["C:1"], {"mapping_provider": ["p"]}, limit=1).run(m)
    assert uuids(found.data) == ["u4"] and found.pagination.first().total_items == 2
    assert uuids(EntitySearch(["C:1"], {"mapping_provider": []}).rows(m)) == [] and len(uuids(EntitySearch(["C:1"], {"mapping_provider": None}).rows(m))) == 3
    assert uuids(TripleSearch("A:1", "r:x", "B:1").run(m).data) == ["u1", "u2"]
    assert mapping_by_id(m, "u3").count() == 1
    with pytest.raises(LookupError):
        require(mapping_by_id(m, "u9"))


def test_justifications(m):
    assert uuids(justifications.others_of(m, "u1")) == ["u2"]
    assert {tuple(r) for r in justifications.pairs(m, m).collect()} == {("u1", "u2"), ("u2", "u1")}
    drawn = {r.uuid: r for r in justifications.drawer(m).collect()}
    assert (drawn["u3"].confidence, drawn["u3"].uri, drawn["u1"].confidence, drawn["u4"].subject_id) == ("", "", "0.5", "http://a#4")
    assert justifications.of_triple(m, "A:1", "r:x", "B:1", "j/2").first().subject_matches == "l, l, s"


def test_neighbourhood(m):
    near = lambda e, n: {r.entity: r.distance for r in entities.neighbourhood(m, e, n).collect()}
    assert near("A:1", 1) == {"A:1": 0, "B:1": 1} and near("A:1", 3) == {"A:1": 0, "B:1": 1, "C:1": 2, "D:1": 3}
    assert near("C:1", 2) == {"C:1": 0, "B:1": 1, "D:1": 1, "A:1": 2} and near("Z:1", 3) == {} and near("", 2) == {}
    with pytest.raises(ValueError):
        entities.neighbourhood(m, "A:1", 4)
    assert [(r.uuid, r.is_subject, r.is_object) for r in entities.entity_view(m, "B:1").collect()] == [("u3", True, False), ("u1", False, True), ("u2", False, True)]
    assert tuple(entities.stats(m).first()) == (5, 0, 2, 4)


@pytest.mark.parametrize(("kind", "sep"), [("csv", ","), ("tsv", "\t")])
def test_export_of_quotes_separators_and_line_ends(spark, tmp_path, kind, sep):
    odd = ['say "a"', "a,b\tc", "line\nend", '"', "", "a\\", None, "plain"]
    rows = [tuple({"uuid": f"u{i}", "comment": t, "match_string": [t, 'x"y', None]}.get(f.name) for f in MAPPING) for i, t in enumerate(odd)]
    source.export(spark.createDataFrame(rows, MAPPING).coalesce(1), f"{tmp_path}/e", kind)
    (file,) = (tmp_path / "e").glob("*.csv")
    with open(file, newline="", encoding="utf-8") as f:
        got = {r["uuid"]: (r["comment"], r["match_string"]) for r in csv.DictReader(f, delimiter=sep)}
    assert got == {f"u{i}": (t or "", f'{t or ""}, x"y, ') for i, t in enumerate(odd)}


def test_filters_reach_stored_mappings(spark, m, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    stored = source.stored(m, f"{tmp_path}/m")
    found = EntitySearch(["B:1"], {"mapping_provider": ["p"]}, (0.2, 0.9)).rows(stored)
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert all(x in pushed for x in ("EqualTo(subject_id_curie,B:1)", "EqualTo(object_id_curie,B:1)", "EqualTo(mapping_provider,p)", "GreaterThanOrEqual(confidence,0.2)"))
    assert uuids(found) == ["u1"]
    plan = entities.beyond(spark.createDataFrame([("B:1",)], "entity string"), stored, None)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(subject_id_curie,B:1)" in plan[plan.index("PushedFilters") :]


def test_neighbourhood_of_stored_edges(spark, m, tmp_path):
    source.write_edges(m, f"{tmp_path}/g")
    links = spark.read.parquet(f"{tmp_path}/g")
    for start in ("A:1", "C:1", "Z:1"):
        for hops in (1, 2, 3):
            assert sorted(entities.neighbourhood(None, start, hops, links).collect()) == sorted(entities.neighbourhood(m, start, hops).collect())


def test_orders(m):
    both = m.union(entities.inverted(m))
    got = [(r.uuid, r.is_subject) for r in entities.entity_view(both, "B:1").collect()]
    assert got == [("u1", True), ("u2", True), ("u3", True), ("u1", False), ("u2", False), ("u3", False)]
    counts = m.sparkSession.createDataFrame([("b", "x", 1), ("A", "y", 2), ("A", "z", 5), ("a", "q", 9), ("A", "w", 2)], "facet string, value string, count long")
    assert [(r.facet, r.value) for r in facets.ordered(counts).collect()] == [("A", "z"), ("A", "w"), ("A", "y"), ("a", "q"), ("b", "x")]


def test_approximate_statistics(spark):
    ids = spark.range(5000).select(*(F.concat(F.lit(f"{c}:"), F.col("id").cast("string")).alias(f"{c}") for c in ("s", "o")), "id")
    many = source.conform(ids.select(F.col("s").alias("subject_id_curie"), F.col("o").alias("object_id_curie"), F.col("id").cast("string").alias("uuid"), F.lit("p").alias("mapping_provider")))
    exact, near = entities.stats(many).first(), entities.stats(many, approximate=True).first()
    assert exact.nb_entity == 10_000 and near.nb_mapping == 5000 and near.nb_entity == pytest.approx(10_000, rel=0.15)


def test_numbers_as_text(spark):
    want = {1.0: "1", 0.5: "0.5", 0.02: "0.02", 0.1 + 0.2: "0.30000000000000004", 1e-6: "0.000001", 1.5e-7: "1.5e-7", 1e-7: "1e-7", 100.0: "100", 1e7: "10000000", 123456789.25: "123456789.25", 1e20: "100000000000000000000", 1e21: "1e+21", -0.25: "-0.25", 0.0: "0", 0.00012345: "0.00012345"}
    got = spark.createDataFrame([(x,) for x in want], "x double").select("x", tx.number_text(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in got} == want
    one = spark.createDataFrame([("", "", ["a"], []), (None, "abc", None, None)], "a string, b string, c array<string>, d array<string>")
    got = one.select(tx.asked(F.col("a")), tx.split_ids(F.col("a")), tx.to_number(F.col("b")), tx.not_empty(F.col("c")), tx.not_empty(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(False, [""], 0.0, True, False), (False, [], 0.0, False, False)]


def test_drawer_requests(m):
    texts = {r.uuid: r.query for r in justifications.requests(m).collect()}
    assert texts["u1"].startswith("subject_id=A%3A1&predicate_id=r%3Ax&object_id=B%3A1&justif_uri=j%2F1&justif_confidence=0.5&justif_provider=p&justif_subject_matches=l%2C+l%2C+s&")
    back = {r.uuid: r for r in justifications.read_requests(justifications.requests(m)).collect()}
    assert (back["u1"].confidence, back["u2"].confidence, back["u4"].match_strings, back["u4"].subject_id) == (0.5, 0.0, "a,b, ", "http://a#4")
    assert [r.uuid for r in justifications.of_drawer(m, "A:1", "r:x", "B:1", 1, 2).collect()] == ["u2"]
    assert uuids(justifications.others_of(m, "u1", 1)) == []


def test_toggled_columns(m):
    rows = [([], "a"), (None, "a"), (["a"], "a"), (["a", "b"], "a"), (["b"], "a"), ([""], "")]
    got = m.sparkSession.createDataFrame(rows, "s array<string>, v string").select(facets.checked(F.col("s"), F.col("v")).alias("c"), facets.toggled(F.col("s"), F.col("v")).alias("t")).collect()
    assert [(r.c, r.t) for r in got] == [(False, []), (False, ["a"]), (True, None), (True, ["b"]), (False, ["b"]), (False, [""])]
    for s, v in rows:
        if s != [""]:
            want = facets.toggle({} if s is None else {"k": s}, "k", v).get("k")
            assert got[rows.index((s, v))].t == want


def test_triples_by_curie_or_iri(spark):
    def row(uuid, subject, curie, why):
        return dict(uuid=uuid, subject_id=subject, subject_id_curie=curie, predicate_id_curie="r:x", object_id="http://b#1", object_id_curie="B:1", mapping_justification=why)

    rows = [row("a", "http://a#1", "", "j1"), row("b", "http://a#2", "", "j2"), row("c", "http://a#1", "", "j2"), row("d", "http://a#2", None, "j2"), row("e", None, "", "j1"), row("f", None, None, "j2"), row("g", "http://a#1", "A:1", None), row("h", "x", "A:1", "j1")]
    m = spark.createDataFrame([tuple(r.get(f.name) for f in MAPPING) for r in rows], MAPPING)
    assert {tuple(r) for r in justifications.pairs(m, m).collect()} == {("a", "c"), ("c", "a"), ("g", "h"), ("h", "g")}
    assert {tuple(r) for r in justifications.links(m).collect()} == {("a", "a", 1), ("c", "a", 1), ("b", "b", 0), ("d", "b", 0), ("e", "e", 0), ("f", "f", 0), ("g", "g", 1), ("h", "g", 1)}
    assert {(r.subject, r.n, r.n_justifications) for r in justifications.by_triple(m).collect()} == {("http://a#1", 2, 2), ("http://a#2", 2, 1), (None, 2, 2), ("A:1", 2, 1)}
    assert {(r.subject, r.shown) for r in justifications.section_flags(m).filter("shown").collect()} == {("http://a#1", True), ("http://a#2", True), (None, True), ("A:1", True)}
    # a part without a CURIE is no condition of the detail's request
    assert uuids(justifications.others_of(m, "a")) == ["b", "c", "d", "f", "g"] and uuids(justifications.others_of(m, "f")) == ["a", "e", "g", "h"]
    assert uuids(justifications.others_of(m, "g")) == ["h"] and uuids(justifications.others_of(m, "nobody")) == []
    assert uuids(justifications.others_of(m, "a", 2)) == ["b"]


def test_drawer_page(m):
    rows = [dict(uuid=f"v{i}", subject_id_curie="A:1", predicate_id_curie="r:x", object_id_curie="B:1", mapping_justification=j) for i, j in enumerate(["j/1", None, "j/1", "", "j/2"])]
    m = m.sparkSession.createDataFrame([tuple(r.get(f.name) for f in MAPPING) for r in rows], MAPPING)
    ask = {"subject_id": "A:1", "predicate_id": "r:x", "object_id": "B:1", "justif_uri": "j/1"}
    assert uuids(justifications.drawer_page(m, ask, 3)) == ["v1"] and uuids(justifications.drawer_page(m, ask, 3, 2)) == ["v3", "v4"] and uuids(justifications.drawer_page(m, ask, 3, 3)) == []
    assert uuids(justifications.drawer_page(m, {**ask, "justif_uri": ""})) == ["v0", "v1", "v2", "v4"]
    assert uuids(justifications.drawer_page(m, {"subject_id": "", "object_id": None, "predicate_id": "r:x"})) == ["v0", "v1", "v2", "v4"]


def test_lenient_decoding(spark):
    cases = {"a=1&a=2": "1", "a=%zz": "%zz", "a=1%": "1%", "a=x+y%20z%2B": "x y z+", "b=1": None, "a": "", "a=": "", "?a=q": "q", "": None, "a=b=c": "b=c", "%61=1": "1", "=1": None, "a=%E9%41": "�A", "&&a=1&": "1", None: None}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", tx.from_query(F.col("t"), "a").alias("v")).collect()
    assert {r.t: r.v for r in got} == cases


def test_trimming(spark):
    cases = {"\u0085x\u0085": "\u0085x\u0085", " \u0085 ": "\u0085", "﻿ 　x  ": "x", "x \u0085": "x \u0085", "\x1cx\x1c": "\x1cx\x1c", "a\nb\n": "a\nb", "​x": "​x"}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", tx.trim_all(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in got} == cases


def test_stored_folders_are_new_each_time(spark, m):
    first, second = source.stored(m), source.stored(m.filter("uuid > 'u2'"))
    assert uuids(first) == ["u1", "u2", "u3", "u4", "u5"] and uuids(second) == ["u3", "u4", "u5"]
    before = entities.neighbourhood(first, "A:1", 2)
    assert entities.neighbourhood(first, "C:1", 2).count() == 4 and before.count() == 3
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        source.stored(m, first.inputFiles()[0].rsplit("/", 1)[0])


@pytest.mark.parametrize(("few", "most"), [(1000, 10), (0, 10), (0, 0)])
def test_frontiers_of_any_size(spark, m, tmp_path, few, most):
    source.write_edges(m, f"{tmp_path}/g")
    links = spark.read.parquet(f"{tmp_path}/g")
    for args in ((m, "A:1", 3), (None, "A:1", 3, links)):
        got = entities.neighbourhood(*args, few=few, most=most).collect()
        assert sorted(map(tuple, got)) == [("A:1", 0), ("B:1", 1), ("C:1", 2), ("D:1", 3)]


def test_small_frontiers_move_no_edges(spark, m):
    stored = source.stored(m)
    frontier = spark.createDataFrame([("B:1",), ("C:1",)], "entity string")
    for few, join in ((1000, None), (0, "BroadcastHashJoin")):
        plan = entities.beyond(frontier, stored, None, few, 10)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and (join or "Scan parquet") in plan
    plan = entities.beyond(frontier, stored, None)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "In(subject_id_curie, [B:1,C:1])" in plan[plan.index("PushedFilters") :]


def test_pager_of_each_place(spark):
    want = {(0, 1): "Previous 1 Next", (0, 3): "Previous 1 2 3 Next", (0, 4): "Previous 1 2 ... 4 Next", (1, 3): "Previous 1 2 3 Next", (2, 4): "Previous 1 2 3 4 Next", (9, 10): "Previous 1 ... 9 10 Next", (4, 10): "Previous 1 ... 4 5 6 ... 10 Next"}
    got = paging.page_links(spark.createDataFrame([(p, n) for p, n in want], "p long, n long")).collect()
    assert {(r.p, r.n): " ".join(r.links) for r in got} == want
    assert all(r.previous_disabled == (r.p == 0) and r.next_disabled == (r.p == r.n - 1) for r in got)


def test_fields_of_requests_are_found_by_place(spark):
    texts = ["?a=1&b=x%20y+z&a=2", "b&a=", "a&a=1", "a=1&a", "%61=3&a=1", "ab=1&ba=2", "&&=x&a==&", "?", None, "a=%zz+100%", "b=%41&a=?a=5"]
    fields = [F.struct(*(tx.from_query(F.col("t"), k).alias(n) for k, n in (("a", "a"), ("b", "b"), ("", "none"))))]
    got = [tuple(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(*fields).collect()]
    nothing = (None, None, None)
    assert got == [("1", "x y z", None), ("", "", None), ("", None, None), ("1", None, None), ("3", None, None), nothing, ("=", None, "x"), nothing, nothing, ("%zz 100%", None, None), ("?a=5", "A", None)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    every = tx.from_queries(rows, F.col("t"), ["a", "b", ""], [])
    assert [tuple(r) for r in every.collect()] == got
    plan = every._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("instr(_body") == 4  # each place of a and b is searched for once


def test_all_pairs_shuffle_the_table_once(spark):
    m = spark.createDataFrame([(f"u{i}", f"A:{i % 3}", "r:1", "B:1", f"j{i % 2}") for i in range(12)], "uuid string, subject_id_curie string, predicate_id_curie string, object_id_curie string, mapping_justification string")
    m = source.conform(m)
    pairs = justifications.pairs(m, m)
    assert {tuple(r) for r in pairs.collect()} == {(f"u{i}", f"u{j}") for i in range(12) for j in range(12) if i % 3 == j % 3 and i % 2 != j % 2}
    assert pairs.columns == ["uuid", "other_uuid"] and pairs.count() == sum(r.n_others for r in justifications.links(m).collect())
