"""Keyed puts, counts kept up to date, page documents as untyped objects, and the reader of pages."""

import http.server
import json
import threading
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapweave import queries
from mapweave.operators import entities, facets, maintained
from mapweave.schema import MAPPING
from mapweave.sources import documents, folders, paged, store
from mapweave.sources import mappings as source

KEYS = ("mapping_provider", "subject_match_field", "confidence")


def made(spark, rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in MAPPING) for r in rows], MAPPING)


def drawn(n, seed, keys=200):
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    ids = rng.choice(keys, n, replace=False)
    return [dict(uuid=f"k{i}", subject_id_curie=pick(["", None, "A:1", "A:2", "A:3"]), object_id_curie=pick(["B:1", "A:1", "B:2"]), mapping_provider=pick(["p", "q", None]), mapping_set_id=pick(["s1", "s2"]), subject_match_field=pick([None, [], ["x", "x"], ["x", "y"]]), confidence=float(i) / keys) for i in ids]


def content(df):
    return {r.uuid: r for r in df.collect()}


def files(kept):
    return set(kept.read().inputFiles())


def test_puts_and_maintained_counts(spark):
    kept, counts, now = store.create(spark, MAPPING, buckets=4), maintained.begin(spark, KEYS, buckets=4), {}
    for step in range(3):
        rows, gone = drawn(60, step), [f"k{i}" for i in range(step * 13, step * 13 + 40)] + ["nobody", None]
        batch = made(spark, rows)
        deleted = spark.createDataFrame([(k,) for k in gone], "uuid string") if step else None
        counts.apply(kept.put(batch, deleted))
        for k in gone if step else []:
            now.pop(k, None)
        now |= content(batch)
        assert content(kept.read()) == now and kept.read().count() == len(now)
        left = spark.createDataFrame(list(now.values()), MAPPING)
        assert sorted(map(tuple, counts.facet_counts().collect())) == sorted(map(tuple, facets.facet_counts(left, KEYS).collect()))
        assert tuple(counts.stats().first()) == tuple(entities.stats(left).first())
    everything = kept.read().select("uuid")
    counts.apply(kept.put(None, everything))
    assert kept.read().count() == 0 and counts.facet_counts().count() == 0 and tuple(counts.stats().first()) == (0, 0, 0, 0)


def test_only_touched_buckets_are_written(spark):
    kept = store.create(spark, MAPPING, buckets=16)
    rows = drawn(150, 9)
    assert kept.put(made(spark, rows)).count() == 150
    before = files(kept)
    assert kept.put(made(spark, rows)).isEmpty() and files(kept) == before  # the same batch again
    changed = {**rows[3], "comment": "new"}
    signed = kept.put(made(spark, [changed, rows[4], rows[4]]), spark.createDataFrame([(rows[3]["uuid"],), ("nobody",)], "uuid string")).collect()
    assert sorted((r._sign, r.comment) for r in signed) == [(-1, None), (1, "new")]
    after = files(kept)
    bucket = lambda f: f.split("_bucket=")[1].split("/")[0]
    assert len({bucket(f) for f in before ^ after}) == 1 and len(after) == len(before)
    assert content(kept.read())[rows[3]["uuid"]].comment == "new" and kept.read().count() == 150
    assert kept.put(source.conform(spark.createDataFrame([(None, "x")], "uuid string, comment string"))).isEmpty() and kept.put().isEmpty()


def test_repeated_keys_of_a_batch(spark):
    kept = store.create(spark, MAPPING, buckets=4)
    kept.put(made(spark, [dict(uuid="a", subject_id="1"), dict(uuid="a", subject_id="2"), dict(uuid="b")]))
    assert {k: r.subject_id for k, r in content(kept.read()).items()} == {"a": "2", "b": None}


def test_a_failing_batch_leaves_the_old_state(spark):
    kept = store.create(spark, MAPPING, buckets=4)
    kept.put(made(spark, drawn(30, 1)))
    before, was = files(kept), content(kept.read())
    bad = made(spark, drawn(30, 2)).withColumn("comment", F.when(F.col("uuid") > "k5", F.raise_error(F.lit("broken"))).otherwise("x"))
    with pytest.raises(Exception, match="broken"):
        kept.put(bad)
    assert files(kept) == before and content(kept.read()) == was


def test_untyped_documents(spark, tmp_path):
    good = dict(uuid="u1", subject_id_curie="A:1", confidence=1, match_string=["a", None], extra={"x": 1}, comment=None)
    texts = [
        json.dumps({"data": [good, dict(uuid="u2", confidence=0.25, match_string=[])], "pagination": {}, "facets": {}}, indent=1),
        json.dumps({"data": [dict(uuid=5, confidence="high", match_string="a", author_id=[1], comment={"k": [1]}), 7, "text", None, [1]]}),
        json.dumps({"data": []}), json.dumps({"data": {"uuid": "u9"}}), json.dumps({"rows": []}), "[1, 2]", '{"data": [', "", "  ",
    ]
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(t)
    got = documents.decode(documents.read_documents(spark, str(tmp_path)))
    assert got.columns == [*MAPPING.names, "_wrong", "_rejected"]
    rows = got.collect()
    told = {r.uuid: r for r in rows if r.uuid}
    assert told.keys() == {"u1", "u2"} and (told["u1"].confidence, told["u1"].match_string, told["u1"]._wrong, told["u2"].match_string) == (1.0, ["a", None], {}, [])
    (odd,) = [r for r in rows if r._wrong]
    assert odd._wrong == {"uuid": "5", "confidence": '"high"', "match_string": '"a"', "author_id": "[1]", "comment": '{"k":[1]}'} and odd._rejected is None
    assert sorted(r._rejected for r in rows if r._rejected is not None) == sorted(["7", '"text"', "null", "[1]", texts[3], texts[4], texts[5], texts[6]])
    assert documents.decode(spark.createDataFrame([], "value string")).count() == 0


def test_written_documents(spark, tmp_path):
    m = made(spark, drawn(95, 3)).repartition(2)
    documents.write_documents(m, f"{tmp_path}/d", 10)
    texts = documents.read_documents(spark, f"{tmp_path}/d", lines=True)
    assert 10 <= texts.count() <= 12 and all(len(json.loads(r.value)["data"]) <= 10 for r in texts.collect())
    assert content(documents.decode(texts).drop("_wrong", "_rejected")) == content(m)


@pytest.fixture(scope="module")
def pages(tmp_path_factory):
    folder, rows = tmp_path_factory.mktemp("pages"), drawn(90, 4)
    for i in range(6):
        (folder / f"page-{i + 1}.json").write_text(json.dumps({"data": rows[15 * i : 15 * i + 15], "pagination": {"total_pages": 6}}))
    return folder, rows


def test_page_reader(spark, pages):
    folder, rows = pages
    paged.register(spark)
    read = spark.read.format("mapping_pages").option("path", str(folder)).load()
    assert read.columns == MAPPING.names and read.rdd.getNumPartitions() == 6
    assert content(read) == content(made(spark, rows))
    found = read.filter("object_id_curie = 'B:1' and mapping_provider in ('p', 'q') and confidence > 0.5")
    want = {r["uuid"] for r in rows if r["object_id_curie"] == "B:1" and r["mapping_provider"] and r["confidence"] > 0.5}
    assert want and content(found).keys() == want
    assert spark.read.format("mapping_pages").option("path", f"file://{folder}").load().filter("uuid = 'nobody'").count() == 0


def test_conditions_are_seen_in_the_reader(spark):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = paged.PageReader({"path": "x"}, MAPPING)
    rest = [GreaterThan(("confidence",), 0.5), EqualTo(("comment",), "x")]
    assert list(reader.pushFilters([EqualTo(("object_id_curie",), "B:1"), In(("mapping_provider",), ("p", "q")), *rest, In(("object_id_curie",), ("B:1", "B:2"))])) == rest
    assert reader.fields == {"object_id_curie": ["B:1"], "mapping_provider": ["p", "q"]}


def test_bad_pages_raise(spark, tmp_path):
    paged.register(spark)
    read = lambda: spark.read.format("mapping_pages").option("path", str(tmp_path)).load()
    assert read().count() == 0
    (tmp_path / "1.json").write_text('{"data": []}')
    lazy = read()
    (tmp_path / "2.json").write_text('{"rows": []}')
    with pytest.raises(Exception, match="2.json: no page document"):
        read().collect()
    with pytest.raises(Exception, match="no folder that a worker can open"):
        spark.read.format("mapping_pages").option("path", "hdfs://x/y").load().collect()
    assert lazy.columns == MAPPING.names


def test_pages_of_a_service(spark, pages):
    folder, rows = pages
    asked = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            ask = urllib.parse.parse_qs(urllib.parse.urlsplit(self.path).query)
            asked.append(ask)
            if (file := folder / f"page-{ask['page'][0]}.json").exists() and ask.get("fail") != ask["page"]:
                self.send_response(200)
                self.end_headers()
                self.wfile.write(file.read_bytes())
            else:
                self.send_error(503)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/ui/mappings?page={{page}}"
    paged.register(spark)
    try:
        reader = paged.PageReader({"url": url, "query": "true"}, MAPPING)
        reader.fields = {"object_id_curie": ["B:1"]}
        parts = reader.partitions()
        assert len(parts) == 6 and asked[0]["object_id_curie"] == ["B:1"]
        read = spark.read.format("mapping_pages").option("url", url).option("query", "true").load()
        assert content(read.filter("object_id_curie = 'B:1'")).keys() == {r["uuid"] for r in rows if r["object_id_curie"] == "B:1"}
        assert {a["page"][0] for a in asked} == set("123456") and all(a.get("object_id_curie") == ["B:1"] for a in asked)
        with pytest.raises(Exception, match="with status 503"):
            spark.read.format("mapping_pages").option("url", f"{url}&fail=4").load().collect()
    finally:
        server.shutdown()


def test_export_reads_back(spark, tmp_path):
    m = made(spark, [dict(uuid="u1", comment='say "a",\tb\nc ', match_string=["x", None, "y"], confidence=0.5), dict(uuid="u2", comment=" ")])
    for kind in ("csv", "tsv"):
        source.export(m, f"{tmp_path}/{kind}", kind)
        got = content(source.read_export(spark, f"{tmp_path}/{kind}", kind))
        assert (got["u1"].comment, got["u1"].match_string, got["u1"].confidence, got["u2"].comment, got["u2"].match_string) == ('say "a",\tb\nc ', "x, , y", "0.5", " ", None)


def test_puts_do_not_move_whole_rows(spark):
    kept, was = store.create(spark, MAPPING, buckets=4), store.FEW_ROWS
    rows = drawn(150, 9)
    store.FEW_ROWS = 100  # a put of many rows
    try:
        kept.put(made(spark, rows))
        changed = [{**r, "comment": "new"} for r in rows[:20]]
        signed = kept.put(made(spark, changed + rows[20:40]), made(spark, rows[100:]).select("uuid"))
        assert signed.count() == 20 * 2 + 50
        want = {r["uuid"]: r for r in rows[:100]} | {r["uuid"]: r for r in changed}
        assert content(kept.read()) == content(made(spark, list(want.values()))) and kept.read().count() == 100
    finally:
        store.FEW_ROWS = was
    places = kept._places(kept._bucketed(made(spark, rows[:9]).select("uuid")))
    plan = kept._at(kept._stored(), places, False)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(uuid" not in plan.split("BroadcastExchange")[0]


def test_documents_take_rows_as_they_lie(spark, tmp_path):
    m = made(spark, drawn(95, 3)).repartition(2)
    documents.write_documents(m, f"{tmp_path}/d", 10)
    assert "Exchange" not in documents.documents(made(spark, drawn(95, 3)), 10)._jdf.queryExecution().executedPlan().toString()
    assert all(f.name.endswith(".gz") for f in (tmp_path / "d").glob("part-*"))
    documents.write_documents(m, f"{tmp_path}/e", 10, each=True)
    paged.register(spark)
    read = spark.read.format("mapping_pages").option("path", f"{tmp_path}/e").load()
    assert 10 <= read.rdd.getNumPartitions() <= 12 and content(read) == content(m)


def test_many_pages_share_partitions(spark):
    reader = paged.PageReader({"path": "x"}, MAPPING)
    dealt = reader._dealt([str(i) for i in range(4_001)])
    assert len(dealt) <= paged.MOST_PARTITIONS and [a for p in dealt for a in p.addresses] == [str(i) for i in range(4_001)]


def test_large_exports_have_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source, "FILE_ROWS", 10)
    m = made(spark, drawn(95, 3)).coalesce(1)
    source.export(m, f"{tmp_path}/csv")
    assert len(list((tmp_path / "csv").glob("part-*"))) == 10 and source.read_export(spark, f"{tmp_path}/csv").count() == 95


def test_a_file_holds_several_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "FILE_ROWS", 30)
    m = made(spark, drawn(95, 3)).coalesce(1)
    documents.write_documents(m, f"{tmp_path}/d", 10)
    files = list((tmp_path / "d").glob("part-*"))
    assert len(files) == 4 and [len(list(paged.fetch(str(f)))) for f in sorted(files)] == [3, 3, 3, 1]
    paged.register(spark)
    assert content(spark.read.format("mapping_pages").option("path", f"{tmp_path}/d").load()) == content(m)
    (tmp_path / "d" / "odd.json").write_text('\n{"data": [],\n "pagination": {}}\n\n{"data": []} {"rows": []}\n')
    with pytest.raises(Exception, match="odd.json: no page document"):
        spark.read.format("mapping_pages").option("path", f"{tmp_path}/d").load().collect()


def test_decoding_is_compiled(spark, tmp_path):
    got = documents.decode(spark.createDataFrame([('{"data": [{"uuid": "u", "confidence": "x", "comment": null, "match_string": []}, {}, 5]}',)], "value string"))
    assert [(r.uuid, r._wrong, r._rejected) for r in got.collect()] == [("u", {"confidence": '"x"'}, None), (None, {}, None), (None, {}, "5")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and plan.count("variant_get(record") == 1


def test_exports_can_be_gzipped(spark, tmp_path):
    m = made(spark, drawn(95, 3))
    for kind in ("csv", "tsv"):
        source.export(m, f"{tmp_path}/{kind}", kind, compression="gzip")
        assert all(f.name.endswith(".csv.gz") for f in (tmp_path / kind).glob("part-*")) and source.read_export(spark, f"{tmp_path}/{kind}", kind).count() == 95


def test_exported_files_of_the_queries_are_gzipped(spark):
    for kind in ("csv", "tsv"):
        got = queries.QUERIES[f"exported_{kind}"](spark, "/root/testdata/sf0.001")
        assert all(f.endswith(".csv.gz") for f in got.inputFiles()) and got.count() > 0


def test_puts_leave_no_staged_tables(spark):
    kept, counts = store.create(spark, MAPPING, buckets=4), maintained.begin(spark, KEYS, buckets=4)
    rows, made_folders = drawn(150, 9), lambda: set(folders._MADE[spark.sparkContext.applicationId])
    before = made_folders()
    first = kept.put(made(spark, rows + rows[:5]))
    assert {p.rsplit("/", 1)[1].split("-")[0] for p in made_folders() - before} == {"batch", "repeated"} and first.count() == 150  # not the rows again as changes
    counts.apply(first)
    folders.forget(first)
    assert made_folders() == before
    second = kept.put(made(spark, [{**r, "comment": "new"} for r in rows[:20]]), made(spark, rows[100:]).select("uuid"))
    assert {p.rsplit("/", 1)[1].split("-")[0] for p in made_folders() - before} == {"changes"} and second.count() == 20 * 2 + 50
    counts.apply(second)
    folders.forget(second, kept.read())  # the store's own files stay
    assert made_folders() == before and kept.read().count() == 100 and counts.stats().first()[0] == 100
    assert all(".zstd." in f for f in kept.read().inputFiles())


def test_an_empty_partition_is_no_bad_page(spark, tmp_path):
    rows = [tuple(r.get(f.name) for f in MAPPING) for r in drawn(20, 3)]
    m = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).mapPartitionsWithIndex(lambda i, part: part if i else iter(())), MAPPING)
    paged.register(spark)
    for each in (False, True):
        documents.write_documents(m, f"{tmp_path}/{each}", 5, each=each)
        assert any(not documents.read_documents(spark, str(f), lines=True).count() for f in (tmp_path / str(each)).glob("part-00000*"))
        read = spark.read.format("mapping_pages").option("path", f"{tmp_path}/{each}").load()
        assert content(read).keys() == {r[0] for r in rows[10:]}
