"""Column names with dots, backticks and spaces in every operator and stage; rows that a step before has repeated in exact dedup; access to shards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mapweave.llm import chat, exact_dedup, knn_quality, mixing, page_text, pieces, pii, quality_rules, simhash, suffix_dedup, token_files, vector_codes
from mapweave.llm.common import named, stage

ODD = ["a.b", "c`d", "e f", "struct.x.y", "text.", "_score", "C0", "c1"]
TEXTS = ["one two three four five six", "One two three four five six", None, "", "x" * 900, "other words of a text that no other row has"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s") + tuple(f"{c}{i}" for c in ODD) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, ["doc_id", "text", "lang", "source"] + ODD)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")


def passed(df, n=None):
    """The odd columns are there with their own values."""
    rows = df.collect()
    assert all(c in df.columns for c in ODD if c != "text.") and (n is None or len(rows) == n)
    at, ids = [df.columns.index(c) for c in ODD], df.columns.index("doc_id")
    assert all(r[i] == f"{c}{r[ids]}" for r in rows for c, i in zip(ODD, at, strict=True))
    return rows


def test_stages_with_odd_names(spark, docs, labels):
    passed(knn_quality.classify(docs, knn_quality.fit(docs, labels)), 6)
    passed(knn_quality.keep_good(docs, labels))
    passed(exact_dedup.drop_copies(docs), 4)
    passed(exact_dedup.dedup(stage(docs)), 6)
    passed(simhash.drop_near_copies(docs), 4)
    passed(mixing.mix(docs), 6)
    passed(mixing.sample(docs))
    passed(pieces.encode_stage(docs), 6)
    assert sorted(r[-1] for r in pieces.decode(pieces.encode(docs.limit(2), pieces.public_pieces()), pieces.public_pieces(), "_ids").collect()) == ["One two three four five six", "one two three four five six"]
    for _, step in corpus_pipeline.STAGES[1:]:
        passed(step(spark, stage(docs), "/root/testdata/sf0.001"))


def test_operators_with_odd_names(docs):
    carry = tuple(ODD) + ("doc_id",)
    passed(quality_rules.apply_rules(docs, carry=carry), 6)
    passed(pii.find_pii(docs, carry=carry), 6)
    passed(simhash.fingerprints(docs), 6)
    by = docs.withColumn("my.id`", named("doc_id"))
    assert sorted(r["my.id`"] for r in simhash.near_groups(by, "my.id`").collect()) == list(range(6))
    assert sorted(r["my.id`"] for r in suffix_dedup.remove_repeats(by, "my.id`").collect()) == list(range(6))
    page = page_text.extract(docs.withColumn("html", F.lit("<p>x</p>")))
    assert all(r["n_chars"] == 1 for r in passed(page, 6))
    assert vector_codes.encode(docs.select("*", F.lit(1).alias("vec_id"), F.lit(1).alias("label"), F.array(F.lit(1.0)).alias("embedding")))[0].count() == 6


def test_conversations_with_odd_names(spark):
    rows = [(1, 0, "user", "a", "z"), (1, 1, "assistant", "b", "z")]
    talk = spark.createDataFrame(rows, ["conv_id", "turn", "role", "text", "a.b`"])
    got = chat.read_chats(chat.format_chats(chat.text_parts(talk))).collect()
    assert {r.conv_id for r in got} == {1}


def test_exact_dedup_of_repeated_rows(spark, docs):
    own = stage(docs.select("doc_id", "text"))
    kept = lambda df: sorted(r["doc_id"] for r in exact_dedup.drop_copies(df).collect())
    want = kept(own)
    assert want == [1, 3, 4, 5]
    assert kept(own.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3))))) == want
    many = own.sample(True, 3.0, seed=4)
    assert kept(many) == kept(stage(many)) and len(kept(many)) == len({(r["text"] or "").lower() for r in many.collect()})
    doubled = spark.createDataFrame([(i, y) for i in range(6) for y in (0, 1)], "doc_id long, y int")
    assert kept(own.join(doubled, "doc_id").drop("y")) == want and kept(own.union(own)) == want
    path = own.inputFiles()[0].rsplit("/", 1)[0]
    assert kept(spark.read.schema(own.schema).parquet(path, path)) == want
    mixed = mixing.sample(stage(docs.select("doc_id", "text", "lang", "source")), share=2.5)
    assert len(kept(mixed)) == len({(r["text"] or "").lower() for r in mixed.collect()})
    assert not exact_dedup.once_each(many) and exact_dedup.once_each(own.filter("doc_id > 1").select("text")) and not exact_dedup.once_each(docs)


def test_shards_expand_what_is_asked_for(spark):
    rng = np.random.default_rng(1)
    counts = np.array([3000, 2, 498, 1])
    ids = np.concatenate([np.tile(rng.integers(0, 50, 100), 30), rng.integers(0, 200, 501)]).astype(np.uint32)
    shard = token_files.Shard(token_files.pack(ids, counts, 300))
    assert len(shard.left) > 0 and (shard.all_ids() == ids).all()
    ends = np.cumsum(counts)
    for d, n in enumerate(counts):
        mine = ids[ends[d] - n : ends[d]]
        for a, b in ((0, None), (0, 1), (17, 230), (n - 1, n), (5, 5), (2999, 9999)):
            assert (shard.ids(d, a, b) == mine[a:b]).all()
