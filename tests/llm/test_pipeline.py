"""The pipeline against a brute-force version of its five stages."""

import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from mapweave.llm import knn_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text):
    w = words(lower(text))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def topic(text):
    n, t = len(words(text)), text or ""
    if 10 * t.count("|") > n:
        return "table"
    if 5 * sum(map(t.count, "*$%&")) > n:
        return "marked"
    if n and t.upper() == t:
        return "shouting"
    return "short" if n < 100 else "long" if n >= 1000 else "medium"


def good(model, text):
    if not text:
        return model.prior >= 0.5
    cosine = model.vectors @ model.project(*knn_quality.counts(text))
    best = np.argsort(-cosine, kind="stable")[: model.k]
    weight = np.maximum(cosine[best], 0) ** model.sharpness
    return (weight * model.labels[best]).sum() / weight.sum() >= 0.5 if weight.sum() > 1e-9 else model.prior >= 0.5


def similar(a, b):
    """Whether five-word shingles have a Jaccard similarity of 0.8 or more."""
    of = lambda t: {tuple(w[i : i + 5]) for w in [words(lower(t))] for i in range(max(1, len(w) - 4))}
    x, y = of(a), of(b)
    return 5 * len(x & y) >= 4 * len(x | y)


def cells(docs, flatten=0.7):
    """Raked weights of the cells (source, language, topic) over their tokens, the tokens, and each document's cell."""
    key = [(d.source, d.lang, topic(d.text)) for d in docs]
    names = [sorted({k[i] for k in key}, key=lambda x: (x is not None, x or "")) for i in range(3)]
    have = np.zeros([len(n) for n in names])
    for d, k in zip(docs, key, strict=True):
        have[tuple(n.index(x) for n, x in zip(names, k, strict=True))] += len(words(d.text))
    w = have / have.sum()
    for _ in range(60):
        for i in range(3):
            others = tuple({0, 1, 2} - {i})
            goal = have.sum(axis=others) ** (1.0 if i == 2 else flatten)
            now = w.sum(axis=others)
            w = w * np.divide(goal / goal.sum(), now, out=np.zeros_like(now), where=now > 0).reshape([-1 if j == i else 1 for j in range(3)])
    at = [tuple(n.index(x) for n, x in zip(names, k, strict=True)) for k in key]
    return np.divide(w, have, out=np.zeros_like(w), where=have > 0), have, at


def rates(docs, share=0.8):
    """How often each document is expected: its cell's weight over its tokens, for share of all tokens."""
    ratio, have, at = cells(docs)
    return {d.doc_id: ratio[c] * share * have.sum() if have[c] else 1.0 for d, c in zip(docs, at, strict=True)}


def chances(docs, share=0.8, flatten=0.7):
    """The probability of each document, once at most: raked cells over present ones, by dense arrays."""
    ratio, have, at = cells(docs, flatten)
    low, high = 0.0, 1 / ratio[ratio > 0].min()
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if (np.minimum(1, ratio * mid) * have).sum() >= share * have.sum() else (mid, high)
    p = np.where(have > 0, np.minimum(1, ratio * high), 1.0)
    return {d.doc_id: p[c] for d, c in zip(docs, at, strict=True)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abdeilmnorstu"), rng.integers(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(w.capitalize() + "." if rng.random() < 0.08 else w for w in rng.choice(vocabulary, n))
    junk = lambda n: " ".join(rng.choice(["$$$", "##", "BUY", "%%", "NOW!!!", "<<>>", "&*"], n))
    texts = [prose(int(rng.integers(60, 400))) for _ in range(70)] + [junk(int(rng.integers(20, 90))) for _ in range(30)]
    texts += [texts[i].upper().lower() for i in range(3)] + [texts[0], texts[0].lower(), texts[7], texts[7]]
    for i in (10, 11, 12):  # one word of many differs
        w = texts[i].split(" ")
        texts.append(" ".join([*w[:20], "changed", *w[21:]]))
    texts += [None, "", "Zoë – 日本 🙂 " + prose(80)]
    rows = [(i, t, ("en", "de", None)[i % 3], "hot" if i % 2 else ("a", "b", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    marks = [(i, int(i < 70), 0) for i in range(100)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    model = knn_quality.fit(table, spark.read.parquet(f"{folder}/labels.parquet"))
    docs = [d for d in table.orderBy("doc_id").collect() if good(model, d.text)]
    assert 60 < len(docs) < 90

    last = {lower(d.text): d.doc_id for d in docs}
    docs = [d for d in docs if last[lower(d.text)] == d.doc_id]

    before, root = len(docs), [d.doc_id for d in docs]
    while True:
        new = [min(r for r, e in zip(root, docs, strict=True) if similar(d.text, e.text)) for d in docs]
        if new == root:
            break
        root = new
    docs = [d for d, r in zip(docs, root, strict=True) if d.doc_id == r]
    assert len(docs) <= before - 3

    rate = rates(docs)
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    chance = {r.doc_id: r.x for r in table.select("doc_id", drawn.alias("x")).collect()}
    copies = {d.doc_id: int(rate[d.doc_id]) + (chance[d.doc_id] < rate[d.doc_id] % 1) for d in docs}
    assert {0, 1} <= set(copies.values())

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = [(d.doc_id, d.lang, d.source, d.n_chars, lib.encode(d.text or "")) for d in docs for _ in range(copies[d.doc_id])]
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.lang, r.source, r.n_chars, r.ids) for r in got) == sorted(want, key=lambda w: w[0])
    assert all(r.n_pieces == len(r.ids) for r in got)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, folder).schema.simpleString() == docs.schema.simpleString()


def test_stages_with_repeated_ids_and_clashing_names(spark, folder):
    """Repeated rows, ids of several texts, null ids and columns with the names that stages use inside."""
    names = "_at _best _copy _d _decoded_same _dedup _gone _ids _metadata _mix _p _quality _salt _score _size _tokens _topic at best body d digest first id ids m n n_pieces node p quality r rate root row runs size tid tokens topic u v x".split()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    twice = docs.union(docs.filter("doc_id in (5, 20, 21)")).union(docs.filter("doc_id = 30").selectExpr("cast(6 as bigint)", "text", "lang", "source", "n_chars"))
    twice = twice.union(docs.filter("doc_id = 31").selectExpr("cast(null as bigint)", "concat(text, ' and so on')", "lang", "source", "n_chars"))
    wide = twice.select("*", *(F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in names))
    plain = {}
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        few, many = step(spark, twice, folder), step(spark, wide, folder)
        rows = many.collect()
        assert many.columns[: len(names) + (5 if i < 4 else 4)] == [c for c in wide.columns if i < 4 or c != "text"], name
        assert all(r[c] == (None if r.doc_id is None else f"{c}-{r.doc_id}") for r in rows for c in names), name
        key = "text" if i < 4 else "n_chars"
        plain[name] = sorted(((r.doc_id or -1, r[key] or "") for r in rows))
        assert plain[name] == sorted(((r.doc_id or -1, r[key] or "") for r in few.collect())), name
    exact = plain["exact dedup"]
    assert len(exact) == len({lower(t) for _, t in exact}) and [t for i, t in exact if i == 30 or i == 6]
    near = plain["SimHash near-dedup"]
    assert not any(similar(a, b) for k, (_, a) in enumerate(near) for _, b in near[:k])


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
