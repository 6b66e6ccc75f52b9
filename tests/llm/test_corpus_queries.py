"""The registered queries of the corpus operators on the smallest tables, against brute force, SQL or held-out labels."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F
from test_pipeline import chances, fingerprint, topic, words

from mapweave.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in sorted(rows, key=lambda r: r["doc_id"])}


def result(spark, name, sf=SF):
    rows = QUERIES[name](spark, sf).collect()
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_op1(spark, texts):
    got = result(spark, "op1_quality_rules")
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        w = words(t)
        places: dict[tuple, list[int]] = {}
        for j in range(len(w) - 2):
            places.setdefault(tuple(w[j : j + 3]), []).append(j)
        repeat = {j + d for at in places.values() if len(at) > 1 for j in at for d in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        assert got[i][1:6] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat))
        assert got[i].base_failed == (len(w) < 50 or 100 * len(repeat) > 50 * len(w))
        assert not (got[i].base_failed and got[i].kept)


def test_op2(spark, texts):
    got, lib = result(spark, "op2_sentence_pieces"), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = spark.createDataFrame([(i, lib.encode(t)) for i, t in texts.items()], "doc_id long, ids array<int>")
    want = {r.doc_id: (r.n, r.h) for r in ids.select("doc_id", F.size("ids").alias("n"), F.xxhash64("ids").alias("h")).collect()}
    assert {i: (r.n_pieces, r.ids_hash) for i, r in got.items()} == want and all(r.decoded_same for r in got.values())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(want.project(", ".join(cols)).fetchall())


def test_op4(spark, texts):
    got, lib, at = result(spark, "op4_token_files"), tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op5(spark):
    sf = "/root/testdata/sf0.01"
    got = result(spark, "op5_quality_classifier", sf)
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    right = [got[i].predicted == y for i, y in labels.items() if i in got and got[i].held_out]
    assert len(right) > 50 and np.mean(right) >= 0.9


def test_op6(spark, texts):
    got, data = result(spark, "op6_suffix_dedup"), {i: t.encode() for i, t in texts.items()}
    starts = {i: [hash(b[a : a + 400]) for a in range(len(b) - 399)] for i, b in data.items()}
    number: dict[int, int] = {}
    for hashes in starts.values():
        for h in hashes:
            number[h] = number.get(h, 0) + 1
    for i, b in data.items():
        gone = np.zeros(len(b) + 1, bool)
        for a, h in enumerate(starts[i]):
            if number[h] > 1:
                gone[a : a + 400] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), len(b) - len(kept), spans, sha(kept))


def test_op7(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got, p = result(spark, "op7_source_mixing"), chances(docs)
    for d in docs:
        r = got[d.doc_id]
        assert (r.source, r.lang, r.topic, r.tokens) == (d.source, d.lang, topic(d.text), len(words(d.text)))
        assert r.p == pytest.approx(p[d.doc_id], abs=1e-4) and (r.kept or r.p < 1)


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_op8(spark, texts):
    got = result(spark, "op8_pii")
    assert got.keys() == texts.keys()
    digits = lambda x: re.sub("[^0-9]", "", x)
    base = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(y) <= 255 for y in x.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(digits(x)) <= 19 and luhn(digits(x))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    }
    for i, t in texts.items():
        found = [(m.start(), n, f"{k}:{m.start()}:{m.end()}", k) for n, (k, (pattern, good)) in enumerate(base.items()) for m in re.finditer(pattern, t) if good(m[0])]
        said = [f[2] for f in sorted(found)]
        assert got[i].base_sha256 == sha(",".join(said))
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(f[3] == k for f in found) for k in base)
        assert set(said) <= set(got[i].spans.split(","))


def test_op10(spark, texts):
    got, fp = result(spark, "op10_simhash_near_dedup"), {i: fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    while True:
        new = {i: min(root[j] for j in texts if (fp[i] ^ fp[j]).bit_count() <= 4) for i in texts}
        if new == root:
            break
        root = new
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fp[i]:016x}", root[i]) for i in texts}
