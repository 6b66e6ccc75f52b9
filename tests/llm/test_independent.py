"""The quality classifier against an own SVD and vote; added personal data against patterns and made texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from mapweave.llm import pii
from mapweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
MARKS = ".,!?|*$%&#<>@\"'()-=:;/"


def kind(byte):
    c = chr(byte)
    if byte >= 128:
        return "other letter"
    if c in MARKS:
        return c
    return "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "9" if c.isdigit() and byte < 128 else "\n" if c == "\n" else " " if c in " \t\x0b\x0c\r" else "?else"


def bag(text):
    """Damped counts of the triples of kinds, and the shares of different words, pairs of words and lines in tenths."""
    data = text.encode()
    kinds = [kind(b) for b in data] + [" "] * max(0, 3 - len(data))
    n = Counter(zip(kinds, kinds[1:], kinds[2:], strict=False))
    out = {k: math.log1p(v * 1000 / (len(kinds) - 2)) for k, v in n.items()}
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    if words:
        pairs = set(zip(words, words[1:], strict=False))
        for i, share in enumerate((len(set(words)) / len(words), len(pairs) / max(len(words) - 1, 1), len(set(lines)) / max(len(lines), 1))):
            out["share", i, min(9, int(10 * share))] = 4.0
    return out


def test_classifier_against_an_own_decomposition(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    quality = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["doc_id"] in texts}
    bags = {i: bag(t) for i, t in texts.items()}
    known = sorted(quality)
    df = Counter(k for i in known for k in bags[i])
    place = {k: n for n, k in enumerate(df)}
    weight = lambda k: math.log((1 + len(known)) / (1 + df.get(k, 0))) + 0.2

    def row(i):
        x = np.zeros(len(place))
        for k, v in bags[i].items():
            if k in place:
                x[place[k]] = v * weight(k)
        return x

    x = np.stack([row(i) for i in known])
    unit = lambda y: y / np.maximum(np.linalg.norm(y, axis=-1, keepdims=True), 1e-9)
    basis = np.linalg.svd(unit(x), full_matrices=False)[2][:48].T
    learnt, labels = unit(x @ basis), np.array([quality[i] for i in known], float)
    got = {r.doc_id: r for r in QUERIES["op5_quality_classifier"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    off, same = [], []
    for i, t in texts.items():
        cosine = learnt @ unit(row(i) @ basis) if t else np.zeros(len(known))
        near = np.argsort(-cosine, kind="stable")[:15]
        votes = np.maximum(cosine[near], 0) ** 8
        score = (votes * labels[near]).sum() / votes.sum() if votes.sum() > 1e-9 else labels.mean()
        off.append(abs(score - got[i].score))
        same.append((score >= 0.5) == got[i].predicted)
    assert np.mean(same) >= 0.99 and np.mean(off) < 0.01


def test_added_secrets_of_the_query(spark):
    """Every token that an own pattern finds in the documents is covered, and no span is added to words without digits."""
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    secret = re.compile(r"(?<![0-9A-Za-z])(?=[0-9a-z]*[a-z])(?=[0-9a-z]*[0-9])[0-9a-z]{24,}(?![0-9A-Za-z])")
    found = wanted = 0
    for r in QUERIES["op8_pii"](spark, SF).collect():
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        for m in secret.finditer(texts[r.doc_id]):
            wanted += 1
            found += any(k == "secret" and a <= m.start() and m.end() <= b for k, a, b in spans)
        assert all(re.search("[0-9]", texts[r.doc_id][a:b]) for k, a, b in spans if k in pii.ADDED)
    assert wanted > 0 and found == wanted


def test_secrets_with_and_without_a_trigger_word(spark):
    rng = np.random.default_rng(12)
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    word = lambda: pick("abdeghilmnorstuw", int(rng.integers(2, 11)))
    rows = []
    for i in range(400):
        text, value = [word() for _ in range(int(rng.integers(3, 12)))], None
        if i % 4 < 2:
            value = [pick("0123456789abcdef", 40), pick("0123456789abcdef", 32), "sk_" + pick("abcdefgh0123456789", 24) + "7q"][i % 3]
            at = int(rng.integers(0, len(text)))
            text[at:at] = [["token", "="], []][i % 4] + [value]
        elif i % 4 == 2:  # numbers, years and short codes, which are none
            text.insert(2, [str(int(rng.integers(1, 3000))), f"{pick('abc', 2)}{pick('0123456789', 3)}", "x" * 20][i % 3])
        rows.append((i, " ".join(text), value))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    said = {r.doc_id: [rows[r.doc_id][1][s.start : s.end] for s in r.spans if s.kind == "secret"] for r in pii.find_pii(docs).collect()}
    recall = [np.mean([v in said[i] for i, _, v in rows if v and i % 4 == k]) for k in (0, 1)]
    wrong = sum(len([x for x in said[i] if x != v]) for i, _, v in rows)
    print("recall with and without a trigger word, wrong spans:", recall, wrong)
    assert recall[0] >= 0.95 and recall[1] >= 0.9 and wrong <= 4
