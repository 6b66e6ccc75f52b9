"""The mix's expected tokens against its target weights."""

from collections import Counter

import numpy as np
import pytest

from mapweave.llm import mixing


def marginals(rows, weight):
    """Shares of the expected tokens by (dim, value), and all expected tokens over all tokens."""
    sums, out = Counter(), {}
    for r in rows:
        for d, k in (("source", r.source), ("lang", r.lang), ("topic", r._mix.topic)):
            sums[d, k] += weight(r) * r._mix.tokens
    total = sum(n for (d, _), n in sums.items() if d == "lang")
    for k, n in sums.items():
        out[k] = n / total
    return out, total / sum(r._mix.tokens for r in rows)


def wanted(rows, flatten=0.7):
    now, _ = marginals(rows, lambda r: 1)
    out = {k: x ** (1 if k[0] == "topic" else flatten) for k, x in now.items()}
    return {k: x / sum(y for j, y in out.items() if j[0] == k[0]) for k, x in out.items()}


def hot(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(600):
        words = " ".join(f"word{x}" for x in rng.integers(0, 999, int(rng.choice([30, 200, 1200], p=[0.5, 0.4, 0.1]))))
        rows.append((i, words, "hot" if rng.random() < 0.7 else f"s{rng.integers(0, 3)}", "en" if rng.random() < 0.8 else str(rng.choice(["de", "es"]))))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


@pytest.mark.parametrize("table", ["hot", "/root/testdata/sf0.01"])
def test_expected_tokens_have_the_target_weights(spark, table):
    docs = hot(spark) if table == "hot" else spark.read.parquet(f"{table}/documents.parquet")
    rows = mixing.mix(docs).collect()
    got, share = marginals(rows, lambda r: r._mix.rate)
    assert share == pytest.approx(0.8, abs=1e-4) and max(r._mix.rate for r in rows) > 1
    assert got == pytest.approx(wanted(rows), abs=1e-4)
    assert all(0 <= r._mix.copies - int(r._mix.rate) <= 1 for r in rows)
    assert sum(r._mix.copies for r in rows) == pytest.approx(sum(r._mix.rate for r in rows), rel=0.05)
    taken = Counter(r.doc_id for r in mixing.sample(docs).collect())
    assert taken == Counter({r.doc_id: r._mix.copies for r in rows if r._mix.copies})


@pytest.mark.parametrize("few", [1_000, 1])
def test_few_values_are_looked_up_without_a_join(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW", few)
    cells = spark.createDataFrame([("a", 1.0), (None, 2.0), ("", 3.0), ("=", 4.0), ("é\"'.`", 5.0), ("none", 6.0)], "source string, w double")
    values = spark.createDataFrame([("a", 0.1), (None, 0.2), ("", 0.3), ("=", 1 / 3), ("é\"'.`", 1e-300)], "k string, f double")
    found = mixing._beside(cells, "source", mixing._kept(values, True), "f", True)
    assert ("Join" in found._jdf.queryExecution().optimizedPlan().toString()) == (few == 1)
    assert {r.source: r.f for r in found.collect()} == {"a": 0.1, None: 0.2, "": 0.3, "=": 1 / 3, "é\"'.`": 1e-300, "none": 0.0}
