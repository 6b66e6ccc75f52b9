"""A sweep of the grammar ranks the pairs that are frequent enough, not all slots of its table."""

import numpy as np

from mapweave.llm import token_files


def test_sweeps_rank_frequent_pairs_only(monkeypatch):
    rng = np.random.default_rng(8)
    counts = rng.integers(1, 200, 300)
    ids = np.minimum(rng.zipf(1.3, counts.sum()), 5000).astype(np.int64)
    ranked, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda x, k: ranked.append(len(x)) or partition(x, k))
    left, right, x, symbols = token_files.repair(ids, counts, 5001, 400, pairs_a_sweep=50)
    assert ranked and max(ranked) <= len(ids) // 8 and 200 < len(left) <= 400
    names = {5001 + i: pair for i, pair in enumerate(zip(left.tolist(), right.tolist(), strict=True))}
    expand = lambda s: [s] if s < 5001 else [i for part in names[s] for i in expand(part)]
    docs = [sum((expand(s) for s in part.tolist()), []) for part in np.split(x, np.cumsum(symbols)[:-1])]
    assert docs == [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]
