from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures_llm import ROWS

from candlewick.llm import mixing


def corpus(spark, sizes=(300, 60, 20, 5), seed=0):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            rows.append((i, "w " * int(rng.integers(1, 30)), None if s == 3 else f"s{s}", "x"))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string, block string"), rows


def weights(tokens, exponent):
    share = np.array(tokens, float) / sum(tokens)
    w = share ** exponent
    return w / w.sum(), share


def entropy(w):
    return -(w * np.log(w)).sum()


def exponent(tokens, target, limit, budget):
    """Bisection in plain numbers."""
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(weights(tokens, mid)[0]) >= target * np.log(len(tokens)) else (low, mid)
    if entropy(weights(tokens, 1.0)[0]) >= target * np.log(len(tokens)):
        low = 1.0
    w, share = weights(tokens, low)
    if limit and (budget * w / share).max() > limit:
        high = 1.0
        for _ in range(60):
            mid = (low + high) / 2
            w, share = weights(tokens, mid)
            low, high = (low, mid) if (budget * w / share).max() <= limit else (mid, high)
        return high
    return low


@pytest.mark.parametrize(("target", "limit", "budget"), [(0.9, None, 1.0), (0.95, 3.0, 1.0), (0.6, 4.0, 2.0), (1.0, 1.5, 1.2), (0.1, 4.0, 1.0)])
def test_budgets_equal_plain_numbers(spark, monkeypatch, target, limit, budget):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    df, rows = corpus(spark)
    tokens = defaultdict(int)
    for _, t, s, _ in rows:
        tokens[s] += 1 + len(t.split())
    names = list(tokens)
    a = exponent([tokens[s] for s in names], target, limit, budget)
    want = dict(zip(names, weights([tokens[s] for s in names], a)[0], strict=True))
    got = mixing.mix(df, target_entropy=target, max_repeats=limit, budget=budget)
    assert got.columns == ["doc_id", "text", "source", "block", "block_order", "weight"]
    out = got.collect()
    size = {i: 1 + len(t.split()) for i, t, _, _ in rows}
    total = sum(tokens.values())
    for s in names:
        own = [r for r in out if r.source == s]
        seen = Counter(r.doc_id for r in own)
        allowed = budget * want[s] * total
        whole = int(allowed / tokens[s] + 1e-5)
        assert all(abs(r.weight - want[s]) < 1e-5 for r in own)
        members = [i for i, _, o, _ in rows if o == s]
        assert all(seen[i] in (whole, whole + 1) for i in members)
        spent = sum(size[i] * n for i, n in seen.items())
        assert spent <= allowed * (1 + 1e-5)
        last = sorted((r for r in own if r.block == whole), key=lambda r: r.block_order)
        left = allowed - whole * tokens[s]
        assert sum(size[r.doc_id] for r in last) <= left + 1e-2
        if len(last) < len(members):  # the next document of the last block's permutation would not fit
            assert left - sum(size[r.doc_id] for r in last) < max(size.values()) + 1e-2
        for b in range(whole):
            block = [r for r in own if r.block == b]
            assert sorted(r.doc_id for r in block) == sorted(members)
            assert len({r.block_order for r in block}) == len(members)
    orders = [tuple(r.doc_id for r in sorted(out, key=lambda r: r.block_order) if r.source == "s2" and r.block == b) for b in (0, 1)]
    assert orders[0] != orders[1] or not orders[1]


def test_awkward_rows(docs, no_docs):
    out = mixing.mix(docs, target_entropy=None, max_repeats=None, budget=2.0)
    assert Counter(r.doc_id for r in out.collect()) == Counter([i for i, _ in ROWS] * 2)
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mix(docs).count() > 0
