import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from fixtures_llm import ROWS

from candlewick.llm import simhash


def brute_fingerprint(text, k=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    grams = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    ones = [sum(xxhash.xxh64_intdigest(g, seed=42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def roots(values, bits=3):
    """Least index of each value's component, all pairs compared."""
    root = list(range(len(values)))
    for _ in values:
        for i, x in enumerate(values):
            for j in range(i):
                if (x ^ values[j]).bit_count() <= bits and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
    return root


def test_fingerprints_and_components_equal_brute_force(docs):
    got = simhash.simhash_components(docs).collect()
    fps = [brute_fingerprint(t) for _, t in ROWS]
    groups = defaultdict(list)
    for (i, _), r in zip(ROWS, roots(fps), strict=True):
        groups[r].append(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    want = Counter((i, f"{fp:016x}", least[r]) for (i, _), fp, r in zip(ROWS, fps, roots(fps), strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_long_texts_are_hashed_whole():
    text = " ".join(f"w{i % 1013}" for i in range(400_000))
    assert simhash.fingerprint(text) & (1 << 64) - 1 == brute_fingerprint(text)


@pytest.mark.parametrize("large", [2048, 5])
def test_links_connect_what_all_pairs_connect(spark, large, monkeypatch):
    """Also when blocks are split a second time."""
    monkeypatch.setattr(simhash, "LARGE_BLOCK", large)
    rng = np.random.default_rng(3)
    values = {int(x) for x in rng.integers(0, 2**63, 150)}
    for centre in list(values)[:6]:
        for _ in range(30):
            centre ^= 1 << int(rng.integers(0, 64))
            values.add(centre)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    links = [(r.a, r.b) for r in simhash.fingerprint_links(fps).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links)
    root = {v: v for v in values}
    for _ in range(len(values)):
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    want = roots([v & (1 << 64) - 1 for v in values])
    assert [values.index(root[v]) for v in values] == want


def test_one_row_of_each_component_stays(docs, no_docs):
    left = simhash.drop_near_copies(docs)
    fps = [brute_fingerprint(t) for _, t in ROWS]
    assert left.columns == docs.columns
    assert left.count() == len(set(roots(fps)))
    assert simhash.drop_near_copies(no_docs).count() == 0
    assert simhash.simhash_components(no_docs).count() == 0
