import hashlib
from collections import Counter

import numpy as np
import pytest
from fixtures_llm import ROWS

from candlewick.llm import queries, substring


def brute(rows, window):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((doc, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return Counter(out)


@pytest.mark.parametrize("window", [2, 5, 35])
def test_awkward_rows(docs, no_docs, window):
    got = substring.cut_repeats(docs, window=window).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute(ROWS, window)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got)
    assert substring.cut_repeats(no_docs, window=window).count() == 0


def test_random_texts_of_few_words(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["a", "b", "c"], int(rng.integers(0, 60))))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.cut_repeats(df, window=9).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute(rows, 9)


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = Counter((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for (d, n, k, t), c in brute(rows, 35).items() for _ in range(c))
    got = queries.op6_substring_dedup(spark, sf).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
