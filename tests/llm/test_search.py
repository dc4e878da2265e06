import math
import re
from collections import Counter

import pytest
from fixtures_llm import ROWS

from candlewick.llm import search

ITEMS = [(1, "Alpha beta"), (2, "eight nine ten, one"), (3, None), (4, ""), (5, "zebra"), (6, "alpha alpha 中文 naïve"), (1, "Alpha beta"), (None, "end of lambda0 mu1")]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, k):
    docs = [(i, Counter(terms(t)), len(terms(t))) for i, t in rows]
    n_docs, n_all = sum(n > 0 for _, _, n in docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        found = []
        for i, c, n in docs:
            m = 100 - 25 + 25 * n * n_docs // max(1, n_all)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, at + 1, i, -s) for at, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def ranked(df, spark, items, k):
    queries = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, search.rank(df, queries, k).collect()), key=str)


@pytest.mark.parametrize("k", [1, 3, 20])
def test_ranking_equals_brute_force(docs, spark, k):
    assert ranked(docs, spark, ITEMS, k) == brute(ROWS, ITEMS, k)


def test_small_blocks_and_passes_change_nothing(docs, spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 2)
    monkeypatch.setattr(search, "PASS_TERMS", 4)
    monkeypatch.setattr(search, "SEED_POSTINGS", 1)
    assert ranked(docs, spark, ITEMS, 3) == brute(ROWS, ITEMS, 3)


def test_accumulators_stop_and_ties_go_by_id(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 100)
    rows = [(i, "common words here" + (" rare" if i % 50 == 3 else "") + (f" only{i % 90}" if i % 7 == 0 else "")) for i in range(1500)]
    items = [(1, "common words here rare"), (2, "common"), (3, "only3 only7 common"), (4, "common rare rare only0")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert ranked(df, spark, items, 5) == brute(rows, items, 5)


def test_string_ids_and_empty_tables(docs, no_docs, spark):
    queries = spark.createDataFrame(ITEMS, "item_id long, text string")
    named = docs.selectExpr("concat('d', doc_id) AS doc_id", "text")
    got = search.rank(named, queries, 2).filter("item_id = 5 OR item_id = 6").collect()
    assert [(r.item_id, r.doc_id) for r in sorted(got, key=lambda r: r["rank"])][0] == (6, "d11")
    assert search.rank(no_docs, queries).count() == 0
    assert search.rank(docs, queries.limit(0)).count() == 0
