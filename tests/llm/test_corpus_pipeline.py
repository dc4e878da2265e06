from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import zlib
from test_exact import brute as exact_brute
from test_simhash import brute_fingerprint, roots
from tokenizers import Tokenizer

from candlewick.llm import packing
from candlewick.llm.common import stage
from candlewick.llm.queries import tokenizer_path


def test_every_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, function in corpus_pipeline.STAGES:
        before = docs
        docs = stage(function(spark, docs, sf), "test")
        kept[name] = docs
        if name == corpus_pipeline.STAGES[-1][0]:
            break
        assert docs.columns == before.columns
    quality, exact, near, mixed, packed = kept.values()

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r.doc_id for r in quality.collect()}
    assert sum((i in left) == bool(q) for i, q in labels.items()) >= 0.97 * len(labels)

    rows = [(r.doc_id, r.text) for r in quality.collect()]
    assert {r.doc_id for r in exact.collect()} == {i for i, _, _, stays in exact_brute(rows) if stays}

    rows = sorted((r.doc_id, r.text) for r in exact.collect())
    root = roots([brute_fingerprint(t) for _, t in rows])
    assert sorted(r.doc_id for r in near.collect()) == sorted(rows[i][0] for i in set(root))

    cost = {r.doc_id: 1 + len(r.text.encode().split()) for r in near.collect()}
    source = {r.doc_id: r.source for r in near.collect()}
    seen, spent = Counter(r.doc_id for r in mixed.collect()), defaultdict(int)
    for i, n in seen.items():
        spent[source[i]] += n * cost[i]
    assert set(seen) <= set(cost) and sum(spent.values()) <= sum(cost.values())

    tokenizer, want = Tokenizer.from_file(tokenizer_path()), Counter()
    for r in mixed.collect():
        ids = np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [0], "<u4")
        want.update((r.doc_id, k, s, n, zlib.crc32(ids[s:s + n].tobytes())) for k, (s, n) in enumerate(packing.pieces(len(ids))))
    rows = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    at = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 2048


def test_run_gives_the_last_stage(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages_take_awkward_rows(spark, sf, docs, no_docs):
    for start in (docs, no_docs):
        current = start
        for _, function in corpus_pipeline.STAGES:
            current = stage(function(spark, current, sf), "test")
        assert (current.count() > 0) == (start is docs)
