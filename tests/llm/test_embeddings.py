import numpy as np
import pytest

from candlewick.llm import embeddings, queries


def brute(rows, least=0.98):
    """(n_links, component) of each (id, vector, label)."""
    def unit(v):
        if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v, float) / np.linalg.norm(np.array(v, float))
    units = [unit(v) if i is not None and label is not None else None for i, v, label in rows]
    near = [[j for j, w in enumerate(units) if i != j and u is not None and w is not None and len(u) == len(w)
             and rows[i][2] == rows[j][2] and float(u @ w) >= least] for i, u in enumerate(units)]
    root = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i, others in enumerate(near):
            low = min([root[i], *(root[j] for j in others)], key=lambda x: (x is None, x or 0))
            changed |= low != root[i]
            root[i] = low
    return sorted(((r[0], len(n), c) for r, n, c in zip(rows, near, root, strict=True)), key=str)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, n string, cid int")
    got = embeddings.near_vectors(df).collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)


def test_awkward_rows(spark):
    v, w = [1.0, 0.0, 0.5, -0.25], [0.0, 1.0, 0.0, 0.0]
    check(spark, [(1, v, 1), (2, v, 1), (3, [x * 4 for x in v], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [], 1), (8, [0.0] * 4, 1),
                  (9, [1.0, None, 0.0, 0.0], 1), (10, [float("nan"), 1.0, 0.0, 0.0], 1), (11, [float("inf"), 1.0, 0.0, 0.0], 1),
                  (12, w, 1), (12, w, 1), (13, [*v, 0.0], 1), (None, v, 1), (14, [1e-30 * x for x in v], 1), (15, [-x for x in v], 1)])


@pytest.mark.parametrize("part", [256, 7])
def test_large_groups_of_near_copies(spark, part, monkeypatch):
    """Also when buckets are compared part against part."""
    monkeypatch.setattr(embeddings, "PART", part)
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for _ in range(4):
        centre = rng.normal(size=32)
        for _ in range(40):
            rows.append((i, (centre + rng.normal(size=32) * 0.03).astype(np.float32).tolist(), i % 2))
            i += 1
        rows += [(i + k, rows[-1][1], rows[-1][2]) for k in range(3)]
        i += 3
    check(spark, rows)


def test_table_and_empty_table(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.filter("label < 2").collect()]
    want = {r[0]: r[1:] for r in brute(rows)}
    got = [r for r in queries.op3_embedding_near_dedup(spark, sf).collect() if r.vec_id in want]
    assert len(got) == len(want)
    assert sum(r.n_links for r in got) >= 0.99 * sum(n for n, _ in want.values())
    assert all(r.n_links <= want[r.vec_id][0] and r.component_id >= want[r.vec_id][1] for r in got)
    assert embeddings.near_vectors(table.limit(0)).count() == 0
