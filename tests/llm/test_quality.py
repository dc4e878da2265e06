import numpy as np
from pyspark.sql import functions as F

from candlewick.llm import quality, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = queries.op7_quality_classifier(spark, sf).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.kept == bool(r.quality) for r in held) >= 0.99 * len(held)
    assert sum(r.kept for r in held if r.quality) >= 0.995 * sum(r.quality for r in held)


def test_views_label_for_each_other():
    """A class that the labelled rows show in one view only is learnt by the other through the pool."""
    rng = np.random.default_rng(0)
    y = np.arange(400) % 2
    text, meta = rng.normal(y[:, None] * 6, 1, (400, 3)), rng.normal(y[:, None] * 6, 1, (400, 2))
    few = np.r_[0:40]
    means = lambda *views: ([v.mean(axis=0) for v in views], [v.std(axis=0) + 1e-6 for v in views])
    model = quality.train((text[few], meta[few]), y[few].astype(float), quality.ArrayPool(text[40:], meta[40:]), *means(text, meta))
    score = quality.apply(model, (text, meta))
    assert ((score[:, 0] > 0.5) == y).mean() > 0.98
    flat = rng.normal(0, 1, (400, 2))
    noise = quality.train((text[few], flat[few]), y[few].astype(float), quality.ArrayPool(text[40:], flat[40:]), *means(text, flat))
    assert ((quality.apply(noise, (text, rng.normal(0, 1, (400, 2))))[:, 0] > 0.5) == y).mean() > 0.95


def test_a_table_hands_over_what_all_rows_in_memory_would(spark, docs, monkeypatch):
    """Moments, surest rows and their views by tasks equal those of one array; every row takes part."""
    monkeypatch.setattr(quality, "HANDED", 3)
    monkeypatch.setattr(quality, "SURE", 0.5)
    many = docs.union(docs).withColumn("row", F.monotonically_increasing_id()).withColumn("label", F.lit(None).cast("double"))
    views = many.select("row", "label", "text", *quality.META).repartition(5).mapInArrow(
        quality._view_rows, "row long, label double, text array<float>, meta array<float>").checkpoint()
    rows = sorted(views.collect(), key=lambda r: r.row)
    text, meta = np.array([r.text for r in rows], float), quality.meta_view(np.array([r.meta for r in rows], float))
    mean, scale = quality.moments(views)
    for k, v in enumerate((text, meta)):
        assert np.allclose(mean[k], v.mean(axis=0)) and np.allclose(scale[k], v.std(axis=0) + 1e-6, atol=1e-5)
    draw = np.random.default_rng(1)
    models = [{"mean": mean[k], "scale": scale[k], "w": draw.normal(size=v.shape[1] + 1)} for k, v in enumerate((text, meta))]
    numbers = np.array([r.row for r in rows])
    taken = numbers[::4]
    got = quality.TablePool(views).surest(models, taken)
    want = quality.ArrayPool(text, meta).surest(models, np.arange(len(rows))[::4])
    assert [(k, label, row) for k, label, _, row in got] == [(k, label, numbers[i]) for k, label, _, i in want] and got
    given = quality.TablePool(views).rows(np.array([r[3] for r in got]))
    assert np.allclose(given[0], text[[r[3] for r in want]]) and np.allclose(given[1], meta[[r[3] for r in want]])


def test_contradicting_labels_are_left_out(spark, docs):
    sure = [(1, 1), (2, 1), (3, 0), (9, 0), (10, 1), (14, 0), (15, 1), (16, 0), (17, 1), (8, 0)]
    schema = "doc_id long, quality int"
    plain, mixed = (quality.fit(docs, spark.createDataFrame(rows, schema)) for rows in (sure, [*sure, (12, 1), (12, 0), (13, None)]))
    assert np.allclose(plain["vote"], mixed["vote"])


def test_awkward_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(i, q) for i, q in [(1, 1), (2, 1), (3, 0), (4, 0), (8, 1), (9, 0), (10, 1), (14, 0), (15, 1), (16, 0), (17, 1), (12, None)]],
                                   "doc_id long, quality int")
    got = quality.keep_good(docs, labels)
    assert got.columns == docs.columns and got.count() <= docs.count()
    scores = docs.select(quality.score(docs, quality.fit(docs, labels))["score"].alias("x")).collect()
    assert len(scores) == docs.count() and all(0 <= r.x <= 1 for r in scores)
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()
    assert quality.keep_good(no_docs, labels).count() == 0
    assert quality.keep_good(docs.select("doc_id", "text"), labels).columns == ["doc_id", "text"]
