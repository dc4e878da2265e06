from itertools import product

import numpy as np
import pytest

from candlewick.llm import queries, toxicity


@pytest.mark.parametrize("lengths", [[1], [4, 1, 3], [2, 6]])
def test_marginals_equal_enumeration(lengths):
    rng = np.random.default_rng(sum(lengths))
    emit, move = rng.normal(0, 2, sum(lengths)), rng.normal(0, 1, (2, 2))
    fore, back = toxicity.forward_backward(emit, np.array(lengths), move)
    at = 0
    for n in lengths:
        mass = np.zeros((n, 2))
        for path in product((0, 1), repeat=n):
            score = sum(emit[at + i] * s for i, s in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False))
            for i, s in enumerate(path):
                mass[i, s] += np.exp(score)
        assert np.allclose((fore + back)[at:at + n], np.log(mass[:, 1] / mass[:, 0]))
        at += n


def test_held_out_documents_and_spans(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = queries.op1_toxicity(spark, sf).join(labels, "doc_id").join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    hits = sum(r.predicted and r.toxic for r in held)
    assert hits >= 0.75 * sum(r.toxic for r in held)  # few labelled texts in some languages
    assert hits >= 0.95 * sum(r.predicted for r in held)
    for r in got:
        assert r.predicted == int(r.score >= 0.7)
        assert all(0 <= s.start < s.end <= len(r.text.lower()) for s in r.spans)


def test_awkward_rows(spark, docs, no_docs):
    rng = np.random.default_rng(0)
    plain = [" ".join(f"word{k}" for k in rng.integers(0, 50, 30)) for _ in range(120)]
    toxic, clean = [f"{t} you wretch {t} a vile{i} one" for i, t in enumerate(plain[:40])], plain[40:]
    model = toxicity.train(toxic, clean)
    got = toxicity.tag(docs, model).collect()
    assert len(got) == docs.count()
    empty = [r for r in got if r.doc_id in (4, 5, 6, 7)]
    assert len({r.score for r in empty}) == 1 and not any(r.spans for r in empty) and empty[0].score < 0.7
    score, spans = toxicity.score_texts(["word1 word2 wretch, word3 WRETCH!", None], model, toxicity._Emissions(model))
    assert score[0] >= 0.7 > score[1] and (spans[0][0]["start"], spans[0][-1]["end"]) == (12, 32)
    assert toxicity.tag(no_docs, model).count() == 0


def test_without_labels_of_both_classes_every_score_is_zero(spark, docs):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model is None
    assert {r.score for r in toxicity.tag(docs, model).collect()} == {0.0}


def test_only_near_copies_of_a_label_are_dropped():
    word = lambda i, k: f"w{i}x{k}"
    passage = [word("p", k) for k in range(30)]
    share = [passage + [word(i, k) for k in range(30)] for i in range(40)]  # a third of all passages of two such texts
    assert toxicity._distinct(share, np.array([1] * 20 + [0] * 20)) == list(range(40))
    long = [word("q", k) for k in range(400)]
    assert toxicity._distinct([long, long, [*long, "end"], long, long], np.array([1, 1, 1, 0, 0])) == [0, 3]


def test_long_texts_train_where_there_are_no_others(spark):
    """A corpus of long texts only is learnt from, whole; where short ones suffice they are taken."""
    filler = lambda: " ".join(f"word{i}" for i in draw.integers(0, 400, 200))
    draw = np.random.default_rng(0)
    rows = [(i, " ".join([filler(), *["gruk vex" if i % 2 else "fine day"] * 4, filler()])) for i in range(120)]
    df = spark.createDataFrame([*rows, (1, rows[1][1]), (500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(500, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, max_chars=1000)
    assert model is not None
    scores = {r.doc_id: r.score for r in toxicity.tag(df, model).collect()}
    assert min(s for i, s in scores.items() if i < 120 and i % 2) > max(s for i, s in scores.items() if i < 120 and not i % 2)
