import itertools
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.llm import langid, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op2_language_id(spark, sf).join(truth, "doc_id").filter("lang is not null").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 100
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_words_come_first_and_grams_back_off(spark):
    rows = [(1, "the cat sat", "en"), (2, "the dog", "en"), (3, "der hund lag", "de"), (4, "der kater", "de")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    scorer = langid.Scorer(model)
    assert model["langs"] == ["de", "en"]
    assert langid.identify("the", scorer, model["langs"])[0] == "en"
    assert langid.identify("hunde", scorer, model["langs"])[0] == "de"  # unseen: by its 4-grams
    assert langid.identify("中", scorer, model["langs"]) == ("de", 0.5)  # nothing known: a tie, first in order
    assert scorer.sums(["the", "hunde"]).shape == (2,)


def test_awkward_rows(docs, no_docs):
    got = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify_documents(docs, F.lit(True)).collect()}
    assert {(4, "und", 0.0), (5, "und", 0.0), (6, "und", 0.0), (7, "und", 0.0)} <= got
    assert langid.identify_documents(no_docs, F.lit(True)).count() == 0
    untaught = langid.identify_documents(docs, F.lit(False)).collect()
    assert len(untaught) == docs.count() and {r.lang_pred for r in untaught} == {"und"}


def test_forgetting_words_changes_no_sum(spark, monkeypatch):
    rows = [(1, "the cat sat on", "en"), (2, "der hund lag da", "de")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    text = ["catty", "hunds", "the", "xyz"]
    whole = langid.Scorer(model).sums(text).tolist()
    monkeypatch.setattr(langid, "CACHE_WORDS", 1)
    forgetful = langid.Scorer(model)
    assert [forgetful.sums(text).tolist() for _ in range(3)] == [whole] * 3


def brute(rows, text):
    """Language scores of a text straight from the definition: counts of words and n-grams in dicts."""
    langs = sorted({lang for _, lang, _ in rows})
    counts = {(lang, n): Counter() for lang in langs for n in range(5)}
    split = lambda t: ["".join(g) for ok, g in itertools.groupby(t.lower(), lambda c: unicodedata.category(c)[0] == "L") if ok]
    cut = lambda w, n: [w] if n == 0 else [m[i:i + n] for m in [w if n == 1 else f"^{w}$"] for i in range(len(m) - n + 1)]
    for _, lang, t in rows:
        for w in split(t):
            for n in range(5):
                counts[lang, n].update(cut(w, n))
    total = dict.fromkeys(langs, 0.0)
    for w in split(text):
        for n in (0, 4, 3, 2, 1):
            found = [g for g in cut(w, n) if any(counts[lang, n][g] for lang in langs)]
            if found:
                logs = {lang: np.mean([np.log((counts[lang, n][g] + 0.5) / (sum(counts[lang, n].values()) + 1)) for g in found]) for lang in langs}
                for lang in langs:
                    total[lang] += logs[lang] - np.mean(list(logs.values()))
                break
    return [total[lang] for lang in langs]


def test_scores_equal_brute_force(spark):
    rows = [(1, "aa", "xu " * 9 + "ye " * 9 + "zo " * 8), (2, "bb", "zo " * 7 + "wa " * 6 + "ye " * 5 + "q"), (3, "cc", "Über naïve xuye zowa"),
            (4, "bb", "quite other words, 12 of them² and x½y")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    scorer = langid.Scorer(model)
    for text in ("xu", "zo ye wa", "xuyo quit ÜBER", "zzz 中 q", "words wordy x²y", "naïver xuyezowa " * 9):
        assert scorer.sums(langid.words(text)) == pytest.approx(brute(rows, text), abs=1e-4), text


def test_numbers_are_no_letters(spark):
    rows = [(1, "the cat", "en"), (2, "der hund", "de")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for text in ("²", "½ ¾", "Ⅷ", "12_3", "٣"):
        assert langid.identify(text, langid.Scorer(model), model["langs"]) == ("und", 0.0)
    assert langid.words("x²y the½") == ["x", "y", "the"]
