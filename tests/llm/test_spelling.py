import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures_llm import ROWS

from candlewick.llm import queries, spelling
from candlewick.llm.common import read_table


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def edits(word, letters):
    """All strings one edit away."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
    return out - {word}


def brute_words(rows, min_chars=7, min_count=2):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= min_chars and n >= min_count}


def brute_groups(words, ratio=10):
    letters, out, form = {c for w in words for c in w}, {}, {}
    for w, n in words.items():
        near = [v for v in edits(w, letters) if v in words]
        best = min(near, key=lambda v: (-words[v], v)) if near else None
        form[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = (n, len(near))
    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n, k, words.get(form[w])) for w, (n, k) in out.items()}


@pytest.mark.parametrize("seed", range(30))
def test_index_finds_exactly_the_words_one_edit_away(seed):
    draw = random.Random(seed)
    letters = "abc"[:draw.choice((1, 2, 3))]
    words = sorted({"".join(draw.choice(letters) for _ in range(draw.randint(2, 6))) for _ in range(60)})
    asked = words[::2] + ["zz", letters * 9]
    lengths, found = np.array([len(w) for w in asked]), set()
    for back in (False, True):
        turned = [w[::-1] if back else w for w in words]
        exact = lengths // 2 if back else lengths - lengths // 2
        a, b = spelling.FmIndex(turned).near([w[::-1] if back else w for w in asked], exact)
        found |= {(asked[i], words[j]) for i, j in zip(a.tolist(), b.tolist())}
    assert found == {(a, b) for a in asked for b in words if one_edit(a, b)}


def test_index_of_nothing_and_of_one_letter():
    none = spelling.FmIndex([]).near(["abcdefg"], np.array([4]))
    assert len(none[0]) == 0
    a, b = spelling.FmIndex(["a" * 50_000, "a" * 50_001]).near(["a" * 50_000], np.array([25_000]))
    assert list(zip(a.tolist(), b.tolist())) == [(0, 1)]


def test_words_equal_a_plain_count(docs):
    got = {r.word: r.n for r in spelling.count_words(docs, min_chars=3, min_count=1).collect()}
    assert got == brute_words(ROWS, 3, 1)


def test_groups_equal_brute_force_when_hot_keys_are_dealt_to_parts(spark, monkeypatch):
    draw = random.Random(7)
    words = {"".join(["cre", *draw.choices("abé", k=draw.randint(2, 4)), "ing"]): draw.choice((2, 3, 30, 400, 5000)) for _ in range(400)}
    words |= {"distant": 3, "distent": 30, "distents": 300, "dixtents": 3000, "strasse": 2, "straße": 9}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    monkeypatch.setattr(spelling, "SEGMENT_WORDS", 50)
    got = spelling.variant_groups(df).collect()
    assert {tuple(r) for r in got} == brute_groups(words) and len(got) == len(words)


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in read_table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = queries.op11_spelling_variants(spark, sf).collect()
    assert {tuple(r) for r in got} == brute_groups(brute_words(rows)) and len(got)


def test_empty_table(no_docs):
    assert spelling.spelling_variants(no_docs).count() == 0
