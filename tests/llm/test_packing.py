import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures_llm import ROWS
from tokenizers import Tokenizer

from candlewick.llm import packing
from candlewick.llm.queries import tokenizer_path

ODD = ["", "it's 12  34 x\n\n y <|endoftext|> z", "\x1c! \x1c!!", "  ", "\t\n x", "é 中文 ²³ \xa0 a  b", "I'LL 'll 've", "a " * 3000,
       " " * 200_000 + "x", "\U0001F600 ok\x00\x85"]


def test_ids_are_those_of_the_tokenizer():
    own, other = packing.ByteBpe(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for text in [*ODD, *(t for _, t in ROWS if t)]:
        assert own.ids(text).tolist() == other.encode(text, add_special_tokens=False).ids


def test_only_the_first_piece_may_be_short():
    assert packing.pieces(1) == [(0, 1)]
    assert packing.pieces(2048) == [(0, 2048)]
    assert packing.pieces(4100) == [(0, 4), (4, 2048), (2052, 2048)]


def best_fit_decreasing(sizes, capacity):
    room = []
    for s in sorted(sizes, reverse=True):
        fit = min((r for r in room if r >= s), default=capacity)
        if fit in room:
            room.remove(fit)
        room.append(fit - s)
    return len(room)


def fewest(sizes, capacity):
    """Exhaustive search."""
    best = [len(sizes)]

    def go(i, room):
        if len(room) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(room)
            return
        for j in {r: j for j, r in enumerate(room) if r >= sizes[i]}.values():
            go(i + 1, [*room[:j], room[j] - sizes[i], *room[j + 1:]])
        go(i + 1, [*room, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_plan_holds_every_piece_and_no_more_sequences_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 60))
    sizes = np.minimum(rng.geometric(0.1, int(rng.integers(1, 300))), capacity) if seed % 2 else rng.integers(1, capacity + 1, int(rng.integers(1, 300)))
    left = np.bincount(sizes, minlength=capacity + 1)
    fixed = packing.reduce_instance(left, capacity)
    groups = fixed + packing.best_fit(left, capacity)
    held = Counter()
    for m, held_sizes in groups:
        assert m > 0
        assert sum(s * k for s, k in held_sizes) <= capacity
        for s, k in held_sizes:
            held[s] += m * k
    assert held == Counter(sizes.tolist())
    assert sum(m for m, _ in groups) <= best_fit_decreasing(sizes.tolist(), capacity)


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_the_optimum(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(8, 30))
    sizes = rng.integers(2, capacity + 1, 10).tolist()
    left = np.bincount(sizes, minlength=capacity + 1)
    fixed = packing.reduce_instance(left, capacity)
    rest = np.repeat(np.arange(capacity + 1), left).tolist()
    assert sum(m for m, _ in fixed) + fewest(rest, capacity) == fewest(sizes, capacity)


def test_pieces_fill_sequences_without_gap_or_overlap(docs, no_docs):
    rows = packing.pack(docs, tokenizer_path()).collect()
    other = Tokenizer.from_file(tokenizer_path())
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
        assert at[r.sequence_id] <= 2048
    want = Counter()
    for i, t in ROWS:
        ids = np.array(other.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.update((i, k, s, n, zlib.crc32(ids[s:s + n].tobytes())) for k, (s, n) in enumerate(packing.pieces(len(ids))))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert packing.pack(no_docs, tokenizer_path()).count() == 0
