import random

import numpy as np
import pytest

from corvana.llm import pieces
from corvana.llm.pieces import RANKS, coarsest, cut_points, doubled, on_chain, units


def plain_boundary(text, limit):
    for r in (0, 1, 2):
        s, e = units(text, r)
        if not len(s) or (e - s).max() <= limit:
            return r
    return 3


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Một câu. Hai câu! Ba?", ["Một câu.", "Hai câu!", "Ba?"]),
        ("Ở TP. Nam Thành, TS. N. V. An nói “Được.” Rồi về.", ["Ở TP. Nam Thành, TS. N. V. An nói “Được.”", "Rồi về."]),
        ("Giá 3.5 điểm, v.v. và hết…) Xong", ["Giá 3.5 điểm, v.v. và hết…)", "Xong"]),
        ("Dòng một\nDòng hai. ", ["Dòng một", "Dòng hai."]),
        ("  \n ", []),
    ],
)
def test_sentences(text, want):
    s, e = units(text, 1)
    assert [text[a:b] for a, b in zip(s, e)] == want


def test_doubling_against_a_walk():
    rng = np.random.default_rng(1)
    for n in (1, 2, 17, 300):
        nxt = np.append(np.minimum(np.arange(n) + rng.integers(1, 9, n), n), n)
        seen, i = [], 0
        while i < n:
            seen.append(i)
            i = nxt[i]
        assert np.flatnonzero(on_chain(nxt, np.array([0]))[:n]).tolist() == seen
        assert doubled(nxt)[0] == n


def make(rng):
    parts = []
    for _ in range(rng.randrange(1, 30)):
        parts.append(" ".join("x" * rng.choice([1, 4, 9, 60]) for _ in range(rng.randrange(1, 25))) + rng.choice([".", "!", "", "…"]))
    return "".join(p + rng.choice([" ", "\n", "\n\n", "\r\n"]) for p in parts)


def test_pieces_hold_the_limit():
    rng = random.Random(3)
    for _ in range(200):
        t, limit, overlap = make(rng), rng.choice([40, 80, 200]), rng.choice([0, 10, 20])
        r = coarsest(t, limit)
        assert r == plain_boundary(t, limit) or not t.strip()
        p = cut_points(t, limit, overlap, r)
        assert all(0 < b - a <= limit for a, b in p)
        at = 0
        for (a, b), nxt in zip(p, [*p[1:], None]):
            assert not t[at:a].strip() or a <= at
            at = b
            if nxt:
                assert a < nxt[0] and b < nxt[1] and b - nxt[0] <= overlap
        assert not t[at:].strip()


def test_tables(spark, articles):
    got = {r["article_id"]: r["boundary"] for r in pieces.boundaries(articles).collect()}
    assert got == {8: "word"}
    cut = pieces.cut(articles).orderBy("article_id", "piece_no").collect()
    assert {r["article_id"] for r in cut} == {1, 2, 3, 4, 6, 7, 8} and all(len(r["piece"]) <= 3000 for r in cut)
    assert [r["piece"] for r in cut if r["article_id"] == 4] == ["chia sẻ"]
    assert pieces.boundaries(articles.limit(0)).count() == 0
    assert RANKS[coarsest("a" * 10, 3)] == "none"
