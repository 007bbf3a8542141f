"""Problem 5: splitting oversized texts at natural boundaries by pointer doubling.

Every text yields a table of boundaries on four ranks: 0 line, 1 sentence, 2 word, 3 character. The table is
joined to itself by position: each boundary gets its farthest legal successor: the last boundary of the coarsest
possible rank within the size limit of the next piece, which starts up to the overlap before its predecessor's stop.
Squaring the successor table (S := S o S) until it is stationary gives, for all boundaries of a text at once, the members
of the greedy chain: a boundary is on the chain if it is an image of the first one. The tables are arrays of one text
after the other in Arrow batches, so nothing is shuffled and a text of any length is one row.

Units are measured without the white space that follows them: a line without its line feed, a sentence from its
first to its last visible character, a word as a run without white space.

Defined results: null texts and texts within the limit give nothing in `boundaries`, and one piece (null: none) in
`cut`; rows repeated under one id count once; null ids are ignored; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvana.functions.arrow import map_batches

RANKS = ("line", "sentence", "word", "none")
_END = re.compile(r"(?<![.!?…])[.!?…]++[\"'”’»›)\]}]*+(?=\s|$)", re.M)
_SPACE = re.compile(r"\s+")
#: Words before a dot that do not end a sentence (fixed values); initials (see `_dot_ends`) never do either.
ABBREVIATIONS = frozenset(
    "tp tx tt ts ths gs pgs bs ks cn ls nsnd nsưt ths.bs v.v vv vd nxb tr gđ pgđ ptgđ hđqt ubnd thpt thcs tnhh ctcp cty tct đc sđt đh cđ bv clb hlv svđ kcn htx lhp nc "
    "vs dr mr mrs ms jr sr prof inc ltd co corp dept vol pp etc e.g i.e u.s".split()
)
_BEFORE = re.compile(r"[^\s\"'“‘«(\[{]*$")


def _dot_ends(text: str, start: int, marks: str) -> bool:
    """Whether the marks at `start` end a sentence: a lone dot after an abbreviation or an initial does not."""
    if marks.rstrip("\"'”’»›)]}") != ".":
        return True
    word = _BEFORE.search(text, max(0, start - 24), start).group()
    parts = word.split(".")
    last = parts[-1]
    initial = len(last) == 1 and last.isalpha() and (last.isupper() or last in "bcdfghjklmnpqrstvxzđ")
    return not (initial or last.lower() in ABBREVIATIONS or word.lower() in ABBREVIATIONS)


def units(text: str, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the units of a rank, in order; lines keep blank ones, other ranks skip white space."""
    if rank == 0:
        feeds = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10)
        return np.concatenate(([0], feeds + 1)), np.concatenate((feeds, [len(text)]))
    if rank == 3:
        at = np.arange(len(text))
        return at, at + 1
    gaps = [m.span() for m in _SPACE.finditer(text)]
    if rank == 1:  # only gaps after a sentence's end or over a line feed divide
        ends = {m.end() for m in _END.finditer(text) if _dot_ends(text, m.start(), m.group())}
        gaps = [(a, b) for a, b in gaps if a in ends or "\n" in text[a:b]]
    e = np.array([a for a, _ in gaps] + [len(text)])
    s = np.array([0] + [b for _, b in gaps])
    keep = e > s
    return s[keep], e[keep]


def doubled(successor: np.ndarray) -> np.ndarray:
    """The last element of the chain from every element: the table squared until it is stationary."""
    s = successor
    while True:
        t = s[s]
        if np.array_equal(t, s):
            return s
        s = t


def on_chain(successor: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mask of the elements reached from `first`, all in parallel: after k squarings the mask holds the first 2^k."""
    mask = np.zeros(len(successor), bool)
    mask[first] = True
    s = successor
    while True:
        mask[s[mask]] = True
        t = s[s]
        if np.array_equal(t, s):
            mask[s[mask]] = True
            return mask
        s = t


def _reaches(text: str, rank: int, limit: int) -> bool:
    """Whether cuts at this rank get from the start to the end with every piece within the limit."""
    s, e = units(text, rank)
    if not len(s):
        return True
    far = np.searchsorted(e, s + limit, "right")  # the unit after the last one that fits
    nxt = np.append(np.maximum(far, np.arange(len(s))), len(s))
    return doubled(nxt)[0] == len(s)


def coarsest(text: str, limit: int) -> int:
    return next(r for r in (0, 1, 2, 3) if r == 3 or _reaches(text, r, limit))


def cut_points(text: str, limit: int, overlap: int, rank: int | None = None) -> list[tuple[int, int]]:
    """(start, stop) of the pieces in order: every piece within the limit, consecutive ones sharing up to `overlap`."""
    if len(text) <= limit:
        return [(0, len(text))]
    rank = coarsest(text, limit) if rank is None else rank
    tables = [units(text, r) for r in range(rank + 1)]
    # States are the stops of pieces. The next piece is cut at the coarsest rank that has an end within the limit; it starts as
    # far back, up to the overlap, as still lets it reach the first such end.
    starts = np.unique(np.concatenate([t[0] for t in tables] + ([units(text, 2)[0]] if rank < 2 else [])))
    states = np.unique(np.concatenate([[0]] + [t[1] for t in tables]))
    plain = np.append(starts, len(text))[np.searchsorted(starts, states)]
    begin, stop = np.full(len(states), len(text)), np.full(len(states), len(text))
    todo = np.ones(len(states), bool)
    for s, e in tables:
        first = np.append(e, len(text) + limit + 1)[np.searchsorted(e, states, "right")]
        ok = todo & (first <= plain + limit)
        begin[ok] = np.minimum(np.append(starts, len(text))[np.searchsorted(starts, np.maximum(states[ok] - overlap, first[ok] - limit))], plain[ok])
        stop[ok] = e[np.searchsorted(e, begin[ok] + limit, "right") - 1]
        todo &= ~ok
    end = len(states)
    nxt = np.where(todo | (stop >= len(text.rstrip())), end, np.searchsorted(states, stop))
    chain = np.flatnonzero(on_chain(np.append(nxt, end), np.array([0]))[:end])
    found: list[tuple[int, int]] = []
    for k in chain[::-1]:  # a piece that the next one holds whole is none
        if not todo[k] and (not found or begin[k] < found[-1][0]):
            found.append((int(begin[k]), int(stop[k])))
    return found[::-1]


def _oversized(articles: DataFrame, limit: int) -> DataFrame:
    return articles.select(F.col("id").alias("id"), F.col("content").alias("content")).where(F.col("id").isNotNull() & (F.char_length("content") > limit))


def boundaries(articles: DataFrame, limit: int = 3000) -> DataFrame:
    """(article_id, boundary): the coarsest rank at which each oversized content can be cut."""

    def rank(_, cols):
        return {"article_id": cols["id"], "boundary": [RANKS[coarsest(t, limit)] for t in cols["content"]]}

    return map_batches(_oversized(articles, limit), rank, "article_id long, boundary string").dropDuplicates(["article_id"])


def cut(articles: DataFrame, limit: int = 3000, overlap: int = 200) -> DataFrame:
    """(article_id, piece_no, start, stop, boundary, piece) of every content; offsets are in code points."""

    def split(_, cols):
        rows = []
        for i, t in zip(cols["id"], cols["content"]):
            r = coarsest(t, limit) if len(t) > limit else 0
            rows += [(i, n, a, b, RANKS[r], t[a:b]) for n, (a, b) in enumerate(cut_points(t, limit, overlap, r))]
        names = ("article_id", "piece_no", "start", "stop", "boundary", "piece")
        return dict(zip(names, map(list, zip(*rows)))) if rows else None

    some = articles.select(F.col("id").alias("id"), F.col("content").alias("content")).where("id is not null and content is not null")
    got = map_batches(some, split, "article_id long, piece_no int, start int, stop int, boundary string, piece string", rows=500)
    return got.dropDuplicates(["article_id", "piece_no"])
