"""Problem 1: the main text of pages, by a tree-structured graphical model over a page's lines.

The lines of a page form a tree: a repeated label ("more stories", a menu entry) is the parent of the unclosed lines
that follow it, every other line hangs on the preceding line outside such a list. Every line is a node with two states,
story or furniture. Node potentials come from a logistic model of a line's shape, its words, how widely it is repeated,
and how much of its wording recurs in the page's closed sentences; edge potentials are one 2 x 2 table for each kind of
parent-child pair. Sum-product messages run upward from the leaves and downward from the root and give each line's
exact marginal probability of being story.

Training: the labelled pages of `page_examples`, and all pages of the corpus, in which lines repeated over many pages without wording in common with their page are furniture, sentences
that share wording with their page are story, and all others are hidden; the edge tables are re-estimated from the
expected counts that the messages give. In training, repetition is withheld from half of the lines so that shape and
words are learned, and parts of story sentences stand in for headings and list items. The pages are divided by a hash into
groups of about `group_pages`, potentials are fitted in each group where it lies, and weights and expected counts are
averaged over all groups. Each group's pages are stored as numbers along with its potentials, and judged from there. Which
labels lead lists is counted over all pages, too.

Repetition is the number of pages with the line (digits, e-mail addresses and the source's own name unified), over all
pages. A group of copies of one story repeats its lines too; these share their wording with the rest of their page, which
repeated furniture does not, so the two are told apart however large the group is. Lines in at least 1/2500 of all pages
are at most 2500 times the lines of an average page and may be sent to the executors.

Defined results: blank lines are never reported; null or blank content has no lines; a null source masks nothing; rows
repeated under one id count once; null ids are ignored; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvana.functions.arrow import map_batches
from corvana.llm.page_examples import PAGES
from corvana.session import stored

_DIGITS = re.compile(r"[0-9]+")
_WORD = re.compile(r"[^\W_]+")
_CLOSED = re.compile(r"[.!?…]+[\"'”’»)\]]*$")
_MARK = re.compile(r"(?:(»+|>+|[-–*+]|•|\d{1,2}[.)]|\d{1,2}(?=\s+[^\W\d]))\s*)")
_STEP = re.compile(r"\w+ \d+:")
_SEPARATED = re.compile(r"\s[|›»•/·]\s")


def form(line: str, source: str) -> str:
    """The line with case, white space, digits, addresses and the source's name unified; '' if blank."""
    s = " ".join(line.lower().split())
    if "@" in s:
        s = " ".join("@" if "@" in w else w for w in s.split(" "))
    if source and source in s:
        s = s.replace(source, "§")
    return _DIGITS.sub("0", s)


def _key(s: str) -> int:
    h = xxhash.xxh64_intdigest(s)
    return h - (1 << 64) if h >> 63 else h


def _lower(source: str | None) -> str:
    return " ".join(unicodedata.normalize("NFC", source).lower().split()) if source else ""


def lines_of(text: str, source: str) -> list[tuple[int, str, str]]:
    """(line_no, visible line, form) of the non-blank lines; the forms of a whole page at once, for no step of them crosses a line."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    if "@" in text:
        return [(i, x.strip(), f) for i, x in enumerate(text.split("\n")) if (f := form(x, source))]
    s = "\n".join([" ".join(x.split()) for x in text.lower().split("\n")])
    if source and source in s:
        s = s.replace(source, "§")
    return [(i, x.strip(), f) for i, (x, f) in enumerate(zip(text.split("\n"), _DIGITS.sub("0", s).split("\n"))) if f]


def words_of(f: str) -> list[str]:
    """The runs of letters and digits."""
    s = f
    for c in ',.:-/%?!"“”…()|':
        s = s.replace(c, " ")
    words = s.split()
    return words if "".join(words).isalnum() else _WORD.findall(f)  # where nothing else divides words, split finds the same


def is_closed(line: str) -> bool:
    return _CLOSED.search(line, max(0, len(line) - 12)) is not None


def shape(line: str) -> tuple[tuple[str, ...], str, bool]:
    """(shape features, kind of line, whether it is closed by a sentence mark)."""
    closed = is_closed(line)
    m = _MARK.match(line)
    mark = (m.group(1) if m else "")[:1]
    mark = ("n." if m.group(1)[-1] in ".)" else "n") if mark.isdigit() else mark
    rest = line[m.end() :] if m else line
    first = rest[:1]
    case = "U" if first.isupper() else "l" if first.islower() else "x"
    if len(line) > 240:
        return (f"mark{mark}", f"case{case}", f"mark{mark}{case}", "size6", f"closed{closed}", f"closed{closed}6"), "closed" if closed else "long", closed
    words = rest.split()
    n = len(words)
    letters = [w for w in words if w[:1].isalpha()] if n <= 6 else []
    title = bool(letters) and all(w[0].isupper() for w in letters)
    size = "1" if n <= 1 else "2" if n <= 3 else "3" if n <= 6 else "4" if n <= 12 else "5" if n <= 25 else "6"
    separators = len(_SEPARATED.findall(line))
    cells = separators and sum(p.strip().isdigit() for p in line.split("|")) > 0
    colon = line.find(":")
    f = [f"mark{mark}", f"case{case}", f"mark{mark}{case}", f"size{size}", f"closed{closed}", f"closed{closed}{size}"]
    f += ["title"] * title + [f"title{size}"] * title
    f += ["sep"] * (separators > 1) + ["cells"] * bool(cells)
    f += [f"colon{'early' if colon < 30 else 'late'}{size if colon < 30 else ''}"] * (colon > 0)
    f += ["ends:"] * line.endswith(":") + ["paren"] * (line.startswith("(") and line.endswith(")")) + ["bracket"] * line.startswith("[")
    f += ["step"] * bool(_STEP.match(line))
    kind = "closed" if closed else f"item{mark}{case}" if mark else "cells" if cells else "sep" if separators > 1 else "name" if title else "short" if n <= 3 else "open"
    return tuple(f), kind, closed


_WIDE = tuple(tuple(f"wide{k}" for k in range(1, w + 1)) for w in range(4))


def context(kind: str, closed: bool, share: float, slot: int, place: str) -> tuple[str, ...]:
    """Features of a line in its page: wording in common with it, distance from a repeated label, place."""
    over = f"over{0 if share < 0.15 else 1 if share < 0.5 else 2}"
    return over, f"{over}closed{closed}", f"slot{slot}", f"slot{slot}{over}", f"{kind}slot{min(slot, 1)}", f"place{place}{closed}"


class Reader:
    """Numbers words, features and edges as they are met, and remembers short lines."""

    def __init__(self):
        self.words: dict = defaultdict()
        self.words.default_factory = self.words.__len__
        self.shapes: dict = {}
        self.contexts: dict = {}
        self.edges: dict = {}
        self.lines: dict = {}
        self.places: dict = {}

    def line(self, line: str, f: str) -> tuple[int, str, bool, list[int]]:
        """(number of the shape features, kind, whether closed, numbers of the words)."""
        got = self.lines.get((line, f))
        if got is None:
            sf, kind, closed = shape(line)
            number = self.words
            got = (self.shapes.setdefault(sf, len(self.shapes)), kind, closed, [number[w] for w in words_of(f)])
            if len(line) < 160:
                self.lines[line, f] = got
        return got

    def place(self, kind: str, closed: bool, share: float, slot: int, place: str) -> int:
        key = kind, closed, 0 if share < 0.15 else 1 if share < 0.5 else 2, slot, place
        got = self.places.get(key)
        if got is None:
            c = context(kind, closed, share, slot, place)
            got = self.places[key] = self.contexts.setdefault(c, len(self.contexts))
        return got


class Pages:
    """The nodes of many pages as arrays, page after page: line numbers, feature and word numbers, tree.

    pages: of each page its lines, how widely each is repeated, and whether each is a list's label."""

    __slots__ = ("at", "closed", "context", "edge", "no", "overlap", "parent", "shape", "shared", "start", "wide", "word")

    def __init__(self, pages: list[tuple[list[tuple[int, str, str]], list[int], list[bool]]], reader: Reader):
        read = [reader.line(x, f) for lines, _, _ in pages for _, x, f in lines]
        n = len(read)
        self.at = np.cumsum([0, *(len(x) for x, _, _ in pages)])
        self.no = np.array([x[0] for lines, _, _ in pages for x in lines], dtype=np.int64)
        self.wide = np.array([w for _, wide, _ in pages for w in wide], dtype=np.int64)
        self.shape = np.array([r[0] for r in read], dtype=np.int64)
        self.closed = np.array([r[2] for r in read], dtype=bool)
        self.start = np.cumsum([0, *(len(r[3]) for r in read)])
        self.word = np.fromiter(chain.from_iterable(r[3] for r in read), dtype=np.int64, count=int(self.start[-1]))
        self._share(len(reader.words))
        share, i = self.overlap.tolist(), 0
        parents, contexts, edges, number = [], [], [], reader.edges
        for lines, wide, heads in pages:
            begin, head, top, since = i, -1, -1, 0
            for w, label in zip(wide, heads):
                _, kind, closed, _ = read[i]
                if head >= 0 and not closed and w < 2:
                    since += 1
                    slot = min(since, 4)
                    parents.append(head)
                    e = f"item{slot}{'same' if share[i] >= 0.5 else 'other'}"
                else:
                    slot = 0
                    parents.append(top)
                    e = f"{'root' if top < 0 else read[top][1][:6]}-{kind[:6]}"
                    top = i
                    head, since = (i, 0) if label else (-1, 0)
                edges.append(number.setdefault(e, len(number)))
                place = "first" if i == begin else "last" if i == begin + len(lines) - 1 else ""
                contexts.append(reader.place(kind, closed, share[i], slot, place))
                i += 1
        self.parent, self.edge, self.context = (np.array(x, dtype=np.int64) for x in (parents, edges, contexts))

    def packed(self, ids: list[int], reader: Reader) -> bytes:
        """What `unpacked` gives: all that is needed to judge these pages, in few bytes."""
        used = np.zeros(len(reader.words), dtype=bool)
        used[self.word] = True
        word = (np.cumsum(used) - 1)[self.word]
        up = np.where(self.parent < 0, 0, np.arange(len(self.no)) - self.parent)
        arrays = np.diff(self.at), self.no, self.shape, self.context, self.wide, up, self.edge, np.diff(self.start), word
        names = list(reader.shapes), list(reader.contexts), list(reader.edges), [w for w, u in zip(reader.words, used.tolist()) if u]
        return pickle.dumps((ids, [a.astype(np.min_scalar_type(a.max(initial=0))) for a in arrays], names), 5)

    @classmethod
    def unpacked(cls, data: bytes) -> tuple[np.ndarray, Pages, Reader]:
        """(each page's id, the pages, the numbers of their features, words and edges)."""
        ids, arrays, names = pickle.loads(data)
        lines, no, shape_, context_, wide, up, edge, size, word = (a.astype(np.int64) for a in arrays)
        p, reader = cls.__new__(cls), Reader()
        p.at, p.no, p.shape, p.context, p.wide, p.edge, p.word = np.append(0, np.cumsum(lines)), no, shape_, context_, wide, edge, word
        p.parent, p.start = np.where(up > 0, np.arange(len(no)) - up, -1), np.append(0, np.cumsum(size))
        reader.shapes, reader.contexts, reader.edges, reader.words = ({x: i for i, x in enumerate(n)} for n in names)
        return np.array(ids, dtype=np.int64), p, reader

    def _share(self, v: int) -> None:
        """overlap: the share of a line's distinct word pairs that are in a closed line of its page, for a closed line in another
        one; shared: for each word whether it and the next are a pair of more than one closed line."""
        n = len(self.no)
        size = np.diff(self.start)
        full = self.closed & (size >= 8)
        page = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        line = np.repeat(np.arange(n), size)
        pos = np.flatnonzero(line[1:] == line[:-1])
        self.shared = np.zeros(len(self.word), dtype=bool)
        self.overlap = np.zeros(n)
        if not len(pos):
            return
        a, b, of = self.word[pos], self.word[pos + 1], page[line[pos]]
        order = np.argsort((of * v + a) * v + b, kind="stable") if len(self.at) * v * v < 1 << 62 else np.lexsort((b, a, of))
        a, b, of, line = a[order], b[order], of[order], line[pos][order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (of[1:] != of[:-1]))
        once = new | np.append(True, line[1:] != line[:-1])  # a pair's first place in its line
        pair = np.cumsum(new) - 1
        lines = np.bincount(pair, once & full[line])[pair]  # closed lines with the pair
        self.shared[pos[order]] = lines >= 2
        found = np.bincount(line, once & (lines >= np.where(full[line], 2, 1)), n)
        self.overlap = found / np.maximum(1, np.bincount(line, once, n))


def up_down(parent: list[int], edge: list, node: list[float], tables: dict, default) -> tuple[list[float], list]:
    """Sum-product on a forest whose parents precede their children. node: log-odds of furniture.

    Returns the marginal log-odds of each node and, for the expected counts, each edge's joint marginal.
    A message is the log-odds that it adds; tables: edge -> ((p00, p01), (p10, p11)) by (parent, child) state.
    """
    n = len(node)
    exp = math.exp
    log = math.log
    up = list(node)  # own evidence and all children's messages
    sent = [0.0] * n
    for i in range(n - 1, -1, -1):
        t = tables.get(edge[i], default)
        o = exp(max(-30.0, min(30.0, up[i])))
        sent[i] = log((t[1][0] + t[1][1] * o) / (t[0][0] + t[0][1] * o))
        if parent[i] >= 0:
            up[parent[i]] += sent[i]
    full = [0.0] * n
    joint = []
    for i in range(n):
        t = tables.get(edge[i], default)
        q = parent[i]
        o = exp(max(-30.0, min(30.0, full[q] - sent[i]))) if q >= 0 else 1.0  # the parent without this child; the root is even
        full[i] = up[i] + log((t[0][1] + o * t[1][1]) / (t[0][0] + o * t[1][0]))
        c = exp(max(-30.0, min(30.0, up[i])))
        j = (t[0][0], t[0][1] * c, o * t[1][0], o * t[1][1] * c)
        s = sum(j)
        joint.append(tuple(x / s for x in j))
    return full, joint


_LONG = 200  # lines; the messages of longer pages are sent page by page


def up_down_all(at: np.ndarray, parent: np.ndarray, edge: np.ndarray, node: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`up_down` over many pages at once, line by line of all pages; page p has the nodes at[p] to at[p + 1], t[edge] is a 2 x 2 table.

    Returns the marginal log-odds and, in rows of four, the joint marginals."""
    n, size = len(node), np.diff(at)
    full, joint = np.zeros(n), np.zeros((n, 4))
    place = np.arange(n) - np.repeat(at[:-1], size)
    rest = np.flatnonzero(np.repeat(size <= _LONG, size))
    rest = rest[np.argsort(place[rest], kind="stable")]
    steps = np.split(rest, np.flatnonzero(np.diff(place[rest])) + 1) if len(rest) else []
    p00, p01, p10, p11 = (t[edge, i, j] for i in (0, 1) for j in (0, 1))
    up, sent, above = node.copy(), np.zeros(n), np.ones(n)
    for i in reversed(steps):  # one line of each page, so no two add to one parent
        o = np.exp(np.clip(up[i], -30.0, 30.0))
        sent[i] = np.log((p10[i] + p11[i] * o) / (p00[i] + p01[i] * o))
        i = i[parent[i] >= 0]
        up[parent[i]] += sent[i]
    for i in steps:
        j = i[parent[i] >= 0]
        above[j] = np.exp(np.clip(full[parent[j]] - sent[j], -30.0, 30.0))
        full[i] = up[i] + np.log((p01[i] + above[i] * p11[i]) / (p00[i] + above[i] * p10[i]))
    c = np.exp(np.clip(up[rest], -30.0, 30.0))
    joint[rest] = np.stack([p00[rest], p01[rest] * c, above[rest] * p10[rest], above[rest] * p11[rest] * c], axis=1)
    for p in np.flatnonzero(size > _LONG):
        a, z = at[p], at[p + 1]
        up_ = [int(q) - int(a) if q >= 0 else -1 for q in parent[a:z]]
        own = dict(enumerate(t.tolist()))
        full[a:z], joint[a:z] = up_down(up_, edge[a:z].tolist(), node[a:z].tolist(), own, None)
    return full, joint / joint.sum(1, keepdims=True) if n else joint


class Model:
    """Weights of features and words, and edge tables."""

    def __init__(self, weights: dict, words: dict, bias: float, tables: dict):
        self.weights, self.words, self.bias, self.tables = weights, words, bias, tables
        self.default = ((0.6, 0.4), (0.4, 0.6))

    def node(self, pages: Pages, reader: Reader) -> np.ndarray:
        get, word = self.weights.get, self.words.get
        of = lambda features: np.array([sum(get(f, 0.0) for f in fs) for fs in features] or [0.0])
        out = self.bias + of(reader.shapes)[pages.shape] + of(reader.contexts)[pages.context] + of(_WIDE)[pages.wide]
        size = np.diff(pages.start)
        some = np.flatnonzero(size)
        if len(some):
            each = np.array([word(w, 0.0) for w in reader.words])
            out[some] += np.add.reduceat(each[pages.word], pages.start[:-1][some]) / np.sqrt(size[some])
        return out

    def messages(self, pages: Pages, reader: Reader, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = np.array([self.tables.get(e, self.default) for e in reader.edges] or [self.default])
        return up_down_all(pages.at, pages.parent, pages.edge, node, t)

    def furniture(self, pages: Pages, reader: Reader) -> np.ndarray:
        return self.messages(pages, reader, self.node(pages, reader))[0]


def _logistic(rows: list[tuple[tuple, list, float, float]], ridge: float = 3e-4, steps: int = 250) -> tuple[dict, dict, float]:
    """Weights from (features, numbers of words, label, weight) rows by full-batch Adam; words count 1 / sqrt(length).

    Equal rows count as one with the sum of their weights. Few rows differ in their features, so these are summed once for all
    rows that have the same."""
    weight: dict = defaultdict(float)
    for fs, ws, label, x in rows:
        weight[fs, tuple(ws), label] += x
    rows = list(weight)
    sets: dict = {}
    of = np.array([sets.setdefault(r[0], len(sets)) for r in rows])
    names: dict = {}
    one = np.array([names.setdefault(f, len(names)) for fs in sets for f in fs])
    many = np.array([len(fs) for fs in sets])
    first = np.cumsum(many) - many
    size = np.array([len(r[1]) for r in rows])
    idx = np.fromiter(chain.from_iterable(r[1] for r in rows), dtype=np.int64, count=int(size.sum()))
    used = np.bincount(idx) > 0
    words, idx = np.flatnonzero(used), (np.cumsum(used) - 1)[idx]
    some = np.flatnonzero(size)
    size = size[some]
    at = np.cumsum(size) - size
    scale = 1 / np.sqrt(size)
    order = np.argsort(idx.astype(np.min_scalar_type(len(words))), kind="stable")
    by_word, place = np.repeat(np.arange(len(some)), size)[order], np.searchsorted(idx[order], np.arange(len(words)))
    y = np.array([r[2] for r in rows])
    k = np.array(list(weight.values()))
    k = k / k.sum()
    n = len(names)
    w, b = np.zeros(n + len(words)), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    each = np.empty(len(idx))
    for t in range(1, steps + 1):
        z = np.add.reduceat(w[one], first)[of] + b
        z[some] += np.add.reduceat(np.take(w[n:], idx, out=each, mode="clip"), at) * scale
        err = (1 / (1 + np.exp(-z)) - y) * k
        shapes = np.bincount(one, np.repeat(np.bincount(of, err, len(sets)), many), n)
        g = np.concatenate([shapes, np.add.reduceat(np.take(err[some] * scale, by_word, out=each, mode="clip"), place), [err.sum()]])
        g[:-1] += ridge * w * 0.1
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        s = 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w -= s[:-1]
        b -= s[-1]
    w = w.tolist()
    return dict(zip(names, w)), dict(zip(words.tolist(), w[n:])), float(b)


def _examples(reader: Reader) -> tuple[Pages, list[int]]:
    pages, label = [], []
    for text in PAGES:
        rows = [(x[0], x[2:]) for x in text.split("\n")]
        marks = "".join(m for m, _ in rows)
        heads = [marks[i : i + 3] == "Fff" for i in range(len(rows))]
        pages.append(([(i, x, form(x, "")) for i, (_, x) in enumerate(rows)], [3 if m == "F" else 0 for m in marks], heads))
        label += [int(m in "Ff") for m in marks]
    return Pages(pages, reader), label


def _tables(count: dict) -> dict:
    """Conditional edge tables, divided by the child's own rate: the node model already holds the prior."""
    prior = np.sum([c for c in count.values()], axis=0)
    base = np.array([prior[0] + prior[2], prior[1] + prior[3]]) / prior.sum()
    tables = {}
    for e, c in count.items():
        rows_ = np.array([[c[0], c[1]], [c[2], c[3]]])
        cond = (rows_ + 2 * base) / (rows_ + 2 * base).sum(1, keepdims=True)
        own = (rows_.sum(0) + 2 * base) / (rows_.sum() + 2)
        t = np.sqrt(cond / own)  # tempered: features and edges share evidence
        tables[e] = ((float(t[0, 0]), float(t[0, 1])), (float(t[1, 0]), float(t[1, 1])))
    return tables


def train(batches: list[Pages], reader: Reader, rounds: int = 3) -> tuple[Model, dict]:
    """Potentials from the labelled examples and partly labelled pages, and the expected counts of the edges."""
    examples, y = _examples(reader)
    shapes, contexts, name = list(reader.shapes), list(reader.contexts), list(reader.words)
    rng = np.random.default_rng(4)
    rows = []
    ends = examples.start.tolist()
    for sf, c, b, a, z, v in zip(examples.shape, examples.context, examples.wide, ends, ends[1:], y):
        own, w = (*shapes[sf], *contexts[c]), examples.word[a:z].tolist()
        rows += [((*own, *_WIDE[b]), w, v, 12.0), (own, w, v, 6.0)]
    known = []
    for p in batches:
        size = np.diff(p.start)
        wide = (p.wide >= 2) & ~(p.closed & (p.overlap >= 0.3) & (size >= 8))
        told = p.closed & (size >= 10) & (p.overlap >= np.where(p.wide > 0, 0.5, 0.15))
        k = np.where(wide, 1, np.where(told, 0, -1))
        known.append(k)
        ends, some = p.start.tolist(), np.flatnonzero(k >= 0)
        for i, sf, c, b, v in zip(some.tolist(), p.shape[some].tolist(), p.context[some].tolist(), p.wide[some].tolist(), k[some].tolist()):
            w = p.word[ends[i] : ends[i + 1]].tolist()
            rows.append(((*shapes[sf], *contexts[c], *(_WIDE[b] if rng.random() < 0.5 else ())), w, v, 1.0))
            if v == 0 and rng.random() < 0.5:  # a part of the sentence in the shape of a heading or a list item
                at, n = rng.integers(0, len(w) - 4), rng.integers(5, 13)
                part = w[at : at + n]
                shared = p.shared[ends[i] + at : ends[i] + at + len(part) - 1].tolist()
                pairs = dict(zip(zip(part, part[1:]), shared))
                mark, upper, end = (("", True, ""), ("", True, ""), ("", True, ""), ("• ", False, ""), ("- ", False, ""), ("1. ", False, ""), ("Bước 1: ", False, ""), ("", False, " | 21 | 4"))[rng.integers(0, 8)]
                text = " ".join([name[x] for x in part])
                sf, kind, closed = shape(mark + (text[:1].upper() + text[1:] if upper else text) + end)
                rows.append(((*sf, *context(kind, closed, sum(pairs.values()) / max(1, len(pairs)), 0, "")), part, 0, 1.0))
    weights, words, bias = _logistic(rows)
    model = Model(weights, {name[w]: x for w, x in words.items()}, bias, {})
    nodes = [np.where(k < 0, model.node(p, reader), np.where(k > 0, 8.0, -8.0)) for p, k in zip(batches, known)]
    edges = list(reader.edges)
    start = np.zeros((len(edges), 4))
    for q, e, v in zip(examples.parent, examples.edge, y):
        start[e, 2 * (y[q] if q >= 0 else 0) + v] += 1.0
        if q < 0:
            start[e, 2 + v] += 1.0
    count: dict = {}
    for _ in range(rounds):  # expected counts of the edges
        total = 1.0 + start
        for p, node in zip(batches, nodes):
            joint = model.messages(p, reader, node)[1]
            total += 0.25 * np.stack([np.bincount(p.edge, joint[:, s], len(edges)) for s in range(4)], axis=1)
        count = dict(zip(edges, total.tolist()))
        model.tables = _tables(count)
    return model, count


def averaged(parts: DataFrame) -> Model:
    """One model from the (kind, name, values) of all groups' potentials, as `fitted` gives them."""
    kind: dict[str, dict] = {"f": {}, "w": {}, "b": {}, "e": {}}
    total = [F.sum(F.col("values")[i]).alias(f"v{i}") for i in range(4)]
    got = parts.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("groups"), *total).collect()  # features, words and edges, not pages
    groups = max(r["groups"] for r in got)  # each has a bias
    for r in got:
        kind[r["kind"]][r["name"]] = [r[f"v{i}"] / groups for i in range(4)]
    one = {k: {n: v[0] for n, v in kind[k].items()} for k in "fwb"}
    return Model(one["f"], one["w"], one["b"][""], _tables({e: [1 + x for x in v] for e, v in kind["e"].items()}))  # 1: a group without the edge


def fitted(model: Model, count: dict) -> list[tuple[str, str, list[float]]]:
    """(kind, name, values) of a group's weights, words, bias and edges; edges as counts beyond the 1 that each begins with."""
    out = [(k, n, [x, 0.0, 0.0, 0.0]) for k, named in (("f", model.weights), ("w", model.words), ("b", {"": model.bias})) for n, x in named.items()]
    return out + [("e", e, [float(x) - 1 for x in c]) for e, c in count.items()]


def lines_by_page(pages: DataFrame) -> DataFrame:
    """(u, s, k, seq): page, source and key of every line of a page, once; and one row a page with k null and, as seq, the
    keys of its lines in order, with 1 for a closed line in place of their last three bits."""

    def collect(_, cols):
        out: dict[str, list] = {"u": [], "s": [], "k": [], "seq": []}
        for u, t, s in zip(cols["u"], cols["text"], cols["source"]):
            low = _lower(s)
            seq = [(_key(f), is_closed(x)) for _, x, f in lines_of(t, low)]
            keys = [None, *{k for k, _ in seq}]
            out["seq"] += [[k >> 3 << 3 | c for k, c in seq], *[None] * (len(keys) - 1)]
            out["u"] += [u] * len(keys)
            out["s"] += [_key(low)] * len(keys)
            out["k"] += keys
        return out

    return map_batches(pages.select("u", "text", "source"), collect, "u long, s long, k long, seq array<long>")


def repetition(lines: DataFrame, n: int, least: float) -> DataFrame:
    """(s, k, level): lines repeated among all n pages (1: from the share `least`), or among the pages of their own source.

    The shares asked of a source's own pages are 25 times as high."""
    per = stored(lines.groupBy("s", "k").agg(F.count(F.lit(1)).alias("n")), "repeated")
    every = per.where("k is not null").groupBy("k").agg(F.sum("n").alias("every")).where("every >= 4")
    own = per.where("k is null").select("s", F.col("n").alias("pages"))  # one row a source

    def level(c: str, of, times: float):
        at = lambda floor, share: F.col(c) >= F.greatest(F.lit(float(floor)), of * times * share)
        return F.when(~at(4, least), 0).when(at(10, 1 / 400), 3).when(at(6, 1 / 1500), 2).otherwise(1)

    both = per.where("k is not null").join(every, "k").join(own, "s")
    return both.select("s", "k", F.greatest(level("every", F.lit(float(n)), 1.0), level("n", F.col("pages"), 25.0)).alias("level")).where("level > 0")


def list_heads(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """(label): keys, without their last three bits, of repeated, unclosed lines of which most occurrences on all pages are
    followed by two unclosed lines that are not repeated."""

    def count(_, cols):
        n, led = Counter(), Counter()
        for seq, codes in zip(cols["seq"], cols["codes"]):
            wide = {c >> 3 for c in codes if c & 3 >= 2}
            often = [c >> 3 in wide for c in seq]
            rare = [not (o or c & 1) for o, c in zip(often, seq)] + [False, False]
            for i, c in enumerate(seq):
                if often[i] and not c & 1:
                    n[c >> 3] += 1
                    led[c >> 3] += rare[i + 1] and rare[i + 2]
        return {"label": list(n), "n": list(n.values()), "led": [led[x] for x in n]} if n else None

    seen = map_batches(lines.where("k is null").select("u", "seq").join(marks, "u").select("seq", "codes"), count, "label long, n long, led long")
    return seen.groupBy("label").agg(F.sum("n").alias("n"), F.sum("led").alias("led")).where("led + 1 > 0.5 * (n + 2)").select("label")


def _marks(codes) -> dict[int, int]:
    """What is known of a page's lines, from its codes: key without the last three bits -> 4 for a list's label, and the level."""
    return {c >> 3: c & 7 for c in codes} if codes is not None else {}


_CHARS = 4_000_000  # of text whose pages are held as arrays at once


def read_pages(texts: list, sources: list, codes: list, reader: Reader) -> Iterator[tuple[int, Pages]]:
    """(index of the first page, pages) for runs of pages of bounded text."""
    held, first, chars = [], 0, 0
    for i, (text, source, c) in enumerate(zip(texts, sources, codes)):
        if held and chars + len(text) > _CHARS:
            yield first, Pages(held, reader)
            held, first, chars = [], i, 0
        lines, known = lines_of(text, _lower(source)), _marks(c)
        got = [known.get(_key(f) >> 3, 0) for _, _, f in lines] if known else [0] * len(lines)
        held.append((lines, [c & 3 for c in got], [c > 3 for c in got]))
        chars += len(text)
    if held:
        yield first, Pages(held, reader)


def furniture_lines(articles: DataFrame, group_pages: int = 1500, least: float = 1 / 2500, odds: float = 0.0) -> DataFrame:
    """(article_id, line_no): every non-blank line whose marginal log-odds of being furniture exceed `odds`."""
    spark = articles.sparkSession
    pages = articles.select(F.col("id").alias("id"), F.col("content").alias("text"), F.col("source").alias("source")).where("id is not null and text is not null")
    pages = pages.withColumn("u", F.xxhash64("id", "text", "source"))
    n = pages.count()
    lines = stored(lines_by_page(pages), "lines")
    often = stored(repetition(lines, n, least), "levels").withColumn("label", F.shiftright("k", 3))

    def marks(known: DataFrame) -> DataFrame:
        code = F.shiftleft("label", 3) + F.when(F.col("head"), 4).otherwise(0) + F.col("level")
        return lines.where("k is not null").select("u", "s", "k").join(known, ["s", "k"]).groupBy("u").agg(F.collect_set(code).alias("codes"))

    heads = stored(list_heads(lines, marks(often.where("level >= 2").withColumn("head", F.lit(False)))), "heads")
    marked = stored(marks(often.join(heads.withColumn("head", F.lit(True)), "label", "left")), "marks")
    whole = pages.join(marked, "u", "left").select("id", "text", "source", "codes")
    groups = max(1, n // group_pages)

    def fit(rows):
        rows = rows.drop_duplicates(["id", "text", "source"]).sort_values(["id", "text"])
        ids, reader = rows["id"].tolist(), Reader()
        codes = [None if c is None else c.tolist() for c in rows["codes"]]
        read = list(read_pages(rows["text"].tolist(), rows["source"].tolist(), codes, reader))
        got = [(*x, None) for x in fitted(*train([p for _, p in read], reader))]
        got += [("p", None, None, p.packed(ids[at : at + len(p.at) - 1], reader)) for at, p in read]
        return pd.DataFrame(got, columns=["kind", "name", "values", "pages"])

    part = F.pmod(F.xxhash64(F.lit(2), "id", "text"), F.lit(groups))
    fits = whole.withColumn("part", part).groupBy("part").applyInPandas(fit, "kind string, name string, values array<double>, pages binary")
    fits = stored(fits, "groups")  # the pages as they were read, too: they are judged with the mean of all groups
    shared = spark.sparkContext.broadcast(averaged(fits.where("kind <> 'p'")) if n else train([], Reader())[0])

    def score(_, cols):
        ids, nos = [], []
        for data in cols["pages"]:
            each, p, reader = Pages.unpacked(data)
            out = shared.value.furniture(p, reader) > odds
            ids.append(np.repeat(each, np.diff(p.at))[out])
            nos.append(p.no[out])
        return {"article_id": np.concatenate(ids), "line_no": np.concatenate(nos).astype(np.int32)}

    return map_batches(fits.where("kind = 'p'").select("pages"), score, "article_id long, line_no int", rows=8).distinct()


def stories(articles: DataFrame, **options) -> DataFrame:
    """(article_id, furniture, story): each article once, its content without the furniture lines."""
    gone = stored(furniture_lines(articles, **options), "furniture").groupBy("article_id").agg(F.collect_set("line_no").alias("gone"))
    one = articles.where("id is not null").groupBy(F.col("id").alias("article_id")).agg(F.max("content").alias("content"))
    kept = F.array_join(F.filter(F.split("content", "\n"), lambda line, i: ~F.array_contains(F.col("gone"), i)), "\n")
    return one.join(gone, "article_id", "left").select("article_id", F.coalesce(F.size("gone"), F.lit(0)).alias("furniture"), F.when(F.col("gone").isNull(), F.col("content")).otherwise(kept).alias("story"))
