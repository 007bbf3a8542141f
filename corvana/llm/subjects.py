"""Problem 2: subject areas by a seeded, anchored non-negative factorisation of the document-term matrix.

Terms are adjacent word pairs inside a sentence, known by a 32-bit hash, that occur in at least `least` of all documents (the vocabulary is
bounded by the pairs of an average document divided by `least`). Only closed sentences count: lines or parts of lines
that end in a sentence mark, which leaves menus, headlines of other stories and labels aside.

The matrix V (documents x terms, all documents) is factored as V ~ H W by alternating multiplicative updates under the
Kullback-Leibler divergence. One component per subject is anchored: labelled documents may use only the components of
their subjects and the background ones, and seed W; the background components take the wording that all subjects share.
A round updates H for each document on its own (given W, which is small) and then W from sums over all documents, which
are aggregated by term, so neither H nor V leaves the executors. The factors then explain every term of a sentence:
a sentence is about the anchored component that explains most of it, if that is enough, and a document's mixture is the
share of its sentences by subject.

Defined results: null and blank content gives no subject; a document without any sentence about a subject gets the
component with the greatest weight over all its terms, and none if it has no known term; labelled documents get their
labels; rows repeated under one id count once in the result; null ids are ignored; without labels the result is empty;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvana.functions.arrow import map_batches
from corvana.session import stored

_WORD = re.compile(r"[^\W_]+")
_GAP = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+")
_CLOSED = tuple(a + b for a in ".!?…" for b in ("", '"', "'", "”", "’", "»", ")", "]"))


def sentences(text: str | None) -> list[list[str]]:
    """The words of every closed sentence of more than three words, lower-case."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    got = []
    for line in text.lower().split("\n"):
        line = line.strip()
        if line:
            parts = _GAP.split(line)
            got += [w for x in parts[:-1] if len(w := _WORD.findall(x)) > 3]
            if line.endswith(_CLOSED) and len(w := _WORD.findall(parts[-1])) > 3:
                got.append(w)
    return got


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh32_intdigest(word)
        return h


def pairs_of(found: list[list[str]], words: dict) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hashes of the adjacent word pairs of all sentences, where each sentence ends among them)."""
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    n = np.array([len(s) for s in found])
    w = np.fromiter(map(words.__getitem__, (x for s in found for x in s)), np.uint32, int(n.sum()))
    h = (w[:-1] * np.uint32(0x9E3779B1)) ^ (w[1:] + np.uint32(0x7F4A7C15))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    inside = np.ones(len(w) - 1, bool)
    inside[np.cumsum(n)[:-1] - 1] = False
    return (h ^ (h >> np.uint32(13)))[inside], np.cumsum(n - 1).astype(np.int32)


def coded(docs: DataFrame) -> DataFrame:
    """(id, fit, pairs, ends): every document as the hashes of its word pairs; texts are read once, here."""

    def code(words, cols):
        got = [pairs_of(sentences(t), words) for t in cols["text"]]
        return {"id": cols["id"], "fit": cols["fit"], "pairs": [p.tobytes() for p, _ in got], "ends": [e.tobytes() for _, e in got]}

    return map_batches(docs.select("id", "fit", "text"), code, "id long, fit long, pairs binary, ends binary", _Words)


class _Frequencies:
    """Document frequencies of one task as sorted arrays, merged when many batches have come together."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.values, self.counts, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0

    def merge(self) -> None:
        v, c = np.unique(np.concatenate(self.parts), return_counts=True) if self.parts else (self.values[:0], self.counts[:0])
        self.parts = []
        v, at = np.unique(np.concatenate([self.values, v]), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate([self.counts, c]), len(v)).astype(np.int64)
        self.values = v

    def flush(self) -> dict | None:
        self.merge()
        got = {"term": np.append(self.values.astype(np.int64), -1), "n": np.append(self.counts, self.n)}
        self.values, self.counts, self.n = self.values[:0], self.counts[:0], 0
        return got


def vocabulary(matrix: DataFrame, least: float) -> np.ndarray:
    """Hashes of the pairs in at least `least` of all documents (and two), sorted."""

    def count(state, cols):
        state.n += len(cols["pairs"])
        state.parts += [np.unique(np.frombuffer(p, np.uint32)) for p in cols["pairs"]]
        if sum(map(len, state.parts)) > 2_000_000:
            state.merge()
        return state.flush() if len(state.values) > 2_000_000 else None

    df = stored(map_batches(matrix.select("pairs"), count, "term long, n long", _Frequencies).groupBy("term").agg(F.sum("n").alias("n")), "frequencies")
    total = df.where("term = -1").agg(F.sum("n")).first()[0] or 0
    rows = df.where((F.col("term") >= 0) & (F.col("n") >= max(2.0, total * least))).select("term").collect()  # at most the pairs of an average document / least
    return np.array(sorted(r["term"] for r in rows), np.uint32)


def weighed(matrix: DataFrame, terms: np.ndarray) -> DataFrame:
    """(id, fit, flat, ends, term, n): the known terms of every document in order, where its sentences end among them, and
    its row of the document-term matrix. Read by every round."""
    v = max(1, len(terms))

    def weigh(_, cols):
        out = {"id": cols["id"], "fit": cols["fit"], "flat": [], "ends": [], "term": [], "n": []}
        for p, e in zip(cols["pairs"], cols["ends"]):
            p, e = np.frombuffer(p, np.uint32), np.frombuffer(e, np.int32)
            at = np.minimum(np.searchsorted(terms, p), v - 1).astype(np.int32)
            known = terms[at] == p if len(terms) else np.zeros(len(p), bool)
            flat = at[known]
            term, n = np.unique(flat, return_counts=True)
            out["flat"].append(flat.tobytes())
            out["ends"].append(np.concatenate(([0], np.cumsum(known)))[e].astype(np.int32).tobytes())
            out["term"].append(term.tobytes())
            out["n"].append(n.astype(np.float32).tobytes())
        return out

    return map_batches(matrix, weigh, "id long, fit long, flat binary, ends binary, term binary, n binary")


def _batch(cols: dict, k: int, b: int):
    """Flattened counts (row, term, n) of a batch; allowed components."""
    size = [len(t) // 4 for t in cols["term"]]
    row = np.repeat(np.arange(len(size)), size)
    term, n = np.frombuffer(b"".join(cols["term"]), np.int32), np.frombuffer(b"".join(cols["n"]), np.float32)
    mask = np.array([(1 << k) - 1 if m is None else m for m in cols["fit"]], np.int64)
    allow = np.c_[(mask[:, None] >> np.arange(k)) & 1, np.ones((len(size), b), int)].astype(np.float32)
    return row, term, n, allow


def h_step(row, term, n, allow, w, steps: int):
    """H of a batch given W by `steps` multiplicative updates from an even start; also V / HW at V's entries."""
    h = allow / np.maximum(allow.sum(1, keepdims=True), 1)
    if not len(row):
        return h, n
    wt = w[term]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    docs = row[first]
    total = np.add.reduceat(n, first)
    h[docs] *= total[:, None]
    for _ in range(steps):
        ratio = n / np.maximum(np.einsum("ij,ij->i", wt, h[row]), 1e-9)
        h[docs] *= np.add.reduceat(wt * ratio[:, None], first, axis=0)
    return h, n / np.maximum(np.einsum("ij,ij->i", wt, h[row]), 1e-9)


def about(flat: list, ends: list, h, w, k: int, enough: float, lead: float) -> np.ndarray:
    """For every document (row) the number of its sentences about each anchored component."""
    size, per = np.array([len(x) for x in flat]), np.array([len(e) for e in ends])
    x, doc = np.concatenate(flat), np.repeat(np.arange(len(flat)), size)
    r = w[x] * h[doc]
    r /= np.maximum(r.sum(1, keepdims=True), 1e-12)
    c = np.vstack([np.zeros((1, k)), np.cumsum(r[:, :k], 0, dtype=np.float64)])
    base = np.cumsum(size) - size
    stop = np.concatenate([e + b for e, b in zip(ends, base)]).astype(np.int64)
    start = np.concatenate([np.r_[b, e[:-1] + b] if len(e) else e for e, b in zip(ends, base)]).astype(np.int64)
    s = c[stop] - c[start]
    best = s.argmax(1) if len(s) else np.zeros(0, np.int64)
    top = s[np.arange(len(s)), best]
    ok = (top >= enough) & (top >= lead * s.sum(1))
    return np.bincount((np.repeat(np.arange(len(flat)), per) * k + best)[ok], minlength=len(flat) * k).reshape(len(flat), k).astype(float)


def subjects(articles: DataFrame, labels: DataFrame, areas: DataFrame, share: float = 0.25, least: float = 0.005, background: int = 3, rounds: int = 4, steps: int = 4, enough: float = 1.0, lead: float = 0.7, most_labels: int = 20_000) -> DataFrame:
    """(article_id, subject): every subject with at least `share` of an article's sentences about any subject."""
    spark = articles.sparkSession
    codes = sorted({r[0] for r in areas.select("subject").where("subject is not null").distinct().limit(64).collect()})  # the fixed list of areas
    if len(codes) > 63:
        raise ValueError("more than 63 subjects: their sets no longer fit into the bits of a long")
    k = len(codes)
    bit = F.create_map(*[x for i, c in enumerate(codes) for x in (F.lit(c), F.lit(1 << i))]) if codes else None
    known = labels.where("article_id is not null and subject is not null").where(F.col("subject").isin(codes))
    known = known.groupBy(F.col("article_id").alias("id")).agg(F.bit_or(bit[F.col("subject")]).cast("long").alias("mask")) if codes else labels.select(F.col("article_id").alias("id"), F.lit(None).cast("long").alias("mask")).limit(0)
    known = stored(known, "labels")
    fit = stored(known.orderBy(F.xxhash64(F.lit(3), "id")).limit(most_labels).select("id", F.col("mask").alias("fit")), "fit")  # what the factors are fitted on: at most most_labels rows
    docs = articles.select(F.col("id").alias("id"), F.col("content").alias("text")).where(F.col("id").isNotNull() & F.col("content").rlike(r"(?U)\S")).join(F.broadcast(fit), "id", "left")
    matrix = stored(coded(docs), "matrix")
    terms = vocabulary(matrix, least)
    v = max(1, len(terms))
    matrix = stored(weighed(matrix, terms), "weighed")

    def sums(w, first: bool):
        """One round: the W-step's numerators over all documents, by term."""
        wb = spark.sparkContext.broadcast(w)

        class Sums:
            def __init__(self):
                self.x = np.zeros((v, k + background))

            def flush(self):
                at = np.flatnonzero(self.x.any(1))
                return {"term": at.astype(np.int32), "x": list(self.x[at])} if len(at) else None

        def step(state, cols):
            row, term, n, allow = _batch(cols, k, background)
            if first:  # seeds: labelled documents feed their anchors, all documents the background
                labelled = np.array([m is not None for m in cols["fit"]])
                a = allow.copy()
                a[~labelled, :k] = 0
                a[:, :k] /= np.maximum(a[:, :k].sum(1, keepdims=True), 1)
                add = a[row] * n[:, None]
            else:
                h, ratio = h_step(row, term, n, allow, wb.value, steps)
                weight = np.where([m is not None for m in cols["fit"]], 4.0, 1.0)  # anchors pull more than other documents
                add = h[row] * (ratio * weight[row])[:, None]
            order = np.argsort(term, kind="stable")
            t = term[order]
            if len(t):
                at = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                state.x[t[at]] += np.add.reduceat(add[order], at, axis=0)
            return None

        got = map_batches(matrix.select("fit", "term", "n"), step, "term int, x array<double>", Sums, rows=100)
        by = got.groupBy("term").agg(*[F.sum(F.col("x")[i]).alias(f"x{i}") for i in range(k + background)])
        out = np.zeros((v, k + background))
        for r in by.collect():  # one row per term
            out[r[0]] = r[1:]
        return out

    w = np.zeros((v, k + background), np.float32)
    seed = sums(None, True) if len(terms) and k else np.zeros((v, k + background))
    fitted = bool(seed[:, :k].any())  # else only the labelled articles have subjects
    if fitted:
        base = seed[:, k:] / max(seed[:, k].sum(), 1e-9)
        anchored = seed[:, :k] / np.maximum(seed[:, :k].sum(0), 1e-9)
        rng = np.random.default_rng(9)
        w0 = np.c_[np.maximum(anchored - 0.7 * base[:, :1], 1e-3 * base[:, :1]) + 1e-9, base * rng.uniform(0.7, 1.3, base.shape) + 1e-9]
        w = (w0 / w0.sum(0)).astype(np.float32)
        for _ in range(rounds):
            w = w * sums(w, False)
            w = (w / np.maximum(w.sum(0), 1e-12) + 1e-9).astype(np.float32)
    wb = spark.sparkContext.broadcast(w)

    def name(_, cols):
        ids, subs = [], []
        row, term, n, allow = _batch(cols, k, background)
        flat, ends = [np.frombuffer(x, np.int32) for x in cols["flat"]], [np.frombuffer(x, np.int32) for x in cols["ends"]]
        h, _r = h_step(row, term, n, allow, wb.value, 3 * steps)
        counts = about(flat, ends, h, wb.value, k, enough, lead)
        for i, c in enumerate(counts):
            if c.sum():
                mine = np.flatnonzero(c >= share * c.sum() - 1e-9).tolist() or [int(c.argmax())]
            else:
                mine = [int(h[i, :k].argmax())] if len(flat[i]) and k else []
            ids += [cols["id"][i]] * len(mine)
            subs += [codes[j] for j in mine]
        return {"article_id": ids, "subject": subs} if ids else None

    found = map_batches(matrix if fitted else matrix.where("false"), name, "article_id long, subject string", rows=100)
    # given labels are kept as they are, however many; only ids and codes are shuffled for it
    given = known.select(F.col("id").alias("article_id"), "mask").join(matrix.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    given = given.select("article_id", F.explode(F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.lit(c)) for i, c in enumerate(codes)]))).alias("subject")) if codes else given.select("article_id", F.lit("").alias("subject")).limit(0)
    return found.join(known.select(F.col("id").alias("article_id")), "article_id", "left_anti").unionByName(given).distinct()


def shares(articles: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(subject, articles, share): the collection by subject; an article with two subjects counts half for each."""
    s = stored(subjects(articles, labels, areas), "subjects")
    per = s.groupBy("article_id").agg(F.count(F.lit(1)).alias("k"))
    by = s.join(per, "article_id").groupBy("subject").agg(F.count(F.lit(1)).alias("articles"), F.sum(1 / F.col("k")).alias("weight"))
    total = per.agg(F.count(F.lit(1)).alias("of"))
    return areas.select("subject").distinct().join(by, "subject", "left").crossJoin(F.broadcast(total)).select("subject", F.coalesce("articles", F.lit(0)).alias("articles"), F.coalesce(F.col("weight") / F.col("of"), F.lit(0.0)).alias("share"))  # beside one row
