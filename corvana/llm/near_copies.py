"""Problem 3: near-duplicate texts by pigeonhole blocks of a min-wise fingerprint.

A text's three-word shingle set becomes a fingerprint of `slots` 16-bit positions, each the minimum of the set
under one hash order; two fingerprints differ in a position with the probability 1 - Jaccard, so their Hamming
distance (in positions) measures the similarity. The fingerprint is split into `slots / width` blocks. A pair
that differs in fewer positions than there are blocks must agree in a whole block (pigeonhole); one that differs
in more still does unless the differences hit every block: at Jaccard 0.7 and the default 128 positions in
blocks of 4 that is (1 - 0.7^4)^32 = 1.5e-4 at the limit itself and vanishes quickly above it. Pairs that share a block are verified by Hamming distance (bound: 5.5
standard deviations beyond the mean at the limit), and then exactly on the shingle sets.

Texts with equal shingle sets form one class before any join, so a group of copies costs one row per member.
No bucket is capped; the block join is a plain equi-join that adaptive execution may split.

Defined results: null and blank content falls back to the title; texts without a word have no shingles and
join nothing; rows repeated under one id count once (the smallest class key, should texts differ); null ids are
ignored; extra columns are ignored.
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

_DROP = re.compile(r"[^\w\s]+")
_M = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """word -> 64-bit hash, emptied when large so that memory stays bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def words_of(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return _DROP.sub("", text.lower()).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str], hashes: dict, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    sets = []
    for t in texts:
        w = np.fromiter(map(hashes.__getitem__, words_of(t)), dtype=np.uint64)
        if len(w) >= n:
            m = len(w) - n + 1
            h = np.zeros(m, np.uint64)
            for k in range(n):
                h = _mix(h * _M + w[k : k + m])
        else:
            h = _mix(w + np.uint64(1))  # the words themselves, in a range of their own
        h.sort()
        sets.append(h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h)
    return sets


def fingerprints(sets: list[np.ndarray], slots: int, seed: int = 11) -> np.ndarray:
    """(len(sets), slots) uint16: minima of the non-empty sets under `slots` multiply-shift orders."""
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    allh = np.concatenate(sets)
    hi = (allh >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**32, slots, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 2**32, slots, dtype=np.uint32)
    lo = allh.astype(np.uint32)
    out = np.empty((len(sets), slots), np.uint16)
    for k in range(slots):
        v = hi * a[k]
        v ^= lo + b[k]
        v *= np.uint32(0x85EBCA6B)
        m = np.minimum.reduceat(v, at)
        m ^= m >> np.uint32(15)
        m *= np.uint32(0x2C1B3C6D)
        out[:, k] = (m >> np.uint32(16)).astype(np.uint16)
    return out


def _texts(articles: DataFrame) -> DataFrame:
    content = F.when(F.regexp_replace("content", r"(?U)[\s\u001C-\u001F\u0085 ]+", "") != "", F.col("content"))
    return articles.select(F.col("id").alias("id"), F.coalesce(content, F.col("title")).alias("text")).where("id is not null and text is not null")


def signed(texts: DataFrame, n: int, slots: int) -> DataFrame:
    """(id, c1, c2, size, fp): class key (128 bits of the sorted set), set size, fingerprint."""

    def sign(state, cols):
        sets = shingle_sets(cols["text"], state, n)
        keep = [i for i, s in enumerate(sets) if len(s)]
        if not keep:
            return None
        sets = [sets[i] for i in keep]
        fps = fingerprints(sets, slots)
        digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
        half, sign64 = (1 << 64) - 1, lambda x: x - (1 << 64) if x >> 63 else x
        return {
            "id": [cols["id"][i] for i in keep], "c1": [sign64(d >> 64) for d in digests], "c2": [sign64(d & half) for d in digests],
            "size": [len(s) for s in sets], "fp": [r.tobytes() for r in fps],
        }

    return map_batches(texts, sign, "id long, c1 long, c2 long, size int, fp binary", _Hashes)


def _hamming(pairs: DataFrame, slots: int, limit: int) -> DataFrame:
    def check(_, cols):
        a = np.frombuffer(b"".join(cols["fa"]), np.uint16).reshape(-1, slots)
        b = np.frombuffer(b"".join(cols["fb"]), np.uint16).reshape(-1, slots)
        ok = np.flatnonzero((a != b).sum(1) <= limit)
        return {"a": [cols["a"][i] for i in ok], "b": [cols["b"][i] for i in ok]} if len(ok) else None

    return map_batches(pairs, check, "a long, b long", rows=8000)


def similar(articles: DataFrame, limit: float = 0.7, n: int = 3, slots: int = 128, width: int = 4) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, rep) puts every text into the class of its shingle set, named by its
    smallest id; links (a, b, jaccard), a < b, are all pairs of representatives at or above `limit`.

    Small intermediate tables are written before they are joined, so that the planner knows their sizes and leaves
    the wide sides unshuffled as long as the small ones are within its broadcast threshold."""
    texts = _texts(articles)
    sig = stored(signed(texts, n, slots), "fingerprints")
    one = sig.groupBy("id").agg(F.min(F.struct("c1", "c2")).alias("c")).select("id", "c.c1", "c.c2")  # one row an article
    heads = stored(one.groupBy("c1", "c2").agg(F.min("id").alias("rep")), "heads")
    members = stored(one.join(heads, ["c1", "c2"]).select("id", "rep"), "members")
    fp = sig.join(heads.withColumnRenamed("rep", "id"), ["id", "c1", "c2"], "left_semi").groupBy("id").agg(F.any_value("fp").alias("fp"), F.any_value("size").alias("size"))
    fp = stored(fp, "representatives")

    no = F.explode(F.sequence(F.lit(0), F.lit(slots // width - 1))).alias("no")
    side = fp.select("id", "fp", no).select("id", F.xxhash64("no", F.expr(f"substring(fp, no * {2 * width} + 1, {2 * width})")).alias("block"))
    found = side.alias("x").join(side.alias("y"), "block").where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    found = stored(found, "candidates")
    far = int(slots * (1 - limit) + 5.5 * (slots * limit * (1 - limit)) ** 0.5)
    x, y = fp.select(F.col("id").alias("a"), F.col("fp").alias("fa"), F.col("size").alias("na")), fp.select(F.col("id").alias("b"), F.col("fp").alias("fb"), F.col("size").alias("nb"))
    near = found.join(x, "a").join(y, "b").where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(limit - 1e-9))
    near = stored(_hamming(near.select("a", "b", "fa", "fb"), slots, far), "near")

    def sets(state, cols):
        got = shingle_sets(cols["text"], state, n)
        return {"id": cols["id"], "shingles": [s.tobytes() for s in got]}

    need = stored(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "needed")
    chosen = texts.join(need, "id", "left_semi").dropDuplicates(["id"])
    full = stored(map_batches(chosen, sets, "id long, shingles binary", _Hashes), "shingles")

    def exact(_, cols):
        a, b, j = [], [], []
        for p, q, s, t in zip(cols["a"], cols["b"], cols["sa"], cols["sb"]):
            s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            sim = both / (len(s) + len(t) - both)
            if sim >= limit - 1e-12:
                a.append(p), b.append(q), j.append(sim)
        return {"a": a, "b": b, "jaccard": j} if a else None

    wide = near.join(full.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(full.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    return members, map_batches(wide.select("a", "b", "sa", "sb"), exact, "a long, b long, jaccard double", rows=4000)


def classes(articles: DataFrame, limit: float = 0.8, n: int = 5) -> DataFrame:
    """(id, rep, copies, links): one row per article with its class, the class's size and the representative's links."""
    members, links = similar(articles, limit, n)
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    size = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies")).join(ends, "rep", "left")
    return members.join(size, "rep").select("id", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"))
