"""Duplicate removal by shingle similarity: an exact set-similarity join, and the keep-first rule.

The join finds all pairs without writing the sets. Two sets of n and n' elements with Jaccard t or more differ in at most
d = (n + n')(1 - t)/(1 + t) elements. If the elements are dealt by a hash to more than d parts, at most d parts of one
set differ from the other's; so of any d + 1 parts one is the same in both (pigeonhole). A set therefore signs with its
d + 1 strongest parts, strongest meaning most elements and then a hash of what the part holds: of two sets, the one with
the higher limit has an equal part at or above it, which the other signs with, too. Such a part holds several elements,
so unrelated sets seldom meet. d depends on the sizes of a pair, so sizes fall into classes of the ratio t: a pair lies in
one class or in two neighbouring ones, and each set signs for its own class and, as the larger one, for the class below.
Sets that meet are compared in full, on elements made again from the texts.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from corvana.functions.arrow import map_batches
from corvana.session import stored

PARTS = 1024  # groups of signatures; those of one group meet in one task
MORE = 3  # signatures, besides one, in which a pair must agree where the sets are large enough; 3 at most
_ELEMENTS, _SIGNATURES, _PAIRS = 1_000_000, 3_000_000, 200_000  # taken at once in a task
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_text(content: Column, title: Column) -> Column:
    return F.coalesce(F.when(content != "", content), title)


def word_list(c: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", ""), r"(?U)\s+", " ")), " "), lambda w: w != "")


def shingles(df: DataFrame, key: str, text: Column, n: int = 3) -> DataFrame:
    """(key, grams, size): distinct word n-grams; texts of fewer than n words have their words; wordless texts none."""
    w = df.select(F.col(key).alias(key), word_list(text).alias("w")).where(F.size("w") > 0)
    shifted = [F.slice("w", i + 1, F.greatest(F.size("w") - (n - 1), F.lit(1))) for i in range(n)]
    zipped = F.transform(F.arrays_zip(*[s.alias(f"s{i}") for i, s in enumerate(shifted)]), lambda x: F.concat_ws(" ", *[x[f"s{i}"] for i in range(n)]))
    grams = F.array_distinct(F.when(F.size("w") < n, F.col("w")).otherwise(zipped))
    return w.select(key, grams.alias("grams")).withColumn("size", F.size("grams"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _sets(h: pa.ListArray, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets of sorted 64-bit elements) for slices of the rows: elements as they are, or n-grams of words."""
    at, flat = np.asarray(h.offsets).astype(np.int64), np.asarray(h.values).view(np.uint64)
    first = 0
    while first < len(h):
        last = max(first + 1, int(np.searchsorted(at, at[first] + _ELEMENTS, "right")) - 1)
        w = _mix(flat[at[first] : at[last]] + _B)
        grams = np.zeros(max(len(w) - n + 1, 0), np.uint64)
        for k in range(n):
            grams = _mix(grams * _A + w[k : k + len(grams)])
        sets = []
        for a, b in zip((at[first:last] - at[first]).tolist(), (at[first + 1 : last + 1] - at[first]).tolist()):
            s = np.sort(grams[a : b - n + 1] if 0 < n <= b - a else w[a:b])
            sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s)
        yield first, sets
        first = last


def _class_keys(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little") for s in sets], np.uint64)


def _size_classes(most: int, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(low, d): first size of each class, and the most elements in which a pair differs whose smaller set is in it."""
    low = [1]
    while low[-1] <= most:
        low.append(max(low[-1] + 1, int(np.ceil(low[-1] / t - 1e-9))))
    top = np.array(low[1:] + [int(np.ceil(low[-1] / t)) + 1], np.int64) - 1
    return np.array(low, np.int64), np.floor((top + np.floor(top / t + 1e-9)) * (1 - t) / (1 + t) + 1e-6).astype(np.int64)


def _signatures(sets: list[np.ndarray], t: float) -> tuple[np.ndarray, np.ndarray]:
    """(number of the set, signature), for all sets. The lowest three bits of a signature are: in how many besides one
    a pair must agree (0 to 3), and whether the set signs as the larger one; two larger ones meet in their own class."""
    size = np.array([len(s) for s in sets], np.int64)
    low, d = _size_classes(int(size.max(initial=1)), t)
    allh = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    place, value = _mix(allh * _A + _B) >> np.uint64(32), (_mix(allh + _A) >> np.uint64(24)).astype(np.float64)
    who, signs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for back in (0, 1):
        k = np.searchsorted(low, size, "right") - 1 - back
        use = (size > 0) & (k >= 0)
        k = np.maximum(k, 0)
        use &= d[k] > 0  # in which nothing may differ only equal sets are similar
        if back:
            use &= np.ceil(size * t - 1e-9) < low[np.minimum(k + 1, len(low) - 1)]  # else it has no smaller partner there
        more = np.minimum(d[k] // 4, MORE)
        taken = d[k] + 1 + more
        m = np.where(use, taken + 2 + taken // 10, 0)
        base = np.concatenate(([0], np.cumsum(m)))
        each = np.repeat(use, size)
        slot = np.repeat(base[:-1], size)[each] + ((place[each] * np.repeat(m, size)[each].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        count = np.bincount(slot, minlength=base[-1])
        held = np.bincount(slot, weights=value[each], minlength=base[-1])  # equal elements are added in equal order
        owner = np.repeat(np.arange(len(sets)), m)
        no = np.arange(base[-1]) - base[owner]
        sign = _mix(_mix(held.view(np.uint64) + count.astype(np.uint64) * _A) + (no + (k[owner] << 32)).astype(np.uint64) * _B)
        order = np.lexsort((~sign, -count, owner))
        order = order[no < taken[owner]]  # owners stand in order, so the numbers are also the ranks of the sorted parts
        who.append(owner[order])
        signs.append((sign[order] & ~np.uint64(7)) | (more[owner[order]].astype(np.uint64) << np.uint64(1)) | np.uint64(back))
    return np.concatenate(who), np.concatenate(signs)


_ENTRY = np.dtype([("s", "<u4"), ("c", "<u8")])


class _Packed:
    """Signatures of a task, packed by group."""

    def __init__(self) -> None:
        self.s, self.c, self.n = [], [], 0

    def add(self, s: np.ndarray, c: np.ndarray) -> None:
        self.s.append(s)
        self.c.append(c)
        self.n += len(s)

    def take(self) -> tuple[list[int], list[bytes]]:
        s, c = np.concatenate(self.s), np.concatenate(self.c)
        self.__init__()
        order = np.argsort(s)
        s, c = s[order], c[order]
        entries = np.empty(len(s), _ENTRY)
        entries["s"], entries["c"] = ((s >> np.uint64(22)) & np.uint64(0xFFFFFFF8) | s & np.uint64(7)).astype(np.uint32), c
        cut = np.searchsorted((s >> np.uint64(54)).astype(np.int64), np.arange(PARTS + 1))
        kept = [p for p in range(PARTS) if cut[p] < cut[p + 1]]
        return kept, [entries[cut[p] : cut[p + 1]].tobytes() for p in kept]


def _met(s: np.ndarray, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, n, need), a < b: pairs of sets that share n signatures, of which they need `need`; a pair may come again."""
    s, lowest = s >> 3, (s & 7).astype(np.uint8)
    order = np.lexsort((c, s))
    s, c, lowest = s[order], c[order], lowest[order]
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])))
    s, c, lowest = s[new], c[new], lowest[new]
    starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    ends = np.repeat(np.append(starts[1:], len(s)), np.diff(np.append(starts, len(s))))
    i, step, got, n = np.flatnonzero(ends - np.arange(len(s)) > 1), 1, [], 0
    while len(i):
        j = i[((lowest[i] & lowest[i + step]) & 1) == 0]
        got.append(np.rec.fromarrays([c[j], c[j + step], lowest[j] >> 1], names="a,b,more"))
        n += len(j)
        step += 1
        i = i[ends[i] - i > step]
        if n >= _PAIRS or not len(i):
            pairs, times = np.unique(np.concatenate(got), return_counts=True)
            if len(pairs):
                yield pairs["a"], pairs["b"], times.astype(np.int32), pairs["more"].astype(np.int32) + 1
            got, n = [], 0


def _marked(df: DataFrame, threshold: float, n: int) -> DataFrame:
    """(id, x, cls) of each row of (id, x, h), and in rows of their own (a, b, n, need): classes that share signatures.

    The texts are read once: what is known of a row goes with its signatures through the one exchange."""
    about = [StructField("id", df.schema["id"].dataType), StructField("x", LongType()), StructField("cls", LongType())]
    sent = StructType([StructField("part", IntegerType()), StructField("signs", BinaryType()), *about])
    got = StructType([*about, StructField("a", LongType()), StructField("b", LongType()), StructField("n", IntegerType()), StructField("need", IntegerType())])
    sent_arrow, got_arrow = to_arrow_schema(sent), to_arrow_schema(got)

    def rows(schema: pa.Schema, **cols) -> pa.RecordBatch:
        length = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(length, f.type) for f in schema], schema=schema)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = _Packed()
        for b in batches:
            for first, sets in _sets(b.column(2), n):
                cls = _class_keys(sets)
                who, signs = _signatures(sets, threshold)
                packed.add(signs, cls[who])
                at = np.array([i for i, e in enumerate(sets) if len(e) or not n], np.int64)
                about_rows = {"id": b.column(0).take(pa.array(first + at)), "x": b.column(1).take(pa.array(first + at)), "cls": cls[at].view(np.int64)}
                yield rows(sent_arrow, part=(cls[at] >> np.uint64(54)).astype(np.int32), **about_rows)
                if packed.n > _SIGNATURES:
                    part, blobs = packed.take()
                    yield rows(sent_arrow, part=part, signs=blobs)
        if packed.n:
            part, blobs = packed.take()
            yield rows(sent_arrow, part=part, signs=blobs)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = defaultdict(list)
        for b in batches:
            plain = b.filter(b.column("signs").is_null())
            if plain.num_rows:
                yield rows(got_arrow, **{f.name: plain.column(f.name) for f in about})
            for p, blob in zip(b.column("part").to_pylist(), b.column("signs").to_pylist()):
                if blob is not None:
                    groups[p].append(blob)
        while groups:
            e = np.frombuffer(b"".join(groups.popitem()[1]), _ENTRY)
            for a, b, times, need in _met(e["s"], e["c"]):
                yield rows(got_arrow, a=a.view(np.int64), b=b.view(np.int64), n=times, need=need)

    return df.mapInArrow(sign, sent).repartition("part").mapInArrow(meet, got)


def _classes(df: DataFrame, elements: Column, threshold: float, n: int) -> tuple[DataFrame, DataFrame]:
    """(members, links) of rows (id, x, ...) with the hashes of their elements, or of their words for n-grams.

    members (id, cls) puts each row into the class of its set; rows equal in id and x count once, and rows without a word
    do not count. links (a, b, jaccard), each pair once, are all pairs of classes at or above the threshold."""
    df = df.where("id is not null")
    marks = stored(_marked(df.select("id", "x", elements.alias("h")), threshold, n), "marks")
    rows = marks.where("cls is not null").select("id", "x", "cls").distinct()
    met = marks.where("a is not null").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
    met = stored(met.where("n >= need").select("a", "b"), "met")
    ends = met.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    heads = stored(rows.join(ends, "cls").groupBy("cls").agg(F.min("id").alias("id")), "heads")

    def full(_, cols):
        sets = [s for _, part in _sets(pa.array(cols["h"], pa.list_(pa.int64())), n) for s in part]
        return {"cls": _class_keys(sets).view(np.int64), "s": [s.tobytes() for s in sets]}

    again = map_batches(df.join(heads.select("id").distinct(), "id", "left_semi").select(elements.alias("h")), full, "cls long, s binary")
    sets = stored(again.join(heads.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.any_value("s").alias("s")), "sets")

    def compare(_, cols):
        a, b, j = [], [], []
        for p, q, s, t in zip(cols["a"], cols["b"], cols["sa"], cols["sb"]):
            s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            jaccard = both / (len(s) + len(t) - both)
            if jaccard >= threshold - 1e-12:
                a.append(p), b.append(q), j.append(jaccard)
        return {"a": a, "b": b, "jaccard": j} if a else None

    wide = met.join(sets.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b")
    links = stored(map_batches(wide.select("a", "b", "sa", "sb"), compare, "a long, b long, jaccard double"), "links")
    return rows.select("id", "cls"), links


def text_classes(df: DataFrame, key: str, text: Column, threshold: float = 0.85, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the texts' shingle sets, see `_classes`; rows of one key and text count once."""
    t = df.select(F.col(key).alias("id"), text.alias("t")).where("t is not null").select("id", F.xxhash64("t").alias("x"), "t")
    return _classes(t, F.transform(word_list(F.col("t")), lambda w: F.xxhash64(w)), threshold, n)


def class_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, jaccard), a < b: the pairs of members of one class or of linked classes."""
    m1, m2 = members.select(F.col("cls").alias("a"), F.col("id").alias("i")), members.select(F.col("cls").alias("b"), F.col("id").alias("k"))
    cross = links.join(m1, "a").join(m2, "b").where("i <> k").select("i", "k", "jaccard")
    own = m1.join(m2, m1["a"] == m2["b"]).where("i < k").select("i", "k", F.lit(1.0).alias("jaccard"))
    return cross.union(own).select(F.least("i", "k").alias("a"), F.greatest("i", "k").alias("b"), "jaccard")


def similar_pairs(sets: DataFrame, key: str, threshold: float = 0.85) -> DataFrame:
    """(a, b, jaccard), a < b, exactly, of sets (key, grams); equal sets are one class, so copies cost one row each."""
    rows = sets.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("x"), "grams")
    return class_pairs(*_classes(rows, F.transform("grams", lambda g: F.xxhash64(g)), threshold, 0))


def dropped_pairwise(pairs: DataFrame) -> DataFrame:
    """Ids with any earlier similar text."""
    return pairs.select(F.col("b").alias("id")).distinct()


def dropped_pairwise_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """The same from classes: ids above the smallest one of their class or of a linked class; no pair is made."""
    low = members.groupBy("cls").agg(F.min("id").alias("low"))
    both = links.select("a", "b").union(links.select("b", "a"))
    near = both.join(low, both["b"] == low["cls"]).select(F.col("a").alias("cls"), "low").union(low).groupBy("cls").agg(F.min("low").alias("low"))
    return members.join(near, "cls").where("id > low").select("id").distinct()


def dropped_greedy(pairs: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Ids dropped when texts are seen in the order of their ids and compared with the kept ones only.

    Each round keeps the undecided texts without an undecided earlier neighbour and drops their later neighbours;
    a chain of n texts takes at most n rounds, and only undecided edges go on to the next one."""
    edges = stored(pairs.select("a", "b"), "edges")
    gone = None
    for _ in range(most_rounds):
        if edges.limit(1).count() == 0:
            break
        kept = edges.select(F.col("a").alias("id")).distinct().join(edges.select(F.col("b").alias("id")), "id", "left_anti")
        drop = stored(edges.join(kept, edges["a"] == kept["id"], "left_semi").select(F.col("b").alias("id")).distinct(), "dropped")
        gone = drop if gone is None else gone.union(drop)
        rest = edges.join(kept, edges["a"] == kept["id"], "left_anti")
        edges = stored(rest.join(drop, rest["a"] == drop["id"], "left_anti").join(drop, F.col("b") == drop["id"], "left_anti"), "edges")
    else:
        raise RuntimeError("keep-first did not settle")
    return gone if gone is not None else pairs.select(F.col("b").alias("id")).limit(0)


def dropped_greedy_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """The same from classes: copies of a class's first text go with it or with what drops it, so they need no pairs.

    Only where the first id of a class has another text in another class are its copies compared one by one."""
    several = members.groupBy("id").agg(F.countDistinct("cls").alias("n")).where("n > 1").select("id")
    low = members.groupBy("cls").agg(F.min("id").alias("low"))
    first = low.join(several.withColumnRenamed("id", "low"), "low", "left_anti")
    copies = stored(members.join(first, "cls").where("id > low").select("id").distinct(), "copies")
    rest = members.join(copies, "id", "left_anti")
    return copies.union(dropped_greedy(class_pairs(rest, links)))
