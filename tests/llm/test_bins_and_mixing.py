import math
import os
import random

import pytest

from corvana.llm import bins, mixing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")
SCHEMA = "doc_id long, text string, lang string, source string, category string, tokens long, part int, container string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)


def test_counts_are_exact():
    c = tokens.Counter(tokens.VOCABULARY)
    for t in ["", "một hai", " một", "một ", "a  b", "a\n b", "Giá 3,5% – “tốt”.\r\n\tXong", "it's  \n\n x", "tab\tx y"]:
        assert c.count(t) == len(c.encoding.encode_ordinary(t)), t
    assert c.count(None) == 0


def test_local_search_keeps_items_and_never_loses():
    rng = random.Random(2)
    for _ in range(20):
        sizes = [rng.randrange(0, 101) for _ in range(rng.randrange(1, 150))]
        start = bins.first_fit(sizes, 100)
        n, fill = len(start), sum(sum(sizes[i] for i in b) ** 2 for b in start)
        end = bins.improve([list(b) for b in start], sizes, 100)
        assert sorted(i for b in end for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 100 for b in end)
        assert len(end) <= n and sum(sum(sizes[i] for i in b) ** 2 for b in end) >= fill


def test_packing(spark):
    rows = [(i, "từ " * (i * 7 % 900), "vi", "A", "x") for i in range(120)] + [(500, None, None, None, None), (501, "", None, None, None), (502, "dài " * 9000, "vi", "A", "x"), (7, "lặp", "vi", "A", "x")]
    d = docs(spark, rows)
    got = bins.packed(d, 512, group=30).collect()
    c = tokens.Counter(tokens.VOCABULARY)
    size = {}
    for r in got:
        size.setdefault(r["container"], []).append(r)
    assert sum(r["tokens"] for r in got) == sum(c.count(r[1]) for r in rows)
    for b in size.values():
        assert sum(r["tokens"] for r in b) <= 512 and {r["space_left"] for r in b} == {512 - sum(r["tokens"] for r in b)}
    for i, t, *_ in rows:
        parts = [r for r in got if r["doc_id"] == i]
        if i != 7 and i != 502 and c.count(t) <= 512:
            assert len(parts) == 1
    assert len([r for r in got if r["doc_id"] == 502]) == math.ceil(c.count("dài " * 9000) / 512)
    assert bins.packed(d.limit(0), 512).count() == 0
    rep = bins.report(d, 512, group=1000).first()
    assert rep["containers"] <= rep["least_containers"] * 1.02 + 2


def test_budgets():
    leaf = lambda s, share, room, d="d", l="l": {"source": s, "share": share, "room": room, "domain": d, "language": l}  # noqa: E731,E741
    got = mixing.budgets([leaf("a", 0.5, 1000), leaf("b", 0.5, 10)], 100)
    assert got == {"a": 90, "b": 10}
    got = mixing.budgets([leaf("a", 0.25, 25), leaf("b", 0.25, 10), leaf("c", 0.5, 1000, "e")], 100)
    assert got["a"] == 25 and got["b"] == 10 and round(got["c"], 6) == 65  # siblings are full, so the shortage goes up
    got = mixing.budgets([leaf("a", 0.2, 100), leaf("b", 0.2, 0), leaf("c", 0.6, 1000, "e")], 100)
    assert round(got["a"], 6) == 40 and round(got["c"], 6) == 60  # the sibling takes it before the other domain
    assert mixing.budgets([leaf("a", 1.0, 5)], 100) == {"a": 5}


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, "từ " * rng.randrange(1, 60), "vi", rng.choice("AAAAB"), "x") for i in range(600)] + [(1000, "ít lắm", "vi", "C", "x"), (1001, None, None, "A", None), (1002, "x", None, None, None), (1003, "x", None, "Z", None)]
    d = docs(spark, rows)
    t = spark.createDataFrame([("A", 0.5, 1), ("B", 0.4, 3), ("C", 0.05, 2), ("D", 0.05, 5), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    used = mixing.uses(d, t, floor=0.3).collect()
    assert len(used) == len(rows)
    most = {"A": 1, "B": 3, "C": 2}
    assert all(r["repeats"] <= most.get(r["source"], 0) for r in used)
    s = {r["source"]: r for r in mixing.shares(d, t, floor=0.3).collect()}
    total = sum(r["tokens"] * r["repeats"] for r in used)
    for k in "ABCD":
        assert abs(s[k]["actual_share"] - sum(r["tokens"] * r["repeats"] for r in used if r["source"] == k) / total) < 1e-9
    assert s["D"]["actual_share"] == 0 and abs(s["A"]["actual_share"] / s["B"]["actual_share"] - 1.25) < 0.05
    assert mixing.uses(d.limit(0), t).count() == 0 and mixing.shares(d, t.limit(0)).count() == 0
    same = {(r["doc_id"], r["repeats"]) for r in mixing.uses(d, t, floor=0.3).collect()}
    assert same == {(r["doc_id"], r["repeats"]) for r in used}


def test_two_for_one_in_bins_of_many_items():
    """A bin of more than 48 items gives two of them for one larger item."""
    sizes = [1] * 48 + [30] + [20, 20] + [45]
    start = [list(range(51)), [51]]
    assert sum(sizes[i] for i in start[0]) == 118
    end = bins.improve([list(b) for b in start], sizes, 123)
    assert sorted(i for b in end for i in b) == list(range(52))
    assert max(sum(sizes[i] for i in b) for b in end) == 123


def test_rows_with_one_id_lie_in_containers_of_their_own(spark):
    d = docs(spark, [(1, "dài " * 3000, "vi", "A", "x"), (1, "dài " * 3000, "vi", "A", "x"), (None, "dài " * 3000, "vi", "A", "x"), (None, "dài " * 3000, "vi", "A", "x")])
    by = {}
    for r in bins.packed(d, 512).collect():
        by[r["container"]] = by.get(r["container"], 0) + r["tokens"]
    assert max(by.values()) <= 512
