import itertools
import random
import unicodedata

import pytest

from corvana.llm import near_copies, queries, site_lines


def plain_repeated(rows, least, share):
    import re

    form = lambda x: re.sub("[0-9]+", "0", re.sub(r"\s+", " ", unicodedata.normalize("NFC", x).lower()).strip())
    per, docs = {}, {}
    for i, s, c in rows:
        if i is None or s is None:
            continue
        docs.setdefault(s, set()).add(i)
        for x in (c or "").split("\n") if c is not None else ():
            if form(x):
                per.setdefault((s, form(x)), set()).add(i)
    often = {k for k, v in per.items() if len(v) >= least and len(v) >= share * len(docs[k[0]])}
    return {(i, n) for i, s, c in rows if i is not None and s is not None and c is not None for n, x in enumerate(c.split("\n")) if (s, form(x)) in often}


def test_repeated_lines_edges(spark, articles):
    rows = [(r["id"], r["source"], r["content"]) for r in articles.collect()]
    want = plain_repeated(rows, 2, 0.5)
    assert want and {tuple(r) for r in site_lines.repeated_lines(articles, 2, 0.5).collect()} == want
    clean = {r["article_id"]: r["content"] for r in site_lines.without_repeated_lines(articles, 2, 0.5).collect()}
    assert clean[2] == "Khác 12" and clean[5] is None and clean[4] == "chia sẻ" and set(clean) == set(range(1, 9))
    assert site_lines.repeated_lines(articles.limit(0)).count() == 0


def test_repeated_lines_random(spark):
    rng = random.Random(7)
    pool = [f"Dòng {k}" + " x" * k for k in range(30)]
    rows = [(i, rng.choice("AAAAAAB"), "\n".join(rng.choice(pool[: rng.choice([3, 30])]) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(6)))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, source string, content string")
    got = {tuple(r) for r in site_lines.repeated_lines(df, 3, 0.4).collect()}
    assert got == plain_repeated(rows, 3, 0.4)


def plain_pairs(rows, limit, n):
    sets = {}
    for i, t, c in rows:
        x = c if c and c.strip() else t
        if i is None or x is None:
            continue
        w = near_copies.words_of(x)
        s = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else set(w)
        if s:
            sets[i] = s
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= limit}


def test_pairs_edges(spark, articles):
    rows = [(r["id"], r["title"], r["content"]) for r in articles.collect()]
    got = [tuple(r) for r in queries._copy_pairs(articles).collect()]
    assert set(got) == plain_pairs(rows, 0.7, 3) and len(got) == len(set(got)) and (5, 6) in got
    assert queries._copy_pairs(articles.limit(0)).count() == 0


def test_pairs_random_with_a_hot_group(spark):
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = [f"t{rng.randrange(500)}" for _ in range(rng.choice([8, 30, 120]))]
        for _ in range(30 if g == 0 else rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 12) + 1)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(500)}"
            rows.append((len(rows), "t", " ".join(w)))
    df = spark.createDataFrame(rows, "id long, title string, content string")
    want = plain_pairs(rows, 0.7, 3)
    got = {tuple(r) for r in queries._copy_pairs(df).collect()}
    assert got <= want and len(got) >= 0.998 * len(want)
    c = {r["id"]: r for r in near_copies.classes(df, 0.8, 5).collect()}
    assert set(c) == {r[0] for r in rows} and all(c[r["rep"]]["rep"] == r["rep"] for r in c.values())


@pytest.mark.parametrize("text", ["", "!!! ...", "một", "a b c " * 5000])
def test_shingle_sets(text):
    s = near_copies.shingle_sets([text], near_copies._Hashes(), 3)[0]
    assert len(s) == len(set(s.tolist())) and (len(s) > 0) == bool(near_copies.words_of(text))
