import itertools
import math
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvana.llm import levels, main_text, names, queries, subjects
from corvana.llm.components import components


def test_messages_against_enumeration():
    rng = random.Random(6)
    for _ in range(30):
        n = rng.randrange(1, 7)
        parent = [-1] + [rng.randrange(-1, i) for i in range(1, n)]
        node = [rng.uniform(-2, 2) for _ in range(n)]
        tables = {i: tuple(tuple(rng.uniform(0.1, 1) for _ in range(2)) for _ in range(2)) for i in range(n)}
        weight = {}
        for s in itertools.product((0, 1), repeat=n):
            w = 1.0
            for i in range(n):
                w *= math.exp(node[i] * s[i]) * (tables[i][s[parent[i]]][s[i]] if parent[i] >= 0 else tables[i][0][s[i]] + tables[i][1][s[i]])
            weight[s] = w
        full, joint = main_text.up_down(parent, list(range(n)), node, tables, ((1, 1), (1, 1)))
        z = sum(weight.values())
        for i in range(n):
            p = sum(w for s, w in weight.items() if s[i]) / z
            assert abs(1 / (1 + math.exp(-full[i])) - p) < 1e-9
            assert abs(joint[i][1] + joint[i][3] - p) < 1e-9


def page(rng, i):
    words = [f"{a}{b}" for a in "bcdghklmn" for b in ("a", "o", "inh", "ương", "ên")]
    topic = rng.sample(words, 8)
    s = lambda n: " ".join(rng.choice(topic) for _ in range(n)).capitalize()
    lines = [("F", f"Trang nhất | Mục {rng.randrange(3)} | Ảnh"), ("F", "Đăng ký nhận bản tin hôm nay")]
    lines += [("S", s(rng.randrange(14, 30)) + ".") for _ in range(4)] + [("S", s(6))] + [("S", s(20) + ".")]
    if rng.random() < 0.6:
        lines += [("F", "Tin khác cho bạn")] + [("F", "- " + " ".join(rng.sample(words, 7)).capitalize()) for _ in range(3)] + [("S", s(22) + ".")]
    lines += [("F", "Về đầu trang"), ("F", f"Đường dây nóng: 09{rng.randrange(10**6)}")]
    return "\n".join(x for _, x in lines), {n for n, (m, _) in enumerate(lines) if m == "F"}


def test_main_text(spark, articles):
    rng = random.Random(8)
    made = [page(rng, i) for i in range(250)]
    rows = [(i, "T", "S", t) for i, (t, _) in enumerate(made)] + [(0, "T", "S", made[0][0])]
    df = spark.createDataFrame(rows, "id long, title string, source string, content string")
    out = [tuple(r) for r in main_text.furniture_lines(df).collect()]
    assert len(out) == len(set(out))
    got, want = set(out), {(i, n) for i, (_, f) in enumerate(made) for n in f}
    assert len(got & want) / len(got) > 0.95 and len(got & want) / len(want) > 0.9
    edge = main_text.furniture_lines(articles).collect()  # nulls, blanks, one very long line
    assert {r["article_id"] for r in edge} <= set(range(1, 9))
    assert main_text.furniture_lines(articles.limit(0)).count() == 0
    assert {r["article_id"] for r in main_text.stories(articles).collect()} == set(range(1, 9))


def test_main_text_of_many_groups(spark):
    rng = random.Random(8)
    made = [page(rng, i) for i in range(250)]
    df = spark.createDataFrame([(i, "S", t) for i, (t, _) in enumerate(made)], "id long, source string, content string")
    got = {tuple(r) for r in main_text.furniture_lines(df, group_pages=60).collect()}
    want = {(i, n) for i, (_, f) in enumerate(made) for n in f}
    assert len(got & want) / len(got) > 0.95 and len(got & want) / len(want) > 0.9


def test_heads_of_all_pages(spark):
    text = lambda i: "Tin khác\n- mục riêng " + chr(97 + i) + "\n- bài riêng " + chr(97 + i) if i < 12 else "Chia sẻ\nMột câu dài hơn một chút."
    rows = [(i, text(i), "S") for i in range(25)]
    lines = main_text.lines_by_page(spark.createDataFrame(rows, "u long, text string, source string")).cache()
    key = {x: main_text._key(main_text.form(x, "s")) >> 3 for x in ("Tin khác", "Chia sẻ")}
    marks = spark.createDataFrame([(i, [(key["Tin khác" if i < 12 else "Chia sẻ"] << 3) + 3]) for i in range(25)], "u long, codes array<long>")
    assert [r["label"] for r in main_text.list_heads(lines, marks).collect()] == [key["Tin khác"]]


def test_groups_are_averaged(spark):
    rows = []
    for words in ({"a": 1.0, "b": 4.0}, {"a": 3.0}):
        rows += main_text.fitted(main_text.Model({"x": 2.0}, words, -1.0, {}), {"e": [5.0, 1.0, 1.0, 3.0]})
    got = main_text.averaged(spark.createDataFrame(rows, "kind string, name string, values array<double>"))
    assert (got.weights, got.words, got.bias) == ({"x": 2.0}, {"a": 2.0, "b": 2.0}, -1.0)
    assert got.tables == main_text._tables({"e": [5.0, 1.0, 1.0, 3.0]})


def read(made, reader):
    """Pages of (text, source), every second line as widely repeated as it can be."""
    codes = [[(main_text._key(f) >> 3 << 3) + 3 + 4 * (i == 8) for i, (_, _, f) in enumerate(main_text.lines_of(t, main_text._lower(s))) if i % 2 == 0] for t, s in made]
    return [p for _, p in main_text.read_pages([t for t, _ in made], [s for _, s in made], codes, reader)]


def test_messages_of_many_pages():
    rng = np.random.default_rng(3)
    sizes = [4, 0, 1, main_text._LONG + 30, 9, main_text._LONG]
    at = np.cumsum([0, *sizes])
    parent = np.array([a + rng.integers(0, i) if i and rng.random() < 0.9 else -1 for a, n in zip(at, sizes) for i in range(n)])
    edge, node, t = rng.integers(0, 5, at[-1]), rng.normal(0, 3, at[-1]), rng.uniform(0.1, 1, (5, 2, 2))
    full, joint = main_text.up_down_all(at, parent, edge, node, t)
    for a, z in itertools.pairwise(at.tolist()):
        own = [q - a if q >= 0 else -1 for q in parent[a:z].tolist()]
        want, both = main_text.up_down(own, edge[a:z].tolist(), node[a:z].tolist(), dict(enumerate(t.tolist())), None)
        assert np.allclose(full[a:z], want, atol=1e-9) and np.allclose(joint[a:z], np.array(both).reshape(-1, 4), atol=1e-9)


def test_wording_in_common_against_sets(monkeypatch):
    rng = random.Random(2)
    line = lambda: " ".join(rng.choice("abcd") for _ in range(rng.randrange(14))) + rng.choice(["", "."])
    made = [("\n".join(line() for _ in range(rng.randrange(12))), None) for _ in range(60)]
    monkeypatch.setattr(main_text, "_CHARS", 500)  # several runs of pages
    reader = main_text.Reader()
    share, flags = [], []
    for p in read(made, reader):
        share += p.overlap.tolist()
        flags += p.shared.tolist()
    want, known = [], []
    for t, _ in made:
        lines = [main_text._WORD.findall(f) for _, _, f in main_text.lines_of(t, "")]
        full = [len(w) >= 8 and main_text.is_closed(x) for (_, x, _), w in zip(main_text.lines_of(t, ""), lines)]
        pairs = [set(zip(w, w[1:])) for w in lines]
        least = lambda n: {x for s in pairs for x in s if sum(x in q for q, c in zip(pairs, full) if c) >= n}
        want += [len(s & least(2 if c else 1)) / len(s) if s else 0.0 for s, c in zip(pairs, full)]
        known += [x in least(2) for w in lines for x in [*zip(w, w[1:]), *[None] * bool(w)]]
    assert share == want and flags == known and any(flags)


@pytest.mark.parametrize("f", ["", "»", "một, hai-ba: bốn.", "tin_tức (mới) 0%", "a\u0301o dài", "½ ² đ/c"])
def test_words_are_runs_of_letters_and_digits(f):
    assert main_text.words_of(f) == main_text._WORD.findall(f)


def test_forms_of_a_page_are_those_of_its_lines():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("aΣσςİ19é\u0301Đ\t\r\x0b\x85 .,-_'\n\n@§%½") for _ in range(rng.randrange(30)))
        source = main_text._lower(rng.choice([None, "a", "1 9", "Σ", "a.", " ", "9"]))
        lines = main_text.unicodedata.normalize("NFC", text).split("\n")
        want = [(i, x.strip(), f) for i, x in enumerate(lines) if (f := main_text.form(x, source))]
        assert main_text.lines_of(text, source) == want
        assert all(main_text.words_of(f) == main_text._WORD.findall(f) for _, _, f in want)


def test_weights_against_dense_descent():
    rng = random.Random(4)
    rows = [(tuple(rng.sample("pqrs", rng.randrange(1, 4))), [rng.randrange(9) for _ in range(rng.randrange(6))], rng.randrange(2), rng.choice([1.0, 3.0])) for _ in range(80)]
    weights, words, bias = main_text._logistic(rows, steps=60)
    names = [*"pqrs", *range(9)]
    x = np.array([[r[0].count(n) if n in "pqrs" else 0 for n in "pqrs"] + [r[1].count(n) / math.sqrt(len(r[1]) or 1) for n in range(9)] + [1] for r in rows])
    y, k = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    w, m, v = np.zeros(14), np.zeros(14), np.zeros(14)
    for t in range(1, 61):
        g = x.T @ ((1 / (1 + np.exp(-x @ w)) - y) * k / k.sum()) + 3e-5 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    assert np.allclose([*((weights | words)[n] for n in names), bias], w, atol=1e-9)


def test_a_line_has_the_words_of_its_own_source():
    made = [("Bản tin Sông Mới mỗi sáng", "Sông Mới"), ("Bản tin Sông Mới mỗi sáng", None)]
    for order in (made, made[::-1]):
        reader = main_text.Reader()
        p, names = read(order, reader)[0], list(reader.words)
        got = {s: [names[w] for w in p.word[a:z]] for (_, s), a, z in zip(order, p.start, p.start[1:])}
        assert got == {"Sông Mới": ["bản", "tin", "mỗi", "sáng"], None: ["bản", "tin", "sông", "mới", "mỗi", "sáng"]}


def test_packed_pages_are_judged_the_same():
    rng = random.Random(8)
    reader = main_text.Reader()
    (p,) = read([*((page(rng, i)[0], "S") for i in range(40)), ("", None), ("»", None)], reader)
    model, _ = main_text.train([p], reader)
    ids, got, names = main_text.Pages.unpacked(p.packed(list(range(42)), reader))
    assert ids.tolist() == list(range(42)) and got.no.tolist() == p.no.tolist() and got.at.tolist() == p.at.tolist()
    assert model.furniture(got, names).tolist() == model.furniture(p, reader).tolist()


def test_training_loops_over_lines_not_over_words():
    rng = random.Random(8)
    reader, calls = main_text.Reader(), 0

    def count(_frame, event, _arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    made = [(page(rng, i)[0], "S") for i in range(300)]
    sys.setprofile(count)
    try:
        batches = read(made, reader)
        main_text.train(batches, reader)
    finally:
        sys.setprofile(None)
    assert calls / sum(len(p.no) for p in batches) < 120


def test_pages_are_read_once_for_training_and_judging(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, "S", page(rng, i)[0]) for i in range(30)], "id long, source string, content string")
    out = main_text.furniture_lines(df)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()  # no text is joined or parsed again


def test_subjects(spark, articles):
    rng = random.Random(9)
    lex = {"law": ["tòa án xét xử", "bị cáo nhận tội", "luật sư bào chữa"], "sport": ["đội bóng ghi bàn", "trọng tài thổi phạt", "khán giả hò reo"], "farming": ["nông dân gặt lúa", "vườn cây trái ngọt", "đàn bò ăn cỏ"]}
    plain = ["hôm nay trời rất đẹp", "mọi người đều có mặt", "kết quả còn phải chờ"]
    rows, truth = [], {}
    for i in range(300):
        subs = rng.sample(list(lex), rng.choice([1, 1, 2]))
        text = []
        for _ in range(16):
            k = rng.choice(subs) if rng.random() < 0.7 else None
            text.append((rng.choice(lex[k]) + " " + rng.choice(plain) if k else rng.choice(plain) + " thôi nhé").capitalize() + ".")
        rows.append((i, " ".join(text)))
        truth[i] = set(subs)
    df = spark.createDataFrame(rows, "id long, content string").withColumns({"subject": F.lit("x"), "mask": F.lit(5), "at": F.lit(0), "text": F.lit("y"), "term": F.lit("z")})
    lab = spark.createDataFrame([(i, s) for i in range(0, 300, 6) for s in sorted(truth[i])] + [(0, None), (None, "law"), (1, "unknown")], "article_id long, subject string")
    areas = spark.createDataFrame([(s, "v") for s in lex] + [(None, "v")], "subject string, label_vi string")
    got = {}
    for r in subjects.subjects(df, lab, areas).collect():
        got.setdefault(r["article_id"], set()).add(r["subject"])
    held = [i for i in range(300) if i % 6]
    assert sum(got.get(i) == truth[i] for i in held) / len(held) > 0.9
    assert all(got[i] == truth[i] for i in range(0, 300, 6))
    assert subjects.subjects(articles, lab.limit(0), areas).count() == 0
    assert subjects.subjects(df.limit(0), lab, areas).count() == 0
    subjects.subjects(articles, lab, areas).collect()
    assert abs(sum(r["share"] for r in subjects.shares(df, lab, areas).collect()) - 1) < 0.05


def test_levels(spark):
    rng = random.Random(10)
    easy, hard = [f"mèo{c}" for c in "abcdefghij"], [f"thiết{i}" for i in range(400)]
    rows, truth = [], {}
    for i in range(400):
        k = rng.randrange(4)
        text = " ".join(" ".join(rng.choice(hard if rng.random() < k * 0.25 else easy) for _ in range(4 + 6 * k)) + "." for _ in range(12))
        rows.append((i, text, "vi", "S"))
        truth[i] = k + 1
    rows += [(900, None, None, None), (901, "", "vi", "S"), (902, "!!! 12", "vi", "S"), (None, "x", "vi", "S"), (0, rows[0][1], "vi", "S")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"level": F.lit(9), "word": F.lit("w"), "n": F.lit(1)})
    lab = spark.createDataFrame([(i, truth[i]) for i in range(0, 400, 4)] + [(None, 2), (5, None), (7777, 1)], "doc_id long, reading_level int")
    out = levels.levels(df, lab).collect()
    got = {r["doc_id"]: r["reading_level"] for r in out}
    assert len(out) == len(got) == 403
    held = [i for i in range(400) if i % 4]
    assert sum(got[i] == truth[i] for i in held) / len(held) > 0.9
    assert {r["reading_level"] for r in levels.levels(df, lab.limit(0)).collect()} == {3}
    assert levels.levels(df.limit(0), lab).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, None)], "a long, b long")
    got = {r["id"]: r["comp"] for r in components(e).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[100] == got[101] == 100 and 200 not in got
    assert components(e.limit(0)).count() == 0


SHORT = [("ctcp", "công ty cổ phần"), ("tp.", "thành phố"), ("clb", "câu lạc bộ"), (None, "x"), ("y", None)]


def test_names(spark):
    rng = random.Random(12)
    fill = ["".join(p) for p in itertools.product(("b", "kh", "tr", "ng", "ph"), ("ân", "ốc", "iêu", "ương", "anh"))]
    rows = [
        (1, "trần văn khốc bân", "Cá nhân"), (2, "TRẦN VĂN KHỐC BÂN", "PERSON"), (3, "tran van khoc ban", "PERSON"), (4, "khốc bân, trần văn", "PERSON"), (5, "ông trần văn khốc bân", "Cá nhân"),
        (6, "trần văn khốc bân (bân lùn)", "PERSON"), (7, "bân lùn", "PERSON"), (8, "t.v. khốc bân", "PERSON"), (9, "lê văn khốc bân", "PERSON"),
        (20, "công ty cổ phần phương triêu ngân", "Tổ chức"), (21, "ctcp phương triêu ngân", "ORG"), (22, 'công ty cổ phần "phương triêu ngân"', "ORG"), (23, "phuongtrieungan", "ORG"), (24, "ctcp phương triêu ngân chi nhánh bân", "ORG"),
        (30, "thành phố khốc bân", "LOC"), (31, "tp. khốc bân", "Địa điểm"), (32, "xã khốc bân", "LOC"), (33, "khốc bân (xã)", "LOC"),
        (40, "điện thoại phanh bân s3", "PRODUCT"), (41, "điện thoại phanh bân s1", "PRODUCT"), (42, "điện thoại phanh bân s3", "Sản phẩm"),
        (50, None, "ORG"), (51, "  ", "ORG"), (52, "x", None), (None, "trần văn khốc bân", "PERSON"), (1, "trần văn khốc bân", "Cá nhân"), (53, "()", "ORG"), (54, "a" * 3000, "ORG"),
    ]
    rows += [(100 + i, " ".join(rng.choice(fill) for _ in range(4)), "PERSON") for i in range(150)] + [(400 + i, "xã " + " ".join(rng.choice(fill) for _ in range(2)), "LOC") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, name string, type string").withColumns({"cls": F.lit("q"), "form": F.lit("f"), "grams": F.lit("g"), "a": F.lit(1), "short": F.lit(2)})
    short = spark.createDataFrame(SHORT, "short_form string, full_form string")
    got = [tuple(r) for r in queries._variant_pairs(df, short).collect()]
    mine = {p for p in got if p[1] < 100}
    want = set(itertools.combinations(range(1, 9), 2)) | set(itertools.combinations(range(20, 24), 2)) | {(30, 31), (32, 33), (40, 42)}
    assert len(got) == len(set(got)) and mine == want
    assert queries._variant_pairs(df.limit(0), short).count() == 0
    assert queries._variant_pairs(df, short.limit(0)).count() > 0


def test_keys_lose_no_link():
    rng = random.Random(13)
    near = {"khoc": ("khốc",), "ban": ("bân", "hân"), "trran": ("trần",), "hân": ("bân",)}
    words = ["trần", "khốc", "bân", "khoc", "ban", "trran", "hân", "lê", "k.", "b."]
    token = lambda w: {"w": w, "like": w, "v": near.get(w, ()), "g": 1.0}
    for cls in ("PERSON", "ORG", "LOC"):
        made = []
        for _ in range(300):
            core = [token(rng.choice(words)) for _ in range(rng.choice([1, 2, 3, 3, 4, 4, 5]))]
            if rng.random() < 0.2:
                core = [token("".join(names.fold(t["w"]) for t in core))]
            kind = rng.choice([[], ["xã"], ["thị", "trấn"], ["tt"], ["công", "ty"]]) if cls != "PERSON" else []
            made.append({"core": core, "kind": kind, "mark": ["2"] * (rng.random() < 0.2) * (cls != "PERSON"), "alias": rng.random() < 0.2})
        made = [(f, names.keys(f, cls)) for f in made]
        linked = 0
        for (x, kx), (y, ky) in itertools.combinations(made, 2):
            if names.link(x, y, cls):
                linked += 1
                assert any(a == b and r | s == 3 for a, r in kx for b, s in ky), (x, y)
        assert linked > 50


def test_common_syllables_make_no_candidates(spark, monkeypatch):
    fill = ["khốc", "triêu", "nguyệt", "phương", "trương", "nghiêu", "thuyên", "khương"]  # no words of kind, else cores are equal
    rows = [(i, "công ty " + " ".join(p), "ORG") for i, p in enumerate(itertools.product(fill, fill, fill))]
    rows += [(1000 + i, " ".join(p), "PERSON") for i, p in enumerate(itertools.product(fill[:5], fill[:5], fill[5:], "ab"))]
    df = spark.createDataFrame([*rows, (2000, "công ty khốc triêu nguyệt", "ORG")], "id long, name string, type string")
    given, real = [], names.map_batches
    monkeypatch.setattr(names, "map_batches", lambda d, fn, schema, *more: (given.append(d), real(d, fn, schema, *more))[1])
    got = names.links(df, spark.createDataFrame(SHORT, "short_form string, full_form string")).collect()
    assert (10, 2000) in {(r["a"], r["b"]) for r in got}
    assert given[-1].count() < len(rows)  # the pairs that are verified; all pairs that share enough grams are far more


@pytest.mark.parametrize(("a", "b", "want"), [("abc", "abc", True), ("abc", "ab", True), ("abc", "acb", True), ("abc", "xbc", True), ("abcd", "ab", False), ("abc", "cab", False)])
def test_near(a, b, want):
    assert names.near(a, b) is want and names.near(b, a) is want


def test_all_labels_are_kept(spark):
    names = ["law", "sport", "farming"]
    text = {"law": "Tòa án xét xử bị cáo. ", "sport": "Đội bóng ghi bàn thắng. ", "farming": "Nông dân gặt lúa mùa. "}
    rows = [(i, text[names[i % 3]] * 4) for i in range(90)] + [(90, "không có câu nào")]
    given = {i: names[(i + i // 3) % 3] for i in range(0, 90, 2)} | {90: "law"}
    df, areas = spark.createDataFrame(rows, "id long, content string"), spark.createDataFrame([(s,) for s in names], "subject string")
    lab = spark.createDataFrame(list(given.items()), "article_id long, subject string")
    for most in (5, 0):
        got = {}
        for r in subjects.subjects(df, lab, areas, most_labels=most).collect():
            got.setdefault(r["article_id"], []).append(r["subject"])
        assert {i: got.get(i) for i in given} == {i: [s] for i, s in given.items()}


def test_repetition_within_a_small_source(spark):
    rows = [(i, f"Dòng riêng số {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", "Lớn") for i in range(17_000)]
    rows += [(20_000 + i, "Danh mục nhỏ", "Nhỏ") for i in range(10)]
    pages = spark.createDataFrame(rows, "u long, text string, source string")
    got = main_text.repetition(main_text.lines_by_page(pages), len(rows), 1 / 2500)
    key = main_text._key(main_text.lines_of("Danh mục nhỏ", "nhỏ")[0][2])
    assert [r["level"] for r in got.where(F.col("k") == key).collect()] == [3]


def test_counts_do_not_overflow():
    text = "một hai lạ. " * 6_000_000
    assert levels.counted(text, frozenset(["một", "hai"]), {}, "") == (18_000_000, 6_000_000, 6_000_000)


def test_more_than_63_subjects_are_refused(spark):
    areas = spark.createDataFrame([(f"s{i}",) for i in range(64)], "subject string")
    df = spark.createDataFrame([(1, "một câu.")], "id long, content string")
    lab = spark.createDataFrame([(1, "s1")], "article_id long, subject string")
    with pytest.raises(ValueError):
        subjects.subjects(df, lab, areas)
