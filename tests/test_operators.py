import itertools
import random

import pytest
from pyspark.sql import functions as F

from corvana.functions import constants as K
from corvana.operators import boilerplate as B
from corvana.operators import chunks as C
from corvana.operators import dedup as U
from corvana.operators import graph as G
from corvana.operators import ner as N
from corvana.operators import search as S
from corvana.operators import views as V

A = "id long, title string, link string, summary string, content string, published_date string, source string, category string"


def test_classify(spark):
    rows = [(1, "x", "https://a/the-thao/1", "", "", None, "s", None), (2, "Bão số 3", "l", "", "", None, "s", K.DEFAULT_CATEGORY), (3, "Bão số 3", "l", "", "", None, "s", None), (4, "x", "l", "", "", None, "s", "Công nghệ"), (5, None, None, "", "", None, "Weather", "")]
    got = {r["id"]: r["category"] for r in V.classify(spark.createDataFrame(rows, A)).collect()}
    assert got == {1: "Thể thao", 2: "Thời tiết Việt Nam", 3: K.DEFAULT_CATEGORY, 4: "Số hóa", 5: "Thời tiết Việt Nam"}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "t", "a", "s", "c", "d", "x", K.DEFAULT_CATEGORY), (2, "t2", "b", "s", "c", "d", "x", "Xe")], A)
    new = spark.createDataFrame([(3, "T", "a", "s2", "c2", "d2", "y", "Thể thao"), (4, "T", "b", "s3", "c3", "d2", "y", "Luật"), (5, "n", None, "s", "c", "d", "x", ""), (6, "n", None, "s", "c", "d", "x", "")], A).withColumn("seq", F.col("id"))
    got = {r["id"]: r for r in G.upsert_articles(old, new).collect()}
    assert len(got) == 4
    assert (got[1]["title"], got[1]["content"], got[1]["category"], got[1]["source"]) == ("t", "c2", "Thể thao", "x")
    assert (got[2]["summary"], got[2]["category"]) == ("s3", "Xe")


def test_queue_is_empty_after_indexing(spark):
    a = spark.createDataFrame([(1, "t", "l", "", "c", None, "s", None), (2, None, "l", "", None, None, "s", None), (3, "u", "l", "", "d", None, "s", None)], A)
    none = spark.createDataFrame([], "article_id long, extractor_signature string, content_hash string")
    q = G.queue(a, none, "v1")
    assert {r["id"] for r in q.collect()} == {1, 3}
    index = q.select(F.col("id").alias("article_id"), F.lit("v1").alias("extractor_signature"), F.col("hash").alias("content_hash"))
    assert G.queue(a, index, "v1").count() == 0
    assert G.queue(a, index, "v2").count() == 2
    assert G.queue(a.withColumn("title", F.lit("z")), index, "v1").count() == 2


def test_numbered_is_dense(spark):
    new = spark.createDataFrame([(f"n{i:03d}",) for i in range(57)], "name string").repartition(7)
    old = spark.createDataFrame([(41, "q")], "id long, name string")
    got = G.numbered(new, old, ["name"]).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(42, 99)) and [r["name"] for r in got] == sorted(r["name"] for r in got)


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefgh") * 2 + str(rng.randrange(40)) for _ in range(rng.randrange(1, 60))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for b in base:
        c = list(b)
        for _ in range(rng.randrange(0, 3)):
            c[rng.randrange(len(c))] = "zz"
        texts += [" ".join(c), " ".join(b)]
    texts += ["", "  ", "một", "một", "Một!", "một hai"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, x string")
    sets = U.shingles(df, "id", F.col("x"))
    have = {r["id"]: set(r["grams"]) for r in sets.collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(have), 2) if len(have[a] & have[b]) / len(have[a] | have[b]) >= 0.8}
    assert {(r["a"], r["b"]) for r in U.similar_pairs(sets, "id", 0.8).collect()} == want


def test_keep_first_on_a_chain(spark):
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 10)], "a long, b long")
    assert {r["id"] for r in U.dropped_greedy(chain).collect()} == {2, 4, 10}
    assert {r["id"] for r in U.dropped_pairwise(chain).collect()} == {2, 3, 4, 5, 10}
    assert U.dropped_greedy(chain.limit(0)).count() == 0


def plain_chunks(text, size=120, overlap=20):
    import re

    out, cur = [], []
    for s in re.split(r"(?<=[.!?])\s+", text):
        w = s.split()
        if not w:
            continue
        if len(w) > size:
            out += [" ".join(cur)] * bool(cur) + [" ".join(w[i : i + size]) for i in range(0, len(w), size - overlap)]
            cur = []
        elif len(cur) + len(w) > size:
            out.append(" ".join(cur))
            cur = cur[-overlap:] + w
        else:
            cur = cur + w
    return [c for c in out + [" ".join(cur)] * bool(cur) if c]


def test_micro_chunks(spark):
    rng = random.Random(5)
    texts = [". ".join(" ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([3, 17, 40, 119, 120, 121, 300]))) for _ in range(rng.randrange(1, 9))) + "." for _ in range(40)] + ["", " ", "một."]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, x string")
    got = {r["id"]: list(r["c"]) for r in df.select("id", C.micro_chunks(F.col("x")).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_chunks(t), i


def test_merge_and_weights(spark):
    row = "id long, title string, source string, link string, published_date string, content string, graph_score double, keyword_score double, score double, match_terms array<string>"
    g = spark.createDataFrame([(1, "a", "s", "l", "2024", "c", 4.0, 0.0, 4.0, ["x"]), (2, "b", "s", "l", None, "c", 2.0, 0.0, 2.0, ["y"])], row)
    k = spark.createDataFrame([(1, "a", "s", "l", "2024", "c", 0.0, 8.0, 6.0, []), (3, "d", "s", "l", "2023", "c", 0.0, 4.0, 3.0, [])], row)
    got = [(r["id"], r["score"]) for r in S.merge(g, k).collect()]
    assert got == [(1, 10.0), (3, 3.0), (2, 2.0)]


@pytest.fixture(scope="module")
def rules():
    return N.Rules({"EVENT": ["cúp ven sông"], "AWARD": ["cúp bạc"], "SPORT_TEAM": ["đội vịnh sa", "đội nam thành"]})


@pytest.mark.parametrize(
    ("text", "triple"),
    [
        ("Đội Vịnh Sa thắng đội Nam Thành.", ("Đội Vịnh Sa", "THẮNG", "đội Nam Thành")),
        ("Đội Vịnh Sa thua đội Nam Thành.", ("Đội Vịnh Sa", "THUA", "đội Nam Thành")),
        ("Công ty Sao Mai hợp tác với Ngân hàng Phương Đông.", ("Công ty Sao Mai", "HỢP_TÁC_VỚI", "Ngân hàng Phương Đông")),
        ("Công ty Sao Mai mua lại Công ty Lửa Hồng.", ("Công ty Sao Mai", "MUA_LẠI", "Công ty Lửa Hồng")),
        ("Công ty Sao Mai có trụ sở tại Hà Nội.", ("Công ty Sao Mai", "CÓ_TRỤ_SỞ_TẠI", "Hà Nội")),
        ("Cúp Ven Sông diễn ra tại Hà Nội.", ("Cúp Ven Sông", "DIỄN_RA_TẠI", "Hà Nội")),
        ("Trần Văn Nam tham dự Cúp Ven Sông.", ("Trần Văn Nam", "THAM_GIA", "Cúp Ven Sông")),
        ("Trần Văn Nam đoạt cúp bạc.", ("Trần Văn Nam", "NHẬN_GIẢI_THƯỞNG", "cúp bạc")),
        ("Trần Văn Nam sinh ra tại Hà Nội.", ("Trần Văn Nam", "SINH_TẠI", "Hà Nội")),
    ],
)
def test_relations(rules, text, triple):
    found = N.extract(text, rules)
    assert triple in [(r["subject"], r["relation"], r["object"]) for r in N.relations(text, found, rules)]


def test_relation_limits(rules):
    for text in ("Đội Vịnh Sa thắng. Đội Nam Thành về nhì.", "Đội Vịnh Sa " + "x" * 190 + " thắng đội Nam Thành"):
        assert N.relations(text, N.extract(text, rules), rules) == []


def test_attributes(rules):
    text = "Đội trưởng Trần Văn Nam, 31 tuổi, ghi bàn."
    got = {(a["entity"], a["attribute_key"], a["attribute_value"]) for a in N.attributes(text, N.extract(text, rules), rules)}
    assert {("Trần Văn Nam", "CHỨC_VỤ", "ĐỘI TRƯỞNG"), ("Trần Văn Nam", "TUỔI", "31 TUỔI"), ("Trần Văn Nam", "HÀNH_ĐỘNG", "GHI BÀN")} <= got


def test_extract_edges(rules):
    assert all(v == [] for v in N.extract(None, rules).values()) and list(N.extract("", rules)) == N.TYPES
    f = N.extract("Lúc 5 giờ sáng thứ hai, 20% của 3,5 triệu đồng, AI.", rules)
    assert "5 giờ" in f["TIME"] and not f["DURATION"] and "thứ hai" in f["DATE"] and not f["ORDINAL"] and f["PERCENT"] == ["20%"] and f["MONEY"] == ["3,5 triệu đồng"] and "ai" in f["TOPIC"]


def test_values_of_equals_the_plain_extractor(spark, rules):
    text = "Ngày 12/5/2024, lúc 8h30, 45 tuổi, 3,5%, tại phường Đông Hải, quận Hải An; gọi 0912 345 678, a.b@c.vn, https://x.y/z, mã cổ phiếu ABC, thứ nhất, #tin @ai_do."
    for kind in ("DATE", "TIME", "PERCENT", "AGE", "PHONE", "EMAIL", "URL", "STOCK_TICKER", "HASHTAG", "USERNAME"):
        got = spark.createDataFrame([(text,)], "x string").select(N.values_of(F.col("x"), kind)).first()[0]
        assert sorted(got) == N.extract(text, rules)[kind], kind


def test_analyze(rules):
    a = N.analyze("Đội Vịnh Sa thắng ai ở Hà Nội?", rules)
    assert {"đội vịnh sa", "hà nội"} <= set(a["anchor_terms"]) and a["term_weights"]["hà nội"] == 4.0 and "WHO" in a["question_intents"]
    assert N.analyze("", rules)["requires_clarification"]


def test_phrase_hits_of_any_length(spark):
    long = "ủy ban điều phối lưu vực sông nam thành mở rộng"
    docs = spark.createDataFrame([(1, f"Nay {long.title()}, họp."), (2, "Ủy ban điều phối: lưu"), (3, None), (4, ""), (5, "sông nam")], "id long, x string")
    phrases = spark.createDataFrame([(long, "ORG"), ("ủy ban điều phối", "ORG"), ("ủy ban điều phối", "TOPIC"), ("sông nam", "LOC"), ("lưu", "LOC"), ("", "LOC"), (None, "LOC")], "phrase string, type string")
    got = {tuple(r) for r in N.phrase_hits(docs, "id", "x", phrases).collect()}
    assert got == {(1, 1, long, "ORG"), (1, 5, "lưu", "LOC"), (1, 7, "sông nam", "LOC"), (2, 0, "ủy ban điều phối", "ORG"), (2, 0, "ủy ban điều phối", "TOPIC"), (2, 4, "lưu", "LOC"), (5, 0, "sông nam", "LOC")}
    assert N.phrase_hits(docs, "id", "x", phrases.limit(0)).columns == ["id", "pos", "phrase", "type"]


def test_phrase_hits_against_a_plain_scan(spark):
    rng = random.Random(8)
    texts = [[rng.choice("abcd") for _ in range(rng.randrange(0, 60))] for _ in range(30)]
    phrases = {" ".join(rng.choice("abcd") for _ in range(rng.choice([1, 2, 3, 5, 6, 7]))) for _ in range(60)} - {"a"}
    want = set()
    for k, w in enumerate(texts):
        for i in range(len(w)):
            have = [n for n in range(1, len(w) - i + 1) if " ".join(w[i : i + n]) in phrases]
            want |= {(k, i, " ".join(w[i : i + max(have)]))} if have else set()
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "id long, x string")
    got = N.phrase_hits(docs, "id", "x", spark.createDataFrame([(p, "T") for p in phrases], "phrase string, type string"))
    assert {(r["id"], r["pos"], r["phrase"]) for r in got.collect()} == want


def test_extraction_text_has_no_boilerplate(spark, tmp_path):
    from corvana.plans.queries import QUERIES

    body = "Đội tuyển Việt Nam thắng.\n\nẢnh: Trần Văn Nam"
    rows = [(1, "Tin", "Lá Tre", body), (2, None, None, "Trần Văn Nam thắng."), (3, "Tin", "Lá Tre", None)]
    spark.createDataFrame(rows, "id long, title string, source string, content string").write.parquet(str(tmp_path / "articles.parquet"))
    spark.createDataFrame([], "id long, name string, type string").write.parquet(str(tmp_path / "graph_entities.parquet"))
    text = spark.read.parquet(str(tmp_path / "articles.parquet")).select("id", B.extraction_text(F.col("title"), F.col("content"), F.col("source")))
    assert dict(map(tuple, text.collect())) == {1: "Tin. Đội tuyển Việt Nam thắng.", 2: ". Trần Văn Nam thắng.", 3: None}
    bare = N.extract("Tin. Đội tuyển Việt Nam thắng.", N.Rules())
    got = {r["id"]: r["entities"] for r in QUERIES["n0_extract_all"](spark, str(tmp_path)).collect()}
    assert got.keys() == {1, 2} and got[1] == sum(map(len, bare.values()))
    links = {r["what"]: r["n"] for r in QUERIES["g3_build_graph"](spark, str(tmp_path)).collect()}["links"]
    assert links == sum(len({v.lower() for v in vs}) for x in (bare, N.extract(". Trần Văn Nam thắng.", N.Rules())) for k, vs in x.items() if k in K.ANCHOR_TYPES and k != "TOPIC")


@pytest.mark.parametrize(("text", "found"), [("Ông đến Nga hôm qua.", True), ("tiếng Nga khó", False), ("Bà Nga nói", False), ("gặp Nga Hoàng ở đó", False), ("đi nga", False), ("Nga, Mỹ", True)])
def test_single_countries(text, found):
    assert ("nga" in N.extract(text, N.Rules())["LOC"]) is found


def test_graph_run(spark):
    from corvana.operators import build

    a = spark.createDataFrame([(1, "Tin", "l", "", "Ông Nguyễn Văn Nam gặp ông Trần Văn Hải ở Hà Nội.", None, "s", None), (2, "Khác", "l", "", "Công ty Sông Xanh ra mắt Galaxy S24 giá 5 triệu đồng.", None, "s", None), (3, None, "l", None, None, None, None, None), (1, "Tin", "l", "", "Ông Nguyễn Văn Nam gặp ông Trần Văn Hải ở Hà Nội.", None, "s", None)], A)
    empty = {"graph_entities": "id long, name string, type string", "article_graph": "article_id long, entity_id long", "entity_relations": "subject_id long, relation_type string, object_id long, article_id long", "entity_attributes": "entity_id long, attribute_key string, attribute_value string, article_id long", "article_graph_index": G.INDEX}
    tables = {k: spark.createDataFrame([], v) for k, v in empty.items()}
    one = build.run(a, tables)
    assert one["mode"] == "incremental" and one["summary"].first()["processed"] == 2
    assert {r["name"] for r in one["tables"]["graph_entities"].collect()} >= {"nguyễn văn nam", "trần văn hải", "hà nội"}
    index = {r["article_id"]: r for r in one["tables"]["article_graph_index"].collect()}
    links = one["tables"]["article_graph"].groupBy("article_id").count().collect()
    assert set(index) == {1, 2} and all(index[r["article_id"]]["entity_count"] == r["count"] for r in links)
    two = build.run(a, one["tables"], stored_signature=one["signature"])
    assert two["summary"].first()["processed"] == 0 and two["tables"]["article_graph"].count() == one["tables"]["article_graph"].count()
    three = build.run(a, one["tables"], lexicon={"TOPIC": ["gặp gỡ"]}, stored_signature=one["signature"])
    assert three["mode"] == "reset" and three["summary"].first()["processed"] == 2
    assert build.run(a, one["tables"])["mode"] == "backfill"
    assert G.rules_signature({"A": ["x", "y"], "B": ["z"]}) == G.rules_signature({"B": ["z"], "A": ["y", "x"]}) != G.rules_signature()
    assert G.missing_columns(a, G.INDEX) == [c.split()[0] for c in G.INDEX.split(", ")] and G.missing_tables(spark) == list(G.DERIVED)


def test_date_terms():
    import datetime as dt

    terms, weights = S.with_date_terms(["a", "1/5"], {"a": 4.0, "1/5": 3.0}, dt.date(2025, 5, 1))
    assert terms[:2] == ["a", "1/5"] and len(terms) == len(set(terms)) == 7
    assert weights["1/5"] == 3.0 and weights["01-05"] == 2.5 and S.with_date_terms(["a"], {"a": 1.0}, None) == (["a"], {"a": 1.0})


def disk():
    """Bytes of the stored tables."""
    import pathlib

    from corvana import session

    return sum(p.stat().st_size for _, at in session._MADE for p in pathlib.Path(at.removeprefix("file://")).rglob("*.parquet"))


def many_articles(spark, folder, copies=1):
    """Articles over few phrases, so that all share some; with near copies, a copy by other marks, an id with two texts and one without a word."""
    rng = random.Random(9)
    phrases = [" ".join(f"w{rng.randrange(900)}" for _ in range(6)) for _ in range(700)]
    texts = [[rng.choice(phrases) for _ in range(50)] for _ in range(500)]
    texts += [t[:20] + ["khác"] + t[21:] for t in texts[:25]] + [t[:25] + [rng.choice(phrases) for _ in range(25)] for t in texts[:25]]
    rows = [(i, "t", ". ".join(t)) for i, t in enumerate(texts)] * 2
    rows += [(600 + k, "t", rows[3][2].upper() + "!" * k) for k in range(copies)] + [(7, "t", rows[9][2]), (5000, "một hai ba", ""), (5001, "Một hai ba!", None), (5002, "?!", None)]
    spark.createDataFrame(rows, "id long, title string, content string").repartition(4).write.parquet(f"{folder}/articles.parquet")
    words = {(i, c or t): "".join(z for z in (c or t).lower() if z.isalnum() or z == " ").split() for i, t, c in rows}
    sets = [(i, frozenset(zip(w, w[1:], w[2:]))) for (i, _), w in words.items() if w]
    pairs = [tuple(sorted((a, b))) for (a, s), (b, t) in itertools.combinations(sets, 2) if a != b and len(s & t) / len(s | t) >= 0.85]
    return sorted(pairs), sum(len(c or t) for _, t, c in rows)


def test_similar_pairs_use_little_disk(spark, tmp_path):
    from corvana.plans import queries as Q

    want, size = many_articles(spark, tmp_path)
    before = disk()
    got = sorted((r["a"], r["b"]) for r in Q.QUERIES["dd3_jaccard_pairs"](spark, str(tmp_path)).collect())
    assert disk() - before < 0.2 * size
    assert got == want and len(want) > 25


def test_pairwise_makes_no_pairs(spark, tmp_path, monkeypatch):
    from corvana.plans import queries as Q

    want, size = many_articles(spark, tmp_path, 300)
    before = disk()
    monkeypatch.setattr(U, "class_pairs", None)
    got = sorted(r["id"] for r in Q.QUERIES["dd4_keep_first_pairwise"](spark, str(tmp_path)).collect())
    assert disk() - before < 0.2 * size
    assert got == sorted({b for _, b in want}) and len(want) > 45_000


def test_greedy_makes_few_pairs(spark, tmp_path, monkeypatch):
    from corvana.plans import queries as Q

    want, _ = many_articles(spark, tmp_path, 300)
    seen, plain = [], U.dropped_greedy
    monkeypatch.setattr(U, "dropped_greedy", lambda pairs: seen.append(pairs.count()) or plain(pairs))
    got = sorted(r["id"] for r in Q.QUERIES["dd4_keep_first_greedy"](spark, str(tmp_path)).collect())
    gone = set()
    for a, b in sorted(want, key=lambda p: p[::-1]):  # all pairs of an earlier b come first
        if a not in gone:
            gone.add(b)
    assert got == sorted(gone)
    assert seen[0] < 100 and len(want) > 45_000


def test_greedy_where_an_id_has_two_texts(spark):
    members = spark.createDataFrame([(5, 1), (9, 1), (3, 2), (5, 2), (7, 3), (8, 3), (11, 4)], "id long, cls long")
    links = spark.createDataFrame([(3, 4, 0.9)], "a long, b long, jaccard double")
    assert sorted(r["id"] for r in U.dropped_greedy_classes(members, links).collect()) == [5, 8, 11]
    assert sorted(r["id"] for r in U.dropped_pairwise_classes(members, links).collect()) == [5, 8, 9, 11]
