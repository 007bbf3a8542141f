import datetime as dt
import html as _html

import pytest
from pyspark.sql import functions as F

from corvana.functions import dates as D
from corvana.functions import text as T
from corvana.operators import boilerplate as B


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()[0]


def test_match_form_and_nfc(spark):
    assert one(spark, "  Hà  Nội, (2024)! ", T.match_form) == "hà nội 2024"
    assert one(spark, "Hà Nội", lambda c: T.match_form(T.nfc(c))) == "hà nội"
    assert one(spark, None, T.nfc) is None


def test_cleaning(spark):
    assert one(spark, "Xem https://a.b/c?d và www.x.vn nhé", T.without_urls) == "Xem  và  nhé"
    assert one(spark, "<p>a &amp; b</p>", T.feed_text) == "a & b"
    assert one(spark, "a<b\n>c", T.feed_text) == "a<b\n>c"  # tags do not cross lines
    assert one(spark, "Đường Ấm ấm", T.plain_letters) == "Đường m ấm"  # capitals with marks are taken for signs
    assert one(spark, "Đường Ấm", lambda c: T.plain_letters(c, keep_upper=True)) == "Đường Ấm"
    assert one(spark, "   ", T.cleaned) is None
    assert one(spark, "giá vàng và bất động sản", T.compounds) == "giá_vàng và bất_động_sản"


@pytest.mark.parametrize(
    ("text", "want"),
    [("Mon, 06 May 2024 08:30:00 +0700", "2024-05-06 08:30:00"), ("06 May 2024 08:30:00 GMT", "2024-05-06 08:30:00"), ("hôm qua", "hôm qua"), ("", None)],
)
def test_feed_date(spark, text, want):
    assert one(spark, text, D.feed_date) == want


@pytest.mark.parametrize(("q", "want"), [("tin 16/5", dt.date(2024, 5, 16)), ("tỉ số 2-1", dt.date(2024, 1, 2)), ("31/2 thì sao, 5/6?", None), ("ngày 1/2/23", dt.date(2023, 2, 1)), ("không có", None)])
def test_explicit_date(spark, q, want):
    assert one(spark, q, lambda c: D.explicit_date(c, 2024)) == want
    assert D.one_explicit_date(q, 2024) == want


def test_question_range(spark):
    today = dt.date(2024, 5, 15)  # a Wednesday
    rows = [("tin hôm nay", today, today), ("hôm qua có gì", dt.date(2024, 5, 14), dt.date(2024, 5, 14)), ("3 ngày qua", dt.date(2024, 5, 12), today), ("tuần này", dt.date(2024, 5, 13), today), ("tin mới nhất", dt.date(2024, 5, 12), today), ("ngày mai", dt.date(2024, 5, 16), dt.date(2024, 5, 16)), ("gì đó", None, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "q string")
    lo, hi = D.question_range(F.col("q"), today)
    got = {r["q"]: (r["lo"], r["hi"]) for r in df.select("q", lo.alias("lo"), hi.alias("hi")).collect()}
    assert got == {q: (a, b) for q, a, b in rows}


def test_boilerplate_lines(spark):
    want = {"Nội dung: An | Thiết kế: Bình | VCBS": True, "(Theo Reuters)": True, "Trần Văn Nam": True, "BBC": True, "Giá vàng hôm nay tăng mạnh so với hôm qua.": False, "Theo " + "x" * 200: False}
    df = spark.createDataFrame([(k,) for k in want], "line string")
    assert {r[0]: r[1] for r in df.select("line", B.is_boilerplate(F.col("line"), B.source_terms(F.lit(None).cast("string")))).collect()} == want


def test_boilerplate_article(spark):
    tail = "\n\n".join(["Chuyện chính của bài."] + [f"Ảnh: {i}x" for i in range(30)])
    rows = [("Một câu dài về giá vàng.\nCâu hai.\n\nẢnh: Nam\n\nTheo Reuters", None), (None, "x"), ("Theo BBC", ""), (tail, "x"), ("Câu chính.\r\n\r\n\r\nTin Xa", "Tin Xa / Báo B"), ("Câu. Ảnh: An | Video: Bình", "x"), ("", None)]
    df = spark.createDataFrame(rows, "content string, source string").select(B.stripped(F.col("content"), F.col("source")))
    got = [r[0] for r in df.collect()]
    assert got[:3] == ["Một câu dài về giá vàng. Câu hai.", None, ""]
    assert got[3].count("Ảnh") == 6  # twelve by paragraphs, twelve by lines
    assert got[4:] == ["Câu chính.", "Câu.", ""]
