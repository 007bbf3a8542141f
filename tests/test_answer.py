import datetime as dt

import pytest

from corvana.operators import ner
from corvana.operators.answer import answer, asks_after, asks_first

TODAY = dt.date(2024, 5, 15)


@pytest.fixture(scope="module")
def tables(spark):
    a = spark.createDataFrame(
        [
            (1, "Giá vàng ở Hà Nội", "l1", "Giá vàng tăng. Người dân Hà Nội xếp hàng mua vàng. Hôm nay giá vẫn tăng.", "2024-05-15 08:00:00", "S", "Kinh doanh"),
            (2, "Thời tiết Hà Nội", "l2", "Dự báo ngày 16/5 Hà Nội có mưa.", "2024-05-14 20:00:00", "S", "Thời sự"),
            (3, "Bóng đá", "l3", "Trận đấu ở Hải Phòng.", None, "S", "Thể thao"),
        ],
        "id long, title string, link string, content string, published_date string, source string, category string",
    )
    e = spark.createDataFrame([(1, "hà nội", "LOC")], "id long, name string, type string")
    g = spark.createDataFrame([(1, 1, 1), (2, 2, 1)], "id long, article_id long, entity_id long")
    return a, g, e


def test_flow(tables):
    a, g, e = tables
    r = ner.Rules()
    got = answer(a, g, e, "Giá vàng ở Hà Nội hôm nay thế nào?", r, TODAY)
    assert [s["title"] for s in got["sources"]] == ["Giá vàng ở Hà Nội"] and got["clarify"] is None
    got = answer(a, g, e, "Thời tiết Hà Nội 16/5 ra sao?", r, TODAY, top_k=1)
    assert [s["link"] for s in got["sources"]] == ["l2"]
    got = answer(a, g, e, "Giá vàng ở Hà Nội", r, TODAY, answerer=lambda q, c: "Không tìm thấy thông tin.")
    assert got["sources"] == [] and got["answer"]
    with pytest.raises(ValueError):
        answer(a, g, e, "x", r, TODAY)


def test_clarification(tables):
    r = ner.Rules()
    assert answer(*tables, "Đi chơi ở đâu?", r, TODAY, category="Du lịch")["clarify"] == "travel_place"
    assert asks_first(ner.analyze("Ngày mai 35 độ C phải không?", r), None, False) == "weather_place"
    assert asks_after(ner.analyze("ở đâu", r)) == "place" and asks_after(ner.analyze("ừ thì", r)) == "general"
