import pytest


@pytest.fixture(scope="module")
def articles(spark):
    """Every edge at once: nulls in each column, empty tables' schema, repeated rows, clashing extra columns."""
    schema = "id long, title string, source string, content string, category string, collected_at string, line string, k1 long, n int, text string, block string, word int"
    rows = [
        (1, "Một hai ba", "A", "Dòng một.\nChia sẻ\r\n\nDòng hai.", "x", "t", "l", 1, 1, "t", "b", 1),
        (1, "Một hai ba", "A", "Dòng một.\nChia sẻ\r\n\nDòng hai.", "x", "u", "l", 1, 1, "t", "b", 1),
        (2, "Một", "A", "  CHIA sẻ \nKhác 12", None, None, None, None, None, None, None, None),
        (3, None, "A", "chia sẹ̉\nchia sẻ", "x", "t", "l", 1, 1, "t", "b", 1),
        (4, "Một hai", None, "chia sẻ", "x", "t", "l", 1, 1, "t", "b", 1),
        (5, "Một hai ba", "B", None, "x", "t", "l", 1, 1, "t", "b", 1),
        (6, "Một hai ba", "B", "   ", "x", "t", "l", 1, 1, "t", "b", 1),
        (7, "", "B", "", "x", "t", "l", 1, 1, "t", "b", 1),
        (None, "Một hai ba", "B", "Chia sẻ", "x", "t", "l", 1, 1, "t", "b", 1),
        (8, "Dài", "C", "từ " * 40_000, "x", "t", "l", 1, 1, "t", "b", 1),
    ]
    return spark.createDataFrame(rows, schema)
