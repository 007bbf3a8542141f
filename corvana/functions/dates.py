"""Dates in feeds, questions and texts, as columns and as plain functions for one question."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXPLICIT = r"(\d{1,2})[/-](\d{1,2})(?:[/-](\d{2,4}))?"


def feed_date(c: Column) -> Column:
    """An RFC 822 date as 'yyyy-MM-dd HH:mm:ss' in its own offset; empty is null, anything else stays as it is."""
    bare = F.regexp_extract(c, r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    parsed = F.date_format(F.try_to_timestamp(F.when(bare != "", bare), F.lit("d MMM yyyy HH:mm:ss")), "yyyy-MM-dd HH:mm:ss")
    return F.when(F.trim(c) == "", None).otherwise(F.coalesce(parsed, c))


def source_date(c: Column) -> Column:
    """The date in the first ten characters, or null."""
    return F.try_to_timestamp(F.regexp_extract(F.trim(c), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")).cast("date")


def explicit_date(c: Column, year: int) -> Column:
    """The first d/m[/y] or d-m[-y]; a missing year is `year`, two digits are of this century; impossible dates are null."""
    d, m, y = (F.regexp_extract(c, _EXPLICIT, i) for i in (1, 2, 3))
    full = F.when(y == "", F.lit(str(year))).when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(F.lpad(y, 4, "0"))
    return F.when(d != "", F.try_to_timestamp(F.concat_ws("-", full, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date"))


def question_range(c: Column, today: dt.date) -> tuple[Column, Column]:
    """(from, to) of a question: explicit date, today, yesterday, tomorrow, last n days, this week, latest (3 days)."""
    q = F.lower(c)
    day = F.lit(today)
    explicit = explicit_date(c, today.year)
    n = F.regexp_extract(q, r"(\d+)\s+ngày\s+(?:qua|gần\s+đây)", 1)
    has = lambda *t: __import__("functools").reduce(lambda a, b: a | b, [q.contains(x) for x in t])
    low = (
        F.when(explicit.isNotNull(), explicit)
        .when(has("hôm nay", "trong ngày"), day)
        .when(has("hôm qua"), F.date_sub(day, 1))
        .when(has("ngày mai"), F.date_add(day, 1))
        .when(n != "", F.date_sub(day, F.expr("0") + F.when(n != "", n).cast("int")))
        .when(has("tuần này"), F.lit(today - dt.timedelta(days=today.weekday())))
        .when(has("mới nhất", "gần đây", "mới có"), F.date_sub(day, 3))
    )
    high = (
        F.when(explicit.isNotNull(), explicit)
        .when(has("hôm nay", "trong ngày"), day)
        .when(has("hôm qua"), F.date_sub(day, 1))
        .when(has("ngày mai"), F.date_add(day, 1))
        .when((n != "") | has("tuần này", "mới nhất", "gần đây", "mới có"), day)
    )
    return low, high


def one_explicit_date(question: str, year: int) -> dt.date | None:
    m = re.search(_EXPLICIT, question)
    if not m:
        return None
    y = m.group(3)
    try:
        return dt.date(int(y) + 2000 if y and len(y) == 2 else int(y) if y else year, int(m.group(2)), int(m.group(1)))
    except ValueError:
        return None


def variants(day: dt.date, wide: bool = False) -> list[str]:
    """Spellings of a date in texts: d/m, d.m and d-m with and without leading zeros; `wide` adds the word and the year."""
    d, m, y = day.day, day.month, day.year
    got = [f.format(d=d, m=m) for s in "/.-" for f in (f"{{d}}{s}{{m}}", f"{{d:02d}}{s}{{m:02d}}")]
    if wide:
        got += [f"ngày {d}/{m}", f"ngày {d:02d}/{m:02d}", f"{d}/{m}/{y}", f"{d:02d}/{m:02d}/{y}"]
    return list(dict.fromkeys(got))


def day_label(day: dt.date) -> str:
    return f"ngày {day.day}/{day.month}/{day.year}"


def anchored(answer: Column, label: str | None) -> Column:
    return F.regexp_replace(answer, r"(?iU)\bhôm nay\b", label) if label else answer
