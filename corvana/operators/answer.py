"""The answer flow for one question: dates, clarification, retrieval, context, and a pluggable answerer.

Only the rows of the final cut (at most `top_k`) reach the driver. Clarifications are codes; their wording is the caller's.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvana.functions import constants as K
from corvana.functions.dates import day_label, one_explicit_date, question_range
from corvana.operators import chunks, ner, search


def asks_first(analysis: dict, category: str | None, has_context: bool) -> str | None:
    """What must be asked before searching: 'travel_place', 'weather_place', or nothing."""
    found = analysis["entities"]
    if found["LOC"]:
        return None
    c = (category or "").casefold()
    if ("du lịch" in c or "travel" in c) and "WHERE" in analysis["question_intents"] and not has_context:
        return "travel_place"
    if (found["DATE"] or found["TIME"]) and (found["TEMPERATURE"] or {"nóng", "lạnh"} & set(found["STATE"])):
        return "weather_place"
    return None


def asks_after(analysis: dict) -> str:
    """What an empty result calls for: 'weather_place', 'place', 'general', or 'not_found'."""
    found = analysis["entities"]
    if not analysis["requires_clarification"]:
        return "not_found"
    if (found["DATE"] or found["TIME"]) and (found["TEMPERATURE"] or found["STATE"]):
        return "weather_place"
    return "place" if "WHERE" in analysis["question_intents"] else "general"


def no_information(answer: str) -> bool:
    low = (answer or "").casefold()
    return any(m in low for m in K.NO_INFO)


def extractive(question: str, contexts: list[str]) -> str:
    """The default answerer: the best context as it is."""
    return contexts[0] if contexts else ""


def answer(articles: DataFrame, links: DataFrame, entities: DataFrame, question: str, rules: ner.Rules, today: dt.date, top_k: int = 3, category: str | None = None, from_date: dt.date | None = None, to_date: dt.date | None = None, context: str | None = None, answerer: Callable[[str, list[str]], str] = extractive) -> dict:
    """{answer, sources, clarify}. A day named in the question only ranks; a relative one, or given bounds, filter."""
    if not 2 <= len(question) <= 500 or not 1 <= top_k <= 10:
        raise ValueError("question of 2 to 500 characters, top_k of 1 to 10")
    asked = f"{context.strip()}. {question}" if context and context.strip() else question
    day = one_explicit_date(asked, today.year)
    if day is None or from_date or to_date:
        spark = articles.sparkSession
        low, high = question_range(F.col("q"), today)
        r = spark.createDataFrame([(asked,)], "q string").select(low.alias("low"), high.alias("high")).first()
        from_date, to_date = from_date or r["low"], to_date or r["high"]
    full = f"{category.strip()}. {asked}" if category and category.strip() else asked
    analysis = ner.analyze(full, rules)
    clarify = asks_first(analysis, category, bool(context))
    if clarify:
        return {"answer": "", "sources": [], "clarify": clarify}
    limit = 4 * top_k if day else top_k
    found = search.hybrid(articles, links, entities, analysis, limit, day=day, category=category, from_date=from_date, to_date=to_date)
    order = [F.desc("score"), F.desc("graph_score"), F.desc("keyword_score"), F.col("id")]
    primary = [ner.normal(v) for k in K.ANCHOR_TYPES for v in analysis["entities"][k]]
    if day and primary:
        secondary = [p for p in K.WEATHER_PHRASES if p in full.casefold()] + [w for w in analysis["residual_keywords"] if len(w) >= 4]
        found = search.merge(search.date_mentions(articles, day, search.dedupe(primary), search.dedupe(secondary), limit), found)
    ranked = (search.prefer_day(found, day, order) if day else found.orderBy(*order)).limit(top_k).select(search.CANDIDATE)
    keywords = [w for w in ner.normal(asked).split() if w not in K.QUERY_STOPWORDS]
    rows = chunks.context(ranked, analysis["search_terms"], keywords, ner.focus_terms(analysis)).orderBy(F.desc("similarity_score"), "id").collect()  # at most top_k
    if not rows:
        return {"answer": "", "sources": [], "clarify": asks_after(analysis)}
    said = answerer(question, [r["context"] for r in rows])
    if day:
        said = said.replace("hôm nay", day_label(day)).replace("Hôm nay", day_label(day))
    sources = [] if no_information(said) else [{k: r[k] for k in ("chunk_text", "similarity_score", "keyword_score", "title", "source", "link", "published_date")} for r in rows]
    return {"answer": said, "sources": sources, "clarify": None}
