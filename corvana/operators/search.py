"""Hybrid retrieval: graph matches, weighted keywords, dates, and their merge."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import add, and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvana.functions.dates import variants
from corvana.operators.graph import matched
from corvana.operators.views import article_filters, contains_any

MAX_TERMS, MAX_REQUIRED = 10, 6
CANDIDATE = ["id", "title", "source", "link", "published_date", "content", "graph_score", "keyword_score", "score", "match_terms"]


def dedupe(values: list[str]) -> list[str]:
    """Trimmed, lower-cased, first occurrence kept, blanks dropped."""
    return [v for v in dict.fromkeys(v.strip().lower() for v in values) if v]


def _hit(column: str, term: str):
    c = F.lower(F.col(column))
    return F.coalesce(c.like(f"%{term}%") if set(term) & set("%_\\") else c.contains(term), F.lit(False))


def graph_search(articles: DataFrame, links: DataFrame, entities: DataFrame, terms: list[str], weights: dict[str, float], limit: int, **bounds) -> DataFrame:
    """Most matching entities first, newest next; cut before weighting."""
    m = matched(articles.where(article_filters(**bounds)), links, entities, terms)
    top = m.orderBy(F.desc("match_count"), F.desc_nulls_last("published_date"), "id").limit(limit)
    w = F.create_map(*[x for t in terms for x in (F.lit(t), F.lit(float(weights.get(t, 1.0))))])
    score = F.aggregate("match_terms", F.lit(0.0), lambda s, t: s + F.coalesce(w[t], F.lit(1.0)))
    return top.withColumn("graph_score", score).withColumn("keyword_score", F.lit(0.0)).withColumn("score", F.col("graph_score")).select(CANDIDATE)


def keyword_search(articles: DataFrame, terms: list[str], weights: dict[str, float], limit: int, required: list[str] | None = None, **bounds) -> DataFrame:
    """Two weights for a term in the title, one in the content; highest first, newest next; positive scores only, after the cut."""
    terms = terms[:MAX_TERMS]
    score = reduce(add, [F.when(_hit("title", t), 2.0 * weights.get(t, 1.0)).otherwise(0.0) + F.when(_hit("content", t), float(weights.get(t, 1.0))).otherwise(0.0) for t in terms])
    where = [contains_any(["title", "content"], terms), article_filters(**bounds)]
    if required:
        where.append(contains_any(["title", "content"], required[:MAX_REQUIRED]))
    top = articles.where(reduce(and_, where)).withColumn("keyword_score", score).orderBy(F.desc("keyword_score"), F.desc_nulls_last("published_date"), "id").limit(limit)
    top = top.where("keyword_score > 0").withColumn("graph_score", F.lit(0.0)).withColumn("score", F.col("keyword_score") * 0.75)
    return top.withColumn("match_terms", F.array().cast("array<string>")).select(CANDIDATE)


def date_mentions(articles: DataFrame, day: dt.date, primary: list[str], secondary: list[str] | None = None, limit: int = 10) -> DataFrame:
    """Articles that mention the day and a primary term (and a secondary one, if any are given); long ones first."""
    where = [contains_any(["title", "content"], variants(day)), contains_any(["title", "content"], primary[:MAX_REQUIRED])]
    if secondary:
        where.append(contains_any(["title", "content"], secondary[:MAX_REQUIRED]))
    n = F.char_length("content")
    top = articles.where(reduce(and_, where)).orderBy(F.desc_nulls_last(n), F.desc_nulls_last("published_date"), "id").limit(limit)
    s = F.lit(50.0) + F.least(F.coalesce(n, F.lit(0)) / 1000.0, F.lit(5.0))
    return top.withColumn("graph_score", s).withColumn("score", s).withColumn("keyword_score", F.lit(0.0)).withColumn("match_terms", F.array().cast("array<string>")).select(CANDIDATE)


def merge(*batches: DataFrame) -> DataFrame:
    """One row an article: best graph and keyword score, both counted where both exist, terms united; ties in batch order."""
    tagged = [b.withColumn("batch", F.lit(i)).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), F.desc_nulls_last("published_date"), "id"))) for i, b in enumerate(batches)]  # batches are cut to a limit
    u = reduce(DataFrame.unionByName, tagged)
    first = F.struct("batch", "pos")
    g = u.groupBy("id").agg(
        *[F.min_by(c, first).alias(c) for c in ("title", "source", "link", "published_date", "content")],
        F.max("graph_score").alias("graph_score"), F.max("keyword_score").alias("keyword_score"), F.count(F.lit(1)).alias("n"), F.max("score").alias("alone"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("match_terms")))).alias("match_terms"), F.min(first).alias("o"),
    )
    s = F.when(F.col("n") > 1, F.col("graph_score") + F.col("keyword_score") * 0.75).otherwise(F.col("alone"))
    return g.withColumn("score", s).orderBy(F.desc("score"), F.desc("graph_score"), F.desc("keyword_score"), "o").select(CANDIDATE)


def with_date_terms(terms: list[str], weights: dict[str, float], day: dt.date | None, least: float = 2.5) -> tuple[list[str], dict[str, float]]:
    """Terms and weights with the day's spellings added, each at `least` or at the weight that it already has, if larger."""
    if day is None:
        return terms, weights
    more = variants(day)
    return [*terms, *(v for v in more if v not in terms)], weights | {v: max(weights.get(v, 0.0), least) for v in more}


def hybrid(articles: DataFrame, links: DataFrame, entities: DataFrame, analysis: dict, limit: int = 5, day: dt.date | None = None, **bounds) -> DataFrame:
    """Both searches over four times the limit, merged and cut. A day's spellings count as terms."""
    terms, weights = with_date_terms(list(analysis["search_terms"]), dict(analysis["term_weights"]), day)
    if not terms:
        return keyword_search(articles, ["\0"], {}, 0)
    g = graph_search(articles, links, entities, terms, weights, max(4 * limit, limit), **bounds)
    k = keyword_search(articles, terms, weights, 4 * limit, analysis.get("anchor_terms"), **bounds)
    return merge(g, k).limit(limit)


def prefer_day(results: DataFrame, day: dt.date, order: list) -> DataFrame:
    """Results that mention the day first, the order within both kept."""
    hay = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit(""))))
    hit = reduce(lambda a, v: a | hay.contains(v), variants(day, wide=True), F.lit(False))
    return results.withColumn("mentions", hit).orderBy(F.desc("mentions"), *order)
