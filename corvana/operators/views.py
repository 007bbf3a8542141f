"""Listing, search and statistics over articles and their graph."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvana.functions import constants as K
from corvana.operators.boilerplate import stripped
from corvana.functions.text import label


def not_uploaded(link: Column = None) -> Column:
    """False for uploads, null (so filtered) for null links."""
    return ~F.startswith(F.col("link") if link is None else link, F.lit(K.UPLOAD))


def category_alias(c: Column) -> Column:
    m = F.create_map(*[F.lit(v) for kv in K.CATEGORY_ALIASES.items() for v in kv])
    return F.when(c.isNull() | (c == ""), c).otherwise(F.coalesce(m[F.trim(c)], F.trim(c)))


def article_filters(category: str | None = None, from_date: dt.date | None = None, to_date: dt.date | None = None) -> Column:
    """Conjunction of the given bounds; dates compare as strings, the upper one is exclusive of the next day."""
    parts = [F.lit(True)]
    if category and category.strip():
        parts.append(F.col("category") == category.strip())
    if from_date is not None:
        parts.append(F.col("published_date") >= from_date.isoformat())
    if to_date is not None:
        parts.append(F.col("published_date") < (to_date + dt.timedelta(days=1)).isoformat())
    return reduce(and_, parts)


def like_any(columns: list[str], patterns: list[str]) -> Column:
    return reduce(or_, [F.col(c).like(p) for p in patterns for c in columns])


def contains_any(columns: list[str], terms: list[str]) -> Column:
    """Any term in any column, lower-cased; wildcards inside a term stay live."""
    return reduce(or_, [F.lower(F.col(c)).like(f"%{t}%") if set(t) & set("%_\\") else F.lower(F.col(c)).contains(t) for t in terms for c in columns])


def with_counts(articles: DataFrame, relations: DataFrame, links: DataFrame) -> DataFrame:
    """Relation and entity counts by article: aggregated first, then joined; 0 where there are none."""
    r = relations.groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias("relation_count"))
    e = links.groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias("entity_count"))
    joined = articles.join(r, "id", "left").join(e, "id", "left")
    return joined.withColumn("relation_count", F.coalesce("relation_count", F.lit(0))).withColumn("entity_count", F.coalesce("entity_count", F.lit(0)))


LISTED = ["id", "title", "link", "summary", "source", "category", "published_date", "content_length", "relation_count", "entity_count"]


def _listed(articles: DataFrame, relations: DataFrame, links: DataFrame, has_relations: bool) -> DataFrame:
    if has_relations:
        articles = articles.join(relations.select(F.col("article_id").alias("id")), "id", "left_semi")
    return with_counts(articles.withColumn("content_length", F.char_length("content")), relations, links).select(LISTED)


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("published_date"), F.col("id")]


def list_news(articles: DataFrame, relations: DataFrame, links: DataFrame, limit: int = 20, offset: int = 0, category: str | None = None, has_relations: bool = False) -> DataFrame:
    """A page of articles; ties in the date go by id. The page is cut before the counts are joined to it."""
    a = articles.where(not_uploaded())
    if category:
        c = K.CATEGORY_ALIASES.get(category.strip(), category.strip())
        a = a.where(F.col("category") == c)
    if has_relations:
        a = a.join(relations.select(F.col("article_id").alias("id")), "id", "left_semi")
    return _listed(a.orderBy(*newest_first()).offset(offset).limit(limit), relations, links, False)


def search_news(articles: DataFrame, relations: DataFrame, links: DataFrame, query: str, limit: int = 100, has_relations: bool = False) -> DataFrame:
    a = articles.where(not_uploaded()).where(like_any(["title", "summary", "content"], [f"%{query}%"]))
    if has_relations:
        a = a.join(relations.select(F.col("article_id").alias("id")), "id", "left_semi")
    return _listed(a.orderBy(*newest_first()).limit(limit), relations, links, False)


def page_of(df: DataFrame, order: list[Column], page: int, size: int = 20, cap: int = 100) -> DataFrame:
    """A page of the first `cap` rows."""
    return df.orderBy(*order).limit(cap).orderBy(*order).offset((page - 1) * size).limit(size)


def count_by_source(articles: DataFrame) -> DataFrame:
    return articles.where(not_uploaded()).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def count_by_category(articles: DataFrame) -> DataFrame:
    """Aliases first, then one aggregate."""
    return articles.where(not_uploaded()).groupBy(category_alias(F.col("category")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def total(articles: DataFrame) -> DataFrame:
    return articles.where(not_uploaded()).agg(F.count(F.lit(1)).alias("total"))


def categories(articles: DataFrame, uploads: bool = False) -> DataFrame:
    a = articles if uploads else articles.where(not_uploaded())
    return a.where("category is not null and category <> ''").select("category").distinct().orderBy("category")


def classify(articles: DataFrame) -> DataFrame:
    """Categories from source, link and title, in that order; only unclassified rows change.

    The default is filled in last, so a null category is read from the title only on a second pass."""
    c = F.col("category")
    empty = c.isNull() | (c == "") | (c == K.DEFAULT_CATEGORY)
    by_link = reduce(lambda w, x: w.when(reduce(or_, [F.col(x[0]).contains(s) for s in x[1]]), F.lit(x[2])), K.LINK_CATEGORIES, F.when(F.lit(False), c)).otherwise(c)
    a = articles.withColumn("category", F.when(empty, by_link).otherwise(c))
    for old, new in K.CATEGORY_ALIASES.items():
        a = a.withColumn("category", F.when(F.col("category") == old, F.lit(new)).otherwise(F.col("category")))
    title = F.lower("title")
    by_title = reduce(lambda w, x: w.when(title.rlike(x[0]), F.lit(x[1])), K.TITLE_CATEGORIES, F.when(F.lit(False), F.col("category"))).otherwise(F.col("category"))
    a = a.withColumn("category", F.when(F.col("category") == K.DEFAULT_CATEGORY, by_title).otherwise(F.col("category")))
    return a.withColumn("category", F.when(F.col("category").isNull() | (F.col("category") == ""), F.lit(K.DEFAULT_CATEGORY)).otherwise(F.col("category")))


def entities_of_articles(links: DataFrame, entities: DataFrame, limit: int = 300) -> DataFrame:
    """(article_id, name, type): the first `limit` by type and name, then one row for each (case-folded name, label)."""
    e = links.join(entities.select(F.col("id").alias("entity_id"), "name", "type"), "entity_id").select("article_id", "name", "type", "id")
    first = e.withColumn("pos", F.row_number().over(Window.partitionBy("article_id").orderBy("type", "name", "id"))).where(F.col("pos") <= limit)
    named = first.select("article_id", "name", label(F.col("type"), K.TYPE_LABELS, K.NO_TYPE).alias("type"), "pos")
    w = Window.partitionBy("article_id", F.lower("name"), "type").orderBy("pos")
    return named.withColumn("k", F.row_number().over(w)).where("k = 1").select("article_id", "name", "type")


def relations_of_articles(relations: DataFrame, entities: DataFrame, limit: int = 100) -> DataFrame:
    """Subject and object names of the latest `limit` relations of each article, each different one once."""
    s = entities.select(F.col("id").alias("subject_id"), F.col("name").alias("subject"), F.col("type").alias("st"))
    o = entities.select(F.col("id").alias("object_id"), F.col("name").alias("object"), F.col("type").alias("ot"))
    r = relations.join(s, "subject_id").join(o, "object_id")
    r = r.withColumn("pos", F.row_number().over(Window.partitionBy("article_id").orderBy(F.desc("id")))).where(F.col("pos") <= limit)
    r = r.select("article_id", "subject", label(F.col("st"), K.TYPE_LABELS, K.NO_TYPE).alias("subject_type"), F.upper(F.replace("relation_type", F.lit(" "), F.lit("_"))).alias("relation"), "object", label(F.col("ot"), K.TYPE_LABELS, K.NO_TYPE).alias("object_type"), "pos")
    w = Window.partitionBy("article_id", F.lower("subject"), "subject_type", "relation", F.lower("object"), "object_type").orderBy("pos")
    return r.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "pos")


def attributes_of_articles(attributes: DataFrame, entities: DataFrame, limit: int = 100) -> DataFrame:
    e = entities.select(F.col("id").alias("entity_id"), F.col("name").alias("entity"), "type")
    a = attributes.join(e, "entity_id").withColumn("pos", F.row_number().over(Window.partitionBy("article_id").orderBy(F.desc("id")))).where(F.col("pos") <= limit)
    key = F.upper(F.trim("attribute_key"))
    m = F.create_map(*[F.lit(v) for kv in {**K.TYPE_LABELS, **K.ATTRIBUTE_LABELS}.items() for v in kv])
    named = F.when(F.col("attribute_key").isNull() | (F.col("attribute_key") == ""), F.lit(K.NO_ATTRIBUTE)).otherwise(F.coalesce(m[key], key))
    return a.select("article_id", "entity", label(F.col("type"), K.TYPE_LABELS, K.NO_TYPE).alias("entity_type"), named.alias("attribute_key"), "attribute_value")


def statistics(articles: DataFrame) -> DataFrame:
    """(what, name, n): the total, and the counts by source and by category, in one table."""
    one = total(articles).select(F.lit("total").alias("what"), F.lit(None).cast("string").alias("name"), F.col("total").alias("n"))
    by = lambda df, c: df.select(F.lit(c).alias("what"), F.col(c).alias("name"), "n")
    return one.unionByName(by(count_by_source(articles), "source")).unionByName(by(count_by_category(articles), "category"))


def article_by_id(articles: DataFrame, article_id: int) -> DataFrame:
    """One article that is no upload, its content without boilerplate; no row if there is none."""
    a = articles.where(F.col("id") == article_id).where(not_uploaded())
    return a.withColumn("content", stripped(F.col("content"), F.col("source"))).limit(1)


def named(entities: DataFrame, names: list[str]) -> DataFrame:
    """Entities by their lower-cased names."""
    return entities.where(F.lower("name").isin(names))


def relation_ends(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(relation columns, subject, relation, object): both ends by name, the relation's type as a code."""
    end = lambda key, name: entities.select(F.col("id").alias(key), F.col("name").alias(name))
    return relations.join(end("subject_id", "subject"), "subject_id").join(end("object_id", "object"), "object_id").withColumn("relation", F.upper(F.replace("relation_type", F.lit(" "), F.lit("_"))))


def linked_entities(links: DataFrame, entities: DataFrame) -> DataFrame:
    """(article_id, entity_id, name, type) of every link."""
    return links.join(entities.select(F.col("id").alias("entity_id"), "name", "type"), "entity_id").select("article_id", "entity_id", "name", "type")
