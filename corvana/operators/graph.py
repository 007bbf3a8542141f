"""The relational knowledge graph: nodes, links, edges, attributes and the incremental index."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvana.functions import constants as K
from corvana.functions.text import content_hash


def matched(articles: DataFrame, links: DataFrame, entities: DataFrame, terms: list[str]) -> DataFrame:
    """(article columns, match_terms, match_count): articles linked to an entity whose name is a term.

    The filtered entities drive the joins; articles are joined last, by the ids that remain."""
    e = entities.select(F.col("id").alias("entity_id"), F.lower("name").alias("name")).where(F.col("name").isin(terms))
    hits = links.join(e, "entity_id").groupBy(F.col("article_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("match_terms"), F.countDistinct("entity_id").alias("match_count"))
    return articles.join(hits, "id")


def queue(articles: DataFrame, index: DataFrame, signature: str | Column) -> DataFrame:
    """Articles to process: not in the index, under another signature, or changed since."""
    h = articles.where("content is not null").withColumn("hash", content_hash(F.col("title"), F.col("content")))
    i = index.select(F.col("article_id").alias("id"), "extractor_signature", "content_hash", F.lit(True).alias("known"))
    j = h.join(i, "id", "left")
    return j.where(F.col("known").isNull() | ~F.col("extractor_signature").eqNullSafe(F.lit(signature)) | ~F.col("content_hash").eqNullSafe(F.col("hash"))).drop("extractor_signature", "content_hash", "known")


def backfill(articles: DataFrame, links: DataFrame, relations: DataFrame, attributes: DataFrame) -> DataFrame:
    """Index rows (three counts and the hash) for articles with content that already have derived rows."""
    counts = [
        t.groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias(n))
        for t, n in ((links, "entity_count"), (relations, "relation_count"), (attributes, "attribute_count"))
    ]
    j = reduce(lambda a, c: a.join(c, "id", "left"), counts, articles.where("content is not null"))
    for n in ("entity_count", "relation_count", "attribute_count"):
        j = j.withColumn(n, F.coalesce(n, F.lit(0)))
    return j.where("entity_count + relation_count + attribute_count > 0").select(F.col("id").alias("article_id"), content_hash(F.col("title"), F.col("content")).alias("content_hash"), "entity_count", "relation_count", "attribute_count")


def derived_counts(links: DataFrame, relations: DataFrame, attributes: DataFrame) -> DataFrame:
    """(article_id, entities, relations, attributes): one pass over the union instead of three joins."""
    rows = reduce(DataFrame.unionByName, [t.select("article_id", *[F.lit(int(k == i)).alias(n) for k, n in enumerate(("entities", "relations", "attributes"))]) for i, t in enumerate((links, relations, attributes))])
    return rows.groupBy("article_id").agg(*[F.sum(n).alias(n) for n in ("entities", "relations", "attributes")])


def insert_new(existing: DataFrame, batch: DataFrame, key: list[str], id_col: str = "id") -> DataFrame:
    """The batch's rows whose key is new, once each, numbered on from the largest id in the order of the key."""
    new = batch.select(key).dropDuplicates(key).join(existing.select(key), key, "left_anti")
    return numbered(new, existing, key, id_col)


def numbered(new: DataFrame, existing: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """Dense ids after the largest existing one, without one task holding all rows: range-sorted, counted by
    partition, then numbered inside each partition."""
    base = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("base"))
    ranged = new.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id())
    n = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    before = n.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    out = ranged.join(F.broadcast(before.select("part", "before", "first")), "part").crossJoin(F.broadcast(base))  # one row
    return out.select((F.col("base") + F.col("before") + F.col("pos") - F.col("first") + 1).cast("long").alias(id_col), *new.columns)


def upsert_articles(existing: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """Articles after a batch in the order of `seq` (existing rows come first), keyed by the first 500 characters of the link.

    Content and summary: last wins. Title, date, source: first stays. Category: the first that is not empty or the
    default, else the last. Rows without a link never meet."""
    a = existing.withColumn(seq, F.lit(0)).unionByName(batch, allowMissingColumns=True)
    key = F.when(F.col("link").isNull(), F.concat(F.lit("\0"), F.xxhash64(*[F.col(c) for c in a.columns]).cast("string"), F.monotonically_increasing_id().cast("string"))).otherwise(F.substring("link", 1, 500))
    a = a.withColumn("key", key).withColumn("o", F.struct(F.col(seq), F.col("id")))
    real = F.col("category").isNotNull() & ~F.col("category").isin("", K.DEFAULT_CATEGORY)
    first = lambda c: F.min_by(c, "o").alias(c)
    g = a.groupBy("key").agg(
        F.min("id").alias("id"), first("title"), first("link"), F.max_by("summary", "o").alias("summary"), F.max_by("content", "o").alias("content"), first("published_date"), first("source"),
        F.coalesce(F.min_by("category", F.when(real, F.col("o"))), F.max_by("category", "o")).alias("category"),
    )
    return g.drop("key")


def delete_articles(articles: DataFrame, tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Everything after deleting articles (not uploads): their links, relations, attributes and index rows go too; nodes stay."""
    gone = articles.join(ids.select("id"), "id", "left_semi").where(~F.startswith("link", F.lit(K.UPLOAD))).select(F.col("id").alias("article_id"))
    return {"articles": articles.join(gone, articles["id"] == gone["article_id"], "left_anti"), **clear(tables, gone)}


def clear(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    return {n: t.join(ids.select("article_id"), "article_id", "left_anti") for n, t in tables.items()}


def keyed_value(rows: DataFrame, key: str | list[str], value: str, order: Column) -> DataFrame:
    """Last value of each key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def unique_entities(found: DataFrame, graph_types: list[str]) -> DataFrame:
    """(article_id, name, type) from (article_id, type, value): graph types only, lower case, longer than two characters."""
    e = found.where(F.col("type").isin(graph_types)).select("article_id", F.lower(F.trim("value")).alias("name"), "type")
    return e.where(F.char_length("name") > 2).distinct()


def build(found: DataFrame, relations: DataFrame, attributes: DataFrame, entities: DataFrame, graph_types: list[str]) -> dict[str, DataFrame]:
    """Nodes, links, edges and attributes for a batch of extraction results.

    Ends of relations and owners of attributes become nodes too, but are not linked to the article."""
    own = unique_entities(found, graph_types)
    low = lambda c: F.lower(F.trim(F.col(c)))
    ends = relations.select(low("subject").alias("name"), F.col("subject_type").alias("type")).union(relations.select(low("object"), F.col("object_type"))).union(attributes.select(low("entity"), F.col("entity_type")))
    nodes = own.select("name", "type").union(ends).distinct()
    new = insert_new(entities, nodes, ["type", "name"]).select("id", "name", "type")
    every = entities.select("id", "name", "type").unionByName(new)
    n = lambda i, a, b: every.select(F.col("id").alias(i), F.col("name").alias(a), F.col("type").alias(b))
    links = own.join(every, ["name", "type"]).select("article_id", F.col("id").alias("entity_id")).distinct()
    r = relations.select("article_id", low("subject").alias("s"), F.col("subject_type").alias("st"), "relation", low("object").alias("o"), F.col("object_type").alias("ot"))
    edges = r.join(n("subject_id", "s", "st"), ["s", "st"]).join(n("object_id", "o", "ot"), ["o", "ot"]).select("subject_id", F.col("relation").alias("relation_type"), "object_id", "article_id").distinct()
    a = attributes.select("article_id", low("entity").alias("s"), F.col("entity_type").alias("st"), "attribute_key", "attribute_value")
    values = a.join(n("entity_id", "s", "st"), ["s", "st"]).select("entity_id", "attribute_key", "attribute_value", "article_id").distinct()
    return {"entities": new, "links": links, "relations": edges, "attributes": values}


#: Raised whenever the rules of extraction change, so that graphs built under older ones are built anew.
RULES_VERSION = "2"
DERIVED = ("article_graph", "entity_relations", "entity_attributes", "article_graph_index")
INDEX = "article_id long, extractor_signature string, content_hash string, entity_count long, relation_count long, attribute_count long"


def rules_signature(lexicon: dict[str, list[str]] | None = None, version: str = RULES_VERSION) -> str:
    """One hash of the rules' version and the lexicon, whatever the order of its types and phrases."""
    lines = sorted(f"{k}\t{p}" for k, ps in (lexicon or {}).items() for p in ps)
    return hashlib.sha256("\n".join([version, *lines]).encode()).hexdigest()


def build_mode(full: bool, stored_signature: str | None, signature: str, has_data: bool) -> str:
    """'reset' (asked for, or the rules have changed), 'backfill' (data without a signature), or 'incremental'."""
    if full or stored_signature and stored_signature != signature:
        return "reset"
    return "backfill" if has_data and not stored_signature else "incremental"


def reset(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The same tables without rows."""
    return {n: t.limit(0) for n, t in tables.items()}


def index_rows(processed: DataFrame, built: dict[str, DataFrame], signature: str) -> DataFrame:
    """Index rows of the processed articles (id, hash), with the counts of the rows that were written for each."""
    count = lambda n: built[n].groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    j = processed.select("id", "hash").dropDuplicates(["id"])
    for n, c in (("links", "entity_count"), ("relations", "relation_count"), ("attributes", "attribute_count")):
        j = j.join(count(n).withColumnRenamed("n", c), "id", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("entity_count", "relation_count", "attribute_count")]
    return j.select(F.col("id").alias("article_id"), F.lit(signature).alias("extractor_signature"), F.col("hash").alias("content_hash"), *counts)


def with_column_updated(rows: DataFrame, column: str, updates: DataFrame, key: str = "id") -> DataFrame:
    """`column` replaced by the updates' value where they have the key (the smallest, should a key repeat); other rows stay."""
    u = updates.groupBy(key).agg(F.min(F.struct(column)).alias("_new"))
    return rows.join(u, key, "left").withColumn(column, F.when(F.col("_new").isNotNull(), F.col("_new")[column]).otherwise(F.col(column))).select(rows.columns)


def missing_tables(spark: SparkSession, names: tuple[str, ...] = DERIVED) -> list[str]:
    """The derived tables that the catalog does not have."""
    return [n for n in names if not spark.catalog.tableExists(n)]


def missing_columns(rows: DataFrame, schema: str) -> list[str]:
    """Columns of a schema that a table lacks."""
    return [f.split()[0] for f in schema.split(", ") if f.split()[0] not in rows.columns]
