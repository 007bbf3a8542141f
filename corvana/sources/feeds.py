"""Feeds: a catalogue of channels, and RSS items as articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvana.functions.dates import feed_date
from corvana.functions.text import feed_text

ARTICLE = "title string, link string, summary string, content string, published_date string, source string, category string"


def catalogue(spark: SparkSession, feeds: dict[str, dict]) -> DataFrame:
    """(source_key, name, category, url) from {key: {name, categories: {category: [urls]}}}."""
    rows = [(k, v["name"], c, u) for k, v in feeds.items() for c, urls in v["categories"].items() for u in urls]
    return spark.createDataFrame(rows, "source_key string, name string, category string, url string")


def parse_feeds(documents: DataFrame) -> DataFrame:
    """(feed columns, pos, article columns) from (xml, source, category): one row for each item of each document.

    A missing field is ''; the summary is also the content; a document that is not XML yields no items. Items are cut
    out by pattern, so one bad item costs no other."""
    items = F.regexp_extract_all("xml", F.lit(r"(?s)<item\b[^>]*>(.*?)</item>"), F.lit(1))

    def field(name: str):
        raw = F.regexp_extract("item", rf"(?s)<{name}\b[^>]*>(.*?)</{name}>", 1)
        cdata = F.regexp_extract(raw, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", 1)
        entities = raw
        for e, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            entities = F.replace(entities, F.lit(e), F.lit(ch))
        return F.trim(F.when(cdata != "", cdata).otherwise(entities))

    d = documents.select("*", F.posexplode(items).alias("pos", "item"))
    summary = feed_text(field("description"))
    return d.select(
        *[c for c in documents.columns if c not in ("xml", "source", "category")], "pos", field("title").alias("title"), field("link").alias("link"), summary.alias("summary"), summary.alias("content"),
        feed_date(field("pubDate")).alias("published_date"), "source", "category",
    )


def head(items: DataFrame, feed: list[str], limit: int = 50) -> DataFrame:
    """The first `limit` items of each feed."""
    w = Window.partitionBy(*feed).orderBy("pos")
    return items.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def read_xml(spark: SparkSession, path: str, source: str, category: str) -> DataFrame:
    """Whole feed files as (path, xml, source, category)."""
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("xml"))
    return d.withColumns({"source": F.lit(source), "category": F.lit(category)})
