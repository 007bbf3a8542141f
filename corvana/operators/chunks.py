"""Micro-chunks of texts and the context built from the best of them."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvana.functions.dates import source_date
from corvana.functions.text import preview


def words(c: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), " "), lambda w: w != "")


def windows(texts: DataFrame, text: str, size: int = 120, step: int = 100) -> DataFrame:
    """Fixed windows of `size` words every `step`; one row a window."""
    w = texts.withColumn("_w", words(F.col(text))).where(F.size("_w") > 0)
    at = F.sequence(F.lit(0), F.size("_w") - 1, F.lit(step))
    return w.select("*", F.posexplode(at).alias("chunk_no", "_at")).withColumn("chunk", F.array_join(F.slice("_w", F.col("_at") + 1, size), " ")).drop("_w", "_at")


def micro_chunks(c: Column, size: int = 120, overlap: int = 20) -> Column:
    """Whole sentences up to `size` words a chunk; a new chunk starts with the last `overlap` words of the one before;
    a sentence longer than that is cut into windows of its own."""
    sentences = F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    state = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"))

    def step(acc, sentence):
        w = words(sentence)
        n, cur, done = F.size(w), acc["cur"], acc["done"]
        flushed = F.when(F.size(cur) > 0, F.concat(done, F.array(F.array_join(cur, " ")))).otherwise(done)
        long = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)), lambda i: F.array_join(F.slice(w, i + 1, size), " "))
        tail = F.when(F.size(cur) > overlap, F.slice(cur, -overlap, overlap)).otherwise(cur)
        empty = F.array().cast("array<string>")
        return (
            F.when(n > size, F.struct(F.concat(flushed, long).alias("done"), empty.alias("cur")))
            .when(F.size(cur) + n > size, F.struct(flushed.alias("done"), F.concat(tail, w).alias("cur")))
            .otherwise(F.struct(done.alias("done"), F.concat(cur, w).alias("cur")))
        )

    def finish(acc):
        return F.filter(F.when(F.size(acc["cur"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["cur"], " ")))).otherwise(acc["done"]), lambda s: s != "")

    return F.aggregate(sentences, state, step, finish)


def score(chunk: Column, terms: list[str], keywords: list[str]) -> Column:
    """3 for every search term longer than two characters, 1 for every keyword."""
    c = F.lower(chunk)
    parts = [F.when(c.contains(t), 3.0).otherwise(0.0) for t in terms if len(t) > 2] + [F.when(c.contains(k), 1.0).otherwise(0.0) for k in keywords]
    return reduce(add, parts, F.lit(0.0))


def best(chunked: DataFrame, key: str, terms: list[str], keywords: list[str], most: int = 2) -> DataFrame:
    """The `most` best chunks of each text with a positive score, earlier ones first in ties."""
    s = chunked.withColumn("chunk_score", score(F.col("chunk"), terms, keywords)).where("chunk_score > 0")
    w = Window.partitionBy(key).orderBy(F.desc("chunk_score"), "chunk_no")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def holds_focus(focus: list[str]) -> Column:
    """Whether the title or the content holds one of the focus terms; always, if there are none."""
    hay = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit(""))))
    return reduce(lambda a, t: a | hay.contains(t), focus, F.lit(False)) if focus else F.lit(True)


def context(results: DataFrame, terms: list[str], keywords: list[str], focus: list[str]) -> DataFrame:
    """(id, context, chunk_text, article columns) for results that hold a focus term and a scoring chunk."""
    r = results.where(holds_focus(focus))
    chunked = r.select("*", F.posexplode(micro_chunks(F.col("content"))).alias("chunk_no", "chunk"))
    b = best(chunked, "id", terms, keywords).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk"))).alias("c"))
    j = r.join(b, "id")
    text = F.array_join(F.transform("c", lambda x: x["chunk"]), "\n...\n")
    day = source_date(F.col("published_date"))
    date = F.when(day.isNotNull(), F.concat(F.lit("\nNgày nguồn: "), day.cast("string"))).otherwise("")
    full = F.concat(F.lit("Nguồn: "), F.coalesce("source", F.lit("")), F.lit(" - "), F.coalesce("title", F.lit("")), date, F.lit("\nNội dung: "), text)
    return j.select("id", full.alias("context"), preview(F.col("c")[0]["chunk"]).alias("chunk_text"), F.round("score", 4).alias("similarity_score"), F.round("keyword_score", 4).alias("keyword_score"), "title", "source", "link", day.alias("published_date"))
