"""Problem 4: lines repeated across one site's documents, kept as compressed bitmaps.

Every line of a source is stored as the set of its documents in a sparse, word-aligned bitmap: one row
(source, line, variant, word, bits) per non-zero 64-bit word, where document `id` is bit `id & 63` of word
`id >> 6`. Empty words take no space, so rare lines cost one row and frequent ones at most one row per 64
documents. Building (`bit_or`), union of spellings (`bit_or`) and cardinality (`bit_count`) are primitive
aggregates with map-side combine; a hot source or line is split by `word`, never gathered in one task.

Defined results: rows with a null source, null or blank content or a null id yield no lines; a repeated
delivery sets the same bit and counts once; columns other than id, source and content are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvana.functions.text import nfc
from corvana.session import stored

SPACE = r"[\s\u001C-\u001F\u0085 ]+"


def same_line(line: Column) -> Column:
    """The form in which two lines (already in NFC) are the same: lower case, white space and digit runs unified."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), "(?U)" + SPACE, " ")), "[0-9]+", "0")


def _keyed(articles: DataFrame) -> DataFrame:
    """(source, id, line_no, k1, k2, variant): non-blank lines under 128-bit keys of their unified form."""
    a = articles.select(F.col("id").alias("id"), F.col("source").alias("source"), nfc("content").alias("content"))
    lines = a.where("id is not null and source is not null and content is not null").select("id", "source", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("form", same_line(F.col("line"))).where("form <> ''")
    return lines.select("source", "id", F.col("line_no").cast("int").alias("line_no"), F.xxhash64("form").alias("k1"), F.xxhash64(F.lit(7), "form").alias("k2"), F.xxhash64("line").alias("variant"))


def bitmaps(lines: DataFrame) -> DataFrame:
    """The store: one row for each non-zero word of each spelling's document bitmap."""
    bit = F.expr("shiftleft(1L, cast(id & 63 as int))")
    return lines.groupBy("source", "k1", "k2", "variant", F.shiftright("id", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def repeated(articles: DataFrame, store: DataFrame, least: int = 3, share: float = 0.01) -> DataFrame:
    """(source, k1, k2, word, bits, n, of): united bitmaps of the lines at or above both thresholds."""
    united = store.groupBy("source", "k1", "k2", "word").agg(F.bit_or("bits").alias("bits"), F.count(F.lit(1)).alias("spellings"))
    card = united.groupBy("source", "k1", "k2").agg(F.sum(F.bit_count("bits")).alias("n"))
    ids = articles.where("id is not null and source is not null").groupBy("source", F.shiftright("id", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(id & 63 as int))")).alias("bits"))
    total = ids.groupBy("source").agg(F.sum(F.bit_count("bits")).alias("of"))
    often = card.where(F.col("n") >= least).join(total, "source").where(F.col("n") >= F.col("of") * F.lit(share) - F.lit(1e-9))
    return united.join(often, ["source", "k1", "k2"]).select("source", "k1", "k2", "word", "bits", "n", "of")


def repeated_lines(articles: DataFrame, least: int = 3, share: float = 0.01) -> DataFrame:
    """(article_id, line_no): each line occurrence whose article's bit is set in the bitmap of a repeated line."""
    lines = stored(_keyed(articles), "lines")
    often = repeated(articles, bitmaps(lines), least, share)
    hit = lines.withColumn("word", F.shiftright("id", 6)).join(often, ["source", "k1", "k2", "word"])
    hit = hit.where(F.expr("(bits & shiftleft(1L, cast(id & 63 as int))) <> 0"))
    return hit.select(F.col("id").alias("article_id"), "line_no").distinct()


def without_repeated_lines(articles: DataFrame, least: int = 3, share: float = 0.01) -> DataFrame:
    """(article_id, removed, content): each article once, without its repeated lines; all others unchanged."""
    gone = repeated_lines(articles, least, share).groupBy("article_id").agg(F.collect_set("line_no").alias("gone"))
    one = articles.where("id is not null").groupBy(F.col("id").alias("article_id")).agg(F.max("content").alias("content"))
    joined = one.join(gone, "article_id", "left")
    kept = F.array_join(F.filter(F.split("content", "\n"), lambda line, i: ~F.array_contains(F.col("gone"), i)), "\n")
    return joined.select("article_id", F.coalesce(F.size("gone"), F.lit(0)).alias("removed"), F.when(F.col("gone").isNull(), F.col("content")).otherwise(kept).alias("content"))
