"""Lexicon and stop-word files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corvana.functions.constants import QUERY_STOPWORDS, SHORT_TERMS, STOPWORDS, TYPE_LABELS
from corvana.functions.text import match_form


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(type, phrase) from JSON objects type -> list of phrases; unknown types and other values are skipped."""
    d = spark.read.json(path, multiLine=True)
    lists = [f.name for f in d.schema.fields if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StringType) and f.name.upper().strip() in TYPE_LABELS]
    if not lists:
        return spark.createDataFrame([], "type string, phrase string")
    rows = d.select(F.explode(F.array(*[F.struct(F.lit(n.upper().strip()).alias("type"), F.col(f"`{n}`").alias("p")) for n in lists])).alias("x"))
    return usable(rows.select("x.type", F.explode("x.p").alias("phrase")))


def usable(rows: DataFrame) -> DataFrame:
    """Normalised phrases: three characters or a known short term, no stop word, not a number; each once."""
    r = rows.select("type", match_form(F.col("phrase")).alias("phrase"))
    ok = ((F.char_length("phrase") >= 3) | F.col("phrase").isin(*SHORT_TERMS)) & ~F.col("phrase").isin(*sorted(QUERY_STOPWORDS)) & ~F.col("phrase").rlike(r"^\d+$")
    return r.where(ok).distinct()


def read_stopwords(spark: SparkSession, path: str | None) -> frozenset[str]:
    """One word a line; the built-in list where no file is given. A list of words, bounded by the file."""
    if not path:
        return STOPWORDS
    rows = spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).where("w <> ''").distinct().limit(100_000).collect()
    return frozenset(r["w"] for r in rows)
