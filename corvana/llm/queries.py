"""Queries over the test tables, by problem, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvana.llm import bins, levels, main_text, mixing, names, near_copies, pieces, site_lines, subjects
from corvana.session import stored
from corvana.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, fn: Callable[..., DataFrame], *more: str) -> Query:
    return lambda spark, d: fn(table(spark, d, name), *(table(spark, d, m) for m in more))


def _pairs_within(classes: DataFrame, cls: str, key: str) -> DataFrame:
    """(id_a, id_b): the pairs of rows of one class that a pN_found query demands; the operators themselves give classes."""
    c = stored(classes.select(key, cls), "classes")
    return c.alias("x").join(c.alias("y"), cls).where(f"x.{key} < y.{key}").select(F.col(f"x.{key}").alias("id_a"), F.col(f"y.{key}").alias("id_b"))


def _copy_pairs(articles: DataFrame, limit: float = 0.7, n: int = 3) -> DataFrame:
    """Pairs of articles at or above the limit, from the classes of equal texts and the links between these."""
    members, links = near_copies.similar(articles, limit, n)
    left = members.select(F.col("rep").alias("a"), F.col("id").alias("u"))
    right = members.select(F.col("rep").alias("b"), F.col("id").alias("v"))
    cross = stored(links, "links").join(left, "a").join(right, "b").select(F.least("u", "v").alias("id_a"), F.greatest("u", "v").alias("id_b"))
    return cross.unionByName(_pairs_within(members, "rep", "id"))


def _variant_pairs(entities: DataFrame, short_forms: DataFrame) -> DataFrame:
    return _pairs_within(names.entities_of(entities, short_forms), "entity", "id")


def queries() -> dict[str, Query]:
    return {
        "p1_found": _over("articles", main_text.furniture_lines),
        "p1_stories": _over("articles", main_text.stories),
        "p2_found": _over("articles", subjects.subjects, "article_labels", "subject_areas"),
        "p2_shares": _over("articles", subjects.shares, "article_labels", "subject_areas"),
        "p3_found": _over("articles", _copy_pairs),
        "p3_classes": _over("articles", near_copies.classes),
        "p4_found": _over("articles", site_lines.repeated_lines),
        "p4_clean": _over("articles", site_lines.without_repeated_lines),
        "p5_found": _over("articles", pieces.boundaries),
        "p5_pieces": _over("articles", pieces.cut),
        "p6_found": _over("graph_entities", _variant_pairs, "short_forms"),
        "p6_entities": _over("graph_entities", names.entities_of, "short_forms"),
        "p7_containers": _over("documents", bins.packed),
        "p7_report": _over("documents", bins.report),
        "p8_uses": _over("documents", mixing.uses, "mix_targets"),
        "p8_shares": _over("documents", mixing.shares, "mix_targets"),
        "p9_found": _over("documents", levels.levels, "document_levels"),
        "p9_profile": _over("documents", levels.profile, "document_levels"),
    }


_P4 = r"""
WITH a AS (SELECT DISTINCT id, source, content FROM articles WHERE source IS NOT NULL),
l AS (SELECT id, source, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_no FROM a WHERE content IS NOT NULL),
f AS (SELECT id, source, line_no, regexp_replace(trim(regexp_replace(lower(nfc_normalize(line)), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g')), '[0-9]+', '0', 'g') AS form FROM l),
t AS (SELECT source, count(DISTINCT id) AS total FROM a GROUP BY source),
r AS (SELECT source, form, count(DISTINCT id) AS n FROM f WHERE form <> '' GROUP BY source, form)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _P4 + "SELECT f.id AS article_id, CAST(f.line_no AS INTEGER) AS line_no FROM f JOIN r USING (source, form) JOIN t USING (source) WHERE n >= 3 AND n * 100 >= total",
        "p4_clean": _P4
        + """, x AS (SELECT f.id, f.line_no FROM f JOIN r USING (source, form) JOIN t USING (source) WHERE n >= 3 AND n * 100 >= total),
        k AS (SELECT l.id, string_agg(line, chr(10) ORDER BY l.line_no) AS kept, count(*) AS n FROM l LEFT JOIN x ON l.id = x.id AND l.line_no = x.line_no WHERE x.id IS NULL GROUP BY l.id),
        g AS (SELECT id, count(*) AS n FROM x GROUP BY id),
        o AS (SELECT DISTINCT id, content FROM articles WHERE id IS NOT NULL)
        SELECT o.id AS article_id, CAST(coalesce(g.n, 0) AS INTEGER) AS removed, CASE WHEN g.n IS NULL THEN o.content ELSE coalesce(k.kept, '') END AS content FROM o LEFT JOIN g USING (id) LEFT JOIN k USING (id)""",
    }
