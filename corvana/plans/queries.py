"""One query for each operator over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvana.functions import constants as K
from corvana.functions import dates as D
from corvana.functions import text as T
from corvana.operators import boilerplate as B
from corvana.operators import chunks as C
from corvana.operators import dedup as U
from corvana.operators import graph as G
from corvana.operators import ner as N
from corvana.operators import search as S
from corvana.operators import views as V
from corvana.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TERMS = ["kỷ lục", "lãi suất", "bệnh viện"]
WEIGHTS = {"kỷ lục": 4.0, "lãi suất": 2.0, "bệnh viện": 1.0}
NAMES = ["nam thành", "bắc lam", "vịnh sa", "hội đồng lưu vực"]
NAME_WEIGHTS = {"nam thành": 4.0, "bắc lam": 3.5}
SIGNATURE = "0" * 64
DAY = dt.date(2025, 9, 26)
NOT_UPLOADED = "link NOT LIKE 'upload://%'"


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = lambda spark, d: fn(lambda t: table(spark, d, t))
        if sql:
            SQL[name] = sql
        return fn

    return keep


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- filters, predicates, projections

@query("f1_upload_exclusion", f"SELECT id, link FROM articles WHERE {NOT_UPLOADED}")
def _(t):
    return t("articles").where(V.not_uploaded()).select("id", "link")


@query("f2_category_equals", "SELECT id, category FROM articles WHERE category = 'Số hóa'")
def _(t):
    return t("articles").where(V.article_filters(category=K.CATEGORY_ALIASES["Công nghệ"])).select("id", "category")


@query("f3_date_range", "SELECT id, published_date FROM articles WHERE published_date >= '2024-03-01' AND published_date < '2024-06-01'")
def _(t):
    return t("articles").where(V.article_filters(from_date=dt.date(2024, 3, 1), to_date=dt.date(2024, 5, 31))).select("id", "published_date")


@query("f4_conjunction", "SELECT id, category, published_date FROM articles WHERE category = 'Thể thao' AND published_date >= '2024-01-01'")
def _(t):
    return t("articles").where(V.article_filters(category=" Thể thao ", from_date=dt.date(2024, 1, 1))).select("id", "category", "published_date")


@query("f5_text_search", "SELECT id, title FROM articles WHERE title LIKE '%kỷ%lục%' OR summary LIKE '%kỷ%lục%' OR content LIKE '%kỷ%lục%'")
def _(t):
    return t("articles").where(V.like_any(["title", "summary", "content"], ["%kỷ%lục%"])).select("id", "title")


_ANY = " OR ".join(f"lower({c}) LIKE '%{x}%'" for x in TERMS for c in ("title", "content"))


@query("f6_any_term", f"SELECT id FROM articles WHERE {_ANY}")
def _(t):
    return t("articles").where(V.contains_any(["title", "content"], TERMS)).select("id")


@query("f7_required_terms", f"SELECT id FROM articles WHERE ({_ANY}) AND (lower(title) LIKE '%kỷ lục%' OR lower(content) LIKE '%kỷ lục%')")
def _(t):
    return t("articles").where(V.contains_any(["title", "content"], TERMS) & V.contains_any(["title", "content"], TERMS[:1])).select("id")


@query("f8_name_in_list", f"SELECT id, name, type FROM graph_entities WHERE lower(name) IN ({', '.join(map(lit, NAMES))})")
def _(t):
    return t("graph_entities").where(F.lower("name").isin(NAMES)).select("id", "name", "type")


_LINK_CASE = " ".join(f"WHEN {' OR '.join(f'{c} LIKE {lit(chr(37) + p + chr(37))}' for p in ps)} THEN {lit(k)}" for c, ps, k in K.LINK_CATEGORIES)
_TITLE_CASE = " ".join(f"WHEN regexp_matches(lower(title), {lit(p)}) THEN {lit(k)}" for p, k in K.TITLE_CATEGORIES)
_ALIAS_CASE = " ".join(f"WHEN c1 = {lit(a)} THEN {lit(b)}" for a, b in K.CATEGORY_ALIASES.items())


@query(
    "f9_classify",
    f"""WITH a AS (SELECT *, CASE WHEN category IS NULL OR category = '' OR category = {lit(K.DEFAULT_CATEGORY)} THEN CASE {_LINK_CASE} ELSE category END ELSE category END AS c1 FROM articles),
    b AS (SELECT *, CASE {_ALIAS_CASE} ELSE c1 END AS c2 FROM a), c AS (SELECT *, CASE WHEN c2 = {lit(K.DEFAULT_CATEGORY)} THEN CASE {_TITLE_CASE} ELSE c2 END ELSE c2 END AS c3 FROM b)
    SELECT id, CASE WHEN c3 IS NULL OR c3 = '' THEN {lit(K.DEFAULT_CATEGORY)} ELSE c3 END AS category FROM c""",
)
def _(t):
    return V.classify(t("articles").select("id", "title", "link", "source", "category")).select("id", "category")


@query("f13_content_length", "SELECT id, CAST(length(content) AS INTEGER) AS content_length FROM articles")
def _(t):
    return t("articles").select("id", F.char_length("content").alias("content_length"))


@query("f14_by_ids", "SELECT id, title, source FROM articles WHERE id IN (3, 5, 8, 13, 21)")
def _(t):
    return t("articles").where(F.col("id").isin(3, 5, 8, 13, 21)).select("id", "title", "source")


@query("f16_focus_terms", "SELECT id FROM articles WHERE lower(coalesce(title, '') || chr(10) || coalesce(content, '')) LIKE '%lãi suất%' OR lower(coalesce(title, '') || chr(10) || coalesce(content, '')) LIKE '%kỷ lục%'")
def _(t):
    hay = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit(""))))
    return t("articles").where(hay.contains("lãi suất") | hay.contains("kỷ lục")).select("id")


@query("f17_no_information", "SELECT id FROM articles WHERE " + " OR ".join(f"lower(summary) LIKE {lit('%' + m + '%')}" for m in K.NO_INFO))
def _(t):
    return t("articles").where(V.contains_any(["summary"], list(K.NO_INFO))).select("id")


@query("f18_categories_present", "SELECT DISTINCT category FROM articles WHERE category IS NOT NULL AND category <> ''")
def _(t):
    return V.categories(t("articles"), uploads=True)


@query("f19_cleaned_preview", "SELECT id, substr(cleaned_content, 1, 200) AS head FROM articles WHERE cleaned_content IS NOT NULL ORDER BY id LIMIT 10")
def _(t):
    return t("articles").where("cleaned_content is not null").orderBy("id", "cleaned_content").limit(10).select("id", F.substring("cleaned_content", 1, 200).alias("head"))


# ---- joins

@query(
    "j1_graph_three_way",
    f"""SELECT a.id, array_to_string(list_sort(list_distinct(list(lower(e.name)))), '|') AS terms, count(DISTINCT g.entity_id) AS match_count FROM (SELECT DISTINCT id FROM articles) a
    JOIN article_graph g ON a.id = g.article_id JOIN graph_entities e ON g.entity_id = e.id WHERE lower(e.name) IN ({', '.join(map(lit, NAMES))}) GROUP BY a.id""",
)
def _(t):
    m = G.matched(t("articles").select("id").distinct(), t("article_graph"), t("graph_entities"), NAMES)
    return m.select("id", F.array_join("match_terms", "|").alias("terms"), "match_count")


@query("j2_link_entities", "SELECT g.article_id, e.name, e.type FROM article_graph g JOIN graph_entities e ON g.entity_id = e.id")
def _(t):
    return t("article_graph").join(t("graph_entities").select(F.col("id").alias("entity_id"), "name", "type"), "entity_id").select("article_id", "name", "type")


@query("j3_relation_ends", "SELECT r.id, s.name AS subject, upper(replace(r.relation_type, ' ', '_')) AS relation, o.name AS object FROM entity_relations r JOIN graph_entities s ON r.subject_id = s.id JOIN graph_entities o ON r.object_id = o.id")
def _(t):
    e = t("graph_entities")
    s, o = e.select(F.col("id").alias("subject_id"), F.col("name").alias("subject")), e.select(F.col("id").alias("object_id"), F.col("name").alias("object"))
    return t("entity_relations").join(s, "subject_id").join(o, "object_id").select("id", "subject", F.upper(F.replace("relation_type", F.lit(" "), F.lit("_"))).alias("relation"), "object")


@query("j4_attribute_entities", "SELECT a.id, e.name AS entity, a.attribute_key, a.attribute_value FROM entity_attributes a JOIN graph_entities e ON a.entity_id = e.id")
def _(t):
    e = t("graph_entities").select(F.col("id").alias("entity_id"), F.col("name").alias("entity"))
    return t("entity_attributes").join(e, "entity_id").select("id", "entity", "attribute_key", "attribute_value")


_HASH = "sha256(coalesce(a.title, '') || chr(10) || coalesce(a.content, ''))"


@query(
    "j5_incremental_queue",
    f"""SELECT DISTINCT a.id FROM articles a LEFT JOIN article_graph_index i ON a.id = i.article_id, (SELECT max(extractor_signature) AS s FROM article_graph_index) m
    WHERE a.content IS NOT NULL AND (i.article_id IS NULL OR i.extractor_signature IS DISTINCT FROM m.s OR i.content_hash IS DISTINCT FROM {_HASH})""",
)
def _(t):
    i = t("article_graph_index")
    latest = i.agg(F.max("extractor_signature").alias("latest"))  # one row
    return G.queue(t("articles").crossJoin(F.broadcast(latest)), i, F.col("latest")).select("id").distinct()


_COUNTS = " ".join(f"LEFT JOIN (SELECT article_id, count(*) AS {n} FROM {x} GROUP BY 1) {n}_ ON a.id = {n}_.article_id" for x, n in (("article_graph", "ec"), ("entity_relations", "rc"), ("entity_attributes", "ac")))


@query(
    "j6_backfill_index",
    f"""SELECT a.id AS article_id, {_HASH} AS content_hash, coalesce(ec, 0) AS entity_count, coalesce(rc, 0) AS relation_count, coalesce(ac, 0) AS attribute_count FROM articles a {_COUNTS}
    WHERE a.content IS NOT NULL AND coalesce(ec, 0) + coalesce(rc, 0) + coalesce(ac, 0) > 0""",
)
def _(t):
    return G.backfill(t("articles"), t("article_graph"), t("entity_relations"), t("entity_attributes"))


@query("j7_semi_relations", f"SELECT id FROM articles a WHERE {NOT_UPLOADED} AND EXISTS (SELECT 1 FROM entity_relations r WHERE r.article_id = a.id)")
def _(t):
    return t("articles").where(V.not_uploaded()).join(t("entity_relations").select(F.col("article_id").alias("id")), "id", "left_semi").select("id")


@query("j8_scalar_counts", "SELECT a.id, (SELECT count(*) FROM entity_relations r WHERE r.article_id = a.id) AS relation_count, (SELECT count(*) FROM article_graph g WHERE g.article_id = a.id) AS entity_count FROM articles a")
def _(t):
    return V.with_counts(t("articles").select("id"), t("entity_relations"), t("article_graph")).select("id", "relation_count", "entity_count")


# ---- aggregates

@query("a1_total", f"SELECT count(*) AS total FROM articles WHERE {NOT_UPLOADED}")
def _(t):
    return V.total(t("articles"))


@query("a2_by_source", f"SELECT source, count(*) AS n FROM articles WHERE {NOT_UPLOADED} GROUP BY source")
def _(t):
    return V.count_by_source(t("articles"))


@query("a3_by_category", f"SELECT CASE trim(category) WHEN 'Công nghệ' THEN 'Số hóa' WHEN 'Thời tiết Hà Nội' THEN 'Thời tiết Việt Nam' ELSE trim(category) END AS category, count(*) AS n FROM articles WHERE {NOT_UPLOADED} GROUP BY 1")
def _(t):
    return V.count_by_category(t("articles"))


@query("a4_entities_by_type", "SELECT type, count(*) AS n FROM graph_entities GROUP BY type")
def _(t):
    return t("graph_entities").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("a5_distinct_entities", "SELECT article_id, count(DISTINCT entity_id) AS n FROM article_graph GROUP BY article_id")
def _(t):
    return t("article_graph").groupBy("article_id").agg(F.countDistinct("entity_id").alias("n"))


@query("a6_joined_names", "SELECT g.article_id, string_agg(DISTINCT lower(e.name), '|' ORDER BY lower(e.name)) AS names FROM article_graph g JOIN graph_entities e ON g.entity_id = e.id GROUP BY g.article_id")
def _(t):
    e = t("graph_entities").select(F.col("id").alias("entity_id"), F.lower("name").alias("name"))
    return t("article_graph").join(e, "entity_id").groupBy("article_id").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("names"))


@query(
    "a8_derived_counts",
    "SELECT article_id, CAST(sum(e) AS BIGINT) AS entities, CAST(sum(r) AS BIGINT) AS relations, CAST(sum(a) AS BIGINT) AS attributes FROM (SELECT article_id, 1 AS e, 0 AS r, 0 AS a FROM article_graph UNION ALL SELECT article_id, 0, 1, 0 FROM entity_relations UNION ALL SELECT article_id, 0, 0, 1 FROM entity_attributes) GROUP BY article_id",
)
def _(t):
    return G.derived_counts(t("article_graph"), t("entity_relations"), t("entity_attributes"))


@query("a9_build_totals", "SELECT e.type, count(*) AS links, count(DISTINCT g.article_id) AS articles FROM article_graph g JOIN graph_entities e ON g.entity_id = e.id GROUP BY e.type")
def _(t):
    e = t("graph_entities").select(F.col("id").alias("entity_id"), "type")
    return t("article_graph").join(e, "entity_id").groupBy("type").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("article_id").alias("articles"))


@query("a13_clean_run", "SELECT count(*) AS seen, count(cleaned_content) AS cleaned, round(100.0 - 100.0 * sum(CASE WHEN cleaned_content IS NOT NULL THEN length(cleaned_content) END) / sum(CASE WHEN cleaned_content IS NOT NULL THEN length(content) END), 1) AS reduction FROM articles WHERE content IS NOT NULL")
def _(t):
    done = F.col("cleaned_content").isNotNull()
    a = t("articles").where("content is not null")
    n = lambda c: F.sum(F.when(done, F.char_length(c)))
    return a.agg(F.count(F.lit(1)).alias("seen"), F.count("cleaned_content").alias("cleaned"), F.round(F.lit(100.0) - F.lit(100.0) * n("cleaned_content") / n("content"), 1).alias("reduction"))


# ---- views, order, limits

_VIEW = "a.id, a.title, a.link, a.summary, a.source, a.category, a.published_date, CAST(length(a.content) AS INTEGER) AS content_length, (SELECT count(*) FROM entity_relations r WHERE r.article_id = a.id) AS relation_count, (SELECT count(*) FROM article_graph g WHERE g.article_id = a.id) AS entity_count"
_NEWEST = "ORDER BY a.published_date DESC NULLS LAST, a.id"


@query("v1_list_news", f"SELECT {_VIEW} FROM articles a WHERE a.{NOT_UPLOADED} {_NEWEST} LIMIT 20 OFFSET 40")
def _(t):
    return V.list_news(t("articles"), t("entity_relations"), t("article_graph"), 20, 40)


@query("v1_list_category", f"SELECT {_VIEW} FROM articles a WHERE a.{NOT_UPLOADED} AND a.category = 'Thể thao' AND EXISTS (SELECT 1 FROM entity_relations r WHERE r.article_id = a.id) {_NEWEST} LIMIT 20")
def _(t):
    return V.list_news(t("articles"), t("entity_relations"), t("article_graph"), category="Thể thao", has_relations=True)


@query("v2_search_news", f"SELECT {_VIEW} FROM articles a WHERE a.{NOT_UPLOADED} AND (a.title LIKE '%kỷ lục%' OR a.summary LIKE '%kỷ lục%' OR a.content LIKE '%kỷ lục%') {_NEWEST} LIMIT 100")
def _(t):
    return V.search_news(t("articles"), t("entity_relations"), t("article_graph"), "kỷ lục")


_TYPE_CASE = "CASE WHEN {0} IS NULL OR {0} = '' THEN " + lit(K.NO_TYPE) + " " + " ".join(f"WHEN upper(trim({{0}})) = {lit(a)} THEN {lit(b)}" for a, b in K.TYPE_LABELS.items()) + " ELSE trim({0}) END"
_KEY_CASE = "CASE WHEN {0} IS NULL OR {0} = '' THEN " + lit(K.NO_ATTRIBUTE) + " " + " ".join(f"WHEN upper(trim({{0}})) = {lit(a)} THEN {lit(b)}" for a, b in {**K.TYPE_LABELS, **K.ATTRIBUTE_LABELS}.items()) + " ELSE upper(trim({0})) END"


@query(
    "v5_article_entities",
    f"""WITH e AS (SELECT g.article_id, e.name, e.type, row_number() OVER (PARTITION BY g.article_id ORDER BY e.type, e.name, g.id) AS pos FROM article_graph g JOIN graph_entities e ON g.entity_id = e.id),
    n AS (SELECT article_id, name, {_TYPE_CASE.format('type')} AS type, pos FROM e WHERE pos <= 300),
    k AS (SELECT *, row_number() OVER (PARTITION BY article_id, lower(name), type ORDER BY pos) AS k FROM n) SELECT article_id, name, type FROM k WHERE k = 1""",
)
def _(t):
    return V.entities_of_articles(t("article_graph"), t("graph_entities"))


@query(
    "v6_article_relations",
    f"""WITH r AS (SELECT r.article_id, s.name AS subject, {_TYPE_CASE.format('s.type')} AS subject_type, upper(replace(r.relation_type, ' ', '_')) AS relation, o.name AS object, {_TYPE_CASE.format('o.type')} AS object_type,
    row_number() OVER (PARTITION BY r.article_id ORDER BY r.id DESC) AS pos FROM entity_relations r JOIN graph_entities s ON r.subject_id = s.id JOIN graph_entities o ON r.object_id = o.id),
    k AS (SELECT *, row_number() OVER (PARTITION BY article_id, lower(subject), subject_type, relation, lower(object), object_type ORDER BY pos) AS k FROM r WHERE pos <= 100)
    SELECT article_id, subject, subject_type, relation, object, object_type FROM k WHERE k = 1""",
)
def _(t):
    return V.relations_of_articles(t("entity_relations"), t("graph_entities"))


@query(
    "v7_article_attributes",
    f"""WITH a AS (SELECT a.article_id, e.name AS entity, {_TYPE_CASE.format('e.type')} AS entity_type, {_KEY_CASE.format('a.attribute_key')} AS attribute_key, a.attribute_value,
    row_number() OVER (PARTITION BY a.article_id ORDER BY a.id DESC) AS pos FROM entity_attributes a JOIN graph_entities e ON a.entity_id = e.id) SELECT article_id, entity, entity_type, attribute_key, attribute_value FROM a WHERE pos <= 100""",
)
def _(t):
    return V.attributes_of_articles(t("entity_attributes"), t("graph_entities"))


@query("v8_categories", f"SELECT DISTINCT category FROM articles WHERE category IS NOT NULL AND category <> '' AND {NOT_UPLOADED} ORDER BY category")
def _(t):
    return V.categories(t("articles"))


@query("l2_search_page", f"SELECT id, published_date FROM (SELECT id, published_date FROM articles a WHERE a.{NOT_UPLOADED} {_NEWEST} LIMIT 100) a {_NEWEST} LIMIT 20 OFFSET 20")
def _(t):
    return V.page_of(t("articles").where(V.not_uploaded()).select("id", "published_date"), V.newest_first(), 2)


@query("l5_longest", "SELECT id, CAST(length(content) AS INTEGER) AS n FROM (SELECT DISTINCT id, content FROM articles) ORDER BY length(content) DESC NULLS LAST, id LIMIT 25")
def _(t):
    return t("articles").select("id", F.char_length("content").alias("n")).distinct().orderBy(F.desc_nulls_last("n"), "id").limit(25)


_DAYS = " OR ".join(f"lower(coalesce(title, '') || chr(10) || coalesce(content, '')) LIKE '%{v}%'" for v in D.variants(DAY, wide=True))


@query("l9_prefer_day", f"SELECT id, coalesce({_DAYS}, false) AS mentions FROM articles ")
def _(t):
    return S.prefer_day(t("articles"), DAY, ["id", "collected_at"]).select("id", "mentions")


# ---- text functions

_W = r"[^\p{L}\p{N}\p{M}_\s]"


@query("t1_match_form", rf"SELECT id, trim(regexp_replace(regexp_replace(lower(nfc_normalize(content)), '{_W}', ' ', 'g'), '\s+', ' ', 'g')) AS form FROM articles")
def _(t):
    return t("articles").select("id", T.match_form(T.nfc("content")).alias("form"))


@query("t2_nfc", "SELECT id, sha256(nfc_normalize(content)) AS h FROM articles")
def _(t):
    return t("articles").select("id", F.sha2(T.nfc("content"), 256).alias("h"))


@query("t3_without_urls", r"SELECT doc_id, sha256(regexp_replace(text, '(?i)https?://\S+|www\.\S+', '', 'g')) AS h FROM documents")
def _(t):
    return t("documents").select("doc_id", F.sha2(T.without_urls(F.col("text")), 256).alias("h"))


@query("t5_without_symbols", r"""SELECT id, sha256(regexp_replace(nfc_normalize(content), '[^\p{L}\p{N}\p{M}_\s\x{85}\p{Z},.:;!?()\-+=''"/\\]', '', 'g')) AS h FROM articles""")
def _(t):
    return t("articles").select("id", F.sha2(T.without_symbols(T.nfc("content")), 256).alias("h"))


@query("t6_plain_letters", rf"SELECT id, trim(regexp_replace(regexp_replace(nfc_normalize(content), '[^a-zA-Z0-9\s_đĐ{K.VIETNAMESE}]', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM articles")
def _(t):
    return t("articles").select("id", T.plain_letters(T.nfc("content")).alias("plain"))


@query("t9_without_stopwords", "SELECT id, array_to_string(list_filter(string_split_regex(trim(content, ' '), '\\s+'), lambda w: w <> '' AND lower(w) NOT IN (" + ", ".join(lit(w) for w in sorted(K.STOPWORDS)) + ")), ' ') AS kept FROM articles WHERE content IS NOT NULL")
def _(t):
    return t("articles").where("content is not null").select("id", T.without_stopwords(F.col("content")).alias("kept"))


@query("t7_compounds")
def _(t):
    return t("articles").select("id", T.compounds(T.nfc("content")).alias("joined"))


@query("t10_cleaned")
def _(t):
    return t("articles").where("content is not null").select("id", T.cleaned(T.nfc("content")).alias("cleaned"))


@query("h1_explicit_date", rf"""SELECT id, CASE WHEN d <> '' THEN try_cast((CASE WHEN y = '' THEN '2024' WHEN length(y) = 2 THEN '20' || y ELSE lpad(y, 4, '0') END) || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') AS DATE) END AS day FROM
    (SELECT id, regexp_extract(content, '{D._EXPLICIT}', 1) AS d, regexp_extract(content, '{D._EXPLICIT}', 2) AS m, regexp_extract(content, '{D._EXPLICIT}', 3) AS y FROM articles WHERE content IS NOT NULL)""")
def _(t):
    return t("articles").where("content is not null").select("id", D.explicit_date(F.col("content"), 2024).alias("day"))


@query("h2_question_range")
def _(t):
    low, high = D.question_range(F.col("title"), DAY)
    return t("articles").select("id", low.alias("from_date"), high.alias("to_date")).where("from_date is not null")


@query("h5_source_date", r"SELECT id, try_cast(nullif(regexp_extract(trim(published_date), '^(\d{4}-\d{2}-\d{2})', 1), '') AS DATE) AS day FROM articles")
def _(t):
    return t("articles").select("id", D.source_date(F.col("published_date")).alias("day"))


@query("h7_content_hash", f"SELECT a.id, {_HASH} AS h FROM articles a")
def _(t):
    return t("articles").select("id", T.content_hash(F.col("title"), F.col("content")).alias("h"))


@query("h8_type_labels", f"SELECT id, {_TYPE_CASE.format('type')} AS label FROM graph_entities")
def _(t):
    return t("graph_entities").select("id", T.label(F.col("type"), K.TYPE_LABELS, K.NO_TYPE).alias("label"))


@query("h10_keyword_overlap", "SELECT id, (CASE WHEN lower(content) LIKE '%kỷ lục%' THEN 1 ELSE 0 END + CASE WHEN lower(content) LIKE '%lãi suất%' THEN 1 ELSE 0 END) / 2.0::DOUBLE AS ratio FROM articles WHERE content IS NOT NULL")
def _(t):
    c = F.lower("content")
    return t("articles").where("content is not null").select("id", ((c.contains("kỷ lục").cast("int") + c.contains("lãi suất").cast("int")) / F.lit(2.0)).alias("ratio"))


@query("h11_preview", "SELECT id, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS preview FROM articles")
def _(t):
    return t("articles").select("id", T.preview(F.col("content")).alias("preview"))


@query("c1_boilerplate")
def _(t):
    from corvana.operators.boilerplate import stripped

    return t("articles").select("id", stripped(F.col("content"), F.col("source")).alias("story"))


@query("c1f_credit_lines", r"SELECT id, line FROM (SELECT id, unnest(string_split(content, chr(10))) AS line FROM articles WHERE content IS NOT NULL) WHERE regexp_matches(line, '(?i)^\s*(?:" + __import__("corvana.operators.boilerplate", fromlist=["LABELS"]).LABELS + r")\s*[:：\-–]\s*\S')")
def _(t):
    from corvana.operators.boilerplate import is_credit_column

    lines = t("articles").where("content is not null").select("id", F.explode(F.split("content", "\n")).alias("line"))
    return lines.where(is_credit_column(F.col("line")))


# ---- duplicates

_GRAMS = """WITH d AS (SELECT DISTINCT id, CASE WHEN content IS NOT NULL AND content <> '' THEN content ELSE title END AS x FROM articles),
    w AS (SELECT id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(x), '[^\\p{L}\\p{N}\\p{M}_\\s\\x{85}\\p{Z}]', '', 'g'), '[\\s\\x{85}\\p{Z}]+', ' ', 'g')), ' '), lambda z: z <> '') AS w FROM d WHERE x IS NOT NULL),
    s AS (SELECT id, list_distinct(CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS grams FROM w WHERE len(w) > 0)"""


def _texts(t):
    a = t("articles").select("id", U.shingle_text(F.col("content"), F.col("title")).alias("x")).distinct()
    return a.where("x is not null")


@query("dd1_shingles", _GRAMS + " SELECT id, len(grams) AS n FROM s")
def _(t):
    return U.shingles(_texts(t), "id", F.col("x")).select("id", F.col("size").cast("long").alias("n"))


_PAIRS = _GRAMS + """, e AS (SELECT id, len(grams) AS n, unnest(grams) AS g FROM s), f AS (SELECT g, count(*) AS df FROM e GROUP BY g),
    o AS (SELECT e.id, n, e.g, row_number() OVER (PARTITION BY e.id ORDER BY df, e.g) AS k FROM e JOIN f USING (g)), p AS (SELECT * FROM o WHERE k <= n - ceil(n * 0.85 - 1e-9) + 1),
    c AS (SELECT DISTINCT x.id AS a, y.id AS b FROM p x JOIN p y ON x.g = y.g AND x.id < y.id), v AS (SELECT a, b, len(list_intersect(x.grams, y.grams)) AS i, len(x.grams) + len(y.grams) AS u FROM c JOIN s x ON x.id = a JOIN s y ON y.id = b)"""


def _classes(t):
    return U.text_classes(t("articles"), "id", U.shingle_text(F.col("content"), F.col("title")), 0.85)


@query("dd3_jaccard_pairs", _PAIRS + " SELECT a, b FROM v WHERE i / (u - i) >= 0.85")
def _(t):
    return U.class_pairs(*_classes(t)).select("a", "b")


@query("dd4_keep_first_pairwise", _PAIRS + " SELECT DISTINCT b AS id FROM v WHERE i / (u - i) >= 0.85")
def _(t):
    return U.dropped_pairwise_classes(*_classes(t))


@query("dd4_keep_first_greedy")
def _(t):
    return U.dropped_greedy_classes(*_classes(t))


# ---- extraction

def _found(kind: str, sql_pattern: str, how: str = "{}"):
    name = f"n1_{kind.lower()}"
    SQL[name] = f"SELECT DISTINCT id, {how.format('v')} AS value FROM (SELECT id, unnest(regexp_extract_all(content, {lit(sql_pattern)})) AS v FROM articles WHERE content IS NOT NULL)"
    QUERIES[name] = lambda spark, d: table(spark, d, "articles").where("content is not null").select("id", F.explode(N.values_of(F.col("content"), kind)).alias("value")).distinct()


_found("EMAIL", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b")
for _kind in ("MONEY", "DATE", "TIME", "PERCENT", "PHONE", "URL", "AGE", "TEMPERATURE", "QUANTITY", "DURATION", "SCORE", "LAW", "ADDRESS", "IDENTIFIER", "STOCK_TICKER", "INDEX", "ORDINAL", "CARDINAL", "HASHTAG", "USERNAME", "TOPIC", "LOC", "ORG", "FACILITY", "PRODUCT", "EVENT"):
    QUERIES[f"n1_{_kind.lower()}"] = lambda spark, d, k=_kind: table(spark, d, "articles").where("content is not null").select("id", F.explode(N.values_of(F.col("content"), k)).alias("value")).distinct()


@query("n0_extract_all")
def _(t):
    x = N.extract_all(t("articles").where("content is not null").select("id", B.extraction_text(F.col("title"), F.col("content"), F.col("source")).alias("text")), "id", "text")
    return x.select("id", F.size("entities").alias("entities"), F.size("relations").alias("relations"), F.size("attributes").alias("attributes"), F.to_json("relations").alias("found"))


@query("n4_lexicon_hits")
def _(t):
    names = t("graph_entities").select(T.match_form("name").alias("phrase"), "type").distinct()
    return N.phrase_hits(t("articles").select("id", T.nfc("content").alias("content")).distinct(), "id", "content", names).distinct()


_INTENT = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(nfc_normalize(title)), '(^|[^\\p{{L}}\\p{{N}}_])(?:{p})($|[^\\p{{L}}\\p{{N}}_])') THEN '{n}' END" for n, p in K.INTENTS) + "], lambda x: x IS NOT NULL), ',')"


@query("n11_intents", f"SELECT id, {_INTENT} AS intents FROM articles WHERE title IS NOT NULL")
def _(t):
    return t("articles").where("title is not null").select("id", F.array_join(N.intents(T.nfc("title")), ",").alias("intents"))


@query("n12_residual_keywords")
def _(t):
    stop = F.array(*[F.lit(w) for w in sorted(K.QUERY_STOPWORDS)])
    w = F.array_distinct(F.split(T.match_form(T.nfc("title")), " "))
    kept = F.filter(w, lambda x: (F.char_length(x) > 1) & ~F.array_contains(stop, x) & ~x.rlike(r"^\d+$"))
    return t("articles").where("title is not null").select("id", F.array_join(kept, " ").alias("words"))


SQL["n12_residual_keywords"] = (
    r"WITH f AS (SELECT DISTINCT id, trim(regexp_replace(regexp_replace(lower(nfc_normalize(title)), '" + _W + r"', ' ', 'g'), '\s+', ' ', 'g')) AS f FROM articles WHERE title IS NOT NULL), "
    r"u AS (SELECT id, unnest(string_split(f, ' ')) AS w, generate_subscripts(string_split(f, ' '), 1) AS i FROM f), g AS (SELECT id, w, min(i) AS i FROM u GROUP BY id, w), "
    r"k AS (SELECT id, string_agg(w, ' ' ORDER BY i) AS words FROM g WHERE length(w) > 1 AND w NOT IN (" + ", ".join(lit(w) for w in sorted(K.QUERY_STOPWORDS)) + r") AND NOT regexp_full_match(w, '\d+') GROUP BY id) "
    "SELECT a.id, coalesce(k.words, '') AS words FROM articles a LEFT JOIN k USING (id) WHERE a.title IS NOT NULL"
)


@query("n16_analyze_titles")
def _(t):
    from corvana.functions.arrow import map_batches

    def run(rules, cols):
        got = [N.analyze(x or "", rules) for x in cols["title"]]
        return {"id": cols["id"], "terms": [" | ".join(g["search_terms"]) for g in got], "top_weight": [max(g["term_weights"].values(), default=0.0) for g in got], "unclear": [g["requires_clarification"] for g in got]}

    return map_batches(t("articles").select("id", T.nfc("title").alias("title")).distinct(), run, "id long, terms string, top_weight double, unclear boolean", N.Rules)


# ---- graph build and sinks

@query("g2_unique_entities", "SELECT DISTINCT g.article_id, lower(trim(e.name)) AS name, e.type FROM article_graph g JOIN graph_entities e ON g.entity_id = e.id WHERE length(lower(trim(e.name))) > 2 ")
def _(t):
    e = t("graph_entities").select(F.col("id").alias("entity_id"), F.col("name").alias("value"), "type")
    return G.unique_entities(t("article_graph").join(e, "entity_id"), ["PERSON", "ORG", "LOC", "SPORT_TEAM", "FACILITY", "PRODUCT", "EVENT", "Cá nhân", "Tổ chức", "Địa điểm", "Đội thể thao", "Cơ sở vật chất", "Sản phẩm", "Sự kiện"])


@query("sk2_insert_links", "SELECT DISTINCT article_id, entity_id FROM article_graph g WHERE NOT EXISTS (SELECT 1 FROM article_graph_index i WHERE i.article_id = g.article_id)")
def _(t):
    g = t("article_graph")
    old = g.join(t("article_graph_index").select("article_id"), "article_id", "left_semi")
    return g.select("article_id", "entity_id").dropDuplicates().join(old.select("article_id", "entity_id"), ["article_id", "entity_id"], "left_anti")


@query("sk3_surrogate_keys", "SELECT (SELECT coalesce(max(id), 0) FROM graph_entities) + row_number() OVER (ORDER BY source, category) AS id, source, category FROM (SELECT DISTINCT source, category FROM articles WHERE source IS NOT NULL AND category IS NOT NULL)")
def _(t):
    new = t("articles").where("source is not null and category is not null").select("source", "category").distinct()
    return G.numbered(new, t("graph_entities"), ["source", "category"])


@query("sk4_last_value", "SELECT entity_id, attribute_key, arg_max(attribute_value, id) AS attribute_value FROM entity_attributes WHERE attribute_key IS NOT NULL AND attribute_value IS NOT NULL GROUP BY entity_id, attribute_key")
def _(t):
    return G.keyed_value(t("entity_attributes").where("attribute_key is not null and attribute_value is not null"), ["entity_id", "attribute_key"], "attribute_value", F.col("id"))


_UP = "WITH u AS (SELECT *, substr(link, 1, 500) AS k FROM (SELECT id, title, link, summary, content, published_date, source, category, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY collected_at, created_at) = 1 THEN id ELSE 1000000000000 + id END AS o FROM articles) WHERE link IS NOT NULL)"


@query(
    "sk1_upsert",
    _UP + f""" SELECT min(id) AS id, arg_min(link, o) AS link, arg_max(coalesce(summary, chr(0)), o) AS summary, arg_max(coalesce(content, chr(0)), o) AS content, arg_min(coalesce(source, chr(0)), o) AS source,
    coalesce(arg_min(category, o) FILTER (WHERE category IS NOT NULL AND category <> '' AND category <> {lit(K.DEFAULT_CATEGORY)}), CASE WHEN arg_max(coalesce(category, chr(0)), o) = chr(0) THEN NULL ELSE arg_max(coalesce(category, chr(0)), o) END) AS category FROM u GROUP BY k""",
)
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("collected_at", "created_at")
    a = t("articles").where("link is not null").select("id", "title", "link", "summary", "content", "published_date", "source", "category", F.row_number().over(w).alias("n"))
    u = G.upsert_articles(a.where("n = 1").drop("n"), a.where("n > 1").withColumn("seq", F.col("id")).drop("n"))  # repeated deliveries meet the first ones
    z = lambda c: F.coalesce(c, F.lit("\0")).alias(c)
    return u.select("id", "link", z("summary"), z("content"), z("source"), "category")


_GONE = "(SELECT id FROM articles WHERE source = 'Lá Tre' AND link NOT LIKE 'upload://%')"


@query("sk6_cascade_delete", f"SELECT 'links' AS what, count(*) AS n FROM article_graph WHERE article_id NOT IN {_GONE} UNION ALL SELECT 'relations', count(*) FROM entity_relations WHERE article_id NOT IN {_GONE} UNION ALL SELECT 'articles', count(*) FROM articles WHERE id NOT IN {_GONE}")
def _(t):
    ids = t("articles").where("source = 'Lá Tre'").select("id")
    left = G.delete_articles(t("articles"), {"links": t("article_graph"), "relations": t("entity_relations")}, ids)
    n = [df.agg(F.lit(k).alias("what"), F.count(F.lit(1)).alias("n")) for k, df in left.items()]
    return n[0].unionByName(n[1]).unionByName(n[2])


@query("sk7_clear_changed", f"SELECT count(*) AS n FROM entity_attributes WHERE article_id NOT IN (SELECT i.article_id FROM article_graph_index i JOIN articles a ON a.id = i.article_id WHERE i.content_hash IS DISTINCT FROM {_HASH})")
def _(t):
    i = t("article_graph_index").join(t("articles").select(F.col("id").alias("article_id"), T.content_hash(F.col("title"), F.col("content")).alias("h")), "article_id")
    return G.clear({"a": t("entity_attributes")}, i.where(~F.col("content_hash").eqNullSafe(F.col("h"))))["a"].agg(F.count(F.lit(1)).alias("n"))


@query("g3_build_graph")
def _(t):
    a = t("articles").where("content is not null").select("id", B.extraction_text(F.col("title"), F.col("content"), F.col("source")).alias("text")).dropDuplicates(["id"])
    from corvana.session import stored

    x = stored(N.extract_all(a, "id", "text"), "extracted").withColumnRenamed("id", "article_id")
    found = x.select("article_id", F.inline("entities"))
    out = G.build(found, x.select("article_id", F.inline("relations")), x.select("article_id", F.inline("attributes")), t("graph_entities"), K.GRAPH_TYPES)
    n = [df.agg(F.lit(k).alias("what"), F.count(F.lit(1)).alias("n")) for k, df in out.items()]
    return n[0].unionByName(n[1]).unionByName(n[2]).unionByName(n[3])


# ---- retrieval

def _score_sql(terms, weights):
    return " + ".join(f"(CASE WHEN lower(title) LIKE '%{x}%' THEN {2 * weights.get(x, 1.0)}::DOUBLE ELSE 0::DOUBLE END + CASE WHEN lower(content) LIKE '%{x}%' THEN {weights.get(x, 1.0)}::DOUBLE ELSE 0::DOUBLE END)" for x in terms)


_ONE = "(SELECT DISTINCT id, title, content, source, link, published_date FROM articles)"
_KW = f"(SELECT id, title, published_date, 0::DOUBLE AS graph_score, ks AS keyword_score, ks * 0.75::DOUBLE AS score FROM (SELECT *, {_score_sql(TERMS, WEIGHTS)} AS ks FROM {_ONE} WHERE {_ANY} ORDER BY ks DESC, published_date DESC NULLS LAST, id LIMIT 40) WHERE ks > 0)"
_NW = "CASE lower(e.name) " + " ".join(f"WHEN {lit(n)} THEN {NAME_WEIGHTS.get(n, 1.0)}::DOUBLE" for n in NAMES) + " END"
_GR = f"""(SELECT id, title, published_date, gs AS graph_score, 0::DOUBLE AS keyword_score, gs AS score FROM (SELECT a.id, a.title, a.published_date, count(DISTINCT g.entity_id) AS mc, (SELECT sum(w) FROM (SELECT DISTINCT lower(e.name), {_NW} AS w FROM article_graph g2 JOIN graph_entities e ON g2.entity_id = e.id
    WHERE g2.article_id = a.id AND lower(e.name) IN ({', '.join(map(lit, NAMES))}))) AS gs FROM {_ONE} a JOIN article_graph g ON a.id = g.article_id JOIN graph_entities e ON g.entity_id = e.id WHERE lower(e.name) IN ({', '.join(map(lit, NAMES))})
    GROUP BY a.id, a.title, a.published_date ORDER BY mc DESC, a.published_date DESC NULLS LAST, a.id LIMIT 40))"""
_OUT = ["id", "title", "published_date", "graph_score", "keyword_score", "score"]


def _one(t):
    return t("articles").dropDuplicates(["id"])


def _keyword(t):
    return S.keyword_search(_one(t), TERMS, WEIGHTS, 40)


def _graph(t):
    return S.graph_search(_one(t), t("article_graph"), t("graph_entities"), NAMES, NAME_WEIGHTS, 40)


@query("r2_keyword_topk", f"SELECT * FROM {_KW}")
def _(t):
    return _keyword(t).select(_OUT)


@query("r1_graph_topk", f"SELECT * FROM {_GR}")
def _(t):
    return _graph(t).select(_OUT)


@query("r6_merge", f"""SELECT id, any_value(title) AS title, any_value(published_date) AS published_date, max(graph_score) AS graph_score, max(keyword_score) AS keyword_score,
    CASE WHEN count(*) > 1 THEN max(graph_score) + max(keyword_score) * 0.75::DOUBLE ELSE max(score) END AS score FROM (SELECT * FROM {_GR} UNION ALL SELECT * FROM {_KW}) GROUP BY id""")
def _(t):
    return S.merge(_graph(t), _keyword(t)).select(_OUT)


@query("r7_hybrid")
def _(t):
    a = N.analyze("Đội tuyển Nam Thành phá kỷ lục ở Vịnh Sa", N.Rules({"LOC": NAMES, "TOPIC": TERMS}))
    return S.hybrid(_one(t), t("article_graph"), t("graph_entities"), a, 10).select(_OUT)


_DV = " OR ".join(f"lower(title) LIKE '%{v}%' OR lower(content) LIKE '%{v}%'" for v in D.variants(DAY))


@query("r4_date_mentions", f"SELECT id, title, published_date, 50::DOUBLE + least(length(content) / 1000.0::DOUBLE, 5::DOUBLE) AS score FROM {_ONE} WHERE ({_DV}) AND (lower(title) LIKE '%kỷ lục%' OR lower(content) LIKE '%kỷ lục%') ORDER BY length(content) DESC NULLS LAST, published_date DESC NULLS LAST, id LIMIT 30")
def _(t):
    return S.date_mentions(_one(t), DAY, ["kỷ lục"], limit=30).select("id", "title", "published_date", "score")


@query(
    "r10_fixed_windows",
    r"""WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '[\s\x{85}\p{Z}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, w, unnest(range(0, len(w), 100)) AS a FROM w WHERE len(w) > 0)
    SELECT doc_id, CAST(a // 100 AS INTEGER) AS chunk_no, sha256(array_to_string(w[a + 1 : a + 120], ' ')) AS h FROM p""",
)
def _(t):
    return C.windows(t("documents").select("doc_id", "text"), "text").select("doc_id", "chunk_no", F.sha2("chunk", 256).alias("h"))


@query("r10_micro_chunks")
def _(t):
    return t("documents").select("doc_id", F.posexplode(C.micro_chunks(F.col("text"))).alias("chunk_no", "chunk"))


@query("r11_best_chunks")
def _(t):
    d = t("documents").select("doc_id", F.posexplode(C.micro_chunks(F.col("text"))).alias("chunk_no", "chunk"))
    return C.best(d, "doc_id", ["hội chợ", "con sông"], ["chợ", "phụ", "huynh"]).select("doc_id", "chunk_no", "chunk_score", "rank")


@query("r12_context")
def _(t):
    return C.context(_keyword(t), TERMS, [w for x in TERMS for w in x.split()], TERMS)


# ---- sources

@query("sc5_feed_head", f"SELECT id, source FROM (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY id, collected_at) AS k FROM articles WHERE source IS NOT NULL AND {NOT_UPLOADED}) WHERE k <= 15")
def _(t):
    from corvana.sources.feeds import head

    a = t("articles").where("source is not null").where(V.not_uploaded()).select("id", "source", F.struct("id", "collected_at").alias("pos"))
    return head(a, ["source"], 15).select("id", "source")


@query("sc7_page_dispatch", "SELECT id, CASE WHEN link LIKE '%vnexpress.net%' THEN 'a' WHEN link LIKE '%dantri.com.vn%' THEN 'b' ELSE 'density' END AS strategy FROM articles")
def _(t):
    from corvana.sources.pages import strategy

    return t("articles").select("id", strategy(F.col("link")).alias("strategy"))


@query("sc12_scan", "SELECT id, title, source FROM articles")
def _(t):
    return t("articles").select("id", "title", "source")


@query("st_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return t("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
