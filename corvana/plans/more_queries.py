"""Further queries over the test tables, with SQL written apart from the operators' own patterns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from corvana.functions import constants as K
from corvana.functions import dates as D
from corvana.functions import text as T
from corvana.operators import boilerplate as B
from corvana.operators import chunks as C
from corvana.operators import graph as G
from corvana.operators import ner as N
from corvana.operators import search as S
from corvana.operators import views as V
from corvana.plans.queries import NAMES, NAME_WEIGHTS, NOT_UPLOADED, QUERIES, SQL, TERMS, WEIGHTS, _one, lit, query

# ---- values by pattern: a line of every kind is added to each text, so that every type is found

_LINE = " | Xem https://bao.example/tin-{0} và #tin{0} của @ban_doc.{0}, 35 tuổi, trời 36,5 độ C, tỉ số 2 - 1, mã cổ phiếu ABC, VN-Index, mst: 0101{0}999, bay VN {1}, nghị định số 15/2020/NĐ-CP. Dòng Galaxy S24 Ultra dùng machine learning được giới thiệu ở World Cup 2026."
_TAIL = _LINE.split("{1}")[1]
_ID, _NO = "cast(id as string)", "cast(100 + id % 800 as string)"
_N, _AFTER = r"\d+(?:[.,]\d+)?", r"(?:$|[^\p{L}\p{M}\p{N}_])"
_SCALES = "nghìn|ngàn|triệu|tỷ|nghìn tỷ"
_D, _M, _H, _MIN = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[012])", r"(?:[01]?\d|2[0-3])", r"[0-5]\d"
#: type: pattern with the value as its group, how the value is written.
_BY_TYPE = {
    "MONEY": (rf"(?i)\b({_N}\s*(?:(?:{_SCALES})\s*)?(?:đồng|vnđ|vnd|usd|đô la|đô la mỹ|euro|eur|bảng anh|gbp|nhân dân tệ|cny|yên|jpy|won|krw|baht|thb)|{_N}\s*(?:{_SCALES})){_AFTER}", "lower(v)"),
    "PERCENT": (rf"(?i)\b({_N}\s*(?:%|phần trăm))(?:\s|$|[.,;:!?])", "lower(v)"),
    "PHONE": (r"(?:^|[^\d])((?:\+84|0)\s*(?:\d[\s.-]?){8,10}\d)(?:$|[^\d])", "v"),
    "URL": (r"(?i)\b((?:https?://|www\.)[^\s<>()]+)\b", "v"),
    "AGE": (rf"(?i)\b(\d{{1,3}}\s*(?:tuổi|năm tuổi)){_AFTER}", "lower(v)"),
    "TEMPERATURE": (rf"(?i)\b(-?{_N}\s*(?:°c|độ c)){_AFTER}", "lower(v)"),
    "QUANTITY": (rf"(?i)\b({_N}\s*(?:kg|g|tấn|tạ|yến|km|m|cm|mm|ha|m2|m²|km2|km²|lít|ml|giờ|phút|ngày|tháng|năm|người|chiếc|căn|hộ|vé|đơn|ca|bộ|sản phẩm)){_AFTER}", "lower(v)"),
    "DURATION": (rf"(?i)\b({_N}\s*(?:giây|phút|giờ|ngày|tuần|tháng|năm)){_AFTER}", "lower(v)"),
    "SCORE": (r"(?:^|[^:\d\w])(\d{1,2}\s*-\s*\d{1,2})(?:$|[^:\d\w])", r"regexp_replace(lower(v), '\s+', '', 'g')"),
    "STOCK_TICKER": (rf"\b(?:mã cổ phiếu|cổ phiếu|mã chứng khoán)\s+([A-Z]{{2,5}}){_AFTER}", "lower(v)"),
    "INDEX": (rf"(?i)\b(vn-index|vn30|hastc-index|hnx-index|upcom-index|dow jones|s&p 500|nasdaq|nikkei 225){_AFTER}", "lower(v)"),
    "ORDINAL": (rf"(?i)\b(thứ\s+(?:nhất|hai|ba|tư|bốn|năm|sáu|bảy|tám|chín|mười)|hạng\s+\d+|top\s+\d+|lần\s+thứ\s+\d+){_AFTER}", "lower(v)"),
    "HASHTAG": (r"(?:^|[^\w])(#\w+)", "lower(v)"),
    "USERNAME": (r"(?:^|[^\w])(@[\w.]{2,})", "lower(v)"),
    "DATE": (
        rf"(?i)(\b(?:ngày\s+)?{_D}/{_M}(?:/\d{{2,4}})?|\b{_D}-{_M}-\d{{2,4}}|\b\d{{4}}-{_M}-{_D}|\b(?:ngày\s+)?{_D}\s+tháng\s+{_M}(?:\s+năm\s+\d{{4}})?|\b(?:tháng\s+)?{_M}\s+năm\s+\d{{4}}|\bnăm\s+\d{{4}}|\bquý\s+[ivx1-4]+\s*(?:năm\s+)?\d{{4}}"
        rf"|\b(?:thứ\s+hai|thứ\s+ba|thứ\s+tư|thứ\s+năm|thứ\s+sáu|thứ\s+bảy|chủ nhật)|\b(?:hôm nay|hôm qua|ngày mai|sáng nay|chiều nay|tối nay|tuần này|tuần trước|tuần sau|tháng này|tháng trước|tháng sau|năm nay|năm ngoái|cuối năm)|đầu năm){_AFTER}",
        "lower(v)",
    ),
}


def _line(c: str):
    return F.concat(F.col(c), *[F.expr(x) for x in (lit(_LINE.split("{0}")[0]), _ID, lit(_LINE.split("{0}")[1]), _ID, lit(_LINE.split("{0}")[2]), _ID, lit(_LINE.split("{0}")[3]), _ID, lit(_LINE.split("{0}")[4].split("{1}")[0]), _NO, lit(_TAIL))])


_p = _LINE.split("{0}")
_LINE_SQL = " || ".join(["content", lit(_p[0]), _ID, lit(_p[1]), _ID, lit(_p[2]), _ID, lit(_p[3]), _ID, lit(_p[4].split("{1}")[0]), _NO, lit(_TAIL)])


def _typed(kind: str, pattern: str, how: str) -> None:
    name = f"n1_{kind.lower()}"
    SQL[name] = f"SELECT DISTINCT id, {how} AS value FROM (SELECT id, unnest(regexp_extract_all({_LINE_SQL}, {lit(pattern)}, 1)) AS v FROM articles WHERE content IS NOT NULL)"
    query(name, SQL[name])(lambda t, k=kind: t("articles").where("content is not null").select("id", F.explode(N.values_of(_line("content"), k)).alias("value")).distinct())


for _kind, (_pattern, _how) in _BY_TYPE.items():
    _typed(_kind, _pattern, _how)


_EDGE = r"(?:^|[^\p{L}\p{M}\p{N}_])"
_CAP = r"[A-ZÀÁẢÃẠĂẰẮẲẴẶÂẦẤẨẪẬĐÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌÔỒỐỔỖỘƠỜỚỞỠỢÙÚỦŨỤƯỪỨỬỮỰỲÝỶỸỴ][a-zàáảãạăằắẳẵặâầấẩẫậđèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ]+"
_ACTS = "luật|bộ luật|nghị định|thông tư|nghị quyết|chỉ thị|quyết định"
_MATCHED = r"trim(regexp_replace(regexp_replace(lower(v), '[^\p{L}\p{N}\p{M}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_SHOWN = lambda kind: lambda t: t("articles").where("content is not null").select("id", F.explode(N.values_of(_line("content"), kind)).alias("value")).distinct()
# white space is doubled, so that two values may share the sign between them
_DOUBLED = rf"regexp_replace({_LINE_SQL}, '(\s)', '\1\1', 'g')"
_TIMES = rf"(?i){_EDGE}({_H}[:h]{_MIN}\s*[-–]\s*{_H}[:h]{_MIN}|từ\s+{_H}[:h]{_MIN}\s+đến\s+{_H}[:h]{_MIN}|{_H}[:h]{_MIN}|{_H}\s*giờ(?:\s*{_MIN}\s*phút)?|sáng|trưa|chiều|tối|đêm|rạng\s+sáng){_AFTER}"
query("n1_time", f"SELECT DISTINCT id, replace(lower(v), '  ', ' ') AS value FROM (SELECT id, unnest(regexp_extract_all({_DOUBLED}, {lit(_TIMES)}, 1)) AS v FROM articles WHERE content IS NOT NULL)")(_SHOWN("TIME"))
_SPACED = f"replace({_LINE_SQL}, chr(160), ' ')"  # white space of every kind divides words
query(
    "n1_law",
    f"""SELECT DISTINCT id, lower(v) AS value FROM (SELECT id, unnest(regexp_extract_all({_SPACED}, {lit(rf"(?i){_EDGE}((?:{_ACTS})" + r"\s+(?:số\s+)?\d{1,4}/\d{2,4}/[A-ZĐ0-9-]+)")}, 1)) AS v FROM articles WHERE content IS NOT NULL)
    UNION SELECT DISTINCT id, {_MATCHED} AS value FROM (SELECT id, unnest(regexp_extract_all({_SPACED}, {lit(rf"{_EDGE}((?i:{_ACTS})" + rf"\s+{_CAP}(?:\s+(?:{_CAP}|và|của|về))" + "{0,8}" + rf"){_AFTER}")}, 1)) AS v FROM articles WHERE content IS NOT NULL)""",
)(_SHOWN("LAW"))
query("n1_cardinal", f"SELECT DISTINCT id, lower(v) AS value FROM (SELECT id, unnest(regexp_extract_all({_DOUBLED}, {lit(r'(?:^|[^\p{L}\p{M}\p{N}_./:-])(\d{1,3}(?:[.,]\d{3})*(?:,\d+)?)(?:$|[^\p{L}\p{M}\p{N}_./:,%-])')}, 1)) AS v FROM articles WHERE content IS NOT NULL)")(_SHOWN("CARDINAL"))
_PLACES = rf"{_EDGE}((?:tỉnh|thành phố|tp|quận|huyện|thị xã|xã|phường|đảo|vịnh|sông|núi|hồ)\s+(?:{_CAP}|\d+)(?:\s+(?:{_CAP}|\d+))" + "{0,3}" + rf"){_AFTER}"
query("n1_loc", f"SELECT DISTINCT id, {_MATCHED} AS value FROM (SELECT id, unnest(regexp_extract_all({_SPACED}, {lit(_PLACES)}, 1)) AS v FROM articles WHERE content IS NOT NULL)")(_SHOWN("LOC"))
_CAPITALS = r"(?:[" + _CAP.split("]")[0][1:] + r"][" + _CAP.split("[")[2].split("]")[0] + r"0-9]+|[A-ZĐ]{2,})"
_BODIES = r"công ty(?:\s+cổ phần|\s+tnhh)?|tập đoàn|ngân hàng(?:\s+tmcp)?|bộ|sở|cục|tổng cục|ủy ban|hội đồng|viện|trường(?:\s+đại học)?|đại học|học viện|bệnh viện|quỹ"
_HOUSES = "sân bay|cảng|ga|nhà ga|bến xe|cầu|hầm|sân vận động|nhà hát|trung tâm hội nghị|trung tâm triển lãm|khu công nghệ cao|khu kinh tế|vườn quốc gia|bệnh viện|trường đại học|học viện"
for _kind, _led in (("ORG", _BODIES), ("FACILITY", _HOUSES)):
    _pattern = rf"{_EDGE}((?i:{_led})\s+{_CAPITALS}(?:\s+(?:{_CAPITALS}|và|of|the))" + "{0,8}" + rf"){_AFTER}"
    query(f"n1_{_kind.lower()}", f"SELECT DISTINCT id, {_MATCHED} AS value FROM (SELECT id, unnest(regexp_extract_all({_SPACED}, {lit(_pattern)}, 1)) AS v FROM articles WHERE content IS NOT NULL)")(_SHOWN(_kind))
_WORD = "[" + _CAP.split("]")[0][1:] + "][" + _CAP.split("[")[2].split("]")[0] + "0-9]+"
_NAMED = r"[A-Z0-9][A-Za-z0-9.+-]*|Pro|Max|Mini|Plus|Air|Ultra|Fold|Flip|Series|SE|OLED"
_MODELS = "iPhone|iPad|MacBook|Galaxy|Pixel|Surface|ThinkPad|Vision Pro|PlayStation|Xbox|GPT|Gemini|Claude|Llama|DeepSeek|Qwen|Mistral|Grok|VF"
for _kind, _pattern in (
    ("ADDRESS", rf"{_EDGE}((?:số\s+)?\d+[A-Za-z]?(?:/\d+[A-Za-z]?)*\s+(?:đường|phố|ngõ|hẻm)\s+{_WORD}(?:\s+{_WORD})" + "{0,4}" + f"){_AFTER}"),
    ("PRODUCT", rf"{_EDGE}((?:{_MODELS})(?:\s+(?:{_NAMED}))" + "{1,4}" + f"){_AFTER}"),
    ("EVENT", rf"{_EDGE}((?i:world cup|euro|olympic|sea games|cop|hội nghị|diễn đàn|đại hội|giải vô địch|liên hoan phim)\s+(?:{_WORD}|\d+)(?:\s+(?:{_WORD}|\d+|và|of|the))" + "{0,6}" + f"){_AFTER}"),
    ("TOPIC", f"(?i){_EDGE}(artificial intelligence|machine learning|deep learning|large language models?|llm|mô hình ngôn ngữ lớn){_AFTER}"),
):
    query(f"n1_{_kind.lower()}", f"SELECT DISTINCT id, {_MATCHED} AS value FROM (SELECT id, unnest(regexp_extract_all({_SPACED}, {lit(_pattern)}, 1)) AS v FROM articles WHERE content IS NOT NULL)")(_SHOWN(_kind))
_CODES = (
    (rf"(?i){_EDGE}((?:cccd|cmnd|mã số thuế|mst|mã hồ sơ|số hộ chiếu|biển số|mã chuyến bay)\s*[:#]?\s*[A-Z0-9][A-Z0-9./-]" + "{3,})" + _AFTER, "lower(v)"),
    (r"\b(\d{2}[A-Z]{1,2}-\d{3}(?:\.\d{2})?)\b", "lower(v)"),
    (r"(?i)\b((?:VN|VJ|QH|BL|BAV|HVN)\s?\d{2,4})\b", r"regexp_replace(lower(v), '\s+', '', 'g')"),
)
query("n1_identifier", " UNION ".join(f"SELECT DISTINCT id, {how} AS value FROM (SELECT id, unnest(regexp_extract_all({_LINE_SQL}, {lit(p)}, 1)) AS v FROM articles WHERE content IS NOT NULL)" for p, how in _CODES))(_SHOWN("IDENTIFIER"))


# ---- text, dates, feeds

_SPACES = r"[\s\x{85}\p{Z}]"
_CLEAN = rf"""regexp_replace(regexp_replace(nfc_normalize(content), '(?i)https?://\S+|www\.\S+', '', 'g'), '<[^>]*>', '', 'g')"""
_PLAIN = rf"""lower(trim(regexp_replace(regexp_replace(regexp_replace({_CLEAN}, '[^\p{{L}}\p{{N}}\p{{M}}_\s\x{{85}}\p{{Z}},.:;!?()\-+=''"/\\]', '', 'g'), '[^a-zA-Z0-9\s_đĐ{K.VIETNAMESE}]', ' ', 'g'), '\s+', ' ', 'g')))"""


@query("t10_cleaned", f"SELECT id, nullif(array_to_string(list_filter(string_split({_PLAIN}, ' '), lambda w: w <> '' AND w NOT IN ({', '.join(map(lit, sorted(K.STOPWORDS)))})), ' '), '') AS cleaned FROM articles WHERE content IS NOT NULL")
def _(t):
    return t("articles").where("content is not null").select("id", T.cleaned(T.nfc("content")).alias("cleaned"))


@query("t8_query_cleaned")
def _(t):
    return t("articles").select("id", T.query_cleaned(T.nfc("title")).alias("words"))


_FEED = "'<p>' || title || '</p>\n<br/>A &amp;lt; B &lt;b&gt; &quot;x&quot; &#39;y&apos;&nbsp;z'"
_SQ = lit("'")


@query("sc2_feed_text", f"SELECT id, trim(replace(replace(replace(replace(replace(replace(replace(regexp_replace({_FEED}, '<.*?>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', {_SQ}), '&apos;', {_SQ}), '&nbsp;', chr(160)), '&amp;', '&')) AS x FROM articles WHERE title IS NOT NULL")
def _(t):
    html = F.concat(F.lit("<p>"), F.col("title"), F.lit("</p>\n<br/>A &amp;lt; B &lt;b&gt; &quot;x&quot; &#39;y&apos;&nbsp;z"))
    return t("articles").where("title is not null").select("id", T.feed_text(html).alias("x"))


@query("sc3_feed_dates", "SELECT id, strftime(collected_at, '%Y-%m-%d %H:%M:%S') AS published FROM articles WHERE collected_at IS NOT NULL UNION ALL SELECT id, nullif(trim(published_date), '') AS published FROM articles WHERE published_date IS NULL OR trim(published_date) = ''")
def _(t):
    a = t("articles")
    rfc = a.where("collected_at is not null").select("id", F.concat(F.date_format("collected_at", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0700")).alias("d"))
    blank = a.where("published_date is null or trim(published_date) = ''").select("id", F.col("published_date").alias("d"))
    return rfc.unionByName(blank).select("id", D.feed_date(F.col("d")).alias("published"))


_DAYS = {"hôm nay": ("2025-09-26", "2025-09-26"), "hôm qua": ("2025-09-25", "2025-09-25"), "ngày mai": ("2025-09-27", "2025-09-27"), "3 ngày qua": ("2025-09-23", "2025-09-26"), "tuần này": ("2025-09-22", "2025-09-26"), "tin mới nhất": ("2025-09-23", "2025-09-26")}
_ASK = f"CASE id % 6 {' '.join(f'WHEN {i} THEN {lit(q)}' for i, q in enumerate(_DAYS))} END"


@query("h2_question_range", f"SELECT id, CAST(CASE id % 6 {' '.join(f'WHEN {i} THEN {lit(a)}' for i, (a, _b) in enumerate(_DAYS.values()))} END AS DATE) AS from_date, CAST(CASE id % 6 {' '.join(f'WHEN {i} THEN {lit(b)}' for i, (_a, b) in enumerate(_DAYS.values()))} END AS DATE) AS to_date FROM articles")
def _(t):
    low, high = D.question_range(F.concat(F.lit("Có gì "), F.expr(_ASK), F.lit("?")), dt.date(2025, 9, 26))
    return t("articles").select("id", low.alias("from_date"), high.alias("to_date"))


@query("h6_anchored_answers", "SELECT id, 'Giá ngày 26/9/2025 tăng, ' || title || ' ngày 26/9/2025' AS answer FROM articles WHERE title IS NOT NULL AND NOT regexp_matches(lower(title), 'hôm nay')")
def _(t):
    a = t("articles").where("title is not null").where(~F.lower("title").contains("hôm nay"))
    return a.select("id", D.anchored(F.concat(F.lit("Giá hôm nay tăng, "), F.col("title"), F.lit(" Hôm nay")), D.day_label(dt.date(2025, 9, 26))).alias("answer"))


_SAID = "CASE WHEN id % 3 = 0 THEN coalesce(title, '') || ': Không tìm thấy thông tin về việc này.' WHEN id % 3 = 1 THEN coalesce(title, '') || ' I could not find it' ELSE coalesce(title, '') END"


@query("f17_no_information", f"SELECT id FROM (SELECT id, lower({_SAID}) AS s FROM articles) WHERE " + " OR ".join(f"s LIKE {lit('%' + m + '%')}" for m in ("không tìm thấy thông tin", "không tìm thấy dữ liệu", "chưa tìm thấy thông tin", "không có thông tin", "không nhắc tới", "không nhắc đến", "không đề cập", "không tìm thấy", "chưa có thông tin", "i could not find", "cannot find")))
def _(t):
    return t("articles").withColumn("said", F.expr(_SAID)).where(V.contains_any(["said"], list(K.NO_INFO))).select("id")


# ---- boilerplate at the end of articles

_LABELS = "nội dung|noi dung|thiết kế|thiet ke|ảnh|anh|nguồn ảnh|nguon anh|video|đồ họa|do hoa|biên tập|bien tap|kỹ thuật|ky thuat|tác giả|tac gia|thực hiện|thuc hien"
_PREFIX = r"theo|nguồn|source|tác giả|tac gia|biên dịch|bien dich|dịch|dich|tổng hợp|tong hop|thực hiện|thuc hien|bài(?:\s+và)?\s+ảnh|bai(?:\s+va)?\s+anh|ảnh|anh|nguồn ảnh|nguon anh|video|đồ họa|do hoa|infographic"
_BRAND = "['vnexpress', 'dân trí', 'dantri', 'vietnamnet', 'tuổi trẻ', 'tuoi tre', 'thanh niên', 'thanh nien', 'lao động', 'lao dong', 'nhân dân', 'nhan dan', 'vov', 'vtv', 'vtc', 'reuters', 'ap', 'afp', 'bbc', 'cnn', 'bloomberg', 'zing', 'znews']"
_UPPER = "A-ZÀÁẢÃẠĂẰẮẲẴẶÂẦẤẨẪẬĐÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌÔỒỐỔỖỘƠỜỚỞỠỢÙÚỦŨỤƯỪỨỬỮỰỲÝỶỸỴ"
_C1_LINES = rf"""
x AS (SELECT *, regexp_replace(line, '^[()\[\]{{}} ]+|[()\[\]{{}} ]+$', '', 'g') AS bare FROM lines),
y AS (SELECT *, lower(bare) AS low, list_filter(list_transform(string_split(bare, '|'), lambda z: trim(z)), lambda z: z <> '') AS seg,
    list_concat({_BRAND}, list_filter(list_transform(list_concat([own], string_split_regex(own, '[,/|;-]+')), lambda z: trim(z)), lambda z: z <> '')) AS terms
    FROM (SELECT *, lower(trim(regexp_replace(coalesce(source, ''), '{_SPACES}+', ' ', 'g'))) AS own FROM x)),
z AS (SELECT *, len(list_filter(seg, lambda s: regexp_matches(s, '(?i)^\s*(?:{_LABELS})\s*[:：\-–]\s*\S'))) AS credits FROM y),
judged AS (SELECT *, line = '' OR (length(line) <= 180 AND (
    regexp_matches(bare, '(?i)^\s*(?:{_LABELS})\s*[:：\-–]\s*\S')
    OR (len(seg) > 1 AND contains(bare, '|') AND (credits = len(seg) OR (credits > 1 AND len(list_filter(seg, lambda s: length(s) > 80)) = 0)))
    OR regexp_matches(bare, '(?i)^\s*(?:{_PREFIX})\s*[:：\-–]?\s+')
    OR list_contains(terms, regexp_replace(low, '^[()\[\]{{}} .:\-–]+|[()\[\]{{}} .:\-–]+$', '', 'g'))
    OR (starts_with(low, 'theo ') AND length(bare) <= 140)
    OR (regexp_matches(low, '(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])(?:theo|nguồn|source)(?:$|[^\p{{L}}\p{{M}}\p{{N}}_])') AND len(list_filter(terms, lambda s: contains(low, s))) > 0)
    OR (bare <> '' AND length(bare) <= 48 AND NOT regexp_matches(bare, '[.!?;:]') AND len(string_split_regex(trim(bare), '\s+')) <= 5
        AND ((upper(bare) = bare AND lower(bare) <> bare) OR regexp_matches(bare, '^[{_UPPER}][\p{{L}}\p{{M}}\p{{N}}_''.-]+(?:\s+[{_UPPER}][\p{{L}}\p{{M}}\p{{N}}_''.-]+){{0,4}}$')))
    )) AS boiler FROM z)"""


@query("c1e_boilerplate_lines", f"WITH lines AS (SELECT DISTINCT id, source, trim(regexp_replace(unnest(string_split(content, chr(10))), '{_SPACES}+', ' ', 'g')) AS line FROM articles WHERE content IS NOT NULL), {_C1_LINES} SELECT id, line FROM judged WHERE boiler")
def _(t):
    lines = t("articles").where("content is not null").select("id", "source", F.explode(F.split("content", "\n")).alias("line")).select("id", "source", B.collapsed(F.col("line")).alias("line")).distinct()
    return lines.where(B.is_boilerplate(F.col("line"), B.source_terms(F.col("source")))).select("id", "line")


_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'))"
_BLOCKLESS = rf"(SELECT id, source, CASE WHEN length(t) - length(c) <= 1200 THEN rtrim(c) ELSE t END AS t FROM (SELECT id, source, t, regexp_replace(t, '(?is)\s+(?:{_LABELS})\s*[:：\-–]\s*.*?(?:\|\s*(?:{_LABELS})\s*[:：\-–]\s*.*?)+\s*$', '') AS c FROM (SELECT DISTINCT id, source, {_NORMAL} AS t FROM articles WHERE content IS NOT NULL)))"


@query(
    "c1_boilerplate",
    rf"""WITH b AS {_BLOCKLESS},
    p AS (SELECT row_number() OVER () AS u, id, source, list_filter(list_transform(string_split_regex(t, '\n{_SPACES}*\n'), lambda z: trim(regexp_replace(z, '{_SPACES}+', ' ', 'g'))), lambda z: z <> '') AS p FROM b),
    lines AS (SELECT u, id, source, unnest(p) AS line, generate_subscripts(p, 1) AS i, len(p) AS n FROM p), {_C1_LINES},
    kept AS (SELECT u, greatest(coalesce(max(i) FILTER (WHERE NOT boiler), 0), max(n) - 24) AS upto FROM judged GROUP BY u)
    SELECT p.id, array_to_string(p.p[1:coalesce(k.upto, 0)], chr(10) || chr(10)) AS story FROM p LEFT JOIN kept k USING (u) UNION ALL SELECT DISTINCT id, NULL FROM articles WHERE content IS NULL""",
)
def _(t):
    return t("articles").select("id", "content", "source").distinct().select("id", B.stripped(F.col("content"), F.col("source")).alias("story"))


# ---- retrieval

@query("r11_window_scores", r"""WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '[\s\x{85}\p{Z}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
    p AS (SELECT doc_id, w, unnest(range(0, len(w), 100)) AS a FROM w WHERE len(w) > 0),
    c AS (SELECT doc_id, CAST(a // 100 AS INTEGER) AS chunk_no, lower(array_to_string(w[a + 1 : a + 120], ' ')) AS x FROM p),
    s AS (SELECT doc_id, chunk_no, (CASE WHEN contains(x, 'hội chợ') THEN 3 ELSE 0 END + CASE WHEN contains(x, 'con sông') THEN 3 ELSE 0 END + CASE WHEN contains(x, 'chợ') THEN 1 ELSE 0 END + CASE WHEN contains(x, 'phụ') THEN 1 ELSE 0 END + CASE WHEN contains(x, 'huynh') THEN 1 ELSE 0 END)::DOUBLE AS chunk_score FROM c),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_score DESC, chunk_no) AS INTEGER) AS rank FROM s WHERE chunk_score > 0) SELECT doc_id, chunk_no, chunk_score, rank FROM r WHERE rank <= 2""")
def _(t):
    return C.best(C.windows(t("documents").select("doc_id", "text").distinct(), "text"), "doc_id", ["hội chợ", "con sông"], ["chợ", "phụ", "huynh"]).select("doc_id", "chunk_no", "chunk_score", "rank")


_DAY = dt.date(2025, 5, 1)
_ONE_DAY = ("1/5", "01/05", "1.5", "01.05", "1-5", "01-05")
_DATED = " OR ".join(f"lower(title) LIKE '%{v}%' OR lower(content) LIKE '%{v}%'" for v in _ONE_DAY)
_ANY_OF = "(lower(title) LIKE '%người%' OR lower(content) LIKE '%người%')"


@query("r4_date_mentions", f"SELECT id, title, published_date, 50::DOUBLE + least(length(content) / 1000.0::DOUBLE, 5::DOUBLE) AS score FROM (SELECT DISTINCT id, title, content, published_date FROM articles) WHERE ({_DATED}) AND {_ANY_OF} ORDER BY length(content) DESC NULLS LAST, published_date DESC NULLS LAST, id LIMIT 30")
def _(t):
    return S.date_mentions(_one(t), _DAY, ["người"], limit=30).select("id", "title", "published_date", "score")


def _searched(terms: dict[str, float], names: dict[str, float], required: list[str], limit: int) -> str:
    """Both searches and their merge in SQL."""
    hit = lambda c, x: f"lower({c}) LIKE '%{x}%'"
    score = " + ".join(f"(CASE WHEN {hit('title', x)} THEN {2 * w}::DOUBLE ELSE 0::DOUBLE END + CASE WHEN {hit('content', x)} THEN {w}::DOUBLE ELSE 0::DOUBLE END)" for x, w in terms.items())
    any_of = lambda xs: " OR ".join(f"{hit(c, x)}" for x in xs for c in ("title", "content"))
    weight = "CASE n " + " ".join(f"WHEN {lit(x)} THEN {w}::DOUBLE" for x, w in names.items()) + " END"
    return f"""WITH one AS (SELECT DISTINCT id, title, content, published_date FROM articles),
    m AS (SELECT g.article_id AS id, lower(e.name) AS n, g.entity_id FROM article_graph g JOIN graph_entities e ON g.entity_id = e.id WHERE lower(e.name) IN ({', '.join(map(lit, names))})),
    mc AS (SELECT id, count(DISTINCT entity_id) AS mc FROM m GROUP BY id), mw AS (SELECT id, sum(w) AS gs FROM (SELECT DISTINCT id, n, {weight} AS w FROM m) GROUP BY id),
    gr AS (SELECT id, title, published_date, gs AS graph_score, 0::DOUBLE AS keyword_score, gs AS score FROM one JOIN mc USING (id) JOIN mw USING (id) ORDER BY mc DESC, published_date DESC NULLS LAST, id LIMIT {4 * limit}),
    kw AS (SELECT id, title, published_date, 0::DOUBLE AS graph_score, ks AS keyword_score, ks * 0.75::DOUBLE AS score FROM (SELECT *, {score} AS ks FROM one WHERE ({any_of(terms)}) AND ({any_of(required)}) ORDER BY ks DESC, published_date DESC NULLS LAST, id LIMIT {4 * limit}) WHERE ks > 0),
    u AS (SELECT 0 AS b, row_number() OVER (ORDER BY score DESC, published_date DESC NULLS LAST, id) AS p, * FROM gr UNION ALL SELECT 1, row_number() OVER (ORDER BY score DESC, published_date DESC NULLS LAST, id), * FROM kw)
    SELECT id, any_value(title) AS title, any_value(published_date) AS published_date, max(graph_score) AS graph_score, max(keyword_score) AS keyword_score,
    CASE WHEN count(*) > 1 THEN max(graph_score) + max(keyword_score) * 0.75::DOUBLE ELSE max(score) END AS score FROM u GROUP BY id ORDER BY score DESC, graph_score DESC, keyword_score DESC, min(b * 1000 + p) LIMIT {limit}"""


_ANALYSIS = {"search_terms": [*NAMES[:2], *TERMS], "term_weights": {**NAME_WEIGHTS, **WEIGHTS}, "anchor_terms": NAMES[:2]}
_R7_TERMS = {"nam thành": 4.0, "bắc lam": 3.5, "kỷ lục": 4.0, "lãi suất": 2.0, "bệnh viện": 1.0}


@query("r7_hybrid", _searched(_R7_TERMS, _R7_TERMS, ["nam thành", "bắc lam"], 10))
def _(t):
    return S.hybrid(_one(t), t("article_graph"), t("graph_entities"), _ANALYSIS, 10).select("id", "title", "published_date", "graph_score", "keyword_score", "score")


@query("r3_date_terms", _searched({**_R7_TERMS, **dict.fromkeys(_ONE_DAY, 2.5)} | {}, {**_R7_TERMS, **dict.fromkeys(_ONE_DAY, 2.5)}, ["nam thành", "bắc lam"], 10).replace("LIKE '%1-5%'", "LIKE '%1-5%'"))
def _(t):
    return S.hybrid(_one(t), t("article_graph"), t("graph_entities"), _ANALYSIS, 10, day=_DAY).select("id", "title", "published_date", "graph_score", "keyword_score", "score")


# ---- views, sinks and the graph run

@query("v3_statistics", f"""SELECT 'total' AS what, NULL AS name, count(*) AS n FROM articles WHERE {NOT_UPLOADED} UNION ALL SELECT 'source', source, count(*) FROM articles WHERE {NOT_UPLOADED} GROUP BY source UNION ALL
    SELECT 'category', CASE trim(category) WHEN 'Công nghệ' THEN 'Số hóa' WHEN 'Thời tiết Hà Nội' THEN 'Thời tiết Việt Nam' ELSE trim(category) END AS c, count(*) FROM articles WHERE {NOT_UPLOADED} GROUP BY 1, 2""")
def _(t):
    return V.statistics(t("articles"))


@query("v4_article_by_id")
def _(t):
    return V.article_by_id(t("articles"), 21).select("id", "title", "content")


@query("f8_name_in_list", f"SELECT id, name, type FROM graph_entities WHERE lower(name) IN ({', '.join(map(lit, NAMES))})")
def _(t):
    return V.named(t("graph_entities"), NAMES).select("id", "name", "type")


@query("j2_link_entities", "SELECT g.article_id, e.name, e.type FROM article_graph g JOIN graph_entities e ON g.entity_id = e.id")
def _(t):
    return V.linked_entities(t("article_graph"), t("graph_entities")).select("article_id", "name", "type")


@query("j3_relation_ends", "SELECT r.id, s.name AS subject, upper(replace(r.relation_type, ' ', '_')) AS relation, o.name AS object FROM entity_relations r JOIN graph_entities s ON r.subject_id = s.id JOIN graph_entities o ON r.object_id = o.id")
def _(t):
    return V.relation_ends(t("entity_relations"), t("graph_entities")).select("id", "subject", "relation", "object")


@query("f16_focus_terms", "SELECT id FROM articles WHERE lower(coalesce(title, '') || chr(10) || coalesce(content, '')) LIKE '%lãi suất%' OR lower(coalesce(title, '') || chr(10) || coalesce(content, '')) LIKE '%kỷ lục%'")
def _(t):
    return t("articles").where(C.holds_focus(["lãi suất", "kỷ lục"])).select("id")


@query("sk2_insert_links", "SELECT DISTINCT article_id, entity_id FROM article_graph g WHERE NOT EXISTS (SELECT 1 FROM article_graph_index i WHERE i.article_id = g.article_id)")
def _(t):
    g = t("article_graph")
    old = g.join(t("article_graph_index").select("article_id"), "article_id", "left_semi")
    return G.insert_new(old, g, ["article_id", "entity_id"]).select("article_id", "entity_id")


@query("sk5_update_column", "SELECT id, CASE WHEN content IS NOT NULL THEN sha256(content) ELSE cleaned_content END AS cleaned_content FROM articles")
def _(t):
    a = t("articles").select("id", "cleaned_content")
    new = t("articles").where("content is not null").select("id", F.sha2("content", 256).alias("cleaned_content"))
    return G.with_column_updated(a, "cleaned_content", new)


@query("sk8_reset", "SELECT 'article_graph' AS what, 0::BIGINT AS n UNION ALL SELECT 'entity_relations', 0 UNION ALL SELECT 'entity_attributes', 0 UNION ALL SELECT 'article_graph_index', 0")
def _(t):
    n = [df.agg(F.lit(k).alias("what"), F.count(F.lit(1)).alias("n")) for k, df in G.reset({k: t(k) for k in G.DERIVED}).items()]
    return n[0].unionByName(n[1]).unionByName(n[2]).unionByName(n[3])


def _tables(t):
    return {k: t(k) for k in ("graph_entities", *G.DERIVED)}


def _run(t):
    from corvana.operators import build

    return build.run(t("articles"), _tables(t), stored_signature="another")


@query("g5_run_summary")
def _(t):
    return _run(t)["summary"]


@query("g7_run_index")
def _(t):
    return _run(t)["tables"]["article_graph_index"]


for _name in ("h2_question_range", "c1_boilerplate", "t10_cleaned"):
    assert _name in QUERIES and _name in SQL
