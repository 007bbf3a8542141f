from pyspark.sql import functions as F

from corvana.sources import feeds, lexicon, pages
from corvana.streaming.refresh import refresh

RSS = """<rss><channel><title>k</title><item><title><![CDATA[Tin & một]]></title><link>https://a/1</link><description>&lt;p&gt;Tóm tắt&lt;/p&gt;</description>
<pubDate>Mon, 06 May 2024 08:30:00 +0700</pubDate></item><item><title>Hai</title></item></channel></rss>"""


def test_feeds(spark):
    d = spark.createDataFrame([(RSS, "S", "C"), ("not xml", "S", "C"), (None, "S", "C")], "xml string, source string, category string")
    got = feeds.parse_feeds(d).orderBy("pos").collect()
    assert [(r["title"], r["link"], r["summary"], r["published_date"]) for r in got] == [("Tin & một", "https://a/1", "Tóm tắt", "2024-05-06 08:30:00"), ("Hai", "", "", None)]
    assert feeds.head(feeds.parse_feeds(d), ["source"], 1).count() == 1
    assert feeds.catalogue(spark, {"k": {"name": "N", "categories": {"A": ["u1", "u2"]}}}).count() == 2


def test_pages(spark):
    long = "Đây là nội dung chính của bài viết. " * 12
    html = f"<html><body><nav>menu</nav><div><p>{'ngắn ' * 60}</p><a>x</a><a>y</a><a>z</a></div><article><p>{long}<p>{long}</article><script>var x</script></body></html>"
    site = "<article class='fck_detail'><p class='Normal'>Một <b>hai</b></p><p>bỏ</p><p class='Normal'>Ba</p></article>"
    d = spark.createDataFrame([(1, "https://x/1", html), (2, "https://vnexpress.net/2", site), (3, "https://x/3", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.page_text(d).collect()}
    assert got[2] == "Mộthai\n\nBa" and long.strip() in got[1] and "menu" not in got[1] and 3 not in got
    assert spark.createDataFrame([("a<nav>m</nav>b<!-- c -->d",)], "h string").select(pages.without_noise(F.col("h"))).first()[0] == "abd"


def test_lexicon(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"org": ["Công ty A", "12", "và"], "nope": ["x"], "LOC": "bad", "TOPIC": ["AI", "GPT"]}', encoding="utf-8")
    assert {(r["type"], r["phrase"]) for r in lexicon.read_lexicon(spark, str(tmp_path / "l.json")).collect()} == {("ORG", "công ty a"), ("TOPIC", "gpt")}
    (tmp_path / "s.txt").write_text("Và \n\ncủa\n", encoding="utf-8")
    assert lexicon.read_stopwords(spark, str(tmp_path / "s.txt")) == {"và", "của"}
    assert "của" in lexicon.read_stopwords(spark, None)


def test_refresh_equals_batch(spark, tmp_path):
    schema = "id long, title string, link string, summary string, content string, published_date string, source string, category string, collected_at timestamp"
    rows = [(1, "a", "l1", "s", "c1", None, "x", None), (2, "b", "l2", "s", "c2", None, "x", None), (3, "a2", "l1", "s3", "c3", None, "x", "Xe")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema.rsplit(",", 1)[0]).withColumn("collected_at", F.timestamp_seconds(F.lit(1000 + i))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = refresh(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    last = spark.read.parquet(str(tmp_path / "out" / "v2"))
    got = {r["link"]: (r["title"], r["content"], r["category"]) for r in last.collect()}
    assert got == {"l1": ("a", "c3", "Xe"), "l2": ("b", "c2", None)} or got == {"l1": ("a2", "c1", "Xe"), "l2": ("b", "c2", None)}
