from pyspark.sql import functions as F

from leafmill.functions import urls as U
from leafmill.operators import chapters, classify, html, links, reading
from leafmill.streaming import progress


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")]).select(column.alias("r")).first()["r"]


def split(spark, text):
    rows = chapters.split_chapters(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("order_index").collect()
    return [(r.title, r.content_text) for r in rows]


def test_chapters_without_headings_are_one(spark):
    assert [t for t, _ in split(spark, "他说第一章很好看。\n然后睡了。")] == ["全文"]
    assert split(spark, None) == [] and split(spark, "　\n \n") == []


def test_numbered_and_named_chapters(spark):
    text = "\r\n".join(["序章", "", "起初。", "", "第一章 开始，然后", "", "　　", "内容甲。", "", "", "Chapter 2", "b", "", "x", "Epilogue", "", "end"])
    got = split(spark, text)
    assert [t for t, _ in got] == ["序章", "第一章 开始，然后", "Chapter 2", "Epilogue"]
    assert all("\n\n" not in c for _, c in got)


def test_head_chapter_and_limits(spark):
    head = "字" * 80
    assert [t for t, _ in split(spark, f"{head}\n\n第1章\n甲\n乙\n丙\n第2章\n丁")] == ["开头", "第1章", "第2章"]
    assert [t for t, _ in split(spark, f"{head[1:]}\n\n第1章\n甲\n乙\n丙\n第2章\n丁")] == ["第1章", "第2章"]
    dense = "\n".join(f"第{i}章\n行" for i in range(8))
    assert [t for t, _ in split(spark, dense)] == ["全文"]
    assert len(split(spark, "\n".join(f"第{i}章\n行" for i in range(7)))) == 7
    assert [t for t, _ in split(spark, "第1章" + "长" * 118 + "\n甲\n第2章\n乙")] == ["全文"]


def test_urls(spark):
    f = lambda u: one(spark, U.url_fingerprint(F.lit(u)))
    assert f("https://A.com/x?b=2&utm_x=1&a=1&ref=q#t") == "https://a.com/x?a=1&b=2" == f(f("https://A.com/x?b=2&a=1"))
    absolute = lambda h: one(spark, U.abs_url(F.lit("https://a.com/b/c.html?q=1"), F.lit(h)))
    assert absolute("../d.html") == "https://a.com/d.html" and absolute("/x/./y/") == "https://a.com/x/y/"
    assert absolute("//h.com/z") == "https://h.com/z" and absolute("javascript:void(0)") == "" and absolute("?p=2") == "https://a.com/b/c.html?p=2"
    public = lambda u: one(spark, U.is_public_http_url(F.lit(u)))
    assert public("https://example.com/a") and not any(map(public, ["ftp://a.com", "http://127.0.0.1/", "http://172.16.0.1", "http://[::1]/", "http://u:p@a.com/", "http://localhost", "http://999.1.1.1/"]))
    assert one(spark, U.path_similarity(F.lit("http://a.com/b/1.html"), F.lit("http://a.com/b/2.html"))) == 55
    assert one(spark, U.numeric_delta(F.lit("http://a.com/b?CID=4"), F.lit("http://a.com/b?cid=6"))) == 2


def test_page_status(spark):
    cases = {
        "ANTI_BOT_OR_BLOCKED": "<body>请输入验证码</body>", "SITE_NOT_FOUND": "<title>404</title><body>x</body>", "CONTENT_REMOVED": "<body>该章节不存在</body>",
        "AUTH_REQUIRED": "<body><input type=\"password\"></body>", "PAYWALL_BLOCKED": "<body><div class=\"paywall\">x</div></body>", "OK": "<body><p>" + "a good page. " * 30 + "</p></body>",
    }
    pages = spark.createDataFrame([(i, "http://a.com/", h) for i, h in enumerate(cases.values())], "page_id long, url string, html string")
    got = {r.page_id: r.status for r in classify.access_status(html.page_features(pages)).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases)


def test_links(spark):
    pages = spark.createDataFrame([(1, "http://a.com/b/1.html", '<script>"<a href=no>"</script><a href="2.html">第2章 x</a><a href=\'/b/2.html#q\'>again</a><a href="#">目录</a>'), (2, "http://a.com/b/2.html", "")], "page_id long, url string, html string")
    a = html.anchors(pages)
    assert [(r.title, r.url) for r in links.toc_entries(a).collect()] == [("第2章 x", "http://a.com/b/2.html")]
    assert [(r.src, r.dst, r.n) for r in links.link_graph(a, pages).where("dst = 2").collect()] == [(1, 2, 2)]
    assert sorted((r.page_id, r.other_id, r.delta) for r in links.numeric_neighbours(pages).collect()) == [(1, 2, 1), (2, 1, -1)]


def test_wrapping_repeats_the_indent(spark):
    assert one(spark, reading.wrap_lines(F.lit("  abcdefgh"), 5)) == ["  abc", "  def", "  gh"]
    assert one(spark, reading.wrap_lines(F.lit(""), 5)) == [""]


def test_stream_ends_as_the_batch(spark, tmp_path):
    feed = [(1, 10, 5, "2024-01-01 00:00:01"), (2, 11, 6, "2024-01-01 00:00:02"), (1, 12, 7, "2024-01-01 00:00:03"), (1, 9, 1, "2024-01-01 00:00:02")]
    schema = "book_id long, item_id long, line_index int, updated_at timestamp_ntz"
    for i, part in enumerate((feed[:2], feed[2:])):
        df = spark.createDataFrame(part, "book_id long, item_id long, line_index int, u string").selectExpr("book_id", "item_id", "line_index", "cast(u as timestamp_ntz) updated_at")
        df.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        progress.stream_progress(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = sorted((r.book_id, r.item_id, r.line_index) for r in progress.snapshot(spark, str(tmp_path / "out")).collect())
    assert got == [(1, 12, 7), (2, 11, 6)]
