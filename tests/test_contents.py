"""Titles, embedded data, contents, library snapshots and streams on small cases."""

import re

from pyspark.sql import functions as F

from leafmill.operators import chapters, classify, contents, embedded, html, library, quality, store, titles
from leafmill.sources import files
from leafmill.streaming import progress


def one(spark, column):
    return spark.range(1).select(column.alias("r")).first()["r"]


def test_titles(spark):
    shelf = lambda t: one(spark, titles.shelf_title(F.lit(t)))
    assert shelf("Ｂｏｏｋ　 one_site") == "Book one" and shelf("x 《书 名》 y") == "《书 名》" and shelf(None) == shelf(" ") == shelf("【a】") == titles.UNTITLED
    assert shelf("a_b") == "a_b" and shelf("书【最新】名 | 晋江文学城") == "书 名"
    chapter = lambda t: one(spark, titles.chapter_title(F.lit(t)))
    assert chapter("第一章  开始 作者：某人") == "第一章 开始" and chapter("第2章 海-七猫中文网 x") == "第2章 海" and chapter(None) == ""
    book = lambda a, b: one(spark, titles.book_title_from(F.lit(a), F.lit(b)))
    assert book("长夜行（某某）_第三章 风", "x") == "长夜行" and book("", "长夜行-第三章") == "长夜行" and book(None, None) == ""


def test_embedded_data_that_is_broken_gives_nothing(spark):
    cases = ['window.__INITIAL_STATE__ = {"reader": {"infoId": ;', '"chapterInfos":[{"title":"a"', '"chapterInfos":[{"title":"a",}]', "", None, '"chapterContentHtml":"x']
    pages = spark.createDataFrame([(i, "https://a.com/web/reader/q", h) for i, h in enumerate(cases)], "page_id long, url string, html string")
    assert embedded.state_chapters(pages).count() == 0 and embedded.inline_chapters(pages).count() == 0
    assert all(r[0] is None for r in pages.select(embedded.embedded_body(F.col("html"))).collect())
    long = spark.createDataFrame([(1, "https://a.com/", '"chapterContentHtml":"' + "\\u003cp\\u003e汉字\\n" * 30000 + '" "chapterInfos":[' + ",".join('{"title":"t%d"}' % i for i in range(30000)) + "]")], "page_id long, url string, html string")
    assert one(spark, F.lit(1)) == 1 and embedded.inline_chapters(long).count() == 20
    assert long.select(F.length(embedded.embedded_body(F.col("html")))).first()[0] is None  # no 50 Han signs in a row


def test_contents_of_nested_lists_and_rescue(spark):
    menu = "".join(f'<li><a href="/m{i}">a label of the menu that is long {i}</a></li>' for i in range(7))
    inner = "".join(f'<li><a href="/b/10000{i}-{i}.html">第{i}章</a></li>' for i in range(4))
    pages = spark.createDataFrame([(1, "https://a.com/x", f"<body><ul>{menu}</ul><div><ul><li>v<ul>{inner}</ul></li></ul></div></body>"), (2, "https://a.com/y", "<p>none</p>"), (3, "https://a.com/z", f"<title>目录</title><ul><li>v<ul>{inner}</ul></li></ul>")], "page_id long, url string, html string")
    got = {i: [(r.title, r.source) for r in contents.page_contents(pages).where(f"page_id = {i}").orderBy("pos").collect()] for i in (1, 2, 3)}
    want = [f"第{i}章" for i in range(4)]
    assert [t for t, _ in got[1]] == want and got[1][0][1] == "list"  # the menu won the lists, the page's chapters took its place
    assert got[2] == [] and [t for t, _ in got[3]] == want


def test_marks_of_blocked_pages(spark):
    long = "<p>" + "a good page of text. " * 20 + "</p>"
    marks = {
        '<span class="captcha-box">': "ANTI_BOT_OR_BLOCKED", '<div class="verify-slider">': "ANTI_BOT_OR_BLOCKED", "<input id=my_captcha>": "ANTI_BOT_OR_BLOCKED", '<iframe src="/captcha/1">': "ANTI_BOT_OR_BLOCKED", "<script>acw_sc__v2</script>": "ANTI_BOT_OR_BLOCKED",
        "<p>captcha slider verify</p>": "OK", "<form action='/login'>": "AUTH_REQUIRED", '<div class="vip">': "PAYWALL_BLOCKED", "<p>removed</p>": "CONTENT_REMOVED", "": "OK",
    }
    pages = spark.createDataFrame([(i, "https://a.com/", f"<body>{m}{long}</body>") for i, m in enumerate(marks)], "page_id long, url string, html string")
    features = html.page_features(pages)
    assert [r.status for r in classify.access_status(features).orderBy("page_id").collect()] == list(marks.values())
    exempt = classify.access_status(features.withColumn("injected", F.col("page_id") == 7)).orderBy("page_id").collect()
    assert exempt[7].status == "OK" and exempt[6].status == "AUTH_REQUIRED"


def test_chapters_of_rows_that_share_an_id(spark):
    rows = [(1, "第1章\na\nb\nc\n第2章\nd"), (1, "第7章\ne\nf\ng\n第8章\nh"), (2, None)]
    out = chapters.split_chapters(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [(r.order_index, r.title) for r in out.collect()] == [(0, "第1章"), (1, "第2章"), (0, "第7章"), (1, "第8章")]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_groups_on_cycles_and_deep_ones(spark):
    ring = spark.createDataFrame([("a", "b", 0, "a"), ("b", "c", 0, "b"), ("c", "a", 0, "c")], "id string, parent_id string, order_index long, title string")
    assert sorted((r.root, r.id, r.depth) for r in library.group_closure(ring).collect()) == [("a", "a", 0), ("a", "b", 2), ("a", "c", 1), ("b", "a", 1), ("b", "b", 0), ("b", "c", 2), ("c", "a", 2), ("c", "b", 1), ("c", "c", 0)]
    chain = spark.createDataFrame([(str(i), str(i - 1) if i else None, 0, "t") for i in range(14)], "id string, parent_id string, order_index long, title string")
    assert library.group_closure(chain, chain.where("id = '0'")).agg(F.max("depth")).first()[0] == 13 and library.group_tree(chain).count() == 14


def test_snapshots_are_whole_or_absent(spark, tmp_path):
    target = str(tmp_path / "library")
    assert store.published(spark, target, "books") is None
    books, items = spark.range(3).toDF("id"), spark.range(5).toDF("item_id")
    assert store.publish({"books": books, "items": items}, target) == 1
    books.limit(1).write.parquet(f"{target}/version=2/books")  # a version that was never finished
    assert store.published(spark, target, "books").count() == 3 and store.publish({"books": books.limit(2), "items": items}, target) == 3
    assert store.published(spark, target, "books").count() == 2 and store.published(spark, target, "items").count() == 5


def test_the_later_batch_wins_and_old_snapshots_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(progress, "FULL", 2)
    schema, source, target = "book_id long, item_id long, line_index int, updated_at timestamp_ntz", str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(6):
        rows = [(1, i, i, f"2024-01-{20 - i:02d} 00:00:00")] + ([(2, 50, 1, "2024-01-01 00:00:00")] if i == 0 else [])
        spark.createDataFrame(rows, "book_id long, item_id long, line_index int, u string").selectExpr("book_id", "item_id", "line_index", "cast(u as timestamp_ntz) updated_at").write.mode("append").parquet(source)
        progress.stream_progress(spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "check")).awaitTermination()
        assert sorted((r.book_id, r.item_id) for r in progress.snapshot(spark, target).collect()) == [(1, i), (2, 50)]
    assert len(progress._batches(spark, target)[2]) <= 4


def test_timings_of_a_stream(spark, tmp_path):
    rows = [("load", 10.0, "2024-01-01 00:01:00"), ("load", 30.0, "2024-01-01 00:02:00"), ("parse", 5.0, "2024-01-01 00:02:00"), ("load", 1.0, "2024-01-01 00:09:00")]
    spark.createDataFrame(rows, "kind string, value double, u string").selectExpr("kind", "value", "cast(u as timestamp) updated_at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("kind string, value double, updated_at timestamp").parquet(str(tmp_path / "in"))
    progress.stream_timings(stream).writeStream.format("memory").queryName("timings").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.kind, r.n, r["mean"]) for r in spark.table("timings").collect()) == [("load", 1, 1.0), ("load", 2, 20.0), ("parse", 1, 5.0)]


def test_text_files_and_reports(spark, tmp_path):
    (tmp_path / "Book One.TXT").write_bytes("第一章".encode())
    (tmp_path / "b.txt").write_bytes(b"")
    got = {r.title: bytes(r.content) for r in files.scan_text_files(spark, str(tmp_path / "*")).collect()}
    assert got == {"Book One": "第一章".encode()}
    rows = [(1, "OK", "t", 50, 100, 3, True), (2, "OK", " ", 50, 10, 0, False)]
    sites = spark.createDataFrame(rows, "site_id long, status string, title string, detail_len int, content_len int, n_toc int, has_next boolean")
    checked = quality.site_checks(sites, spark.createDataFrame([], "site_id long, requires_login boolean, expected_codes array<string>"))
    quality.write_report(quality.site_table(checked), quality.run_summary(quality.site_table(checked), F.col("passed")), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/rows")).count() == 2
    failed = spark.read.json(str(tmp_path / "report/failures")).collect()
    assert [r.site_id for r in failed if re.search("content", r.reasons)] and {r.site_id for r in failed} >= {2}
