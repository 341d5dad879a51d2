"""Extraction, navigation, sources and streams on small cases."""

import datetime as dt

from pyspark.sql import functions as F

from leafmill.operators import classify, extract, html, navigation, quality
from leafmill.sources import files
from leafmill.streaming import throttle

BODY = "".join(f"<p>这是第{i}段正文，内容足够长，读起来像一个句子。这里还有一句话作为补充说明。</p>" for i in range(12))


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def test_extracts_the_block_without_noise(spark):
    p = pages(
        spark, ("https://a.example/b/12345_1.html", f"<html><head><title>T</title></head><body><div class='top-menu'><a href='/x'>菜单</a></div><article>{BODY}<div class='share'>分享</div></article><div>短</div></body></html>"),
        ("https://a.example/b/2", None), ("https://a.example/b/3", "<article>too short</article>"),
        ("https://a.example/b/4", '<script type="application/ld+json">{"@graph":[{"articleBody":"' + "A sentence of the story. " * 20 + '\\"end\\""}]}</script><script type="application/ld+json">{bad</script>'),
        ("https://a.example/b/5", "<title>404</title>"),
    )
    got = {r.page_id: r for r in extract.extract_pages(p).collect()}
    assert [got[i].status for i in range(5)] == ["OK", "NO_MAIN_CONTENT", "NO_MAIN_CONTENT", "OK", "SITE_NOT_FOUND"]
    assert got[0].strategy == "heuristic" and "第11段" in got[0].content and "分享" not in got[0].content and "菜单" not in got[0].content
    assert got[3].strategy == "structured" and got[3].content.endswith('"end"')


def test_pagination_and_stated_length(spark):
    p = pages(spark, ("https://a.example/1", f"<article>{BODY}</article><a href='/1?page=2'>下一页</a>"), ("https://a.example/2", f"<p>本章字数：100</p><article>{BODY[:300]}</article>"))
    got = {r.page_id: r.status for r in extract.extract_pages(p).collect()}
    assert got == {0: "PAGINATION_DETECTED", 1: "OK"}


def test_navigation_order_and_bands(spark):
    p = pages(
        spark, ("https://a.example/b/7.html", '<link rel="next" href="/b/9.html"><a href="/b/8.html">下一章</a>'), ("https://a.example/b/7.html", '<a href="/b/8.html">x</a>'),
        ("https://a.example/b/c.html", '<a href="/b/chapter/d.html">下一章</a>'), ("https://a.example/b/7.html", ""),
    )
    a = html.anchors(p)
    nav = navigation.detect_navigation(p, a, classify.pagination_hint(a))
    got = {r.page_id: (r.next_url, r.next_confidence, r.next_reason) for r in nav.collect()}
    assert got[0] == ("https://a.example/b/9.html", 0.92, "rel_next") and got[1] == ("https://a.example/b/8.html", 0.58, "url_numeric_delta")
    assert got[2][2] == "anchor_next" and got[3] == (None, None, None)
    candidates = navigation.next_candidates(p, a, nav)
    toc = spark.createDataFrame([(0, 0, "t", p.first().url, "https://a.example/")], "list_id long, pos int, title string, url string, next_url string")
    matched = navigation.match_toc(p.where("page_id = 3").select("page_id", F.lit(0).cast("long").alias("list_id"), "url"), toc)
    out = {r.page_id: r for r in navigation.resolve_next(p, matched, toc, candidates).collect()}
    assert out[0].next_url.endswith("9.html") and not out[0].needs_confirmation
    assert out[1].next_url is None and out[1].needs_confirmation and out[1].n_choices == 1
    assert out[3].reason == "toc_adjacent_unplausible" and out[3].source == "none"


def test_counted_urls(spark):
    cases = {"https://a/b/9.html?x": "https://a/b/10.html?x", "https://a/b-9/": "https://a/b-10/", "https://a/r?cid=1&p=2": "https://a/r?cid=2&p=2", "https://a/b": "", None: ""}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "u string, v string")
    assert all(r.v == r.got for r in df.select("v", navigation.counted_url(F.col("u"), 1).alias("got")).collect())


def test_charset_repair(spark):
    text = "第一章春天来了万物复苏" * 5
    rows = [("utf8", text.encode()), ("gb", text.encode("gb18030")), ("ascii", b"plain  text"), ("empty", b""), ("twice", text.encode("gbk").decode("latin1").encode()), ("null", None)]
    got = {r.path: r for r in files.repair_charset(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert all(got[k].text == text for k in ("utf8", "gb", "twice")) and got["ascii"].text == "plain text"
    assert got["utf8"].method == "direct-utf-8" and not got["utf8"].changed and got["gb"].method == "direct-gb18030" and got["gb"].changed
    assert got["twice"].method.startswith("utf8->view") and got["empty"].text == got["null"].text == ""


def test_archives(spark):
    package = '<package><manifest><item id="cover" href="cover.html"/><item id="a" href="../t/a.html" media-type="x"/><item id="b" href="b.html"/><item id="gone" href="g.html"/></manifest><spine><itemref idref="cover"/><itemref idref="gone"/><itemref idref="b"/><itemref idref="a"/></spine></package>'
    members = [("z", "META-INF/container.xml", '<rootfile full-path="o/p.opf"/>'), ("z", "o/p.opf", package), ("z", "o/cover.html", "<p>c</p>"), ("z", "t/a.html", "<h2>A</h2><p>one&nbsp;two  \r\nx</p>"), ("z", "o/b.html", "<p>b</p>"), ("y", "o/b.html", None)]
    got = files.flatten_archives(spark.createDataFrame(members, "archive string, path string, text string")).orderBy("order_index").collect()
    assert [(r.title, r.content_text) for r in got] == [("章节 1", "b"), ("A", "Aone two\nx")]


def feed(spark, rows):
    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)
    return spark.createDataFrame([(b, i, line, at(ms), why) for i, (b, ms, line, why) in enumerate(rows)], throttle.OUT)


ROWS = [(1, 0, 0, "tick"), (1, 500, 5, "tick"), (1, 600, 60, "tick"), (2, 700, 3, "tick"), (1, 2200, 61, "tick"), (1, 9000, 61, "tick"), (1, 9001, 61, "pause"), (2, 800, 4, "deleted"), (2, 900, 4, "tick")]


def test_throttle_as_table_and_stream(spark, tmp_path):
    want = [0, 2, 3, 4, 6, 8]
    table = feed(spark, ROWS)
    assert sorted(r.item_id for r in throttle.throttle(table, 10).collect()) == want
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = throttle.stream_throttle(spark.readStream.schema(throttle.OUT).parquet(str(tmp_path / "in")), 10)
    out.writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.item_id for r in spark.table("kept").collect()) == want


def test_backfill_stream(spark, tmp_path):
    spark.createDataFrame([(1, "https://a/1", ""), (2, "https://a/2", "old"), (3, "https://a/3", " ")], "item_id long, url string, content_text string").write.parquet(str(tmp_path / "items"))
    spark.createDataFrame([("https://a/1?utm_source=x", "new"), ("https://a/2", "other")], "url string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, text string").parquet(str(tmp_path / "in"))
    throttle.stream_backfill(stream, str(tmp_path / "items"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [(r.item_id, r.content_text) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "new")]


def test_report(spark, tmp_path):
    rows = spark.createDataFrame([(1, True)], "site_id long, ok boolean")
    quality.write_report(rows, quality.run_summary(rows, F.col("ok")), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/rows")).count() == 1
