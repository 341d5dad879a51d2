"""Queries over tables whose keys and addresses are longer than those of the smallest given ones."""

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from leafmill.functions.text import SPACE, trim
from leafmill.operators import classify, extract, quality
from leafmill.plans import registry
from leafmill.sources.files import repair_charset
from leafmill.streaming import throttle


def same(spark, folder, name):
    con = duckdb.connect()
    for file in folder.iterdir():
        con.sql(f"create view {file.name.split('.')[0]} as select * from '{file}/*.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, str(folder))
    rows = sorted(map(tuple, got.select(*want.columns).collect()), key=repr)
    assert rows == sorted(want.fetchall(), key=repr)
    return got


def test_bodies_of_pages_with_long_numbers(spark, tmp_path):
    spark.sql("SELECT id AS page_id, 'https://a.example/' AS url, '<p>x</p>' AS html FROM range(123400, 123500)").write.parquet(str(tmp_path / "pages.parquet"))
    same(spark, tmp_path, "n2_embedded_bodies")


def test_places_in_lists_of_addresses_with_long_numbers(spark, tmp_path):
    url = "concat('https://a', id % 2, '.example/', id DIV 50, '/', 12345 + id % 50, CASE WHEN id % 3 = 0 THEN '.html' ELSE '/?utm_source=x' END)"
    spark.sql(f"SELECT id AS page_id, {url} AS url, '' AS html FROM range(100)").write.parquet(str(tmp_path / "pages.parquet"))
    same(spark, tmp_path, "j8_match_toc")
    kinds = {r.by for r in same(spark, tmp_path, "j8_match_toc_by_number").collect()}
    assert kinds == {0, 1}


def test_words_that_a_pattern_is_searched_for_by(spark):
    """A text without any of a pattern's words has no match, whatever its case and white space; one with a word is counted whole."""
    hits = [
        "代表作 文库", "VIP章节 vip章节", "去app阅读 APP内继续阅读", "第　 12\n章 第三回", "chapter\t4", "PART iv", "书名：a 作者：b ISBN", "ALL　rights \n reserved COPYRIGHT", "Published by x Understanding  China Editorial\tBoard",
        "#FFF; #00ff00 z-index URL( BackGround", "ICP备 icp证 All Rights\nReserved", "İSBN ISBN", "Ｃopyright", "﻿chapter 1", "第1话 第2篇", "", " ", None, "plain text",
    ]
    df = spark.createDataFrame([(t,) for t in hits], "t string")
    plain = lambda p: F.regexp_count(trim(F.regexp_replace(F.coalesce("t", F.lit("")), f"{SPACE}+", " ")), F.lit(p))
    for pattern in quality.HELD:
        rows = df.select("t", plain(pattern).alias("want"), quality._n(F.col("t"), pattern).alias("got")).collect()
        assert all(r.want == r.got for r in rows) and any(r.want for r in rows), pattern


def test_one_book_without_a_flush_over_many_blocks(spark, monkeypatch):
    """A row each second, so that every second row passes and no block tells what it ends with, and each begins with what the one before it ends with."""
    monkeypatch.setattr(throttle, "BLOCK", 64)
    feed = spark.range(301).selectExpr("7L AS book_id", "id AS item_id", "int(id) AS line_index", "timestamp_seconds(id) AS updated_at", "'tick' AS reason")
    assert [r.item_id for r in throttle.throttle(feed, 10).orderBy("item_id").collect()] == list(range(0, 301, 2))


def test_throttling_takes_few_jobs(spark):
    """Jobs are what a table of any size pays for; pointer doubling and looking ahead took hundreds."""
    feed = spark.range(600).selectExpr("id % 3 AS book_id", "id AS item_id", "int(id) AS line_index", "timestamp_seconds(id) AS updated_at", "IF(id % 50 = 0, 'pause', 'tick') AS reason")
    spark.sparkContext.setJobGroup("throttle", "")
    throttle.throttle(feed, 10).count()
    ids = spark.sparkContext.statusTracker().getJobIdsForGroup("throttle")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(ids) < 30


def test_charset_repair_takes_files_in_bounded_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    big = spark.range(0, 48, 1, 1).select("id", F.encode(F.repeat(F.lit("text "), F.lit(200_000)), "UTF-8").alias("content"))
    out = repair_charset(big)
    sizes = big.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert len(sizes) > 4 and max(r.n for r in sizes) < 1 << 24
    assert out.agg(F.sum(F.length("text"))).first()[0] == 48 * 1_000_000


def test_pages_are_worked_out_in_their_rows(spark):
    """Without rules no join and no shuffle, so pages that share an id stay apart; normal signs of ASCII are those of the whole pattern."""
    body = "<p>" + "A sentence of the text of the page. " * 12 + "</p>"
    rows = [(1, "https://a.example/1", f"<html><body><article>{body}one</article></body></html>"), (1, "https://a.example/2", f"<html><body><article>{body}two</article></body></html>"), (2, "https://a.example/3", None), (3, "https://a.example/4", "")]
    out = extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted((r.page_id, r.status, (r.content or "")[-3:]) for r in out.collect()) == [(1, "OK", "one"), (1, "OK", "two"), (2, "NO_MAIN_CONTENT", ""), (3, "NO_MAIN_CONTENT", "")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    signs = spark.range(0, 0x3100).select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    kept = signs.where(F.length(F.regexp_replace("c", classify.NORMAL, "")) != F.length(F.regexp_replace(F.regexp_replace("c", classify.NORMAL_ASCII, ""), classify.NORMAL + "+", "")))
    assert kept.count() == 0
