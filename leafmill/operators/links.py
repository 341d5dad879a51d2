"""Link tables: predicates on link texts and URLs, groups, graphs and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.urls import CHAPTER_KEYS, last_path_number, numeric_delta, path_similarity, url_fingerprint, url_host, url_path

# Labels of links that lead on, back, or to no chapter.
NEXT = r"(?i)(下一章|下一页|下一节|下页|下一篇|后[一1]章|继续阅读|加载下一章|下一回|下一节内容|Next|>>|›)"
PREVIOUS = r"(?i)(上一章|上一页|上一节|上页|上一篇|前[一1]章|上一回|Prev|Previous|<<|‹)"
STOP = r"(?i)^(登录|注册|目录|书页|返回|首页|上一章|下一章|上一页|下一页|下载|举报)$"
NUMBERED = r"(?i)第\s*[零一二三四五六七八九十百千0-9]+\s*[章回节卷话篇]|^(chapter|ch\.)\s*[0-9]+"


def is_next_text(text: Column) -> Column:
    """F20."""
    return text.rlike(NEXT)


def is_prev_text(text: Column) -> Column:
    """F20."""
    return text.rlike(PREVIOUS)


def is_chapter_link_text(text: Column) -> Column:
    """numbered labels up to 80 characters, or others up to 24; never a navigation label."""
    s = F.trim(text)
    return (s != "") & (F.length(s) <= 80) & ~s.rlike(STOP) & (s.rlike(NUMBERED) | (F.length(s) <= 24))


def is_chapter_href(url: Column) -> Column:
    """a chapter word or a long number with a part number in the path, or a numeric chapter key in the query."""
    path = F.lower(url_path(url))
    keys = "|".join(CHAPTER_KEYS[:4])
    return path.rlike(r"/(chapter|reader|read|content)\b") | path.rlike(r"/\d{5,}[-_]\d{1,6}") | F.lower(url).rlike(rf"[?&]({keys})=-?\d+(&|#|$)")


def first_by_fingerprint(df: DataFrame, keys: list[str], url: str, order: str) -> DataFrame:
    """Of the rows with one fingerprint the first, a key at a time."""
    rows = df.withColumn("fp", url_fingerprint(F.col(url)))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys, "fp").orderBy(order))).where("rn = 1").drop("rn")


def best_url_group(anchors: DataFrame) -> DataFrame:
    """(page_id, signature, score) of the group of links with one shape of URL that looks most like a table of contents."""
    shape = F.regexp_replace(F.regexp_replace(F.col("abs_url"), "[?#].*$", ""), r"\d+", "#")
    like = is_chapter_link_text(F.col("text")) & is_chapter_href(F.col("abs_url"))
    g = anchors.where("abs_url <> ''").groupBy("page_id", shape.alias("signature")).agg((F.count("*") + 2 * F.count_if(like)).alias("score"))
    return g.groupBy("page_id").agg(F.max(F.struct("score", "signature")).alias("m")).select("page_id", "m.signature", "m.score")


def link_graph(anchors: DataFrame, pages: DataFrame) -> DataFrame:
    """(src, dst, n) between pages that are there, matched by fingerprint."""
    known = pages.select(F.col("page_id").alias("dst"), url_fingerprint(F.col("url")).alias("fp"))
    out = anchors.where("abs_url <> ''").select(F.col("page_id").alias("src"), url_fingerprint(F.col("abs_url")).alias("fp"))
    return out.join(known, "fp").groupBy("src", "dst").agg(F.count("*").alias("n"))


def numeric_neighbours(pages: DataFrame, min_similarity: int = 45) -> DataFrame:
    """(page_id, other_id, delta) of pages on one host whose numbers differ by one.

    The neighbour's number is made beforehand, so the join is by host and
    number and never all pages of a host.
    """
    p = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), last_path_number(F.col("url")).alias("no")).where("no is not null and host <> ''")
    left = p.select(F.col("page_id"), F.col("url").alias("a"), "host", F.explode(F.array(F.col("no") - 1, F.col("no") + 1)).alias("no"))
    j = left.join(p.select(F.col("page_id").alias("other_id"), F.col("url").alias("b"), "host", "no"), ["host", "no"])
    j = j.withColumn("delta", numeric_delta(F.col("a"), F.col("b"))).withColumn("similarity", path_similarity(F.col("a"), F.col("b")))
    return j.where(F.col("delta").isin(-1, 1) & (F.col("similarity") >= min_similarity)).select("page_id", "other_id", F.col("delta").cast("long").alias("delta"))


def toc_next(entries: DataFrame) -> DataFrame:
    """Each entry with the one behind it."""
    w = Window.partitionBy("page_id").orderBy("pos")
    return entries.withColumn("next_url", F.lead("url").over(w)).withColumn("next_title", F.lead("title").over(w))


def toc_entries(anchors: DataFrame, cap: int = 500) -> DataFrame:
    """Links that look like chapters, once by fingerprint, in order, at most `cap` a page."""
    like = anchors.where(is_chapter_link_text(F.col("text")) & (F.col("abs_url") != ""))
    first = first_by_fingerprint(like, ["page_id"], "abs_url", "pos")
    no = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return first.withColumn("no", no).where(F.col("no") <= cap).select("page_id", "pos", F.col("text").alias("title"), F.col("abs_url").alias("url"))
