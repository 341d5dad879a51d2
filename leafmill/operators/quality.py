"""Report operators over timings, statuses and messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import SPACE
from ..functions.urls import url_host
from .classify import any_of
from .percentiles import exact_percentiles


def perf_summary(timings: DataFrame, key: str, value: str) -> DataFrame:
    """A10, Q5: nearest-rank p50 and p90 and mean of the positive values of each key; NaN is no value."""
    rows = timings.where((F.col(value) > 0) & ~F.isnan(F.col(value).cast("double")))
    ranks = exact_percentiles(rows, key, value, (0.5, 0.9)).select(F.col(key).alias("k_"), F.col("q0").alias("p50"), F.col("q1").alias("p90"))
    means = rows.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(value), 3).alias("mean"))
    return means.join(ranks, F.col(key).eqNullSafe(F.col("k_"))).select(key, "n", "p50", "p90", "mean")


def error_rates(results: DataFrame, code: str) -> DataFrame:
    """A10: (n, timeout_rate, too_large_rate) to three places, over all rows."""
    share = lambda c: F.round(F.count_if(F.col(code) == c) / F.greatest(F.count("*"), F.lit(1)), 3)
    return results.agg(F.count("*").alias("n"), share("EXTRACTION_TIMEOUT").alias("timeout_rate"), share("DOM_TOO_LARGE").alias("too_large_rate"))


def status_by_host(status: DataFrame) -> DataFrame:
    """Q8."""
    return status.groupBy(url_host(F.col("url")).alias("host"), "status").agg(F.count("*").alias("n"))


def run_summary(checks: DataFrame, passed: Column) -> DataFrame:
    """A11."""
    return checks.agg(F.count("*").alias("total"), F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed"))


def parse_error(message: Column) -> Column:
    """struct(code, message) of PREFIX::CODE::message; another text is a message without code."""
    pattern = r"(?s)^[A-Z_]+::([A-Z_]+)::(.*)$"
    hit = message.rlike(pattern)
    return F.struct(F.when(hit, F.regexp_extract(message, pattern, 1)).alias("code"), F.when(hit, F.regexp_extract(message, pattern, 2)).otherwise(message).alias("message"))


# Words of navigation, of book details, and the shapes of chapter titles and addresses.
UTILITY = r"(?i)(去App看书|下载APP|下载|加入书架|书籍详情|书末页|目录|上一章|下一章|返回|首页|排行|推荐|帮助中心|登录|注册|微信读书|墨水屏版|版权信息|节选|欢迎你从|体验卡|推荐值|点评|书城)"
TITLE_NUMBERED = r"(?i)第\s*[零一二三四五六七八九十百千0-9]+\s*[章回节卷话篇]|^(chapter|ch\.?)\s*\d+|\d{1,4}[.\-_]\d{1,5}"
CHAPTER_ADDRESS = r"(?i)/(chapter|reader|read|content)\b|/\d{4,}[-_]\d{1,6}(\.html)?([/?#]|$)|[-_]\d{5,}|[?&](cid|chapterid|chapter)=\d+"
NAV_WORDS = r"(?i)(加入书架|书籍详情|去APP|目录|上一章|下一章|首页|排行榜|设置|扫码|书签|书城|推荐值|点评|体验卡|可读字数|阅读\d+万人|一般\(\d+|推荐\(\d+|不行\(\d+)"
DETAIL_WORDS = r"(?i)(版权信息|ISBN|出版社|译者|版权所有|出版时间)"


def is_utility_nav(title: Column) -> Column:
    """a blank label or one with a word of navigation; a null counts as blank."""
    t = F.trim(F.coalesce(title, F.lit("")))
    return (t == "") | t.rlike(UTILITY)


def is_chapter_title(title: Column) -> Column:
    """F23."""
    t = F.trim(F.coalesce(title, F.lit("")))
    return ~is_utility_nav(t) & (F.length(t) <= 80) & t.rlike(TITLE_NUMBERED)


def is_chapter_address(url: Column) -> Column:
    """looser than the rule for links."""
    return F.coalesce(url.rlike(CHAPTER_ADDRESS), F.lit(False))


def toc_quality(entries: DataFrame, key: str = "list_id") -> DataFrame:
    """(key, n_like, ratio, valid) of each list of (title, url): how much of it looks like chapters, utility labels aside."""
    counted = ~is_utility_nav(F.col("title"))
    sums = entries.groupBy(key).agg(F.count_if(counted).alias("n"), F.count_if(counted & is_chapter_title(F.col("title"))).alias("by_title"), F.count_if(counted & is_chapter_address(F.col("url"))).alias("by_url"))
    like = F.greatest("by_title", "by_url")
    rated = sums.withColumn("n_like", like).withColumn("ratio", F.when(F.col("n") > 0, like / F.col("n")).otherwise(F.lit(0.0)))
    return rated.select(key, "n_like", "ratio", ((F.col("n_like") >= 2) & ((F.col("ratio") >= 0.2) | (F.col("by_url") >= 3))).alias("valid"))


def is_readable_body(text: Column, least: int = 180) -> Column:
    """F21 on a normalized text: long enough, with sentences, and with few words of navigation or book details; null is not."""
    t = F.coalesce(text, F.lit(""))
    n = lambda pattern: F.regexp_count(t, F.lit(pattern))
    marks, han = n("[。！？.!?]"), n("[一-龥]")
    worded = ((han >= 60) | (marks >= 3)) & ((marks >= 2) | (han >= 260))
    share = lambda pattern, per: n(pattern) / F.greatest(F.lit(1.0), F.length(t) / per)
    return (F.length(t) >= least) & worded & (share(NAV_WORDS, 20) <= 0.35) & (share(DETAIL_WORDS, 30) <= 0.45)


# Words of introductions, pages before the text, style sheets, legal footers and pay walls.
INTRO = "(?i)(代表作|文库|出版社|村上春树|阅读狂潮|崇拜对象|内容简介|推荐阅读|书籍简介)"
CHAPTER_MARK = r"(?i)第\s*[0-9零一二三四五六七八九十百千]+\s*[章回节卷]"
SHELL_MARK = r"(?i)第\s*[零一二三四五六七八九十百千0-9]+\s*[章回节卷话篇]"
PART_MARK = r"(?i)^(chapter|part)\s*[0-9ivxlcdm]+"
FRONT_HAN = "(?i)(版权信息|书名：|作者：|译者：|出版社：|出版时间：|ISBN|版权所有|侵权必究|本书由)"
FRONT_LATIN = "(?i)(copyright|all rights reserved|published by|isbn|translator|author|understanding china|editorial board)"
CSS = r"(?i)(background|font-size|margin|padding|position|display|width|height|z-index|url\(|#(?:[0-9a-f]{3}|[0-9a-f]{6})\b)"
LEGAL = "(?i)(ICP备|ICP证|公网安备|统一社会信用代码|违法犯罪举报|网信算备|版权所有|All Rights Reserved|Copyright|北京幻想纵横|纵横小说网)"
PAY_SHELL = "(?i)(VIP章节|会员可见|开通会员|购买本章|购买章节|继续阅读请|解锁本章|订阅后阅读|登录后阅读|需付费阅读|充值阅读|畅读卡|去APP阅读|APP内继续阅读)"
GATED = ("AUTH_REQUIRED", "PAYWALL_BLOCKED", "ANTI_BOT_OR_BLOCKED", "SITE_NOT_FOUND", "CONTENT_REMOVED")
CHECKS = ("basic_info", "toc", "detail_content", "chapter_content", "content", "navigation", "paywall_or_auth")


FALLBACK = r"(?i)\(expected_block\)$|toc_adjacent_ok|chapter_metadata_ok|synthetic_toc_ok|chapter_sequence_ok"
BLOCKED = ("AUTH_REQUIRED", "PAYWALL_BLOCKED", "ANTI_BOT_OR_BLOCKED")


HAN = "[一-龥]"
# What a match of each pattern holds whatever its white space, in lower case; a search for words costs a tenth of the pattern.
HELD = {
    INTRO: ("代表作", "文库", "出版社", "村上春树", "阅读狂潮", "崇拜对象", "内容简介", "推荐阅读", "书籍简介"),
    CHAPTER_MARK: ("第",),
    SHELL_MARK: ("第",),
    PART_MARK: ("chapter", "part"),
    FRONT_HAN: ("版权信息", "书名：", "作者：", "译者：", "出版社：", "出版时间：", "isbn", "版权所有", "侵权必究", "本书由"),
    FRONT_LATIN: ("copyright", "rights", "published", "isbn", "translator", "author", "understanding", "editorial"),
    CSS: ("background", "font-size", "margin", "padding", "position", "display", "width", "height", "z-index", "url(", "#"),
    LEGAL: ("icp备", "icp证", "公网安备", "统一社会信用代码", "违法犯罪举报", "网信算备", "版权所有", "rights", "copyright", "北京幻想纵横", "纵横小说网"),
    PAY_SHELL: ("vip章节", "会员可见", "开通会员", "购买本章", "购买章节", "继续阅读请", "解锁本章", "订阅后阅读", "登录后阅读", "需付费阅读", "充值阅读", "畅读卡", "去app阅读", "app内继续阅读"),
}


def _holds(text: Column, pattern: str) -> Column:
    """Whether a text may match: without one of the words it does not. Words with Han signs are looked for in texts that have any."""
    t = F.lower(F.coalesce(text, F.lit("")))
    latin, han = [tuple(w for w in HELD[pattern] if w.isascii() == plain) for plain in (True, False)]
    parts = ([t.rlike(HAN) & any_of(t, han)] if han else []) + ([any_of(t, latin)] if latin else [])
    return reduce(lambda a, b: a | b, parts)


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " "))


def _n(text: Column, pattern: str) -> Column:
    """Matches in a text whose white space is squeezed; only a text that holds one of the pattern's words is squeezed and searched."""
    return F.when(_holds(text, pattern), F.regexp_count(_squeezed(text), F.lit(pattern))).otherwise(0)


def is_intro(text: Column) -> Column:
    """two words of an introduction and no chapter."""
    return (_n(text, INTRO) >= 2) & (_n(text, CHAPTER_MARK) == 0)


def is_book_front_matter(text: Column) -> Column:
    """three words of an imprint and no chapter."""
    return ((_n(text, FRONT_HAN) >= 3) | (_n(text, FRONT_LATIN) >= 3)) & (_n(text, CHAPTER_MARK) + _n(text, PART_MARK) == 0)


def is_css_noise(text: Column) -> Column:
    """two words of style sheets, or one that tells of places and twelve signs of their syntax."""
    n = lambda pattern: F.regexp_count(_squeezed(text), F.lit(pattern))
    return F.when(_holds(text, CSS), (n(CSS) >= 2) | ((n("[{};:]") >= 12) & (n(r"(?i)url\(|background|display|position") > 0))).otherwise(False)


def is_legal_footer(text: Column) -> Column:
    """F22."""
    return _n(text, LEGAL) >= 2


def is_paywall_shell(html: Column, text: Column) -> Column:
    """two offers to pay in a page or its text, and at most one chapter."""
    merged = F.concat_ws(" ", F.regexp_replace(html, "<[^>]+>", " "), text)
    return (_n(merged, PAY_SHELL) >= 2) & (_n(merged, SHELL_MARK) <= 1)


def sample_titles(entries: DataFrame, key: str = "list_id", pos: str = "page_id", n: int = 5) -> DataFrame:
    """K8: (key, titles) of up to `n` entries of each list, only those like chapters if there are any."""
    good = ~is_utility_nav(F.col("title")) & (is_chapter_title(F.col("title")) | is_chapter_address(F.col("url")))
    w = Window.partitionBy(key).orderBy(F.desc("good"), pos)
    ranked = entries.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("no", F.row_number().over(w)).where(F.col("no") <= n)
    kept = ranked.withColumn("any", F.max("good").over(Window.partitionBy(key))).where("good or not any")
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "title"))), lambda x: x["title"]).alias("titles"))


def site_checks(pages: DataFrame, expectations: DataFrame) -> DataFrame:
    """Q1, Q2: pages (site_id, status, title, detail_len, content_len, n_toc, has_next) with the seven checks.

    A gated status passes the content checks if `expectations` (site_id,
    requires_login, expected_codes) allows it; a site without expectations allows none.
    """
    j = pages.join(expectations, "site_id", "left")
    blocked = F.col("status").isin(*GATED)
    allowed = F.coalesce(blocked & (F.col("requires_login") | F.array_contains("expected_codes", F.col("status"))), F.lit(False))
    detail, chapter = (F.col("detail_len") >= 20) | allowed, (F.col("content_len") >= 180) | allowed
    made = {
        "basic_info": F.trim(F.coalesce("title", F.lit(""))) != "", "toc": (F.col("n_toc") >= 2) | allowed, "detail_content": detail, "chapter_content": chapter,
        "content": detail & chapter, "navigation": F.col("has_next") | (F.col("n_toc") >= 2) | allowed, "paywall_or_auth": ~blocked | allowed,
    }
    return j.select(*pages.columns, *[F.coalesce(v, F.lit(False)).alias(k) for k, v in made.items()])


def consistency_issues(checks: DataFrame) -> Column:
    """Q3: names of checks that hold without their evidence in a row of `site_checks`.

    Further evidence counts where the table has it: detail_excerpt,
    chapter_excerpt, nav_probe (how navigation was found instead of a link) and
    requires_login, which with a blocked status exempts the chapter's text.
    """
    has = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in checks.columns else F.lit(default)
    inked = lambda name: F.length(F.trim(has(name, "")))
    exempt = has("requires_login", False) & F.col("paywall_or_auth") & F.col("status").isin(*BLOCKED)
    rules = {
        "info_without_title": F.col("basic_info") & (F.trim(F.coalesce("title", F.lit(""))) == ""),
        "toc_without_entries": F.col("toc") & (F.col("n_toc") <= 0),
        "detail_without_text": F.col("detail_content") & (F.col("detail_len") < 40) & (inked("detail_excerpt") == 0),
        "chapter_without_text": F.col("chapter_content") & ~exempt & (F.col("content_len") < 80) & (inked("chapter_excerpt") < 20),
        "navigation_without_link": F.col("navigation") & ~F.col("has_next") & ~has("nav_probe", "").rlike(FALLBACK),
    }
    return F.array_compact(F.array(*[F.when(v, k) for k, v in rules.items()]))


def failure_reasons() -> Column:
    """Q4: names of the checks that fail, in their order."""
    return F.array_compact(F.array(*[F.when(~F.col(c), c) for c in CHECKS]))


def chapter_title_of(toc_title: Column, page_title: Column, extracted: Column) -> Column:
    """Q6: the contents list's title, else the page's if it marks a chapter, else the extractor's."""
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(given(toc_title), F.when(page_title.rlike(CHAPTER_MARK) | page_title.rlike(PART_MARK), given(page_title)), given(extracted))


def book_title_of(curated: Column, derived: Column, site: Column, book_id: Column) -> Column:
    """Q7: the first that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (curated, derived, site)], book_id)


def site_table(checked: DataFrame) -> DataFrame:
    """A row a site: its checks, whether all hold without an issue, and the reasons and issues as text."""
    reasons, issues = F.array_join(failure_reasons(), ","), F.array_join(consistency_issues(checked), ",")
    return checked.select("site_id", *CHECKS, "status", reasons.alias("reasons"), issues.alias("issues"), ((reasons == "") & (issues == "")).alias("passed"))


def write_report(results: DataFrame, summary: DataFrame, path: str) -> None:
    """The rows, of `site_table` or others, as JSON under path/rows, those with a false `passed` under path/failures, and the summary as CSV under path/summary."""
    results.write.mode("overwrite").json(f"{path}/rows")
    if "passed" in results.columns:
        results.where(~F.col("passed")).write.mode("overwrite").json(f"{path}/failures")
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/summary")
