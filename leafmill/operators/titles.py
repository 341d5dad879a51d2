"""Titles for the shelf and for chapters, and the summary of a detail page."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from ..functions.text import SPACE, trim
from .quality import is_css_noise, is_legal_footer

# The title of a page without one, and what sites add to titles.
UNTITLED = "未命名网页"
SITE_SUFFIX = r"(?i)\s*[-|｜]\s*.{0,48}文学城.*$"
ADDED = (
    r"(?i)(作者|作家)[：:]\s*[^|_\-–—]+$",
    "(?i)(最新章节|全文阅读|免费阅读|作品|小说大全).*$",
    r"(?i)[-_–—]\s*(免费小说|全文免费阅读|作品|小说大全|七猫免费小说|七猫中文网|塔读小说网|小说阅读页).*$",
    r"(?i)[-_–—]\s*(微信读书|小说阅读网|红袖读书手机版).*$",
)
MARK = "第\\s*[零一二三四五六七八九十百千0-9]+\\s*[章回节卷话篇]"
BOOK_ENDS = (r"(?i)[_-]\s*" + MARK + "[^_，,|]{0,50}$", "(?i)" + MARK + ".*$", "(?i)全文(在线)?阅读.*$", "(?i)最新章节.*$")
PICK_ENDS = (r"（[^）]{1,16}）|\([^)]{1,16}\)", "(?i)最新章节在线阅读.*$", "(?i)全文(在线)?阅读.*$", "(?i)小说网.*$")
SUMMARY_STOP = "(?i)(加入书架|下载APP|登录|注册|目录|上一章|下一章)"
META = r"""(?i)<meta[^>]+(?:name|property)=["'](?:description|og:description)["'][^>]*content=["']([^"']+)["']"""
CHUNK = r"(?is)<p[^>]*>.*?</p>|<div[^>]*>.*?</div>"


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null is empty."""
    return trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " "))


def _without(text: Column, patterns: tuple[str, ...]) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return text


def shelf_title(raw: Column) -> Column:
    """A title in 《》 if there is one; else without 【】, what follows the first _ (if 2 to 95 characters are left) and the site's name."""
    s = squeeze(_nfkc(F.coalesce(raw, F.lit(""))))
    t = squeeze(F.regexp_replace(s, "【[^】]*】", " "))
    head = F.trim(F.substring_index(t, "_", 1))
    t = F.when(F.length(head).between(2, 95), head).otherwise(t)
    t = F.trim(F.regexp_replace(F.trim(F.regexp_replace(t, SITE_SUFFIX, "")), r"\s+_", " "))
    quoted = F.regexp_extract(s, "《[^》]+》", 0)
    return F.when(quoted != "", quoted).when((s == "") | (t == ""), UNTITLED).otherwise(t)


def chapter_title(raw: Column) -> Column:
    """Without author, site and advertisement at the end; blank is empty."""
    return F.trim(F.regexp_replace(_without(squeeze(raw), ADDED), " {2,}", " "))


def has_marker(text: Column) -> Column:
    return text.rlike("(?i)" + MARK) | text.rlike(r"(?i)^(chapter|ch\.?)\s*\d+")


def _book_of(title: Column) -> Column:
    """The part of a title between - and _ that names the book: the first in Han without a chapter number, else the whole."""
    t = squeeze(_without(chapter_title(title), BOOK_ENDS))
    parts = F.filter(F.transform(F.split(t, "[_\\-–—]"), squeeze), lambda p: (p != "") & ~has_marker(p) & p.rlike("[一-龥]{2,}"))
    return F.trim(_without(F.coalesce(F.get(parts, F.lit(0)), t), PICK_ENDS))


def book_title_from(detail: Column, chapter: Column) -> Column:
    """The book named by the detail page's title, else by the chapter page's; one of 60 characters or less is preferred."""
    a, b = _book_of(detail), _book_of(chapter)
    short = lambda x: (x != "") & (F.length(x) <= 60)
    return F.when(short(a), a).when(short(b), b).when(a != "", a).otherwise(b)


def detail_summary(html: Column) -> Column:
    """The description of 40 characters, else the title of 20, else the first clean block of 80; empty if there is none."""
    html = F.coalesce(html, F.lit(""))
    clean = lambda t: ~is_css_noise(t) & ~is_legal_footer(t)
    meta = squeeze(F.regexp_extract(html, META, 1))
    title = squeeze(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))
    blocks = F.transform(F.regexp_extract_all(html, F.lit(CHUNK), F.lit(0)), lambda x: squeeze(F.regexp_replace(x, "<[^>]+>", " ")))
    good = F.filter(blocks, lambda x: (F.length(x) >= 80) & ~x.rlike(SUMMARY_STOP) & clean(x))
    return F.when((F.length(meta) >= 40) & clean(meta), meta).when((F.length(title) >= 20) & clean(title), title).otherwise(F.coalesce(F.get(good, F.lit(0)), F.lit("")))
