"""Pages as tokens: row-local arrays of tags and texts, exploded only where a table is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import normalize_text
from ..functions.urls import abs_url

HIDDEN = (r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>", r"(?s)<!--.*?-->")
TOKEN = "<[^>]+>|[^<]+"


def visible(html: Column) -> Column:
    """The page without scripts, styles and comments."""
    out = F.coalesce(html, F.lit(""))
    for pattern in HIDDEN:
        out = F.regexp_replace(out, pattern, "")
    return out


def unescape(text: Column) -> Column:
    """The entities that texts hold most, the ampersand last."""
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def tokenize_pages(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, tag, raw) of every tag and text in order."""
    t = pages.select("page_id", F.posexplode(F.regexp_extract_all(visible(F.col("html")), F.lit(TOKEN), F.lit(0))).alias("pos", "raw"))
    kind = F.when(F.col("raw").startswith("</"), "close").when(F.col("raw").startswith("<"), "open").otherwise("text")
    return t.select("page_id", "pos", kind.alias("kind"), F.lower(F.regexp_extract("raw", r"^</?([A-Za-z0-9]+)", 1)).alias("tag"), "raw")


def page_title(html: Column) -> Column:
    """S3, X5."""
    return normalize_text(unescape(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)))


LINK = r"(?is)<a\b[^>]*\bhref=.*?</a>"
PARAGRAPH = r"(?is)<p\b[^>]*>(.*?)(?=<p\b|</p>|</?div|</article|</section|$)"


def body_of(seen: Column) -> Column:
    """Text of the visible part of a page."""
    return normalize_text(unescape(F.regexp_replace(F.regexp_replace(seen, r"(?is)<head\b.*?</head>", ""), "<[^>]+>", " ")))


def body_text(html: Column) -> Column:
    """Visible text without tags."""
    return body_of(visible(html))


def paragraphs_of(seen: Column) -> Column:
    """Texts of <p> in the visible part of a page; one that is not closed ends at the next block."""
    raw = F.regexp_extract_all(seen, F.lit(PARAGRAPH), F.lit(1))
    return F.filter(F.transform(raw, lambda x: normalize_text(unescape(F.regexp_replace(x, "<[^>]+>", " ")))), lambda x: x != "")


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, pos, text, href, abs_url) of links with a href."""
    raw = F.regexp_extract_all(visible(F.col("html")), F.lit(LINK), F.lit(0))
    a = pages.select("page_id", "url", F.posexplode(raw).alias("pos", "raw"))
    href = F.regexp_extract("raw", r"""(?is)^<a\b[^>]*?\bhref=["']?([^"'\s>]*)""", 1)
    text = normalize_text(unescape(F.regexp_replace("raw", "<[^>]+>", "")))
    return a.select("page_id", "pos", text.alias("text"), href.alias("href"), abs_url(F.col("url"), unescape(href)).alias("abs_url"))


def strip_attrs(html: Column, keep_images: bool = False) -> Column:
    """Tags without attributes; images go unless kept."""
    out = html if keep_images else F.regexp_replace(html, r"(?is)<img\b[^>]*>", "")
    return F.regexp_replace(out, r"(?s)<([A-Za-z0-9]+)\s[^>]*>", "<$1>")


def link_text(raw: Column) -> Column:
    """Label of a whole link."""
    return normalize_text(unescape(F.regexp_replace(raw, "<[^>]+>", "")))


def link_url(raw: Column, base: Column) -> Column:
    """Absolute address of a whole link on a page."""
    return abs_url(base, unescape(F.regexp_extract(raw, r"""(?is)^<a\b[^>]*?\bhref=["']?([^"'\s>]*)""", 1)))


def page_features(pages: DataFrame, *carried: str) -> DataFrame:
    """A4: lengths and counts of each page, and its links as they are written; all row-local. Columns may be carried along."""
    # in steps, so that no pass over a page is made twice
    seen = pages.select("page_id", "url", "html", *carried, visible(F.col("html")).alias("seen"))
    v = F.col("seen")
    links = F.regexp_extract_all(v, F.lit(LINK), F.lit(0))
    parts = seen.select(
        "page_id", "url", "html", *carried, page_title(F.col("html")).alias("title"), body_of(v).alias("body"), paragraphs_of(v).alias("paragraphs"),
        links.alias("links"), F.regexp_count(v, F.lit(r"(?i)<p\b")).cast("long").alias("n_p"),
    )
    link_text = normalize_text(unescape(F.array_join(F.transform("links", lambda x: F.regexp_replace(x, "<[^>]+>", "")), " ")))
    return parts.select(
        "page_id", "url", "html", *carried, "title", "body", "paragraphs", "links", F.size("links").cast("long").alias("n_anchors"), F.length(link_text).cast("long").alias("link_len"),
        F.length("body").cast("long").alias("text_len"), "n_p", F.regexp_count("body", F.lit("[。！？.!?]")).cast("long").alias("n_sentences"),
    )
