"""Chapter lists and bodies that pages carry in scripts, addresses or elements that site rules name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import mask_json, normalize_text, unmask_json
from ..functions.urls import url_host, url_path
from .extract import host_suffixes
from .html import unescape
from .nesting import nested
from .quality import is_utility_nav
from .titles import chapter_title, squeeze

# Where pages keep their state, and what a body must hold.
STATE = r"(?s)window\.__INITIAL_STATE__\s*=\s*(\{.*?\})\s*;"
BODY_KEYS = ("chapterContentHtml", "chapterContentTargetHtml")
HAN_RUN = "[一-龥]{50,}"
LEAST_BODY, LEAST_INJECTED = 180, 400


def _origin(url: Column) -> Column:
    return F.regexp_extract(url, "(?i)^(https?://[^/?#]*)", 1)


def state_chapters(pages: DataFrame) -> DataFrame:
    """(page_id, pos, title, url) of the chapters in the state object of a page's script, by number.

    A title that is a number of up to three digits becomes a chapter's; one
    without text or over 90 characters goes, and so does a number under 1.
    Without an id in the state the one in the page's address counts; a state
    that is no JSON gives no rows.
    """
    schema = "reader struct<infoId:string,chapterInfos:array<struct<chapterUid:string,title:string>>>"
    state = F.from_json(F.regexp_extract(F.coalesce("html", F.lit("")), STATE, 1), schema)["reader"]
    book = F.coalesce(F.nullif(F.trim(F.col("r.infoId")), F.lit("")), F.nullif(F.regexp_extract(url_path(F.col("url")), "(?i)/web/reader/([^/]+)", 1), F.lit("")))
    rows = pages.select("page_id", "url", state.alias("r")).select("page_id", _origin(F.col("url")).alias("origin"), book.alias("book"), F.inline("r.chapterInfos"))
    t = F.trim(F.coalesce("title", F.lit("")))
    rows = rows.withColumn("uid", F.col("chapterUid").try_cast("long")).withColumn("title", F.when(t.rlike(r"^\d{1,3}$"), F.concat(F.lit("第"), t.try_cast("int"), F.lit("章"))).otherwise(t))
    rows = rows.where((F.col("uid") > 0) & (F.col("title") != "") & (F.length("title") <= 90) & F.col("book").isNotNull())
    once = rows.groupBy("page_id", "uid").agg(F.min("title").alias("title"), F.first("origin").alias("origin"), F.first("book").alias("book"))
    pos = F.row_number().over(Window.partitionBy("page_id").orderBy("uid")) - 1
    return once.select("page_id", pos.alias("pos"), "title", F.concat("origin", F.lit("/web/reader/"), "book", F.lit("?chapterUid="), "uid").alias("url"))


def _after(html: Column, key: str) -> Column:
    """What follows the first `key`; null if it is not there."""
    at = F.locate(key, html)
    return F.when(at > 0, F.substring(html, at + len(key), F.length(html)))


def embedded_body(html: Column) -> Column:
    """The first body among the known keys of a script that has 180 characters of text and 50 Han signs in a row, unescaped; else null."""
    html = F.coalesce(html, F.lit(""))
    found = []
    for key in BODY_KEYS:
        raw = unmask_json(F.substring_index(mask_json(_after(html, f'"{key}":"')), '"', 1))
        body = F.from_json(F.concat(F.lit('{"x":"'), raw, F.lit('"}')), "x string")["x"]
        text = normalize_text(unescape(F.regexp_replace(body, "<[^>]+>", " ")))
        found.append(F.when((F.length(text) >= LEAST_BODY) & text.rlike(HAN_RUN), body))
    return F.coalesce(*found)


def balanced_end(tokens: Column) -> Column:
    """The number of tokens up to the ] that closes a bracket opened before the first; null if there is none. Strings are tokens of their own, so brackets in them do not count."""
    def step(acc: Column, x: Column) -> Column:
        depth = acc["depth"] + F.when(x == "[", 1).when(x == "]", -1).otherwise(0)
        end = F.when(acc["end"].isNull() & (depth == 0), acc["n"] + 1).otherwise(acc["end"])
        return F.struct((acc["n"] + 1).alias("n"), depth.alias("depth"), end.alias("end"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(1).alias("depth"), F.lit(None).cast("int").alias("end"))
    return F.aggregate(tokens, zero, step, lambda acc: acc["end"])


def inline_chapters(pages: DataFrame, cap: int = 20) -> DataFrame:
    """(page_id, pos, title, url, idx) of the first array of chapters in a page's source.

    The array ends where the brackets outside strings balance, so its objects
    may hold arrays and objects. Titles that are a number, or a label of
    navigation, go; then the first `cap` stay, with the page's address. An
    array that does not end or is no JSON gives no rows.
    """
    rest = mask_json(_after(F.coalesce("html", F.lit("")), '"chapterInfos":['))
    parts = pages.select("page_id", "url", F.regexp_extract_all(rest, F.lit(r'"[^"]*"|[\[\]]|[^"\[\]]+'), F.lit(0)).alias("s"))
    # no filter on what is cut: Spark would move it under the tokens, and make them anew for each part; nulls give no rows
    cut = parts.withColumn("e", balanced_end(F.col("s")))
    array = F.when(F.col("e").isNotNull(), F.concat(F.lit("["), F.array_join(F.slice("s", 1, F.col("e")), "")))
    rows = cut.select("page_id", "url", F.from_json(unmask_json(array), "array<struct<title:string,chapterIdx:long>>").alias("c"))
    kept = F.filter("c", lambda x: (squeeze(x["title"]) != "") & ~squeeze(x["title"]).rlike(r"^\d{1,3}$") & ~is_utility_nav(x["title"]))
    rows = rows.select("page_id", "url", F.posexplode(F.slice(kept, 1, cap)).alias("pos", "c"))
    return rows.select("page_id", "pos", chapter_title(F.col("c.title")).alias("title"), "url", F.coalesce("c.chapterIdx", F.lit(0)).cast("long").alias("idx"))


def _parameter(url: Column, key: str) -> Column:
    """The first value of a query key, whatever its case; empty if it has none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), rf"(?i)^[^#]*[?&]{key}=([^&#]*)", 1)


def keyed_contents(pages: DataFrame, anchors: DataFrame, work_key: str = "novelid", chapter_key: str = "chapterid", cap: int = 500) -> DataFrame:
    """(page_id, pos, title, url) of the links of a page to the chapters of its own work, by number.

    They go to the page's host and path, with the same work and a chapter
    above 0; the first title of a chapter counts, one that is blank or over
    120 characters becomes its number. Addresses are made anew from the two keys.
    """
    here = pages.select("page_id", _origin(F.col("url")).alias("origin"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), _parameter(F.col("url"), work_key).alias("work")).where("work <> ''")
    links = anchors.select("page_id", F.col("pos").alias("at"), "text", "abs_url").join(here, "page_id")
    there = F.col("abs_url")
    no = _parameter(there, chapter_key).try_cast("long")
    own = links.where((url_host(there) == F.col("host")) & (url_path(there) == F.col("path")) & (_parameter(there, work_key) == F.col("work")) & (no > 0)).withColumn("no", no)
    first = own.groupBy("page_id", "no", "origin", "path", "work").agg(F.min_by("text", "at").alias("text"))
    t = F.trim("text")
    title = F.when((t != "") & (F.length(t) <= 120), t).otherwise(F.concat(F.lit("第"), "no", F.lit("章")))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("no"))
    url = F.concat("origin", "path", F.lit(f"?{work_key}="), "work", F.lit(f"&{chapter_key}="), "no")
    return first.withColumn("place", place).where(F.col("place") <= cap).select("page_id", (F.col("place") - 1).alias("pos"), title.alias("title"), url.alias("url"))


def container_bodies(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, text, injected) of the first element whose id a site's rule names.

    rules: (host_suffix, container_id), of which the least id counts if several
    match; the text must have 180 characters, and
    is a body put there by the site, which exempts the page from the checks for
    log-in and payment, if it has 400 and Han signs. An element that is not
    closed ends with the page.
    """
    named = pages.select("page_id", F.explode(host_suffixes(F.col("url"))).alias("host_suffix")).join(rules.select("host_suffix", "container_id"), "host_suffix")
    named = named.groupBy("page_id").agg(F.min("container_id").alias("container_id"))
    t = nested(pages.join(named, "page_id"), "container_id")
    own = F.filter("blocks", lambda b: F.regexp_extract(b["raw"], r"""(?is)\bid=["']?([^"'\s>]*)""", 1) == F.col("container_id"))
    t = t.select("page_id", "tokens", F.get(own, F.lit(0)).alias("b"))
    inside = F.slice("tokens", F.col("b.start") + 2, F.coalesce("b.end", F.size("tokens")) - F.col("b.start") - 1)
    words = F.transform(F.filter(inside, lambda x: x["kind"] == "text"), lambda x: x["plain"])
    found = t.select("page_id", normalize_text(F.array_join(words, " ")).alias("text")).where(F.length("text") >= LEAST_BODY)
    return found.select("page_id", "text", ((F.length("text") >= LEAST_INJECTED) & F.col("text").rlike("[一-龥]")).alias("injected"))

