"""Next and previous chapters of pages: link scores, detection, resolution, and neighbours by number or contents list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import normalize_text
from ..functions.urls import TRACKING, _part, _query, abs_url, numeric_delta, path_similarity, same_path_group, trailing_id, url_fingerprint, url_host, url_path
from .extract import _meta
from .links import first_by_fingerprint, is_chapter_href, is_chapter_link_text, is_next_text, is_prev_text

# Words of chapters and of contents pages, and the shapes of addresses that can be counted on.
CHAPTER_WORD = r"(?i)chapter|section|page|第\s*\d+|章|节|回"
CHAPTER_LABEL = r"(?i)第\s*[0-9零一二三四五六七八九十百千]+\s*[章回节卷]"
CONTENTS_WORD = "(?i)(目录|章节|章节列表|返回目录|书页|catalog|toc|chapters)"
COUNTED = (r"(?i)^(.*/)(\d+)(\.html(?:\?.*)?)$", r"^(.*[-_])(\d+)(/?)$", r"^(.*/)(\d+)(/?)$", r"(?i)^(.*?[?&](?:cid|chapterid|chapter)=)(\d+)(.*)$")
SEQUENCE_KEYS = ("cid", "chapterid", "chapter")
FROM_LIST, FROM_REL, FROM_NUMBER, FROM_PAGINATION = 0.92, 0.92, 0.58, 0.42
SURE, POSSIBLE = 0.75, 0.45


def site_fingerprint(url: Column) -> Column:
    """Https, host, path without slashes and a part number at its end, sorted query without tracking keys. Another text loses its fragment and last slashes."""
    path = F.regexp_replace(F.regexp_replace(_part(url, 3), "/+$", ""), r"_\d+$", "")
    pairs = F.array_sort(F.filter(_query(url), lambda x: ~F.substring_index(x, "=", 1).rlike(TRACKING)))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    good = F.concat(F.lit("https://"), F.lower(_part(url, 2)), F.when(path == "", "/").otherwise(path), query)
    return F.when(_part(url, 2) != "", good).otherwise(F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", ""))


def counted_url(url: Column, step: int) -> Column:
    """The address with its chapter number changed by `step`, at least 1 when going back; empty if no shape fits."""
    out = F.lit("")
    for pattern in reversed(COUNTED):
        number = F.regexp_extract(url, pattern, 2).try_cast("long") + step
        number = F.greatest(F.lit(1), number) if step < 0 else number
        out = F.when(url.rlike(pattern) & number.isNotNull(), F.concat(F.regexp_extract(url, pattern, 1), number.cast("string"), F.regexp_extract(url, pattern, 3))).otherwise(out)
    return F.coalesce(out, F.lit(""))


def nav_score(base: Column, text: Column, url: Column) -> Column:
    """How much a link looks like one to a neighbouring chapter; 0 without an address."""
    points = (
        F.when(is_next_text(text) | is_prev_text(text), 80).otherwise(0) + F.when(text.rlike(CHAPTER_WORD), 20).otherwise(0) + F.when(is_chapter_href(url), 26).otherwise(0)
        + F.when(same_path_group(base, url), 25).otherwise(0) + path_similarity(base, url) + F.when(url.rlike(r"\d"), 10).otherwise(0)
    )
    return F.when(url == "", 0).otherwise(points)


def is_plausible_chapter(url: Column, host: Column) -> Column:
    """on the page's own host any path but the root; elsewhere chapter words, keys or long numbers."""
    path = F.lower(url_path(url))
    shaped = path.rlike(r"(chapter|reader|read|content)\b") | url.rlike(r"(?i)[?&](cid|chapterid|chapter)=\d+") | path.rlike(r"/\d+[-_]\d+") | path.rlike(r"\d{5,}")
    return (path != "/") & ((url_host(url) == host) | shaped)


def toc_link(anchors: DataFrame) -> DataFrame:
    """(page_id, toc_url), the first link whose label names contents."""
    named = anchors.where((F.col("abs_url") != "") & F.col("text").rlike(CONTENTS_WORD))
    return named.groupBy("page_id").agg(F.min_by("abs_url", "pos").alias("toc_url"))


def scored_links(pages: DataFrame, anchors: DataFrame) -> DataFrame:
    """Links to other pages with their scores."""
    base = pages.select("page_id", F.col("url").alias("base"))
    a = anchors.where("abs_url <> ''").join(base, "page_id")
    a = a.where(url_fingerprint(F.col("abs_url")) != url_fingerprint(F.col("base")))
    return a.withColumn("score", nav_score(F.col("base"), F.col("text"), F.col("abs_url")))


def rel_link(html: Column, base: Column, rel: str) -> Column:
    """The address of the last link of this relation that leads elsewhere, else null."""
    tags = F.regexp_extract_all(html, F.lit(rf"""(?is)<(?:a|link)\b[^>]*\brel=["']?{rel}["'\s>/][^>]*>?"""), F.lit(0))
    urls = F.transform(tags, lambda t: abs_url(base, F.regexp_extract(t, r"""(?is)\bhref=["']?([^"'\s>]+)""", 1)))
    return F.try_element_at(F.filter(urls, lambda u: (u != "") & (url_fingerprint(u) != url_fingerprint(base))), F.lit(-1))


def detect_navigation(pages: DataFrame, anchors: DataFrame, hints: DataFrame) -> DataFrame:
    """(page_id, next_url, next_confidence, next_reason, prev_url, prev_confidence, prev_reason).

    In order: the page's declared relation, an address whose number differs by
    one, the best labelled link of 60 points or more, the next page of a
    pagination. The first link wins ties. All links of a page are one aggregate.
    """
    s = scored_links(pages, anchors)
    first = -F.col("pos")

    def best(condition: Column, by: Column, name: str) -> Column:
        return F.max(F.when(condition, F.struct(by.alias("by"), first.alias("at"), F.col("abs_url").alias("url")))).alias(name)

    delta, similar = numeric_delta(F.col("base"), F.col("abs_url")), path_similarity(F.col("base"), F.col("abs_url"))
    labelled = F.col("score") >= 60
    g = s.groupBy("page_id").agg(
        best((delta == 1) & (similar >= 45), similar, "n_number"), best((delta == -1) & (similar >= 45), similar, "p_number"),
        best(labelled & is_next_text(F.col("text")), F.col("score"), "n_label"), best(labelled & is_prev_text(F.col("text")), F.col("score"), "p_label"),
    )
    p = pages.select("page_id", F.col("url").alias("base"), rel_link(F.col("html"), F.col("url"), "next").alias("n_rel"), rel_link(F.col("html"), F.col("url"), "prev").alias("p_rel"))
    j = p.join(g, "page_id", "left").join(hints.select("page_id", F.col("next_page_url").alias("more")), "page_id", "left")
    more = F.when(url_fingerprint(F.col("more")) != url_fingerprint(F.col("base")), F.col("more"))

    def choice(side: str, name: str) -> Column:
        made = lambda url, confidence, reason: F.when(url.isNotNull(), F.struct(url.alias("url"), confidence.alias("confidence"), F.lit(reason).alias("reason")))
        label = F.col(f"{side}_label")
        options = [
            made(F.col(f"{side}_rel"), F.lit(FROM_REL), f"rel_{name}"), made(F.col(f"{side}_number.url"), F.lit(FROM_NUMBER), "url_numeric_delta"),
            made(label["url"], F.least(F.lit(0.88), 0.52 + label["by"] / 220), f"anchor_{name}"),
        ]
        return F.coalesce(*options, *([made(more, F.lit(FROM_PAGINATION), "pagination_next")] if side == "n" else []))

    j = j.select("page_id", choice("n", "next").alias("n"), choice("p", "prev").alias("p"))
    return j.select("page_id", *[F.col(f"{s}.{c}").alias(f"{name}_{c}") for s, name in (("n", "next"), ("p", "prev")) for c in ("url", "confidence", "reason")])


def next_candidates(pages: DataFrame, anchors: DataFrame, navigation: DataFrame, pool: int = 8, top: int = 6) -> DataFrame:
    """K4, U4: (page_id, rank, url, label, confidence, reason): the detected address and the best links that look like a next one.

    An address is taken once, in order of points; of the first `pool` the `top`
    most confident stay, ties in that order.
    """
    s = scored_links(pages, anchors)
    text = F.col("text")
    looks = is_next_text(text) | (text.rlike(CHAPTER_LABEL) & (F.col("score") >= 48)) | (text.rlike("(?i)next|下一篇") & (F.col("score") >= 52))
    label = F.when(text == "", "下一章").otherwise(F.substring(text, 1, 56))
    guessed = s.where(looks).select("page_id", F.col("abs_url").alias("url"), label.alias("label"), F.least(F.lit(0.88), 0.48 + F.col("score") / 200).alias("confidence"), F.lit("anchor_guess").alias("reason"), (-F.col("score")).alias("a"), F.col("pos").alias("b"))
    primary = navigation.where("next_url is not null").select("page_id", F.col("next_url").alias("url"), F.lit("系统推荐").alias("label"), F.col("next_confidence").alias("confidence"), F.col("next_reason").alias("reason"), F.lit(-(1 << 30)).alias("a"), F.lit(0).alias("b"))
    once = guessed.unionByName(primary).withColumn("fp", url_fingerprint(F.col("url"))).groupBy("page_id", "fp").agg(F.min_by(F.struct("url", "label", "confidence", "reason", "a", "b"), F.struct("a", "b")).alias("x")).select("page_id", "x.*")
    pooled = once.withColumn("no", F.row_number().over(Window.partitionBy("page_id").orderBy("a", "b"))).where(F.col("no") <= pool)
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("confidence"), "no"))
    return pooled.withColumn("rank", rank).where(F.col("rank") <= top).select("page_id", "rank", "url", "label", "confidence", "reason")


def match_toc(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, list_id, pos, title, by) of each page's place in its list (page_id, list_id, url).

    By fingerprint, else by a trailing number, else by the text of the address;
    the first entry of the best kind. Three equal joins, no pairs of a list.
    """
    keys = lambda url: F.explode(F.array(*[F.struct(F.lit(i).alias("by"), k.alias("key")) for i, k in enumerate((url_fingerprint(url), F.nullif(trailing_id(url), F.lit("")), url))]))
    p = pages.select("page_id", "list_id", keys(F.col("url")).alias("k")).select("page_id", "list_id", "k.*").where("key is not null")
    e = entries.select("list_id", "pos", "title", keys(F.col("url")).alias("k")).select("list_id", "pos", "title", "k.*").where("key is not null")
    e = e.groupBy("list_id", "by", "key").agg(F.min(F.struct("pos", "title")).alias("e"))
    found = p.join(e, ["list_id", "by", "key"]).groupBy("page_id", "list_id").agg(F.min(F.struct("by", "e")).alias("x"))
    return found.select("page_id", "list_id", "x.e.pos", "x.e.title", "x.by")


def resolve_next(pages: DataFrame, matched: DataFrame, following: DataFrame, candidates: DataFrame) -> DataFrame:
    """(page_id, next_url, confidence, reason, source, needs_confirmation, n_choices).

    `following` is (list_id, pos, next_url): the entry behind each. A page with
    a place and an entry behind takes it if plausible, else nothing. Otherwise
    the best candidate: 0.75 is taken, 0.45 needs confirmation, less is nothing.
    """
    behind = matched.where("by = 0").join(following.where("next_url is not null").select("list_id", "pos", F.col("next_url").alias("toc_next")), ["list_id", "pos"]).select("page_id", "toc_next")
    one = F.struct(F.col("rank"), F.col("url"), F.col("label"), F.col("confidence"), F.col("reason"))
    c = candidates.where(F.col("confidence") >= POSSIBLE).groupBy("page_id").agg(F.array_sort(F.collect_list(one)).alias("pool"))
    j = pages.select("page_id", "url").join(behind, "page_id", "left").join(c, "page_id", "left")
    fit = is_plausible_chapter(F.col("toc_next"), url_host(F.col("url")))
    best = F.get(F.col("pool"), F.lit(0))
    listed, sure = F.col("toc_next").isNotNull(), best["confidence"] >= SURE
    return j.select(
        "page_id", F.when(listed, F.when(fit, F.col("toc_next"))).when(sure, best["url"]).alias("next_url"),
        F.when(listed, F.when(fit, FROM_LIST).otherwise(0.0)).otherwise(F.coalesce(best["confidence"], F.lit(0.0))).alias("confidence"),
        F.when(listed, F.when(fit, "toc_adjacent").otherwise("toc_adjacent_unplausible")).when(sure, best["reason"]).when(best.isNotNull(), "pending_user_choice").otherwise("none").alias("reason"),
        F.when(listed, F.when(fit, "toc").otherwise("none")).when(best.isNotNull(), "nav").otherwise("none").alias("source"),
        F.coalesce(~listed & ~sure, F.lit(False)).alias("needs_confirmation"), F.when(~listed & ~sure, F.size("pool")).otherwise(0).alias("n_choices"),
    )


def sequence_toc(pages: DataFrame, titles: DataFrame, n: int = 5) -> DataFrame:
    """(page_id, no, title, url): the pages there are under the next `n` numbers of a page's chapter key.

    `titles` is (url, title); a title without a chapter's mark becomes a numbered one.
    """
    key = F.regexp_extract("url", rf"(?i)[?&]({'|'.join(SEQUENCE_KEYS)})=\d+", 1)
    at = rf"(?i)^(.*?[?&](?:{'|'.join(SEQUENCE_KEYS)})=)(\d+)(.*)$"
    number = F.regexp_extract("url", at, 2).try_cast("long")
    p = pages.where(key != "").select("page_id", "url", number.alias("n0"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("no")).where("n0 > 0")
    p = p.withColumn("made", F.concat(F.regexp_extract("url", at, 1), (F.col("n0") + F.col("no")).cast("string"), F.regexp_extract("url", at, 3)))
    known = titles.groupBy(url_fingerprint(F.col("url")).alias("fp")).agg(F.min("title").alias("found"))
    j = p.withColumn("fp", url_fingerprint(F.col("made"))).join(known, "fp")
    title = F.when(F.col("found").rlike(CHAPTER_LABEL), F.col("found")).otherwise(F.concat(F.lit("第"), F.col("n0") + F.col("no"), F.lit("章")))
    return j.select("page_id", "no", title.alias("title"), F.col("made").alias("url"))


def neighbour_toc(pages: DataFrame, navigation: DataFrame, extracts: DataFrame, cap: int = 7) -> DataFrame:
    """(page_id, no, title, url) of a page, what navigation and its number lead to, once each, where a text was extracted.

    `extracts` is (url, title), one row for each page that gave a text.
    """
    j = pages.select("page_id", "url").join(navigation.select("page_id", "next_url", "prev_url"), "page_id", "left")
    urls = F.array("prev_url", "url", "next_url", counted_url(F.col("url"), -1), counted_url(F.col("url"), 1))
    e = j.select("page_id", F.posexplode(F.filter(urls, lambda u: u.isNotNull() & (u != ""))).alias("no", "url"))
    once = first_by_fingerprint(e, ["page_id"], "url", "no")
    known = extracts.groupBy(url_fingerprint(F.col("url")).alias("fp")).agg(F.min("title").alias("title"))
    kept = once.join(known, "fp")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("no"))).where(F.col("rank") <= cap).select("page_id", "no", "title", "url")


def rescue_toc(entries: DataFrame, anchors: DataFrame, cap: int = 120, seen: int = 2400) -> DataFrame:
    """Entries (page_id, pos, title, url), or a page's chapter-like links where its list holds hardly any.

    Chapter-like entries displace the others. A list with fewer than two, or
    of six and more with under 0.35 of them, gives way to the page's links if these are two or more.
    """
    like = is_chapter_href(F.col("url")) | is_chapter_link_text(F.col("title"))
    e = entries.withColumn("like", F.coalesce(like, F.lit(False)))
    links = anchors.where((F.col("pos") < seen) & (F.col("text") != "") & (F.col("abs_url") != "")).select("page_id", "pos", F.col("text").alias("title"), F.col("abs_url").alias("url"))
    found = first_by_fingerprint(links.where(like), ["page_id"], "url", "pos").drop("fp")
    found = found.withColumn("no", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where(F.col("no") <= cap).drop("no")
    mine = e.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if("like").alias("n_like"))
    other = found.groupBy("page_id").agg(F.count("*").alias("n_found"))
    sizes = mine.join(other, "page_id", "full").na.fill(0)
    poor = (F.col("n_like") < 2) | ((F.col("n") >= 6) & (F.col("n_like") / F.col("n") < 0.35))
    sizes = sizes.select("page_id", "n_like", (poor & (F.col("n_found") >= 2)).alias("rescued"))
    own = e.join(sizes, "page_id").where(~F.col("rescued") & (F.col("like") | (F.col("n_like") == 0))).select("page_id", "pos", "title", "url")
    return own.unionByName(found.join(sizes.where("rescued"), "page_id", "left_semi").select("page_id", "pos", "title", "url"))


def book_facts(html: Column, url: Column, title: Column) -> Column:
    """struct(title, intro, url): heading, else og title, else the page's; og or meta description; the address without its fragment."""
    heading = F.nullif(normalize_text(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1), "<[^>]+>", "")), F.lit(""))
    return F.struct(F.coalesce(heading, _meta(html, "og:title"), title).alias("title"), F.coalesce(_meta(html, "og:description", "description"), F.lit("")).alias("intro"), F.regexp_replace(url, "#.*$", "").alias("url"))
