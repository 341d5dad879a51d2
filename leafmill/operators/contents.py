"""Tables of contents: from a page's lists, tables and containers, over several pages, and by way of links to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import trim
from ..functions.urls import abs_url, url_fingerprint, url_host
from .html import page_title, unescape
from .links import is_chapter_href, is_chapter_link_text
from .nesting import links_of, nested
from .quality import toc_quality

# Titles of pages of contents, the containers that may hold one, and links that lead to one.
CONTENTS_TITLE = "(?i)(目录|章节|列表|catalog|toc|chapters)"
CONTAINERS = (("id", "chapterList"), ("class", "chapter-list"), ("class", "chapters"), ("class", "catalog"), ("class", "volume"), ("class", "mulu"), ("tag", "main"), ("tag", "body"))
BACK_TEXT = "(目录|书页|作品|详情|简介|返回|全部章节|章节目录)"
BACK_ADDRESS = r"(?i)/(novel|book|ebook|work|works|shu)\b|(novelid|bookid|aid=)"
MEAN_LABEL, ENOUGH, CONTAINER_ENOUGH, CONTAINER_CAP = 45, 4, 6, 120


def _attribute(raw: Column, name: str) -> Column:
    return F.regexp_extract(raw, rf"""(?is)\b{name}=["']?([^"'>]*)""", 1) if name == "class" else F.regexp_extract(raw, rf"""(?is)\b{name}=["']?([^"'\s>]*)""", 1)


def is_like_chapter(text: Column, url: Column) -> Column:
    return is_chapter_link_text(text) | is_chapter_href(url)


def least_links(html: Column) -> Column:
    """3 links make a list on a page whose title or first heading names contents, 6 on others."""
    html = F.coalesce(html, F.lit(""))
    named = F.concat_ws(" ", page_title(html), F.regexp_replace(F.regexp_extract(html, "(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", "")).rlike(CONTENTS_TITLE)
    return F.when(named, 3).otherwise(6)


def linked_pages(pages: DataFrame) -> DataFrame:
    """One row a page: page_id, least, blocks and links of `nested`, the links as (at, text, url, tables, fp, label, href_like, like).

    label and href_like: whether text and address look like a chapter's; like:
    either, of a link with both.
    """
    t = nested(pages.select("*", least_links(F.col("html")).alias("least_")), "url", "least_")
    named = F.transform("links", lambda x: F.struct(x["at"].alias("at"), trim(x["text"]).alias("text"), abs_url(F.col("url"), unescape(x["href"])).alias("url"), x["tables"].alias("tables")))

    def rated(x: Column) -> Column:
        label, href = is_chapter_link_text(x["text"]) & (x["text"] != ""), is_chapter_href(x["url"])
        return F.struct(*[x[c].alias(c) for c in ("at", "text", "url", "tables")], url_fingerprint(x["url"]).alias("fp"), label.alias("label"), href.alias("href_like"))

    whole = lambda x: F.struct(*[x[c].alias(c) for c in ("at", "text", "url", "tables", "fp", "label", "href_like")], ((x["text"] != "") & (x["url"] != "") & (x["label"] | x["href_like"])).alias("like"))
    return t.select("page_id", F.col("least_").alias("least"), "blocks", F.transform(F.transform(named, rated), whole).alias("links"))


def rated_list(block: Column, links: Column, least: Column) -> Column:
    """(quality, m, start, tag, first, n) of a <ul> or <ol>; null for other blocks and for lists with too few links or long labels.

    The quality is 3 a label and 2 an address like a chapter's, and 1 a link.
    """
    held = links_of(block, links)
    shown = F.filter(held, lambda x: x["text"] != "")
    mean = F.try_divide(F.aggregate(shown, F.lit(0), lambda n, x: n + F.length(x["text"])), F.size(shown))
    count = lambda flag: F.size(F.filter(held, lambda x: x[flag]))
    good = block["tag"].isin("ul", "ol") & (block["n"] >= least) & (F.coalesce(mean, F.lit(0.0)) <= MEAN_LABEL)
    parts = (3 * count("label") + 2 * count("href_like") + block["n"]).alias("quality"), (-block["start"]).alias("m"), *[block[c].alias(c) for c in ("start", "tag", "first", "n")]
    return F.when(good, F.struct(*parts))


def best_lists(pages: DataFrame) -> DataFrame:
    """(page_id, start, tag, quality): the list of the best quality of each page, the first if several are equal."""
    best = F.array_max(F.filter(F.transform("blocks", lambda b: rated_list(b, F.col("links"), F.col("least"))), lambda r: r.isNotNull()))
    return linked_pages(pages).select("page_id", best.alias("b")).where("b is not null").select("page_id", "b.start", "b.tag", "b.quality")


def _is_container(kind: str, value: str):
    if kind == "tag":
        return lambda b: b["tag"] == value
    if kind == "id":
        return lambda b: _attribute(b["raw"], "id") == value
    return lambda b: F.array_contains(F.split(_attribute(b["raw"], "class"), r"\s+"), value)


def _steps(kinds: int) -> Column:
    """The links that each step of the cascade gives, as (fp, step, at, text, url, like), from columns best, links and blocks."""
    def at_step(i: int):
        return lambda x: F.struct(x["fp"].alias("fp"), F.lit(i).alias("step"), *[x[c].alias(c) for c in ("at", "text", "url", "like")])

    usable = F.filter("links", lambda x: (x["text"] != "") & (x["url"] != ""))
    like = F.filter("links", lambda x: x["like"])
    listed = F.when(F.col("best").isNotNull(), F.filter(links_of(F.col("best"), F.col("links")), lambda x: (x["text"] != "") & (x["url"] != "")))
    in_table = F.filter(usable, lambda x: (x["tables"] > 0) & (F.length(x["text"]) <= 90))
    parts = [F.transform(listed, at_step(0)), F.when(F.size(in_table) >= ENOUGH, F.transform(in_table, at_step(1)))]
    for i, (kind, value) in enumerate(CONTAINERS[:-1], 2):
        root = F.get(F.filter("blocks", _is_container(kind, value)), F.lit(0))
        held = F.slice(F.filter(links_of(root, F.col("links")), lambda x: x["like"]), 1, CONTAINER_CAP)
        parts.append(F.transform(held, at_step(i)))
    parts.append(F.transform(F.slice(like, 1, CONTAINER_CAP), at_step(kinds - 1)))
    return F.concat(*[F.coalesce(p, F.slice(parts[-1], 1, 0)) for p in parts])


def _first_of_each(column: str) -> Column:
    """Of sorted structs that begin with fp the first of each fp."""
    return F.filter(F.col(column), lambda x, i: (i == 0) | (F.get(F.col(column), i - 1)["fp"] != x["fp"]))


def page_contents(pages: DataFrame) -> DataFrame:
    """(page_id, pos, title, url, source) of the contents that a page holds.

    Links come from the best list; with fewer than 4 of them, from tables that
    have 4 links at least; with fewer than 4 still, links like chapters from
    containers, one after another until there are 6. Each address counts once,
    at its first place. If some look like chapters only these stay; if fewer
    than 2 do, or under 0.35 of 6 or more, all links of the page that look like
    chapters take their place, if there are 2. The source is list, table,
    mixed, or none; a page without links gives no rows. All of it is array work
    in the row of a page; rows that share a page_id stay apart.
    """
    kinds = len(CONTAINERS) + 2
    best = F.array_max(F.filter(F.transform("blocks", lambda b: rated_list(b, F.col("links"), F.col("least"))), lambda r: r.isNotNull()))
    t = linked_pages(pages).select("page_id", "links", "blocks", best.alias("best"))
    like = F.transform(F.filter("links", lambda x: x["like"]), lambda x: F.struct(x["fp"].alias("fp"), F.lit(0).alias("step"), *[x[c].alias(c) for c in ("at", "text", "url", "like")]))
    t = t.select("page_id", F.array_sort(_steps(kinds)).alias("every"), F.array_sort(like).alias("likes"))
    t = t.select("page_id", _first_of_each("every").alias("first"), _first_of_each("likes").alias("likes"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(kinds - 1)), lambda k: F.size(F.filter("first", lambda x: x["step"] == k)))
    by_place = lambda a: F.array_sort(F.transform(a, lambda x: F.struct(*[x[c].alias(c) for c in ("step", "at", "text", "url", "like")])))
    t = t.select("page_id", by_place("first").alias("first"), F.slice(by_place("likes"), 1, CONTAINER_CAP).alias("rescued"), counts.alias("n"))
    # what the steps before have found decides whether a step is made: the table with under 4, a container with under 4 of those two and under 6 in all
    listed, tabled = F.get("n", F.lit(0)), F.get("n", F.lit(1))
    early = F.when(listed >= ENOUGH, listed).otherwise(listed + tabled)
    found = lambda k: F.aggregate(F.slice("n", 1, k), F.lit(0), lambda a, x: a + x)
    made = lambda x: (x["step"] == 0) | ((x["step"] == 1) & (F.col("listed") < ENOUGH)) | ((x["step"] > 1) & (F.col("early") < ENOUGH) & (F.get("sums", x["step"]) < CONTAINER_ENOUGH))
    t = t.select("*", listed.alias("listed"), early.alias("early"), F.transform(F.sequence(F.lit(0), F.lit(kinds - 1)), found).alias("sums"))
    t = t.select("page_id", "rescued", F.filter("first", made).alias("chosen"))
    n, n_like = F.size("chosen"), F.size(F.filter("chosen", lambda x: x["like"]))
    has = lambda k: F.exists("chosen", lambda x: x["step"] == k)
    source = F.when(has(0), F.when(has(1), "mixed").otherwise("list")).when(has(1), "table").when(n >= ENOUGH, "mixed").otherwise("none")
    rescue = (F.size("rescued") >= 2) & ((n_like < 2) | ((n >= 6) & (n_like < 0.35 * n)))
    t = t.select("page_id", "rescued", "chosen", source.alias("source"), rescue.alias("rescue"), n_like.alias("n_like"))
    kept = F.when(F.col("rescue"), F.col("rescued")).otherwise(F.filter("chosen", lambda x: x["like"] | (F.col("n_like") == 0)))
    named = F.when(F.col("rescue") & (F.col("source") == "none"), "mixed").otherwise(F.col("source"))
    rows = t.select("page_id", named.alias("source"), F.posexplode(kept).alias("pos", "x"))
    return rows.select("page_id", "pos", F.col("x.text").alias("title"), "x.url", "source")


def contents_cascade(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """(page_id, pos, title, url, source): of each page the contents (page_id, pos, title, url) of the first source that has good ones."""
    every = None
    for i, (name, rows) in enumerate(sources):
        rows = rows.select("page_id", F.col("pos").cast("long").alias("pos"), "title", "url", F.lit(i).alias("rank"), F.lit(name).alias("source"))
        every = rows if every is None else every.unionByName(rows)
    keyed = every.withColumn("list_id", F.struct("page_id", "rank"))
    good = toc_quality(keyed).where("valid").groupBy("list_id.page_id").agg(F.min("list_id.rank").alias("rank"))
    return every.join(good, ["page_id", "rank"]).drop("rank")


def contents_hops(pages: DataFrame, anchors: DataFrame, counts: DataFrame, candidates: DataFrame, max_hops: int = 4) -> DataFrame:
    """H6: (page_id, reached, hops, n): the page at which each page's search for contents ends.

    counts: (page_id, n), the chapters that a page lists; candidates: (page_id,
    toc_url). A page with fewer than 2 first goes to its candidate, then from
    there to at most `max_hops` of the first ten links on its own host that lead
    back to a book or its contents, until one lists 2 chapters; if none does,
    the last one that is there is reached. Pages that are not in the table
    cannot be followed and count for no hop.
    """
    known = pages.select(F.col("page_id").alias("to"), url_fingerprint(F.col("url")).alias("fp")).groupBy("fp").agg(F.min("to").alias("to"))
    n = pages.select("page_id").join(counts, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("n"))
    step = candidates.select("page_id", url_fingerprint(F.col("toc_url")).alias("fp")).join(known, "fp").select("page_id", "to")
    first = n.join(step, "page_id", "left").withColumn("at", F.when((F.col("n") < 2) & (F.col("to") != F.col("page_id")), F.col("to")).otherwise(F.col("page_id")))
    first = first.select("page_id", "at").join(n.select(F.col("page_id").alias("at"), F.col("n").alias("n_at")), "at")
    hosts = pages.select("page_id", url_host(F.col("url")).alias("host"))
    back = anchors.join(hosts, "page_id").where((F.col("text") != "") & (F.length("text") <= 72) & (url_host(F.col("abs_url")) == F.col("host")))
    back = back.where(F.col("text").rlike(BACK_TEXT) | F.col("abs_url").rlike(BACK_ADDRESS)).groupBy("page_id", "abs_url").agg(F.min("pos").alias("pos"))
    back = back.withColumn("rn", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where("rn <= 10")
    jumps = back.select(F.col("page_id").alias("at"), "rn", url_fingerprint(F.col("abs_url")).alias("fp")).join(known, "fp").where("to <> at")
    jumps = jumps.join(n.select(F.col("page_id").alias("to"), F.col("n").alias("n_to")), "to")
    jumps = jumps.withColumn("hop", F.row_number().over(Window.partitionBy("at").orderBy("rn"))).where(F.col("hop") <= max_hops)
    ends = jumps.groupBy("at").agg(
        F.min(F.when(F.col("n_to") >= 2, F.struct("hop", "to", "n_to"))).alias("hit"), F.max(F.struct("hop", "to", "n_to")).alias("last"),
    ).select("at", F.coalesce("hit", "last").alias("e"))
    j = first.join(ends, "at", "left")
    goes = (F.col("n_at") < 2) & F.col("e").isNotNull()
    hops = (F.col("at") != F.col("page_id")).cast("int") + F.when(goes, F.col("e.hop")).otherwise(0)
    return j.select("page_id", F.when(goes, F.col("e.to")).otherwise(F.col("at")).alias("reached"), hops.cast("int").alias("hops"), F.when(goes, F.col("e.n_to")).otherwise(F.col("n_at")).alias("n"))
