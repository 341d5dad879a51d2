"""Main texts of pages: blocks of tags, the densest block without its noise, structured data, and the choice between them.

What a page's nesting tells comes from `nesting.nested`, in the page's own row;
nothing here shuffles but what site rules and tables of texts ask for. A page
without tokens gives no row here and NO_MAIN_CONTENT in `extract_pages`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import mask_json, normalize_text, unmask_json
from ..functions.urls import abs_url, url_host, url_path
from . import classify as K
from .html import link_text, link_url, page_features, unescape, visible
from .nesting import CONTAINERS, NOISE_CLASS, NOISE_CLASS_PART, NOISE_PART, NOISE_ROLE, NOISE_TAGS, SENTENCE, is_noise_tag, nested  # noqa: F401

# Blocks that may hold the text, tags that break its lines, and the fields of structured data that hold one.
TEXT_BLOCKS = ("article", "main", "section", "div")
BREAKS = ("p", "br", "div", "h1", "h2", "h3", "li", "section", "article")
FIELDS = ("articleBody", "description", "text", "headline", "name")
MIN_LENGTH = 200
MOST_ELEMENTS = 5000


def block_tokens(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, tag, raw, text, level, noise, opens, closes): the tokens of pages with their place in the nesting."""
    t = nested(pages).select("page_id", F.inline(F.arrays_zip("tokens", "states"))).select("page_id", "tokens.*", "states.*")
    is_block = F.col("tag").isin(*CONTAINERS)
    opens, closes = [(is_block & (F.col("kind") == k)).cast("int").alias(n) for k, n in (("open", "opens"), ("close", "closes"))]
    return t.select("page_id", "pos", "kind", "tag", "raw", "text", "level", "noise", opens, closes)


def block_score(b: Column) -> Column:
    """A5: of a block of `nested`: its length less its share of link text, 180 a paragraph and 80 a sentence; null for blocks that cannot hold the text.

    These are other tags than TEXT_BLOCKS, and blocks under 80 characters or
    over 0.65 of links.
    """
    density = F.try_divide(b["link"], b["text"])
    score = b["text"] * (1 - F.least(density, F.lit(0.95))) + b["p"] * 180 + b["dots"] * 80
    return F.when(b["tag"].isin(*TEXT_BLOCKS) & (b["text"] >= 80) & (density <= 0.65), score)


def blocks(pages: DataFrame) -> DataFrame:
    """A5: (page_id, pos, end, score) of the blocks that may hold the text; one that is never closed ends with the page."""
    b = nested(pages).select("page_id", (F.size("tokens") - 1).alias("last"), F.explode("blocks").alias("b"))
    return b.select("page_id", F.col("b.start").alias("pos"), F.coalesce("b.end", "last").alias("end"), block_score(F.col("b")).alias("score")).where("score is not null")


def best_text(pages: DataFrame, *carried: str) -> DataFrame:
    """(page_id, start, end, score, n_p, content) of the best block, the first if scores are equal, without noise.

    With columns to carry along, pages without such a block stay, with an empty content.
    """
    rated = lambda b: F.struct(block_score(b).alias("score"), (-b["start"]).alias("at"), b["end"].alias("end"), b["p"].alias("p"))
    best = F.array_max(F.filter(F.transform("blocks", rated), lambda r: r["score"].isNotNull()))
    t = nested(pages, *carried).select("page_id", *carried, F.arrays_zip("tokens", "states").alias("z"), best.alias("best"))
    t = t if carried else t.where("best is not null")
    end = F.coalesce("best.end", F.size("z") - 1)
    held = t.select("page_id", *carried, "best", end.alias("end"), F.slice("z", 1 - F.col("best.at"), end + F.col("best.at") + 1).alias("held"))
    piece = lambda z: F.when(z["tokens"]["kind"] == "text", z["tokens"]["text"]).when(z["tokens"]["tag"].isin(*BREAKS), "\n").otherwise("")
    parts = F.filter(F.transform("held", lambda z: F.when(z["states"]["noise"], "").otherwise(piece(z))), lambda x: x != "")
    content = normalize_text(F.regexp_replace(F.array_join(parts, " "), " *\n *", "\n"))
    return held.select("page_id", *carried, (-F.col("best.at")).alias("start"), "end", F.col("best.score").alias("score"), F.col("best.p").cast("long").alias("n_p"), content.alias("content"))


def _meta(html: Column, *names: str) -> Column:
    """The content of the first meta tag that has one of the names, in their order; null if there is none."""
    def one(name: str) -> Column:
        tag = F.regexp_extract(html, rf"""(?is)(<meta\b[^>]*\b(?:name|property)=["']{name}["'][^>]*>)""", 1)
        return F.nullif(F.trim(unescape(F.regexp_extract(tag, r"""(?is)\bcontent=["']([^"']*)["']""", 1))), F.lit(""))

    return F.coalesce(*[one(n) for n in names])


_LEVEL = "struct<path:array<int>,is_object:boolean,next:int>"
_SAID = "struct<path:array<int>,rank:int,raw:string>"


def walk_json(text: Column) -> Column:
    """The strings of FIELDS in the objects of a JSON text at any depth, as they are quoted: an object's own in the order of FIELDS, then those of the values inside it as they follow each other.

    One fold over the text's tokens with a stack of open objects and arrays,
    each known by the numbers of the values on the way to it.
    """
    tokens = F.regexp_extract_all(mask_json(text), F.lit(r'"[^"]*"|[\[\]{}:,]|[^\s"\[\]{}:,]+'), F.lit(0))
    fields = ("stack", "key", "is_value", "said")
    zero = F.struct(F.array().cast(f"array<{_LEVEL}>").alias("stack"), F.lit("").alias("key"), F.lit(False).alias("is_value"), F.array().cast(f"array<{_SAID}>").alias("said"))

    def step(acc: Column, x: Column) -> Column:
        depth, top = F.size(acc["stack"]), F.try_element_at(acc["stack"], F.lit(-1))
        to = lambda **new: F.struct(*[new.get(f, acc[f]).alias(f) for f in fields])
        level = lambda path, is_object, n: F.struct(path.alias("path"), is_object.alias("is_object"), n.cast("int").alias("next"))
        below = F.when(depth == 0, F.array(F.lit(0))).otherwise(F.array_append(top["path"], top["next"]))
        counted = F.when(depth == 0, acc["stack"]).otherwise(F.array_append(F.slice(acc["stack"], 1, F.greatest(depth - 1, F.lit(0))), level(top["path"], top["is_object"], top["next"] + 1)))
        named = F.coalesce(top["is_object"], F.lit(False))
        rank = F.array_position(F.array(*[F.lit(f'"{f}"') for f in FIELDS]), acc["key"])
        taken = F.array_append(acc["said"], F.struct(top["path"].alias("path"), rank.cast("int").alias("rank"), x.alias("raw")))
        return (
            F.when(x.startswith('"'), F.when(named & ~acc["is_value"], to(key=x)).when(named & (rank > 0), to(said=taken)).otherwise(acc))
            .when(x.isin("{", "["), to(stack=F.array_append(counted, level(below, x == "{", F.lit(0))), is_value=F.lit(False)))
            .when(x.isin("}", "]"), to(stack=F.slice(acc["stack"], 1, F.greatest(depth - 1, F.lit(0)))))
            .when(x == ":", to(is_value=F.lit(True)))
            .when(x == ",", to(is_value=F.lit(False)))
            .otherwise(acc)
        )

    return F.aggregate(tokens, zero, step, lambda acc: F.transform(F.array_sort(acc["said"]), lambda s: unmask_json(s["raw"])))


def structured_text(html: Column, skip_description: Column | None = None) -> Column:
    """The long strings of the preferred fields of JSON-LD at any depth, then the description; empty if there is none.

    Strings in arrays are no field's. Blocks that are no JSON are left out.
    `skip_description` drops the description of pages without such strings.
    """
    raw = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script"""), F.lit(1))
    good = F.filter(raw, lambda x: x.rlike('"(' + "|".join(FIELDS) + ')"') & F.try_parse_json(x).isNotNull())
    quoted = F.flatten(F.transform(good, walk_json))
    said = F.filter(F.transform(quoted, lambda x: normalize_text(F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>"), F.lit(0)))), lambda x: F.length(x) >= 30)
    about = F.coalesce(_meta(html, "og:description", "description", "twitter:description"), F.lit(""))
    if skip_description is not None:
        about = F.when(skip_description & (F.size(said) == 0), "").otherwise(about)
    return normalize_text(F.array_join(F.filter(F.concat(said, F.array(about)), lambda x: x != ""), "\n\n"))


def structured_title(html: Column, title: Column) -> Column:
    """Og or twitter title, else the page's."""
    return F.coalesce(_meta(html, "og:title", "twitter:title"), title)


def candidate_score(text: Column, n_p: Column, is_directory: Column, least: Column | int = MIN_LENGTH) -> Column:
    """Length, paragraphs and sentences less URLs and short lines; -1 for a short text."""
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
    share = lambda x: F.when(F.size(x) == 0, 1.0).otherwise(F.size(F.filter(x, lambda y: F.length(y) < 12)) / F.size(x))
    short = F.get(F.transform(F.array(lines), share), F.lit(0))  # bound, so that lines are cut once
    urls = F.least(F.lit(1.0), F.regexp_count(text, F.lit(r"(?i)https?://|www\.")) / 22)
    base = F.log10(F.length(text) + 10.0) * 100 + F.least(n_p, F.lit(50)) * 2.5 + F.least(F.regexp_count(text, F.lit(SENTENCE)), F.lit(120)) * 1.2
    score = base * (1 - F.least(F.lit(0.55), urls * 0.85 + short * 0.35))
    return F.when(F.length(text) < least, -1.0).otherwise(F.when(is_directory, score * 0.35).otherwise(score))


def least_length(body: Column, least: int = MIN_LENGTH) -> Column:
    """A page that states its number of words may be shorter than `least`."""
    n = F.regexp_extract(body, r"(?:本章字数|字数)\s*[:：]?\s*(\d{1,6})", 1).try_cast("int")
    return F.when(n > 0, F.least(F.lit(least), F.greatest(F.lit(60), F.floor(n * 0.95 + 0.5)))).otherwise(least).cast("int")


def frames_elsewhere(html: Column, url: Column) -> Column:
    """Whether a page has a frame from another host."""
    sources = F.regexp_extract_all(html, F.lit(r"""(?is)<iframe\b[^>]*\bsrc=["']?([^"'\s>]+)"""), F.lit(1))
    return F.exists(sources, lambda s: (abs_url(url, s) != "") & (url_host(abs_url(url, s)) != url_host(url)))


def has_foreign_iframe(html: Column, url: Column, text_len: Column, least: Column | int = MIN_LENGTH) -> Column:
    """a short text on a page with a frame from another host."""
    return F.coalesce((text_len < least) & frames_elsewhere(html, url), F.lit(False))


def validation_status(text: Column, is_directory: Column, has_next_page: Column, is_foreign: Column) -> Column:
    """F16: the first rule that a chosen text breaks, else OK."""
    return F.when(is_directory, "TOC_PAGE_SUSPECT").when(has_next_page, "PAGINATION_DETECTED").when(K.is_font_obfuscated(text), "FONT_OBFUSCATED").when(is_foreign, "IFRAME_CROSS_ORIGIN").otherwise("OK")


def element_count(html: Column) -> Column:
    """The elements of a page's body: its opening tags, scripts and styles as one each."""
    body = lambda x: F.regexp_replace(x, r"(?is)^.*?<body\b[^>]*>", "")
    return F.regexp_count(body(visible(html)), F.lit("<[A-Za-z]")) + F.regexp_count(body(F.coalesce(html, F.lit(""))), F.lit(r"(?i)<(script|style)\b"))


def extract_pages(pages: DataFrame, least: int = MIN_LENGTH, rules: DataFrame | None = None, most_elements: int = MOST_ELEMENTS) -> DataFrame:
    """(page_id, status, strategy, title, content, score), one row a page.

    A blocked page keeps its status; one of more than `most_elements` elements
    is DOM_TOO_LARGE and has no text. Else the strategies with a score are tried
    from the best, equal ones in the order heuristic, structured; the first that is valid is
    taken, or the best with what it breaks. Without any: NO_MAIN_CONTENT.
    rules, as of `match_rules`, clean both candidates before they are scored.

    What a page as a whole tells and its best text are worked out in its row in
    one scan; only rules ask for a join.
    """
    texts = best_text(pages, "url", "html").select("page_id", "url", "html", "content", F.col("n_p").alias("best_p"))
    f = page_features(texts, "content", "best_p")
    on = F.exists("links", lambda x: K.is_next_page(link_text(x)) & (link_url(x, F.col("url")) != ""))
    j = f.select(
        "page_id", "content", "best_p", "title", structured_title(F.col("html"), F.col("title")).alias("other_title"), structured_text(F.col("html")).alias("other"),
        K.is_directory_page(*(F.col(c) for c in ("n_anchors", "link_len", "text_len", "n_p"))).alias("is_directory"), least_length(F.col("body"), least).alias("least"),
        K.status_of(*(F.col(c) for c in ("html", "title", "body", "paragraphs"))).alias("access"), F.coalesce(on, F.lit(False)).alias("has_next_page"),
        F.coalesce(frames_elsewhere(F.col("html"), F.col("url")), F.lit(False)).alias("elsewhere"), (element_count(F.col("html")) > most_elements).alias("too_large"),
    )
    if rules is not None:
        j = _ruled(j, match_rules(pages, rules), "content", "other")
    other = F.col("other")

    def strategy(name: str, rank: int, title: Column, text: Column, n_p: Column) -> Column:
        score = candidate_score(text, n_p, F.col("is_directory"), F.col("least"))
        status = validation_status(text, F.col("is_directory"), F.col("has_next_page"), F.col("elsewhere") & (F.length(text) < F.col("least")))
        return F.struct((status == "OK").alias("valid"), score.alias("score"), F.lit(-rank).alias("rank"), F.lit(name).alias("strategy"), status.alias("status"), title.alias("title"), text.alias("content"))

    both = F.array(
        strategy("heuristic", 0, F.col("title"), F.coalesce(F.col("content"), F.lit("")), F.coalesce(F.col("best_p"), F.lit(0))),
        strategy("structured", 1, F.col("other_title"), other, F.size(F.split(other, "\n+"))),
    )
    chosen = F.array_max(F.filter(both, lambda s: s["score"] >= 0))
    access = F.when((F.col("access") == "OK") & F.col("too_large"), "DOM_TOO_LARGE").otherwise(F.col("access"))
    j = j.select("page_id", access.alias("access"), chosen.alias("chosen"))
    blocked = F.col("access") != "OK"
    status = F.when(blocked, F.col("access")).otherwise(F.coalesce("chosen.status", F.lit("NO_MAIN_CONTENT")))
    return j.select("page_id", status.alias("status"), *[F.when(~blocked, F.col(f"chosen.{c}")).alias(c) for c in ("strategy", "title", "content", "score")])


def region_text(html: Column, least: int = 20) -> Column:
    """Text of a chosen part of a page without forms and navigation; null under `least` characters."""
    cut = html
    for tag in NOISE_TAGS:
        cut = F.regexp_replace(cut, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    text = normalize_text(unescape(F.regexp_replace(F.regexp_replace(cut, r"(?is)<(script|style)\b.*?</\1\s*>", ""), "<[^>]+>", " ")))
    return F.when(F.length(text) >= least, text)


def host_suffixes(url: Column) -> Column:
    """A host and what follows each of its dots."""
    parts = F.split(url_host(url), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, rule columns) of every rule whose host suffix and path pattern fit.

    Each host is spread into its few suffixes, so the join is by equality and
    needs no broadcast of the rules. A rule of null pattern fits every path.
    """
    p = pages.select("page_id", url_path(F.col("url")).alias("path_"), F.explode(host_suffixes(F.col("url"))).alias("host_suffix"))
    return p.join(rules, "host_suffix").where("path_regex is null or path_ rlike path_regex").drop("path_")


def apply_rules(texts: DataFrame, matched: DataFrame) -> DataFrame:
    """(page_id, content) cleaned by the rules of its page in their order.

    A rule drops lines that match, then phrases, cuts before a heading at
    1..799 and from a footer on. Null parts of a rule do nothing. The rules of a
    page are few, they travel as one array.
    """
    return _ruled(texts.select("page_id", "content"), matched, "content")


def _ruled(texts: DataFrame, matched: DataFrame, *columns: str) -> DataFrame:
    """texts with some columns cleaned as `apply_rules` does."""
    rule = F.struct("rule_order", "drop_line_regex", "drop_phrases", "heading_regex", "footer_regex")
    r = matched.groupBy("page_id").agg(F.array_sort(F.collect_list(rule)).alias("rules"))

    def clean(text: Column, x: Column) -> Column:
        lines = F.array_join(F.filter(F.split(text, "\n"), lambda s: ~F.coalesce(F.rlike(F.trim(s), x["drop_line_regex"]), F.lit(False))), "\n")
        out = F.aggregate(F.coalesce(x["drop_phrases"], F.array().cast("array<string>")), lines, lambda acc, p: F.replace(acc, p, F.lit("")))
        head = F.length(F.regexp_substr(out, F.concat(F.lit(r"(?s)^.*?(?="), x["heading_regex"], F.lit(")"))))
        out = F.when((head > 0) & (head < 800), F.substring(out, head + 1, F.length(out))).otherwise(out)
        return F.coalesce(F.regexp_replace(out, F.concat(F.lit("(?s)(?:"), x["footer_regex"], F.lit(").*$")), F.lit("")), out)

    out = lambda c: F.when(F.col("rules").isNull(), F.col(c)).otherwise(normalize_text(F.aggregate(F.col("rules"), F.col(c), clean))).alias(c)
    return texts.join(r, "page_id", "left").select(*[out(c) if c in columns else c for c in texts.columns])
