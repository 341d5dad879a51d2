"""The nesting of a page, by one fold over its tokens with a stack of open blocks.

All of it is array work in a page's own row: no token is shuffled, and rows
that share a page_id stay apart. The fold carries running sums; what a block
holds is the difference of those at its two ends, and which links it holds is
a range of their numbers, so nothing is searched for in an interval.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .html import TOKEN, unescape, visible

# Tags that make blocks, marks of regions without text, and what ends a sentence.
CONTAINERS = ("article", "main", "section", "div", "ul", "ol", "table", "nav", "footer", "aside", "header", "form", "button", "select", "textarea", "noscript", "iframe")
NOISE_TAGS = ("nav", "aside", "footer", "form", "button", "select", "textarea", "noscript", "iframe")
NOISE_ROLE = r"""(?i)\brole=["']?(navigation|complementary)"""
NOISE_CLASS = r"""(?i)\bclass=["']([^"']*\s)?(advertisement|ads|share|related|comment|comments)(\s[^"']*)?["']"""
NOISE_PART = r"""(?i)\b(class|id)=["'][^"']*(toolbar|header|footer|menu|nav|setting)"""
NOISE_CLASS_PART = r"""(?i)\bclass=["'][^"']*(reader-tools|read-tool|bookrack|bookshelf)"""
SENTENCE = "[。！？.!?]"

OTHER, TEXT, OPEN, CLOSE, LINK, LINK_END, PARAGRAPH = range(7)
SUMS = ("text", "link", "p", "dots", "n")
_SUMS = ",".join(f"{s}:int" for s in SUMS)
_OPEN = f"struct<start:int,tag:string,raw:string,mark:int,{_SUMS}>"
_BLOCK = f"struct<start:int,end:int,tag:string,raw:string,{_SUMS},first:int>"
_LINK = "struct<at:int,href:string,text:string,tables:int>"
_STATE = "struct<level:int,noise:boolean>"
OUTPUTS = ("states", "blocks", "links")


def is_noise_tag(tag: Column, raw: Column) -> Column:
    """Whether an opening tag begins a region without text."""
    return tag.isin(*NOISE_TAGS) | raw.rlike(NOISE_ROLE) | raw.rlike(NOISE_CLASS) | raw.rlike(NOISE_PART) | raw.rlike(NOISE_CLASS_PART)


def fold(items: Column, zero: Column, step: Callable[[Column, Column], Column], fields: tuple[str, ...], outputs: tuple[str, ...]) -> Column:
    """The state after the last item. `outputs` are arrays that steps append to.

    An append copies the array, so items are taken in chunks of about the root
    of their number, whose outputs are joined: a long page costs the power 1.5
    of its tokens and not their square.
    """
    width = F.greatest(F.lit(16), F.floor(F.sqrt(F.size(items))).cast("int"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / width).cast("int")), lambda j: F.slice(items, j * width + 1, width))

    def whole(acc: Column, chunk: Column) -> Column:
        begun = F.struct(*[(F.slice(acc[f], 1, 0) if f in outputs else acc[f]).alias(f) for f in fields])
        ended = F.aggregate(chunk, begun, step)
        return F.get(F.transform(F.array(ended), lambda r: F.struct(*[(F.concat(acc[f], r[f]) if f in outputs else r[f]).alias(f) for f in fields])), F.lit(0))

    return F.aggregate(chunks, zero, whole)


def _tokens(pages: DataFrame, *carried: str) -> DataFrame:
    raws = pages.select("page_id", *carried, F.regexp_extract_all(visible(F.col("html")), F.lit(TOKEN), F.lit(0)).alias("raws"))
    kind = lambda x: F.when(x.startswith("</"), "close").when(x.startswith("<"), "open").otherwise("text")
    tag = lambda x: F.lower(F.regexp_extract(x, r"^</?([A-Za-z0-9]+)", 1))
    named = F.transform("raws", lambda x, i: F.struct(i.alias("pos"), kind(x).alias("kind"), F.when(x.startswith("<"), tag(x)).otherwise("").alias("tag"), x.alias("raw")))

    def coded(x: Column) -> Column:
        opens, closes = x["kind"] == "open", x["kind"] == "close"
        block = x["tag"].isin(*CONTAINERS)
        code = F.when(x["kind"] == "text", TEXT).when(opens & block, OPEN).when(closes & block, CLOSE).when(opens & (x["tag"] == "a"), LINK).when(closes & (x["tag"] == "a"), LINK_END).when(opens & (x["tag"] == "p"), PARAGRAPH).otherwise(OTHER)
        plain = F.when(x["kind"] == "text", unescape(x["raw"])).otherwise("")
        return F.struct(*[x[c].alias(c) for c in ("pos", "kind", "tag", "raw")], code.alias("code"), plain.alias("plain"))

    def measured(x: Column) -> Column:
        text = F.when(x["code"] == TEXT, F.trim(F.regexp_replace(x["plain"], r"[\s ]+", " "))).otherwise("")
        mark = F.when(x["code"] == OPEN, is_noise_tag(x["tag"], x["raw"]).cast("int")).otherwise(0)
        href = F.when(x["code"] == LINK, F.regexp_extract(x["raw"], r"""(?is)\bhref=["']?([^"'\s>]*)""", 1)).otherwise("")
        return F.struct(*[x[c].alias(c) for c in ("pos", "kind", "tag", "raw", "code", "plain")], text.alias("text"), mark.alias("mark"), href.alias("href"))

    return raws.select("page_id", *carried, F.transform(F.transform(named, coded), measured).alias("tokens"))


FIELDS = ("stack", "noise", "tables", *SUMS, "open", *OUTPUTS)


def _zero() -> Column:
    empty = {"stack": _OPEN, "open": _LINK, "states": _STATE, "blocks": _BLOCK, "links": _LINK}
    return F.struct(*[(F.array().cast(f"array<{empty[f]}>") if f in empty else F.lit(0)).alias(f) for f in FIELDS])


def _step(acc: Column, x: Column) -> Column:
    def to(level: Column | None = None, noise: Column | None = None, **changes: Column) -> Column:
        noise = acc["noise"] if noise is None else noise
        state = F.struct((F.lit(None).cast("int") if level is None else level).alias("level"), (noise > 0).alias("noise"))
        changes |= {"noise": noise, "states": F.array_append(acc["states"], state)}
        return F.struct(*[changes.get(f, acc[f]).alias(f) for f in FIELDS])

    linked = F.size(acc["open"]) > 0
    link, n = F.get(acc["open"], F.lit(0)), F.length(x["text"])
    told = F.when(linked & (link["href"] != ""), F.array_append(acc["links"], link)).otherwise(acc["links"])
    longer = F.array(F.struct(link["at"].alias("at"), link["href"].alias("href"), F.concat(link["text"], x["plain"]).alias("text"), link["tables"].alias("tables")))
    depth, top = F.size(acc["stack"]), F.try_element_at(acc["stack"], F.lit(-1))
    opened = F.struct(x["pos"].alias("start"), x["tag"].alias("tag"), x["raw"].alias("raw"), x["mark"].alias("mark"), *[acc[s].alias(s) for s in SUMS])
    begun = F.array(F.struct(x["pos"].alias("at"), x["href"].alias("href"), F.lit("").alias("text"), acc["tables"].alias("tables")))
    return (
        F.when(x["code"] == TEXT, to(text=acc["text"] + n, link=acc["link"] + F.when(linked, n).otherwise(0), dots=acc["dots"] + F.regexp_count(x["text"], F.lit(SENTENCE)), open=F.when(linked, longer).otherwise(acc["open"])))
        .when(x["code"] == OTHER, to())
        .when(x["code"] == PARAGRAPH, to(p=acc["p"] + 1))
        .when(x["code"] == LINK, to(links=told, open=begun, n=acc["n"] + (x["href"] != "").cast("int")))
        .when(x["code"] == LINK_END, to(links=told, open=F.slice(acc["open"], 1, 0)))
        .when(x["code"] == OPEN, to(depth + 1, acc["noise"] + x["mark"], stack=F.array_append(acc["stack"], opened), tables=acc["tables"] + (x["tag"] == "table").cast("int")))
        .when(depth == 0, to(F.lit(0)))
        .otherwise(to(depth, acc["noise"] - top["mark"], stack=F.slice(acc["stack"], 1, depth - 1), tables=acc["tables"] - (top["tag"] == "table").cast("int"), blocks=F.array_append(acc["blocks"], _closed(top, x["pos"], acc))))
    )


def _closed(b: Column, end: Column, acc: Column) -> Column:
    return F.struct(b["start"].alias("start"), end.cast("int").alias("end"), b["tag"].alias("tag"), b["raw"].alias("raw"), *[(acc[s] - b[s]).alias(s) for s in SUMS], b["n"].alias("first"))


def nested(pages: DataFrame, *carried: str) -> DataFrame:
    """One row a page: page_id, columns to carry along, tokens, states, blocks, links.

    tokens: (pos, kind, tag, raw, code, plain, text, mark, href); text is the
    text of a text token with its blanks squeezed, empty for tags. states: of
    each token its level (of block tags; 0 for an end tag that closes nothing)
    and whether noise covers it. blocks: (start, end, tag, raw, sums of what
    it holds: text, text in links, paragraphs, sentences, n links; first: the
    number of links before it), by their starts; one that is never closed has a
    null end and reaches to the end of the page. links: (at, href, text,
    tables around it) of links with an address, in order; a link ends at its
    end tag, the next link or the end of the page. A null page is empty.
    """
    # inline: as a struct the fold would be worked out anew for each of its fields that is read
    t = _tokens(pages, *carried).select("page_id", *carried, "tokens", F.inline(F.array(fold(F.col("tokens"), _zero(), _step, FIELDS, OUTPUTS))))
    last = F.get("open", F.lit(0))
    links = F.when((F.size("open") > 0) & (last["href"] != ""), F.array_append("links", last)).otherwise(F.col("links"))
    totals = {s: F.col(s) for s in SUMS}
    rest = F.transform("stack", lambda b: _closed(b, F.lit(None), totals))
    return t.select("page_id", *carried, "tokens", "states", F.array_sort(F.concat("blocks", rest)).alias("blocks"), links.alias("links"))


def links_of(block: Column, links: Column) -> Column:
    """The links that a block holds."""
    return F.slice(links, block["first"] + 1, block["n"])
