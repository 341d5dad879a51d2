"""Text files and archives as rows: charset repair, formats, and chapters of packaged books."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import normalize_text
from ..operators.html import unescape
from .storage import bounded_batches

# Signs of a wrong decoding, what cleaning removes or replaces, and words of pages before the text.
MOJIBAKE = ("锟", "銆", "嚙", "�", "Ã", "Â")
REMOVED = ("锟斤拷", "嚙", "銆")
REPLACED = (("Ã€", "€"), ("Â", ""))
FRONT_WORD = r"\b(cover|toc|nav|contents?)\b"
FRONT_ID = r"\b(cover|toc|nav|contents)\b"
FRONT_TITLE = r"^(cover|table\s+of\s+contents|contents?|目录|封面|扉页)$"
FRONT_TEXT = r"(table\s+of\s+contents|目录|contents?)"
NCX = "application/x-dtbncx+xml"


def scan_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, content) of whole files; the title is the name without .txt. Spark's reader leaves out files without bytes."""
    f = spark.read.format("binaryFile").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.txt$", "")
    return f.select("path", F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("未命名")).alias("title"), "content")


def source_format(path: Column) -> Column:
    """struct(format, error) by the ending of a name."""
    p = F.lower(F.coalesce(path, F.lit("")))
    kind = F.when(p.endswith(".txt"), "txt").when(p.endswith(".epub"), "epub")
    return F.struct(kind.alias("format"), F.when(kind.isNull(), "UNSUPPORTED_FORMAT").alias("error"))


CHUNK = 1 << 20
"""Bytes of a file that are decoded at once."""
_MEASURES = "array<struct<method:string,is_view:boolean,n:long,han:long,bad:long>>"


def _codecs(refine: bool) -> tuple[list[str], list[tuple[str, str]]]:
    """Codecs of the bytes, and names and codecs of views: text that was read as Latin-1 before it was written as UTF-8."""
    views = [("latin1->gbk", "gbk"), ("latin1->gb18030", "gb18030"), ("windows-1252->gbk", "gbk"), ("windows-1252->gb18030", "gb18030")]
    return ["utf-8", "gb18030", "gbk"] + (["big5"] if refine else []), views + ([("gbk->utf8", "utf-8"), ("big5->utf8", "big5")] if refine else [])


def _pieces(b: bytes, codec: str, is_view: bool) -> Iterator[str]:
    """The text of a file, chunk by chunk, by an incremental decoder that carries what a chunk cuts in two."""
    of = lambda name: codecs.getincrementaldecoder("utf-8-sig" if name == "utf-8" and not is_view else name)("replace")
    first, second = codecs.getincrementaldecoder("utf-8-sig")("replace") if is_view else None, of(codec)
    for lo in range(0, max(1, len(b)), CHUNK):
        chunk, last = b[lo : lo + CHUNK], lo + CHUNK >= len(b)
        yield second.decode(first.decode(chunk, last).encode("latin1", "replace") if is_view else chunk, last)


def _methods(refine: bool) -> list[tuple[str, str, bool]]:
    direct, views = _codecs(refine)
    return [(f"direct-{c}", c, False) for c in direct] + [(f"utf8->view->{n}", c, True) for n, c in views]


def _measurer(refine: bool):
    methods, wrong = _methods(refine), [ord(c) for c in MOJIBAKE]

    @F.pandas_udf(_MEASURES)
    def measure(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(b: bytes | None) -> list:
            out = []
            for method, codec, is_view in methods:
                n = han = bad = 0
                for piece in _pieces(b or b"", codec, is_view):
                    signs = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
                    n += len(signs)
                    han += int(((signs >= 0x4E00) & (signs <= 0x9FFF)).sum())
                    bad += int(np.isin(signs, wrong).sum())
                out.append((method, is_view, n, han, bad))
            return out

        for batch in contents:
            yield batch.map(one)

    return measure


def _decoder(refine: bool):
    known = {m: (c, v) for m, c, v in _methods(refine)}

    @F.pandas_udf("text string, plain string")
    def decode(contents: pd.Series, methods: pd.Series) -> pd.DataFrame:
        whole = lambda b, m: "".join(_pieces(b or b"", *known[m]))
        texts = [whole(b, m) for b, m in zip(contents, methods)]
        return pd.DataFrame({"text": texts, "plain": [None if m == "direct-utf-8" else whole(b, "direct-utf-8") for b, m in zip(contents, methods)]})

    return decode


def _score(n: Column, han: Column, bad: Column, is_view: Column, prefer_view: Column) -> Column:
    most = F.greatest(n, F.lit(1))
    share = han / most + F.when(prefer_view & is_view, 0.002).otherwise(0.0)
    return F.struct(share.alias("a"), F.when(n == 0, -1.0).otherwise(-F.least(F.lit(0.5), bad / most * 10)).alias("b"), F.least(n / 1_000_000, F.lit(0.1)).alias("c"))


def encoding_score(text: Column, is_view: Column, prefer_view: Column) -> Column:
    """struct(share of Han characters with a bias to views, less the density of wrong signs, length)."""
    count = lambda signs: F.regexp_count(text, F.lit(f"[{signs}]"))
    return _score(F.length(text), count("一-鿿"), count("".join(MOJIBAKE)), is_view, prefer_view)


def clean_mojibake(text: Column) -> Column:
    """T2."""
    for bad in REMOVED:
        text = F.replace(text, F.lit(bad), F.lit(""))
    for a, b in REPLACED:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(text, "[ \t]{2,}", " "), "\n{3,}", "\n\n")


def encoding_label(method: Column) -> Column:
    """Null for text that needed no repair."""
    return (
        F.when(method.isNull() | method.isin("", "direct-utf-8", "none"), None).when(method.contains("gb18030"), "GB18030").when(method.contains("gbk"), "GBK")
        .when(method.contains("big5"), "Big5").when(method.startswith("utf8->view"), "自动修复乱码").otherwise("自动识别编码")
    )


def repair_charset(files: DataFrame, clean: bool = True, refine: bool = False) -> DataFrame:
    """Files with (text, method, han_ratio, n_bad, changed) in place of content, the best of several decodings.

    Scores compare part by part and UTF-8 wins ties; as the share of Han comes
    first, UTF-8 text with much punctuation can lose to its reading as GBK. A
    first pass counts the signs of each decoding, CHUNK bytes at a time, and
    keeps none of their texts; a second one decodes by the best method alone
    (and as UTF-8 too, if that is another). Only decoding runs in Python; a
    null content is an empty text. Batches for Python are bounded in bytes, so
    a worker holds a few of those, or one file that is larger.
    """
    bounded_batches(files.sparkSession)
    f = files.withColumn("found", _measurer(refine)(F.col("content")))
    prefer = F.get("found", F.lit(0))["bad"] > 0
    scored = F.transform("found", lambda c, i: F.struct(_score(c["n"], c["han"], c["bad"], c["is_view"], prefer).alias("s"), (-i).alias("i"), c["method"].alias("method")))
    f = f.withColumn("method", F.array_max(scored)["method"]).drop("found")
    f = f.withColumn("decoded", _decoder(refine)(F.col("content"), F.col("method")))
    plain = F.coalesce("decoded.plain", "decoded.text")
    text = clean_mojibake(F.col("decoded.text")) if clean else F.col("decoded.text")
    out = f.select(*[c for c in files.columns if c != "content"], text.alias("text"), "method", plain.alias("plain"))
    han = F.regexp_count("text", F.lit("[一-鿿]")) / F.greatest(F.length("text"), F.lit(1))
    return out.select("*", han.alias("han_ratio"), F.regexp_count("text", F.lit("�")).alias("n_bad"), ((F.col("method") != "direct-utf-8") & (F.col("text") != F.col("plain"))).alias("changed")).drop("plain")


def resolve_path(base: Column, href: Column) -> Column:
    """Href against the folder of base; an address with a scheme stays, an empty one is empty."""
    parts = F.split(F.concat(F.regexp_replace(F.replace(base, F.lit("\\"), F.lit("/")), "[^/]*$", ""), F.replace(href, F.lit("\\"), F.lit("/"))), "/")
    folded = F.aggregate(F.filter(parts, lambda x: ~x.isin("", ".")), F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)))
    return F.when(href == "", "").when(href.rlike("(?i)^[a-z]+:"), href).otherwise(F.array_join(folded, "/"))


def member_text(html: Column) -> Column:
    """X11: text of a member, line ends trimmed."""
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<head\b.*?</head>", ""), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]+>", "")
    return F.regexp_replace(F.regexp_replace(F.replace(unescape(body), F.lit("\r\n"), F.lit("\n")), "[ \t　 ]+(?=\n)", ""), r"^[\s　 ]+|[\s　 ]+$", "")


def member_title(html: Column) -> Column:
    """X11: the first heading or title in the page; empty if there is none."""
    return normalize_text(unescape(F.regexp_replace(F.regexp_extract(html, r"(?is)<(h1|h2|h3|title)\b[^>]*>(.*?)</\1>", 2), "<[^>]+>", "")))


def _attribute(tag: Column, name: str) -> Column:
    return F.trim(unescape(F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']""", 1)))


def is_front_matter(idref: Column, href: Column, media_type: Column, title: Column, text: Column, position: Column) -> Column:
    """A cover or contents page among the first four places."""
    t = F.lower(F.trim(text))
    hit = F.lower(idref).rlike(FRONT_ID) | F.lower(href).rlike(FRONT_WORD) | F.lower(media_type).contains(NCX) | F.lower(F.trim(title)).rlike(FRONT_TITLE) | (F.length(t).between(1, 260) & t.rlike(FRONT_TEXT))
    return (position <= 3) & hit


def flatten_archives(members: DataFrame) -> DataFrame:
    """(archive, order_index, title, content_text) of members (archive, path, text) of packaged books.

    The container names the package, whose list of items and order of reading
    meet by id; each item's text is joined by archive and path. Missing and
    empty members and front matter are left out; a chapter without a heading is
    numbered by its place among those kept. Of an id given twice the last counts.
    Texts are joined once; only the small container and package are parsed apart.
    """
    m = members.select("archive", "path", F.coalesce("text", F.lit("")).alias("text"))
    packages = m.where("path = 'META-INF/container.xml'").select("archive", F.regexp_extract("text", r"""(?is)full-path\s*=\s*["']([^"']+)""", 1).alias("path"))
    p = m.join(packages, ["archive", "path"]).select("archive", "path", "text")
    item = F.posexplode(F.regexp_extract_all("text", F.lit(r"(?is)<(?:\w+:)?item\s[^>]*>"), F.lit(0)))
    items = p.select("archive", "path", item.alias("no", "tag")).select("archive", "no", _attribute(F.col("tag"), "id").alias("idref"), resolve_path(F.col("path"), _attribute(F.col("tag"), "href")).alias("href"), _attribute(F.col("tag"), "media-type").alias("media_type"))
    items = items.where("idref <> '' and href <> ''").groupBy("archive", "idref").agg(F.max_by(F.struct("href", "media_type"), "no").alias("x")).select("archive", "idref", "x.*")
    spine = p.select("archive", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?is)<(?:\w+:)?itemref\s[^>]*>"), F.lit(0))).alias("position", "tag")).select("archive", "position", _attribute(F.col("tag"), "idref").alias("idref"))
    chapters = spine.join(items, ["archive", "idref"]).join(m.withColumnRenamed("path", "href"), ["archive", "href"])
    c = chapters.select("archive", "position", "idref", "href", "media_type", member_title(F.col("text")).alias("heading"), member_text(F.col("text")).alias("content_text"))
    c = c.where((F.col("content_text") != "") & ~is_front_matter(F.col("idref"), F.col("href"), F.col("media_type"), F.col("heading"), F.col("content_text"), F.col("position")))
    no = F.row_number().over(Window.partitionBy("archive").orderBy("position"))
    return c.withColumn("no", no).select("archive", (F.col("no") - 1).alias("order_index"), F.when(F.col("heading") == "", F.concat(F.lit("章节 "), "no")).otherwise(F.col("heading")).alias("title"), "content_text")
