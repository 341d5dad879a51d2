"""Tables that the library is filled with: chapters, contents lists, backfilled texts; and page steps over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.urls import is_public_http_url, url_fingerprint
from ..sources.versions import publish, published  # noqa: F401


def to_library(chapters: DataFrame) -> DataFrame:
    """Chapters (doc_id, order_index, title, content_text) as items with ids and an order without gaps from 0.

    An id is a digest of the document and the place, so a second run writes the same items.
    """
    no = (F.row_number().over(Window.partitionBy("doc_id").orderBy("order_index")) - 1).cast("int")
    item = F.sha2(F.concat_ws(":", "doc_id", no), 256)
    return chapters.select(item.alias("item_id"), F.col("doc_id").alias("book_id"), no.alias("order_index"), "title", "content_text")


def book_rows(books: DataFrame, items: DataFrame) -> DataFrame:
    """Of each of books(book_id, title, source_ref) with items its row: (id, title, source_type, source_ref, n_items). A blank title becomes the reference."""
    n = items.groupBy("book_id").agg(F.count("*").alias("n_items"))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("source_ref"))
    return books.join(n, "book_id").select(F.col("book_id").alias("id"), title.alias("title"), F.lit("file").alias("source_type"), "source_ref", "n_items")


def toc_to_library(entries: DataFrame, intros: DataFrame, empty_intro: str = "-", cap: int = 500) -> DataFrame:
    """Of each book its intro at 0, then at most `cap` chapters with empty texts.

    entries: (book_id, pos, title, url); a blank title becomes "#" and the place.
    intros: (book_id, intro); a blank intro becomes `empty_intro`. Entries of
    books without an intro row are kept, from 1 on.
    """
    no = F.row_number().over(Window.partitionBy("book_id").orderBy("pos"))
    chapters = entries.withColumn("order_index", no).where(F.col("order_index") <= cap)
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("#"), "order_index"))
    chapters = chapters.select("book_id", "order_index", title.alias("title"), F.lit("").alias("content_text"), "url")
    text = F.coalesce(F.nullif(F.trim("intro"), F.lit("")), F.lit(empty_intro))
    first = intros.select("book_id", F.lit(0).alias("order_index"), F.lit("intro").alias("title"), text.alias("content_text"), F.lit(None).cast("string").alias("url"))
    return first.unionByName(chapters)


def backfill(items: DataFrame, extracts: DataFrame) -> DataFrame:
    """Items (url, content_text, ...) whose blank texts are taken from extracts (url, text) of the same fingerprint.

    Texts that are there stay; of several extracts the least text that is not blank counts.
    """
    found = extracts.select(url_fingerprint(F.col("url")).alias("fp_"), F.trim("text").alias("t")).where("t <> ''").groupBy("fp_").agg(F.min("t").alias("found_"))
    joined = items.withColumn("fp_", url_fingerprint(F.col("url"))).join(found, "fp_", "left")
    old = F.when(F.trim("content_text") != "", F.col("content_text"))
    return joined.withColumn("content_text", F.coalesce(old, "found_", "content_text")).drop("fp_", "found_")


def valid_lists(entries: DataFrame, key: str = "list_id", most: int = 500) -> DataFrame:
    """the lists of 1 to `most` entries (title, url), all with titles of 1 to 200 characters and public URLs; one bad entry rejects its list."""
    ok = F.length(F.trim("title")).between(1, 200) & is_public_http_url(F.col("url"))
    good = entries.groupBy(key).agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok"), F.count("*").alias("n")).where(F.col("ok") & (F.col("n") <= most))
    return entries.join(good.select(key), key, "left_semi")


def step_page(items: DataFrame, positions: DataFrame, delta: int, rows: int) -> DataFrame:
    """(book_id, order_index, line) after a step of `delta` display lines from each position (book_id, order_index, line).

    items: (book_id, order_index, n_lines). Before a chapter's first line lies
    the last page of `rows` lines of the chapter before, behind its last line
    the first line of the next; a book's ends hold. Each item knows its
    neighbours, so one equi-join does. Positions without an item give no row.
    """
    w = Window.partitionBy("book_id").orderBy("order_index")
    known = items.select(
        "book_id", "order_index", "n_lines", F.lag("order_index").over(w).alias("before"), F.lag("n_lines").over(w).alias("n_before"), F.lead("order_index").over(w).alias("after")
    )
    to = F.col("line") + delta
    back, on = (to < 0) & F.col("before").isNotNull(), (to >= F.col("n_lines")) & F.col("after").isNotNull()
    held: Column = F.greatest(F.lit(0), F.least(to, F.col("n_lines") - 1))
    return positions.join(known, ["book_id", "order_index"]).select(
        "book_id",
        F.when(back, F.col("before")).when(on, F.col("after")).otherwise(F.col("order_index")).alias("order_index"),
        F.when(back, F.greatest(F.lit(0), F.col("n_before") - rows)).when(on, F.lit(0)).otherwise(held).cast("long").alias("line"),
    )
