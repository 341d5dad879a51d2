"""The library: books, items (chapters), groups and progress as tables. Errors are rows, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .trees import group_closure, group_tree, tree_order  # noqa: F401


def latest_progress(feed: DataFrame) -> DataFrame:
    """The last row of each book; rows arrive in the order of (updated_at, item_id). max combines on the map side, so a hot book is no hot task."""
    row = F.struct("updated_at", "item_id", "line_index")
    return feed.groupBy("book_id").agg(F.max(row).alias("r")).select("book_id", "r.item_id", "r.line_index", "r.updated_at")


def list_books(books: DataFrame, progress: DataFrame) -> DataFrame:
    """Books with their progress, if any."""
    p = progress.select(F.col("book_id").alias("id"), "item_id", "line_index", F.col("updated_at").alias("read_at"))
    return books.join(p, "id", "left")


def shelf_filter(shelf: DataFrame, source_type: str | None = None, group_id: str | None = None, q: str = "") -> DataFrame:
    """tab, group, and text anywhere in title and group, without regard to case."""
    out = shelf.where(F.col("source_type") == source_type) if source_type else shelf
    out = out.where(F.col("group_id") == group_id) if group_id else out
    q = q.strip().lower()
    return out.where(F.contains(F.lower(F.concat_ws(" ", "title", "group_id")), F.lit(q))) if q else out


def search_books(books: DataFrame, q: str) -> DataFrame:
    """LIKE %q% without regard to case; % and _ in q keep their meaning; an empty q finds all."""
    return books.where(F.col("title").ilike(f"%{q.strip()}%")) if q.strip() else books


def item_counts(items: DataFrame) -> DataFrame:
    """A1."""
    return items.groupBy("book_id").agg(F.count("*").alias("n"))


def book_detail(books: DataFrame, items: DataFrame, progress: DataFrame | None = None) -> DataFrame:
    """Each book with its items in order, as one text of order and title; a book without items has none. progress, if given, adds where it was left."""
    own = items.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("order_index", "title"))).alias("s"))
    listed = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["order_index"].cast("string"), x["title"])), ",")
    own = own.select(F.col("book_id").alias("id"), listed.alias("items"), F.size("s").cast("long").alias("n_items"))
    detail = books.join(own, "id", "left").na.fill({"items": "", "n_items": 0})
    return list_books(detail, progress) if progress is not None else detail


def items_with_book(items: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items of a known book, orphans)."""
    b = books.select(F.col("id").alias("book_id"), F.col("title").alias("book_title"))
    return items.join(b, "book_id"), items.join(b, "book_id", "left_anti")


def resume_points(items: DataFrame, progress: DataFrame) -> DataFrame:
    """Where to go on: the item of the progress row if it is the book's, else the first; the line within the item's lines (M3)."""
    p = progress.select("book_id", F.col("item_id").alias("at"), "line_index")
    lines = items.withColumn("n_lines", F.size(F.split("content_text", "\n", -1)))
    j = lines.join(p, "book_id", "left").groupBy("book_id").agg(
        F.min(F.struct("order_index", "n_lines")).alias("first"),
        F.min(F.when(F.col("order_index") == F.col("at"), F.struct("order_index", "n_lines"))).alias("hit"), F.first("line_index").alias("line"),
    )
    chosen = F.coalesce("hit", "first")
    line = F.when(F.col("hit").isNotNull(), clamp_line(F.col("line"), chosen["n_lines"])).otherwise(0)
    return j.select("book_id", chosen["order_index"].alias("item_id"), line.cast("int").alias("line_index"))


def clamp_line(index: Column, n_lines: Column) -> Column:
    """M3."""
    return F.greatest(F.lit(0), F.least(F.floor(F.coalesce(index, F.lit(0))), n_lines - 1)).cast("int")


def validate_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad with error_code) by the limits on title and content, and by a book's number of items."""
    n = F.count("*").over(Window.partitionBy("book_id"))
    code = (
        F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "EMPTY_TITLE").when(F.length("title") > 200, "TITLE_TOO_LONG")
        .when(F.length("content_text") > 1_000_000, "CONTENT_TOO_LONG").when(n > 500, "TOO_MANY_ITEMS")
    )
    marked = items.withColumn("error_code", code)
    return marked.where("error_code is null").drop("error_code"), marked.where("error_code is not null")


def missing_items(items: DataFrame) -> DataFrame:
    """items without content."""
    return items.where(F.trim(F.coalesce("content_text", F.lit(""))) == "")


def reindex(items: DataFrame, order: list[str]) -> DataFrame:
    """order_index without gaps from 0."""
    return items.withColumn("order_index", (F.row_number().over(Window.partitionBy("book_id").orderBy(*order)) - 1).cast("int"))


def append_items(items: DataFrame, new: DataFrame, books: DataFrame) -> DataFrame:
    """New items take the places from the book's item count on; those of a file book get an error instead."""
    kind = books.select(F.col("id").alias("book_id"), "source_type")
    placed = new.join(item_counts(items), "book_id", "left").join(kind, "book_id", "left")
    no = F.row_number().over(Window.partitionBy("book_id").orderBy("item_id")) - 1
    bad = F.col("source_type") == "file"
    return placed.select(
        "book_id", "item_id", F.when(~F.coalesce(bad, F.lit(False)), F.coalesce("n", F.lit(0)) + no).cast("long").alias("order_index"),
        F.when(bad, "FILE_BOOK").alias("error"),
    )


def delete_books(books: DataFrame, items: DataFrame, progress: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the books in gone(id)."""
    ids = gone.select(F.col("id").alias("book_id"))
    return books.join(gone, "id", "left_anti"), items.join(ids, "book_id", "left_anti"), progress.join(ids, "book_id", "left_anti")


def next_group_index(groups: DataFrame) -> DataFrame:
    """A2: the next free order_index under each parent, the root (null) among them."""
    return groups.groupBy("parent_id").agg((F.max("order_index") + 1).cast("long").alias("next_index"))


def check_groups(moves: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moves to a known group or to none, the others)."""
    ids = groups.select(F.col("id").alias("group_id"))
    known = moves.join(ids, "group_id", "left_semi").unionByName(moves.where("group_id is null"))
    return known, moves.where("group_id is not null").join(ids, "group_id", "left_anti")


def delete_group(books: DataFrame, groups: DataFrame, group_id: str, keep_books: bool) -> tuple[DataFrame, DataFrame]:
    """H3: (books, groups) without the group and all below it; its books lose their group or go."""
    gone = group_closure(groups, groups.where(F.col("id") == group_id)).select("id")
    left = groups.join(gone, "id", "left_anti")
    ids = gone.select(F.col("id").alias("group_id"))
    if not keep_books:
        return books.join(ids, "group_id", "left_anti"), left
    marked = books.join(ids.withColumn("hit", F.lit(True)), "group_id", "left")
    return marked.withColumn("group_id", F.when(F.col("hit").isNull(), F.col("group_id"))).drop("hit"), left


def move_books(books: DataFrame, moves: DataFrame, now: Column | None = None) -> DataFrame:
    """H4: moves(id, new_group) applied; `now`, if given, becomes the updated_at of the books moved. No moves change nothing."""
    j = books.join(moves.withColumn("moved", F.lit(True)), "id", "left")
    j = j.withColumn("group_id", F.when(F.col("moved"), F.col("new_group")).otherwise(F.col("group_id")))
    if now is not None:
        j = j.withColumn("updated_at", F.when(F.col("moved"), now).otherwise(F.col("updated_at")))
    return j.drop("moved", "new_group")


def rename(entities: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """H5: (entities with new titles, renames of ids that are not there)."""
    updated = entities.join(renames, "id", "left").withColumn("title", F.coalesce("new_title", "title")).drop("new_title")
    return updated, renames.join(entities, "id", "left_anti")


def list_groups(groups: DataFrame) -> DataFrame:
    """K3: roots first, then by parent, order, and the time changed, the newest first."""
    return groups.orderBy(F.col("parent_id").isNotNull(), "parent_id", "order_index", F.desc("updated_at"))


def order_by_recency(shelf: DataFrame) -> DataFrame:
    """K2: by the time read, or changed if it never was."""
    return shelf.orderBy(F.coalesce("read_at", "updated_at").desc_nulls_last(), "id")


def last_progress(progress: DataFrame) -> DataFrame:
    """K1: the newest row of all."""
    return progress.orderBy(F.desc("updated_at"), F.desc("item_id")).limit(1)


def chapter_page(items: DataFrame, page_no: int, page_size: int = 20) -> DataFrame:
    """K6."""
    return items.where(F.floor(F.col("order_index") / page_size) == page_no)


def cap_per_key(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """K5: the first n rows of each key."""
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn_") <= n).drop("rn_")
