"""Reading: wrapping, pages, time, and steps through chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import raw_lines, trim


# Titles of what stands before the text.
FRONT = r"^(cover|table\s+of\s+contents|toc|目录|封面|扉页|版权|contents?)$"


def wrap_lines(line: Column, cols: int) -> Column:
    """Pieces of `cols` code points; an empty line is one empty piece. Later pieces repeat the line's indent, up to cols - 1."""
    indent = F.substring(F.regexp_extract(line, "^[ \t　]*", 0), 1, cols - 1)
    rest = F.substring(line, cols + 1, 1 << 30)
    width = F.lit(cols) - F.length(indent)
    more = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(rest) / width).cast("int") - 1, F.lit(0))), lambda i: F.concat(indent, rest.substr(i * width + 1, width)))
    return F.when(F.length(line) <= cols, F.array(line)).otherwise(F.concat(F.array(F.substring(line, 1, cols)), more))


def n_pieces(line: Column, cols: int) -> Column:
    """Number of pieces that `wrap_lines` gives, from the lengths of the line and its indent alone."""
    indent = F.least(F.length(F.regexp_extract(line, "^[ \t　]*", 0)), F.lit(cols - 1))
    return F.when(F.length(line) <= cols, 1).otherwise(1 + F.ceil((F.length(line) - cols) / (cols - indent)).cast("int"))


def display_lines(text: Column, cols: int) -> Column:
    """Number of pieces that the lines of a text wrap to."""
    return F.aggregate(F.transform(raw_lines(text), lambda x: n_pieces(x, cols)), F.lit(0), lambda a, x: a + x)


def tick_ms(cols: Column, rows: Column, lines: Column, cpm: Column) -> Column:
    """M1: time of a step of `lines` lines at cpm characters a minute, between a comfortable least and 30 s."""
    least = F.greatest(F.lit(900.0), F.floor(F.lit(2800.0) * lines / rows + 0.5))
    return F.least(F.greatest(F.floor(F.lit(60000.0) * cols * lines / cpm + 0.5), least), F.lit(30000.0)).cast("int")


def last_page_start(n_lines: Column, rows: int) -> Column:
    """M4."""
    return F.greatest(F.lit(0), n_lines - rows)


def reading_time(chapters: DataFrame, cols: int, rows: int, cpm: int) -> DataFrame:
    """M2: pages and milliseconds of each chapter when a page turns at a time."""
    pages = F.ceil(display_lines(F.col("content_text"), cols) / rows)
    step = tick_ms(F.lit(cols), F.lit(rows), F.lit(rows), F.lit(cpm))
    return chapters.select("doc_id", "order_index", pages.cast("long").alias("pages"), (pages * step).cast("long").alias("ms"))


def display_offsets(chapters: DataFrame, cols: int) -> DataFrame:
    """The display line at which each chapter of a document begins."""
    n = chapters.select("doc_id", "order_index", display_lines(F.col("content_text"), cols).alias("n"))
    w = Window.partitionBy("doc_id").orderBy("order_index").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("start_line", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long")).withColumn("n", F.col("n").cast("long"))


def chapter_key(title: Column, text: Column, index: Column) -> Column:
    """Front:title of what stands before the text, else ord:n by a number in the title or the first line, else idx:place."""
    def ordinal(s: Column) -> Column:
        a, b = F.regexp_extract(s, r"(?i)chapter\s*([0-9]{1,5})", 1), F.regexp_extract(s, r"(?:^|\s)([0-9]{1,5})(?:\s*[.、:：\-]|\s|$)", 1)
        return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))
    first = F.get(F.filter(F.transform(raw_lines(text), trim), lambda x: x != ""), F.lit(0))
    found = F.coalesce(ordinal(F.coalesce(title, F.lit(""))), ordinal(F.coalesce(first, F.lit("")))).cast("int")
    name = F.lower(trim(F.coalesce(title, F.lit(""))))
    return F.coalesce(F.when(name.rlike(FRONT), F.concat(F.lit("front:"), name)), F.concat(F.lit("ord:"), found.cast("string")), F.concat(F.lit("idx:"), index.cast("string")))


def chapter_runs(items: DataFrame, key: str = "key") -> DataFrame:
    """Runs of items in a row with one key, and of each run the item with the longest text."""
    w = Window.partitionBy("book_id").orderBy("order_index")
    new = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)), 0).otherwise(1)
    runs = items.withColumn("new", new).withColumn("run_no", F.sum("new").over(w) - 1)
    best = F.max_by("order_index", F.struct(F.length(F.trim("content_text")), -F.col("order_index")))
    return runs.groupBy("book_id", "run_no").agg(best.alias("preferred_item"), F.min("order_index").alias("first_item"), F.max("order_index").alias("last_item"))


def step_chapters(runs: DataFrame, positions: DataFrame, delta: int) -> DataFrame:
    """The preferred item of the run `delta` runs on from each position, clamped to the book."""
    last = runs.groupBy("book_id").agg(F.max("run_no").alias("last"))
    at = positions.join(runs, "book_id").where("item between first_item and last_item").select("book_id", "run_no").join(last, "book_id")
    goal = at.select("book_id", F.greatest(F.lit(0), F.least(F.col("run_no") + delta, F.col("last"))).alias("run_no"))
    return goal.join(runs, ["book_id", "run_no"]).select("book_id", F.col("preferred_item").alias("item_id"))
