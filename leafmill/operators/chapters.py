"""Chapter segmentation. All of it is row-local array work, so it needs no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import SPACE, drop_blank_lines, split_lines, trim

# Heading patterns (numbered, volume, named, English), the strong ones, and sentence marks.
_N = "[零一二三四五六七八九十百千两0-9]+"
_REST = "[\\s:：\\-—_.、·]*.*$"
STRONG = (f"^第\\s*{_N}\\s*[章回节卷话集篇幕部]", "(?i)^chapter\\s+\\d+\\b", f"^卷\\s*{_N}")
NAMED = (
    f"^(序章|序|楔子|引子|前言|扉页|正文|后记|完结感言|终章|最终章|尾声|番外|外传|附录|幕间|间章){_REST}",
    f"(?i)^(Prologue|Epilogue|Afterword|Preface|Appendix|Interlude|Extra)\\b{_REST}",
)
SENTENCE = "[。！？；;：:，,]"


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(p)
    return found


def is_heading(line: Column, before: Column, after: Column, patterns: tuple[str, ...] | None = None) -> Column:
    """T7 on trimmed lines: strong headings up to 120 characters; others need no sentence mark, 60 at most, and an empty neighbour or 40 at most."""
    candidate = _any(line, patterns) if patterns else _any(line, STRONG + NAMED)
    weak = ~line.rlike(SENTENCE) & (F.length(line) <= 60) & ((before == "") | (after == "") | (F.length(line) <= 40))
    return (line != "") & candidate & F.when(_any(line, STRONG), F.length(line) <= 120).otherwise(weak)


def _hits(patterns: tuple[str, ...] | None) -> Column:
    """Numbers of the headings among the trimmed lines `ls`."""
    at = lambda i: F.coalesce(F.get("ls", i), F.lit(""))
    return F.filter(F.sequence(F.lit(0), F.size("ls") - 1), lambda i: is_heading(at(i), F.when(i > 0, at(i - 1)).otherwise(""), at(i + 1), patterns))


def detect_headings(docs: DataFrame, patterns: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, line, title) of every heading."""
    lines = docs.select("doc_id", F.transform(split_lines(F.col("text")), trim).alias("ls"))
    return lines.select("doc_id", "ls", F.explode(_hits(patterns)).alias("line")).select("doc_id", "line", F.get("ls", F.col("line")).alias("title"))


def heading_gaps(headings: DataFrame) -> DataFrame:
    """Each heading with its distance from the one before."""
    return headings.withColumn("gap", F.col("line") - F.lag("line").over(Window.partitionBy("doc_id").orderBy("line")))


def mean_heading_gap(headings: DataFrame) -> DataFrame:
    """A3."""
    return heading_gaps(headings).groupBy("doc_id").agg(F.count("*").alias("n_hits"), F.avg("gap").alias("avg_gap"))


def split_chapters(docs: DataFrame, patterns: tuple[str, ...] | None = None, min_hits: int = 2, min_avg_gap: int = 4, dense_guard: int = 8, min_head_chars: int = 80, full_title: str = "全文", head_title: str = "开头") -> DataFrame:
    """(doc_id, order_index, title, content_text); a chapter begins with its heading and holds no blank lines.

    Too few headings, or many that stand too close, give one chapter. Text
    before the first heading is a chapter if it has enough characters. Empty
    chapters go. A null text counts as empty; rows that repeat a doc_id are
    split each on its own.
    """
    rows = docs.select("doc_id", split_lines(F.col("text")).alias("raw")).withColumn("ls", F.transform("raw", trim))
    rows = rows.withColumn("hits", _hits(patterns)).withColumn("n", F.size("hits"))
    gap = F.when(F.col("n") > 1, (F.element_at("hits", -1) - F.get("hits", F.lit(0))) / (F.col("n") - 1)).otherwise(999)
    full = (F.col("n") < min_hits) | ((F.col("n") >= dense_guard) & (gap < min_avg_gap))
    span = lambda a, b, title, least: F.struct(title.alias("title"), a.alias("a"), b.alias("b"), F.lit(least).alias("least"))
    end, zero = F.size("raw"), F.lit(0)
    starts = F.transform("hits", lambda h, i: span(h, F.coalesce(F.get("hits", i + 1), end), F.get("ls", h), 1))
    head = span(zero, F.get("hits", zero), F.lit(head_title), min_head_chars)
    spans = F.when(full, F.array(span(zero, end, F.lit(full_title), 1))).otherwise(F.concat(F.array(head), starts))
    rows = rows.select("doc_id", "raw", spans.alias("spans"), F.size("raw").alias("n"))
    # numbered and filtered as an array in its row, so that nothing is shuffled and rows of one doc_id stay apart
    body = lambda s: trim(drop_blank_lines(F.array_join(F.slice("raw", s["a"] + 1, s["b"] - s["a"]), "\n")))
    made = F.transform("spans", lambda s: F.struct(s["title"].alias("title"), body(s).alias("content_text"), s["least"].alias("least")))
    rows = rows.select("doc_id", made.alias("made"), "n")
    ink = lambda x: F.length(F.regexp_replace(x["content_text"], SPACE, ""))
    kept = F.filter("made", lambda x: F.when(x["least"] > 1, ink(x) >= x["least"]).otherwise(x["content_text"] != ""))
    return rows.select("doc_id", F.posexplode(kept).alias("order_index", "c")).select("doc_id", "order_index", "c.title", "c.content_text")
