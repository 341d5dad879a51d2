"""All registered queries of the package, by operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T, urls as U
from ..operators import chapters as C, classify as K, html as H, library as L, links as N, quality as Q, reading as R, store as W
from ..sources import tables as S

SHORT_LINE = (r"^\S+(\s+\S+){0,2}$",)

_QUERIES: dict = {}
_SQL: dict = {}


def _add(name: str, sql: str | None = None):
    """Registers a query, with its SQL after the views' definitions."""

    def put(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = f"WITH RECURSIVE {S.SQL.strip()}, q AS ({sql}) SELECT * FROM q"
        return f

    return put


def _put(name: str, sql: str) -> None:
    """SQL of a query that is registered already."""
    assert name in _QUERIES and name not in _SQL, name
    _SQL[name] = f"WITH RECURSIVE {S.SQL.strip()}, q AS ({sql}) SELECT * FROM q"


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- text and chapters over documents

_SP = "[\\s　 ﻿]"
_LINES = "SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS raw, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) - 1 AS line FROM documents"
_STRONG = "regexp_matches(l, '(?i)^chapter\\s+\\d+\\b') OR regexp_matches(l, '^第\\s*[零一二三四五六七八九十百千两0-9]+\\s*[章回节卷话集篇幕部]') OR regexp_matches(l, '^卷\\s*[零一二三四五六七八九十百千两0-9]+')"
_HITS = f"""
  WITH l0 AS ({_LINES}), l1 AS (SELECT *, regexp_replace(raw, '^{_SP}+|{_SP}+$', '', 'g') AS l FROM l0),
  l2 AS (SELECT *, coalesce(lag(l) OVER w, '') AS before, coalesce(lead(l) OVER w, '') AS after, ({_STRONG}) AS strong FROM l1 WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
  hits AS (SELECT doc_id, line, l AS title FROM l2 WHERE l <> '' AND regexp_matches(l, '^\\S+(\\s+\\S+){{0,2}}$') AND
    CASE WHEN strong THEN length(l) <= 120 ELSE NOT regexp_matches(l, '[。！？；;：:，,]') AND length(l) <= 60 AND (before = '' OR after = '' OR length(l) <= 40) END)"""


def _docs(spark, d):
    return S.table(spark, d, "documents").select("doc_id", "text")


@_add("t4_normalize_text", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '^[\s　 ﻿]+|[\s　 ﻿]+$', '', 'g') AS normal FROM documents""")
def _(spark, d):
    return _docs(spark, d).select("doc_id", T.normalize_text(F.col("text")).alias("normal"))


@_add("t5_drop_blank_lines", r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(x, '[ \t　]+$', '')), lambda x: regexp_replace(x, '[ \t　]', '', 'g') <> ''), chr(10)) AS kept FROM documents""")
def _(spark, d):
    return _docs(spark, d).select("doc_id", T.drop_blank_lines(F.col("text")).alias("kept"))


@_add("t6_raw_lines", r"""SELECT doc_id, len(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)))::BIGINT AS n_lines, sha256(array_to_string(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(replace(x, chr(9), '    '), '[\s　 ﻿]+$', '')), chr(10))) AS sha FROM documents""")
def _(spark, d):
    lines = T.raw_lines(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.sha2(F.array_join(lines, "\n"), 256).alias("sha"))


@_add("t14_escape_html", "SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS sha FROM pages")
def _(spark, d):
    return S.table(spark, d, "pages").select("page_id", F.sha2(T.escape_html(F.col("html")), 256).alias("sha"))


@_add("k7_preview", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(x, '^" + _SP + "+|" + _SP + "+$', '', 'g')), lambda x: x <> '')[1:12], chr(10)) AS preview, left(text, 180) AS excerpt FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", T.preview(F.col("text")).alias("preview"), T.excerpt(F.col("text"), 180).alias("excerpt"))


@_add("t7_detect_headings", f"{_HITS} SELECT doc_id, line::BIGINT AS line, title FROM hits")
def _(spark, d):
    return C.detect_headings(_docs(spark, d), SHORT_LINE).withColumn("line", F.col("line").cast("long"))


@_add("w1_heading_gaps", f"{_HITS} SELECT doc_id, line::BIGINT AS line, (line - lag(line) OVER (PARTITION BY doc_id ORDER BY line))::BIGINT AS gap FROM hits")
def _(spark, d):
    return C.heading_gaps(C.detect_headings(_docs(spark, d), SHORT_LINE)).select("doc_id", F.col("line").cast("long").alias("line"), F.col("gap").cast("long").alias("gap"))


@_add("a3_mean_heading_gap", f"{_HITS} SELECT doc_id, count(*) AS n_hits, CASE WHEN count(*) > 1 THEN (max(line) - min(line))::DOUBLE / (count(*) - 1) END AS avg_gap FROM hits GROUP BY doc_id")
def _(spark, d):
    return C.mean_heading_gap(C.detect_headings(_docs(spark, d), SHORT_LINE))


_SPLIT = f"""{_HITS}, g AS (SELECT doc_id, count(*) AS n, (max(line) - min(line))::DOUBLE / greatest(count(*) - 1, 1) AS gap FROM hits GROUP BY doc_id),
  f AS (SELECT l1.doc_id, l1.line, l1.raw, coalesce(g.n, 0) < 2 OR (g.n >= 8 AND g.gap < 4) AS whole FROM l1 LEFT JOIN g USING (doc_id)),
  c AS (SELECT f.*, h.title, CASE WHEN whole THEN 1 ELSE count(h.line) OVER (PARTITION BY f.doc_id ORDER BY f.line) END AS no FROM f LEFT JOIN hits h ON h.doc_id = f.doc_id AND h.line = f.line),
  b AS (SELECT doc_id, no, bool_or(whole) AS whole, min(title) FILTER (NOT whole) AS title, regexp_replace(coalesce(string_agg(regexp_replace(raw, '[ \\t　]+$', ''), chr(10) ORDER BY line) FILTER (regexp_replace(raw, '[ \\t　]', '', 'g') <> ''), ''), '^{_SP}+|{_SP}+$', '', 'g') AS body FROM c GROUP BY doc_id, no)
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1)::INT AS order_index, CASE WHEN whole THEN '全文' WHEN no = 0 THEN '开头' ELSE title END AS title, body AS content_text
  FROM b WHERE body <> '' AND (whole OR no > 0 OR length(regexp_replace(body, '{_SP}', '', 'g')) >= 80)"""


@_add("t8_split_chapters", _SPLIT)
def _(spark, d):
    return C.split_chapters(_docs(spark, d), SHORT_LINE)


# the same with headings of all kinds put before every sixth line, and lines that only look like some

_FORMS = (
    "第{}章", " 第 十二 回 · 题{}", "Chapter {}", "CHAPTER {}: A title, with marks. And more", "chapter {}b", "卷 三 {}", "卷三十：名，{}", "序章", "楔子 起{}", "Prologue", "afterword — {}", "序章，{}", "Extra " + "x" * 55 + "{}",
    "第一章" + "长" * 118 + "{}", "番外{}", "In Chapter {} of", "  终章  ", "Appendix{}", "完结感言: {}", "第 章 {}", "Interlude" + " y" * 20 + "{}",
)
_FAMILIES = (
    "'^第\\s*[零一二三四五六七八九十百千两0-9]+\\s*[章回节卷话集篇幕部]'", "'(?i)^chapter\\s+\\d+\\b'", "'^卷\\s*[零一二三四五六七八九十百千两0-9]+'", "'^(序章|序|楔子|引子|前言|扉页|正文|后记|完结感言|终章|最终章|尾声|番外|外传|附录|幕间|间章)'",
    "'(?i)^(Prologue|Epilogue|Afterword|Preface|Appendix|Interlude|Extra)\\b'",
)
_FORM_LIST = "[" + ", ".join(f"'{x}'" for x in _FORMS) + "]"
_PLANTED = f"(SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 6 = 2 THEN replace({_FORM_LIST}[((doc_id + i - 1) % {len(_FORMS)} + 1)::INT], '{{}}', (i - 1)::VARCHAR) || chr(10) || x ELSE x END), chr(10)) AS text FROM documents)"


def _with_families(sql: str) -> str:
    every = " OR ".join(f"regexp_matches(l, {p})" for p in _FAMILIES)
    return sql.replace("FROM documents)", f"FROM {_PLANTED} documents)", 1).replace("regexp_matches(l, '^\\S+(\\s+\\S+){0,2}$')", f"({every})")


def _planted(spark, d):
    form = lambda i: F.replace(F.element_at(F.array(*[F.lit(x) for x in _FORMS]), ((F.col("doc_id") + i) % len(_FORMS) + 1).cast("int")), F.lit("{}"), i.cast("string"))
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 6 == 2, F.concat(form(i), F.lit("\n"), x)).otherwise(x))
    return _docs(spark, d).select("doc_id", F.array_join(lines, "\n").alias("text"))


@_add("t7_headings_of_all_kinds", _with_families(f"{_HITS} SELECT doc_id, line::BIGINT AS line, title FROM hits"))
def _(spark, d):
    return C.detect_headings(_planted(spark, d)).withColumn("line", F.col("line").cast("long"))


@_add("t8_chapters_of_all_kinds", _with_families(_SPLIT))
def _(spark, d):
    return C.split_chapters(_planted(spark, d))


# ---- library

@_add("w8_latest_progress", "SELECT * FROM v_latest")
def _(spark, d):
    return L.latest_progress(S.progress_feed(spark, d))


@_add("k1_last_progress", "SELECT * FROM v_latest ORDER BY updated_at DESC, item_id DESC LIMIT 1")
def _(spark, d):
    return L.last_progress(L.latest_progress(S.progress_feed(spark, d)))


@_add("j1_list_books", "SELECT b.*, p.item_id, p.line_index, p.updated_at AS read_at FROM v_books b LEFT JOIN v_latest p ON p.book_id = b.id")
def _(spark, d):
    return L.order_by_recency(L.list_books(S.books(spark, d), L.latest_progress(S.progress_feed(spark, d))))


@_add("f4_shelf_filter", "SELECT * FROM v_books WHERE source_type = 'file' AND contains(lower(title || ' ' || group_id), '1')")
def _(spark, d):
    return L.shelf_filter(S.books(spark, d), source_type="file", q=" 1 ")


@_add("f5_search_books", "SELECT * FROM v_books WHERE title ILIKE '%0_1%'")
def _(spark, d):
    return L.search_books(S.books(spark, d), "0_1")


@_add("a1_item_counts", "SELECT book_id, count(*) AS n FROM v_items GROUP BY book_id")
def _(spark, d):
    return L.item_counts(S.items(spark, d))


@_add("j2_book_detail", """WITH n AS (SELECT book_id, string_agg(concat(order_index, ':', title), ',' ORDER BY order_index, title) AS items, count(*) AS n_items FROM v_items GROUP BY book_id)
  SELECT b.*, coalesce(n.items, '') AS items, coalesce(n.n_items, 0) AS n_items, p.item_id, p.line_index, p.updated_at AS read_at FROM v_books b LEFT JOIN n ON n.book_id = b.id LEFT JOIN v_latest p ON p.book_id = b.id""")
def _(spark, d):
    return L.book_detail(S.books(spark, d), S.items(spark, d), L.latest_progress(S.progress_feed(spark, d)))


@_add("j3_items_with_book", "SELECT i.*, b.title AS book_title FROM v_items i JOIN v_books b ON b.id = i.book_id")
def _(spark, d):
    return L.items_with_book(S.items(spark, d), S.books(spark, d))[0]


@_add("j3_orphan_items", "SELECT * FROM v_items i WHERE NOT EXISTS (SELECT 1 FROM v_books b WHERE b.id = i.book_id AND b.source_type = 'url')")
def _(spark, d):
    return L.items_with_book(S.items(spark, d), S.books(spark, d).where("source_type = 'url'"))[1]


@_add("j4_resume_points", """WITH n AS (SELECT *, len(string_split(content_text, chr(10))) AS n_lines FROM v_items), p AS (SELECT book_id, item_id % 8 AS at, line_index FROM v_latest),
  j AS (SELECT n.*, p.line_index, n.order_index = p.at AS hit FROM n LEFT JOIN p USING (book_id))
  SELECT book_id, order_index AS item_id, CASE WHEN coalesce(hit, FALSE) THEN greatest(0, least(line_index, n_lines - 1)) ELSE 0 END::INT AS line_index FROM j
  QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY coalesce(hit, FALSE) DESC, order_index) = 1""")
def _(spark, d):
    progress = L.latest_progress(S.progress_feed(spark, d)).withColumn("item_id", F.col("item_id") % 8)
    return L.resume_points(S.items(spark, d), progress)


@_add("f1_valid_items", "SELECT * FROM v_items WHERE trim(coalesce(title, '')) <> '' AND length(title) <= 200 AND (content_text IS NULL OR length(content_text) <= 1000000) QUALIFY count(*) OVER (PARTITION BY book_id) <= 500")
def _(spark, d):
    return L.validate_items(S.items(spark, d))[0]


@_add("f24_missing_items", "SELECT book_id, order_index FROM v_items WHERE trim(coalesce(CASE WHEN title = 'system' THEN '  ' ELSE content_text END, '')) = ''")
def _(spark, d):
    emptied = S.items(spark, d).withColumn("content_text", F.when(F.col("title") == "system", "  ").otherwise(F.col("content_text")))
    return L.missing_items(emptied).select("book_id", "order_index")


@_add("w9_reindex", "SELECT book_id, (row_number() OVER (PARTITION BY book_id ORDER BY order_index) - 1)::INT AS order_index, title FROM v_items WHERE title <> 'system'")
def _(spark, d):
    return L.reindex(S.items(spark, d).where("title <> 'system'"), ["order_index"]).select("book_id", "order_index", "title")


@_add("s9_append_items", """WITH n AS (SELECT book_id, count(*) AS n FROM v_items GROUP BY book_id)
  SELECT f.book_id, f.item_id, CASE WHEN b.source_type = 'file' THEN NULL ELSE coalesce(n.n, 0) + row_number() OVER (PARTITION BY f.book_id ORDER BY f.item_id) - 1 END::BIGINT AS order_index,
  CASE WHEN b.source_type = 'file' THEN 'FILE_BOOK' END AS error FROM v_feed f LEFT JOIN n USING (book_id) LEFT JOIN v_books b ON b.id = f.book_id""")
def _(spark, d):
    return L.append_items(S.items(spark, d), S.progress_feed(spark, d), S.books(spark, d))


@_add("j12_delete_books", "SELECT i.book_id, i.order_index FROM v_items i WHERE book_id NOT IN (SELECT id FROM v_books WHERE source_type = 'file')")
def _(spark, d):
    books = S.books(spark, d)
    gone = books.where("source_type = 'file'").select("id")
    return L.delete_books(books, S.items(spark, d), S.progress_feed(spark, d), gone)[1].select("book_id", "order_index")


@_add("a2_next_group_index", "SELECT parent_id, (max(order_index) + 1)::BIGINT AS next_index FROM v_groups GROUP BY parent_id")
def _(spark, d):
    return L.next_group_index(S.groups(spark, d))


@_add("j11_rejected_moves", "SELECT id, group_id FROM (SELECT id, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN group_id ELSE 'x' || group_id END AS group_id FROM v_books) WHERE group_id IS NOT NULL AND group_id NOT IN (SELECT id FROM v_groups)")
def _(spark, d):
    kind = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.col("group_id")).otherwise(F.concat(F.lit("x"), "group_id"))
    return L.check_groups(S.books(spark, d).select("id", kind.alias("group_id")), S.groups(spark, d))[1].select("id", "group_id")


@_add("h1_group_closure", "SELECT * FROM v_closure")
def _(spark, d):
    return L.group_closure(S.tree(spark, d))


@_add("h2_group_tree", """SELECT id, label, place FROM (WITH RECURSIVE p AS (SELECT id, title, 0 AS depth, concat(lpad(order_index::VARCHAR, 6, '0'), ' ', title) AS place FROM v_tree WHERE parent_id IS NULL
  UNION ALL SELECT t.id, t.title, p.depth + 1, concat(p.place, '/', lpad(t.order_index::VARCHAR, 6, '0'), ' ', t.title) FROM p JOIN v_tree t ON t.parent_id = p.id) SELECT id, concat(repeat('  ', least(depth, 6)), title) AS label, place FROM p)""")
def _(spark, d):
    return L.group_tree(S.tree(spark, d)).orderBy("place")


@_add("h2_tree_order", """WITH RECURSIVE p AS (SELECT id, title, id AS root, 0 AS depth, concat(lpad(order_index::VARCHAR, 9, '0')) AS place FROM v_tree WHERE parent_id IS NULL
  UNION ALL SELECT t.id, t.title, p.root, p.depth + 1, concat(p.place, '/', lpad(t.order_index::VARCHAR, 9, '0')) FROM p JOIN v_tree t ON t.parent_id = p.id),
  e AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY place) - 1 AS enter FROM p)
  SELECT id, concat(repeat('  ', least(depth, 6)), title) AS label, root, depth, enter, enter + (SELECT count(*) FROM v_closure c WHERE c.root = e.id) - 1 AS leave FROM e""")
def _(spark, d):
    return L.tree_order(S.tree(spark, d))


def _shelved(spark, d):
    return S.books(spark, d).withColumn("group_id", F.concat(F.lit("c"), F.floor(F.col("id") / 2)))


@_add("h3_delete_group_keep", "SELECT id, CASE WHEN concat('c', id // 2) NOT IN (SELECT id FROM v_closure WHERE root = 'c1') THEN concat('c', id // 2) END AS group_id FROM v_books")
def _(spark, d):
    return L.delete_group(_shelved(spark, d), S.tree(spark, d), "c1", True)[0].select("id", "group_id")


@_add("h3_delete_group_books", "SELECT id, concat('c', id // 2) AS group_id FROM v_books WHERE concat('c', id // 2) NOT IN (SELECT id FROM v_closure WHERE root = 'c1')")
def _(spark, d):
    return L.delete_group(_shelved(spark, d), S.tree(spark, d), "c1", False)[0].select("id", "group_id")


@_add("h4_move_books", "SELECT id, CASE WHEN source_type = 'url' THEN 'r0' ELSE group_id END AS group_id, CASE WHEN source_type = 'url' THEN TIMESTAMP '2025-01-01' ELSE updated_at END AS updated_at FROM v_books")
def _(spark, d):
    books = S.books(spark, d)
    return L.move_books(books, books.where("source_type = 'url'").select("id", F.lit("r0").alias("new_group")), F.expr("timestamp_ntz'2025-01-01 00:00:00'")).select("id", "group_id", "updated_at")


@_add("h5_rename", "SELECT id, CASE WHEN source_type = 'url' THEN upper(title) || '!' ELSE title END AS title FROM v_books")
def _(spark, d):
    books = S.books(spark, d)
    return L.rename(books, books.where("source_type = 'url'").select("id", F.concat(F.upper("title"), F.lit("!")).alias("new_title")))[0].select("id", "title")


@_add("k3_list_groups", "SELECT * FROM v_groups")
def _(spark, d):
    return L.list_groups(S.groups(spark, d))


@_add("k5_cap_per_key", "SELECT book_id, item_id FROM v_feed QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY item_id) <= 20")
def _(spark, d):
    return L.cap_per_key(S.progress_feed(spark, d), ["book_id"], ["item_id"], 20).select("book_id", "item_id")


@_add("k6_chapter_page", "SELECT book_id, order_index, title FROM v_items WHERE order_index BETWEEN 3 AND 5")
def _(spark, d):
    return L.chapter_page(S.items(spark, d), 1, 3).select("book_id", "order_index", "title")


# ---- URLs, pages and links

@_add("f3_url_host", "SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host FROM pages")
def _(spark, d):
    return S.table(spark, d, "pages").select("page_id", U.url_host(F.col("url")).alias("host"))


@_add("f2_public_urls", r"""SELECT page_id, regexp_matches(u, '^https?://[^/@?#]+([/?#]|$)') AND NOT regexp_matches(u, '^https?://(localhost|127\.|10\.|192\.168\.)') AS ok FROM (
  SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'http://10.0.0.1/' || page_id WHEN 1 THEN 'ftp' || url WHEN 2 THEN replace(url, '://', '://u:p@') WHEN 3 THEN 'http://192.168.1.9/x' ELSE url END AS u FROM pages)""")
def _(spark, d):
    k = F.col("page_id") % 5
    u = F.when(k == 0, F.concat(F.lit("http://10.0.0.1/"), "page_id")).when(k == 1, F.concat(F.lit("ftp"), "url")).when(k == 2, F.replace("url", F.lit("://"), F.lit("://u:p@"))).when(k == 3, "http://192.168.1.9/x").otherwise(F.col("url"))
    return S.table(spark, d, "pages").select("page_id", U.is_public_http_url(u).alias("ok"))


_FP = r"""SELECT page_id, url, concat(regexp_extract(url, '^(https?://[^/?#]*)', 1), CASE WHEN regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) END,
  CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END) AS fp FROM (
  SELECT page_id, url, list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '(?i)^utm_|^spm$|^from$|^ref$')) AS kept FROM pages)"""


@_add("r2_url_fingerprint", f"SELECT page_id, fp FROM ({_FP})")
def _(spark, d):
    return S.table(spark, d, "pages").select("page_id", U.url_fingerprint(F.col("url")).alias("fp"))


@_add("a13_first_by_fingerprint", f"SELECT min(page_id) AS page_id, fp FROM ({_FP}) GROUP BY fp")
def _(spark, d):
    pages = S.table(spark, d, "pages").select("page_id", "url", F.lit(1).alias("one"))
    tagged = pages.unionByName(pages.select((F.col("page_id") + 1_000_000).alias("page_id"), F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.contains("url", F.lit("?")), "&utm_source=x#y").otherwise("?utm_source=x#y")).alias("url"), "one"))
    return N.first_by_fingerprint(tagged, ["one"], "url", "page_id").select("page_id", "fp")


@_add("r4_trailing_id", r"SELECT page_id, regexp_extract(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '(\d{5,})\D*$', 1) AS id FROM pages")
def _(spark, d):
    return S.table(spark, d, "pages").select("page_id", U.trailing_id(F.col("url")).alias("id"))


@_add("s3_scan_pages", r"SELECT page_id, trim(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&quot;', '\"'), '&amp;', '&')) AS title FROM pages".replace('\\"', '"'))
def _(spark, d):
    return S.table(spark, d, "pages").select("page_id", H.page_title(F.col("html")).alias("title"))


_VIS = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"


@_add("x1_tokenize_pages", f"SELECT page_id, count(*) AS n, count(*) FILTER (starts_with(t, '</')) AS n_close, count(*) FILTER (NOT starts_with(t, '<')) AS n_text FROM (SELECT page_id, unnest(regexp_extract_all({_VIS}, '<[^>]+>|[^<]+')) AS t FROM pages) GROUP BY page_id")
def _(spark, d):
    return H.tokenize_pages(S.table(spark, d, "pages")).groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "close").alias("n_close"), F.count_if(F.col("kind") == "text").alias("n_text"))


@_add("x3_anchors")
def _(spark, d):
    return H.anchors(S.table(spark, d, "pages"))


@_add("x10_strip_attrs", r"SELECT page_id, sha256(regexp_replace(regexp_replace(html, '(?is)<img\b[^>]*>', '', 'g'), '(?s)<([A-Za-z0-9]+)\s[^>]*>', '<\1>', 'g')) AS sha FROM pages")
def _(spark, d):
    return S.table(spark, d, "pages").select("page_id", F.sha2(H.strip_attrs(F.col("html")), 256).alias("sha"))


@_add("a4_page_features")
def _(spark, d):
    return H.page_features(S.table(spark, d, "pages")).select("page_id", "n_anchors", "n_p", "link_len", "text_len", "n_sentences")


@_add("x5_page_text")
def _(spark, d):
    return H.page_features(S.table(spark, d, "pages")).select("page_id", "title", "body", F.size("paragraphs").alias("n_paragraphs"))


@_add("f6_access_status")
def _(spark, d):
    return K.access_status(H.page_features(S.table(spark, d, "pages"))).select("page_id", "status")


@_add("f12_directory_pages")
def _(spark, d):
    f = H.page_features(S.table(spark, d, "pages"))
    return f.select("page_id", K.is_directory_page(*(F.col(c) for c in ("n_anchors", "link_len", "text_len", "n_p"))).alias("is_directory"))


@_add("f13_font_obfuscated", r"""SELECT doc_id, length(text) >= 120 AND length(regexp_replace(text, '[\x{4e00}-\x{9fa5}a-zA-Z0-9\s，。！？、,.!?;:："''“”‘’（）()【】\[\]\-—_&~*]', '', 'g'))::DOUBLE / greatest(length(text), 1) >= CASE WHEN length(text) < 200 THEN 0.6 ELSE 0.35 END AS flag FROM documents""")
def _(spark, d):
    return _docs(spark, d).select("doc_id", K.is_font_obfuscated(F.col("text")).alias("flag"))


@_add("f15_pagination_hint")
def _(spark, d):
    return K.pagination_hint(H.anchors(S.table(spark, d, "pages")))


@_add("q8_status_by_host")
def _(spark, d):
    return Q.status_by_host(K.access_status(H.page_features(S.table(spark, d, "pages"))))


@_add("a14_chapter_links")
def _(spark, d):
    return N.toc_entries(H.anchors(S.table(spark, d, "pages")))


@_add("w4_toc_next")
def _(spark, d):
    return N.toc_next(N.toc_entries(H.anchors(S.table(spark, d, "pages"))))


@_add("a9_best_url_group")
def _(spark, d):
    return N.best_url_group(H.anchors(S.table(spark, d, "pages")))


@_add("j9_link_graph", """WITH e AS (SELECT page_id AS src, unnest([page_id + 1, page_id // 2, page_id + 1]) AS dst FROM pages) SELECT src, dst, count(*) AS n FROM e WHERE dst IN (SELECT page_id FROM pages) GROUP BY ALL""")
def _(spark, d):
    """Pages that link twice to the one behind them, with other queries, and to the one of half their number."""
    i = F.col("page_id")
    link = lambda n, tail: F.concat(F.lit('<a href="/p/'), n.cast("string"), F.lit(f'{tail}">x</a>'))
    pages = S.table(spark, d, "pages").select("page_id", F.concat(F.lit("https://g.example/p/"), i.cast("string")).alias("url"), F.concat("html", link(i + 1, "?utm_a=1"), link(F.floor(i / 2), ""), link(i + 1, "#x")).alias("html"))
    return N.link_graph(H.anchors(pages), pages)


@_add("j10_numeric_neighbours", """WITH p AS (SELECT page_id, page_id // 7 AS book FROM pages) SELECT a.page_id, b.page_id AS other_id, (b.page_id - a.page_id)::BIGINT AS delta FROM p a JOIN p b ON a.book = b.book AND abs(a.page_id - b.page_id) = 1""")
def _(spark, d):
    """Seven chapters a book; the last of one and the first of the next are neighbours by number, but not alike enough."""
    i = F.col("page_id")
    url = F.concat(F.lit("https://n.example/book/b"), F.floor(i / 7).cast("string"), F.lit("/"), i.cast("string"), F.lit(".html"))
    return N.numeric_neighbours(S.table(spark, d, "pages").select("page_id", url.alias("url")), 50)


# ---- reading and reports

@_add("m1_tick_ms", "SELECT event_id, least(greatest(floor(60000.0::DOUBLE * (10 + event_id % 50) * (1 + event_id % 4) / (50 + event_id % 700) + 0.5), greatest(900, floor(2800.0::DOUBLE * (1 + event_id % 4) / (1 + event_id % 9) + 0.5))), 30000)::INT AS ms FROM events")
def _(spark, d):
    e = F.col("event_id")
    return S.table(spark, d, "events").select("event_id", R.tick_ms(10 + e % 50, 1 + e % 9, 1 + e % 4, 50 + e % 700).alias("ms"))


@_add("m4_last_page_start", "SELECT doc_id, greatest(0, len(string_split(text, chr(10))) - 5)::INT AS start FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", R.last_page_start(F.size(F.split("text", "\n", -1)), 5).cast("int").alias("start"))


_WRAP = "greatest(1, ceil(length(regexp_replace(replace(x, chr(9), '    '), '" + _SP + "+$', ''))::DOUBLE / 40))"


@_add("t9_display_lines", f"SELECT doc_id, sum({_WRAP})::BIGINT AS n FROM (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS x FROM documents) GROUP BY doc_id")
def _(spark, d):
    return _docs(spark, d).select("doc_id", R.display_lines(F.col("text"), 40).cast("long").alias("n"))


@_add("m2_reading_time")
def _(spark, d):
    return R.reading_time(C.split_chapters(_docs(spark, d), SHORT_LINE), 40, 12, 300)


@_add("w10_display_offsets")
def _(spark, d):
    return R.display_offsets(C.split_chapters(_docs(spark, d), SHORT_LINE), 40)


_RUNS = """WITH k AS (SELECT *, CASE WHEN title IS DISTINCT FROM lag(title) OVER (PARTITION BY book_id ORDER BY order_index) THEN 1 ELSE 0 END AS new FROM (SELECT book_id, order_index, content_text, order_index // 2 AS title FROM v_items)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY book_id ORDER BY order_index) - 1 AS run_no FROM k),
  runs AS (SELECT book_id, run_no::BIGINT AS run_no, arg_max(order_index, (length(trim(content_text)) * 1000 - order_index)) AS preferred_item, min(order_index) AS first_item, max(order_index) AS last_item FROM r GROUP BY book_id, run_no)"""


def _runs(spark, d):
    return R.chapter_runs(S.items(spark, d).withColumn("key", F.floor(F.col("order_index") / 2)))


@_add("w5_chapter_runs", f"{_RUNS} SELECT * FROM runs")
def _(spark, d):
    return _runs(spark, d)


@_add("w6_step_chapters", f"{_RUNS}, p AS (SELECT book_id, min(order_index) AS item FROM v_items GROUP BY book_id), l AS (SELECT book_id, max(run_no) AS last FROM runs GROUP BY book_id), a AS (SELECT p.book_id, least(r.run_no + 2, l.last) AS run_no FROM p JOIN runs r ON r.book_id = p.book_id AND p.item BETWEEN r.first_item AND r.last_item JOIN l ON l.book_id = p.book_id) SELECT a.book_id, r.preferred_item AS item_id FROM a JOIN runs r USING (book_id, run_no)")
def _(spark, d):
    return R.step_chapters(_runs(spark, d), S.items(spark, d).groupBy("book_id").agg(F.min("order_index").alias("item")), 2)


@_add("t12_chapter_key")
def _(spark, d):
    return S.items(spark, d).select("book_id", "order_index", R.chapter_key(F.col("title"), F.col("content_text"), F.col("order_index")).alias("key"))


@_add("a10_perf_summary", "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, round(avg(value), 3) AS mean FROM events WHERE value > 0 GROUP BY event_type")
def _(spark, d):
    return Q.perf_summary(S.table(spark, d, "events"), "event_type", "value")


@_add("a10_error_rates", "SELECT count(*) AS n, round(count(*) FILTER (event_type = 'view' AND value > 50)::DOUBLE / count(*), 3) AS timeout_rate, round(count(*) FILTER (event_type = 'click')::DOUBLE / count(*), 3) AS too_large_rate FROM events")
def _(spark, d):
    kind = F.col("event_type")
    code = F.when((kind == "view") & (F.col("value") > 50), "EXTRACTION_TIMEOUT").when(kind == "click", "DOM_TOO_LARGE").otherwise("")
    return Q.error_rates(S.table(spark, d, "events").select(code.alias("code")), "code")


@_add("f25_parse_error", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'E_' || upper(event_type) END AS code, CASE WHEN event_id % 2 = 0 THEN 'at ' ELSE 'plain ' END || event_id AS message FROM events")
def _(spark, d):
    e = S.table(spark, d, "events")
    even = F.col("event_id") % 2 == 0
    said = F.when(even, F.concat(F.lit("WEB::E_"), F.upper("event_type"), F.lit("::at "), "event_id")).otherwise(F.concat(F.lit("plain "), "event_id"))
    return e.select("event_id", Q.parse_error(said).alias("x")).select("event_id", "x.code", "x.message")


@_add("a11_run_summary", "SELECT count(*) AS total, count(*) FILTER (value > 50) AS passed, count(*) FILTER (NOT value > 50) AS failed FROM events")
def _(spark, d):
    return Q.run_summary(S.table(spark, d, "events"), F.col("value") > 50)


# ---- filling the library

_CHAPTERS = _SQL["t8_split_chapters"]


@_add("s7_to_library", f"SELECT sha256(concat(doc_id, ':', order_index)) AS item_id, doc_id AS book_id, order_index, title, content_text FROM ({_CHAPTERS})")
def _(spark, d):
    return W.to_library(C.split_chapters(_docs(spark, d), SHORT_LINE))


@_add("s7_book_rows", f"SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN concat('d', doc_id) ELSE source END AS title, 'file' AS source_type, concat('d', doc_id) AS source_ref, (SELECT count(*) FROM ({_CHAPTERS}) c WHERE c.doc_id = documents.doc_id) AS n_items FROM documents WHERE doc_id IN (SELECT doc_id FROM ({_CHAPTERS}))")
def _(spark, d):
    ref = F.concat(F.lit("d"), "doc_id")
    books = S.table(spark, d, "documents").select(F.col("doc_id").alias("book_id"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("source")).alias("title"), ref.alias("source_ref"))
    return W.book_rows(books, W.to_library(C.split_chapters(_docs(spark, d), SHORT_LINE)))


@_add("s8_toc_to_library", """SELECT user_id AS book_id, no::INT AS order_index, CASE WHEN event_type = 'view' THEN concat('#', no) ELSE event_type END AS title, '' AS content_text, props AS url
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS no FROM events) WHERE no <= 30
  UNION ALL SELECT id, 0, 'intro', CASE WHEN source_type = 'file' THEN '-' ELSE title END, NULL FROM v_books""")
def _(spark, d):
    entries = S.table(spark, d, "events").select(F.col("user_id").alias("book_id"), F.col("event_id").alias("pos"), F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type")).alias("title"), F.col("props").alias("url"))
    intros = S.books(spark, d).select(F.col("id").alias("book_id"), F.when(F.col("source_type") == "url", F.col("title")).alias("intro"))
    return W.toc_to_library(entries, intros, cap=30)


@_add("j5_backfill", f"""WITH f AS ({_FP}), x AS (SELECT fp, min(concat('text ', page_id)) AS t FROM f WHERE page_id % 3 <> 0 GROUP BY fp)
  SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'old' ELSE coalesce(t, ' ') END AS content_text FROM f LEFT JOIN x USING (fp)""")
def _(spark, d):
    pages = S.table(spark, d, "pages")
    tagged = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("utm_medium=x"))
    extracts = pages.select(tagged.alias("url"), F.when(F.col("page_id") % 3 == 0, " ").otherwise(F.concat(F.lit("text "), "page_id")).alias("text"))
    items = pages.select("page_id", "url", F.when(F.col("page_id") % 4 == 0, "old").otherwise(" ").alias("content_text"))
    return W.backfill(items, extracts).select("page_id", "content_text")


_LISTS = "SELECT page_id, page_id % 25 AS list_id, url, CASE page_id % 4 WHEN 0 THEN '目录' WHEN 1 THEN concat('Chapter ', page_id) ELSE concat('x', page_id) END AS title FROM pages"


def _lists(spark, d):
    k = F.col("page_id") % 4
    title = F.when(k == 0, "目录").when(k == 1, F.concat(F.lit("Chapter "), "page_id")).otherwise(F.concat(F.lit("x"), "page_id"))
    return S.table(spark, d, "pages").select("page_id", (F.col("page_id") % 25).alias("list_id"), "url", title.alias("title"))


@_add("f27_valid_lists", f"""WITH l AS (SELECT page_id, list_id, CASE WHEN page_id % 97 = 5 THEN 'ftp' ELSE url END AS url FROM ({_LISTS}))
  SELECT page_id, list_id FROM l WHERE list_id NOT IN (SELECT list_id FROM l WHERE page_id % 97 = 5)""")
def _(spark, d):
    bad = _lists(spark, d).withColumn("url", F.when(F.col("page_id") % 97 == 5, "ftp").otherwise(F.col("url")))
    return W.valid_lists(bad).select("page_id", "list_id")


_QUALITY = {k: getattr(Q, k).replace("'", "''") for k in ("UTILITY", "TITLE_NUMBERED", "CHAPTER_ADDRESS", "NAV_WORDS", "DETAIL_WORDS")}


@_add("a8_toc_quality", f"""WITH c AS (SELECT list_id, count(*) FILTER (u) AS n, count(*) FILTER (u AND regexp_matches(title, '{_QUALITY["TITLE_NUMBERED"]}')) AS a, count(*) FILTER (u AND regexp_matches(url, '{_QUALITY["CHAPTER_ADDRESS"]}')) AS b
  FROM (SELECT *, NOT regexp_matches(title, '{_QUALITY["UTILITY"]}') AS u FROM ({_LISTS})) GROUP BY list_id)
  SELECT list_id, greatest(a, b) AS n_like, CASE WHEN n > 0 THEN greatest(a, b)::DOUBLE / n ELSE 0 END AS ratio, greatest(a, b) >= 2 AND (n > 0 AND greatest(a, b)::DOUBLE / n >= 0.2 OR b >= 3) AS valid FROM c""")
def _(spark, d):
    return Q.toc_quality(_lists(spark, d))


def _count_sql(pattern: str) -> str:
    return f"len(regexp_extract_all(t, '{pattern}'))"


@_add("f21_readable_body", f"""SELECT doc_id, length(t) >= 180 AND (han >= 60 OR marks >= 3) AND (marks >= 2 OR han >= 260) AND nav / greatest(1.0::DOUBLE, length(t)::DOUBLE / 20) <= 0.35 AND meta / greatest(1.0::DOUBLE, length(t)::DOUBLE / 30) <= 0.45 AS ok FROM (
  SELECT doc_id, t, {_count_sql("[。！？.!?]")} AS marks, {_count_sql("[一-龥]")} AS han, {_count_sql(_QUALITY["NAV_WORDS"])}::DOUBLE AS nav, {_count_sql(_QUALITY["DETAIL_WORDS"])}::DOUBLE AS meta FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""")
def _(spark, d):
    return _docs(spark, d).select("doc_id", Q.is_readable_body(F.col("text")).alias("ok"))


@_add("w11_step_page", """WITH n AS (SELECT book_id, order_index, len(string_split(content_text, chr(10))) + order_index AS n FROM v_items),
  k AS (SELECT *, lag(order_index) OVER w AS before, lag(n) OVER w AS nb, lead(order_index) OVER w AS after FROM n WINDOW w AS (PARTITION BY book_id ORDER BY order_index)),
  p AS (SELECT k.*, line + step AS t FROM k, (VALUES (0), (1)) l(line), (VALUES (-2), (2)) s(step))
  SELECT book_id, CASE WHEN t < 0 AND before IS NOT NULL THEN before WHEN t >= n AND after IS NOT NULL THEN after ELSE order_index END AS order_index,
  (CASE WHEN t < 0 AND before IS NOT NULL THEN greatest(0, nb - 3) WHEN t >= n AND after IS NOT NULL THEN 0 ELSE greatest(0, least(t, n - 1)) END)::BIGINT AS line FROM p""")
def _(spark, d):
    items = S.items(spark, d).select("book_id", "order_index", (F.size(F.split("content_text", "\n", -1)) + F.col("order_index")).alias("n_lines"))
    positions = items.select("book_id", "order_index", F.explode(F.array(F.lit(0), F.lit(1))).alias("line"))
    return W.step_page(items, positions, -2, 3).unionByName(W.step_page(items, positions, 2, 3))


from . import contents_queries, navigation_queries, page_queries, source_queries, stream_queries, page_sql  # noqa: E402, F401, I001
