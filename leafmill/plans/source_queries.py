"""Queries over files, archives and site reports; `registry` imports this module last."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import extract as X, library as L, quality as Q
from ..sources import files as B, tables as S
from ..sources.storage import scratch_folder
from ..streaming import throttle as G
from .registry import _SP, _LISTS, _QUALITY, _add, _count_sql, _lists


def _docs(spark, d):
    return S.table(spark, d, "documents").select("doc_id", "text")


_CLEAN = "replace(replace(replace(replace(replace(coalesce(text, ''), '锟斤拷', ''), '嚙', ''), '銆', ''), 'Ã€', '€'), 'Â', '')"


@_add("t2_clean_mojibake", rf"SELECT doc_id, regexp_replace(regexp_replace({_CLEAN}, '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", B.clean_mojibake(F.coalesce("text", F.lit(""))).alias("text"))


@_add("a12_encoding_scores", "SELECT doc_id, round(len(regexp_extract_all(text, '[一-鿿]'))::DOUBLE / greatest(length(text), 1), 9) AS a, round(CASE WHEN text = '' THEN -1 ELSE -least(0.5::DOUBLE, len(regexp_extract_all(text, '[锟銆嚙�ÃÂ]'))::DOUBLE / greatest(length(text), 1) * 10) END, 9) AS b FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", B.encoding_score(F.col("text"), F.lit(False), F.lit(False)).alias("s")).select("doc_id", F.round("s.a", 9).alias("a"), (F.round("s.b", 9) + 0.0).alias("b"))


@_add("t1_repair_charset")
def _(spark, d):
    out = B.repair_charset(_docs(spark, d).select("doc_id", F.encode("text", "UTF-8").alias("content")))
    return out.select("doc_id", "text", "method", "changed", B.encoding_label(F.col("method")).alias("label"))


@_add("t1_known_bytes", """SELECT doc_id, repeat('中文面', (1 + doc_id % 9)::INT) AS text, CASE doc_id % 3 WHEN 0 THEN 'direct-utf-8' WHEN 1 THEN 'direct-gb18030' ELSE 'utf8->view->latin1->gbk' END AS method, doc_id % 3 > 0 AS changed, CASE doc_id % 3 WHEN 1 THEN 'GB18030' WHEN 2 THEN 'GBK' END AS label FROM documents""")
def _(spark, d):
    """The same Han text as UTF-8, as GBK, and as GBK that was read as Latin-1 and written as UTF-8."""
    k = F.col("doc_id") % 3
    code = F.when(k == 0, "E4B8ADE69687E99DA2").when(k == 1, "D6D0CEC4C3E6").otherwise("C396C390C38EC384C383C3A6")
    out = B.repair_charset(_docs(spark, d).withColumn("code", code).select("doc_id", F.unhex(F.expr("repeat(code, int(1 + doc_id % 9))")).alias("content")))
    return out.select("doc_id", "text", "method", "changed", B.encoding_label(F.col("method")).alias("label"))


@_add("s2_source_formats", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'epub' END AS format, CASE WHEN page_id % 3 = 2 THEN 'UNSUPPORTED_FORMAT' END AS error FROM pages")
def _(spark, d):
    k = F.col("page_id") % 3
    kind = B.source_format(F.concat("url", F.when(k == 0, ".TXT").when(k == 1, ".epub").otherwise(".pdf")))
    return S.table(spark, d, "pages").select("page_id", kind.alias("x")).select("page_id", "x.*")


@_add("s5_resolved_paths", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('ops/c/', page_id) WHEN 1 THEN concat('ops/', page_id) WHEN 2 THEN url ELSE '' END AS path FROM pages")
def _(spark, d):
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    href = F.when(k == 0, F.concat(F.lit("./c//"), i)).when(k == 1, F.concat(F.lit("x/../"), i)).when(k == 2, F.col("url")).otherwise("")
    return S.table(spark, d, "pages").select("page_id", B.resolve_path(F.lit("ops/book.opf"), href).alias("path"))


@_add("s4_flatten_archives", r"""SELECT book_id AS archive, (row_number() OVER (PARTITION BY book_id ORDER BY order_index) - 1)::INT AS order_index, concat('Part ', order_index, ' of ', book_id) AS title, sha256(concat('Part ', order_index, ' of ', book_id, chr(10), regexp_replace(regexp_replace(replace(coalesce(content_text, ''), chr(13) || chr(10), chr(10)), '[ \t　 ]+\n', chr(10), 'g'), '[\s　 ]+$', ''))) AS sha FROM v_items WHERE order_index % 5 <> 3""")
def _(spark, d):
    """Each conversation as a book: its turns are members, their package is derived from them; every fifth member is missing."""
    i = S.items(spark, d).select(F.col("book_id").alias("archive"), "order_index", "content_text")
    said = F.replace(F.replace(F.replace(F.coalesce("content_text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    name = F.concat(F.lit("text/s"), "order_index", F.lit(".xhtml"))
    bodies = i.where("order_index % 5 <> 3").select("archive", F.concat(F.lit("ops/"), name).alias("path"), F.concat(F.lit("<html><head></head><body><h1>Part "), "order_index", F.lit(" of "), "archive", F.lit("</h1>\n<p>"), said, F.lit("</p></body></html>")).alias("text"))
    item = F.concat(F.lit('<item id="s'), "order_index", F.lit('" href="'), name, F.lit('" media-type="application/xhtml+xml"/>'))
    ref = F.concat(F.lit('<itemref idref="s'), "order_index", F.lit('"/>'))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_index", c.alias("t")))), lambda x: x["t"]), "")
    package = i.groupBy("archive").agg(F.concat(F.lit("<package><manifest>"), listed(item), F.lit("</manifest><spine>"), listed(ref), F.lit("</spine></package>")).alias("text")).select("archive", F.lit("ops/book.opf").alias("path"), "text")
    container = i.select("archive").distinct().select("archive", F.lit("META-INF/container.xml").alias("path"), F.lit('<container><rootfile full-path="ops/book.opf"/></container>').alias("text"))
    return B.flatten_archives(bodies.unionByName(package).unionByName(container)).select("archive", "order_index", "title", F.sha2("content_text", 256).alias("sha"))


_N = {k: getattr(Q, k).replace("'", "''") for k in ("INTRO", "CHAPTER_MARK", "SHELL_MARK", "PART_MARK", "FRONT_HAN", "FRONT_LATIN", "CSS", "LEGAL", "PAY_SHELL")}


@_add("f22_noise_flags", f"""SELECT doc_id, i >= 2 AND c = 0 AS intro, (h >= 3 OR l >= 3) AND c + p = 0 AS front, s >= 2 OR (dots >= 12 AND len(regexp_extract_all(t, '(?i)url\\(|background|display|position')) > 0) AS css, g >= 2 AS legal, y >= 2 AND c2 <= 1 AS shell FROM (
  SELECT doc_id, t, {_count_sql(_N["INTRO"])} AS i, {_count_sql(_N["CHAPTER_MARK"])} AS c, {_count_sql(_N["SHELL_MARK"])} AS c2, {_count_sql(_N["PART_MARK"])} AS p, {_count_sql(_N["FRONT_HAN"])} AS h, {_count_sql(_N["FRONT_LATIN"])} AS l, {_count_sql(_N["CSS"])} AS s,
  {_count_sql(_N["LEGAL"])} AS g, {_count_sql(_N["PAY_SHELL"])} AS y, {_count_sql("[{};:]")} AS dots FROM (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '{_SP}+', ' ', 'g'), '^{_SP}+|{_SP}+$', '', 'g') AS t FROM documents))""")
def _(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", Q.is_intro(t).alias("intro"), Q.is_book_front_matter(t).alias("front"), Q.is_css_noise(t).alias("css"), Q.is_legal_footer(t).alias("legal"), Q.is_paywall_shell(F.lit(""), t).alias("shell"))


@_add("k8_sample_titles", f"""WITH l AS (SELECT *, NOT regexp_matches(title, '{_QUALITY["UTILITY"]}') AND (regexp_matches(title, '{_QUALITY["TITLE_NUMBERED"]}') OR regexp_matches(url, '{_QUALITY["CHAPTER_ADDRESS"]}')) AS good FROM ({_LISTS})),
  m AS (SELECT *, bool_or(good) OVER (PARTITION BY list_id) AS hit FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY page_id) AS no FROM m WHERE good OR NOT hit)
  SELECT list_id, string_agg(title, '|' ORDER BY no) AS titles FROM r WHERE no <= 5 GROUP BY list_id""")
def _(spark, d):
    return Q.sample_titles(_lists(spark, d)).select("list_id", F.array_join("titles", "|").alias("titles"))


_SITES = "SELECT id AS site_id, CASE id % 4 WHEN 0 THEN 'PAYWALL_BLOCKED' WHEN 1 THEN 'AUTH_REQUIRED' ELSE 'OK' END AS status, CASE WHEN id % 7 = 0 THEN ' ' ELSE title END AS title, id % 50 AS detail_len, (id * 7) % 400 AS content_len, id % 5 AS n_toc, id % 3 = 0 AS has_next FROM v_books"


def _sites(spark, d):
    b = S.books(spark, d)
    i = F.col("id")
    return b.select(i.alias("site_id"), F.when(i % 4 == 0, "PAYWALL_BLOCKED").when(i % 4 == 1, "AUTH_REQUIRED").otherwise("OK").alias("status"), F.when(i % 7 == 0, " ").otherwise(F.col("title")).alias("title"), (i % 50).alias("detail_len"), ((i * 7) % 400).alias("content_len"), (i % 5).alias("n_toc"), (i % 3 == 0).alias("has_next"))


_CHECKED = f"""WITH s AS (SELECT *, CASE WHEN status = 'PAYWALL_BLOCKED' THEN site_id % 3 <> 0 AND site_id % 2 = 0 ELSE status = 'AUTH_REQUIRED' AND site_id % 3 <> 0 AND site_id % 6 = 1 END AS allowed FROM ({_SITES})),
  k AS (SELECT *, trim(title) <> '' AS basic_info, n_toc >= 2 OR allowed AS toc, detail_len >= 20 OR allowed AS detail_content, content_len >= 180 OR allowed AS chapter_content, has_next OR n_toc >= 2 OR allowed AS navigation, status = 'OK' OR allowed AS paywall_or_auth FROM s)"""


def _checked(spark, d):
    b = S.books(spark, d).where("id % 3 <> 0")
    return Q.site_checks(_sites(spark, d), b.select(F.col("id").alias("site_id"), (F.col("id") % 6 == 1).alias("requires_login"), F.array(F.lit("PAYWALL_BLOCKED")).alias("expected_codes")))


@_add("q1_site_checks", f"{_CHECKED} SELECT site_id, basic_info, toc, detail_content, chapter_content, detail_content AND chapter_content AS content, navigation, paywall_or_auth FROM k")
def _(spark, d):
    return _checked(spark, d).select("site_id", *Q.CHECKS)


_REASONS = "concat_ws(',', CASE WHEN NOT basic_info THEN 'basic_info' END, CASE WHEN NOT toc THEN 'toc' END, CASE WHEN NOT detail_content THEN 'detail_content' END, CASE WHEN NOT chapter_content THEN 'chapter_content' END, CASE WHEN NOT (detail_content AND chapter_content) THEN 'content' END, CASE WHEN NOT navigation THEN 'navigation' END, CASE WHEN NOT paywall_or_auth THEN 'paywall_or_auth' END)"
_ISSUES = "concat_ws(',', CASE WHEN basic_info AND trim(title) = '' THEN 'info_without_title' END, CASE WHEN toc AND n_toc <= 0 THEN 'toc_without_entries' END, CASE WHEN detail_content AND detail_len < 40 THEN 'detail_without_text' END, CASE WHEN chapter_content AND content_len < 80 THEN 'chapter_without_text' END, CASE WHEN navigation AND NOT has_next THEN 'navigation_without_link' END)"


@_add("q4_failure_reasons", f"{_CHECKED} SELECT site_id, {_REASONS} AS reasons FROM k")
def _(spark, d):
    return _checked(spark, d).select("site_id", F.array_join(Q.failure_reasons(), ",").alias("reasons"))


@_add("s10_site_table", f"{_CHECKED} SELECT site_id, basic_info, toc, detail_content, chapter_content, detail_content AND chapter_content AS content, navigation, paywall_or_auth, status, {_REASONS} AS reasons, {_ISSUES} AS issues, {_REASONS} = '' AND {_ISSUES} = '' AS passed FROM k")
def _(spark, d):
    return Q.site_table(_checked(spark, d))


@_add("q3_consistency_issues", f"""SELECT site_id, concat_ws(',', CASE WHEN trim(title) = '' THEN 'info_without_title' END, CASE WHEN n_toc <= 0 THEN 'toc_without_entries' END, CASE WHEN detail_len < 40 AND site_id % 11 > 0 THEN 'detail_without_text' END,
  CASE WHEN content_len < 80 AND NOT (site_id % 5 = 0 AND status <> 'OK') AND site_id % 13 > 0 THEN 'chapter_without_text' END, CASE WHEN NOT has_next AND site_id % 7 > 1 THEN 'navigation_without_link' END) AS issues FROM ({_SITES})""")
def _(spark, d):
    """What a report would claim if every check were said to hold."""
    i = F.col("site_id")
    claimed = _sites(spark, d).select("*", *[F.lit(True).alias(c) for c in Q.CHECKS], (i % 5 == 0).alias("requires_login"), F.when(i % 11 == 0, "some").alias("detail_excerpt"), F.when(i % 13 == 0, "x" * 20).otherwise("x" * 19).alias("chapter_excerpt"), F.when(i % 7 == 0, "PAYWALL(expected_block)").when(i % 7 == 1, "toc_adjacent_ok").otherwise("no").alias("nav_probe"))
    return claimed.select("site_id", F.array_join(Q.consistency_issues(claimed), ",").alias("issues"))


@_add("q6_chapter_titles", "SELECT book_id, order_index, CASE WHEN order_index % 3 = 0 THEN concat('toc ', order_index) WHEN order_index % 3 = 1 THEN concat('Chapter ', order_index) ELSE title END AS title FROM v_items")
def _(spark, d):
    k, i = F.col("order_index") % 3, F.col("order_index")
    chosen = Q.chapter_title_of(F.when(k == 0, F.concat(F.lit("toc "), i)).otherwise(" "), F.when(k == 1, F.concat(F.lit("Chapter "), i)).otherwise("page"), F.col("title"))
    return S.items(spark, d).select("book_id", "order_index", chosen.alias("title"))


@_add("q7_book_titles", "SELECT id, CASE id % 4 WHEN 0 THEN concat('c', id) WHEN 1 THEN title WHEN 2 THEN group_id ELSE id::VARCHAR END AS title FROM v_books")
def _(spark, d):
    k, i = F.col("id") % 4, F.col("id").cast("string")
    chosen = Q.book_title_of(F.when(k == 0, F.concat(F.lit("c"), i)), F.when(k == 1, F.col("title")).otherwise(" "), F.when(k == 2, F.col("group_id")), i)
    return S.books(spark, d).select("id", chosen.alias("title"))


@_add("g2_throttled_progress", """WITH RECURSIVE e AS (SELECT book_id, item_id, line_index, updated_at, epoch_ms(updated_at) AS ms, CASE WHEN item_id % 50 = 0 THEN 'pause' ELSE 'tick' END AS reason, row_number() OVER (PARTITION BY book_id ORDER BY updated_at, item_id) AS no FROM v_feed),
  r AS (SELECT book_id, no, TRUE AS ok, ms AS last_ms, line_index AS last_line FROM e WHERE no = 1
    UNION ALL SELECT book_id, no, ok, CASE WHEN ok THEN ms ELSE last_ms END, CASE WHEN ok THEN line_index ELSE last_line END FROM (
      SELECT e.book_id, e.no, e.ms, e.line_index, r.last_ms, r.last_line, e.reason = 'pause' OR (e.line_index <> r.last_line AND (e.ms - r.last_ms >= 1500 OR abs(e.line_index - r.last_line) >= 60)) AS ok FROM r JOIN e ON e.book_id = r.book_id AND e.no = r.no + 1))
  SELECT e.book_id, e.item_id, e.line_index, e.reason FROM e JOIN r USING (book_id, no) WHERE r.ok""")
def _(spark, d):
    feed = S.progress_feed(spark, d).withColumn("reason", F.when(F.col("item_id") % 50 == 0, "pause").otherwise("tick"))
    return G.throttle(feed, 10).select("book_id", "item_id", "line_index", "reason")


@_add("s1_text_files", "SELECT source, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS n_bytes, true AS named FROM documents GROUP BY source")
def _(spark, d):
    """The texts of each source written as whole files, and scanned as such."""
    folder = f"{scratch_folder(spark)}/texts-{uuid.uuid4()}"
    S.table(spark, d, "documents").select("source", F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("source").option("lineSep", "\n").text(folder)
    files = B.scan_text_files(spark, f"{folder}/*/*.txt")
    name = F.nullif(F.regexp_extract("path", "/source=([^/]*)/", 1), F.lit("__HIVE_DEFAULT_PARTITION__"))
    sums = files.select(name.alias("source"), F.length("content").cast("long").alias("n"), (F.col("title").startswith("part-") & ~F.col("title").endswith(".txt")).alias("ok"))
    return sums.groupBy("source").agg(F.sum("n").alias("n_bytes"), F.bool_and("ok").alias("named"))


@_add("s6_front_matter", r"""WITH m AS (SELECT page_id, ['cover', 'ch1', 'nav-x', 'c', 'Toc', 'b', 'discover'][1 + page_id % 7] AS idref, ['a/x.html', 'a/contents.html', 'covers.html'][1 + page_id % 3] AS href, CASE WHEN page_id % 11 = 0 THEN 'application/x-dtbncx+xml' ELSE 'text/html' END AS media, CASE WHEN page_id % 13 = 0 THEN ' Contents ' ELSE 'One' END AS title, CASE WHEN page_id % 5 = 0 THEN 'Table  of Contents' ELSE html END AS text, page_id % 6 AS position FROM pages)
  SELECT page_id, position <= 3 AND (regexp_matches(lower(idref), '\b(cover|toc|nav|contents)\b') OR regexp_matches(href, '\b(cover|toc|nav|contents?)\b') OR contains(media, 'x-dtbncx') OR trim(title) = 'Contents' OR (length(trim(text)) BETWEEN 1 AND 260 AND regexp_matches(lower(text), 'contents'))) AS is_front FROM m""")
def _(spark, d):
    k = F.col("page_id")
    one_of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))
    front = B.is_front_matter(
        one_of(("cover", "ch1", "nav-x", "c", "Toc", "b", "discover")), one_of(("a/x.html", "a/contents.html", "covers.html")), F.when(k % 11 == 0, B.NCX).otherwise("text/html"),
        F.when(k % 13 == 0, " Contents ").otherwise("One"), F.when(k % 5 == 0, "Table  of Contents").otherwise(F.col("html")), k % 6,
    )
    return S.table(spark, d, "pages").select("page_id", front.alias("is_front"))


@_add("k2_last_read", "SELECT b.id, b.title, l.updated_at AS read_at FROM v_books b LEFT JOIN v_latest l ON l.book_id = b.id ORDER BY coalesce(l.updated_at, b.updated_at) DESC NULLS LAST, b.id LIMIT 20")
def _(spark, d):
    shelf = L.list_books(S.books(spark, d), L.latest_progress(S.progress_feed(spark, d)))
    return L.order_by_recency(shelf).limit(20).select("id", "title", "read_at")


@_add("t15_least_length", "SELECT doc_id, CASE WHEN doc_id % 400 > 0 AND doc_id % 3 > 0 THEN least(200, greatest(60, floor(doc_id % 400 * 0.95 + 0.5)))::INT ELSE 200 END AS least FROM documents")
def _(spark, d):
    said = F.when(F.col("doc_id") % 3 > 0, F.concat(F.when(F.col("doc_id") % 2 > 0, "本章字数：").otherwise("字数 : "), (F.col("doc_id") % 400).cast("string"))).otherwise("")
    return _docs(spark, d).select("doc_id", X.least_length(F.concat(F.coalesce("text", F.lit("")), said)).alias("least"))
