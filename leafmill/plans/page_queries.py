"""Queries over blocks and main texts of pages; `registry` imports this module last."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as X, html as H
from ..sources import tables as S
from .registry import _VIS, _add

_NOISE = " OR ".join([f"tag IN {X.NOISE_TAGS}"] + ["regexp_matches(raw, '" + p.replace("'", "''") + "')" for p in (X.NOISE_ROLE, X.NOISE_CLASS, X.NOISE_PART, X.NOISE_CLASS_PART)])
_PLAIN = "raw"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_a}', '{_b}')"
_TOKENS = rf"""
  WITH a AS (SELECT page_id, unnest(regexp_extract_all({_VIS}, '<[^>]+>|[^<]+')) AS raw, generate_subscripts(regexp_extract_all({_VIS}, '<[^>]+>|[^<]+'), 1) - 1 AS pos FROM pages),
  b AS (SELECT *, CASE WHEN starts_with(raw, '</') THEN 'close' WHEN starts_with(raw, '<') THEN 'open' ELSE 'text' END AS kind, lower(regexp_extract(raw, '^</?([A-Za-z0-9]+)', 1)) AS tag FROM a),
  c AS (SELECT *, (kind = 'open' AND tag IN {X.CONTAINERS})::INT AS opens, (kind = 'close' AND tag IN {X.CONTAINERS})::INT AS closes,
    CASE WHEN kind = 'text' THEN trim(regexp_replace({_PLAIN}, '[\s ]+', ' ', 'g')) ELSE '' END AS text FROM b),
  d AS (SELECT *, CASE WHEN opens + closes > 0 THEN sum(opens - closes) OVER w + closes END AS level, CASE WHEN opens = 1 AND ({_NOISE}) THEN 1 ELSE 0 END AS mark FROM c WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
  e AS (SELECT *, CASE WHEN closes = 1 THEN coalesce(lag(mark) OVER (PARTITION BY page_id, level ORDER BY pos), 0) ELSE 0 END AS open_mark FROM d),
  t AS (SELECT *, sum(mark - open_mark) OVER (PARTITION BY page_id ORDER BY pos) > 0 OR mark = 1 AS noise, sum(CASE WHEN kind = 'open' AND tag = 'a' THEN 1 WHEN kind = 'close' AND tag = 'a' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) > 0 AS in_link FROM e)"""
_BLOCKS = f"""{_TOKENS},
  s AS (SELECT *, sum(length(text)) OVER w AS c_text, sum(CASE WHEN in_link THEN length(text) ELSE 0 END) OVER w AS c_link, sum((kind = 'open' AND tag = 'p')::INT) OVER w AS c_p, sum(len(regexp_extract_all(text, '{X.SENTENCE}'))) OVER w AS c_dots FROM t WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
  u AS (SELECT *, max(pos) OVER p AS z_pos, max(c_text) OVER p AS z_text, max(c_link) OVER p AS z_link, max(c_p) OVER p AS z_p, max(c_dots) OVER p AS z_dots FROM s WINDOW p AS (PARTITION BY page_id)),
  v AS (SELECT *, coalesce(lead(pos) OVER l, z_pos) AS fin, coalesce(lead(c_text) OVER l, z_text) - c_text AS b_text, coalesce(lead(c_link) OVER l, z_link) - c_link AS b_link, coalesce(lead(c_p) OVER l, z_p) - c_p AS b_p, coalesce(lead(c_dots) OVER l, z_dots) - c_dots AS b_dots FROM u WINDOW l AS (PARTITION BY page_id, level ORDER BY pos)),
  k AS (SELECT *, CASE WHEN opens = 1 AND tag IN {X.TEXT_BLOCKS} AND b_text >= 80 AND b_link::DOUBLE / b_text <= 0.65 THEN b_text::DOUBLE * (1 - least(b_link::DOUBLE / b_text, 0.95::DOUBLE)) + b_p * 180 + b_dots * 80 END AS score FROM v)"""


def _pages(spark, d):
    return S.spread(S.table(spark, d, "pages"))


@_add("x2_block_levels", f"{_TOKENS} SELECT page_id, pos::INT AS pos, tag, level::BIGINT AS level, noise FROM t WHERE opens + closes > 0")
def _(spark, d):
    return X.block_tokens(_pages(spark, d)).where("opens + closes > 0").select("page_id", "pos", "tag", F.col("level").cast("long").alias("level"), "noise")


@_add("x4_text_without_noise", f"{_TOKENS} SELECT page_id, count(*) FILTER (text <> '') AS n, sum(length(text))::BIGINT AS chars FROM t WHERE NOT noise GROUP BY page_id")
def _(spark, d):
    kept = X.block_tokens(_pages(spark, d)).where(~F.col("noise"))
    return kept.groupBy("page_id").agg(F.count_if(F.col("text") != "").alias("n"), F.sum(F.length("text")).alias("chars"))


@_add("a5_block_scores", f"{_BLOCKS} SELECT page_id, pos::INT AS pos, fin::INT AS fin, round(score, 6) AS score FROM k WHERE score IS NOT NULL")
def _(spark, d):
    return X.blocks(_pages(spark, d)).select("page_id", "pos", F.col("end").alias("fin"), F.round("score", 6).alias("score"))


_BREAKS = "('p', 'br', 'div', 'h1', 'h2', 'h3', 'li', 'section', 'article')"
_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), '^[\s　 ﻿]+|[\s　 ﻿]+$', '', 'g')"
_BEST = f"""{_BLOCKS}, m AS (SELECT page_id, pos AS start, fin, score, b_p FROM k WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) = 1),
  g AS (SELECT m.page_id, start, m.fin, m.score, m.b_p, coalesce(string_agg(CASE WHEN text <> '' THEN text ELSE chr(10) END, ' ' ORDER BY pos) FILTER (NOT noise AND (text <> '' OR tag IN {_BREAKS})), '') AS c FROM m JOIN k ON k.page_id = m.page_id AND pos BETWEEN start AND m.fin GROUP BY ALL),
  best AS (SELECT page_id, start::INT AS start, fin::INT AS fin, b_p::BIGINT AS n_p, {_NORMAL.format("regexp_replace(c, ' *' || chr(10) || ' *', chr(10), 'g')")} AS content FROM g)"""


@_add("x6_best_text", f"{_BEST} SELECT * FROM best")
def _(spark, d):
    return X.best_text(_pages(spark, d)).select("page_id", "start", F.col("end").alias("fin"), "n_p", "content")


@_add("a6_candidate_scores", rf"""{_BEST}, l AS (SELECT *, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM best)
  SELECT page_id, round(CASE WHEN length(content) < 200 THEN -1 ELSE (log10(length(content) + 10.0::DOUBLE) * 100 + least(n_p, 50) * 2.5::DOUBLE + least(len(regexp_extract_all(content, '{X.SENTENCE}')), 120) * 1.2::DOUBLE)
    * (1 - least(0.55::DOUBLE, least(1.0::DOUBLE, len(regexp_extract_all(content, '(?i)https?://|www\.'))::DOUBLE / 22) * 0.85::DOUBLE + CASE WHEN len(lines) = 0 THEN 1 ELSE len(list_filter(lines, lambda x: length(x) < 12))::DOUBLE / len(lines) END * 0.35::DOUBLE)) END, 6) AS score FROM l""")
def _(spark, d):
    return X.best_text(_pages(spark, d)).select("page_id", F.round(X.candidate_score(F.col("content"), F.col("n_p"), F.lit(False)), 6).alias("score"))


@_add("x7_structured_text", rf"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('Og ', page_id) WHEN 1 THEN concat('Tw & ', page_id) ELSE {_NORMAL.format(_PLAIN.replace("raw", "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} END AS title,
  array_to_string(list_filter([CASE WHEN page_id % 4 < 2 THEN concat('A "long" text of the page with number', chr(10), page_id) END, CASE WHEN page_id % 4 = 1 THEN concat('A headline that is inside of ', page_id, ' and long') END, CASE WHEN page_id % 5 = 0 THEN concat('about ', page_id) END], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS content FROM pages""")
def _(spark, d):
    """Pages with titles for other sites, nested data, a block that is no JSON, and a description."""
    i, k = F.col("page_id").cast("string"), F.col("page_id")
    say = lambda keep, *parts: F.when(keep, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")
    made = F.concat(
        say(k % 3 == 0, '<meta content="Og ', i, '" property="og:title">'), say(k % 3 == 1, "<meta name='twitter:title' content='Tw &amp; ", i, "'>"), say(k % 5 == 0, '<meta name="description" content=" about ', i, '">'),
        F.lit('<script type="application/ld+json">{"text": "no JSON, but thirty signs long at least",,}</script>'),
        say(k % 4 < 2, '<script type="application/ld+json">{"@graph":[{"articleBody" : "A \\"long\\" text of the page with number\\n', i, '","name":"short"}', F.when(k % 4 == 1, F.concat(F.lit(',{"x":{"headline":"A headline that is inside of '), i, F.lit(' and long"}}'))).otherwise(""), "]}</script>"),
    )
    html = F.concat(made, F.col("html"))
    return _pages(spark, d).select("page_id", X.structured_title(html, H.page_title(html)).alias("title"), X.structured_text(html).alias("content"))


@_add("x7_walked_text", """SELECT page_id, array_to_string(list_filter([
  CASE WHEN page_id % 3 = 0 THEN concat('The body of the article number ', page_id, ', "quoted" \\ and long') END, concat('A description that comes behind it: ', page_id), concat('The headline, which comes even later: ', page_id),
  CASE WHEN page_id % 2 = 0 THEN concat('A part inside of an array inside of ', page_id) END, CASE WHEN page_id % 2 = 0 THEN concat('The name of the second part of page ', page_id) END, concat('An author, whose name is very long: ', page_id)], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS content FROM pages""")
def _(spark, d):
    """Graphs whose objects tell fields out of order, before, between and behind values that hold more; arrays of strings are no field."""
    i, k = F.col("page_id").cast("string"), F.col("page_id")
    body = F.when(k % 3 == 0, F.concat(F.lit('"articleBody":"The body of the article number '), i, F.lit(', \\"quoted\\" \\\\ and long",'))).otherwise('"articleBody":["a string of an array which is longer than thirty signs"],')
    parts = F.when(k % 2 == 0, F.concat(F.lit('{"text":"A part inside of an array inside of '), i, F.lit('"},"a stray string that is longer than thirty signs",[{"name":"The name of the second part of page '), i, F.lit('"}]'))).otherwise("")
    made = F.concat(
        F.lit('<script type="application/ld+json">{"@context":"x","@graph":[ {"headline" : "The headline, which comes even later: '), i, F.lit('", "hasPart":['), parts, F.lit('],'), body,
        F.lit('"n":[1,{"text":null,"name":7}],"author":{"name":"An author, whose name is very long: '), i, F.lit('","text":"short"},"description":"A description that comes behind it: '), i, F.lit('"}]}</script>'),
    )
    return _pages(spark, d).select("page_id", X.structured_text(made).alias("content"))


@_add("x8_large_pages", r"""SELECT page_id, len(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)^.*?<body[^>]*>', ''), '(?s)<!--.*?-->', '', 'g'), '<[A-Za-z]')) > 60 AS too_large FROM pages""")
def _(spark, d):
    return X.extract_pages(_pages(spark, d), most_elements=60).select("page_id", (F.col("status") == "DOM_TOO_LARGE").alias("too_large"))


@_add("x8_extract_pages")
def _(spark, d):
    pages = _pages(spark, d)
    return X.extract_pages(pages).withColumn("score", F.round("score", 6))


@_add("x8_ruled_pages", """SELECT page_id, CASE WHEN page_id % 3 = 2 THEN 'NO_MAIN_CONTENT' ELSE 'OK' END AS status, CASE WHEN page_id % 3 <> 2 THEN concat('Chapter ', page_id, chr(10), chr(10), repeat('A sentence of the text. ', 12), 'end') END AS content FROM pages""")
def _(spark, d):
    """Pages with a menu before the heading and a footer; on every third, the rule leaves too little."""
    i = F.col("page_id").cast("string")
    short = F.when(F.col("page_id") % 3 == 2, "gone ").otherwise("A sentence of the text. ")
    body = F.concat(F.lit("<p>share</p><p>menu of the site</p><p>Chapter "), i, F.lit("</p><p>"), F.repeat(short, F.lit(12)), F.lit("end</p><p>Copyright "), F.repeat(F.lit("x. "), F.lit(80)), F.lit("</p>"))
    pages = _pages(spark, d).select("page_id", F.concat(F.lit("https://www.rule.example/"), i).alias("url"), F.concat(F.lit("<html><body><article>"), body, F.lit("</article></body></html>")).alias("html"))
    rules = spark.sql("SELECT 'rule.example' AS host_suffix, CAST(NULL AS STRING) AS path_regex, 1 AS rule_order, '^(login|share)$' AS drop_line_regex, array('AD') AS drop_phrases, 'Chapter [0-9]+' AS heading_regex, 'Copyright' AS footer_regex")
    return X.extract_pages(pages, rules=rules).select("page_id", "status", "content")

@_add("x9_region_text")
def _(spark, d):
    article = F.regexp_extract("html", r"(?is)<article\b[^>]*>(.*)</article>", 1)
    return _pages(spark, d).select("page_id", X.region_text(article).alias("content"))


@_add("f14_foreign_iframes", """SELECT page_id, page_id % 3 = 1 AND page_id % 2 = 0 AS flag FROM pages""")
def _(spark, d):
    frame = F.when(F.col("page_id") % 3 == 1, '<iframe src="https://frames.example.invalid/a"></iframe>').when(F.col("page_id") % 3 == 2, '<iframe src="/a"></iframe>').otherwise("")
    return _pages(spark, d).select("page_id", X.has_foreign_iframe(F.concat("html", frame), F.col("url"), F.when(F.col("page_id") % 2 == 0, 10).otherwise(1000)).alias("flag"))


_RULES = "(VALUES ('net', 1, 'example.net', CAST(NULL AS {0})), ('en', 2, 'example.com', '/en/'), ('fr', 3, 'com', '/fr/[0-9]*5'))"
_RULE_ROWS = "SELECT col1 AS rule_id, col2 AS rule_order, col3 AS host_suffix, col4 AS path_regex FROM VALUES ('net', 1, 'example.net', CAST(NULL AS STRING)), ('en', 2, 'example.com', '/en/'), ('fr', 3, 'com', '/fr/[0-9]*5')"


@_add("j6_match_rules", f"""SELECT page_id, rule_id FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
  JOIN {_RULES.format('VARCHAR')} r(rule_id, o, suffix, pattern) ON (host = suffix OR ends_with(host, '.' || suffix)) AND (pattern IS NULL OR regexp_matches(path, pattern))""")
def _(spark, d):
    return X.match_rules(_pages(spark, d), spark.sql(_RULE_ROWS)).select("page_id", "rule_id")


@_add("t13_site_rules", r"""SELECT page_id, CASE WHEN lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) LIKE '%.example.net' THEN concat('Chapter ', page_id, chr(10), 'body x') ELSE concat('menu', chr(10), 'Chapter ', page_id, chr(10), 'body AD x', chr(10), 'Copyright ', page_id) END AS content FROM pages""")
def _(spark, d):
    rules = spark.sql("SELECT 'example.net' AS host_suffix, CAST(NULL AS STRING) AS path_regex, 1 AS rule_order, '^(login|share)$' AS drop_line_regex, array('AD') AS drop_phrases, 'Chapter [0-9]+' AS heading_regex, 'Copyright' AS footer_regex")
    text = F.concat(F.lit("menu\nChapter "), "page_id", F.lit("\nbody AD x\nCopyright "), "page_id")
    pages = _pages(spark, d)
    return X.apply_rules(pages.select("page_id", text.alias("content")), X.match_rules(pages, rules))
