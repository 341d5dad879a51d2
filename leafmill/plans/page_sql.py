"""SQL of the queries over page texts, links and ways between pages; `registry` imports this module last."""

from __future__ import annotations

from ..operators import classify as K, links as N, navigation as V, reading as R, extract as X, html as H, titles as T  # noqa: F401
from .page_queries import _BEST
from .registry import _CHAPTERS, _LISTS, _VIS, _WRAP, _put


def quoted(text: str) -> str:
    return text.replace("'", "''")


def hit(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{quoted(pattern)}')"


def any_of(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{quoted(w)}')" for w in words) + ")"


def n_of(column: str, words) -> str:
    return "(" + " + ".join(f"contains({column}, '{quoted(w)}')::INT" for w in words) + ")"


def unescaped(t: str) -> str:
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = f"replace({t}, '{a}', '{b}')"
    return t


def normal(t: str) -> str:
    t = f"replace({t}, chr(13) || chr(10), chr(10))"
    for a, b in ((r"[ \t]+\n", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)"), (r"[ \t]{2,}", "' '")):
        t = f"regexp_replace({t}, '{a}', {b}, 'g')"
    return rf"regexp_replace({t}, '^[\s　 ﻿]+|[\s　 ﻿]+$', '', 'g')"


def bare(t: str, by: str = " ") -> str:
    return f"regexp_replace({t}, '<[^>]+>', '{by}', 'g')"


# pages with the parts that classifiers look at: a table p(page_id, url, html) becomes f
_PARTS = rf"""v AS (SELECT page_id, url, html, {_VIS} AS seen FROM p),
  f AS (SELECT page_id, url, html, {normal(unescaped("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title, {normal(unescaped(bare("regexp_replace(seen, '(?is)<head\\b.*?</head>', '', 'g')")))} AS body,
    list_filter(list_transform(string_split_regex(seen, '(?i)<p\b[^>]*>')[2:], lambda x: {normal(unescaped(bare("regexp_extract(x, '(?is)^(.*?)(</p>|</?div|</article|</section|$)', 1)")))}), lambda x: x <> '') AS ps,
    regexp_extract_all(seen, '{H.LINK}') AS links, len(regexp_extract_all(seen, '(?i)<p\b'))::BIGINT AS n_p FROM v)"""
_RAW = "p AS (SELECT page_id, url, html FROM pages)"

_put("x5_page_text", f"WITH {_RAW}, {_PARTS} SELECT page_id, title, body, len(ps)::INT AS n_paragraphs FROM f")

_NO_LONG = "len(list_filter(ps, lambda x: length(x) >= 120)) = 0"


def _blocked(words, strong) -> str:
    return f"({any_of('lower(body)', words)} AND {_NO_LONG} AND ({n_of('lower(body)', strong)} >= 2 OR length(body) < 280))"


_PASSWORD = r"(?i)<input\b[^>]*type=[\"']?password"
_LOGIN = r"(?i)<form\b[^>]*(action|id|class)=[\"'][^\"'>]*login"
_MASK = (r"(?i)(class|id)=[\"'][^\"'>]*paywall", r"(?i)class=[\"'][^\"'>]*(vip|subscribe|blur)", r"(?i)style=[\"'][^\"'>]*filter: blur")
_STATUS = f"""CASE WHEN {any_of("lower(body)", K.ANTI_BOT)} OR {hit("html", K.CAPTCHA)} OR {hit("html", K.SLIDER)} OR {any_of("lower(html)", K.WAF)} THEN 'ANTI_BOT_OR_BLOCKED'
  WHEN {hit("lower(title)", chr(92) + "b404" + chr(92) + "b")} OR {any_of("lower(title)", K.NOT_FOUND_TITLE)} OR {any_of("lower(body)", K.NOT_FOUND_TITLE)} AND length(body) < 260 THEN 'SITE_NOT_FOUND'
  WHEN {any_of("lower(concat(title, ' ', body))", K.REMOVED_STRONG)} OR {any_of("lower(concat(title, ' ', body))", K.REMOVED_WEAK)} AND length(body) < 280 AND {_NO_LONG} THEN 'CONTENT_REMOVED'
  WHEN {hit("html", _PASSWORD)} OR {hit("html", _LOGIN)} OR {_blocked(K.AUTH, K.AUTH_STRONG)} THEN 'AUTH_REQUIRED'
  WHEN {" OR ".join(hit("html", m) for m in _MASK)} OR {_blocked(K.PAY, K.PAY_STRONG)} THEN 'PAYWALL_BLOCKED' ELSE 'OK' END"""
_put("f6_access_status", f"WITH {_RAW}, {_PARTS} SELECT page_id, {_STATUS} AS status FROM f")
_put("q8_status_by_host", f"WITH {_RAW}, {_PARTS} SELECT lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host, {_STATUS} AS status, count(*) AS n FROM f GROUP BY ALL")

_LINK_TEXT = normal(unescaped("array_to_string(list_transform(links, lambda x: regexp_replace(x, '<[^>]+>', '', 'g')), ' ')"))
_DIRECTORY = f"(len(links) >= 18 AND CASE WHEN length(body) > 0 THEN length({_LINK_TEXT})::DOUBLE / length(body) ELSE 1 END >= 0.55 AND n_p <= 5)"
_put("f12_directory_pages", f"WITH {_RAW}, {_PARTS} SELECT page_id, {_DIRECTORY} AS is_directory FROM f")

# the links of p: a(page_id, url, pos, text, abs_url); their addresses are from the root, absolute or empty
_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"
_ANCHORS = rf"""w AS (SELECT page_id, url, unnest(regexp_extract_all({_VIS}, '{H.LINK}')) AS a, generate_subscripts(regexp_extract_all({_VIS}, '{H.LINK}'), 1) - 1 AS pos FROM p),
  h AS (SELECT page_id, url, pos::INT AS pos, {normal(unescaped(bare("a", "")))} AS text, {unescaped("regexp_extract(a, '(?is)^<a" + chr(92) + "b[^>]*?" + chr(92) + "bhref=[" + chr(34) + "'']?([^" + chr(34) + "''" + chr(92) + "s>]*)', 1)")} AS href FROM w),
  a AS (SELECT page_id, url, pos, text, href, CASE WHEN href = '' THEN '' WHEN starts_with(href, '/') THEN {_ORIGIN} || href ELSE href END AS abs_url FROM h)"""


def fingerprint(u: str) -> str:
    path = f"regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1)"
    kept = rf"list_filter(string_split(regexp_extract({u}, '^[^?#]*\?([^#]*)', 1), '&'), lambda z: z <> '' AND NOT regexp_matches(split_part(z, '=', 1), '(?i)^utm_|^spm$|^from$|^ref$'))"
    return f"concat(regexp_extract({u}, '^(https?://[^/?#]*)', 1), CASE WHEN {path} = '' THEN '/' ELSE {path} END, CASE WHEN len({kept}) > 0 THEN '?' || array_to_string(list_sort({kept}), '&') ELSE '' END)"


_put("a4_page_features", f"""WITH {_RAW}, {_PARTS} SELECT page_id, len(links)::BIGINT AS n_anchors, n_p, length({_LINK_TEXT})::BIGINT AS link_len, length(body)::BIGINT AS text_len, len(regexp_extract_all(body, '[。！？.!?]'))::BIGINT AS n_sentences FROM f""")
_put("x3_anchors", f"WITH {_RAW}, {_ANCHORS} SELECT page_id, pos, text, href, abs_url FROM a")
_NEXT_PAGE = "(?i)(下一页|next|>>|›)"
_put("f15_pagination_hint", rf"""WITH {_RAW}, {_ANCHORS} SELECT page_id, bool_or(regexp_matches(text, '^\d+\s*/\s*\d+$') OR regexp_matches(text, '第?\s*\d+\s*页') OR {hit("text", _NEXT_PAGE)}) AS has_pagination,
  arg_min(abs_url, pos) FILTER ({hit("text", _NEXT_PAGE)}) AS next_page_url FROM a WHERE text <> '' AND abs_url <> '' GROUP BY page_id""")


def like_text(t: str) -> str:
    return f"(trim({t}) <> '' AND length(trim({t})) <= 80 AND NOT {hit(f'trim({t})', N.STOP)} AND ({hit(f'trim({t})', N.NUMBERED)} OR length(trim({t})) <= 24))"


def like_href(u: str) -> str:
    path = f"lower(regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1))"
    return f"(regexp_matches({path}, '/(chapter|reader|read|content)\\b') OR regexp_matches({path}, '/\\d{{5,}}[-_]\\d{{1,6}}') OR regexp_matches(lower({u}), '[?&](chapterid|cid|chapter|chapter_id)=-?\\d+(&|#|$)'))"


_CHAPTER_LINKS = f"""k AS (SELECT page_id, pos, text AS title, abs_url AS url FROM a WHERE {like_text("text")} AND abs_url <> '' QUALIFY row_number() OVER (PARTITION BY page_id, {fingerprint("abs_url")} ORDER BY pos) = 1),
  c AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 500)"""
_put("a14_chapter_links", f"WITH {_RAW}, {_ANCHORS}, {_CHAPTER_LINKS} SELECT * FROM c")
_put("w4_toc_next", f"WITH {_RAW}, {_ANCHORS}, {_CHAPTER_LINKS} SELECT *, lead(url) OVER w AS next_url, lead(title) OVER w AS next_title FROM c WINDOW w AS (PARTITION BY page_id ORDER BY pos)")
_put("a9_best_url_group", rf"""WITH {_RAW}, {_ANCHORS}, g AS (SELECT page_id, regexp_replace(regexp_replace(abs_url, '[?#].*$', ''), '\d+', '#', 'g') AS signature, count(*) + 2 * count(*) FILTER ({like_text("text")} AND {like_href("abs_url")}) AS score FROM a WHERE abs_url <> '' GROUP BY ALL)
  SELECT page_id, signature, score FROM g QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, signature DESC) = 1""")

# ---- chapters as they are read

_put("m2_reading_time", f"""WITH c AS ({_CHAPTERS}), l AS (SELECT doc_id, order_index, sum({_WRAP}) AS n FROM (SELECT doc_id, order_index, unnest(string_split(content_text, chr(10))) AS x FROM c) GROUP BY ALL)
  SELECT doc_id, order_index, ceil(n / 12)::BIGINT AS pages, (ceil(n / 12) * least(greatest(floor(60000.0::DOUBLE * 40 * 12 / 300 + 0.5), greatest(900, floor(2800.0::DOUBLE * 12 / 12 + 0.5))), 30000))::BIGINT AS ms FROM l""")
_put("w10_display_offsets", f"""WITH c AS ({_CHAPTERS}), l AS (SELECT doc_id, order_index, sum({_WRAP})::BIGINT AS n FROM (SELECT doc_id, order_index, unnest(string_split(content_text, chr(10))) AS x FROM c) GROUP BY ALL)
  SELECT doc_id, order_index, n, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_line FROM l""")


def _ordinal(t: str) -> str:
    return rf"coalesce(nullif(regexp_extract({t}, '(?i)chapter\s*([0-9]{{1,5}})', 1), ''), nullif(regexp_extract({t}, '(?:^|\s)([0-9]{{1,5}})(?:\s*[.、:：\-]|\s|$)', 1), ''))"


_TRIM = r"regexp_replace({0}, '^[\s　 ﻿]+|[\s　 ﻿]+$', '', 'g')"
_FIRST = f"coalesce(list_filter(list_transform(string_split(replace(content_text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: {_TRIM.format('x')}), lambda x: x <> '')[1], '')"
_put("t12_chapter_key", f"""WITH i AS (SELECT book_id, order_index, coalesce(title, '') AS t, {_FIRST} AS f FROM v_items)
  SELECT book_id, order_index, CASE WHEN {hit("lower(" + _TRIM.format("t") + ")", R.FRONT)} THEN concat('front:', lower({_TRIM.format("t")})) ELSE coalesce('ord:' || coalesce({_ordinal("t")}, {_ordinal("f")})::INT, concat('idx:', order_index)) END AS key FROM i""")

# ---- ways between pages, with links to the next and previous number behind each page


def _counted(step: str) -> str:
    u, shape = "regexp_replace(url, '[?#].*$', '')", r"'^(.*[-_/])(\d+)(/?|\.html)$'"
    number = f"regexp_extract({u}, {shape}, 2)::BIGINT"
    number = f"{number} + 1" if step == "next" else f"greatest(1, {number} - 1)"
    return f"CASE WHEN regexp_matches({u}, {shape}) THEN concat(regexp_extract({u}, {shape}, 1), {number}, regexp_extract({u}, {shape}, 3)) ELSE '' END"


_LINKED = f"""p AS (SELECT page_id, url, concat(html, '<a href="', {_counted("next")}, '">Next</a><a href="', {_counted("prev")}, '">上一章</a><a href="/toc">目录</a>') AS html FROM pages)"""


def _segments(u: str) -> str:
    return f"list_filter(string_split(CASE WHEN regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1) END, '/'), lambda z: z <> '')"


_HOST = "lower(regexp_extract({0}, '^https?://([^/?#:]*)', 1))"
_FOLDER = "regexp_replace(CASE WHEN regexp_extract({0}, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({0}, '^https?://[^/?#]*([^?#]*)', 1) END, '[^/]*$', '')"
_LAST = r"TRY_CAST(regexp_extract(list_filter({0}, lambda z: regexp_matches(z, '\d'))[-1], '(\d+)\D*$', 1) AS BIGINT)"
_SCORED = f"""s0 AS (SELECT page_id, url, pos, text, abs_url, {_HOST.format("url")} = {_HOST.format("abs_url")} AS near, {_FOLDER.format("url")} = {_FOLDER.format("abs_url")} AS beside, {_segments("url")} AS b, {_segments("abs_url")} AS o FROM a WHERE abs_url <> '' AND {fingerprint("abs_url")} <> {fingerprint("url")}),
  s1 AS (SELECT *, {_LAST.format("o")} - {_LAST.format("b")} AS delta, len(list_filter(range(1, least(len(b), len(o)) + 1), lambda i: b[i] = o[i])) AS same FROM s0),
  s2 AS (SELECT *, CASE WHEN near AND len(b) > 0 AND len(o) > 0 THEN floor(40.0::DOUBLE * same / greatest(len(b), len(o)) + 0.5)::INT + CASE WHEN abs(delta) = 1 THEN 35 WHEN abs(delta) <= 3 THEN 15 ELSE 0 END ELSE 0 END AS alike FROM s1),
  s AS (SELECT *, CASE WHEN {hit("text", N.NEXT)} OR {hit("text", N.PREVIOUS)} THEN 80 ELSE 0 END + CASE WHEN {hit("text", V.CHAPTER_WORD)} THEN 20 ELSE 0 END + CASE WHEN {like_href("abs_url")} THEN 26 ELSE 0 END
    + CASE WHEN near AND beside THEN 25 ELSE 0 END + alike + CASE WHEN regexp_matches(abs_url, '\\d') THEN 10 ELSE 0 END AS score FROM s2)"""
_put("r8_scored_links", f"WITH {_LINKED}, {_ANCHORS}, {_SCORED} SELECT page_id, pos, abs_url, score FROM s")


def _best(condition: str, by: str) -> str:
    return f"(SELECT struct_pack(by := {by}, url := abs_url) FROM s WHERE s.page_id = p.page_id AND {condition} ORDER BY {by} DESC, pos LIMIT 1)"


_FOUND = f"""n0 AS (SELECT page_id, url, {_best("delta = 1 AND alike >= 45", "alike")} AS nn, {_best("delta = -1 AND alike >= 45", "alike")} AS pn, {_best("score >= 60 AND " + hit("text", N.NEXT), "score")} AS nl, {_best("score >= 60 AND " + hit("text", N.PREVIOUS), "score")} AS pl,
    (SELECT arg_min(abs_url, pos) FROM a WHERE a.page_id = p.page_id AND text <> '' AND abs_url <> '' AND {hit("text", _NEXT_PAGE)}) AS more FROM p),
  n1 AS (SELECT *, CASE WHEN {fingerprint("more")} <> {fingerprint("url")} THEN more END AS other FROM n0),
  n AS (SELECT page_id, url, coalesce(nn.url, nl.url, other) AS next_url, CASE WHEN nn IS NOT NULL THEN 0.58 WHEN nl IS NOT NULL THEN least(0.88::DOUBLE, 0.52::DOUBLE + nl.by::DOUBLE / 220) WHEN other IS NOT NULL THEN 0.42 END::DOUBLE AS next_confidence,
    CASE WHEN nn IS NOT NULL THEN 'url_numeric_delta' WHEN nl IS NOT NULL THEN 'anchor_next' WHEN other IS NOT NULL THEN 'pagination_next' END AS next_reason, coalesce(pn.url, pl.url) AS prev_url,
    CASE WHEN pn IS NOT NULL THEN 0.58 WHEN pl IS NOT NULL THEN least(0.88::DOUBLE, 0.52::DOUBLE + pl.by::DOUBLE / 220) END::DOUBLE AS prev_confidence, CASE WHEN pn IS NOT NULL THEN 'url_numeric_delta' WHEN pl IS NOT NULL THEN 'anchor_prev' END AS prev_reason FROM n1)"""
_put("r9_navigation", f"WITH {_LINKED}, {_ANCHORS}, {_SCORED}, {_FOUND} SELECT * EXCLUDE (url) FROM n")

_POOL = f"""g AS (SELECT page_id, abs_url AS url, CASE WHEN text = '' THEN '下一章' ELSE left(text, 56) END AS label, least(0.88::DOUBLE, 0.48::DOUBLE + score::DOUBLE / 200) AS confidence, 'anchor_guess' AS reason, -score AS x, pos AS y FROM s
    WHERE {hit("text", N.NEXT)} OR {hit("text", V.CHAPTER_LABEL)} AND score >= 48 OR {hit("text", "(?i)next|下一篇")} AND score >= 52
    UNION ALL SELECT page_id, next_url, '系统推荐', next_confidence, next_reason, -1073741824, 0 FROM n WHERE next_url IS NOT NULL),
  o AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY page_id, {fingerprint("url")} ORDER BY x, y) = 1), q8 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY x, y) AS no FROM o QUALIFY no <= 8),
  kc AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, no))::INT AS rank, url, label, confidence, reason FROM q8 QUALIFY rank <= 6)"""
_put("k4_next_candidates", f"WITH {_LINKED}, {_ANCHORS}, {_SCORED}, {_FOUND}, {_POOL} SELECT * FROM kc")
_put("j14_neighbour_toc", f"""WITH {_LINKED}, {_ANCHORS}, {_SCORED}, {_FOUND}, u AS (SELECT page_id, list_filter([prev_url, url, next_url, {_counted("prev").replace("regexp_replace(url, '[?#].*$', '')", "url")}, {_counted("next").replace("regexp_replace(url, '[?#].*$', '')", "url")}], lambda z: z IS NOT NULL AND z <> '') AS l FROM n),
  e AS (SELECT page_id, unnest(l) AS url, generate_subscripts(l, 1) - 1 AS no FROM u), o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY page_id, {fingerprint("url")} ORDER BY no) = 1),
  k AS (SELECT {fingerprint("url")} AS fp, min({normal(unescaped("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))}) AS title FROM p GROUP BY 1) SELECT page_id, no::INT AS no, title, url FROM o JOIN k ON k.fp = {fingerprint("url")} QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY no) <= 7""")
_put("u2_rescue_toc", f"""WITH {_LINKED}, {_ANCHORS}, e AS (SELECT page_id, pos, text AS title, abs_url AS url, {like_href("abs_url")} OR {like_text("text")} AS lk FROM a),
  r AS (SELECT page_id, pos, title, url FROM e WHERE pos < 2400 AND title <> '' AND url <> '' AND lk QUALIFY row_number() OVER (PARTITION BY page_id, {fingerprint("url")} ORDER BY pos) = 1), r1 AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 120),
  m AS (SELECT page_id, count(*) AS n, count(*) FILTER (lk) AS good, (SELECT count(*) FROM r1 WHERE r1.page_id = e.page_id) AS found FROM e GROUP BY page_id), d AS (SELECT page_id, good, found >= 2 AND (good < 2 OR n >= 6 AND good::DOUBLE / n < 0.35) AS rescued FROM m)
  SELECT e.page_id, pos, title, url FROM e JOIN d USING (page_id) WHERE NOT rescued AND (lk OR good = 0) UNION ALL SELECT r1.* FROM r1 JOIN d USING (page_id) WHERE rescued""")
_META = r"""nullif(trim({0}), '')"""
_put("r13_book_facts", f"""SELECT page_id, coalesce(nullif({normal("regexp_replace(regexp_extract(html, '(?is)<h1" + chr(92) + "b[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')")}, ''), {normal(unescaped("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))}) AS title, '' AS intro, regexp_replace(url, '#.*$', '') AS url FROM pages""")

_CUT = "regexp_extract(html, '(?is)<article" + chr(92) + "b[^>]*>(.*)</article>', 1)"
for _tag in X.NOISE_TAGS:
    _CUT = f"regexp_replace({_CUT}, '(?is)<{_tag}{chr(92)}b[^>]*>.*?</{_tag}{chr(92)}s*>', '', 'g')"
_REGION = normal(unescaped(bare(f"regexp_replace({_CUT}, '(?is)<script{chr(92)}b.*?</script{chr(92)}s*>|<style{chr(92)}b.*?</style{chr(92)}s*>', '', 'g')")))
_put("x9_region_text", f"SELECT page_id, CASE WHEN length({_REGION}) >= 20 THEN {_REGION} END AS content FROM pages")

_SENTENCES = f"len(regexp_extract_all(content, '{X.SENTENCE}'))"
_SCORE = rf"""CASE WHEN length(content) < 200 THEN -1 ELSE (log10(length(content) + 10.0::DOUBLE) * 100 + least(b.n_p, 50) * 2.5::DOUBLE + least({_SENTENCES}, 120) * 1.2::DOUBLE)
    * (1 - least(0.55::DOUBLE, least(1.0::DOUBLE, len(regexp_extract_all(content, '(?i)https?://|www\.'))::DOUBLE / 22) * 0.85::DOUBLE + CASE WHEN len(lines) = 0 THEN 1 ELSE len(list_filter(lines, lambda x: length(x) < 12))::DOUBLE / len(lines) END * 0.35::DOUBLE)) END"""
_ODD = r"length(content) >= 120 AND length(regexp_replace(content, '[\x{4e00}-\x{9fa5}a-zA-Z0-9\s，。！？、,.!?;:：\"''“”‘’（）()【】\[\]\-—_&~*]', '', 'g'))::DOUBLE / greatest(length(content), 1) >= CASE WHEN length(content) < 200 THEN 0.6 ELSE 0.35 END"
_put("x8_extract_pages", f"""WITH {_RAW}, {_PARTS}, c AS (SELECT page_id, title, {_STATUS} AS access, {_DIRECTORY} AS many FROM f), b AS (SELECT *, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM ({_BEST} SELECT * FROM best)),
  r AS (SELECT c.*, b.content, ({_SCORE}) * CASE WHEN many AND length(content) >= 200 THEN 0.35::DOUBLE ELSE 1 END AS score FROM c LEFT JOIN b USING (page_id)), g AS (SELECT *, access = 'OK' AND coalesce(score, -1) >= 0 AS taken FROM r)
  SELECT page_id, CASE WHEN access <> 'OK' THEN access WHEN NOT taken THEN 'NO_MAIN_CONTENT' WHEN many THEN 'TOC_PAGE_SUSPECT' WHEN {_ODD} THEN 'FONT_OBFUSCATED' ELSE 'OK' END AS status, CASE WHEN taken THEN 'heuristic' END AS strategy, CASE WHEN taken THEN title END AS title, CASE WHEN taken THEN content END AS content, CASE WHEN taken THEN round(score, 6) END AS score FROM g""")

_PLAUSIBLE = f"""(lower(regexp_extract(toc_next, '^https?://[^/?#]*([^?#]*)', 1)) NOT IN ('', '/') AND ({_HOST.format("toc_next")} = {_HOST.format("url")} OR regexp_matches(lower(regexp_extract(toc_next, '^https?://[^/?#]*([^?#]*)', 1)), '(chapter|reader|read|content)\\b|/\\d+[-_]\\d+|\\d{{5,}}') OR regexp_matches(toc_next, '(?i)[?&](cid|chapterid|chapter)=\\d+')))"""
_put("r10_resolve_next", f"""WITH {_LINKED}, {_ANCHORS}, {_SCORED}, {_FOUND}, {_POOL}, l0 AS ({_LISTS}), l AS (SELECT *, {fingerprint("url")} AS fp, lead(url) OVER (PARTITION BY list_id ORDER BY page_id) AS behind FROM l0),
  m AS (SELECT x.page_id, x.url, (SELECT y.behind FROM l y WHERE y.list_id = x.list_id AND y.fp = x.fp ORDER BY y.page_id LIMIT 1) AS toc_next FROM l x),
  z AS (SELECT m.*, {_PLAUSIBLE} AS fit, (SELECT count(*) FROM kc WHERE kc.page_id = m.page_id AND confidence >= 0.45) AS n, (SELECT struct_pack(u := kc.url, c := confidence, r := reason) FROM kc WHERE kc.page_id = m.page_id AND confidence >= 0.45 ORDER BY rank LIMIT 1) AS best FROM m)
  SELECT page_id, CASE WHEN toc_next IS NOT NULL THEN CASE WHEN fit THEN toc_next END WHEN best.c >= 0.75 THEN best.u END AS next_url, CASE WHEN toc_next IS NOT NULL THEN CASE WHEN fit THEN 0.92 ELSE 0 END ELSE coalesce(best.c, 0) END::DOUBLE AS confidence,
    CASE WHEN toc_next IS NOT NULL THEN CASE WHEN fit THEN 'toc_adjacent' ELSE 'toc_adjacent_unplausible' END WHEN best.c >= 0.75 THEN best.r WHEN best IS NOT NULL THEN 'pending_user_choice' ELSE 'none' END AS reason,
    CASE WHEN toc_next IS NOT NULL THEN CASE WHEN fit THEN 'toc' ELSE 'none' END WHEN best IS NOT NULL THEN 'nav' ELSE 'none' END AS source, coalesce(toc_next IS NULL AND best.c < 0.75, FALSE) AS needs_confirmation, CASE WHEN toc_next IS NULL AND best.c < 0.75 THEN n ELSE 0 END::INT AS n_choices FROM z""")
