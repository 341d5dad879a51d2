"""URL columns. A URL that does not parse gives null, never an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Query keys that only track, and those that number chapters, in order of preference.
TRACKING = "(?i)^utm_|^spm$|^from$|^ref$"
CHAPTER_KEYS = ("chapterid", "cid", "chapter", "chapter_id", "page", "p")
_PARTS = r"(?i)^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, i)


def url_host(url: Column) -> Column:
    """host in lower case, without credentials and port; empty for what is no http URL."""
    return F.lower(F.regexp_replace(F.regexp_replace(_part(url, 2), "^[^@]*@", ""), r":\d*$", ""))


def url_path(url: Column) -> Column:
    return F.when(_part(url, 3) == "", F.lit("/")).otherwise(_part(url, 3))


def _query(url: Column) -> Column:
    return F.filter(F.split(F.substring(_part(url, 4), 2, 1 << 20), "&"), lambda x: x != "")


def is_public_http_url(url: Column) -> Column:
    """http or https, up to 4096 characters, no credentials, and a host that is not local or private."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^\[|\]$", ""), "^::ffff:", "")
    octets = [F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int") for i in range(1, 5)]
    a, b = octets[:2]
    private = (a.isin(0, 10, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | reduce(lambda x, y: x | y, [o > 255 for o in octets])
    v6 = host.contains(":") & (host.isin("::1", "0:0:0:0:0:0:0:1") | host.startswith("fe80:") | host.rlike("^f[cd][0-9a-f]{0,2}:"))
    local = (host == "") | (host == "localhost") | host.endswith(".localhost")
    ok = url.rlike(_PARTS) & (F.length(url) <= 4096) & ~_part(url, 2).contains("@") & ~local & ~F.coalesce(private, F.lit(False)) & ~v6
    return F.coalesce(ok, F.lit(False))


def url_fingerprint(url: Column) -> Column:
    """R2: origin, path, and the query's pairs sorted by key without tracking keys; no fragment. Another text stays as it is."""
    pairs = F.filter(_query(url), lambda x: ~F.substring_index(x, "=", 1).rlike(TRACKING))
    query = F.array_join(F.transform(F.array_sort(F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), x.alias("x")))), lambda s: s["x"]), "&")
    base = F.concat(F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2)), url_path(url))
    return F.when(url.rlike(_PARTS), F.concat(base, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))).otherwise(url)


def trailing_id(url: Column) -> Column:
    """The last number of five digits or more in the path, else empty."""
    return F.regexp_extract(url_path(url), r"(\d{5,})\D*$", 1)


def path_parts(url: Column) -> Column:
    return F.filter(F.split(url_path(url), "/"), lambda x: x != "")


def last_path_number(url: Column) -> Column:
    """The last number of the last path segment that has one."""
    with_digit = F.filter(path_parts(url), lambda x: x.rlike(r"\d"))
    return F.regexp_extract(F.try_element_at(with_digit, F.lit(-1)), r"(\d+)\D*$", 1).try_cast("long")


def path_similarity(a: Column, b: Column) -> Column:
    """40 times the share of equal segments, 35 more if the last numbers differ by one, 15 if by up to three; 0 for other hosts."""
    p, q = path_parts(a), path_parts(b)
    same = F.size(F.filter(F.zip_with(p, q, lambda x, y: x == y), lambda z: F.coalesce(z, F.lit(False))))
    diff = F.abs(last_path_number(b) - last_path_number(a))
    bonus = F.when(diff == 1, 35).when(diff <= 3, 15).otherwise(0)
    score = F.floor(F.lit(40.0) * same / F.greatest(F.size(p), F.size(q)) + 0.5).cast("int") + bonus
    return F.when((url_host(a) == url_host(b)) & (url_host(a) != "") & (F.size(p) > 0) & (F.size(q) > 0), score).otherwise(0)


def _query_number(url: Column, key: str) -> Column:
    mine = F.filter(_query(url), lambda x: (F.lower(F.substring_index(x, "=", 1)) == key) & x.rlike(r"=-?\d+$"))
    return F.regexp_extract(F.get(mine, F.lit(0)), r"=(-?\d+)$", 1).try_cast("long")


def numeric_delta(a: Column, b: Column) -> Column:
    """Difference of the first chapter key that both have, else of the last path numbers."""
    return F.coalesce(*[_query_number(b, k) - _query_number(a, k) for k in CHAPTER_KEYS], last_path_number(b) - last_path_number(a))


def same_path_group(a: Column, b: Column) -> Column:
    """One host and one directory."""
    folder = lambda u: F.regexp_replace(url_path(u), "[^/]*$", "")
    return (url_host(a) == url_host(b)) & (folder(a) == folder(b))


def abs_url(base: Column, href: Column) -> Column:
    """The absolute http(s) URL of href on a page, else empty. Dot segments are folded for relative paths."""
    origin = F.concat(F.lower(_part(base, 1)), F.lit("://"), _part(base, 2))
    href = F.coalesce(href, F.lit(""))
    folder = F.regexp_replace(url_path(base), "[^/]*$", "")
    fold = lambda path: F.concat(F.lit("/"), F.array_join(F.aggregate(
        F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".")), F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x))), "/"),
        F.when(path.rlike("(/|/\\.{1,2})$"), "/").otherwise(""))
    head, tail = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    return (
        F.when((href == "") | (_part(base, 2) == ""), "")
        .when(href.rlike("(?i)^https?://"), href)
        .when(href.startswith("//"), F.concat(F.lower(_part(base, 1)), F.lit(":"), href))
        .when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), "")
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(origin, url_path(base), href))
        .when(href.startswith("/"), F.concat(origin, F.regexp_replace(fold(head), "^/+$", "/"), tail))
        .otherwise(F.concat(origin, F.regexp_replace(fold(F.concat(folder, head)), "^/+$", "/"), tail))
    )
