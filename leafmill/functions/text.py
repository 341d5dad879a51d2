"""Text columns: lines, blanks, escapes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# White space that counts at the ends of a line.
SPACE = "[\\s　 ﻿]"
INK = "[ \t　]"


def trim(text: Column) -> Column:
    """Without white space at its ends, of which only the ends are looked at."""
    return F.trim(text, F.lit(" \t\n\x0b\f\r" + SPACE[3:-1]))


def normalize_text(text: Column) -> Column:
    """T4: line feeds only, no blanks at line ends, at most one empty line, single spaces, trimmed; null is empty."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    for pattern, by in ((r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")):
        out = F.regexp_replace(out, pattern, by)
    return trim(out)


def split_lines(text: Column) -> Column:
    return F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n", -1)


def drop_blank_lines(text: Column) -> Column:
    """T5: lines without blanks at their end; lines of blanks only go."""
    ends = F.transform(split_lines(text), lambda x: F.regexp_replace(x, f"{INK}+$", ""))
    return F.array_join(F.filter(ends, lambda x: F.regexp_replace(x, INK, "") != ""), "\n")


def raw_lines(text: Column) -> Column:
    """Lines with tabs as four spaces and no white space at their end."""
    return F.transform(split_lines(text), lambda x: F.regexp_replace(F.replace(x, F.lit("\t"), F.lit("    ")), f"{SPACE}+$", ""))


def escape_html(text: Column) -> Column:
    """T14."""
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def preview(text: Column, n_lines: int = 12) -> Column:
    """K7: the first n lines that are not blank."""
    return F.array_join(F.slice(F.filter(F.transform(split_lines(text), trim), lambda x: x != ""), 1, n_lines), "\n")


def excerpt(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def mask_json(text: Column) -> Column:
    """JSON text whose escaped backslashes and quotes are single other signs, so that the next quote ends a string."""
    return F.replace(F.replace(text, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))


def unmask_json(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
