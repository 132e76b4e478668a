"""Text functions over Columns: white space, language, dates, soft errors, keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0085}\x{001c}-\x{001f}]+"


def collapse(x: Column) -> Column:
    """Runs of white space, no-break ones too, as one space; none at the ends."""
    return F.trim(F.regexp_replace(x, SPACE, " "))


def language(x: Column) -> Column:
    """zh if CJK letters are a twentieth of Latin ones or more, else en if there are Latin ones, else empty."""
    cjk, latin = F.regexp_count(x, F.lit(r"[\x{3400}-\x{9fff}]")), F.regexp_count(x, F.lit("[A-Za-z]"))
    return F.coalesce(F.when((cjk > 0) & (cjk >= latin * 0.05), "zh").when(latin > 0, "en").otherwise(""), F.lit(""))


# The date pattern, phrases of pages that were not found, marks and size of a script-only page, headers that are not kept.
DATE = r"(20\d{2})\s*(?:年|[-/.])\s*(\d{1,2})\s*(?:月|[-/.])\s*(\d{1,2})日?(?:\s*[T ]\s*(\d{1,2})(?::|时)(\d{1,2})(?::(\d{1,2}))?)?"


def parse_date(x: Column) -> Column:
    """An ISO date or time, else the first date in the text; without a zone it is UTC; null if there is none or it can't be."""
    x = collapse(x)
    iso = F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})?)?$"), F.try_to_timestamp(x))
    part = lambda k: F.nullif(F.regexp_extract(x, DATE, k), F.lit(""))
    n = lambda k: F.coalesce(part(k).cast("int"), F.lit(0))
    return F.coalesce(iso, F.try_make_timestamp(part(1).cast("int"), part(2).cast("int"), part(3).cast("int"), n(4), n(5), n(6)))


def keyword(x: Column, word: str) -> Column:
    """A word between non-letters if it is ASCII, anywhere if not; titles over 120 characters hold none."""
    import re

    low = F.lower(F.trim(x))
    word = word.lower()
    hit = low.rlike(f"(?<![a-z]){re.escape(word)}(?![a-z])") if word.isascii() else F.contains(low, F.lit(word))
    return (F.length(low) <= 120) & hit


def any_keyword(x: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | keyword(x, w)
    return F.coalesce(out, F.lit(False))


NOT_FOUND_TITLES = ("page not found", "页面未找到", "页面不存在", "找不到页面")
NOT_FOUND_BODIES = ("page not found", "404 -", "404页面", "页面未找到", "页面不存在")
NOT_FOUND_BODY_SIZE = 300
APP_MARKS = ('id="app"', "id='app'", 'id="root"', "id='root'", "__next_data__", "data-reactroot")
APP_SIZE = 1200
PRIVATE_HEADERS = ("authorization", "cookie", "proxy-authorization", "set-cookie", "x-api-key")


def soft_not_found(title: Column, body: Column) -> Column:
    """A page that says 'not found' with status 200."""
    t, b = F.lower(collapse(title)), F.lower(collapse(F.substring(body, 1, 1200)))
    in_title = t.rlike(r"(?:^|\s|[-|])404(?:\s|$|[-|])") | t.rlike("|".join(NOT_FOUND_TITLES))
    in_body = (F.length(b) <= NOT_FOUND_BODY_SIZE) & b.rlike("|".join(NOT_FOUND_BODIES))
    return F.coalesce(in_title, F.lit(False)) | F.coalesce(in_body, F.lit(False))


def app_shell(html: Column, media_type: Column | None = None) -> Column:
    """A page that scripts have to fill: a root mark, a script, and fewer than APP_SIZE characters before the first one."""
    low = F.lower(F.substring(html, 1, 100_000))
    marked = F.lit(False)
    for mark in APP_MARKS:
        marked = marked | F.contains(low, F.lit(mark))
    made = marked & F.contains(low, F.lit("<script")) & (F.length(F.trim(F.substring_index(low, "<script", 1))) < APP_SIZE)
    if media_type is not None:
        made = made & F.coalesce(media_type, F.lit("")).rlike("^(?:$|text/html|application/xhtml)")
    return F.coalesce(made, F.lit(False))


def header(headers: Column, name: str) -> Column:
    return F.element_at(F.map_filter(F.transform_keys(headers, lambda k, v: F.lower(k)), lambda k, v: k == name.lower()), name.lower())


def public_headers(headers: Column) -> Column:
    """Headers without credentials and cookies."""
    return F.map_filter(headers, lambda k, v: ~F.lower(k).isin(*PRIVATE_HEADERS))
