"""URLs from sitemaps, feeds and JSON endpoints, and what media a response holds."""

from __future__ import annotations

import gzip
import json
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Keys of JSON objects that hold URLs, conventional sitemap paths.
JSON_KEYS = ("url", "href", "link", "uri", "permalink", "next", "target")
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap/sitemap.xml", "/sitemap.xml.gz", "/sitemap_index.xml.gz")
DEPTH = 3


@F.pandas_udf(StringType())
def unzipped(body: pd.Series) -> pd.Series:
    """A body as text; gzip is undone. Null where it can't be."""

    def one(b):
        try:
            raw = bytes(b)
            return (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode("utf-8", "replace")
        except (TypeError, OSError, EOFError):
            return None

    return body.map(one)


def _locations(xml: Column) -> Column:
    """Non-blank loc texts, whatever the namespace; none of what is no XML."""
    ok = F.coalesce(xml.rlike(r"(?s)^\s*(?:<\?xml.*?\?>\s*)?(?:<!--.*?-->\s*)*<(?:\w+:)?(?:urlset|sitemapindex)\b.*</(?:\w+:)?(?:urlset|sitemapindex)>\s*$"), F.lit(False))
    found = F.when(ok, F.xpath(xml, F.lit('//*[local-name()="loc"]/text()')))
    return F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def is_index(xml: Column) -> Column:
    return F.coalesce(xml.rlike(r"<(?:\w+:)?sitemapindex\b"), F.lit(False))


def locations(bodies: DataFrame) -> DataFrame:
    """loc and is_index for each location of sitemaps (url, body text)."""
    return bodies.where("body is not null").select(F.explode(_locations(F.col("body"))).alias("loc"), is_index(F.col("body")).alias("is_index"))


def sitemap_urls(starts: DataFrame, responses: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Page URLs of sitemaps (url), following index files at most `depth` levels down through responses (url, body binary). A fixed number of joins; each sitemap is read once a level."""
    texts = responses.select("url", unzipped("body").alias("xml"))
    level, found = starts.select("url").distinct(), None
    for _ in range(depth + 1):
        here = level.join(texts, "url").select("url", "xml", F.explode(_locations(F.col("xml"))).alias("loc"))
        pages = here.where(~is_index(F.col("xml"))).select(F.col("loc").alias("url"))
        found = pages if found is None else found.union(pages)
        level = here.where(is_index(F.col("xml"))).select(F.col("loc").alias("url")).distinct()
    return found.distinct()


def feed_urls(xml: Column) -> Column:
    """Links of an RSS, Atom or RDF feed: the text of link elements, or their href."""
    texts = F.xpath(xml, F.lit('//*[local-name()="link"]/text()'))
    refs = F.xpath(xml, F.lit('//*[local-name()="link"]/@href'))
    return F.array_distinct(F.filter(F.transform(F.concat(texts, refs), lambda x: F.trim(x)), lambda x: x != ""))


@F.pandas_udf(ArrayType(StringType()))
def json_urls(body: pd.Series) -> pd.Series:
    """Strings under JSON_KEYS, or under lists below them, breadth first, each once; none if it is no JSON."""

    def one(text):
        try:
            todo, found = deque([(json.loads(text), False)]), {}
        except (TypeError, ValueError, RecursionError):
            return []
        while todo:
            item, named = todo.popleft()
            if isinstance(item, dict):
                todo.extend((v, k.lower() in JSON_KEYS) for k, v in item.items())
            elif isinstance(item, list):
                todo.extend((v, named) for v in item)
            elif isinstance(item, str) and named and item.strip():
                found.setdefault(item.strip())
        return list(found)

    return body.map(one)


def looks_html(media_type: Column, body: Column) -> Column:
    """By media type, else by how the body begins."""
    media, start = F.lower(F.coalesce(media_type, F.lit(""))), F.lower(F.ltrim(F.substring(F.coalesce(body, F.lit("")), 1, 512)))
    return media.rlike("^(?:text/html|application/xhtml)") | start.rlike("^(?:<!doctype html|<html|<head|<body)")


def looks_json(media_type: Column, body: Column) -> Column:
    return F.contains(F.lower(F.coalesce(media_type, F.lit(""))), F.lit("json")) | F.ltrim(F.substring(F.coalesce(body, F.lit("")), 1, 80)).rlike(r"^[{\[]")


def http_outcome(status: Column) -> Column:
    """What an answer of the job API means: ok, retry (408, 425, 429, 5xx), or failed."""
    return F.when((status >= 200) & (status < 300), "ok").when(status.isin(408, 425, 429) | (status >= 500), "retry").otherwise("failed")


def file_title(url: Column) -> Column:
    """The name of a file from the end of its path, without its extension."""
    name = F.element_at(F.split(F.regexp_extract(url, r"^(?:[a-zA-Z]+://[^/?#]*)?([^?#]*)", 1), "/"), -1)
    return F.substring(F.regexp_replace(F.coalesce(F.try_url_decode(F.regexp_replace(name, r"\+", "%2B")), name), r"\.[A-Za-z0-9]{1,5}$", ""), 1, 500)
