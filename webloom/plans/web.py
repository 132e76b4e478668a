"""Queries over pages and documents: URLs, markup, links, page types, identities, text; each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import discovery, ids, text, urls
from webloom.functions.html import plain_title
from webloom.operators import crawl
from webloom.operators import pages as P
from webloom.session import ship

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
COLLECTION = "col-1"
SCOPE = urls.Scope(hosts=("example.com",), include_subdomains=True, path_prefixes=("/en", "/fr"), excluded=(r"/9\d\d",), allowed_query_keys=("page",))
ROBOTS = """User-agent: *
Disallow: /en/
Allow: /en/7
Disallow: /*.html$
Disallow: /de/8

User-agent: other
Disallow: /
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


HREFS = 'regexp_extract_all(html, \'<a href="([^"]*)"\', 1)'


def _hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and link of every page's anchors, each once."""
    return _pages(spark, sf_dir).select("page_id", F.explode(F.array_distinct(F.expr(HREFS))).alias("link"))


_HREFS = f"hrefs as (select distinct page_id, unnest({HREFS}) as link from pages)"


def _values(*rows: tuple[int, str]) -> str:
    """Edge rows as SQL."""
    return ", ".join(f"({k}, '{x}')" for k, x in rows)


def _edges(spark: SparkSession, rows: tuple, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


#: The canonical form of the tables' URLs: they are normal but for fragments and query strings.
_CANON = """canon as (select page_id, url, base || case when q <> '' then '?' || q else '' end as canonical_url from (select *, array_to_string(list_sort(list_filter(string_split(case when contains(bare, '?') then regexp_extract(bare, '\\?(.*)$', 1) else '' end, '&'),
  lambda x: x <> '' and not starts_with(lower(split_part(x, '=', 1)), 'utm_') and lower(split_part(x, '=', 1)) not in ('gclid', 'fbclid', 'msclkid', 'yclid', '_ga', '_gl'))), '&') as q,
  case when regexp_matches(split_part(bare, '?', 1), '^https?://[^/]+$') then split_part(bare, '?', 1) || '/' else split_part(bare, '?', 1) end as base
  from (select page_id, url, regexp_replace(url, '#.*$', '') as bare from pages)))"""


@query(f"with {_CANON} select page_id, canonical_url from canon")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in functions for plain URLs, the exact function for the rest."""
    return _pages(spark, sf_dir).select("page_id", urls.canonical_fast(F.col("url")).alias("canonical_url"))


@query("select page_id, regexp_replace(url, '#.*$', '') as wire_url from pages")
def url_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is requested."""
    return _pages(spark, sf_dir).select("page_id", urls.wire_url("url").alias("wire_url"))


_PARTS = f"""{_CANON}, parts as (select *, regexp_extract(canonical_url, '^[a-z]+://([^/?#:]*)', 1) as host, regexp_extract(canonical_url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path, case when contains(canonical_url, '?') then regexp_extract(canonical_url, '\\?(.*)$', 1) else '' end as q from canon)"""


@query(
    f"""with {_PARTS} select page_id, case when not (host = 'example.com' or host like '%.example.com') then 'external_host' when not (path = '/en' or path like '/en/%' or path = '/fr' or path like '/fr/%') then 'path_outside_scope'
  when regexp_matches(path, '/9\\d\\d') then 'path_excluded' when len(list_filter(string_split(q, '&'), lambda x: x <> '' and split_part(x, '=', 1) <> 'page')) > 0 then 'query_key_not_allowed' end as reason from parts"""
)
def url_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason against a URL, null if it is in scope."""
    p = _pages(spark, sf_dir).withColumn("canon", urls.canonical_fast(F.col("url")))
    return p.select("page_id", urls.decide(F.col("url"), F.col("canon"), SCOPE).alias("reason"))


@query(f"with {_PARTS} select page_id, case when not (host = 'example.com' or host like '%.example.com') then 'external_host' end as reason from parts")
def url_auxiliary_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots, sitemaps and feeds need not be below a prefix."""
    p = _pages(spark, sf_dir).withColumn("canon", urls.canonical_fast(F.col("url")))
    return p.select("page_id", urls.decide(F.col("url"), F.col("canon"), SCOPE, auxiliary=True).alias("reason"))


@query(
    """select page_id, case when greatest(case when regexp_matches(path, '^/en/7') then 5 else -1 end) >= greatest(case when regexp_matches(path, '^/en/') then 4 else -1 end, case when regexp_matches(path, '^/.*\\.html$') then 8 else -1 end, case when regexp_matches(path, '^/de/8') then 5 else -1 end) then true else false end as allowed
from (select page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) as path from pages)"""
)
def robots_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest rule decides."""
    rules = urls.parse_robots(ROBOTS, "webloom")
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^#]*)", 1)
    return _pages(spark, sf_dir).select("page_id", urls.robots_allows(path, rules["allow"], rules["disallow"]).alias("allowed"))


#: Routes that the tables' links don't have.
ROUTES = ((-1, "/user/login"), (-2, "/api/memberList"), (-3, "/x?do=updateRow"), (-4, "/author/api/page"), (-5, "/upload/report.pdf"), (-6, "/rest/orders/9"), (-7, "/data/session.json"), (-8, "/a/sign-in"), (-9, "/a/b.PDF"), (-10, "/api/file/7"), (-11, "/x/download"), (-12, "/img/a.webp"))


@query(
    f"""with {_HREFS}, l as (select * from hrefs union all select * from (values {_values(*ROUTES)}) v(page_id, link)), p as (select *, split_part(link, '?', 1) as path from l),
t as (select *, list_filter(list_transform(regexp_split_to_array(regexp_replace(link, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[/_.?&=:#\\-\\s]+'), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), lambda x: x <> '') as tokens,
  list_transform(string_split(lower(path), '/'), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')) as segments from p)
select page_id, link, case when regexp_matches(path, '(?i)\\.(pdf|docx?|xlsx?|pptx?|zip|rar|7z|jpg|jpeg|png|gif|svg|mp4|mp3|webm|wav|mov)$') then null when list_has_any(tokens, ['login', 'logout', 'signin', 'auth', 'captcha', 'password']) then 'login_route'
  when (list_has_any(segments, ['api', 'ajax', 'json', 'rest', 'graphql']) or ends_with(lower(path), '.json')) and len(list_filter(tokens, lambda x: regexp_matches(x, 'login|logout|signin|token|captcha|member|account|order|pay|password|session') or (contains(x, 'auth') and not starts_with(x, 'author')))) > 0 then 'private_endpoint'
  when list_has_any(tokens, ['create', 'delete', 'destroy', 'insert', 'remove', 'save', 'submit', 'update', 'upload']) then 'mutating_endpoint' end as reason from t"""
)
def discovery_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that are not to be probed, over all links of all pages and routes of each kind."""
    links = _hrefs(spark, sf_dir).unionByName(_edges(spark, ROUTES, "page_id long, link string"))
    return links.select("page_id", "link", urls.unsafe_reason(F.col("link")).alias("reason"))


@query(f"with {_HREFS}, l as (select * from hrefs union all select * from (values {_values(*ROUTES)}) v(page_id, link)) select page_id, link, regexp_matches(lower(split_part(link, '?', 1)), '\\.(pdf|docx?|xlsx?|pptx?|zip|rar|7z|jpg|jpeg|png|gif|svg|mp4|mp3|webm|wav|mov|webp)$|/api/attach/|/api/file/|/download') as resource from l")
def resource_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to files, over all links of all pages and routes of each kind."""
    links = _hrefs(spark, sf_dir).unionByName(_edges(spark, ROUTES, "page_id long, link string"))
    return links.select("page_id", "link", urls.resource_url(F.col("link")).alias("resource"))


#: Titles and bodies that the tables' pages don't have.
ERRORS = ((-1, "404 - Page", "fine"), (-2, "A title", "Sorry, Page  Not Found here"), (-3, "A title", "page not found " + "x" * 400), (-4, "Room 4040", "fine"), (-5, "页面不存在", ""), (-6, "x", "404页面"))
_SHOWN = "trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    f"""with s as (select page_id, lower(trim(regexp_extract(coalesce(html, ''), '<h1>([^<]*)</h1>', 1))) as t, lower(left({_SHOWN}, 1200)) as b from pages union all select page_id, lower(t), lower(left(trim(regexp_replace(b, '\\s+', ' ', 'g')), 1200)) from (values {", ".join(f"({k}, '{t}', '{b}')" for k, t, b in ERRORS)}) v(page_id, t, b))
select page_id, regexp_matches(t, '(^|\\s|[-|])404(\\s|$|[-|])') or regexp_matches(t, 'page not found|页面未找到|页面不存在|找不到页面') or (length(trim(b)) <= 300 and regexp_matches(b, 'page not found|404 -|404页面|页面未找到|页面不存在')) as soft from s"""
)
def soft_404(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that say 'not found' with status 200, over every page's heading and visible text and a row of each kind."""
    html = F.coalesce("html", F.lit(""))
    shown = F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))
    rows = _pages(spark, sf_dir).select("page_id", F.regexp_extract(html, "<h1>([^<]*)</h1>", 1).alias("title"), shown.alias("body")).unionByName(_edges(spark, ERRORS, "page_id long, title string, body string"))
    return rows.select("page_id", text.soft_not_found(F.col("title"), F.col("body")).alias("soft"))


@query("select page_id, (contains(h, 'id=\"app\"') or contains(h, 'id=\"root\"')) and contains(h, '<script') and length(trim(split_part(h, '<script', 1))) < 1200 as shell from (select page_id, lower(case when page_id % 2 = 0 then coalesce(html, '') else '<div id=\"root\">' || left(coalesce(html, ''), (page_id % 3000)::int) || '<script>' end) as h from pages)")
def app_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that scripts have to fill; every other page is cut and made one."""
    html = F.coalesce("html", F.lit(""))
    made = F.when(F.col("page_id") % 2 == 0, html).otherwise(F.concat(F.lit('<div id="root">'), F.substring(html, F.lit(1), (F.col("page_id") % 3000).cast("int")), F.lit("<script>")))
    return _pages(spark, sf_dir).select("page_id", text.app_shell(made).alias("shell"))


_TITLE = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<h1>([^<]*)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&#x27;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(f"select page_id, {_TITLE} as title from pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title by the full interpreter."""
    return P.facts(_pages(spark, sf_dir), only=("title",)).select("page_id", F.col("facts.title").alias("title"))


@query(f"select page_id, {_TITLE} as title from pages")
def page_title_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F21 in built-in functions, for pages of the plain shape."""
    return _pages(spark, sf_dir).select("page_id", plain_title(F.col("html")).alias("title"))


@query("select page_id, count(distinct u) as n_links from (select page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as u from pages) where u <> '' and not starts_with(u, '#') group by page_id")
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page that has some."""
    links = P.links(P.facts(_pages(spark, sf_dir), only=("links",))).where("source = 'html_link'")
    return links.groupBy("page_id").agg(F.count("*").alias("n_links"))


@query("select distinct page_id, u as url, 'html_link' as source from (select page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as u from pages) where u <> '' and not starts_with(u, '#')")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link with where it stands."""
    return P.links(P.facts(_pages(spark, sf_dir), only=("links",))).where("source = 'html_link'").select("page_id", "url", "source")


@query()
def page_facts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary, body, section, dates and more of each page."""
    f = P.facts(_pages(spark, sf_dir))
    return f.select("page_id", "facts.title", "facts.summary", "facts.body", "facts.section", F.timestamp_micros("facts.published_micros").alias("published_at"), "facts.published_confidence", "facts.canonical_url", text.language(F.coalesce(F.nullif("facts.body", F.lit("")), "facts.title")).alias("language"), F.size("facts.links").alias("n_links"), F.size("facts.attachments").alias("n_attachments"), "facts.error")


@query()
def page_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page type, confidence and evidence."""
    return P.classify(P.facts(_pages(spark, sf_dir)), routes=((r"/de/\d+", "notice", "de"),)).select("page_id", "page_type", "confidence", F.array_join("evidence", ",").alias("evidence"))


@query()
def page_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A07."""
    return P.classify(P.facts(_pages(spark, sf_dir))).groupBy("page_type").agg(F.count("*").alias("n"))


@query(
    f"""with {_CANON}, f as (select page_id, canonical_url, '/' || split_part(regexp_extract(canonical_url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1), '/', 1) || '/*' as pattern from canon)
select pattern, count(*) as n_pages, array_to_string(list_sort(list(distinct canonical_url))[1:5], ' ') as samples from f group by pattern"""
)
def route_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the first segment of their path."""
    p = _pages(spark, sf_dir).select(urls.canonical_fast(F.col("url")).alias("canonical_url"))
    return P.route_families(p).select("pattern", "n_pages", F.array_join("samples", " ").alias("samples"))


@query(
    """with l as (select distinct page_id, u from (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as u from pages) where u <> '' and not starts_with(u, '#'))
select u as url, count(*) as n_pages, min(page_id) as first_page, string_agg(page_id::varchar, ',' order by page_id) as sources from l group by u"""
)
def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate for each link, with all pages that lead to it."""
    links = P.links(P.facts(_pages(spark, sf_dir), only=("links",))).where("source = 'html_link'")
    found = links.select(F.col("url").alias("canonical_url"), "url", F.col("page_id").cast("string").alias("source"), F.lit(1).alias("depth"), F.lit(50).alias("priority"), F.col("page_id").alias("seq"))
    m = P.merge_candidates(found)
    return m.select("url", F.size("sources").cast("long").alias("n_pages"), F.col("seq").alias("first_page"), F.array_join("sources", ",").alias("sources"))


@query("select page_id, 'page-' || substr(sha256('col-1' || chr(10) || url), 1, 32) as record_id from pages")
def page_record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identities of page records."""
    return _pages(spark, sf_dir).select("page_id", ids.page_record_id(F.lit(COLLECTION), F.col("url")).alias("record_id"))


@query("select doc_id, 'doc_' || substr(sha256('{\"identity_version\":\"1.0\",\"key\":\"' || doc_id || '\",\"namespace\":\"' || coalesce(source, '') || '\",\"scope_key\":\"' || coalesce(lang, '') || '\"}'), 1, 32) as document_id, sha256('[\"' || coalesce(lang, '') || '\",\"' || doc_id || '\"]') as ingest_hash from documents")
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document identities and ingest hashes."""
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    made = ids.document_id(lang, source, F.col("doc_id").cast("string"), F.lit("1.0"))
    return _docs(spark, sf_dir).select("doc_id", made.alias("document_id"), ids.digest(ids.canonical_array(lang, F.col("doc_id").cast("string"))).alias("ingest_hash"))


@query("select page_id, 'evidence://sha256/' || sha256(coalesce(html, '')) || '/html' as ref from pages")
def evidence_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12, S31."""
    return _pages(spark, sf_dir).select("page_id", ids.evidence_ref(F.coalesce("html", F.lit("")), "html").alias("ref"))


@query("select sha256(coalesce(text, '')) as sha256, min(doc_id) as first_doc, count(*) as n from documents group by 1")
def evidence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed, one object for equal contents."""
    d = _docs(spark, sf_dir).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return d.groupBy("sha256").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


_LANG = "case when cjk > 0 and cjk >= latin * 0.05 then 'zh' when latin > 0 then 'en' else '' end"


@query(f"select doc_id, {_LANG} as language from (select doc_id, len(regexp_extract_all(t, '[\\x{{3400}}-\\x{{9fff}}]')) as cjk, len(regexp_extract_all(t, '[A-Za-z]')) as latin from (select doc_id, case when doc_id % 3 = 0 then repeat('网页内容', (length(x) // 50)::int) || x when doc_id % 7 = 0 then regexp_replace(x, '[A-Za-z]', '', 'g') else x end as t from (select doc_id, coalesce(text, '') as x from documents)))")
def language_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F02, over whole documents, a third of them led by Chinese words, some without Latin letters."""
    x = F.coalesce("text", F.lit(""))
    made = F.when(F.col("doc_id") % 3 == 0, F.concat(F.repeat(F.lit("网页内容"), F.floor(F.length(x) / 50).cast("int")), x)).when(F.col("doc_id") % 7 == 0, F.regexp_replace(x, "[A-Za-z]", "")).otherwise(x)
    return _docs(spark, sf_dir).select("doc_id", text.language(made).alias("language"))


@query("select o_orderkey as order_key, case when o_orderkey % 4 = 3 or (o_orderkey % 4 > 0 and year(o_orderdate) < 2000) then null else strftime(o_orderdate, '%Y-%m-%d') || case when o_orderkey % 4 = 1 then ' 08:05:00' else ' 00:00:00' end end as stated from orders")
def date_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dates in four spellings, one of them impossible; years before 2000 count in ISO form only."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    die, y, m, d = F.col("o_orderkey") % 4, F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"), F.dayofmonth("o_orderdate").cast("string")
    said = F.when(die == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(die == 1, F.concat(F.lit("on "), y, F.lit("/"), m, F.lit("/"), d, F.lit(" 8:05"))).when(die == 2, F.concat(F.lit("发布 "), y, F.lit("年"), m, F.lit("月"), d, F.lit("日"))).otherwise(F.concat(y, F.lit("-13-45")))
    return o.select(F.col("o_orderkey").alias("order_key"), F.date_format(text.parse_date(said), "yyyy-MM-dd HH:mm:ss").alias("stated"))


@query("select doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '[\\s\\x{00a0}\\x{000b}]+', ' ', 'g'))) as body_sha256 from documents")
def text_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """white space collapsed, over whole texts."""
    return _docs(spark, sf_dir).select("doc_id", F.sha2(text.collapse(F.coalesce("text", F.lit(""))), 256).alias("body_sha256"))


@query("select distinct regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || '/p' || (page_id % 50) as url from pages")
def sitemap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index file that leads to a sitemap of each host, gzip where the host begins with m; read back to page URLs."""
    origin = F.regexp_extract("url", r"^[a-z]+://[^/?#]*", 0)
    pages = _pages(spark, sf_dir).select(origin.alias("origin"), F.concat(origin, F.lit("/p"), (F.col("page_id") % 50).cast("string")).alias("loc")).distinct()
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.collect_list(F.concat(F.lit("<url><loc> "), "loc", F.lit(" </loc></url>"))), ""), F.lit("</urlset>"))
    maps = pages.groupBy("origin").agg(xml.cast("binary").alias("body")).select(F.concat("origin", F.lit("/sitemap.xml")).alias("url"), "body")
    index = maps.agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).cast("binary").alias("body"))
    responses = maps.unionByName(index.withColumn("url", F.lit("https://start.test/sitemap.xml")))
    return discovery.sitemap_urls(spark.range(1).select(F.lit("https://start.test/sitemap.xml").alias("url")), responses)


@query(f"select page_id, array_to_string(list_distinct_in_order, ' ') as found_urls from (select page_id, list_filter(list_concat([split_part(url, '&', 1)], hs), lambda x, i: x <> '' and list_position(list_concat([split_part(url, '&', 1)], hs), x) = i) as list_distinct_in_order from (select page_id, url, {HREFS} as hs from pages))")
def feed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of each page: its URL as text, its links as attributes."""
    hrefs = F.transform(F.expr(HREFS), lambda h: F.concat(F.lit('<entry><link href="'), h, F.lit('"/></entry>')))
    xml = F.concat(F.lit("<feed><entry><link> "), F.substring_index("url", "&", 1), F.lit(" </link></entry>"), F.array_join(hrefs, ""), F.lit("</feed>"))
    return _pages(spark, sf_dir).select("page_id", F.array_join(discovery.feed_urls(xml), " ").alias("found_urls"))


@query(f"select page_id, array_to_string(list_filter(list_concat([url], hs), lambda x, i: trim(x) <> '' and list_position(list_concat([url], hs), x) = i), ' ') as found_urls from (select page_id, url, {HREFS} as hs from pages)")
def json_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs in a JSON answer of each page: its own, then those of its links."""
    body = F.to_json(F.struct(F.struct(F.col("url").alias("href"), F.lit(3).alias("size")).alias("item"), F.transform(F.expr(HREFS), lambda h: F.struct(h.alias("next"), F.lit("x").alias("title"))).alias("list")))
    return _pages(spark, sf_dir).select("page_id", F.array_join(discovery.json_urls(body), " ").alias("found_urls"))


@query("select event_id, case when s >= 200 and s < 300 then 'ok' when s in (408, 425, 429) or s >= 500 then 'retry' else 'failed' end as outcome from (select event_id, 200 + (event_id * 7 + floor(coalesce(value, 0))::bigint) % 400 as s from events)")
def http_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every status from 200 to 599, dealt by the events' values."""
    status = F.lit(200) + F.pmod(F.col("event_id") * 7 + F.floor(F.coalesce("value", F.lit(0.0))), F.lit(400))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", discovery.http_outcome(status).alias("outcome"))


@query("select doc_id, coalesce(lang, '') as language, case when doc_id % 4 = 0 then 'x-source' else 'content-language,x-source' end as kept from documents where doc_id % 4 <> 0 union all select doc_id, null, 'x-source' from documents where doc_id % 4 = 0")
def header_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """header lookup without case, and headers without credentials; the tables' languages and sources as headers, in several spellings, some missing."""
    die = F.col("doc_id") % 4
    name = F.when(die == 1, "Content-Language").when(die == 2, "CONTENT-LANGUAGE").when(die == 3, "content-language").otherwise("Cookie")
    h = F.map_from_arrays(F.array(name, F.lit("X-Source"), F.lit("Set-Cookie"), F.lit("AUTHORIZATION"), F.lit("X-Api-Key")), F.array(F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), F.lit("x"), F.lit("y"), F.lit("z")))
    kept = F.array_join(F.array_sort(F.transform(F.map_keys(text.public_headers(h)), F.lower)), ",")
    return _docs(spark, sf_dir).select("doc_id", text.header(h, "Content-LANGUAGE").alias("language"), kept.alias("kept"))


@query("select page_id, url, case when regexp_matches(url, '^https?://') then null else 'network_scheme_not_allowed' end as reason from pages")
def network_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that the network policy refuses, names not looked up."""
    return _pages(spark, sf_dir).select("page_id", "url", urls.network_policy(F.col("url")).alias("reason"))


_VISITS = f"""{_CANON}, own as (select canonical_url, min(coalesce(html, '')) as html from canon join pages using (page_id) where canonical_url <> '' group by 1),
targets as (select distinct case when starts_with(u, '/') then regexp_extract(canonical_url, '^[a-z]+://[^/?#]*', 0) || replace(replace(replace(replace(url_encode(split_part(u, '#', 1)), '%2F', '/'), '%2C', ','), '%3B', ';'), '%3A', ':') else split_part(u, '#', 1) end as canonical_url from (select canonical_url, unnest({HREFS}) as u from own) where u <> '' and not starts_with(u, '#')),
visits as (select canonical_url, 0 as depth, 200 as status, {{title}} as title from own union all select canonical_url, 1, 404, '' from targets where canonical_url not in (select canonical_url from own))"""
_VISITS = _VISITS.replace("{title}", _TITLE)


@query(f"with {_VISITS} select canonical_url, depth, status, title, case when status = 404 then 'http_status' end as issue from visits")
def crawl_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of the whole pages table and every link of it through the replay fetcher."""
    return crawl.replay_pages(spark, sf_dir).pages.select("canonical_url", "depth", "status", "title", "issue")


@query(f"with {_VISITS} select count(*) as n_visited, count(*) filter (where status = 200) as n_pages, count(*) filter (where status = 404) as n_failures, max(depth) as deepest, count(*) as n_candidates, 0::bigint as n_waiting, count(*) as n_requests, 'explicit_seed,html_link' as sources, 'partial' as status, true as converged from visits")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, usage, sources and status of that crawl."""
    c = crawl.replay_pages(spark, sf_dir).coverage
    return c.select("n_visited", "n_pages", "n_failures", "deepest", "n_candidates", "n_waiting", "n_requests", F.array_join("sources_succeeded", ",").alias("sources"), "status", "converged")
