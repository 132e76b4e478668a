import ast
import gzip
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.functions.html import Page, decode_body, interpret, parse_date
from webloom.functions.urls import Scope, canonical, canonical_fast, decide
from webloom.operators import crawl, pages
from webloom.plans import web
from webloom.sources.jobs import JobApi, JobResults, UpstreamError, route

BASE = "https://example.test/"


@pytest.mark.parametrize("url,want", [
    ("/news/1?utm_source=x&b=2&a=1#fragment", "https://example.test/news/1?a=1&b=2"), ("/ky?abc-123", "https://example.test/ky?abc-123"), ("/ky?abc-123=", "https://example.test/ky?abc-123="), ("HTTPS://Example.TEST.:443//a/../b/", "https://example.test/b/"),
    ("/news?b=2&utm_source=mail&a=1&tag=hello%20world#top", "https://example.test/news?a=1&b=2&tag=hello+world"), ("/中文/%2F/%25", "https://example.test/%E4%B8%AD%E6%96%87/%2F/%25"), ("mailto:x@y", ""), ("https://[bad", ""), ("http://[::1]:8080/page", "http://[::1]:8080/page"), ("http://u:p@example.test/", ""),
])
def test_canonical(url, want):
    assert canonical(url, BASE) == want


def test_fast_form_is_exact(spark, sf):
    odd = [("https://a.example.com/x?b=1&a=2",), ("https://a.example.com",), ("https://a.example.com/a//b",), ("https://a.example.com/a/../b?x",), ("http://a.example.com:80/",), (None,), ("x",), ("https://a.example.com/%7Ea?q=a+b",), ("https://a.example.com/a?a-b=1&a=2",)]
    df = spark.read.parquet(f"{sf}/pages.parquet").select("url").union(spark.createDataFrame(odd, "url string"))
    for r in df.select("url", canonical_fast(F.col("url")).alias("c")).collect():
        assert (r.c or "") == canonical(r.url), r.url


@pytest.mark.parametrize("url,scope,want", [
    ("https://example.test/newsroom/1", Scope(hosts=("example.test",), path_prefixes=("/news",)), "path_outside_scope"), ("https://example.test/news", Scope(hosts=("example.test",), path_prefixes=("/news",)), None), ("https://other.test/page", Scope(hosts=("example.test",)), "external_host"), ("mailto:a@b", Scope(), "unsupported_scheme_or_missing_host"),
    ("http://[::1]:8080/page", Scope(), "private_network"), ("http://[::1]:8080/page", Scope(allow_private_network=True), None), ("http://127.0.0.1/", Scope(), "private_network"), ("https://example.test/a?x=1", Scope(allowed_query_keys=("y",)), "query_key_not_allowed"), ("https://example.test/" + "a" * 5000, Scope(), "url_too_long"),
])
def test_decisions(spark, url, scope, want):
    df = spark.createDataFrame([(url, canonical(url))], "u string, c string")
    assert df.select(decide(F.col("u"), F.col("c"), scope).alias("r")).first().r == want


def test_scope_intersection_never_widens(spark):
    a, b = Scope(hosts=("example.test", "x.test"), path_prefixes=("/a", "/b")), Scope(hosts=("example.test",), path_prefixes=("/a/c", "/d"), excluded=("secret",))
    both = a.intersect(b)
    tried = [f"https://{h}/{p}" for h in ("example.test", "x.test", "y.test") for p in ("a", "a/c", "a/c/secret", "b", "d", "")]
    df = spark.createDataFrame([(u, canonical(u)) for u in tried], "u string, c string")
    for r in df.select("u", *[decide(F.col("u"), F.col("c"), s).alias(n) for n, s in (("a", a), ("b", b), ("both", both))]).collect():
        assert r.both is not None or (r.a is None and r.b is None)


def test_robots(spark):
    rules = urls.parse_robots("User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /x*y$\n\nUser-agent: me\nDisallow: /only\nSitemap: https://s.test/m.xml", "webloom")
    df = spark.createDataFrame([("/a/b",), ("/a/c",), ("/x1y",), ("/x1yz",), ("/only",)], "p string")
    allowed = lambda state="available": [r[0] for r in df.select(urls.robots_allows(F.col("p"), rules["allow"], rules["disallow"], state)).collect()]
    assert allowed() == [True, False, False, True, True] and allowed("unreachable") == [False] * 5
    assert rules["sitemaps"] == ["https://s.test/m.xml"] and urls.parse_robots("User-agent: me\nDisallow: /only", "ME")["disallow"] == ["/only"]


HTML = """<html><head><title>Site</title><meta name="description" content="About  it"><meta property="article:published_time" content="2026-01-02T03:04:05Z"><base href="/deep/"><link rel="canonical" href="/canon?b=1&amp;a=2">
<link rel="alternate" type="application/rss+xml" href="/feed"><script type="application/ld+json">{"datePublished": "2020-01-01"}</script><script>var u = "/api/list?page=2"; var s = "/x.css"</script></head>
<body><nav><a href="/nav">N</a></nav><div class="breadcrumb">Home &gt; News</div><div class="content"><h1>The  <b>heading</b></h1><p>Body text that is long enough to count as the content of this page, more than eighty letters.</p>
<a href="file.PDF">Report</a><a href="javascript:void(0)">no</a><div style="display: none">hidden</div><div onclick="location.href='/click'">c</div></div></body></html>"""


def test_interpretation():
    f = interpret("https://example.test/a/", HTML)
    assert f["error"] is None and f["title"] == "The heading" and f["summary"] == "About it" and f["section"] == "Home > News" and f["canonical_url"] == "https://example.test/canon?a=2&b=1"
    assert "hidden" not in f["body"] and f["body"].startswith("The heading") is False or "Body text" in f["body"]
    assert f["published_confidence"] == 0.95 and f["published_micros"] == 1767323045000000
    assert {(x["url"], x["source"]) for x in f["links"]} >= {("https://example.test/nav", "html_link"), ("https://example.test/deep/file.PDF", "html_link"), ("https://example.test/feed", "rss"), ("https://example.test/click", "onclick"), ("https://example.test/api/list?page=2", "script_url")}
    assert f["attachments"] == [{"url": "https://example.test/deep/file.PDF", "name": "Report"}]


def test_interpreter_edges():
    assert interpret(None, None)["error"] is None and interpret("https://[bad", "<p>x")["error"]
    deep = "<div>" * 5000 + "text" + "<p>" * 100
    assert interpret("https://e.test/x", deep)["body"] == "text"
    assert decode_body("页面".encode("gb18030")) == "页面" and decode_body(b"a\0b\0\0") == "a b" and decode_body("é".encode("cp1252"), "text/html; charset=cp1252") == "é"
    assert parse_date("2026年3月4日 05:06").isoformat() == "2026-03-04T05:06:00+00:00" and parse_date("2026-13-45") is None
    p = Page('<div id="a" class="x y"><span data-k="v">t</span></div>')
    assert [p.find(s) for s in ("#a", ".y", "div.x", "[data-k=v]", "span", "b")] == [1, 1, 1, 2, 2, None]
    handler = Page("""<script>[{id: "c1", path: "/list"}]</script><div onclick="showDetail('7','','c1')">t</div><div onclick="showBaseDetail('9','',1)">u</div>""")
    assert [u for u, s, _ in handler.links() if s == "onclick"] == ["/list?id=7", "?id=9"]


LONG = "word " * 60
# (url, title, body html) -> type; our own cases for each step of the cascade
TYPES = [
    ("https://e.test/", "x", "", "home"), ("https://e.test/login", "x", "", "login"), ("https://e.test/search?q=a", "x", "", "search"), ("https://e.test/news/detail/12", "x", "", "article"), ("https://e.test/notice/detail/12", "x", "", "notice"), ("https://e.test/product/view/3", "x", "", "product"),
    ("https://e.test/news/", "x", "", "news_list"), ("https://e.test/notice/", "x", "", "notice_list"), ("https://e.test/newsstatus", "x", "", "article"), ("https://e.test/about", "x", "", "profile"), ("https://e.test/research", "x", "", "research"), ("https://e.test/career", "x", "", "recruitment"), ("https://e.test/contact", "x", "", "contact"),
    ("https://e.test/zzz", "x", "<ul>" + "<li>item of a long list</li>" * 10 + "</ul>", "list"), ("https://e.test/zzz", "x", "", "other"), ("https://e.test/zzz", "公告", "", "notice"), ("https://e.test/zzz", "Daily news", "", "article"), ("https://e.test/zzz", "x", f"<p>2026-01-02 and 2026-01-03 {LONG}</p>", "article"), ("https://e.test/app?id=77", "x", "", "article"),
    ("https://e.test/zzz", "用户登录", "", "login"), ("https://e.test/?News%2F241.html=", "x", "", "article"), ("https://e.test/archives/55.html", "x", "", "article"), ("https://e.test/special", "x", "", "research"),
]


def test_types(spark):
    rows = [(k, u, f"<html><title>{t}</title><body>{b}</body></html>") for k, (u, t, b, _) in enumerate(TYPES)]
    f = pages.facts(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: r.page_type for r in pages.classify(f, routes=(("/special", "research", "s"),)).collect()}
    assert [(TYPES[k], v) for k, v in sorted(got.items()) if v != TYPES[k][3]] == []


def site(spark):
    page = lambda title, *links: f"<html><title>{title}</title><body>" + "".join(f'<a href="{x}">{x}</a>' for x in links) + "</body></html>"
    rows = [
        ("https://s.test/", 200, "text/html", page("Home", "/a", "/b", "/a?utm_source=x", "https://other.test/", "/private", "/user/login", "/old")), ("https://s.test/a", 200, "text/html", page("A", "/c")), ("https://s.test/b", 200, "text/html", page("404 - gone")), ("https://s.test/c", 200, "text/html", page("C", "/d")),
        ("https://s.test/d", 200, "text/html", page("D")), ("https://s.test/robots.txt", 200, "text/plain", "User-agent: *\nDisallow: /private"), ("https://s.test/sitemap.xml", 200, "text/xml", "<urlset><url><loc>https://s.test/m</loc></url></urlset>"), ("https://s.test/m", 200, "text/html", page("M")),
    ]
    df = spark.createDataFrame([(*r, None) for r in rows], crawl.RESPONSE.replace("body string, ", "body string, "))
    moved = spark.createDataFrame([("https://s.test/old", 301, "text/html", "", "/d")], crawl.RESPONSE)
    return df.select("url", "status", "media_type", "body", "redirect_to").union(moved)


def test_crawl(spark):
    c = crawl.collect_site(spark, ["https://s.test"], site(spark), Scope(hosts=("s.test",)), batch=10)
    pages_ = {r.canonical_url: r for r in c.pages.collect()}
    assert set(pages_) == {f"https://s.test/{p}" for p in ("", "a", "b", "c", "d", "m", "old")}
    assert pages_["https://s.test/b"].issue == "soft_404" and pages_["https://s.test/c"].depth == 2
    assert {(r.url, r.reason) for r in c.exclusions.collect()} >= {("https://other.test/", "external_host"), ("https://s.test/private", "robots_disallowed"), ("https://s.test/user/login", "login_route")}
    row = c.coverage.first()
    assert (row.n_visited, row.n_pages, row.n_failures, row.converged, row.n_robots, row.status) == (7, 6, 0, True, 1, "completed")
    assert row.sources_attempted == ["explicit_seed", "sitemap", "html_link", "redirect"] and row.sources_succeeded == row.sources_attempted and row.limits_reached == [] and row.blind_spots == ["sitemap_unavailable"]
    assert row.n_requests == 7 and row.n_duplicates >= 2 and row.n_bytes == sum(len(r.body) for r in site(spark).collect() if not r.url.endswith((".txt", ".xml")))
    a = c.candidates.where("canonical_url = 'https://s.test/a'").first()
    assert a.aliases == ["https://s.test/a?utm_source=x"] and a.page_type


def test_crawl_budgets(spark):
    scope = Scope(hosts=("s.test",))
    run = lambda **limits: crawl.collect_site(spark, ["https://s.test"], site(spark), scope, crawl.Budget(**limits)).coverage.first()
    got = {k: run(**{k: v}) for k, v in {"max_candidates": 3, "max_requests": 3}.items()}
    assert {k: (r.status, r.limits_reached) for k, r in got.items()} == {k: ("partial", [k]) for k in got}
    assert got["max_requests"].n_requests == 3 and got["max_candidates"].n_candidates == 3
    both = run(max_depth=1, max_total_bytes=450)
    assert both.limits_reached == ["max_depth", "max_total_bytes"] or both.limits_reached == ["max_total_bytes"]
    ticks = iter(range(0, 10**6, 200))
    late = crawl.collect_site(spark, ["https://s.test"], site(spark), scope, batch=1, clock=lambda: next(ticks)).coverage.first()
    assert late.limits_reached == ["max_duration_seconds"] and late.status == "partial"
    with pytest.raises(crawl.CrawlError):
        crawl.collect_site(spark, ["mailto:x"], site(spark), scope)
    assert crawl.refresh_pages(spark, ["https://s.test/a"], site(spark), scope).pages.count() == 1


class Api(BaseHTTPRequestHandler):
    fails = 1

    def do_GET(self):  # noqa: N802
        if Api.fails:
            Api.fails -= 1
            self.send_response(429)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        at = int(self.path.partition("cursor=")[2] or 0)
        more = at < 4
        body = {"status": "completed", "records": [{"record_id": f"r{at + k}", "payload": {"b": k, "a": at}} for k in range(2)], "has_more": more, "next_cursor": str(at + 2) if more else None}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *a):
        pass


def test_job_source(spark, tmp_path):
    server = HTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert JobApi(url).status("j") == "completed"
    spark.dataSource.register(JobResults)
    stream = spark.readStream.format("job_results").option("url", url).option("job", "j").load()
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        import time

        for _ in range(120):
            time.sleep(0.5)
            done = list((tmp_path / "o").glob("*.parquet"))
            if done and spark.read.parquet(str(tmp_path / "o")).count() >= 6:
                break
    finally:
        q.stop()
        server.shutdown()
    rows = spark.read.parquet(str(tmp_path / "o")).collect()
    assert sorted(r.record_id for r in rows) == [f"r{k}" for k in range(6)] and rows[0].payload.startswith('{"a":')


def test_router():
    def down(ambiguous):
        def submit():
            raise UpstreamError("UNREACHABLE", "", True, ambiguous=ambiguous)

        return submit

    assert route({"a": down(False), "b": lambda: "j1"}) == ("b", "j1") and route({"a": lambda: "ja", "b": lambda: "jb"}, hint="b") == ("b", "jb")
    with pytest.raises(UpstreamError):
        route({"a": down(True), "b": lambda: "j1"})
    with pytest.raises(UpstreamError):
        route({})
    with pytest.raises(UpstreamError):
        route({"a": lambda: "ja"}, hint="zz")


def test_discovery(spark):
    from webloom.functions import discovery

    zipped = gzip.compress(b"<urlset><url><loc>https://a.test/1</loc></url></urlset>")
    responses = spark.createDataFrame([("i", b"<sitemapindex><sitemap><loc>z</loc></sitemap><sitemap><loc>i</loc></sitemap></sitemapindex>"), ("z", zipped), ("bad", b"<html>")], "url string, body binary")
    assert [r.url for r in discovery.sitemap_urls(spark.createDataFrame([("i",), ("bad",)], "url string"), responses).collect()] == ["https://a.test/1"]


def test_nothing_imports_the_training_data_package():
    root = Path(__file__).resolve().parent.parent / "webloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names), p


def test_fetch_attempts(spark):
    """A first error that may pass is tried once more; any other is not."""
    kind = crawl.RESPONSE + ", attempt int, error string, retryable boolean"
    rows = [("u1", 0, "", "", None, 1, "http_fetch_failed", True), ("u1", 200, "text/html", "ok", None, 2, None, False), ("u2", 0, "", "", None, 1, "response_too_large", False), ("u3", 0, "", "", None, 1, "http_fetch_failed", True)]
    got = {r.wire: r for r in crawl.replay(spark.createDataFrame(rows, kind))(spark.createDataFrame([("u1",), ("u2",), ("u3",), ("u4",)], "wire string")).collect()}
    assert [(got[u].status, got[u].error, got[u].requests) for u in ("u1", "u2", "u3", "u4")] == [(200, None, 2), (0, "response_too_large", 1), (0, "http_fetch_failed", 2), (404, None, 1)]


def test_rendering(spark):
    shell, full = '<html><div id="app"></div><script>x</script></html>', "<html>full</html>"
    pages_ = spark.createDataFrame([("a", 200, "text/html", shell, None), ("b", 200, "text/html", full, None), ("c", 200, "text/html", shell, None)], crawl.RESPONSE)
    made = spark.createDataFrame([("a", 200, "text/html", "rendered", None)], crawl.RESPONSE)
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "wire string")
    got = {r.wire: (r.body, r.rendered, r.fallback_failed) for r in crawl.hybrid(crawl.replay(pages_), crawl.replay(made, rendered=True))(wanted).collect()}
    assert got == {"a": ("rendered", True, False), "b": (full, False, False), "c": (shell, False, True)}
    assert {r.error for r in crawl.hybrid(crawl.replay(pages_), None, "required")(wanted).collect()} == {"rendering_required"}
    c = crawl.collect_site(spark, ["https://s.test/"], crawl.hybrid(crawl.replay(spark.createDataFrame([("https://s.test/", 200, "text/html", shell, None)], crawl.RESPONSE)), None), Scope(hosts=("s.test",)))
    assert "rendered_content_unavailable" in c.coverage.first().blind_spots


def test_auxiliary_redirects(spark):
    rows = [(f"https://s.test/{k}", 301, "", "", f"/{k + 1}") for k in range(8)] + [("https://s.test/8", 200, "", "end", None), ("https://s.test/out", 302, "", "", "https://other.test/"), ("https://s.test/ok", 200, "", "fine", None)]
    got = {r.url: (r.body, r.reason) for r in crawl.auxiliary(spark.createDataFrame([("https://s.test/0",), ("https://s.test/3",), ("https://s.test/out",), ("https://s.test/ok",), ("https://x.test/",)], "url string"), crawl.replay(spark.createDataFrame(rows, crawl.RESPONSE)), Scope(hosts=("s.test",))).collect()}
    assert got == {"https://s.test/0": (None, "too_many_redirects"), "https://s.test/3": ("end", None), "https://s.test/out": (None, "redirect_out_of_scope"), "https://s.test/ok": ("fine", None), "https://x.test/": (None, "external_host")}


def test_profile(spark):
    feed = ("https://s.test/rss", 200, "text/xml", "<rss><channel><item><link>https://s.test/fed</link></item></channel></rss>", None)
    pages_ = site(spark).union(spark.createDataFrame([feed, ("https://s.test/fed", 200, "application/json", '{"items": [{"url": "/from-json"}]}', None)], crawl.RESPONSE))
    profile = crawl.Profile("s", hints=("/rss", "/map.xml"), excluded=("/A$",))
    c, families, draft = crawl.inspect_site(spark, ["https://s.test"], pages_, Scope(hosts=("s.test",)), profile=profile, site_ref="s")
    got = {r.canonical_url for r in c.pages.collect()}
    assert {"https://s.test/fed", "https://s.test/from-json"} <= got and "https://s.test/a" not in got
    assert c.coverage.first().sources_attempted[:3] == ["explicit_seed", "sitemap", "rss"]
    with pytest.raises(crawl.CrawlError):
        crawl.resolve_profile(Scope(), "other", profile)
    d = draft.first()
    assert d.seeds[0] == "https://s.test/" and d.evidence[0].startswith("candidates:") and families.count() >= 3


def test_static_fetch(spark):
    class Site(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            big = self.path == "/big"
            self.send_response(302 if self.path == "/moved" else 200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            if self.path == "/moved":
                self.send_header("Location", "/there")
            self.end_headers()
            self.wfile.write(b"x" * 5000 if big else "<p>é</p>".encode())

        def log_message(self, *a):
            pass

    from webloom.sources.fetch import get, static

    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        rows = spark.createDataFrame([(url + p,) for p in ("/", "/moved", "/big")] + [("http://127.0.0.1:1/",)], "wire string")
        got = {r.wire.removeprefix(url): r for r in static(max_bytes=1000, allow_private=True)(rows).collect()}
        assert got["/"].body == "<p>é</p>" and got["/"].media_type == "text/html" and (got["/moved"].status, got["/moved"].redirect_to) == (302, "/there")
        assert got["/big"].error == "response_too_large" and (got["http://127.0.0.1:1/"].error, got["http://127.0.0.1:1/"].requests) == ("http_fetch_failed", 2)
        assert get(url)["error"] == "network_policy_denied"
    finally:
        server.shutdown()


def test_network_policy(spark):
    rows = [("https://a.test/", "GET", None), ("https://a.test/", "POST", "http_method_not_allowed"), ("ftp://a.test/", "get", "network_scheme_not_allowed"), ("https://u:p@a.test/", "HEAD", "network_credentials_not_allowed"), ("http://10.0.0.1/", "GET", "private_network"), ("http://metadata/", "GET", "private_network"), ("https://a.test:99999/", "GET", "invalid_network_url"), (None, "GET", "network_scheme_not_allowed")]
    df = spark.createDataFrame([(u, m, w) for u, m, w in rows], "u string, m string, w string")
    assert [r for r in df.select("u", "w", urls.network_policy(F.col("u"), F.col("m")).alias("got")).collect() if r.got != r.w] == []
    assert urls.network_reason("https://a.test/", resolve_host=lambda h: ["10.1.1.1"]) == "private_network" and urls.network_reason("https://a.test/", resolve_host=lambda h: []) == "dns_resolution_failed"


def test_scope_rules_of_text(spark):
    """Exclusions ignore case; lengths are those of what is requested; a scope may ignore other keys."""
    df = spark.createDataFrame([("https://e.test/Private/a",), ("https://e.test/" + "a" * 20 + "#" + "f" * 100,), ("https://e.test/a?keep=1&gclid=2",)], "u string")
    one = lambda s: [r.r for r in df.select(decide(F.col("u"), canonical_fast(F.col("u")), s).alias("r")).collect()]
    assert one(Scope(excluded=("/private",), max_url_length=60)) == ["path_excluded", None, None]
    assert df.select(canonical_fast(F.col("u"), ("keep",)).alias("c")).collect()[2].c == "https://e.test/a?gclid=2"


def test_plain_urls_are_not_sent_to_python(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(urls, "canonical", lambda *a, **k: 1 / 0)
    assert urls.exactly(pd.Series([None, None], dtype=object)).tolist() == [None, None]


def test_last_page_of_a_job(spark, tmp_path):
    """The last page has records and no cursor; for one page and for three."""
    from webloom.sources.jobs import MemoryJobs, PagedReader, all_records

    for n, size in ((1, 5), (3, 5), (0, 5), (5, 2)):
        api = MemoryJobs(lambda spec: [{"payload": {"k": k}} for k in range(spec["n"])], size)
        job = api.submit({"n": n}, f"key{n}")
        assert api.submit({"n": 99}, f"key{n}") == job and [r[0] for r in all_records(api, job)] == [f"record-{k + 1}" for k in range(n)]
    reader = PagedReader.__new__(PagedReader)
    reader.api, reader.job = api, job
    rows, end = reader.read(reader.initialOffset())
    rows2, end2 = reader.read(end)
    assert [r[0] for r in reader.readBetweenOffsets(reader.initialOffset(), end2)] == [r[0] for r in [*rows, *rows2]] and len(list(reader.readBetweenOffsets(end, end2))) == 2

    class Stuck(MemoryJobs):
        def results(self, job, cursor):
            return super().results(job, cursor) | {"has_more": True, "next_cursor": None}

    stuck = Stuck(lambda spec: [{"payload": {}}])
    with pytest.raises(UpstreamError) as e:
        all_records(stuck, stuck.submit({}, "k"))
    assert e.value.code == "UPSTREAM_CURSOR_STALLED"


def test_evidence_is_stored_once(spark, tmp_path):
    from webloom.sources.store import evidence

    rows = spark.createDataFrame([("html", "a", {"Etag": "1", "Cookie": "x"}), ("html", "a", {"Etag": "0"}), ("resource", "b", {})], "kind string, body string, headers map<string,string>")
    root = f"file://{tmp_path}/e"
    assert evidence(rows, root).count() == 3 and evidence(rows, root).count() == 3
    stored = spark.read.parquet(root).collect()
    assert sorted(r.body for r in stored) == ["a", "b"] and next(r for r in stored if r.body == "a").headers == {"Etag": "0"}


def test_texts_cut_within_a_reference():
    """A reference without its semicolon stays; attributes and scripts are read as ever."""
    page = Page("<h1>A &amp;&lt;b&#39; &eacute; &nosuch; c&amp</h1><a href='/x?a=1&amp;b=2&amp'>y</a><script>a&amp;b</script>")
    assert page.said(1) == "A &<b' é &nosuch; c&amp" and page.attrs[2]["href"] == "/x?a=1&b=2&" and page.text(3) == "a&amp;b"


def test_title_of_a_cut_heading(spark, tmp_path):
    spark.createDataFrame([(1, "https://e.test/a", "<h1>Les&amp;&amp</h1>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert web.page_title(spark, str(tmp_path)).first().title == "Les&&amp"
    assert web.crawl_replay(spark, str(tmp_path)).first().title == "Les&&amp"


def test_facts_hold_few_pages_at_once(monkeypatch):
    """Python objects of ROWS pages at most exist at a time, however large a batch is; other columns than those wanted are not made."""
    import pyarrow as pa

    from webloom.functions import html

    most, make = [], pa.array
    monkeypatch.setattr(html.pa, "array", lambda x, *more: most.append(len(x)) or make(x, *more))
    got = html.facts_of("links").func(make(["https://e.test/"] * 1000), make(["<a href='/x'>y</a>"] * 1000))
    assert len(got) == 1000 and max(most) <= html.ROWS and got[999].as_py() == {"links": [{"url": "/x", "source": "html_link", "text": "y"}]}


def test_large_batches_are_dealt(spark, monkeypatch):
    """A batch that is larger than a piece costs the same, is ranked alike, and no task has all of its answers."""
    ws = crawl.Workspace(spark, "test")
    got = spark.createDataFrame([(k, 1 + k % 2, "x" * (10 * k), k % 3 == 0, None) for k in range(1, 10)], "rank int, requests int, body string, rendered boolean, error string")
    used = {"requests": 1, "bytes": 5, "rendered": 0}
    limits = ({}, {"max_requests": 6}, {"max_requests": 15}, {"max_total_bytes": 100}, {"max_total_bytes": 5}, {"max_rendered_pages": 1})

    def run(most):
        return [sorted((r.rank, r.error or "", r.limit or "") for r in crawl._within_budget(got, most, crawl.Budget(**more), used).collect()) for more in limits]

    plain = run(9)
    assert [len(x) for x in plain] == [9, 3, 9, 4, 1, 6] and plain[3][-1] == (4, "byte_budget_exhausted", "max_total_bytes")
    monkeypatch.setattr(crawl, "PIECE", 2)
    assert run(9) == plain
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("best"))
    assert all(r.rank == r.best + 1 for r in crawl._first(rows, 500, ws, "ranked").collect())
    plans = []
    monkeypatch.setattr(crawl.P, "facts", lambda rows, *more: plans.append(rows._jdf.queryExecution().toString()) or rows)
    chosen = got.select("rank", F.lit("u").alias("canonical_url"), F.struct(F.lit("https://e.test/").alias("url")).alias("head"), F.lit(0).alias("depth"), F.array(F.struct(F.lit(1).alias("first"), F.lit("x").alias("source"))).alias("sources"))
    crawl._visit(lambda w: w.join(got, "rank"), chosen, 9, crawl.Budget(), used, ws, "answers")
    assert "SinglePartition" not in plans[0] and "Window" not in plans[0]
