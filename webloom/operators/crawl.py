"""A budgeted priority crawl as DataFrame rounds over a fetcher.

A round takes the best `batch` of the frontier by (priority, seq), fetches it, parses the pages, explodes their links, decides each link, and folds what is new into the frontier. The frontier is one table with a row for each canonical URL, saved once a round, so the plan of a round does not grow with the rounds before it, and a lost executor costs a round. Pages, links and issues are a folder for each round, read together at the end. The driver holds counters and the robots rules of the seeds' origins.

Order is part of the result, so every observation carries seq, a struct of round, place in the batch, place in the page.

Live fetching stays outside: a fetcher is a function from a DataFrame with the column `wire` to the same rows with the columns of FETCHED. replay() makes one from a stored table, hybrid() one from a static and a rendering one.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions import discovery, ids, text, urls
from webloom.functions.discovery import SITEMAP_PATHS, file_title, sitemap_urls
from webloom.operators import pages as P
from webloom.session import Workspace, ship

SEQ = "struct<turn:int,rank:int,at:int>"
RESPONSE = "url string, status int, media_type string, body string, redirect_to string"  #: and, if there are any: attempt int, error string, retryable boolean
FETCHED = ("status", "media_type", "body", "redirect_to", "error", "requests", "rendered", "fallback_failed")
REDIRECTS = 5
PIECE = 10_000  #: rows of a batch that one task may put in a line; a larger batch is dealt

Fetcher = Callable[[DataFrame], DataFrame]


class CrawlError(ValueError):
    """A crawl that can't begin: code says why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Budget:
    """Limits of a crawl; they are features, not shortcuts."""

    max_pages: int = 1000
    max_candidates: int = 5000
    max_depth: int = 8
    max_duration_seconds: float = 300.0
    max_requests: int = 10_000
    max_total_bytes: int = 256_000_000
    max_rendered_pages: int | None = None
    max_rounds: int = 10_000


@dataclass(frozen=True)
class Profile:
    """What is known of a site: rendering is none, preferred or required; hints are sitemaps, or feeds if their URL says rss, atom or feed."""

    site_ref: str = ""
    rendering: str = "none"
    hints: tuple[str, ...] = ()
    routes: tuple = ()
    excluded: tuple[str, ...] = ()
    scope: urls.Scope | None = None


def resolve_profile(scope: urls.Scope, site_ref: str, profile: Profile | None) -> tuple[urls.Scope, Profile]:
    """The scope that a profile leaves of a scope: never a wider one. A profile of another site is refused."""
    if profile is None:
        return scope, Profile(site_ref)
    if profile.site_ref and profile.site_ref != site_ref:
        raise CrawlError("PROFILE_INCOMPATIBLE", f"the profile is of {profile.site_ref!r}, not of {site_ref!r}")
    made = scope.intersect(profile.scope) if profile.scope else scope
    return replace(made, excluded=tuple(dict.fromkeys(made.excluded + profile.excluded))), profile


@dataclass
class Collection:
    pages: DataFrame  #: a row for each visited URL
    candidates: DataFrame
    exclusions: DataFrame  #: links that were refused, with reason
    coverage: DataFrame  #: one row
    sources: DataFrame = field(default=None)  #: discovery sources in the order of their first use, and whether they led to a candidate


def frontier_priority(source: Column, url: Column) -> Column:
    """0: seeds, sitemaps, feeds; 1: links; 2: data attributes; 3: scripts; 4: embedded files and resources."""
    resource = urls.resource_url(url)
    return F.when(source.isin("explicit_seed", "known_url", "sitemap", "rss"), 0).when(source.isin("html_link", "dom_link", "onclick", "meta_refresh", "redirect"), F.when(resource, 4).otherwise(1)).when(source == "script_url", 3).when(source == "embedded_url", 4).otherwise(2)


def replay(responses: DataFrame, rendered: bool = False) -> Fetcher:
    """A fetcher over a stored table. Unknown URLs are 404. A first attempt with a retryable error is followed by the second one, if the table has it; there is no third."""
    r = responses
    for name, value in (("attempt", F.lit(1)), ("error", F.lit(None).cast("string")), ("retryable", F.lit(False))):
        r = r if name in r.columns else r.withColumn(name, value)
    kept = [c for c in FETCHED if c in r.columns] + ["retryable"]

    def fetch(wanted: DataFrame) -> DataFrame:
        own = wanted.columns
        first = r.where("attempt = 1").select(F.col("url").alias("u1"), F.struct(*kept).alias("a1"))
        second = r.where("attempt = 2").select(F.col("url").alias("u2"), F.struct(*kept).alias("a2"))
        got = wanted.join(first, wanted["wire"] == F.col("u1"), "left").join(second, wanted["wire"] == F.col("u2"), "left")
        again = F.coalesce(F.col("a1.error").isNotNull() & F.col("a1.retryable"), F.lit(False))
        last = F.when(again, F.coalesce("a2", "a1")).otherwise(F.col("a1"))
        got = got.select(*[wanted[c] for c in own], last.alias("r"), F.when(again, 2).otherwise(1).alias("requests"))
        missing = F.col("r").isNull()
        return got.select(
            *own,
            F.when(missing, 404).otherwise(F.col("r.status")).alias("status"),
            F.coalesce("r.media_type", F.lit("text/html")).alias("media_type"),
            F.coalesce("r.body", F.lit("")).alias("body"),
            F.col("r.redirect_to").alias("redirect_to"),
            F.col("r.error").alias("error"),
            "requests",
            F.lit(rendered).alias("rendered"),
            F.lit(False).alias("fallback_failed"),
        )

    return fetch


def hybrid(static: Fetcher, rendering: Fetcher | None, need: str = "preferred") -> Fetcher:
    """A fetcher that renders: always (required), or where the static answer is a page that scripts have to fill (preferred). A rendering that fails leaves the static answer and says so; a required one that can't be had is an error."""

    def fetch(wanted: DataFrame) -> DataFrame:
        own = wanted.columns
        if need == "required":
            if rendering is None:
                none = F.lit(None).cast("string")
                return wanted.select(*own, F.lit(0).alias("status"), F.lit("").alias("media_type"), F.lit("").alias("body"), none.alias("redirect_to"), F.lit("rendering_required").alias("error"), F.lit(0).alias("requests"), F.lit(False).alias("rendered"), F.lit(True).alias("fallback_failed"))
            return rendering(wanted)
        got = static(wanted)
        if need == "none":
            return got
        shell = F.col("error").isNull() & F.col("status").between(200, 299) & text.app_shell(F.col("body"), F.col("media_type"))
        plain, shells = got.where(~shell), got.where(shell)
        if rendering is None:
            return plain.unionByName(shells.withColumn("fallback_failed", F.lit(True)))
        again = rendering(shells.select(*own)).select(F.col("wire").alias("w"), F.struct(*FETCHED).alias("n"))
        both = shells.join(again, shells["wire"] == F.col("w"), "left")
        good = F.coalesce(F.col("n.error").isNull() & F.col("n.status").between(200, 299), F.lit(False))
        made = [F.when(good, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in FETCHED if c not in ("requests", "fallback_failed")]
        both = both.select(*own, *made, (F.col("requests") + F.coalesce("n.requests", F.lit(0))).alias("requests"), (~good).alias("fallback_failed"))
        return plain.unionByName(both)

    return fetch


def auxiliary(wanted: DataFrame, fetch: Fetcher, scope: urls.Scope, hops: int = REDIRECTS) -> DataFrame:
    """Robots files, sitemaps and feeds (url) after their redirects: url, status, body, reason. Each hop is decided anew; reason says why there is no answer: a scope's reason, redirect_out_of_scope, too_many_redirects, or the fetcher's error."""
    ws = Workspace(wanted.sparkSession, "auxiliary")
    none = F.lit(None)

    def refused(rows: DataFrame) -> DataFrame:
        return rows.where("reason is not null").select("url", none.cast("int").alias("status"), none.cast("string").alias("body"), "reason")

    def why(column: Column) -> Column:
        return urls.decide(column, urls.canonical_fast(column, scope.ignored_query_keys), scope, auxiliary=True)

    now = ws.save(wanted.select("url", urls.wire_url("url").alias("wire"), why(F.col("url")).alias("reason")), "asked")
    done = [refused(now)]
    now = now.where("reason is null").select("url", "wire")
    for hop in range(hops + 1):
        got = ws.save(fetch(now).select("url", "wire", "status", "body", "redirect_to", "error"), f"hop{hop}")  # one join a hop, most often the only one
        done.append(got.where("redirect_to is null").select("url", "status", "body", F.col("error").alias("reason")))
        moved = got.where("redirect_to is not null").select("url", urls.wire_link("redirect_to", "wire").alias("wire"))
        moved = ws.save(moved.withColumn("reason", F.when(why(F.col("wire")).isNotNull(), "redirect_out_of_scope")), f"moved{hop}")
        done.append(refused(moved))
        now = moved.where("reason is null").select("url", "wire")
        if now.isEmpty():
            break
    done.append(refused(now.withColumn("reason", F.lit("too_many_redirects"))))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _robots(answers: DataFrame, agent: str) -> dict[str, dict]:
    """Rules of each origin, one row of the answers each: a 4xx file allows all, another failure nothing."""
    out = {}
    for r in answers.collect():
        fine = r.status is not None and 200 <= r.status < 300
        state = "available" if fine else "unavailable" if r.status is not None and 400 <= r.status < 500 else "unreachable"
        out[r.url.removesuffix("/robots.txt")] = {"state": state, **(urls.parse_robots(r.body or "", agent) if fine else {"allow": [], "disallow": [], "sitemaps": []})}
    return out


def _allowed(canon: Column, rules: dict[str, dict]) -> Column:
    origin, path = F.regexp_extract(canon, r"^[a-z]+://[^/?#]*", 0), F.regexp_extract(canon, r"^[a-z]+://[^/?#]*([^#]*)", 1)
    ok = F.lit(True)
    for o, r in rules.items():
        ok = F.when(origin == o, urls.robots_allows(path, r["allow"], r["disallow"], r["state"])).otherwise(ok)
    return ok


def _seq(turn: int, rank: Column, at: Column) -> Column:
    return F.struct(F.lit(turn).cast("int").alias("turn"), rank.cast("int").alias("rank"), at.cast("int").alias("at"))


def collect_site(spark: SparkSession, seeds: list[str] | DataFrame, responses: DataFrame | Fetcher, scope: urls.Scope, budget: Budget = Budget(), batch: int = 64, collection_id: str = "collection", agent: str = "webloom", follow: bool = True, source: str = "explicit_seed", routes: tuple = (), profile: Profile | None = None, site_ref: str = "", respect_robots: bool = True, clock: Callable[[], float] = time.time, evidence_root: str | None = None) -> Collection:  # noqa: B008
    """Pages, candidates, exclusions, coverage and sources of a site. follow=False visits the seeds only (a refresh). Seeds may be a table with a column url; then robots files and sitemaps are left out, since their origins are not bounded."""
    ship(spark)
    ws = Workspace(spark, "crawl")
    fetch: Fetcher = replay(responses) if isinstance(responses, DataFrame) else responses
    scope, profile = resolve_profile(scope, site_ref, profile)
    routes = routes or profile.routes
    began, limits, blind = clock(), set(), set()

    def canon_of(column: Column) -> Column:
        return urls.canonical_fast(column, scope.ignored_query_keys)

    rules: dict[str, dict] = {}
    if isinstance(seeds, DataFrame):
        start = _numbered(seeds.select("url").distinct(), "url", ws, "seeds").select("url", F.lit(source).alias("source"), F.lit(0).alias("depth"), _seq(0, F.col("rank"), F.lit(0)).alias("seq"))
    else:
        canon_seeds = list(dict.fromkeys(c for c in (urls.canonical(s, ignored=scope.ignored_query_keys) for s in seeds) if c))
        if not canon_seeds:
            raise CrawlError("INVALID_SPEC", "no usable seed")
        origins = urls.origins(canon_seeds)
        start = spark.createDataFrame([(s, source, 0, k) for k, s in enumerate(dict.fromkeys(s.strip() for s in seeds if s and s.strip()))], "url string, source string, depth int, k int").select("url", "source", "depth", _seq(0, F.col("k"), F.lit(0)).alias("seq"))
        if respect_robots:
            asked = spark.createDataFrame([(f"{o}/robots.txt",) for o in origins], "url string")
            rules = _robots(ws.save(auxiliary(asked, fetch, scope), "robots"), agent)
            blind |= {f"robots_{r['state']}" for r in rules.values() if r["state"] != "available"}
        if follow:
            start = start.unionByName(_discovered(spark, fetch, scope, origins, rules, profile, ws, blind))

    def decided(found: DataFrame) -> DataFrame:
        """Adds canonical_url and reason."""
        f = found.withColumn("canonical_url", canon_of(F.col("url")))
        reason = F.coalesce(urls.decide(F.col("url"), F.col("canonical_url"), scope), F.when(F.col("source") == "redirect", F.lit(None)).otherwise(F.when(F.col("source") != source, urls.unsafe_reason(F.col("canonical_url")))), F.when(~_allowed(F.col("canonical_url"), rules), "robots_disallowed"))
        f = f.withColumn("reason", reason).withColumn("reason", F.when((F.col("source") == "redirect") & F.col("reason").isNotNull(), "redirect_out_of_scope").otherwise(F.col("reason")))
        return f.withColumn("priority", frontier_priority(F.col("source"), F.col("url")).cast("int"))

    kinds = ["canonical_url", "url", "source", "depth", "priority", "seq", "reason"]
    links = [ws.save(decided(start).select(*kinds), "links0")]
    state, n_known, capped = _admit(None, links[0], budget.max_candidates, ws, 0)
    if not n_known:
        raise CrawlError("INVALID_SPEC", "no seed is in scope")
    visited: list[DataFrame] = []
    got = None
    used = {"requests": 0, "bytes": 0, "rendered": 0}
    n_pages, turn = 0, 0
    while turn < budget.max_rounds:
        waiting = state.where("not visited")
        within = waiting.where(F.col("depth") <= budget.max_depth)
        left = budget.max_pages - n_pages
        if left <= 0 or clock() - began >= budget.max_duration_seconds or limits & {"max_requests", "max_total_bytes", "max_rendered_pages"}:
            if not waiting.isEmpty():
                limits |= {"max_pages"} if left <= 0 else {"max_duration_seconds"} if clock() - began >= budget.max_duration_seconds else set()
            break
        chosen = _first(within, min(batch, left), ws, f"chosen{turn}")
        got = ws.save(_visit(fetch, chosen, min(batch, left), budget, used, ws, f"answers{turn}"), f"pages{turn}")
        ws.drop(f"chosen{turn}", f"answers{turn}")
        n, requests, size, rendered, over = got.agg(F.count("*"), F.sum("requests"), F.sum("n_bytes"), F.count_if("rendered"), F.array_sort(F.collect_set("limit"))).first()
        if not n:
            break
        used = {"requests": used["requests"] + (requests or 0), "bytes": used["bytes"] + (size or 0), "rendered": used["rendered"] + rendered}
        limits |= set(over)
        n_pages += n
        turn += 1
        if evidence_root:
            from webloom.sources.store import evidence

            body = got.where("status between 200 and 299 and content != ''").select(F.when(discovery.looks_html(F.col("media_type"), F.col("content")), "html").otherwise("resource").alias("kind"), F.col("content").alias("body"), F.create_map().cast("map<string,string>").alias("headers"))
            evidence(body, evidence_root).write.format("noop").mode("overwrite").save()
        visited.append(got.drop("content"))
        found = _found_links(got, turn) if follow else _moved(got, turn)
        links.append(ws.save(decided(found).select(*kinds), f"links{turn}"))
        seen = got.select("canonical_url")
        before = state
        state, n_known, more = _admit(before, links[-1], budget.max_candidates, ws, turn, seen, n_known)
        capped = capped or more
        ws.drop(f"state{turn - 1}")
    if capped:
        limits.add("max_candidates")
    if not state.where(~F.col("visited") & (F.col("depth") > budget.max_depth)).isEmpty():
        limits.add("max_depth")
    if visited:
        every_page = spark.read.schema(visited[0].schema).parquet(*[f"{ws.path}/pages{k}" for k in range(turn)])
    else:
        every_page = (got if got is not None else _visit(fetch, _first(state.limit(0), 0, ws, ""), 0, budget, used, ws, "")).drop("content")
    pages = ws.save(_page_rows(every_page, collection_id, routes), "pages")
    every = spark.read.schema(links[0].schema).parquet(*[f"{ws.path}/links{k}" for k in range(len(links))])
    types = pages.select("canonical_url", "page_type", "confidence")
    candidates = P.unfold(state).join(types, "canonical_url", "left")
    candidates = ws.save(candidates, "candidates")
    exclusions = ws.save(every.where("reason is not null").select("canonical_url", "url", "source", "reason").distinct(), "exclusions")
    sources = every.groupBy("source").agg(F.min("seq").alias("first"), F.max(F.col("reason").isNull()).alias("succeeded"))
    sources = ws.save(sources, "sources")
    if not pages.where("fallback_failed or issue = 'rendering_required'").isEmpty():
        blind.add("rendered_content_unavailable")
    duplicates = every.where("reason is null").count() - n_known
    report = coverage(pages, candidates, exclusions, limits, turn, blind, sources, max(0, duplicates), used)
    return Collection(pages, candidates, exclusions, report, sources)


def _discovered(spark: SparkSession, fetch: Fetcher, scope: urls.Scope, origins: list[str], rules: dict, profile: Profile, ws: Workspace, blind: set[str]) -> DataFrame:
    """URLs of sitemaps and feeds: those that robots files name, the conventional ones, and a profile's hints."""
    hints = [h if "://" in h else urls.resolve(h, o + "/") for h in profile.hints for o in origins] if origins else list(profile.hints)
    feeds = [h for h in hints if any(t in h.lower() for t in ("rss", "atom", "feed"))]
    maps = [m for r in rules.values() for m in r["sitemaps"]] + [o + p for o in origins for p in SITEMAP_PATHS] + [h for h in hints if h not in feeds]
    maps, feeds = list(dict.fromkeys(maps)), list(dict.fromkeys(feeds))

    def answers(wanted: DataFrame) -> DataFrame:
        return auxiliary(wanted, fetch, scope).select("url", F.when(F.col("status").between(200, 299), F.col("body")).alias("body"))

    asked = spark.createDataFrame([(m,) for m in maps], "url string")
    level, bodies = asked, None
    for k in range(discovery.DEPTH + 1):  # index files lead to more sitemaps
        got = ws.save(answers(level), f"sitemaps{k}")
        bodies = got if bodies is None else bodies.unionByName(got)
        level = discovery.locations(got).where("is_index").select(F.col("loc").alias("url")).distinct()
        if level.isEmpty():
            break
    if not bodies.where("body is null").isEmpty():
        blind.add("sitemap_unavailable")
    listed = sitemap_urls(asked, bodies.where("body is not null").dropDuplicates(["url"]).select("url", F.col("body").cast("binary").alias("body")))
    line = Window.orderBy("url")  # what a site's sitemaps list
    out = listed.select("url", F.lit("sitemap").alias("source"), F.lit(1).alias("depth"), _seq(0, F.lit(1 << 20) + F.row_number().over(line), F.lit(0)).alias("seq"))
    if feeds:
        fed = ws.save(answers(spark.createDataFrame([(f,) for f in feeds], "url string")), "feeds")
        if not fed.where("body is null").isEmpty():
            blind.add("feed_unavailable")
        items = fed.where("body is not null").select("url", F.posexplode(discovery.feed_urls(F.col("body"))).alias("k", "link"))
        items = items.select(urls.wire_link("link", "url").alias("url"), F.lit("rss").alias("source"), F.lit(1).alias("depth"), _seq(0, F.lit(1 << 29), F.col("k")).alias("seq"))
        out = out.unionByName(items)
    return out


def _numbered(rows: DataFrame, by: str, ws: Workspace, name: str) -> DataFrame:
    """The rows with their rank by a column, from 1 on: they are sorted in ranges, and each range counts from where the ones before it end."""
    rows = ws.save(rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    sizes = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    rank = F.col("__before") + F.col("__at") - F.shiftleft("__part", 33) + 1
    return rows.withColumn("__part", part).join(F.broadcast(sizes), "__part").withColumn("rank", rank.cast("int")).drop("__part", "__at", "__before")


def _first(within: DataFrame, most: int, ws: Workspace, name: str) -> DataFrame:
    """The best rows of the frontier, at most so many, with their rank."""
    if most > PIECE:
        return _numbered(within, "best", ws, name).where(F.col("rank") <= most)
    return within.orderBy("best").limit(most).withColumn("rank", F.row_number().over(Window.orderBy("best")))


def _visit(fetch: Fetcher, chosen: DataFrame, most: int, budget: Budget, used: dict, ws: Workspace, name: str) -> DataFrame:
    """Answers and facts of a batch of frontier rows, most of them at most."""
    wanted = chosen.select("canonical_url", F.col("head.url").alias("url"), "depth", P.source_names("sources").alias("sources"), "rank").withColumn("wire", urls.wire_url("url"))
    got = fetch(wanted)
    if most > PIECE:  # fetched once, and parsed in all tasks
        got = ws.save(got.repartition(int(ws.spark.conf.get("spark.sql.shuffle.partitions")), "rank"), name)
    got = _within_budget(got, most, budget, used)
    return P.facts(got.withColumn("n_bytes", F.octet_length("body").cast("long")).withColumn("content", F.col("body")), "wire", "body")


def _within_budget(got: DataFrame, most: int, budget: Budget, used: dict) -> DataFrame:
    """The answers that the budget pays for, in the order of the batch: what is asked for after the last request is not visited; the answer that exceeds the bytes or rendered pages fails, and nothing after it is visited."""
    costs = {"requests": F.col("requests"), "bytes": F.octet_length("body"), "rendered": F.col("rendered").cast("int")}
    order = Window.orderBy("rank") if most <= PIECE else Window.partitionBy("piece").orderBy("rank")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    g, start = got, {k: F.lit(n) for k, n in used.items()}
    if most > PIECE:
        g = got.withColumn("piece", F.floor((F.col("rank") - 1) / PIECE))
        pieces = g.groupBy("piece").agg(*[F.sum(c).alias(k) for k, c in costs.items()])
        total = pieces.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in costs]).first()
        spent = {k: used[k] + total[k] for k in costs}
        if spent["requests"] < budget.max_requests and spent["bytes"] <= budget.max_total_bytes and spent["rendered"] <= (budget.max_rendered_pages if budget.max_rendered_pages is not None else spent["rendered"]):
            return got.withColumn("limit", F.lit(None).cast("string"))
        before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
        pieces = pieces.select("piece", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in costs])
        g = g.join(F.broadcast(pieces), "piece")
        start = {k: F.lit(used[k]) + F.col(f"{k}_before") for k in costs}
    g = g.withColumns({f"{k}_upto": F.sum(c).over(upto) + start[k] for k, c in costs.items()})

    def over(upto: dict) -> Column:
        limit = F.when(upto["bytes"] > budget.max_total_bytes, "max_total_bytes")
        return limit if budget.max_rendered_pages is None else F.coalesce(limit, F.when(upto["rendered"] > budget.max_rendered_pages, "max_rendered_pages"))

    sums = {k: F.col(f"{k}_upto") for k in costs}
    g = g.withColumn("over", over(sums)).where(over({k: sums[k] - F.coalesce(c, F.lit(0)) for k, c in costs.items()}).isNull() | (F.col("rank") == 1)).where(sums["requests"] <= budget.max_requests)
    last = F.when(sums["requests"] >= budget.max_requests, "max_requests")
    codes = {"max_total_bytes": "byte_budget_exhausted", "max_rendered_pages": "rendered_page_budget_exhausted"}
    failed = F.coalesce(F.col("error"), *[F.when(F.col("over") == k, v) for k, v in codes.items()])
    return g.withColumn("error", failed).withColumn("limit", F.coalesce("over", last)).select(*got.columns, "limit")


def _moved(got: DataFrame, turn: int) -> DataFrame:
    """Redirects of pages, as observations at the same depth."""
    moved = got.where("error is null and redirect_to is not null")
    return moved.select(urls.wire_link("redirect_to", "wire").alias("url"), F.lit("redirect").alias("source"), "depth", _seq(turn, F.col("rank"), F.lit(0)).alias("seq"))


def _found_links(got: DataFrame, turn: int) -> DataFrame:
    """Links of pages, URLs of JSON answers, and redirects."""
    fine = got.where("error is null and status between 200 and 299 and redirect_to is null")
    html = discovery.looks_html(F.col("media_type"), F.col("content"))
    rows = fine.where(html).select("wire", "depth", "rank", F.posexplode("facts.links").alias("at", "link"))
    rows = rows.select("wire", F.col("link.url").alias("raw"), F.col("link.source").alias("source"), (F.col("depth") + 1).alias("depth"), _seq(turn, F.col("rank"), F.col("at")).alias("seq"))
    data = fine.where(~html & discovery.looks_json(F.col("media_type"), F.col("content"))).select("wire", "depth", "rank", F.posexplode(discovery.json_urls("content")).alias("at", "raw"))
    data = data.select("wire", "raw", F.lit("data_url").alias("source"), (F.col("depth") + 1).alias("depth"), _seq(turn, F.col("rank"), F.col("at")).alias("seq"))
    rows = rows.unionByName(data).withColumn("url", urls.wire_link("raw", "wire"))
    rows = rows.select(F.when(F.col("url") == "", F.col("raw")).otherwise(F.col("url")).alias("url"), "source", "depth", "seq")
    return rows.unionByName(_moved(got, turn))


def _admit(state: DataFrame | None, links: DataFrame, most: int, ws: Workspace, turn: int, seen: DataFrame | None = None, known: int = 0) -> tuple[DataFrame, int, bool]:
    """The frontier with the accepted links and visits of a round; how many candidates it has; whether some found no room. New candidates are taken in the order of their first observation."""
    new = P.fold(links.where("reason is null"))
    if state is not None:
        new = new.join(state.select("canonical_url", F.lit(True).alias("old")), "canonical_url", "left")
    else:
        new = new.withColumn("old", F.lit(None).cast("boolean"))
    new = ws.save(new, f"new{turn}")
    fresh = new.where("old is null").drop("old")
    n = fresh.count()
    room = max(0, most - known)
    admitted = fresh if n <= room else fresh.orderBy("head").limit(room)
    made = admitted.unionByName(new.where("old").drop("old")).withColumn("visited", F.lit(False))
    if state is not None:
        visits = state.join(seen.distinct(), "canonical_url", "left_semi").withColumn("visited", F.lit(True)) if seen is not None else state.limit(0)
        made = P.merge(state.unionByName(visits).unionByName(made))
    made = ws.save(made, f"state{turn}")
    ws.drop(f"new{turn}")
    return made, known + min(n, room), n > room


def _page_rows(visited: DataFrame, collection_id: str, routes: tuple) -> DataFrame:
    """Page records: type, title (a file's own where it is no page), issues, identity. A URL that moved or failed keeps its row, with the issue."""
    c = P.classify(visited.withColumn("page_url", F.col("url")).withColumn("url", F.col("wire")), F.col("media_type"), routes)
    title = F.when(F.col("page_type") == "attachment", file_title(F.col("wire"))).otherwise(F.col("facts.title"))
    issue = F.coalesce("error", F.when(F.col("redirect_to").isNotNull(), "redirected"), F.when(~F.col("status").between(200, 299), "http_status"), F.when(F.col("facts.error").isNotNull(), "interpretation_failed"), F.when(text.soft_not_found(F.col("facts.title"), F.col("facts.body")), "soft_404"))
    return c.select("canonical_url", F.col("page_url").alias("url"), "depth", "status", "sources", "page_type", "confidence", title.alias("title"), F.col("facts.summary").alias("summary"), F.col("facts.body").alias("body"), F.col("facts.section").alias("section"), F.timestamp_micros("facts.published_micros").alias("published_at"), text.language(F.coalesce(F.nullif("facts.body", F.lit("")), "facts.title")).alias("language"), issue.alias("issue"), F.size("facts.links").alias("n_links"), F.col("facts.attachments").alias("attachments"), "requests", "n_bytes", "rendered", "fallback_failed", ids.page_record_id(F.lit(collection_id), F.col("canonical_url")).alias("record_id"))


def coverage(pages: DataFrame, candidates: DataFrame, exclusions: DataFrame, limits: set[str], rounds: int, blind: set[str], sources: DataFrame, duplicates: int, used: dict) -> DataFrame:
    """One row: counts, usage, sources tried and fruitful, blind spots, limits reached, status, converged (nothing waits and no limit was met)."""
    failed = F.col("issue").isNotNull() & ~F.col("issue").isin("redirected", "soft_404", "interpretation_failed")
    p = pages.agg(
        F.count("*").alias("n_visited"),
        F.count_if(~failed & (F.col("issue").isNull() | (F.col("issue") != "redirected"))).alias("n_pages"),
        F.count_if(failed).alias("n_failures"),
        F.count_if(F.col("page_type") == "attachment").alias("n_files"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("deepest"),
        F.count_if("rendered").alias("n_rendered"),
    )
    c = candidates.agg(F.count("*").alias("n_candidates"), F.count_if(~F.col("visited")).alias("n_waiting"))
    x = exclusions.agg(F.count("*").alias("n_exclusions"), F.count_if(F.col("reason") == "robots_disallowed").alias("n_robots"))
    order = F.array_sort(F.collect_list(F.struct("first", "source", "succeeded")))
    s = sources.agg(order.alias("s")).select(F.transform("s", lambda v: v["source"]).alias("sources_attempted"), F.transform(F.filter("s", lambda v: v["succeeded"]), lambda v: v["source"]).alias("sources_succeeded"))
    row = p.crossJoin(c).crossJoin(x).crossJoin(s)  # four rows of one
    texts = lambda v: F.array(*[F.lit(k) for k in sorted(v)]).cast("array<string>")
    row = row.withColumns({
        "cancelled": F.lit(False), "budget_exhausted": F.lit(bool(limits)), "limits_reached": texts(limits), "blind_spots": texts(blind), "rounds": F.lit(rounds), "n_duplicates": F.lit(duplicates).cast("long"), "n_requests": F.lit(used["requests"]).cast("long"), "n_bytes": F.lit(used["bytes"]).cast("long"),
    })
    return P.status(row).withColumn("converged", (F.col("n_waiting") == 0) & ~F.col("budget_exhausted"))


def refresh_pages(spark: SparkSession, known: list[str], responses: DataFrame | Fetcher, scope: urls.Scope, **more) -> Collection:
    """Known pages again; links are not followed."""
    return collect_site(spark, known, responses, scope, follow=False, source="known_url", **more)


def inspect_site(spark: SparkSession, seeds: list[str], responses: DataFrame | Fetcher, scope: urls.Scope, budget: Budget = Budget(120, 1000, 4, 120.0), **more) -> tuple[Collection, DataFrame, DataFrame]:  # noqa: B008
    """A small crawl, its route families and a profile draft: up to 10 seeds, what was seen as evidence strings, and what stays unknown."""
    c = collect_site(spark, seeds, responses, scope, budget, **more)
    families = P.route_families(c.pages.where("issue is null or issue != 'redirected'").select("canonical_url", "page_type"))
    first = c.pages.orderBy("canonical_url").limit(10).agg(F.array_sort(F.collect_list("canonical_url")).alias("seeds"), F.concat_ws(", ", F.array_sort(F.collect_set("page_type"))).alias("page_types"))
    said = lambda name, column: F.concat(F.lit(f"{name}:"), F.col(column).cast("string"))
    evidence = F.array_compact(F.array(said("candidates", "n_candidates"), said("visited", "n_visited"), said("pages", "n_pages"), F.when(F.size("sources_succeeded") > 0, F.concat(F.lit("sources:"), F.array_join("sources_succeeded", ","))), F.when(F.col("n_duplicates") > 0, said("duplicates", "n_duplicates"))))
    unknown = F.concat(F.col("blind_spots"), F.transform("limits_reached", lambda v: F.concat(F.lit("limit:"), v)))
    draft = first.crossJoin(c.coverage.select(evidence.alias("evidence"), unknown.alias("unknowns")))  # two rows of one
    return c, families, draft


def replay_pages(spark: SparkSession, sf_dir: str) -> Collection:
    """A crawl of the whole pages table: every page is a seed, and every link of a page is visited."""
    stored = spark.read.parquet(f"{sf_dir}/pages.parquet").select(urls.canonical_fast(F.col("url")).alias("url"), F.coalesce("html", F.lit("")).alias("body"))
    responses = Workspace(spark, "replay").save(stored.where("url != ''").groupBy("url").agg(F.min("body").alias("body")), "bodies")
    responses = responses.select("url", F.lit(200).alias("status"), F.lit("text/html").alias("media_type"), "body", F.lit(None).cast("string").alias("redirect_to"))
    free = 1 << 62
    return collect_site(spark, responses.select("url"), responses, urls.Scope(), Budget(free, 1 << 31 - 1, 1, float("inf"), free, free), batch=1 << 30)
