"""Pages as DataFrames: facts, types, links, candidates and route families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.classify import classified
from webloom.functions.html import facts_of


def facts(pages: DataFrame, url: str = "url", markup: str = "html", only: tuple[str, ...] = ()) -> DataFrame:
    """The pages with a struct `facts`, or only some of them; each page is parsed once, the markup goes."""
    return pages.withColumn("facts", facts_of(*only)(url, markup)).drop(markup)


def classify(with_facts: DataFrame, media_type: Column | None = None, routes: tuple[tuple[str, str, str], ...] = ()) -> DataFrame:
    """Adds page_type, confidence, evidence."""
    return with_facts.withColumn("__c", classified(F.col("facts"), F.col("url"), media_type, routes)).select("*", "__c.*").drop("__c")


def links(with_facts: DataFrame, *keep: str) -> DataFrame:
    """A row for each link: page_id (or keep), position, url, source, text."""
    keep = keep or ("page_id",)
    return with_facts.select(*keep, F.posexplode("facts.links").alias("position", "l")).select(*keep, "position", "l.*")


def merge_candidates(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row for each canonical_url from observations (canonical_url, url, source, depth, priority, seq): the first url, least depth and priority, sources in order of their first appearance, the other urls as aliases. seq is when the best priority was first reached: a candidate that improves queues anew, one that doesn't keeps its place.

    Sources of one candidate are first reduced to one row each, so a page that everything links to costs no more than its distinct sources.
    """
    all_ = found if known is None else known.unionByName(found)
    by = all_.groupBy("canonical_url", "source").agg(F.min("seq").alias("first"), F.min("depth").alias("depth"), F.min(F.struct("priority", "seq")).alias("best"), F.min(F.struct("seq", "url")).alias("head"), F.collect_set("url").alias("urls"))
    merged = by.groupBy("canonical_url").agg(
        F.min("head")["url"].alias("url"),
        F.min("depth").alias("depth"),
        F.min("best").alias("best"),
        F.transform(F.array_sort(F.collect_list(F.struct("first", "source"))), lambda s: s["source"]).alias("sources"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("urls")))).alias("urls"),
    )
    return merged.select("canonical_url", "url", "depth", F.col("best.priority").alias("priority"), F.col("best.seq").alias("seq"), "sources", F.array_remove("urls", F.col("url")).alias("aliases"))


def fold(found: DataFrame) -> DataFrame:
    """Observations (canonical_url, url, source, depth, priority, seq) as one frontier row for each canonical URL; merge() adds more of them."""
    by = found.groupBy("canonical_url", "source").agg(F.min("seq").alias("first"), F.min("depth").alias("depth"), F.min(F.struct("priority", "seq")).alias("best"), F.min(F.struct("seq", "url")).alias("head"), F.collect_set("url").alias("urls"))
    return by.groupBy("canonical_url").agg(F.min("head").alias("head"), F.min("depth").alias("depth"), F.min("best").alias("best"), F.collect_list(F.struct("first", "source")).alias("sources"), F.array_distinct(F.flatten(F.collect_list("urls"))).alias("urls"))


def merge(rows: DataFrame) -> DataFrame:
    """Frontier rows, one for each canonical URL again: the first URL, the least depth and priority, each source with its first appearance, visited if one is."""
    every = F.flatten(F.collect_list("sources"))
    m = rows.groupBy("canonical_url").agg(F.min("head").alias("head"), F.min("depth").alias("depth"), F.min("best").alias("best"), every.alias("s"), F.array_distinct(F.flatten(F.collect_list("urls"))).alias("urls"), F.max("visited").alias("visited"))
    names = F.array_distinct(F.transform("s", lambda x: x["source"]))
    once = F.transform(names, lambda n: F.struct(F.array_min(F.transform(F.filter("s", lambda x: x["source"] == n), lambda x: x["first"])).alias("first"), n.alias("source")))
    return m.select("canonical_url", "head", "depth", "best", once.alias("sources"), "urls", "visited")


def source_names(sources: Column | str) -> Column:
    """Sources of a frontier row, in the order of their first appearance."""
    return F.transform(F.array_sort(sources), lambda x: x["source"])


def unfold(rows: DataFrame) -> DataFrame:
    """Frontier rows as candidates: canonical_url, url, depth, priority, seq, sources, aliases, visited."""
    url = F.col("head.url")
    return rows.select("canonical_url", url.alias("url"), "depth", F.col("best.priority").alias("priority"), F.col("best.seq").alias("seq"), source_names("sources").alias("sources"), F.array_sort(F.array_remove("urls", url)).alias("aliases"), "visited")


def route_families(pages: DataFrame, samples: int = 5) -> DataFrame:
    """Pages by the first segment of their path: pattern, n_pages, the first `samples` URLs in order and, if page_type is there, the types."""
    first = F.element_at(F.split(F.regexp_extract("canonical_url", r"^[a-z]+://[^/?#]*/?([^?#]*)", 1), "/"), 1)
    p = pages.withColumn("pattern", F.concat(F.lit("/"), first, F.lit("/*")))
    types = [F.array_sort(F.collect_set("page_type")).alias("page_types")] if "page_type" in pages.columns else []
    counts = p.groupBy("pattern").agg(F.count("*").alias("n_pages"), *types)
    # samples: a bounded minimum for each pattern, by rounds of a window that Spark limits before it shuffles
    from pyspark.sql import Window

    top = p.select("pattern", "canonical_url").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("pattern").orderBy("canonical_url"))).where(F.col("nth") <= samples)
    few = top.groupBy("pattern").agg(F.array_sort(F.collect_list("canonical_url")).alias("samples"))
    return counts.join(few, "pattern")


def status(agg: DataFrame) -> DataFrame:
    """The outcome of a collection from its counters: cancelled, else partial if a budget ended it, failed if nothing came, partial if something failed, completed."""
    return agg.withColumn("status", F.when(F.col("cancelled"), "cancelled").when(F.col("budget_exhausted"), "partial").when((F.col("n_pages") == 0) & (F.col("n_failures") > 0), "failed").when(F.col("n_failures") > 0, "partial").otherwise("completed"))
