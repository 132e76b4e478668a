"""URL filters: rules first, then naive Bayes over segmented hosts and paths.

A rule (host, path) fits its host and all subdomains, if the url's path starts with the rule's; the longest rule decides. Urls that no rule fits are judged by multinomial naive Bayes, learned from those that a rule decides: tokens are the words of host and path. Letter runs are concatenated names, which Viterbi splits into the words of the largest unigram probability; unigram counts come from the visible words of all pages, of up to LONGEST letters. A letter run that no word covers costs as Norvig's unknown words do, 10 / (N * 10^length).

There is no lexicon to send: each distinct run is joined with the counts of all words that stand in it, and each distinct token with its counts, so every word and token counts at any size. Rule, verdict and odds are worked out once for each distinct url. Joins whose key can be hot are split (joins.hot_join).

Null urls and urls without :// have an empty host and path and no tokens: their verdict is that of the prior. Ties between classes allow. Without any rule's page of a class both are as likely. Repeated rows stay, null html has no words, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.joins import hot_join
from webloom.session import Workspace, ship

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
LONGEST = 24  #: letters of a word at most
SHORT = 3  #: words of up to so many letters, 18,278 at most, are sent to the tasks
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def matched(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as host and path in one string, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame) -> DataFrame:
    """Counts of the lower-cased words of A-Z of all pages' visible text."""
    visible = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    words = F.explode(F.split(F.translate(visible, UPPER, LOWER), "[^a-z]+"))
    return pages.select(words.alias("word")).where(f"word != '' and length(word) <= {LONGEST}").groupBy("word").agg(F.count("*").alias("n"))


def segment(name: str, counts: dict[tuple[int, int], int], total: int) -> list[str]:
    """The words of a letter run by unigram Viterbi; counts: of the known words in it, by start and length."""
    unknown = [math.log(max(total, 1) / 10) + k * math.log(10) for k in range(LONGEST + 1)]
    n = len(name)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - LONGEST), end):
            seen = counts.get((start, end - start))
            cost = best[start] + (unknown[end - start] if seen is None else -math.log(seen / total))
            if cost < best[end]:
                best[end], back[end] = cost, start
    out, end = [], n
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def segmented(names: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """run, words of each distinct letter run of names (nid, run). A run's number stands for it on the way, so that a very long one is not sent with each of its parts."""
    at = F.explode(F.sequence(F.lit(1), F.length("run")))
    tails = names.select("nid", "run", at.alias("at")).select("nid", "at", F.expr(f"substring(run, at, {LONGEST})").alias("tail"))
    parts = tails.select("nid", "at", "tail", F.explode(F.sequence(F.lit(1), F.length("tail"))).alias("size")).select("nid", "at", "size", F.expr("substring(tail, 1, size)").alias("word"))
    short = parts.where(f"size <= {SHORT}").join(F.broadcast(counts.where(f"length(word) <= {SHORT}")), "word")
    rest = parts.where(f"size > {SHORT}").join(counts.where(f"length(word) > {SHORT}"), "word")
    found = short.unionByName(rest).groupBy("nid").agg(F.collect_list(F.struct("at", "size", "n")).alias("known"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [segment(run, {(x["at"] - 1, x["size"]): x["n"] for x in known or ()}, total) for run, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.string()))], names=["run", "words"])

    return names.join(found, "nid", "left").select("run", "known").mapInArrow(split, "run string, words array<string>")


_RUNS = r"[a-z]+|[0-9]+|[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def runs_of(kind: str, text: Column) -> Column:
    """Runs of letters, digits, or other characters, as (kind, run); digits become their number."""
    return F.transform(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(_RUNS), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("kind"), F.when(x.rlike(r"\A[0-9]"), F.repeat(F.lit("#"), F.length(x))).otherwise(x).alias("run")))


def url_odds(urls: DataFrame, counts: DataFrame, ws: Workspace) -> DataFrame:
    """uid and log odds of block, without the prior, of distinct urls: uid, host, path, verdict (null: no rule's), n (pages). Urls without tokens are left out."""
    total = int(counts.agg(F.sum("n")).first()[0] or 0)
    part = F.explode(F.concat(runs_of("h", F.col("host")), runs_of("p", F.col("path"))))
    runs = urls.select("uid", "verdict", "n", part.alias("r")).groupBy("uid", "verdict", "n", "r").agg(F.count("*").alias("m"))
    runs = ws.save(runs.select("uid", "verdict", "n", "r.kind", "r.run", "m"), "runs")
    of = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n") * F.col("m"))), F.lit(0))
    known = ws.save(runs.groupBy("kind", "run").agg(of("block").alias("block"), of("allow").alias("allow"), F.count("*").alias("rows")), "known")
    names = ws.save(known.where(F.col("run").rlike(r"\A[a-z]")).select("run").distinct().withColumn("nid", F.monotonically_increasing_id()), "names")
    words = ws.save(segmented(names, counts, total), "split")
    token = F.explode(F.coalesce("words", F.array("run")))
    tokens = ws.save(known.join(words, "run", "left").select("kind", "run", "block", "allow", "rows", token.alias("word")), "tokens")
    seen = ws.save(tokens.groupBy("kind", "word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count("*").alias("held")), "seen")
    taught = seen.where("block + allow > 0")
    s = taught.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count("*").alias("n")).first()
    one = lambda c: F.log((F.col(c) + 1) / F.lit(float((s[c] or 0) + max(1, s["n"]))))
    weight = F.when(F.col("block") + F.col("allow") > 0, one("block") - one("allow")).otherwise(0.0)
    scored = hot_join(tokens.select("kind", "run", "rows", "word"), seen.select("kind", "word", "held", weight.alias("weight")), ["kind", "word"], "held")
    scored = ws.save(scored.groupBy("kind", "run", "rows").agg(F.sum("weight").alias("weight")), "weights")
    return hot_join(runs.select("uid", "kind", "run", "m"), scored, ["kind", "run"], "rows").groupBy("uid").agg(F.sum(F.col("weight") * F.col("m")).alias("odds"))


def url_verdicts(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, log_odds (of block)."""
    spark = pages.sparkSession
    ship(spark)
    ws = Workspace(spark, "urls")
    host, path = host_and_path(F.col("url").cast("string"))
    p = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    urls = p.groupBy("host", "path").agg(F.count("*").alias("n"))
    urls = ws.save(urls.select("host", "path", "n", rule.alias("rule"), verdict.alias("verdict")).withColumn("uid", F.monotonically_increasing_id()), "urls")
    n = {r.verdict: r.n for r in urls.where("verdict is not null").groupBy("verdict").agg(F.sum("n").alias("n")).collect()}
    odds = F.lit(0.0)
    if n.get("block") and n.get("allow"):
        counts = ws.save(word_counts(pages), "words")
        urls = urls.join(url_odds(urls, counts, ws), "uid", "left")
        odds = F.coalesce("odds", F.lit(0.0)) + math.log(n["block"] / n["allow"])
    judged = F.coalesce("verdict", F.when(F.round("log_odds", 9) > 0, "block").otherwise("allow"))
    urls = ws.save(urls.withColumn("log_odds", odds).select("host", "path", "n", "rule", judged.alias("verdict"), "log_odds"), "judged")
    return hot_join(p, urls, ["host", "path"], "n").select("page_id", "host", "path", "rule", "verdict", "log_odds")
