import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from webloom.llm import chat, licenses, mixing, queries, urls
from webloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    clean = lambda x: round(x, 6) if isinstance(x, float) else x
    a = sorted([tuple(clean(r[c]) for c in sorted(names)) for r in got.collect()], key=str)
    b = sorted([tuple(clean(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in want.fetchall()], key=str)
    assert a == b


def test_mixing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert [r.asDict() for r in mixing.mix(docs.repartition(5)).collect()] == [r.asDict() for r in rows]
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    target, taken = {}, {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        target[source[r.doc_id]] = r.target
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert all(abs(target[s] - taken[s]) < 1 for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(r.size for r in rows)) < 1
    assert all(a.position <= b.position for a, b in zip(rows, rows[1:], strict=False) if a.position is not None and b.position is not None)


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, None, None), (2, " \t", "t"), (3, "c " * 100, None)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 5 and all(r.taken <= 2 * r.size for r in rows) and mixing.mix(docs.limit(0)).count() == 0


def test_chat_parts(spark):
    parts = chat.PARTS
    rows = spark.createDataFrame([(1, 0, "user", [("text", "see <image_1> & [INST]", None, None), ("image", None, "a.png", 2)]), (1, 1, "assistant", [("text", "</s>ok", None, None), ("audio", None, "b.wav", 10)]), (2, 0, None, None)], f"conv_id long, turn long, role string, parts {parts}")
    f = {r.conv_id: r for r in chat.read_back(chat.flatten(rows)).collect()}
    assert f[1].texts[0] == "see <image_1> & [INST]<image_1>" and f[1].roles == ["user", "assistant"]
    assert [(a.placeholder, a.ref, a.tokens) for a in f[1].attachments] == [("<image_1>", "a.png", 512), ("<audio_2>", "b.wav", 250)]
    assert f[1].attachment_tokens == 762 and f[1].loss_text == "</s>ok<audio_2>" and f[2].texts == [""]
    assert "&lt;image_1>" in f[1].formatted and chat.flatten(rows.limit(0)).count() == 0
    s = f[1].loss_spans[0]
    assert f[1].formatted[s["start"] - 1 : s["start"] - 1 + s["length"]] == "&lt;/s>ok<audio_2>"


def test_license_inheritance(spark):
    apache, mit = "// Licensed under the Apache License, Version 2.0.\ncode", "Released under the MIT License."
    files = [(1, "LICENSE", mit), (2, "a/x.py", "plain"), (3, "a/b/LICENSE", apache), (4, "a/b/c/y.py", "plain"), (5, "a/z.py", apache), (6, None, None), (7, "q.py", ""), (8, "a/b/c/y.py", "plain")]
    got = {r.doc_id: (r.license, r.license_from, r.license_dir) for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "header", None), 2: ("MIT", "directory", ""), 3: ("Apache-2.0", "header", None), 4: ("Apache-2.0", "directory", "a/b"), 5: ("Apache-2.0", "header", None), 6: ("MIT", "directory", ""), 7: ("MIT", "directory", ""), 8: ("Apache-2.0", "directory", "a/b")}
    assert licenses.scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_url_rules(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    extra = [(-1, None, "x"), (-2, "nohost", None), (-3, "http://EXAMPLE.com/en/7?x#y", ""), (-4, "https://org/es/", ""), (-5, "http://xorg/es/1", "")]
    rows = pages.select("page_id", "url", "html").unionByName(spark.createDataFrame(extra, "page_id long, url string, html string"))
    known = {r.page_id: r.url for r in rows.collect()}
    html = {r.page_id: r.html for r in rows.collect()}
    out = urls.url_verdicts(rows).collect()
    assert len(out) == len(known)
    for r in out:
        rest = known[r.page_id].split("://", 1)[1] if known[r.page_id] and "://" in known[r.page_id] else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].translate(brute.UP), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fit = [(t, k) for k, t in urls.RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])]
        best = max(fit, key=lambda f: len(f[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, best[0]) and r.verdict == (best[1] or r.verdict) and r.verdict in ("allow", "block")


    odds = brute.url_odds([(r.host, r.path, html[r.page_id]) for r in out], [dict((x, k) for k, x in urls.RULES).get(r.rule) for r in out])
    for r, o in zip(out, odds, strict=True):
        assert abs(r.log_odds - o) < 1e-6 and (r.rule or r.verdict == ("block" if o > 1e-9 else "allow"))


def test_url_edges(spark):
    """Repeated rows, an empty table, a very long url, other columns, no page of a class."""
    long = "http://en.com/" + "ab" * 10_000
    rows = [(1, "http://a.com/en/cheaploansnow", "cheap loans now <b>cheap</b>", 0), (1, "http://a.com/en/cheaploansnow", None, 0), (2, "http://b.net/de/kindwords", "kind words", 1), (3, long, "ab", 2), (4, "http://c.io/cheap-kind", "", 3), (5, None, None, 4), (None, "x", "x", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int").withColumn("verdict", F.lit("z"))
    got = urls.url_verdicts(df).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in got if r.rule) == [(1, "block"), (1, "block"), (2, "allow")] and len(got) == 7
    assert urls.url_verdicts(df.limit(0)).count() == 0
    assert {r.verdict for r in urls.url_verdicts(df.where("page_id > 2")).collect()} == {"allow"}


def test_segmentation():
    counts = {"cheap": 50, "loans": 40, "now": 60, "an": 90, "so": 80}
    name = "cheaploansnow"
    known = {(i, len(w)): n for w, n in counts.items() for i in range(len(name)) if name.startswith(w, i)}
    assert urls.segment(name, known, 400) == ["cheap", "loans", "now"] and urls.segment("", {}, 0) == []


def test_license_cosine(spark, sf):
    """Own licenses against plain vectors: all documents, headers of several lines, repeated words, a very long line, ties, other columns."""
    rows = [(r.doc_id, r.path, r.text) for r in licenses.as_files(spark.read.parquet(f"{sf}/documents.parquet")).collect()]
    full = licenses.TEMPLATES["MIT"].split("|")[0]
    rows += [(-1, "z/LICENSE", full.replace(" copy ", "\n copy ") + "\n\nmore words"), (-2, "z/a", "license license license mit"), (-3, None, "permission " * 30_000), (-4, "COPYING", full.replace(",", ",\n")), (-5, "z/a", "Released under the MIT License. Licensed under CC BY-NC 4.0."), (-5, "z/a", None), (-6, "z/b", "license , .")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("x")).withColumn("dir", F.lit(1))
    got = {(r.doc_id, r.path): (r.own_license and (r.own_license, r.own_score)) for r in licenses.scan(df).collect() if r.doc_id != -5}
    want = brute.licenses([(p, t) for _, p, t in rows], licenses.TEMPLATES, licenses.LICENSE_WORD, licenses.LICENSE_FILE, licenses.MIN_COSINE)
    want = {r[:2]: w for r, w in zip(rows, want, strict=True) if r[0] != -5}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert (got[k] is None) == (w is None) and (w is None or (got[k][0] == w[0] and abs(got[k][1] - w[1]) < 2e-6)), (k, got[k], w)


def test_license_query_is_native(spark, sf):
    plan = queries.op6_license_scan(spark, sf)._jdf.queryExecution().executedPlan().toString()
    chat_plan = queries.op10_chat_formatting(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan + chat_plan and "Arrow" not in plan + chat_plan and F is not None
