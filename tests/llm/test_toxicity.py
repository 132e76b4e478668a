import math

import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from webloom.llm import toxicity as T
from webloom.session import Workspace, ship


def grams_of(word):
    s = b" " + word.encode() + b" "
    return [s[max(0, k - T.ORDER + 1) : k + 1] for k in range(1, len(s))]


def test_ratios_against_dictionaries(spark):
    texts = [("the cat sat on the mat", 0), ("you vile cat", 1), ("vile vile vilest thing", 1), ("a plain thing, sat there", 0), ("unlabelled cats", -1), (None, 0), ("Ünd mehr", -1)]
    ship(spark)
    counted = spark.createDataFrame(texts, "text string, label int").mapInArrow(T._count, "gram long, c0 int, c1 int, c2 int, c3 int").groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("c0", "c1", "c2", "c3")])
    by_gram, by_context = T.ratios(counted, Workspace(spark, "test"))
    c = {0: {}, 1: {}}
    every = set()
    for text, label in texts:
        for w in brute.words(text, brute.PLAIN):
            for g in grams_of(w):
                every.add(g)
                if label >= 0:
                    c[label][g] = c[label].get(g, 0) + 1
    types, kinds = {}, {}
    for g in every:
        types[g[1:]] = types.get(g[1:], 0) + 1
        kinds[g[1:-1]] = kinds.get(g[1:-1], 0) + 1

    def log(label, g):
        same = {x: n for x, n in c[label].items() if x[:-1] == g[:-1]}
        h = sum(same.values())
        w = min(1, max(T.DISCOUNT * len(same) / h, T.PRIOR / (h + T.PRIOR))) if h else 1
        shared = 0.95 * types[g[1:]] / kinds[g[1:-1]] + 0.05 / 256
        return math.log((max(c[label].get(g, 0) - T.DISCOUNT, 0) / h if h else 0) + w * shared)

    got = {r.key: r.r1 for r in by_gram.collect()}
    want = {int.from_bytes(g, "big", signed=len(g) == 8): log(1, g) - log(0, g) for g in {*c[0], *c[1]}}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-5 for k, v in want.items())


def test_held_out_quality_and_blocks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = T.toxicity(docs, labels)
    rows = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.score, rows[r.doc_id]) for r in out.where("held_out").collect() if r.doc_id in rows]
    good = sum(a > b for a, x in held if x == 1 for b, y in held if y == 0) / (sum(x == 1 for _, x in held) * sum(y == 0 for _, y in held))
    assert good > 0.9 and out.count() == docs.count()
    model, w = T.train(docs, labels)
    one = {r.row: r.score for r in T.score(docs, model, w).collect()}
    many = {r.row: r.score for r in T.score(docs, T.Model(model.by_gram, model.by_context, "r1", block_rows=20_000), w).collect()}
    assert one.keys() == many.keys() and max(abs(one[k] - many[k]) for k in one) < 1e-4


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "words here", "c"), (None, "words here", "d"), (3, "x" * 300_000, "e")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(2, 1, 1), (2, 0, 0), (9, 1, None)], "doc_id long, quality int, toxic int")
    rows = T.toxicity(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert T.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert T.toxicity(docs.limit(0), labels).count() == 0
    assert T.clean(docs, labels.limit(0)).columns == docs.columns


def test_held_out_rule(spark):
    import zlib

    rows = spark.range(50).select("id", T.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)
    assert np.isfinite(T.fit(np.zeros((0, 2)), np.zeros(0))).all()
