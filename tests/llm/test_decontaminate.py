from tests.llm import brute
from webloom.llm.decontaminate import clean, contamination


def check(spark, docs, bench, window=10):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    rows = contamination(d, b, window).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in rows}
    want = brute.leaks(docs, bench, window)
    assert got == want
    assert {r.doc_id: (r.longest_words, r.longest_at, r.longest_item) for r in rows} == brute.longest_matches(docs, bench, window)


def test_whole_tables(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    check(spark, docs, bench)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(25))
    docs = [(1, None), (2, ""), (3, "x " + long.upper() + ", y"), (4, "short one here"), (5, "short, ONE"), (6, "a a a a a a a a a a a a a"), (7, "é" * 50_000 + " short one"), (8, long[: len(long) // 2])]
    check(spark, docs, [(1, long), (2, long), (3, "Short one"), (4, None), (5, ""), (6, "a a a a a a a a a a a")])
    # longer matches than a window, equal items, equal matches of two items, a null id, an overlap of two
    more = long + " " + long
    check(spark, [(1, f"q {more} q"), (1, f"q {more} q"), (2, f"{long} w3 {long}"), (3, " ".join(more.split()[5:40]))], [(9, more), (10, more), (8, long), (None, f"{more} w1"), (7, f"zz {long} yy")])
    check(spark, docs, [])
    check(spark, [], [(1, long)])


def test_blocks_and_clean(spark):
    docs = spark.createDataFrame([(i, f"n{i} a{i} b{i} c{i} d", "k") for i in range(30)], "doc_id long, text string, row string")
    bench = spark.createDataFrame([(i, f"a{i} b{i} c{i}") for i in range(0, 30, 3)], "item_id long, text string")
    from webloom.llm.decontaminate import contaminated_spans

    got = {r.row for r in contaminated_spans(docs, bench, block_bytes=64).where("size(spans) > 0").collect()}
    assert got == set(range(0, 30, 3))
    rows = [(1, "x a b c d e f g"), (2, "c d e f"), (3, None)]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d e", "b c d e f g", "c d e f", "", "x a b c"])], "item_id long, text string")
    found = contaminated_spans(spark.createDataFrame(rows, "doc_id long, text string"), items, 3, block_bytes=24).collect()
    assert {r.row: r.longest and (r.longest.words, r.longest.first, str(r.longest.item)) or (0, None, None) for r in found} == brute.longest_matches(rows, [tuple(r) for r in items.collect()], 3)
    left = clean(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(30)) - got
