from pathlib import Path

from tests.llm import brute
from webloom.llm import near_dedup
from webloom.llm.near_dedup import estimate, kept_documents, near_duplicates, registers
from webloom.session import shared_root

import numpy as np
import pytest


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert got == brute.near(rows)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_edges(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30", "x")
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, base), (8, near), (9, base), (10, base + " " + base), (11, "z" * 100_000), (12, "Ünï " * 20)]
    check(spark, rows)


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(300):
        w = list(words)
        w[int(rng.integers(80))] = f"v{i % 37}"
        rows.append((i, " ".join(w)))
    check(spark, rows)


@pytest.mark.parametrize("pivots", [4, 10_000])
def test_chains_of_near_copies(spark, monkeypatch, pivots):
    """Texts that differ step by step, so that ends of a chain are not alike, and texts that share much and not enough; with rounds and without."""
    monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
    rng = np.random.default_rng(6)
    rows = []
    for g in range(6):
        w = [f"g{g}w{i}" for i in range(120)]
        for k in range(14):
            rows.append((100 * g + k, " ".join(w)))
            at = int(rng.integers(110))
            w[at : at + (1 if g < 3 else 3 if k % 3 else 12)] = [f"n{g}x{k}"]
    rows += [(900 + k, " ".join(f"c{i}" for i in range(60)) + f" only{k} " + " ".join(f"o{k}x{i}" for i in range(11 + k % 4))) for k in range(20)]
    check(spark, rows)


def test_rows_that_share_an_id(spark):
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    df = spark.createDataFrame([(1, base, "a"), (5, base, "b"), (5, other, "c"), (7, other, "d"), (5, None, "e"), (5, base, "f")], "doc_id long, text string, hash string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(1, 56, 1, True), (5, 0, 5, True), (5, 56, 1, False), (5, 56, 1, False), (5, 56, 5, True), (7, 56, 5, False)]
    assert sorted(r["hash"] for r in kept_documents(df).collect()) == ["a", "c", "e"]


def test_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"), (2, "a b c d e f", "w")], "doc_id long, text string, key string")
    out = near_duplicates(df)
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in out.collect()) == [(-1, -1), (1, 1), (1, 1), (2, 1)]
    kept = kept_documents(df)
    assert kept.columns == df.columns and sorted(r.key for r in kept.collect()) == ["x", "y", "z"]
    assert near_duplicates(df.limit(0)).count() == 0


def test_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for share in (0.0, 0.5, 0.85):
        n = int(3000 * 2 * share / (1 + share))
        y = np.concatenate([x[:n], rng.integers(0, 2**63, 3000 - n, dtype=np.uint64)])
        assert abs(estimate(registers(x), registers(y)) - share) < 0.17


def test_only_what_the_result_is_read_from_stays(spark):
    words = [f"w{k}" for k in range(60)]
    df = spark.createDataFrame([(i, " ".join(words[:58] + [f"x{i}"])) for i in range(5)], "doc_id long, text string")
    top = Path(shared_root(spark).removeprefix("file://")) / "webloom"
    before = set(top.glob("near-*"))
    kept = kept_documents(df)
    (made,) = set(top.glob("near-*")) - before
    assert {p.name for p in made.iterdir() if not p.name.startswith(".")} == {"sketch", "final"}
    assert [r.doc_id for r in kept.collect()] == [0]
