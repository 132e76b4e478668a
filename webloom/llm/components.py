"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.session import Workspace


def components(links: DataFrame, ws: Workspace, label: str) -> DataFrame:
    """(id, component) for every id in links (a, b): component is the smallest id reachable.

    Alternates the large-star and small-star steps (Kiveris et al. 2014): each step re-hangs neighbours on the smallest one, so chains fold in a logarithmic number of rounds and no step makes more rows than it reads. Self links and repeated links change nothing; no links give no rows.
    """
    edges = ws.save(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-0")
    step = 0
    while not _stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        step += 1
        edges = ws.save(small, f"{label}-{step}")
        ws.drop(f"{label}-{step - 1}")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Every a has one b, and no b is an a."""
    upper = edges.select(F.col("a").alias("b")).distinct().withColumn("met", F.lit(1))
    n, distinct, met = edges.join(upper, "b", "left").agg(F.count("*"), F.count_distinct("a"), F.count("met")).first()
    return n == distinct and not met
