"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove_path, sized


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node that links reach) for every node of ``links`` (``a``, ``b``: longs).

    Self-links, repeated links and either direction are fine; null ends are left out; no links: no rows. A round is a
    few joins on node ids, written to the shared folder; rounds grow with the logarithm of the longest chain. No node's
    links are gathered in one place: minima are aggregated before they are shuffled, and a hub's join can be split.
    Minima of many links are not broadcast.
    """
    spark = links.sparkSession
    pairs = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark, n = None, edges.count()
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(sized(least, 2 * n), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(sized(lower, 2 * n), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b"))).distinct()
        old, edges = edges, materialize(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove_path(spark, old.inputFiles()[0].rsplit("/", 1)[0]) if old.inputFiles() else None
        if now == mark:
            break
        mark, n = now, now[0]
    else:
        raise RuntimeError(f"links have not settled in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()
