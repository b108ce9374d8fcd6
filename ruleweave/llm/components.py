"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: A node's links are dealt over so many rows of its least neighbour, so that a hub's links don't meet in one task.
SALTS = 8


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """links (a, b) with m, the least of column u = a."""
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = links.withColumn("l_salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    return own.join(salted, (F.col("a") == F.col("u")) & (F.col("l_salt") == F.col("salt"))).drop("salt", "l_salt")


def connected_components(links: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(node, root) for every node of links (a, b), root being the smallest node it reaches; nulls and self-links are dropped.

    A round joins each node's links with the smallest neighbour of that node, which is salted, so a hub's links stay spread
    over tasks; nothing is collected. Rounds are written to the shared folder; rows is about the number of links, if known.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    last = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        # Large star: neighbours above u go to the least of u and its neighbours.
        large = _with_least(both.where("b > a"), low).select(F.col("b").alias("a"), F.least("m", "u").alias("b")).distinct()
        # Small star: u and its neighbours below go to the least of them.
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = _with_least(large, low).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        old, edges = edges, materialize(small.where("a <> b").distinct(), "stars", rows=rows)
        discard(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last, rows = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
