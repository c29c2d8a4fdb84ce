"""Connected components of an edge table by alternating large-star and small-star rounds.

All work is joins and map-side-combined minima over edges; the number of rounds grows with the logarithm of the
largest component.  Every round is written in the shared folder and the one before it removed.  Nothing but two
checksums of a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b.  Large star: neighbours above a node go to its least; small star: those below it."""
    sides = edges.select("a", "b")
    if large:
        sides = sides.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = sides.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        least = least.select("a", F.least("a", "m").alias("m"))
    met = sides.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) -> (node, root): every node of the table that isn't a root itself, with the least node of its component.

    Direction, repeats and self-links of ``edges`` don't matter; an empty table has no components.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    said = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == said or not seen[0]:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out._strata_path = now._strata_path
            return out
        said = tuple(seen)
        after = cut(_star(_star(now, True), False), "links")
        drop_cut(now)
        now = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
