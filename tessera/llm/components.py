"""Connected components of a table of links, by alternating stars.

Links never leave the executors: each round is two joins on vertices, written to
the shared folder.  Ends when every vertex has one root, before the first round if
the links are stars already; a caller that adds links to known components gives
the stars of these and the new links.  Plans are kept small, for each exchange and
broadcast of a round costs the driver memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import persist


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """vertex, root for every vertex of the links (a, b); root is the least
    vertex of its component.  Loops and repeated links do no harm."""
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    while True:
        # Those that others are linked to are their own roots, unless they are linked further.
        named = now.select(F.col("a").alias("vertex"), F.col("b").alias("root")).union(now.select(F.col("b").alias("vertex"), F.col("b").alias("root")))
        named = named.groupBy("vertex").agg(F.min("root").alias("root"), F.max("root").alias("other"))
        if not named.agg(F.count_if(F.col("root") < F.col("other")).alias("n")).first().n:
            return named.select("vertex", "root")
        # Large stars: every larger neighbour of u is linked to the least vertex around u, which is u or a smaller one.
        least = _least(now)
        large = now.join(least, now.b == least.u, "left").select("a", F.coalesce("m", "b").alias("b"))
        # Small stars: every smaller neighbour of u, and u, is linked to the least of them.
        least = _least(large)
        small = large.join(least, large.a == least.u).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        now = persist(small.where("a <> b").distinct(), "links")
