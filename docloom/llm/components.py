"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root): the smallest node that each node of a link reaches.

    Nodes are longs. Loops and repeated links change nothing; an empty table gives
    an empty one. Every round is written to the shared folder, as is the result; its joins
    are sorted merges, which adaptive execution may split at hubs and none of which the driver builds a table for.
    """
    edges = materialize(_ordered(links.select("a", "b")), "edges")
    while True:
        large = _star(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), F.col("b") > F.col("a"))
        small = materialize(_ordered(_star(_ordered(large), None)), "edges")
        discard(edges)
        # Done when every node has one smaller neighbour and no larger one, or only larger ones.
        ends = small.select(F.col("a").alias("node"), "b").unionByName(small.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("b")))
        ends = ends.groupBy("node").agg(F.min("b").alias("least"), F.max("b").alias("most"), F.count("b").alias("down"), F.count(F.lit(1)).alias("all"))
        if ends.filter("down > 0 and (down < all or least < most)").isEmpty():
            break
        edges = small
    roots = small.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    out = materialize(roots.unionByName(small.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "components")
    discard(small)
    return out


def _ordered(e: DataFrame) -> DataFrame:
    """Each edge once, from the larger node to the smaller."""
    return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _star(e: DataFrame, larger) -> DataFrame:
    """Link the neighbours of each node (those that ``larger`` keeps, or all) to the least of them and the node."""
    least = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    out = (e if larger is None else e.filter(larger)).join(least.hint("merge"), "a")
    out = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out if larger is not None else out.unionByName(least.select("a", F.col("m").alias("b")))
