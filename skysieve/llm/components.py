"""Connected components by contraction, for graphs of any shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skysieve.session import materialise

#: Rounds at most; each at least halves the nodes that still have links.
ROUNDS = 64


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`nodes` (node, distinct) with `root`: equal for two nodes if and only if `links` (a, b) connect them.

    Every round each node goes to the neighbour, or itself, with the smallest random number of the round, links
    are renamed and those inside a node vanish. Minima are taken map-side first, so a node with many links is no
    hot key there; the joins meet a side that has each node once, which Spark splits where the other is skewed.
    """
    roots = nodes.select("node", F.col("node").alias("root"))
    links = materialise(links.where("a <> b").select("a", "b").distinct(), "links")
    for turn in range(ROUNDS):
        if links.isEmpty():
            break
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        drawn = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("draw"), F.col(c).alias("to"))
        best = both.groupBy("a").agg(F.least(F.min(drawn("b")), F.min(drawn("a"))).alias("best"))
        moves = materialise(best.select(F.col("a").alias("root"), F.col("best.to").alias("to")), "moves")
        roots = materialise(
            roots.join(moves, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots"
        )
        named = links.join(moves.toDF("a", "new_a"), "a").join(moves.toDF("b", "new_b"), "b")
        links = materialise(
            named.where("new_a <> new_b")
            .select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b"))
            .distinct(),
            "links",
        )
    else:
        raise RuntimeError("links left after all rounds")
    return roots
