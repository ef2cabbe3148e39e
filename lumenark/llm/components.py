"""Connected components of a link table, by alternating star contraction.

Links stay in tables: every round halves long chains, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import Scratch


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbours and itself."""
    both = _both(links)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) links to (node, component): the least node reachable, for every node but the least of each component.

    Links of a node to itself and repeated links do no harm; nulls are dropped; no links give no rows.
    """
    state, held = links.select("a", "b").where("a is not null and b is not null and a <> b"), None
    while True:
        # ends in the shuffle of its distinct, so adaptive execution writes few files
        stars = scratch.keep(_small_star(_large_star(state).where("a <> b").distinct()).where("a <> b").distinct())
        if held is not None:
            scratch.drop(held)
        state = held = stars
        # done when every link leads to a least node: no node has two links up, or links both up and down
        ends = stars.select(F.inline(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
        if ends.groupBy("v").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
