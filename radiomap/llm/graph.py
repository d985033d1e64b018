"""Connected components of a table of links, by alternating star contraction.

Each round points every node at its smallest neighbour (large star, then small
star), which keeps the number of links and ends after O(log^2 n) rounds. Both
steps are one aggregate and one join; the result of a round is written to the
shared folder, so a lost executor rereads it. Nothing of the graph reaches the
driver but a count and a checksum of each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiomap.session import materialize


def _round(links: DataFrame) -> DataFrame:
    """links (u > v) -> links (u > v): every node to the least of its neighbourhood."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    root = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(root.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns ``node, root`` (root: least node reachable) for every linked node.

    Links may repeat, run either way or join a node to itself; rows with a null
    end are no links. Nodes without a link to another node are not returned; an
    empty table gives an empty table."""
    links = (links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
             .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    links, seen = materialize(links, "links"), None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            break
        seen = now
        links = materialize(_round(links), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
