"""Connected components of a link table, by alternating stars.

Each round rewrites the links so that nodes point at smaller ones: first every larger neighbour, then
every smaller one, is linked to the smallest node known around it. The links end as one star for each
component. Minima are pre-aggregated before they are shuffled, and are checkpointed before they are
joined: both sides of the joins are then plain shuffles, which adaptive execution splits where a node
has very many links. All checkpoints are in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _rewrite(links: DataFrame) -> DataFrame:
    """One large and one small star over links (a > b)."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
    large = checkpointed(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
    low = checkpointed(large.groupBy("a").agg(F.min("b").alias("m")))
    small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
    return small.where("a > b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link between two different nodes; component is its smallest node.

    Nulls and links of a node with itself are left out; repeated links count once; no links: no rows.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = checkpointed(links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a > b").distinct())
    mark = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    was = mark(now)
    while was[0]:
        now = checkpointed(_rewrite(now))
        if (new := mark(now)) == was:
            break
        was = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
