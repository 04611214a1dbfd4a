"""Connected components of a graph given by its links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.textkit import checkpointed


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked with the node's least neighbour."""
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked with the least of these."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for each node with a link; root is the least node reachable.

    links has two columns u and v of one type without nulls.  Each round is the
    alternation of large and small stars, which needs about the logarithm of the
    longest path in rounds; no node's neighbours are gathered in one place.  The
    rounds end when the links no longer change.
    """
    links = checkpointed(links.select("u", "v").where("u <> v").distinct())
    print_of = lambda frame: tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = None
    for _ in range(most_rounds):
        links = checkpointed(_small_star(_large_star(links)))
        now = print_of(links)
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select("root", "root").distinct())
