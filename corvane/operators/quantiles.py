"""Exact quantiles of groups of any size: range partitions of pre-aggregated values, and running counts.

Rows are first counted by group and value.  These counts are dealt out in ranges
of (group, value), so that a large group lies over many partitions.  A pass over
the partitions adds up each group's counts in each; a second one takes, from the
partitions that hold a wanted rank, the values at it.  No task holds a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.sources.shared import checkpointed


def value_counts(rows: DataFrame, sets: list[list[str]], value: str) -> DataFrame:
    """(group, value, n): how often each value occurs in each group of some grouping sets; null values are left out.

    group is a struct of the sets' columns, null where a set lacks one, and of
    `grouping`, the number of the set.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    own = rows.where(F.col(value).isNotNull()).select(*columns, F.col(value).alias("_value"))
    each = own.groupingSets([[*s, "_value"] for s in sets], *columns, "_value").agg(F.count("*").alias("n"), F.grouping_id(*columns, "_value").alias("grouping"))
    return each.select(F.struct(*columns, "grouping").alias("group"), F.col("_value").alias("value"), "n")


def quantiles_of_counts(counts: DataFrame, quantiles: dict[str, float], parts: int | None = None) -> DataFrame:
    """group and, for each name, the quantile of the group's values, linear between neighbours at rank (n - 1) q.

    counts has group, value and n, with one row for each group and value.  NaN
    is above all other numbers, as Spark orders it.
    """
    spark = counts.sparkSession
    ranges = counts.repartitionByRange(parts or _partitions(spark), "group", "value")
    # Written, so that both passes see the same ranges.
    dealt = checkpointed(ranges.withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("group", "part").agg(F.sum("n").alias("m"))
    before = Window.partitionBy("group").orderBy("part")  # as many rows of a group as there are partitions, at most
    placed = sums.withColumn("before", F.sum("m").over(before) - F.col("m")).withColumn("total", F.sum("m").over(Window.partitionBy("group")))
    ranks = {name: (F.col("total") - 1) * F.lit(float(q)) for name, q in quantiles.items()}
    held = lambda rank: (rank >= F.col("before")) & (rank < F.col("before") + F.col("m"))
    wanted = placed.where(reduce(lambda a, b: a | b, [held(f(r)) for r in ranks.values() for f in (F.floor, F.ceil)]))
    rows = dealt.join(wanted.select("group", "part", "before", "total"), ["group", "part"])
    running = F.sum("n").over(Window.partitionBy("group", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("before")
    rows = rows.withColumn("end", running)
    at = lambda rank: F.max(F.when((rank >= F.col("end") - F.col("n")) & (rank < F.col("end")), F.col("value")))
    found = rows.groupBy("group").agg(F.first("total").alias("total"), *[at(f(r)).alias(f"{name}_{side}") for name, r in ranks.items() for side, f in (("low", F.floor), ("high", F.ceil))])
    between = lambda name: F.col(f"{name}_low") + F.when(F.col(f"{name}_high") == F.col(f"{name}_low"), 0.0).otherwise((F.col(f"{name}_high") - F.col(f"{name}_low")) * (ranks[name] - F.floor(ranks[name])))
    return found.select("group", *[between(name).alias(name) for name in quantiles])


def _partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_quantiles(rows: DataFrame, sets: list[list[str]], value: str, quantiles: dict[str, float], *aggregates: Column) -> DataFrame:
    """The columns of some grouping sets, aggregates of their rows, `grouping` and exact quantiles of a value."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    whole = rows.groupingSets(sets, *columns).agg(*aggregates, F.grouping_id(*columns).alias("grouping")) if columns else rows.agg(*aggregates, F.lit(0).cast("bigint").alias("grouping"))
    # A value column takes the last bit of the counts' numbers, and stands in every set.
    found = quantiles_of_counts(value_counts(rows, sets, value), quantiles).withColumn("_grouping", F.shiftright(F.col("group.grouping"), 1))
    names = [f"_q_{c}" for c in columns]
    found = found.select(*[F.col(f"group.{c}").alias(n) for c, n in zip(columns, names, strict=True)], "_grouping", *quantiles)
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(columns, names, strict=True)]
    return whole.join(found, reduce(lambda a, b: a & b, same, F.col("grouping") == F.col("_grouping")), "left").drop(*names, "_grouping")
