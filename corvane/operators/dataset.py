"""Dataset preparation: samples, audits, overlaps and set operations on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seeded_sample(rows: DataFrame, key: str, count: int, seed: str) -> DataFrame:
    """The rows with the least MD5 of seed and key, which is a sample without replacement that any engine can repeat."""
    drawn = rows.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")))
    return drawn.orderBy("_h", key).limit(count).drop("_h")


def first_of_each(rows: DataFrame, keys: list[str], order: Column, count: int) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_n") <= count).drop("_n")


def audit(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One row: rows, distinct keys, surplus rows, rows with an empty text, first and last key."""
    return rows.agg(F.count("*").alias("n"), F.countDistinct(key).alias("distinct"), (F.count(key) - F.countDistinct(key)).alias("surplus"), F.count_if(F.col(text).isNull() | (F.trim(text) == "")).alias("empty"), F.min(key).alias("first"), F.max(key).alias("last"))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys in both."""
    return a.select(key).intersect(b.select(key))


def only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of a that b doesn't have."""
    return a.select(key).subtract(b.select(key))


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def partitioned_by_list(rows: DataFrame, name: str, listed: tuple[str, ...]) -> DataFrame:
    """Adds part: Other for listed names, classify for the rest."""
    return rows.withColumn("part", F.when(F.col(name).isin(*listed), "Other").otherwise("classify"))


def surplus_victims(names: DataFrame, name: str, keep: int) -> DataFrame:
    """All but the last `keep` names, which a rotation of backups takes away."""
    kept = names.orderBy(F.desc(name)).limit(keep)
    return names.join(kept, name, "left_anti")


def side_by_side(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of both by key, keys that one side misses), the input of a review of two files."""
    x, y = (f.select(key, *[F.col(c).alias(f"{n}_{c}") for c in f.columns if c != key]) for f, n in ((a, "a"), (b, "b")))
    missing = only_in(a, b, key).withColumn("side", F.lit("b")).unionByName(only_in(b, a, key).withColumn("side", F.lit("a")))
    return x.join(y, key), missing
