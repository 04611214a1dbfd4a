"""Latency summaries and audits of run logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import is_safe
from corvane.operators.quantiles import with_quantiles


def latency_summary(rows: DataFrame, sets: list[list[str]], value: str = "seconds") -> DataFrame:
    """Attempts, successes and, of these, mean and 95th percentile, for each grouping set of columns.

    Percentiles are of the observations themselves (linear between neighbours),
    in every set; they are never averaged.
    """
    own = rows.withColumn("_ok", F.when(F.col("status") == "ok", F.col(value)))
    found = with_quantiles(own, sets, "_ok", {"p95": 0.95}, F.count("*").alias("attempts"), F.count("_ok").alias("successes"), F.avg("_ok").alias("mean"))
    return found.drop("grouping")


def full_summary(rows: DataFrame, by: list[str], value: str = "seconds") -> DataFrame:
    """n, mean, deviation (0 for one value), least, most, median and 95th percentile of a value."""
    v = F.col(value)
    deviation = F.when(F.count(v) > 1, F.stddev_samp(v)).when(F.count(v) == 1, 0.0).alias("std")
    found = with_quantiles(rows, [by], value, {"p50": 0.5, "p95": 0.95}, F.count(v).alias("n"), F.avg(v).alias("mean"), deviation, F.min(v).alias("least"), F.max(v).alias("most"))
    return found.drop("grouping")


def rolling_eta(rows: DataFrame, series: str, order: list[str], value: str, window: int = 50, least: int = 3) -> DataFrame:
    """Adds eta: the mean of the last `window` values times the rows left in the series; null below `least` values."""
    w = Window.partitionBy(series).orderBy(*order)
    recent = w.rowsBetween(-(window - 1), 0)
    left = F.count("*").over(Window.partitionBy(series)) - F.row_number().over(w)
    return rows.withColumn("eta", F.when(F.count(value).over(recent) >= least, F.avg(value).over(recent) * left))


def gap_tolerance(interval: Column) -> Column:
    return F.greatest(2.5 * interval, F.lit(2.5))


def series_gaps(rows: DataFrame, series: str, at: str, tolerance: Column) -> DataFrame:
    """For each series: samples, steps longer than the tolerance, steps back in time (in the order of `position`), and the longest."""
    step = F.col(at) - F.lag(at).over(Window.partitionBy(series).orderBy("position"))
    return rows.withColumn("step", step).groupBy(series).agg(F.count("*").alias("samples"), F.count_if(F.col("step") > tolerance).alias("gaps"), F.count_if(F.col("step") < 0).alias("unordered"), F.max("step").alias("longest"))


def series_coverage(rows: DataFrame, series: str, at: str, spans: DataFrame, tolerance: Column) -> DataFrame:
    """Whether each series' samples reach from its span's begin to its end, within the tolerance."""
    ends = rows.groupBy(series).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    return spans.join(ends, series, "left").withColumn("covered", F.coalesce((F.col("first") <= F.col("begin") + tolerance) & (F.col("last") >= F.col("finish") - tolerance), F.lit(False)))


def timing_closure(rows: DataFrame, bounds: list[str], total: str) -> DataFrame:
    """Adds deltas between rising bounds, whether they rise, and whether they add up to the total."""
    deltas = [F.col(b) - F.col(a) for a, b in zip(bounds, bounds[1:], strict=False)]
    rising = reduce(lambda a, b: a & b, [d >= 0 for d in deltas])
    whole = reduce(lambda a, b: a + b, deltas)
    return rows.withColumn("deltas", F.array(*deltas)).withColumn("rising", rising).withColumn("closed", F.abs(whole - F.col(total)) <= 1e-9 * F.greatest(F.abs(whole), F.abs(F.col(total)), F.lit(1e-12)))


def round_schedule(manifest: DataFrame, rounds: int) -> DataFrame:
    """Every row once in each round, in the rows' order: (round, position, order)."""
    n = manifest.agg(F.count("*").alias("n"))
    placed = manifest.join(n, how="cross").select("*", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    return placed.withColumn("run_order", (F.col("round") - 1) * F.col("n") + F.col("position")).drop("n")


def warmup_rows(rows: DataFrame, group: str, order: str, count: int = 5) -> DataFrame:
    """The first rows of each group, interleaved: run_order counts by rank, then group."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("rank") <= count)
    # At most `count` rows of each group are left here, so one ordering of them all is small.
    return ranked.withColumn("run_order", F.row_number().over(Window.orderBy("rank", group)))


def manifest_checks(manifest: DataFrame) -> DataFrame:
    """One row: ids unique, positions 1 to n, images that occur twice, and the sizes of the groups."""
    images = manifest.groupBy("image").agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("repeated_images"), F.count("*").alias("images"))
    groups = manifest.groupBy("source_group").agg(F.count("*").alias("c")).agg(F.min("c").alias("least_group"), F.max("c").alias("most_group"))
    whole = manifest.agg(F.count("*").alias("n"), (F.countDistinct("record_id") == F.count("*")).alias("unique_ids"), ((F.min("position") == 1) & (F.max("position") == F.count("*")) & (F.countDistinct("position") == F.count("*"))).alias("in_sequence"))
    return whole.join(images, how="cross").join(groups, how="cross")


def run_checks(rows: DataFrame) -> DataFrame:
    """(check, n_rows, n_failed) over observations of a run: keys, timings, branch, tokens and errors."""
    keys = rows.groupBy("model", "replica", "record_id").agg(F.count("*").alias("c")).agg(F.lit("unique_keys").alias("check"), F.count("*").alias("n_rows"), F.count_if(F.col("c") > 1).alias("n_failed"))
    branch = F.when(is_safe(F.col("response_text")), "safe").otherwise("hazard")
    checks = {
        "timings_present": (F.col("status") == "ok") == F.col("seconds").isNotNull(),
        "branch_recomputed": (F.col("status") != "ok") | (F.col("branch") == branch),
        "positive_seconds": F.col("seconds").isNull() | (F.col("seconds") >= 0),
        "token_tail": (F.col("status") != "ok") | F.col("last_token_id").isin(1, 2),
    }
    one = rows.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()])
    wide = one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("check"), F.col("n").alias("n_rows"), F.col(name).alias("n_failed")) for name in checks])))
    return keys.unionByName(wide)


def recomputed(expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str], slack: float = 1e-9) -> DataFrame:
    """Keys and values of two tables of figures that differ by more than the slack, or are on one side only."""
    e, a = (f.select(*keys, *[F.col(v).alias(f"{v}_{n}") for v in values]) for f, n in ((expected, "expected"), (actual, "actual")))
    differs = reduce(lambda x, y: x | y, [~F.coalesce(F.abs(F.col(f"{v}_expected") - F.col(f"{v}_actual")) <= slack, F.col(f"{v}_expected").isNull() & F.col(f"{v}_actual").isNull()) for v in values])
    return e.join(a, keys, "full").where(differs)


def attempt_histories(rows: DataFrame, key: str) -> DataFrame:
    """For each key whether its attempts are numbered 1 to n and the last one's text is the final text."""
    own = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("attempt", "raw"))).alias("tries"), F.max("final").alias("final"))
    numbered = F.forall(F.transform("tries", lambda t, i: t["attempt"] == i + 1), lambda ok: ok)
    return own.select(key, F.size("tries").alias("attempts"), numbered.alias("numbered"), (F.element_at("tries", -1)["raw"] == F.col("final")).alias("last_is_final"))


def latest_valid(log: DataFrame, key: str, position: str, valid: Column) -> DataFrame:
    """The last valid entry of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(position))
    return log.where(valid).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def metric_violations(cells: DataFrame) -> DataFrame:
    """Cells whose counts don't add up, whose rate isn't theirs, or that have a rate of nothing."""
    wrong = F.when(F.col("detected") + F.col("missed") != F.col("total"), "sum").when((F.col("total") == 0) & F.col("recall").isNotNull(), "rate_of_nothing").when((F.col("total") > 0) & (F.abs(F.col("recall") - F.col("detected") / F.col("total")) > 1e-12), "rate")
    return cells.withColumn("violation", wrong).where("violation is not null")
