"""Evaluation aggregates: recall slices, confusion matrices, field scores, distance errors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.measures import distance_bin, f1
from corvane.functions.text import CATEGORIES, LABELS
from corvane.operators.quantiles import with_quantiles


def recall_slices(results: DataFrame) -> DataFrame:
    """(method, slice, category, distance_bin, detected, missed, total, recall), tidy.

    Slices are overall, category (each label of an object counts), bin (without
    Unknown) and category_bin.  A cell that never occurs is absent.
    """
    kind = "struct<whole:boolean,category:string>"
    cells = F.concat(F.array(F.lit(None).cast("string")), F.coalesce("categories", F.array().cast("array<string>")))
    own = results.select("method", "detected", distance_bin(F.col("distance_steps")).alias("distance_bin"), F.explode(F.transform(cells, lambda c, i: F.struct((i == 0).alias("whole"), c.alias("category")).cast(kind))).alias("cell"))
    own = own.select("method", "detected", "distance_bin", "cell.whole", "cell.category")
    sums = [F.count_if("detected").alias("detected"), F.count_if(~F.col("detected")).alias("missed"), F.count("*").alias("total")]
    keys = ["method", "whole", "category"]
    found = own.groupingSets([keys, [*keys, "distance_bin"]], *keys, "distance_bin").agg(F.grouping("distance_bin").alias("g"), *sums)
    name = F.when(F.col("whole"), F.when(F.col("g") == 1, "overall").otherwise("bin")).otherwise(F.when(F.col("g") == 1, "category").otherwise("category_bin"))
    tidy = found.select("method", name.alias("slice"), "category", "distance_bin", "detected", "missed", "total")
    return tidy.where("slice <> 'bin' or distance_bin <> 'Unknown'").withColumn("recall", F.try_divide("detected", "total"))


def recall_deltas(slices: DataFrame, first: str, second: str) -> DataFrame:
    """Recall of the first method less that of the second where both have one."""
    of = lambda m: F.max(F.when(F.col("method") == m, F.col("recall")))
    return slices.groupBy("slice", "category", "distance_bin").agg(of(first).alias("first_recall"), of(second).alias("second_recall")).where("first_recall is not null and second_recall is not null").withColumn("delta", F.col("first_recall") - F.col("second_recall"))


def fractional_confusion(events: DataFrame) -> DataFrame:
    """(method, actual, predicted, mass): each event of label arrays a and p spreads a mass of one."""
    spread = events.select("method", "a", "p", (F.lit(1.0) / (F.size("a") * F.size("p"))).alias("w"))
    return spread.select("method", F.explode("a").alias("actual"), "p", "w").select("method", "actual", F.explode("p").alias("predicted"), "w").groupBy("method", "actual", "predicted").agg(F.sum("w").alias("mass"))


def row_normalised(matrix: DataFrame, value: str) -> DataFrame:
    """A full matrix over the labels, each row in percent of its sum; 0 for an empty row."""
    spark = matrix.sparkSession
    labels = spark.createDataFrame([(a, i, p, j) for i, a in enumerate(LABELS) for j, p in enumerate(LABELS)], "actual string, row int, predicted string, column int")
    cells = matrix.select("method").distinct().join(F.broadcast(labels), how="cross")
    full = cells.join(matrix, ["method", "actual", "predicted"], "left").na.fill(0, [value])
    total = F.sum(value).over(Window.partitionBy("method", "actual"))
    return full.withColumn("percent", F.coalesce(F.try_divide(F.col(value) * 100, total), F.lit(0.0)))


def mass_check(events: DataFrame, matrix: DataFrame) -> DataFrame:
    """For each method: events, mass, whether they agree, hazard mass off the diagonal, and the diagonal's recall."""
    counts = events.groupBy("method").agg(F.count("*").alias("events"))
    hazard = F.col("actual") != "SAFE"
    sums = matrix.groupBy("method").agg(F.sum("mass").alias("mass"), F.sum(F.when(hazard & (F.col("actual") != F.col("predicted")), F.col("mass")).otherwise(0.0)).alias("off_diagonal"), F.sum(F.when(hazard & (F.col("actual") == F.col("predicted")), F.col("mass")).otherwise(0.0)).alias("diagonal"), F.sum(F.when(hazard, F.col("mass")).otherwise(0.0)).alias("hazard_mass"))
    return counts.join(sums, "method").select("method", "events", "mass", (F.abs(F.col("mass") - F.col("events")) <= 1e-6).alias("conserved"), "off_diagonal", F.try_divide("diagonal", "hazard_mass").alias("diagonal_recall"))


def overwritten_confusion(events: DataFrame) -> DataFrame:
    """Counts of label pairs where a matched prediction takes over the reference's labels."""
    safe = F.array(F.lit("SAFE"))
    taken = events.withColumn("p", F.when((F.col("a") != safe) & (F.col("p") != safe), F.col("a")).otherwise(F.col("p")))
    return taken.select("method", F.explode("a").alias("actual"), "p").select("method", "actual", F.explode("p").alias("predicted")).groupBy("method", "actual", "predicted").agg(F.count("*").alias("n"))


def cooccurrence(labels: DataFrame) -> DataFrame:
    """(a, b, n, share): images with both labels, and that over the images with a.  labels: (image, label)."""
    own = labels.distinct()
    single = own.groupBy(F.col("label").alias("a")).agg(F.count("*").alias("images"))
    pairs = own.select("image", F.col("label").alias("a")).join(own.select("image", F.col("label").alias("b")), "image").groupBy("a", "b").agg(F.count("*").alias("n"))
    return pairs.join(single, "a").select("a", "b", "n", F.try_divide("n", "images").alias("share"))


def presence_scores(records: DataFrame) -> DataFrame:
    """For each method and category whether records' label sets g and q have it: tp, fp, fn, tn, precision, recall, f1."""
    flags = records.select("method", "g", "q", F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category")).select("method", "category", F.array_contains("g", F.col("category")).alias("a"), F.array_contains("q", F.col("category")).alias("p"))
    c = flags.groupBy("method", "category").agg(F.count_if(F.col("a") & F.col("p")).alias("tp"), F.count_if(~F.col("a") & F.col("p")).alias("fp"), F.count_if(F.col("a") & ~F.col("p")).alias("fn"), F.count_if(~F.col("a") & ~F.col("p")).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("*", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("f1"))


def safe_danger(rows: DataFrame) -> DataFrame:
    """One row from booleans ref_safe and pred_safe: the 2 x 2 counts, SAFE precision, danger recall and accuracy (NaN if undefined)."""
    r, p = F.col("ref_safe"), F.col("pred_safe")
    c = rows.agg(F.count_if(r & p).alias("safe_safe"), F.count_if(r & ~p).alias("safe_danger"), F.count_if(~r & p).alias("danger_safe"), F.count_if(~r & ~p).alias("danger_danger"))
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(float("nan")))
    ss, sd, ds, dd = (F.col(x) for x in ("safe_safe", "safe_danger", "danger_safe", "danger_danger"))
    return c.select("*", over(ss, ss + ds).alias("safe_precision"), over(dd, dd + ds).alias("danger_recall"), over(ss + dd, ss + sd + ds + dd).alias("accuracy"))


def safe_summary(rows: DataFrame) -> DataFrame:
    """One row: pairs, names that differ, SAFE counts, agreement, pairs without SAFE, and the mean score of those that have one."""
    r, p = F.col("ref_safe"), F.col("pred_safe")
    return rows.agg(F.count("*").alias("pairs"), F.count_if(~F.col("same_name")).alias("name_mismatches"), F.count_if(r).alias("ref_safe_count"), F.count_if(p).alias("pred_safe_count"), F.avg((r == p).cast("double")).alias("safe_accuracy"), F.count_if(~r & ~p).alias("hazard_pairs"), F.avg(F.when(~r & ~p & ~F.isnan("score"), F.col("score"))).alias("mean_score"))


def hazard_counts(events: DataFrame, by: list[str]) -> DataFrame:
    """Role-aware counts of events (kind, role): matched tp, surplus fp, missed required ones fn."""
    c = events.groupBy(*by).agg(F.count_if(F.col("kind") == "matched").alias("tp"), F.count_if(F.col("kind") == "unmatched_pred").alias("fp"), F.count_if((F.col("kind") == "unmatched_gt") & (F.col("role") == "required")).alias("fn"))
    return c.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def field_scores(events: DataFrame, by: list[str], gt: Column, pred: Column) -> DataFrame:
    """Micro and macro F1 of a field over events (kind, role): gt and pred are its labels on either side.

    A match with a null gt label is skipped; a wrong label is a miss if its role
    is required, and a surplus if a label was predicted.
    """
    role, kind = F.col("role"), F.col("kind")
    own = events.select(*by, kind, role, gt.alias("g"), pred.alias("p"))
    row = lambda label, tp, fp, fn: F.struct(label.alias("label"), tp.cast("int").alias("tp"), fp.cast("int").alias("fp"), fn.cast("int").alias("fn"))
    none = F.lit(0)
    g, p = F.col("g"), F.col("p")
    wrong = (kind == "matched") & g.isNotNull() & ~g.eqNullSafe(p)
    cells = F.array(
        row(F.when((kind == "matched") & (g == p), g), F.lit(1), none, none),
        row(F.when((wrong | (kind == "unmatched_gt")) & (role == "required"), g), none, none, F.lit(1)),
        row(F.when(wrong | (kind == "unmatched_pred"), p), none, F.lit(1), none),
    )
    labels = own.select(*by, F.inline(cells)).where("label is not null").groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    scored = labels.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))
    total = scored.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.coalesce(F.avg(F.when(F.col("tp") + F.col("fn") > 0, F.col("f1"))), F.lit(0.0)).alias("macro_f1"))
    return total.withColumn("micro_f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def distance_errors(rows: DataFrame) -> DataFrame:
    """Errors of predicted against reference steps: all, by role and by category, as (slice, value, ...)."""
    ok = F.col("status") == "ok"
    e = F.when(ok, F.col("predicted_steps") - F.col("reference_steps"))
    own = rows.withColumn("e", e).withColumn("_size", F.abs("e"))
    sets = [[], ["role"], ["category"]]
    aggregates = [
        F.count("*").alias("eligible"), F.count("e").alias("successful"), F.count_if(~ok).alias("failed"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias"),
        F.avg((F.abs("e") <= 1).cast("double")).alias("within_1"),
    ]
    split = with_quantiles(own, sets, "_size", {"median_ae": 0.5}, *aggregates)
    # Images are told apart before they are counted, so that no task holds those of a whole slice.
    images = own.groupingSets([[*s, "image"] for s in sets], "role", "category", "image").agg(F.grouping_id("role", "category", "image").alias("grouping")).where("image is not null")
    images = images.groupBy(F.col("role").alias("_role"), F.col("category").alias("_category"), F.shiftright("grouping", 1).alias("_grouping")).agg(F.count("*").alias("images"))
    split = split.join(images, F.col("role").eqNullSafe(F.col("_role")) & F.col("category").eqNullSafe(F.col("_category")) & (F.col("grouping") == F.col("_grouping")), "left")
    slices = F.when(F.col("grouping") == 3, "all").when(F.col("grouping") == 1, "role").otherwise("category")
    value = F.coalesce("role", "category", F.lit("all"))
    return split.select(slices.alias("slice"), value.alias("value"), "eligible", "successful", "failed", F.coalesce("images", F.lit(0)).alias("images"), "mae", "rmse", "bias", "median_ae", "within_1")


def cohort(reference: DataFrame, models: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Reference rows with `included` and the reasons against: the reference must be eligible and every model ok and certain."""
    joined, reasons = reference, [F.when(~F.col("eligible"), F.lit("reference_not_eligible"))]
    for name, model in models.items():
        joined = joined.join(model.select(*keys, F.col("status").alias(f"{name}_status"), F.col("uncertain").alias(f"{name}_uncertain")), keys, "left")
        reasons.append(F.when(F.coalesce(F.col(f"{name}_status"), F.lit("missing")) != "ok", F.lit(f"{name}_not_ok")))
        reasons.append(F.when(F.coalesce(F.col(f"{name}_uncertain"), F.lit(False)), F.lit(f"{name}_uncertain")))
    return joined.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn("included", F.size("reasons") == 0)


def pair_category_counts(pairs: DataFrame) -> DataFrame:
    """tp, fp, fn of category sets g and q of given pairs; a null side is an empty set."""
    none = F.array().cast("array<string>")
    g, q = F.array_distinct(F.coalesce("g", none)), F.array_distinct(F.coalesce("q", none))
    c = pairs.groupBy("method").agg(F.sum(F.size(F.array_intersect(g, q))).alias("tp"), F.sum(F.size(F.array_except(q, g))).alias("fp"), F.sum(F.size(F.array_except(g, q))).alias("fn"))
    return c.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def judge_summary(scores: DataFrame, by: list[str]) -> DataFrame:
    """Weighted judge scores: mean, deviation, median and the shares of at least 8 and 6; a NaN counts as neither."""
    overall = 0.5 * F.col("hazard") + 0.4 * F.col("guide") + 0.1 * F.col("format")
    own = scores.withColumn("_number", F.when(~F.isnan(overall), overall))
    number = F.col("_number")
    share = lambda least: (F.avg(F.coalesce((number >= least).cast("double"), F.lit(0.0))) * 100)
    found = with_quantiles(own, [by], "_number", {"median": 0.5}, F.count("*").alias("n"), F.avg(number).alias("mean"), F.stddev_samp(number).alias("std"), share(8).alias("pct_8"), share(6).alias("pct_6"))
    return found.drop("grouping")


def _replicate_sums(replicates: int, seed: int, block: int = 4096):
    """A task's sums for all replicates: of weights, and of weighted differences."""
    term, below = math.exp(-1), []
    for k in range(1, 60):
        below.append(term + (below[-1] if below else 0.0))
        term /= k
    steps = np.array(below[: 1 + next(i for i in range(58) if below[i + 1] == below[i])])  # up to where doubles end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, sums = np.zeros(replicates), np.zeros(replicates)
        numbers = (np.arange(replicates, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            keys, d = batch["key"].to_numpy().astype(np.uint64), batch["d"].to_numpy()
            for at in range(0, len(keys), block):
                x = keys[at : at + block, None] ^ numbers
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                own = np.searchsorted(steps, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53, side="right").astype(float)
                weights += own.sum(axis=0)
                sums += d[at : at + block] @ own
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(weights), pa.array(sums)], names=["replicate", "weight", "total"])

    return run


def paired_bootstrap(rows: DataFrame, replicates: int, seed: int = 17) -> DataFrame:
    """One row: the mean difference of paired scores a and b, n, and the central 95 % of resampled means.

    Each row's weight in a replicate is a Poisson draw, which a hash of its id
    and the replicate gives, however rows are dealt out.  A task adds up all
    replicates of its rows and sends one sum for each.  Pairs with a null are
    left out; without pairs all but n are null.
    """
    own = rows.select("id", (F.col("a") - F.col("b")).cast("double").alias("d")).where("d is not null")
    keyed = own.select(F.xxhash64("id", F.lit(seed)).alias("key"), "d")
    parts = keyed.mapInArrow(_replicate_sums(replicates, seed), "replicate bigint, weight double, total double")
    means = parts.groupBy("replicate").agg(F.try_divide(F.sum("total"), F.sum("weight")).alias("m"))
    point = own.agg(F.avg("d").alias("difference"), F.count("*").alias("n"))
    return point.join(means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high")), how="cross")  # both are one row


def categories_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(LABELS)), "place int, label string")
