"""Queries on latencies, series and run audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.measures import back_off
from corvane.functions.text import duration, progress_bar
from corvane.operators import latency as o
from corvane.plans import adapters as a
from corvane.plans.registry import query

_STATS = "count(*) AS attempts, count(seconds) AS successes, round(avg(seconds), 9) AS mean, round(quantile_cont(seconds, 0.95), 9) AS p95"


def _rounded(frame: DataFrame, *names: str) -> DataFrame:
    for n in names:
        frame = frame.withColumn(n, F.round(n, 9))
    return frame


@query(f"WITH {a.OBSERVATIONS_SQL} SELECT branch, {_STATS} FROM obs GROUP BY branch")
def latency_by_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(o.latency_summary(a.observations(spark, sf_dir), [["branch"]]), "mean", "p95")


@query(f"WITH {a.OBSERVATIONS_SQL} SELECT model, branch, {_STATS} FROM obs GROUP BY model, branch")
def latency_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(o.latency_summary(a.observations(spark, sf_dir), [["model", "branch"]]), "mean", "p95")


@query(f"WITH {a.OBSERVATIONS_SQL} SELECT model, replica, branch, {_STATS} FROM obs GROUP BY GROUPING SETS ((model, replica, branch), (model, branch), ())")
def latency_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(o.latency_summary(a.observations(spark, sf_dir), [["model", "replica", "branch"], ["model", "branch"], []]), "mean", "p95")


@query(f"""WITH {a.OBSERVATIONS_SQL} SELECT model, replica, count(seconds) AS n, round(avg(seconds), 9) AS mean, round(CASE WHEN count(seconds) > 1 THEN stddev_samp(seconds) WHEN count(seconds) = 1 THEN 0 END, 9) AS std,
min(seconds) AS least, max(seconds) AS most, round(quantile_cont(seconds, 0.5), 9) AS p50, round(quantile_cont(seconds, 0.95), 9) AS p95 FROM obs GROUP BY model, replica""")
def latency_full_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(o.full_summary(a.observations(spark, sf_dir), ["model", "replica"]), "mean", "std", "p50", "p95")


@query(f"""WITH {a.OBSERVATIONS_SQL} SELECT series, record_id, round(CASE WHEN count(seconds) OVER w >= 3 THEN avg(seconds) OVER w * (count(*) OVER (PARTITION BY series) - row_number() OVER (PARTITION BY series ORDER BY ts, record_id)) END, 9) AS eta
FROM obs WINDOW w AS (PARTITION BY series ORDER BY ts, record_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")
def rolling_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = o.rolling_eta(a.observations(spark, sf_dir), "series", ["ts", "record_id"], "seconds")
    return found.select("series", "record_id", F.round("eta", 9).alias("eta"))


_TOLERANCE = 3_600_000_000 * 24


@query(f"""WITH {a.OBSERVATIONS_SQL}, s AS (SELECT series, micros - lag(micros) OVER (PARTITION BY series ORDER BY record_id) AS step FROM obs)
SELECT series, count(*) AS samples, count_if(step > {_TOLERANCE}) AS gaps, count_if(step < 0) AS unordered, max(step) AS longest FROM s GROUP BY series""")
def series_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.series_gaps(a.observations(spark, sf_dir).withColumn("position", F.col("record_id")), "series", "micros", F.lit(_TOLERANCE))


@query(f"""WITH {a.OBSERVATIONS_SQL}, span AS (SELECT min(micros) AS b, max(micros) AS e FROM obs), s AS (SELECT series, min(micros) AS first, max(micros) AS last FROM obs GROUP BY series)
SELECT series, first <= b + {_TOLERANCE} AND last >= e - {_TOLERANCE} AS covered FROM s, span""")
def series_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = a.observations(spark, sf_dir)
    span = own.agg(F.min("micros").alias("begin"), F.max("micros").alias("finish"))
    spans = own.select("series").distinct().join(F.broadcast(span), how="cross")  # the span is one row
    return o.series_coverage(own, "series", "micros", spans, F.lit(_TOLERANCE)).select("series", "covered")


_MANIFEST = "m AS (SELECT user_id AS record_id, 'img_' || (user_id % 195) AS image, user_id + 1 AS position, user_id % 2 AS source_group FROM (SELECT DISTINCT user_id FROM events))"


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = a.table(spark, sf_dir, "events").select(F.col("user_id").alias("record_id")).distinct()
    return users.select("record_id", F.concat(F.lit("img_"), (F.col("record_id") % 195).cast("string")).alias("image"), (F.col("record_id") + 1).alias("position"), (F.col("record_id") % 2).alias("source_group"))


@query(f"WITH {_MANIFEST} SELECT record_id, r AS round, (r - 1) * (SELECT count(*) FROM m) + position AS run_order FROM m, range(1, 4) t(r)")
def round_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.round_schedule(_manifest(spark, sf_dir), 3).select("record_id", "round", "run_order")


@query(f"""WITH {_MANIFEST}, r AS (SELECT record_id, source_group, row_number() OVER (PARTITION BY source_group ORDER BY position) AS rank FROM m)
SELECT record_id, source_group, row_number() OVER (ORDER BY rank, source_group) AS run_order FROM r WHERE rank <= 5""")
def warmup_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.warmup_rows(_manifest(spark, sf_dir), "source_group", "position").select("record_id", "source_group", "run_order")


@query(f"""WITH {_MANIFEST}, i AS (SELECT image, count(*) AS c FROM m GROUP BY 1), g AS (SELECT source_group, count(*) AS c FROM m GROUP BY 1)
SELECT count(*) AS n, count(DISTINCT record_id) = count(*) AS unique_ids, min(position) = 1 AND max(position) = count(*) AND count(DISTINCT position) = count(*) AS in_sequence,
(SELECT count_if(c > 1) FROM i) AS repeated_images, (SELECT count(*) FROM i) AS images, (SELECT min(c) FROM g) AS least_group, (SELECT max(c) FROM g) AS most_group FROM m""")
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.manifest_checks(_manifest(spark, sf_dir))


@query(f"""WITH {a.OBSERVATIONS_SQL}, t AS (SELECT record_id, seconds * 0.1 AS b0, seconds * 0.3 AS b1, seconds * 0.6 AS b2, seconds * CASE WHEN record_id % 11 = 0 THEN 0.5 ELSE 1.1 END AS b3, seconds FROM obs WHERE status = 'ok')
SELECT record_id, b1 >= b0 AND b2 >= b1 AND b3 >= b2 AS rising, abs(b3 - b0 - seconds) <= 1e-9 * greatest(abs(b3 - b0), abs(seconds), 1e-12) AS closed FROM t""")
def timing_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("seconds")
    rows = a.observations(spark, sf_dir).where("status = 'ok'").select("record_id", "seconds", (s * 0.1).alias("b0"), (s * 0.3).alias("b1"), (s * 0.6).alias("b2"), (s * F.when(F.col("record_id") % 11 == 0, 0.5).otherwise(1.1)).alias("b3"))
    return o.timing_closure(rows, ["b0", "b1", "b2", "b3"], "seconds").select("record_id", "rising", "closed")


@query(f"""WITH {a.OBSERVATIONS_SQL}, k AS (SELECT model, replica, record_id, count(*) AS c FROM obs GROUP BY ALL)
SELECT 'unique_keys' AS "check", count(*) AS n_rows, count_if(c > 1) AS n_failed FROM k
UNION ALL SELECT 'timings_present', count(*), count_if((status = 'ok') <> (seconds IS NOT NULL)) FROM obs
UNION ALL SELECT 'branch_recomputed', count(*), count_if(status = 'ok' AND branch <> CASE WHEN response_text = '<SAFE/>' THEN 'safe' ELSE 'hazard' END) FROM obs
UNION ALL SELECT 'positive_seconds', count(*), count_if(seconds < 0) FROM obs
UNION ALL SELECT 'token_tail', count(*), count_if(status = 'ok' AND last_token_id NOT IN (1, 2)) FROM obs""")
def run_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.run_checks(a.observations(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING n > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.operators.matching import duplicate_keys as found

    return found(a.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_CELLS = "cells AS (SELECT l_suppkey AS cell, count_if(l_linestatus = 'F') AS detected, count_if(l_linestatus = 'O') AS missed, count(*) + CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END AS total, count_if(l_linestatus = 'F') / count(*) AS recall FROM lineitem GROUP BY l_suppkey)"


@query(f"WITH {_CELLS} SELECT cell, CASE WHEN detected + missed <> total THEN 'sum' WHEN abs(recall - detected / total) > 1e-12 THEN 'rate' END AS violation FROM cells WHERE violation IS NOT NULL")
def metric_recompute_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = a.table(spark, sf_dir, "lineitem")
    d, n = F.count_if(F.col("l_linestatus") == "F"), F.count("*")
    cells = line.groupBy(F.col("l_suppkey").alias("cell")).agg(d.alias("detected"), F.count_if(F.col("l_linestatus") == "O").alias("missed"), n.alias("n"), (d / n).alias("recall"))
    cells = cells.withColumn("total", F.col("n") + F.when(F.col("cell") % 10 == 0, 1).otherwise(0))
    return o.metric_violations(cells).select("cell", "violation")


@query("""WITH e AS (SELECT user_id, round(avg(value), 6) AS v FROM events GROUP BY 1), c AS (SELECT user_id, CASE WHEN user_id % 9 = 0 THEN v + 0.5 ELSE v END AS v FROM e WHERE user_id % 13 <> 0)
SELECT user_id, e.v AS v_expected, c.v AS v_actual FROM e FULL JOIN c USING (user_id) WHERE coalesce(abs(e.v - c.v) > 1e-9, true)""")
def figures_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("v"))
    c = e.where("user_id % 13 <> 0").withColumn("v", F.when(F.col("user_id") % 9 == 0, F.col("v") + 0.5).otherwise(F.col("v")))
    return o.recomputed(e, c, ["user_id"], ["v"])


@query("""WITH t AS (SELECT user_id, event_id, event_type AS raw, row_number() OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN user_id % 8 = 0 THEN 1 ELSE 0 END AS attempt FROM events),
l AS (SELECT user_id, max_by(raw, attempt) AS final FROM t WHERE user_id % 6 <> 1 GROUP BY 1)
SELECT t.user_id, count(*)::INT AS attempts, min(attempt) = 1 AS numbered, coalesce(any_value(final), '') = max_by(raw, attempt) AS last_is_final FROM t LEFT JOIN l USING (user_id) GROUP BY 1""")
def attempt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    t = a.table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("raw"), (F.row_number().over(w) + F.when(F.col("user_id") % 8 == 0, 1).otherwise(0)).alias("attempt"))
    last = t.where("user_id % 6 <> 1").groupBy("user_id").agg(F.max_by("raw", "attempt").alias("final"))
    rows = t.join(last, "user_id", "left").na.fill("", ["final"])
    return o.attempt_histories(rows, "user_id")


@query("SELECT user_id, event_id, value FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_cache_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.latest_valid(a.table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") != "error").select("user_id", "event_id", "value")


@query("""SELECT event_id, CASE WHEN v >= 3600 THEN lpad((v // 3600)::VARCHAR, 2, '0') || ':' ELSE '' END || lpad((v % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((v % 60)::VARCHAR, 2, '0') AS shown,
repeat('#', f) || repeat('-', 20 - f) AS bar, least(2.0, 0.25 * pow(2.0, event_id % 6)) AS wait FROM (SELECT event_id, floor(value * 40)::INT AS v, floor(least(event_id % 100, 80) / 80 * 20)::INT AS f FROM events)""")
def progress_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events")
    return e.select("event_id", duration(F.col("value") * 40).alias("shown"), progress_bar(F.col("event_id") % 100, F.lit(80)).alias("bar"), back_off(F.col("event_id") % 6 + 1).alias("wait"))
