"""The audit of whole runs, over a run log derived from the events, with faults in its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import run_audit as r
from corvane.plans import adapters as a
from corvane.plans.registry import query
from corvane.sources.shared import checkpointed

#: What every run was planned with.
PLAN = {"barrier": 5.0, "rounds": 2, "warm_each": 2, "interval": 1.0, "token_limit": 5, "wall_budget": 14400.0, "disk_budget": 450e6}

# A user is a worker, four of them a run.  The first four events warm up, the others go in two rounds.
_LOG_SQL = """numbered AS (SELECT *, user_id // 4 AS run_id, user_id AS worker, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
sized AS (SELECT *, greatest((n - 4) // 2, 1) AS m FROM numbered),
placed AS (SELECT *, CASE WHEN k <= 4 THEN 'warmup' ELSE 'formal' END AS phase, CASE WHEN k <= 4 THEN 0 ELSE least(1 + (k - 5) // m, 2) END AS round FROM sized),
attempts AS (SELECT run_id, worker, CASE WHEN event_id % 101 = 0 THEN 'gx' ELSE 'g' || worker END AS device, phase, round, position,
    CASE WHEN phase = 'warmup' AND worker % 5 = 2 THEN position WHEN phase = 'warmup' THEN CASE WHEN position % 2 = 1 THEN position + 1 ELSE position - 1 END WHEN event_id % 97 = 0 THEN position + 1 ELSE position END AS record_id,
    began AS started, began + dur AS ended, CASE WHEN event_id % 97 = 1 THEN 'error' ELSE 'ok' END AS status, CASE WHEN event_id % 97 = 1 THEN NULL ELSE [dur * 0.1, dur * 0.1, dur * 0.2, dur * 0.5, dur * CASE WHEN event_id % 83 = 0 THEN 0.2 ELSE 0.1 END] END AS stages,
    CASE WHEN event_id % 97 <> 1 OR event_id % 2 = 0 THEN dur END AS total, range(event_id % 6) AS ids, CASE WHEN event_id % 79 = 0 THEN 99 ELSE nullif(event_id % 6, 0) - 1 END AS last_token_id, event_id % 6 = 5 AS hit_limit,
    CASE WHEN event_type = 'error' THEN '<ALERT>a</ALERT><GUIDE>b</GUIDE>' ELSE ' <SAFE/>' END AS response_text, CASE WHEN event_id % 97 = 1 THEN NULL WHEN event_type = 'error' AND event_id % 73 <> 0 THEN 'hazard' ELSE 'safe' END AS branch, CASE WHEN event_id % 97 = 1 THEN event_type END AS error
  FROM (SELECT *, k - CASE WHEN phase = 'warmup' THEN 0 ELSE 4 + (round - 1) * m END AS position, k - CASE WHEN event_id % 89 = 0 THEN 0.95 ELSE 0.0 END::DOUBLE AS began, 0.1::DOUBLE + value / 1000 AS dur FROM placed)),
users AS (SELECT run_id, worker, any_value(n) AS n, any_value(m) AS m FROM placed GROUP BY 1, 2),
halves AS (SELECT run_id, worker, round, max(value) AS peak FROM placed WHERE round > 0 GROUP BY ALL),
rounds AS (SELECT h.run_id, h.worker, h.round, CASE WHEN h.round = 1 THEN 5.0 WHEN h.worker % 9 = 4 THEN 4.0 + m ELSE 5.0 + m END::DOUBLE AS start, CASE WHEN h.round = 1 THEN 4.99 + m ELSE 0.99 + n END::DOUBLE AS "end", peak FROM halves h JOIN users USING (run_id, worker)),
timed AS (SELECT *, CASE WHEN worker % 10 = 6 THEN start + 1 ELSE start - 0.01 END AS reset FROM rounds),
workers AS (SELECT run_id, worker, 'g' || worker AS device, CASE WHEN worker % 7 = 3 THEN 4.2 ELSE 5.0 END AS barrier, CASE WHEN worker % 6 = 1 THEN 5.5 ELSE 4.95 END AS warm_finished, 0.5 AS started, n + CASE WHEN worker % 13 = 4 THEN 20000 ELSE 1.5 END AS ended,
    CASE WHEN worker % 17 = 5 THEN 'failed' ELSE 'complete' END AS status, (SELECT max(peak) FROM halves h WHERE h.worker = users.worker) + CASE WHEN worker % 8 = 2 THEN 1 ELSE 0 END AS peak FROM users),
manifest AS (SELECT run_id, worker, p AS position, CASE WHEN worker % 19 = 7 AND p = 3 THEN 2 ELSE p END AS record_id, p % 2 AS source_group FROM (SELECT run_id, worker, unnest(range(1, m + 1)) AS p FROM users)),
samples AS (SELECT 'g' || worker AS device, k AS sequence, k + value / 10000 - CASE WHEN event_id % 107 = 0 THEN 3 ELSE 0 END AS tick, value * 1e6 AS stored FROM placed
  WHERE NOT (worker % 5 = 1 AND k % 40 BETWEEN 10 AND 13) AND NOT (worker % 12 = 7 AND 2 * k > n))"""


def _check(source: str, **checks: tuple[str, str] | str) -> str:
    """SQL that counts, for each run, the rows of a source that a check applies to and that fail it."""
    parts = []
    for name, check in checks.items():
        true, applies = (check, "true") if isinstance(check, str) else check
        parts.append(f"SELECT run_id, '{name}' AS \"check\", count_if({applies}) AS n_rows, count_if({applies} AND NOT coalesce({true}, false)) AS n_failed FROM ({source}) GROUP BY run_id")
    return " UNION ALL ".join(parts)


def _audit_sql() -> str:
    ok, formal = "status = 'ok'", "phase = 'formal'"
    row = """SELECT t.*, w.device AS own, g.start, g."end", m.record_id AS planned FROM attempts t LEFT JOIN workers w USING (run_id, worker) LEFT JOIN timed g USING (run_id, worker, round) LEFT JOIN manifest m ON m.worker = t.worker AND m.position = t.position"""
    warm = """SELECT t.run_id, t.record_id, e.record_id AS planned FROM attempts t LEFT JOIN (SELECT worker, record_id, row_number() OVER (PARTITION BY worker ORDER BY rank, source_group) AS position
    FROM (SELECT *, row_number() OVER (PARTITION BY worker, source_group ORDER BY position) AS rank FROM manifest) WHERE rank <= 2) e ON e.worker = t.worker AND e.position = t.position WHERE phase = 'warmup'"""
    made = "made AS (SELECT worker, count_if(phase = 'formal') AS n_formal, count_if(phase = 'warmup') AS n_warm, max(ended) FILTER (phase = 'warmup') AS last_warm, min(started) FILTER (phase = 'formal') AS b, max(ended) FILTER (phase = 'formal') AS f FROM attempts GROUP BY worker)"
    worker = "SELECT w.*, made.*, (SELECT max(peak) FROM timed t WHERE t.worker = w.worker) AS most, (SELECT count(*) FROM timed t WHERE t.worker = w.worker) AS n_rounds, (SELECT count(*) FROM manifest t WHERE t.worker = w.worker) AS n_records, (SELECT count(DISTINCT source_group) FROM manifest t WHERE t.worker = w.worker) AS n_groups FROM workers w LEFT JOIN made USING (worker)"
    near = "SELECT w.run_id, s.*, b, f FROM workers w JOIN made USING (worker) JOIN (SELECT *, lag(tick) OVER (PARTITION BY device ORDER BY sequence) AS before FROM samples) s USING (device) WHERE tick BETWEEN b - 2.5 AND f + 2.5"
    shared = "SELECT run_id, row_number() OVER (PARTITION BY worker, round, record_id) AS nth FROM attempts WHERE phase = 'formal'"
    over = "SELECT run_id, NOT EXISTS (FROM attempts b WHERE b.worker = t.worker AND b.started < t.started AND b.ended > t.started) AS alone FROM attempts t"
    parts = [
        _check("SELECT run_id, worker, count(*) AS n, min(position) = 1 AND max(position) = count(*) AND count(DISTINCT position) = count(*) AS p, count(DISTINCT record_id) = count(*) AS i, abs(2 * count_if(source_group = 0) - count(*)) <= 1 AS e FROM manifest GROUP BY ALL", manifest_positions="p", manifest_ids="i", manifest_groups="e"),
        _check(row, device="device = own", record_order=("record_id = planned", formal), warmup_succeeds=(ok, f"NOT {formal}"), times_rise="ended >= started", within_round=('start <= started AND ended <= "end"', formal), barrier_apart="CASE WHEN phase = 'formal' THEN started >= 5 ELSE ended <= 5 END",
            stages_present=("list_min(stages) >= 0 AND total >= 0", ok), stages_close=("abs(stages[1] + stages[2] + stages[3] + stages[4] + stages[5] - total) <= 1e-9", ok), last_token=("last_token_id IS NOT DISTINCT FROM ids[-1]", ok), token_limit=("len(ids) <= 5 AND hit_limit = (len(ids) >= 5)", ok),
            branch=("branch = CASE WHEN response_text = ' <SAFE/>' THEN 'safe' ELSE 'hazard' END", ok), no_error=("error IS NULL", ok), failure_is_bare=("error <> '' AND stages IS NULL AND total IS NULL AND branch IS NULL", f"NOT ({ok})")),
        _check(f"SELECT a.run_id, w.record_id, w.planned, w.run_id IS NOT NULL AS warm FROM (SELECT DISTINCT run_id FROM attempts) a LEFT JOIN ({warm}) w USING (run_id)", warmup_order=("record_id = planned", "warm")),
        _check(shared, unique_attempts="nth = 1"), _check(over, one_at_a_time="alone"),
        _check("SELECT t.*, w.warm_finished, lag(\"end\") OVER (PARTITION BY worker ORDER BY round) AS prior, row_number() OVER (PARTITION BY worker ORDER BY round) AS nth FROM timed t LEFT JOIN workers w USING (run_id, worker)", round_numbers="round = nth", round_order="prior IS NULL OR start >= prior", round_bounds='"end" >= start', peak_reset="warm_finished <= reset AND reset <= start", peak_positive="peak > 0"),
        _check(worker, barrier_shared="barrier = 5", warmup_before_barrier="warm_finished <= 5", warmup_finished="last_warm <= warm_finished", peak_of_rounds="peak = most", worker_status="status = 'complete'", rounds_complete="n_rounds = 2", warmup_complete="n_warm = 2 * n_groups", attempts_complete="n_formal = 2 * n_records"),
        _check("SELECT run_id, max(ended) - min(started) AS span, count(DISTINCT device) = count(*) AS own FROM workers GROUP BY run_id", wall_budget="span <= 14400", own_devices="own"),
        _check(near, samples_ordered="before IS NULL OR tick >= before", samples_dense="before IS NULL OR before < b - 2.5 OR tick - before <= 2.5", disk_budget="stored IS NULL OR stored BETWEEN 0 AND 450e6"),
        _check(f"SELECT w.run_id, x.first <= b + 2.5 AND x.last >= f - 2.5 AS covered FROM workers w JOIN made USING (worker) LEFT JOIN (SELECT device, min(tick) AS first, max(tick) AS last FROM ({near}) GROUP BY device) x USING (device)", samples_cover="covered"),
    ]
    return f"WITH {_LOG_SQL}, {made} SELECT *, n_failed = 0 AS passed FROM (" + " UNION ALL ".join(parts) + ")"


def run_log(spark: SparkSession, sf_dir: str) -> r.RunLog:
    """The log as DataFrames; what the SQL above says."""
    own = Window.partitionBy("user_id")
    e = a.table(spark, sf_dir, "events").withColumn("k", F.row_number().over(own.orderBy("ts", "event_id"))).withColumn("n", F.count("*").over(own)).withColumn("m", F.greatest(F.floor((F.col("n") - 4) / 2), F.lit(1)))
    e = e.withColumns({"run_id": F.floor(F.col("user_id") / 4), "worker": F.col("user_id"), "phase": F.when(F.col("k") <= 4, "warmup").otherwise("formal"), "round": F.when(F.col("k") <= 4, 0).otherwise(F.least(1 + F.floor((F.col("k") - 5) / F.col("m")), F.lit(2))).cast("int")})
    # Stands for a log that is stored; its tables are all read from it.
    e = checkpointed(e.withColumns({"position": F.col("k") - F.when(F.col("phase") == "warmup", 0).otherwise(4 + (F.col("round") - 1) * F.col("m")), "began": F.col("k") - F.when(F.col("event_id") % 89 == 0, 0.95).otherwise(0.0), "dur": 0.1 + F.col("value") / 1000}))
    n, k, m, worker, warm = F.col("event_id"), F.col("k"), F.col("m"), F.col("worker"), F.col("phase") == "warmup"
    position, dur, failed = F.col("position"), F.col("dur"), n % 97 == 1
    device = F.concat(F.lit("g"), worker.cast("string"))
    swapped = F.when(position % 2 == 1, position + 1).otherwise(position - 1)
    stage = lambda share: F.when(~failed, dur * share)
    attempts = e.select(
        "run_id", "worker", F.when(n % 101 == 0, "gx").otherwise(device).alias("device"), "phase", "round", "position",
        F.when(warm & (worker % 5 != 2), swapped).when(~warm & (n % 97 == 0), position + 1).otherwise(position).alias("record_id"),
        F.col("began").alias("started"), (F.col("began") + dur).alias("ended"), F.when(failed, "error").otherwise("ok").alias("status"),
        stage(F.lit(0.1)).alias("read"), stage(F.lit(0.1)).alias("prepare"), stage(F.lit(0.2)).alias("transfer"), stage(F.lit(0.5)).alias("generate"), stage(F.when(n % 83 == 0, 0.2).otherwise(0.1)).alias("decode"),
        F.when(~failed | (n % 2 == 0), dur).alias("total"), F.when(n % 6 > 0, F.sequence(F.lit(0), n % 6 - 1)).otherwise(F.array().cast("array<bigint>")).alias("token_ids"),
        F.when(n % 79 == 0, 99).when(n % 6 > 0, n % 6 - 1).alias("last_token_id"), (n % 6 == 5).alias("hit_limit"),
        F.when(F.col("event_type") == "error", "<ALERT>a</ALERT><GUIDE>b</GUIDE>").otherwise(" <SAFE/>").alias("response_text"),
        F.when(failed, None).when((F.col("event_type") == "error") & (n % 73 != 0), "hazard").otherwise("safe").alias("branch"), F.when(failed, F.col("event_type")).alias("error"),
    )
    users = e.groupBy("run_id", "worker").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.max(F.when(F.col("round") > 0, F.col("value"))).alias("most"))
    halves = e.where("round > 0").groupBy("run_id", "worker", "round", "n", "m").agg(F.max("value").alias("peak"))
    first = F.col("round") == 1
    start = F.when(first, 5.0).when(worker % 9 == 4, 4.0 + m).otherwise(5.0 + m)
    rounds = halves.select("run_id", "worker", "round", start.alias("start"), F.when(first, 4.99 + m).otherwise(0.99 + F.col("n")).alias("end"), F.when(worker % 10 == 6, start + 1).otherwise(start - 0.01).alias("reset"), "peak")
    workers = users.select("run_id", "worker", device.alias("device"), F.when(worker % 7 == 3, 4.2).otherwise(5.0).alias("barrier"), F.when(worker % 6 == 1, 5.5).otherwise(4.95).alias("warm_finished"), F.lit(0.5).alias("started"),
        (F.col("n") + F.when(worker % 13 == 4, 20000).otherwise(1.5)).alias("ended"), F.when(worker % 17 == 5, "failed").otherwise("complete").alias("status"), (F.col("most") + F.when(worker % 8 == 2, 1).otherwise(0)).alias("peak"))
    planned = users.select("run_id", "worker", F.explode(F.sequence(F.lit(1).cast("bigint"), "m")).alias("position"))
    manifest = planned.select("*", F.when((worker % 19 == 7) & (F.col("position") == 3), 2).otherwise(F.col("position")).alias("record_id"), (F.col("position") % 2).alias("source_group"))
    samples = e.where(~((worker % 5 == 1) & (k % 40).between(10, 13)) & ~((worker % 12 == 7) & (2 * k > F.col("n")))).select(device.alias("device"), k.alias("sequence"), (k + F.col("value") / 10000 - F.when(n % 107 == 0, 3).otherwise(0)).alias("at"), (F.col("value") * 1e6).alias("stored"))
    config = users.select("run_id").distinct().select("run_id", *[F.lit(v).alias(name) for name, v in PLAN.items()])
    return r.RunLog(attempts, workers, rounds, manifest, samples, config)


@query(_audit_sql())
def run_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.audit(run_log(spark, sf_dir))
