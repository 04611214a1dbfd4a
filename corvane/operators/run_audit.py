"""Acceptance checks of whole runs: each answers how many of a run's rows fail it.

A run has workers; each warms up, waits for a barrier that all share, and then
makes its attempts in rounds over a manifest, while its device is monitored.
Every check is a frame (run_id, check, n_rows, n_failed); a run passes a check
without failures.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import is_safe
from corvane.operators.latency import gap_tolerance

#: Stages of an attempt, in order; they add up to its total.
STAGES = ("read", "prepare", "transfer", "generate", "decode")
#: Seconds in a slot of a worker's time, and rows in a slot of a series: what one window holds at most.
SLOT_SECONDS, SLOT_ROWS = 3600, 10_000


@dataclass(frozen=True)
class RunLog:
    """The tables of a log; times are epoch seconds.

    attempts: run_id, worker, device, phase (warmup or formal), round (0 in the
    warm-up), position, record_id, started, ended, status (ok or error), the
    STAGES, total, token_ids, last_token_id, hit_limit, response_text, branch, error.
    workers: run_id, worker, device, barrier, warm_finished, started, ended, status, peak.
    rounds: run_id, worker, round, start, end, reset, peak.
    manifest: run_id, worker, position, record_id, source_group.
    samples: device, sequence, at, stored (bytes).
    config: run_id, barrier, rounds, warm_each, interval, token_limit, wall_budget, disk_budget.
    """

    attempts: DataFrame
    workers: DataFrame
    rounds: DataFrame
    manifest: DataFrame
    samples: DataFrame
    config: DataFrame


def _counted(rows: DataFrame, checks: dict[str, Column], applies: dict[str, Column] | None = None) -> DataFrame:
    """One pass over rows: for each run and check the rows that it applies to, and those where it isn't true."""
    applies = applies or {}
    wide = []
    for name, check in checks.items():
        held = F.coalesce(applies.get(name, F.lit(True)), F.lit(False))
        wide += [F.count_if(held).alias(f"{name}_n"), F.count_if(held & ~F.coalesce(check, F.lit(False))).alias(f"{name}_f")]
    each = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"{n}_n").alias("n_rows"), F.col(f"{n}_f").alias("n_failed")) for n in checks])
    return rows.groupBy("run_id").agg(*wide).select("run_id", F.inline(each))


def expected_warmup(manifest: DataFrame, config: DataFrame) -> DataFrame:
    """run_id, worker, position and record of the warm-up: the first warm_each rows of each group, by rank and then group."""
    by_group = Window.partitionBy("run_id", "worker", "source_group").orderBy("position")
    first = manifest.join(config.select("run_id", "warm_each"), "run_id").withColumn("rank", F.row_number().over(by_group)).where(F.col("rank") <= F.col("warm_each"))
    # At most warm_each rows of each group are left of a worker.
    order = Window.partitionBy("run_id", "worker").orderBy("rank", "source_group")
    return first.select("run_id", "worker", F.row_number().over(order).alias("position"), F.col("record_id").alias("expected"))


def attempt_checks(log: RunLog) -> DataFrame:
    """What each attempt must satisfy: identity, order, times, sums, tokens, branch and errors, all in one pass."""
    rounds = log.rounds.groupBy("run_id", "worker").agg(F.map_from_entries(F.collect_list(F.struct("round", F.struct("start", "end")))).alias("bounds"))  # as many as a worker has rounds
    own = log.workers.select("run_id", "worker", F.col("device").alias("own_device")).join(rounds, ["run_id", "worker"], "left")
    rule = log.config.select("run_id", F.col("barrier").alias("release"), "token_limit")
    planned = log.manifest.select("run_id", "worker", F.lit("formal").alias("phase"), "position", F.col("record_id").alias("expected"))
    planned = planned.unionByName(expected_warmup(log.manifest, log.config).withColumn("phase", F.lit("warmup")))
    rows = log.attempts.join(own, ["run_id", "worker"], "left").join(rule, "run_id", "left").join(planned, ["run_id", "worker", "phase", "position"], "left")
    formal, ok = F.col("phase") == "formal", F.col("status") == "ok"
    stages = [F.col(s) for s in STAGES]
    total, whole = F.col("total"), reduce(lambda a, b: a + b, stages)
    bounds = F.col("bounds")[F.col("round")]
    ids = F.col("token_ids")
    checks = {
        "device": F.col("device") == F.col("own_device"),
        "warmup_order": F.col("record_id") == F.col("expected"),
        "record_order": F.col("record_id") == F.col("expected"),
        "warmup_succeeds": ok,
        "times_rise": F.col("ended") >= F.col("started"),
        "within_round": (bounds["start"] <= F.col("started")) & (F.col("ended") <= bounds["end"]),
        "barrier_apart": F.when(formal, F.col("started") >= F.col("release")).otherwise(F.col("ended") <= F.col("release")),
        "stages_present": reduce(lambda a, b: a & b, [F.coalesce(s >= 0, F.lit(False)) for s in [*stages, total]]),
        "stages_close": F.abs(whole - total) <= 1e-9 * F.greatest(F.abs(whole), F.abs(total), F.lit(1.0)),
        "last_token": F.col("last_token_id").eqNullSafe(F.try_element_at(ids, F.lit(-1))),
        "token_limit": (F.size(ids) <= F.col("token_limit")) & (F.col("hit_limit") == (F.size(ids) >= F.col("token_limit"))),
        "branch": F.col("branch") == F.when(is_safe(F.col("response_text")), "safe").otherwise("hazard"),
        "no_error": F.col("error").isNull(),
        "failure_is_bare": (F.col("status") == "error") & F.coalesce(F.col("error") != "", F.lit(False)) & F.coalesce(*stages, total).isNull() & F.col("branch").isNull(),
    }
    applies = {"warmup_order": ~formal, "record_order": formal, "warmup_succeeds": ~formal, "within_round": formal, "failure_is_bare": ~ok}
    applies |= {name: ok for name in ("stages_present", "stages_close", "last_token", "token_limit", "branch", "no_error")}
    return _counted(rows, checks, applies)


def unique_attempts(log: RunLog) -> DataFrame:
    """Formal attempts by their key, and those that share it with an earlier one."""
    keys = log.attempts.where("phase = 'formal'").groupBy("run_id", "worker", "round", "record_id").agg(F.count("*").alias("c"))
    return keys.groupBy("run_id").agg(F.lit("unique_attempts").alias("check"), F.sum("c").alias("n_rows"), F.sum(F.col("c") - 1).alias("n_failed"))


def one_at_a_time(log: RunLog, slot: int = SLOT_SECONDS) -> DataFrame:
    """Attempts that start while another one of their worker runs, by a sweep over starts and ends.

    A worker's time is cut into slots, and an attempt swept in each that it
    touches; it is judged in that of its start only, so no window holds more
    than a slot.
    """
    at = lambda c: F.floor(F.col(c) / slot).cast("long")
    rows = log.attempts.where("ended > started").select("run_id", "worker", "started", "ended", at("started").alias("own"), F.explode(F.sequence(at("started"), at("ended"))).alias("slot"))
    # At one time ends come before starts: attempts that touch don't overlap.
    marks = rows.select("run_id", "worker", "slot", F.inline(F.array(
        F.struct(F.col("started").alias("time"), F.lit(1).alias("step"), (F.col("own") == F.col("slot")).alias("judged")),
        F.struct(F.col("ended").alias("time"), F.lit(-1).alias("step"), F.lit(False).alias("judged")),
    )))
    running = F.sum("step").over(Window.partitionBy("run_id", "worker", "slot").orderBy("time", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = marks.withColumn("running", running).where("judged")
    return found.groupBy("run_id").agg(F.lit("one_at_a_time").alias("check"), F.count("*").alias("n_rows"), F.count_if(F.col("running") > 1).alias("n_failed"))


def round_checks(log: RunLog) -> DataFrame:
    """Rounds of each worker: numbered from 1 without a hole, one after another, with a peak that was reset in time."""
    before = Window.partitionBy("run_id", "worker").orderBy("round")  # as many rows as a worker has rounds
    rows = log.rounds.withColumn("prior", F.lag("end").over(before)).withColumn("number", F.row_number().over(before)).join(log.workers.select("run_id", "worker", "warm_finished"), ["run_id", "worker"], "left")
    return _counted(rows, {
        "round_numbers": F.col("round") == F.col("number"),
        "round_order": F.col("prior").isNull() | (F.col("start") >= F.col("prior")),
        "round_bounds": F.col("end") >= F.col("start"),
        "peak_reset": (F.col("warm_finished") <= F.col("reset")) & (F.col("reset") <= F.col("start")),
        "peak_positive": F.col("peak") > 0,
    })


def worker_checks(log: RunLog) -> DataFrame:
    """Each worker against its run, its rounds and its attempts: barrier, warm-up, peak, status and completeness."""
    formal = F.col("phase") == "formal"
    made = log.attempts.groupBy("run_id", "worker").agg(F.count_if(formal).alias("n_formal"), F.count_if(~formal).alias("n_warm"), F.max(F.when(~formal, F.col("ended"))).alias("last_warm"))
    rounds = log.rounds.groupBy("run_id", "worker").agg(F.max("peak").alias("most"), F.count("*").alias("n_rounds"))
    size = log.manifest.groupBy("run_id", "worker").agg(F.count("*").alias("n_records"))
    groups = log.manifest.groupBy("run_id", "worker").agg(F.count_distinct("source_group").alias("n_groups"))
    rows = log.workers.join(log.config.withColumnsRenamed({"barrier": "release", "rounds": "planned"}), "run_id", "left")
    for more in (made, rounds, size, groups):
        rows = rows.join(more, ["run_id", "worker"], "left")
    return _counted(rows, {
        "barrier_shared": F.col("barrier") == F.col("release"),
        "warmup_before_barrier": F.col("warm_finished") <= F.col("release"),
        "warmup_finished": F.col("last_warm") <= F.col("warm_finished"),
        "peak_of_rounds": F.col("peak") == F.col("most"),
        "worker_status": F.col("status").isin("complete", "completed", "complete_with_errors"),
        "rounds_complete": F.col("n_rounds") == F.col("planned"),
        "warmup_complete": F.col("n_warm") == F.col("warm_each") * F.col("n_groups"),
        "attempts_complete": F.col("n_formal") == F.col("planned") * F.col("n_records"),
    })


def run_budgets(log: RunLog) -> DataFrame:
    """Whether a run's workers, from the first start to the last end, keep to the time budget; devices are their own."""
    spans = log.workers.groupBy("run_id").agg(F.min("started").alias("first"), F.max("ended").alias("last"), F.count("*").alias("n"), F.count_distinct("device").alias("devices"))
    rows = spans.join(log.config.select("run_id", "wall_budget"), "run_id", "left")
    return _counted(rows, {"wall_budget": F.col("last") - F.col("first") <= F.col("wall_budget"), "own_devices": F.col("devices") == F.col("n")})


def sample_steps(samples: DataFrame, series: list[str], sequence: str, at: str, slot: int = SLOT_ROWS) -> DataFrame:
    """Adds `before`: the time of the sample before each one in its series, by sequence.

    Windows hold a slot of the sequence; the ends of slots are stitched by a
    second, small window over slots.
    """
    cut = samples.withColumn("_slot", F.floor(F.col(sequence) / slot).cast("long"))
    inner = F.lag(at).over(Window.partitionBy(*series, "_slot").orderBy(sequence))
    ends = cut.groupBy(*series, "_slot").agg(F.max_by(at, sequence).alias("_last"))
    ends = ends.withColumn("_prior", F.lag("_last").over(Window.partitionBy(*series).orderBy("_slot"))).drop("_last")
    lines = cut.withColumn("_inner", inner).withColumn("_first", F.row_number().over(Window.partitionBy(*series, "_slot").orderBy(sequence)) == 1)
    return lines.join(ends, [*series, "_slot"], "left").withColumn("before", F.when(F.col("_first"), F.col("_prior")).otherwise(F.col("_inner"))).drop("_slot", "_inner", "_first", "_prior")


def monitoring_checks(log: RunLog, slot: int = SLOT_ROWS) -> DataFrame:
    """Samples of each worker's device, joined to its formal attempts by time: order, gaps, coverage and the disk budget."""
    formal = log.attempts.where("phase = 'formal'").groupBy("run_id", "worker").agg(F.min("started").alias("begin"), F.max("ended").alias("finish"))
    tolerance = gap_tolerance(F.col("interval"))
    spans = log.workers.select("run_id", "worker", "device").join(formal, ["run_id", "worker"]).join(log.config.select("run_id", tolerance.alias("tolerance"), "disk_budget"), "run_id")
    steps = sample_steps(log.samples, ["device"], "sequence", "at", slot)
    near = (F.col("at") >= F.col("begin") - F.col("tolerance")) & (F.col("at") <= F.col("finish") + F.col("tolerance"))
    held = spans.join(steps, "device").where(near)
    gap = F.col("before").isNull() | (F.col("before") < F.col("begin") - F.col("tolerance")) | (F.col("at") - F.col("before") <= F.col("tolerance"))
    rows = _counted(held, {
        "samples_ordered": F.col("before").isNull() | (F.col("at") >= F.col("before")),
        "samples_dense": gap,
        "disk_budget": F.col("stored").isNull() | F.col("stored").between(F.lit(0), F.col("disk_budget")),
    })
    ends = held.groupBy("run_id", "worker").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    covered = (F.col("first") <= F.col("begin") + F.col("tolerance")) & (F.col("last") >= F.col("finish") - F.col("tolerance"))
    return rows.unionByName(_counted(spans.join(ends, ["run_id", "worker"], "left"), {"samples_cover": covered}))


def manifest_audit(log: RunLog) -> DataFrame:
    """Manifest rows of each worker: positions 1 to n, ids of their own, groups of one size."""
    own = log.manifest.groupBy("run_id", "worker").agg(F.count("*").alias("n"), F.min("position").alias("least"), F.max("position").alias("most"), F.count_distinct("position").alias("positions"), F.count_distinct("record_id").alias("ids"))
    groups = log.manifest.groupBy("run_id", "worker", "source_group").agg(F.count("*").alias("c")).groupBy("run_id", "worker").agg((F.max("c") - F.min("c") <= 1).alias("even"))
    rows = own.join(groups, ["run_id", "worker"], "left")
    return _counted(rows, {"manifest_positions": (F.col("least") == 1) & (F.col("most") == F.col("n")) & (F.col("positions") == F.col("n")), "manifest_ids": F.col("ids") == F.col("n"), "manifest_groups": F.col("even")})


def audit(log: RunLog) -> DataFrame:
    """(run_id, check, n_rows, n_failed, passed) of every check.

    A null where a check needs a value fails it.  A check has no row for a run
    that has no rows for it, unless it is a worker's, where missing rows fail.
    """
    parts = [manifest_audit(log), attempt_checks(log), unique_attempts(log), one_at_a_time(log), round_checks(log), worker_checks(log), run_budgets(log), monitoring_checks(log)]
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("n_failed") == 0)
