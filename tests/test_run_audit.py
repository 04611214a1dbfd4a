"""The run audit on a small log by hand, and its slots against whole windows."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import run_audit as r
from corvane.plans.run_audit import run_log


@pytest.fixture(scope="module")
def log(spark, small):
    return run_log(spark, small)


def test_faults_are_found(log):
    # The smallest tables lack faults of three kinds.
    log = r.RunLog(log.attempts, log.workers, log.rounds.withColumn("end", F.col("end") - 0.9), log.manifest, log.samples, log.config.withColumns({"barrier": F.lit(5.2), "disk_budget": F.lit(1e6)}))
    failed = {row.check for row in r.audit(log).where("n_failed > 0").select("check").distinct().collect()}
    assert failed >= {"device", "warmup_order", "record_order", "within_round", "barrier_apart", "stages_close", "last_token", "branch", "failure_is_bare", "unique_attempts", "one_at_a_time", "round_order", "peak_reset",
                      "barrier_shared", "warmup_before_barrier", "peak_of_rounds", "worker_status", "attempts_complete", "wall_budget", "samples_ordered", "samples_dense", "disk_budget", "samples_cover"}


@pytest.mark.parametrize("slot", [1, 7, 10**6])
def test_slots_change_nothing(spark, slot):
    rng = random.Random(2)
    rows = []
    for worker in range(3):
        at = 0.0
        for _ in range(150):
            at += rng.choice([0.0, 0.5, 3.25])
            rows.append((0, worker, at, at + rng.choice([0.0, 0.25, 1.0, 9.5])))
    attempts = spark.createDataFrame(rows, "run_id int, worker int, started double, ended double")
    log = r.RunLog(attempts, None, None, None, None, None)
    want = 0
    for worker in range(3):
        own = sorted(((s, e) for _, w, s, e in rows if w == worker and e > s), key=lambda x: x[0])
        open_ends = []
        for s, e in own:
            open_ends = [x for x in open_ends if x > s]
            want += bool(open_ends)
            open_ends.append(e)
    got = r.one_at_a_time(log, slot).first()
    assert (got.n_rows, got.n_failed) == (sum(e > s for _, _, s, e in rows), want)


@pytest.mark.parametrize("slot", [1, 4, 10**6])
def test_sample_steps(spark, slot):
    rng = random.Random(3)
    rows = [(d, i, float(rng.randint(0, 9))) for d in "ab" for i in range(0, 90, rng.choice([1, 3]))]
    got = {(x.device, x.sequence): x.before for x in r.sample_steps(spark.createDataFrame(rows, "device string, sequence int, at double"), ["device"], "sequence", "at", slot).collect()}
    for d in "ab":
        own = [(i, t) for x, i, t in rows if x == d]
        assert all(got[d, i] == (own[n - 1][1] if n else None) for n, (i, _) in enumerate(own))


def test_missing_values_fail(spark, log):
    bare = log.workers.withColumns({"status": F.lit(None).cast("string"), "barrier": F.lit(None).cast("double")})
    rows = r.worker_checks(r.RunLog(log.attempts.where("false"), bare, log.rounds.where("false"), log.manifest, log.samples, log.config)).collect()
    assert all(x.n_failed == x.n_rows for x in rows if x.check in ("worker_status", "barrier_shared", "rounds_complete", "attempts_complete", "warmup_finished"))
