"""Contracts between tables on odd rows."""

import duckdb
import pytest
from comparing import assert_same
from pyspark.sql import functions as F

from corvane.operators import contracts as c
from corvane.plans.catalogue import ORACLE_SQL, QUERIES


def test_pairs(spark):
    reference = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None), ("b", "y"), ("c", None), ("c", None), ("d", "z")], "k string, t string")
    prediction = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("c", "4"), ("e", "5")], "k string, t string")
    assert sorted(map(tuple, c.pair_problems(reference, prediction, "k", "t").collect())) == [("conflicting_reference", "b"), ("duplicate_prediction", "c"), ("prediction_only", "e"), ("reference_only", "d")]
    with pytest.raises(c.ContractError, match="problem"):
        c.paired_strictly(reference, prediction, "k", "t")
    good = c.paired_strictly(reference.where("k in ('a', 'c')"), prediction.where("t in ('1', '3')"), "k", "t")
    assert sorted((r.k, r.t, r.reference_text) for r in good.collect()) == [("a", "1", "x"), ("c", "3", None)]


def test_targets_and_lookups(spark):
    targets = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",)], "k string")
    records = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", None), ("c", None), ("z", "q")], "k string, t string")
    assert sorted(map(tuple, c.target_problems(targets, records, "k", "t").collect())) == [("conflicting_record", "b"), ("duplicate_target", "a"), ("missing_target", "d")]
    rows, counts = c.looked_up(targets, records, ["k"])
    assert rows.count() == 4 and counts.first()[:] == (4, 1)


def test_assignments(spark):
    bodies = ['{"assignments":[]}', None, "[]", '{"assignments":{}}', '{"assignments":[1]}', '{"assignments":[{"annotation_index":0,"category":"PIT"},{"annotation_index":1,"category":"PIT"}]}', '{"assignments":[{"annotation_index":true,"category":"PIT"}]}',
              '{"assignments":[{"annotation_index":0,"category":null},{"annotation_index":0,"category":"PIT"}]}', '{"assignments":[{"annotation_index":1,"category":"PIT","x":1}]}']
    rows = spark.createDataFrame([(i, b, [1, 0, 1]) for i, b in enumerate(bodies)], "k int, body string, want array<int>")
    got = {r.k: r.violations for r in c.assignment_violations(rows, "k", "body", "want", ("PIT",)).collect()}
    assert got == {0: ["ids"], 1: ["schema"], 2: ["schema"], 3: ["schema"], 4: ["schema"], 5: [], 6: ["index", "ids"], 7: ["repeated", "category", "ids"], 8: ["schema"]}


def test_merged(spark):
    objects = spark.createDataFrame([("s", 0), ("s", 1), ("t", 0)], "s string, i int")
    groups = [spark.createDataFrame([("s", 0, "Other"), ("u", 5, "x")], "s string, i int, c string"), spark.createDataFrame([("s", 0, None), ("s", 1, None)], "s string, i int, c string")]
    kept, problems = c.merged_assignments(objects, groups, "s", "i", "c")
    assert sorted(map(tuple, problems.collect())) == [("s", 0, "repeated"), ("t", 0, "missing"), ("u", 5, "unknown")]
    assert sorted((r.s, r.i, r.c) for r in kept.collect()) == [("s", 0, None), ("s", 1, None)]


def test_batches(spark):
    rows = spark.createDataFrame([("a", "safe"), ("a", "failed"), ("a", None), ("b", "rejected"), ("b", "filtered")], "b string, status string")
    assert {r.b: r[1:] for r in c.batch_summary(rows, ["b"]).collect()} == {"a": (3, 1, 0, 1, 0, 1), "b": (2, 0, 1, 0, 1, 0)}
    assert [r[:] for r in c.counted_objects(rows, "b", F.col("status") == "safe", 2).orderBy("b").collect()] == [("a", 3, 2, True), ("b", 2, 2, True)]


def test_batches_without_a_status(spark, tmp_path):
    orders = [(1, "O", 1.0, "4-NOT SPECIFIED"), (1, "P", 1.0, "4-NOT SPECIFIED"), (2, "O", 1.0, "4-NOT SPECIFIED"), (2, "F", 3e5, "5-LOW"), (3, "P", 1.0, "2-HIGH")]
    spark.createDataFrame(orders, "o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert_same(QUERIES["batch_outcomes"](spark, str(tmp_path)), con, ORACLE_SQL["batch_outcomes"])
