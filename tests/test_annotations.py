"""Annotation work lists and pair lists on odd rows; the review queue by hand."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corvane.operators import annotations as o
from corvane.operators.review import review_items
from corvane.plans.catalogue import QUERIES


def test_work_lists(spark):
    rows = spark.createDataFrame([("a", 1, "draft", None), ("a", 2, "completed", "done"), ("a", 3, None, None), ("a", 4, "completed", None), ("b", 1, "completed", "done")], "s string, i int, status string, role_status string")
    assert o.filtered(rows).count() == 5 and [r.i for r in o.filtered(rows, "unstarted").collect()] == [3] and {r.i for r in o.filtered(rows, "completed", "unstarted").collect()} == {4}
    got = {(r.s, r.i): r.next_open for r in o.next_open(rows, "s", "i", F.coalesce(F.col("status") != "completed", F.lit(True))).collect()}
    assert got == {("a", 1): 3, ("a", 2): 3, ("a", 3): 1, ("a", 4): 1, ("b", 1): None}
    assert {r.s: r[1:] for r in o.progress(rows, ["s"], F.col("status"), F.col("role_status") == "done").collect()} == {"a": (4, 2, 1, 1, 1), "b": (1, 1, 0, 0, 0)}
    names = spark.createDataFrame([("Car",), ("car ",), (" ",), (None,), ("Bus",)], "n string")
    assert sorted(map(tuple, o.folded_names(names, "n").collect())) == [("bus", "Bus", 1), ("car", "Car", 2)]


def test_counts(spark):
    rows = spark.createDataFrame([("a", {"x": 1, "y": None}), ("a", {"x": 4}), ("b", {}), ("c", None)], "k string, c map<string, int>")
    assert sorted(map(tuple, o.summed(rows, ["k"], "c").collect())) == [("a", "x", 5), ("a", "y", 0)]
    verdicts = spark.createDataFrame([("a", "1"), ("a", " 2 "), ("a", "3"), ("a", None)], "k string, v string")
    assert o.win_counts(verdicts, ["k"], "v").first()[:] == ("a", 1, 1, 2)
    with pytest.raises(PySparkException, match="no verdict"):
        o.win_counts(verdicts, ["k"], "v", strict=True).collect()


@pytest.mark.parametrize("text, strict, tolerant", [
    ('{"pairs":[]}', [], []), ('{"pairs":[{"gt_index":0,"pred_index":1}]}', [(0, 1)], [(0, 1)]), ('ok {"pairs":[{"gt_index":0,"pred_index":1}]} end', None, [(0, 1)]), ('{"pairs":[{"gt_index":0,"pred_index":1}],"x":1}', None, [(0, 1)]),
    ('{"pairs":[{"gt_index":0,"pred_index":1},{"gt_index":0,"pred_index":2},{"gt_index":3,"pred_index":1},{"gt_index":4,"pred_index":2}]}', None, [(0, 1), (4, 2)]), ('{"pairs":[{"gt_index":true,"pred_index":1},{"gt_index":1.5,"pred_index":1},3,null]}', None, []),
    ('{"pairs":{}}', None, None), ("nothing", None, None), (None, None, None),
])
def test_pair_list(spark, text, strict, tolerant):
    row = spark.createDataFrame([(text,)], "t string").select(o.pair_list(F.col("t")).alias("s"), o.pair_list(F.col("t"), tolerant=True).alias("t")).first()
    plain = lambda x: None if x is None else [tuple(p) for p in x]
    assert (plain(row.s), plain(row.t)) == (strict, tolerant)


def test_pair_lists_parse_each_answer_once(spark, small):
    plan = QUERIES["pair_lists"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 2  # strictly and tolerantly


def test_pair_list_of_odd_items(spark):
    pair = '{"gt_index":0,"pred_index":1}'
    items = ['{"gt_index":1,"pred_index":1e0}', '{"gt_index":99999999999,"pred_index":3}', '{"gt_index":2}', '{"gt_index":2,"pred_index":4,"why":"x"}', "[1,2]", '"x"', "{}", '{"gt_index":null,"pred_index":6}']
    rows = spark.createDataFrame([(f'{{"pairs":[{pair},{i}]}}',) for i in items], "t string").select(o.pair_list(F.col("t")).alias("s"), o.pair_list(F.col("t"), tolerant=True).alias("t")).collect()
    assert all(r.s is None for r in rows) and [[tuple(p) for p in r.t][1:] for r in rows] == [[], [], [], [(2, 4)], [], [], [], []]


def test_review_queue(spark):
    objects = "record_index int, method string, object_index int, name string, categories array<string>"
    gt = spark.createDataFrame([(1, m, i, n, c) for m in ("a", "b") for i, n, c in ((0, "car", ["GROUND"]), (1, "hole", ["PIT"]))] + [(2, "a", 0, "bin", None)], objects)
    pred = spark.createDataFrame([(1, "a", 0, "cars", []), (1, "a", 1, "pit", []), (1, "b", 5, "car", [])], objects)
    pairs = spark.createDataFrame([(1, "a", 0, 0, "exact"), (1, "a", 1, 1, "decision")], "record_index int, method string, gt_index int, pred_index int, source string")
    decisions = spark.createDataFrame([(1, "a", "ok", None), (1, "b", "unresolved", "timeout")], "record_index int, method string, status string, error string")
    rows = review_items(gt, pred, pairs, decisions, ("a", "b")).collect()
    of = lambda t: [r for r in rows if r.type == t]
    assert [(r.gt_index, r.gt_name, r.pred_index, r.pred_name) for r in of("decision_match")] == [(1, "hole", 1, "pit")]
    assert [(r.method, r.error, r.unresolved_gt, r.unresolved_pred) for r in of("decision_failure")] == [("b", "timeout", [0, 1], [5])]
    assert sorted((r.method, r.detected, r.match_source) for r in of("pit_overhead")) == [("a", True, "decision"), ("b", False, "unresolved")]
    assert [(r.record_index, r.method) for r in of("competing_candidates")] == [(1, "b")]
    assert [[tuple(x) for x in r.rule_matches] for r in of("rule_match_sample")] == [[(0, 0, "exact")]]
    assert sorted((r.gt_index, r.first_detected, r.first_pred_index, r.second_detected) for r in of("detection_disagreement")) == [(0, True, 0, False), (1, True, 1, False)]
    assert len(rows) == 8


def test_review_items_read_the_lines_once(spark, small):
    plan = QUERIES["review_items"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
