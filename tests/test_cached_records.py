"""The cached-record validator: every planted fault is named, and odd bodies."""

from pyspark.sql import functions as F

from corvane.operators import cached_records as c
from corvane.plans.cached_records import EQUAL, FAULTS, records

#: What each planted fault must be called.
NAMES = {0: "not_an_object", 1: "not_an_object", 2: "run_id", 3: "input_sha256", 4: "attempts", 5: "attempts", 6: "attempt_history", 7: "raw_response", 8: "objects", 9: "object_name", 10: "object_categories", 11: "object_categories", 12: "object_evidence",
         13: "object_id_repeated", 14: "safe_with_objects", 15: "hazard_without_objects", 16: "failed_without_error", 17: "scope_uncertain", 18: "chain_sha256", 19: "object_unresolved_filled", 20: "generation_empty"}


def test_planted_faults(spark, small):
    rows = c.record_violations(*records(spark, small), "doc_id", equal=EQUAL).collect()
    for fault in range(FAULTS):
        found = [r.violations for r in rows if r.doc_id % FAULTS == fault]
        assert found and (any(NAMES[fault] in v for v in found) if fault in NAMES else all(v == [] for v in found)), fault


def test_odd_bodies(spark):
    good = '{"status":"ok","scene_text_state":"ambiguous","scope_uncertain":false,"attempts":0,"attempt_history":[],"chain_sha256":"","raw_response":"","objects":[],"error":null,"human_review_status":"","agent_review_status":"","k":"1"}'
    bodies = [good, None, "", "{", "null", "[]", "1", good.replace('"k":"1"', '"k":"2"'), good.replace('"objects":[]', '"objects":[1,null]'), good.replace('"attempts":0', '"attempts":0.5'), good.replace('"status":"ok"', '"status":7'), good]
    table = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    samples = spark.createDataFrame([(i, "text", "1", "clash") for i in range(len(bodies) - 1)], "id int, raw_text string, k string, body string")
    got = {r.id: r.violations for r in c.record_violations(table, samples, "id", equal=("k",)).collect()}
    assert got[0] == [] and all(got[i] == ["not_an_object"] for i in range(1, 7)) and got[7] == ["k"]
    assert {"object_incomplete", "object_id", "object_name"} <= set(got[8]) and {"attempts", "attempt_history"} <= set(got[9]) and got[10] == ["status"] and got[11] == ["sample", "k"]
    assert c.record_violations(table.where("false"), samples, "id").count() == 0


def test_canonical(spark):
    rows = spark.createDataFrame([('{"b": [ {"y":1, "x":{"d":null,"c":2}} ], "a":"é"}', '{"a":"é","b":[{"x":{"c":2,"d":null},"y":1}]}')], "l string, r string")
    assert rows.select(c.canonical_text(F.col("l")) == c.canonical_text(F.col("r")), c.canonical_text(F.col("l")) == F.col("r")).first()[:] == (True, True)
