"""The array cache against files that numpy writes, and redaction of nested values against a walk in Python."""

import hashlib
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.redaction import Redaction, redacted_frame
from corvane.sources.array_cache import npy_header, read_arrays


def saved(array):
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


@pytest.mark.parametrize("array", [np.ones((3, 4), np.float32), np.zeros((2, 3, 5), bool), np.arange(6, dtype=np.uint8).reshape(6, 1), np.zeros(7, np.uint8)])
def test_header(spark, array):
    data = saved(array)
    row = spark.createDataFrame([(bytearray(data),)], "data binary").select(npy_header(F.col("data")).alias("h")).first().h
    assert (row.dtype, row.shape, len(data) - row.start) == (array.dtype.name, list(array.shape), array.nbytes)


def test_no_header(spark):
    bad = [b"", None, b"\x93NUMPY", saved(np.ones((2, 2), np.float64)), saved(np.asfortranarray(np.ones((2, 3), np.float32))), saved(np.ones((2, 2), np.float32))[1:]]
    rows = spark.createDataFrame([(None if x is None else bytearray(x),) for x in bad], "data binary").select(npy_header(F.col("data")).alias("h")).collect()
    assert all(r.h is None for r in rows)


def test_outcomes(spark):
    deep, mask = saved(np.ones((3, 4), np.float32)), saved(np.zeros((2, 3, 5), bool))
    digest = hashlib.sha256("\n".join(f"{n}:{hashlib.sha256(x).hexdigest()}" for n, x in (("depth", deep), ("mask", mask))).encode()).hexdigest()
    good = {"schema_version": 1, "sample_id": "s", "stage": "mask", "kind": "npz", "fingerprint": "f", "array_sha256": digest, "metadata": {"x": 1},
            "arrays": {"mask": {"shape": [2, 3, 5], "dtype": "bool", "ndim": 3}, "depth": {"shape": [3, 4], "dtype": "float32", "ndim": 2}}}
    depth = lambda **x: good["arrays"] | {"depth": good["arrays"]["depth"] | x}
    cases = {
        "good": (good, "hit", ""), "none": (None, "damaged", "manifest"), "text": ("x", "damaged", "manifest"), "number": (7, "damaged", "manifest"), "old": (good | {"fingerprint": "g"}, "miss", "stale"),
        "json": (good | {"kind": "json"}, "miss", "other_kind"), "kind": (good | {"kind": "zip"}, "damaged", "manifest"), "version": (good | {"schema_version": 2}, "damaged", "manifest"), "short": ({k: v for k, v in good.items() if k != "metadata"}, "damaged", "manifest"),
        "sum": (good | {"array_sha256": "0" * 64}, "damaged", "checksum"), "list": (good | {"arrays": []}, "damaged", "descriptors"), "empty": (good | {"arrays": {}}, "damaged", "descriptors"), "zero": (good | {"arrays": depth(shape=[0, 4])}, "damaged", "descriptors"),
        "large": (good | {"arrays": depth(shape=[10**6, 10**6])}, "damaged", "descriptors"), "ndim": (good | {"arrays": depth(ndim=3)}, "damaged", "descriptors"), "type": (good | {"arrays": depth(dtype="uint8")}, "damaged", "arrays"), "turned": (good | {"arrays": depth(shape=[4, 3])}, "damaged", "arrays"),
        "more": (good | {"arrays": good["arrays"] | {"z": good["arrays"]["mask"]}}, "damaged", "names"),
    }
    named = lambda body, key: body if not isinstance(body, dict) else body | {"sample_id": key}
    manifests = [(k, "mask", json.dumps(named(b, k)) if b is not None else None) for k, (b, _, _) in cases.items()] + [("bare", "mask", json.dumps(named(good, "bare")))]
    arrays = [(k, "mask", n, bytearray(x)) for k in [*cases, "alone"] for n, x in (("mask", mask), ("depth", deep))]
    wanted = [(k, "mask", "f") for k in [*cases, "alone", "absent", "bare"]]
    found = read_arrays(spark.createDataFrame(wanted, "sample_id string, stage string, fingerprint string"), spark.createDataFrame(manifests, "sample_id string, stage string, body string"), spark.createDataFrame(arrays, "sample_id string, stage string, name string, data binary"))
    got = {r.sample_id: r for r in found.collect()}
    want = {k: (o, r) for k, (_, o, r) in cases.items()} | {"alone": ("miss", "absent"), "absent": ("miss", "absent"), "bare": ("damaged", "no_arrays")}
    assert {k: (r.outcome, r.reason) for k, r in got.items()} == want
    assert [(x.name, x.shape, bytes(x.data)) for x in got["good"].arrays] == [("depth", [3, 4], deep), ("mask", [2, 3, 5], mask)] and got["old"].arrays is None


def test_nested_redaction(spark):
    schema = "id int, a struct<api_key: string, b: array<struct<`Api-Key`: int, t: string, m: map<string, array<string>>>>>, m map<string, map<string, string>>, API_KEY string, n map<int, string>"
    rows = [
        (1, ("k", [(5, "x sk-abc_1, ask-me sk-d", {"sk-1": ["sk-2"], "api-key": ["v"], "t": ["topsecret", None]}), None]), {"o": {"API_KEY": "v", "sk-a": "1", "sk-b": "2", "c": "data:image/png;base64,AA"}}, "v", {1: "sk-z"}),
        (2, None, None, None, None),
        (3, (None, []), {}, "", {}),
    ]
    got = {r.id: r.asDict(recursive=True) for r in redacted_frame(spark.createDataFrame(rows, schema), Redaction(texts=("topsecret",))).collect()}
    assert got[1]["a"] == {"api_key": "[REDACTED]", "b": [{"Api-Key": None, "t": "x [REDACTED], ask-me [REDACTED]", "m": {"[REDACTED]": ["[REDACTED]"], "api-key": None, "t": ["[REDACTED]", None]}}, None]}
    assert got[1]["m"]["o"].pop("[REDACTED]") in ("1", "2")  # the last one in the map's own order, which a dict doesn't fix
    assert got[1]["m"] == {"o": {"API_KEY": "[REDACTED]", "c": "[REDACTED_BASE64_IMAGE]"}} and got[1]["API_KEY"] == "[REDACTED]" and got[1]["n"] == {1: "[REDACTED]"}
    assert got[2]["a"] is None and got[2]["m"] is None and got[3]["a"] == {"api_key": "[REDACTED]", "b": []} and got[3]["m"] == {}
