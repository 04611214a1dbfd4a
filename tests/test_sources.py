"""Readers and writers on files, read back."""

import hashlib

import numpy as np
import pytest
from pyspark.errors import PySparkException

from corvane.functions.raster import eight_bit
from corvane.sources import records


def test_csv_manifest(spark, tmp_path):
    path = str(tmp_path / "manifest.csv")
    with open(path, "w", encoding="utf-8") as file:
        file.write('﻿run_order,image,extra\n1,"a,b.png",x\n 2 ,c.png,y\n')
    got = records.csv_manifest(spark, path, ("run_order", "image"), whole=("run_order",), key=("run_order",))
    assert got.dtypes == [("run_order", "bigint"), ("image", "string")]
    assert sorted(map(tuple, got.collect())) == [(1, "a,b.png"), (2, "c.png")]
    with pytest.raises(ValueError, match="missing"):
        records.csv_manifest(spark, path, ("run_order", "other"))
    with open(path, "a", encoding="utf-8") as file:
        file.write("2,d.png,z\n")
    with pytest.raises(ValueError, match="more than once"):
        records.csv_manifest(spark, path, ("run_order",), whole=("run_order",), key=("run_order",))
    with open(path, "a", encoding="utf-8") as file:
        file.write("two,e.png,z\n")
    with pytest.raises(PySparkException, match="no whole number"):
        records.csv_manifest(spark, path, ("run_order",), whole=("run_order",)).collect()


def test_create_once(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = spark.createDataFrame([(1, "a")], "i int, t string")
    assert records.create_once(rows, path) and not records.create_once(rows, path)
    with pytest.raises(ValueError, match="other rows"):
        records.create_once(rows.union(rows), path)


def test_files_and_hashes(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, text in (("One.png", b"1"), ("a/one.JPG", b"22"), ("a/two.txt", b"333"), ("b.jpeg", b"4444")):
        (tmp_path / name).write_bytes(text)
    found = {r.path.rsplit("/", 1)[1]: (r.stem, r.length, r.repeated_stem) for r in records.files(spark, str(tmp_path), (".png", ".jpg", ".jpeg")).collect()}
    assert found == {"One.png": ("One", 1, True), "one.JPG": ("one", 2, True), "b.jpeg": ("b", 4, False)}
    before = spark.createDataFrame(records.file_hashes(spark, str(tmp_path)).collect())
    assert {r.path.rsplit("/", 1)[1]: r.sha256 for r in before.collect()}["One.png"] == hashlib.sha256(b"1").hexdigest()
    (tmp_path / "One.png").write_bytes(b"9")
    (tmp_path / "b.jpeg").unlink()
    (tmp_path / "new.txt").write_bytes(b"n")
    changed = {r.path.rsplit("/", 1)[1]: (r.was is None, r["is"] is None) for r in records.manifest_differences(before, records.file_hashes(spark, str(tmp_path))).collect()}
    assert changed == {"One.png": (False, False), "b.jpeg": (False, True), "new.txt": (True, False)}


def test_reports(spark):
    rows = spark.createDataFrame([("a|b", 1, None), ("50%_{x}\\", 22, 0.5), ("c\nd", 3, 1.0)], "name string, n int, v double").coalesce(1)
    assert records.markdown(rows) == "| name | n | v |\n|---|---|---|\n| a\\|b | 1 |  |\n| 50%_{x}\\ | 22 | 0.5 |\n| c d | 3 | 1.0 |"
    assert records.markdown(rows, 2).endswith("… and 1 more") and records.latex(rows, 2).endswith("% 1 more")
    assert records.latex(rows).split("\n") == [r"\begin{tabular}{lrr}", r"\toprule", r"name & n & v \\", r"\midrule", r"a|b & 1 &  \\", r"50\%\_\{x\}\textbackslash{} & 22 & 0.5 \\", "c", r"d & 3 & 1.0 \\", r"\bottomrule", r"\end{tabular}"]


def test_odd_logs(spark):
    lines = lambda text: records.lines_of(spark.createDataFrame([("s", text)], "source string, text string"))
    assert records.line_pairs(lines("\n \n")).count() == 0
    with pytest.raises(PySparkException, match="left over"):
        records.line_pairs(lines("a\n\nb\nc")).collect()
    good, bad = records.json_lines(lines('{"k":1}\n\n{"k":\n[2]\n"x"'), "struct<k:int>")
    assert sorted((r.line_no, r.k) for r in good.collect())[0] == (1, 1) and [(r.line_no, r.line) for r in bad.collect()] == [(3, '{"k":')]


@pytest.mark.parametrize("values", [[3.0, 3.0], [0.0, 0.5, 1.0], [-4.0, 1.0, 6.0, 0.98]])
def test_eight_bit(values):
    low, high = min(values), max(values)
    want = [0 if high == low else round((v - low) * (255 / (high - low))) for v in values]
    assert eight_bit(np.array(values)).tolist() == want
