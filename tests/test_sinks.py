"""Repeatable sinks, class lists, assembly by key and the bootstrap, against plain Python."""

import csv
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.text import fixed
from corvane.operators.matching import assembled
from corvane.operators.metrics import paired_bootstrap
from corvane.sources import class_names as c
from corvane.sources import sinks


@pytest.mark.parametrize("places", [0, 1, 3, 6])
def test_fixed(spark, places):
    rng = random.Random(4)
    values = [0.0, -0.0, 0.0625, 0.1875, -0.3125, 0.0005, 0.0015, 1.0005, 2.5, 1.5, 0.9995, 0.99951, 999.9999995, 1e-9, -1e-9, 123456.789, 1 / 3, None, float("nan"), float("inf"), -float("inf")]
    values += [rng.uniform(-1, 1) for _ in range(500)] + [rng.randint(0, 400) / rng.randint(1, 400) for _ in range(2000)] + [rng.randint(-2000, 2000) / 2000 for _ in range(300)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(fixed(F.col("v"), places)).collect()]
    want = ["" if v is None else f"{v:.{places}f}" for v in values]
    assert got == [w.removeprefix("-") if v == 0 else w for v, w in zip(values, want, strict=True)]  # zero has no sign here


@pytest.mark.parametrize("parts, end", [(1, "\n"), (4, "\r\n")])
def test_ordered_csv(spark, tmp_path, parts, end):
    rng = random.Random(5)
    rows = [(rng.choice(["b", "a", "zz", None]), rng.choice([1, 2, None]), rng.choice(['x,"y"', "line\nbreak", "", None, "é"]), rng.random()) for _ in range(300)]
    table = spark.createDataFrame(rows, "kind string, n int, text string, v double").repartition(5)
    order = ("zz", "a")
    path, target = str(tmp_path / "parts"), str(tmp_path / "whole.csv")
    sinks.write_ordered_csv(table, path, {"kind": F.col("kind"), "n, all": F.col("n"), "text": F.col("text"), "v": fixed(F.col("v"), 3)}, [sinks.place_in(F.col("kind"), order), F.col("n")], mark=True, line_end=end, parts=parts)
    sinks.join_parts(spark, path, target)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["kind", "n, all", "text", "v"])
    line = lambda r: ",".join(f'"{x}"'.replace('"x,"y""', '"x,""y"""') if x and set(x) & set('",\n') else x or "" for x in r)
    shown = [((order.index(k) if k in order else 9, n is not None, n or 0), ["" if x is None else str(x) for x in (k, n, t)] + [f"{v:.3f}"]) for k, n, t, v in rows]
    for _, r in sorted(shown, key=lambda x: (x[0], line(x[1]).encode())):
        writer.writerow(r)
    with open(target, "rb") as made:
        assert made.read() == b"\xef\xbb\xbf" + out.getvalue().encode()
    sinks.write_ordered_csv(table.where("false"), path, {"kind": F.col("kind")}, [F.col("kind")])
    sinks.join_parts(spark, path, target)
    with open(target, "rb") as made:
        assert made.read() == b"kind\n"


def test_append_log(spark, tmp_path):
    path = str(tmp_path / "log")
    table = spark.createDataFrame([(i, f"t{i}\n") for i in range(50)], "id int, text string")
    assert sinks.read_log(spark, path, table.schema).count() == 0
    assert sinks.append_batch(table.where("id < 20"), path, 0) and not sinks.append_batch(table.where("id < 20"), path, 0)
    broken = table.where("id >= 20").repartition(8, "id").withColumn("text", F.when(F.col("id") == 41, F.raise_error(F.lit("killed"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="killed"):
        sinks.append_batch(broken, path, 1)
    assert sinks.read_log(spark, path, table.schema).count() == 20
    assert sinks.append_batch(table.where("id >= 20"), path, 1)
    rows = sinks.read_log(spark, path, table.schema)
    assert sorted((r.id, r.text, r.batch) for r in rows.collect()) == [(i, f"t{i}\n", int(i >= 20)) for i in range(50)]


def test_killed_stream(spark, tmp_path):
    source, path, check = (str(tmp_path / x) for x in ("in", "log", "check"))
    spark.range(30).repartition(3).write.parquet(source)
    stream = lambda: spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(source)

    def dies(frame, number):
        if number == 1:
            frame.limit(3).write.json(f"{path}/rows/batch={number}")  # rows of a batch that never commits
            raise RuntimeError("killed")

    query = sinks.append_stream(stream(), path, check, dies)
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination(60)
    schema = spark.range(0).schema
    assert 0 < sinks.read_log(spark, path, schema).count() < 30
    for _ in range(2):  # the second restart has nothing to do
        sinks.append_stream(stream(), path, check).awaitTermination(60)
        assert sorted(r.id for r in sinks.read_log(spark, path, schema).collect()) == list(range(30))


def test_class_lists(spark, tmp_path):
    texts = {
        "list": "names: ['a, b', \"c: d\", e] # three\ntrain: x", "block": "names:\r\n- a  # first\r\n- 'b # c'\r\n\r\n- \"\"\r\nnc: 3", "map": "nc: 2\nnames:\n  0: a\n  # none\n  5: \"b\"\nval: images/val # v\n", "inline": "names: {0: a, 1: 'b, c'}",
        "mixed": "names:\n  - a\n  1: b\n", "nothing": "path: x\n", "empty": "", "last": "names:\n - only", "twice": "names: [a, b, a]",
    }
    want = {"list": [(0, "a, b", None), (1, "c: d", None), (2, "e", None)], "block": [(0, "a", None), (1, "b # c", None), (2, "", "blank")], "map": [(0, "a", None), (5, "b", None)], "inline": [(0, "a", None), (1, "b, c", None)],
            "mixed": [(0, "from text", None)], "nothing": [(0, "from text", None)], "empty": [(0, "from text", None)], "last": [(0, "only", None)], "twice": [(0, "a", "repeated"), (1, "b", None), (2, "a", "repeated")], "bare": [(None, None, "none")]}
    for key, text in texts.items():
        (tmp_path / "sets" / key).mkdir(parents=True)
        (tmp_path / "sets" / key / "dataset.yaml").write_bytes(text.encode())
        (tmp_path / "sets" / key / "classes.txt").write_text("\n from text \n")
    (tmp_path / "sets" / "bare").mkdir()
    (tmp_path / "sets" / "bare" / "classes.txt").write_text("\n")
    got = {}
    for r in c.read_class_lists(spark, str(tmp_path / "sets")).collect():
        got.setdefault(r.folder.rsplit("/", 1)[1], []).append((r.class_id, r.name, r.problem))
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {k: sorted(v, key=repr) for k, v in want.items()}
    splits = spark.createDataFrame([(texts["map"],), ("train: a/b\ntest: 'c d'",)], "text string").select(c.yaml_splits(F.col("text")).alias("s")).collect()
    assert [[tuple(x) for x in r.s] for r in splits] == [[("val", "images/val")], [("train", "a/b"), ("test", "c d")]]


def test_class_lists_of_many_names(spark):
    names = [f"part, {i}" for i in range(20_000)] + ["twice", "twice", ""]
    lines = "\n".join(f"  - '{n}'" for n in names)
    texts = {"list": "names: [" + ", ".join(f"'{n}'" for n in names) + "]\n", "block": f"names:\n{lines}\nnc: 5\n", "map": "names: {" + ", ".join(f'{i}: "{n}"' for i, n in enumerate(names)) + "}\n"}
    files = spark.createDataFrame([(k, "dataset.yaml", t) for k, t in texts.items()], "k string, file string, text string")
    got = {}
    for r in c.class_lists(files, "k").collect():
        got.setdefault(r.k, []).append((r.class_id, r.name, r.problem))
    want = [(i, n, {"twice": "repeated", "": "blank"}.get(n)) for i, n in enumerate(names)]
    assert set(got) == set(texts) and all(sorted(own) == sorted(want, key=lambda x: x[0]) for own in got.values())


def test_assembled(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.0), (2, None, 2.0), (None, None, 5.0)], "k int, g string, u double")
    b = spark.createDataFrame([(1, "x", "t"), (3, "y", "w")], "k int, g string, t string")
    empty = spark.createDataFrame([], "k int, g string, u int")
    got = {(r.k, r.g): (r.a and r.a.u, r.b and r.b.t, r.c, r.missing, r.repeated) for r in assembled({"a": a, "b": b, "c": empty}, ["k", "g"]).collect()}
    assert got == {(1, "x"): (1.0, "t", None, ["c"], []), (2, None): (2.0, None, None, ["b", "c"], ["a"]), (None, None): (5.0, None, None, ["b", "c"], []), (3, "y"): (None, "w", None, ["a", "c"], [])}


def test_bootstrap(spark):
    rng = np.random.default_rng(8)
    d = rng.gamma(2.0, size=400)
    table = spark.createDataFrame([(i, float(x), 0.0) for i, x in enumerate(d)] + [(999, None, 1.0)], "id bigint, a double, b double")
    one, two = (paired_bootstrap(table.repartition(n), 2000).first() for n in (1, 5))
    assert one[:] == pytest.approx(two[:], rel=1e-9) and one.n == 400 and one.difference == pytest.approx(d.mean())
    exact = np.quantile(rng.choice(d, (20_000, 400)).mean(axis=1), [0.025, 0.975])
    assert [one.low, one.high] == pytest.approx(exact, abs=0.1 * (exact[1] - exact[0]))
    none = paired_bootstrap(table.where("false"), 50).first()
    assert none.n == 0 and none.difference is None and none.low is None
