"""Exact quantiles against sorted lists, for groups that lie over many partitions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators.quantiles import quantiles_of_counts, value_counts, with_quantiles


def quantile(values, q):
    values = sorted(values)
    at = (len(values) - 1) * q
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [("hot", "a", rng.uniform(-5, 5)) for _ in range(6000)] + [("hot", "b", 7.0)] * 500  # far most rows in one group
    out += [(f"g{i}", "b", float(rng.randint(0, 3))) for i in range(40) for _ in range(i)] + [("none", "a", None)] * 3 + [(None, "a", 1.5), (None, None, 2.5), ("one", "b", 4.0)]
    return out


@pytest.mark.parametrize("parts", [1, 2, 13, 200])
def test_groups(spark, rows, parts):
    table = spark.createDataFrame(rows, "g string, s string, v double")
    counts = value_counts(table, [["g"]], "v")
    asked = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.group.g: r for r in quantiles_of_counts(counts, asked, parts).collect()}
    groups = {g: [v for x, _, v in rows if x == g and v is not None] for g in {r[0] for r in rows}}
    assert set(got) == {g for g, v in groups.items() if v}
    for g, r in got.items():
        for name, q in asked.items():
            assert r[name] == pytest.approx(quantile(groups[g], q), abs=1e-12)


def test_hot_group_is_dealt_out(spark, rows):
    table = spark.createDataFrame(rows, "g string, s string, v double")
    counts = value_counts(table, [["g"]], "v").repartitionByRange(16, "group", "value")
    sizes = [r["count"] for r in counts.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 0.25 * sum(sizes)


def test_sets(spark, rows):
    table = spark.createDataFrame(rows, "g string, s string, v double")
    got = {(r.g, r.s, r.grouping): r for r in with_quantiles(table, [["g", "s"], ["s"], []], "v", {"m": 0.5}, F.count("*").alias("n")).collect()}
    sets = {0: lambda r: (r[0], r[1]), 2: lambda r: (None, r[1]), 3: lambda r: (None, None)}
    want = {}
    for number, key in sets.items():
        for r in rows:
            want.setdefault((*key(r), number), []).append(r[2])
    assert set(got) == set(want)
    for key, values in want.items():
        held = [v for v in values if v is not None]
        assert got[key].n == len(values) and (got[key].m == pytest.approx(quantile(held, 0.5)) if held else got[key].m is None)
    assert with_quantiles(table.where("false"), [["g"]], "v", {"m": 0.5}, F.count("*").alias("n")).count() == 0
