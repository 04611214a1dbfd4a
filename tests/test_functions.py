import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import measures, raster, text
from corvane.functions.parser import parse_output, parsed_output
from corvane.operators import assignment, latency, matching
from corvane.sources import records


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize(("name", "want"), [("Traffic  Cones!", "traffic cone"), ("Buses", "bus"), ("bus", "bus"), ("species", "species"), ("ladies", "lady"), ("ties", "tie"), ("boxes", "box"), ("glasses", "glasses"), ("benches", "bench"), ("axis", "axis"), ("", ""), ("gas-pipes", "gas pipe")])
def test_cautious_name(spark, name, want):
    assert values(spark, [(name,)], "n string", text.cautious_name(F.col("n"))) == [(want,)]


@pytest.mark.parametrize(("name", "want"), [("Cones", "cone"), ("bus", "bu"), ("glass", "glass"), ("as", "as"), ("low-hanging wires.", "low hanging wire")])
def test_simple_name(spark, name, want):
    assert values(spark, [(name,)], "n string", text.simple_name(F.col("n"))) == [(want,)]


@pytest.mark.parametrize(
    ("raw", "steps", "want"),
    [
        ("3 steps", 3, "direct_numeric"), ("about 3 steps ahead", 3, "direct_numeric"), ("3 steps to the left", 3, "direct_numeric"), ("between 2 and 4 steps", 3, "direct_numeric"),
        ("2-4 steps", 3, "direct_numeric"), ("from 2 to 4 steps", 3, "direct_numeric"), ("1.8 meters", 3, "direct_numeric"), ("6 feet", 3, "direct_numeric"), ("3 steps behind it", 3, "derived_reviewed"),
        ("possibly 3 steps", 3, "derived_reviewed"), ("at least 3 steps", 3, "derived_reviewed"), ("< 3 steps", 3, "derived_reviewed"), ("walk 3 steps", 3, "derived_reviewed"), ("around 3 steps", 3, "direct_numeric"),
        ("around the corner, 3 steps", 3, "derived_reviewed"), ("3 steps, 2 cones", 3, "derived_reviewed"), ("5 steps", 3, "derived_reviewed"), (None, 3, "derived_reviewed"), ("3 steps", None, "unknown"), ("4 to 2 steps", 3, "derived_reviewed"),
    ],
)
def test_provenance(spark, raw, steps, want):
    assert values(spark, [(raw, steps)], "r string, s int", measures.distance_provenance(F.col("s"), F.col("r"))) == [(want,)]


def test_bins_and_angles(spark):
    got = values(spark, [(5,), (6,), (8,), (9,), (None,)], "s int", measures.distance_bin(F.col("s")), measures.prompt_distance_bin(F.col("s")))
    assert got == [("Near", "near"), ("Medium", "near"), ("Medium", "near"), ("Far", "near"), ("Unknown", None)]
    assert values(spark, [(0, 1), (0, 11), (10, 11)], "x int, w int", measures.direction_degrees(F.col("x"), F.col("w"))) == [(0.0,), (90.0,), (-90.0,)]
    assert values(spark, [(255.0,), (0.0,), (256.0,)], "d double", measures.depth_steps(F.col("d"))) == [(4,), (None,), (None,)]


def test_percentiles(spark):
    rows = [("ok", "x", v) for v in (1.0, 2.0, 3.0, 100.0)] + [("error", "x", None)]
    got = latency.latency_summary(spark.createDataFrame(rows, "status string, branch string, seconds double"), [["branch"]]).collect()[0]
    assert (got.attempts, got.successes, got.mean) == (5, 4, 26.5) and got.p95 == pytest.approx(85.45)


@pytest.mark.parametrize(
    ("raw", "detect", "want"),
    [
        ("<ALERT>a car</ALERT><GUIDE>go  left</GUIDE>", True, ("a car", "go left", True, False)),
        ("```\n<ALERT>a</ALERT><GUIDE>b</GUIDE>\n```", False, ("a", "b", None, False)),
        ("<alert>a</alert> <guide>b", False, ("a", "b", None, True)),
        ("ALERT: a\nGUIDE: b", True, ("a", "b", True, True)),
        ('{"alert": "a", "guide": "b"}', False, ("a", "b", None, True)),
        ('{"status": "safe"}', True, ("", "", False, True)),
        ("<SAFE/>", True, ("", "", False, False)),
        ("<SAFE>", True, ("", "", False, True)),
        ("safe", True, ("", "", False, False)),
        ("nothing here", True, ("nothing here", "", None, True)),
        ("  ", False, ("", "", None, True)),
        ("<ALERT>a</ALERT><ALERT>a</ALERT><GUIDE></GUIDE>", False, ("a", "", None, True)),
        ("<ALERT>a<GUIDE>b</GUIDE>", False, ("a", "b", None, True)),
    ],
)
def test_parser(raw, detect, want):
    assert parse_output(raw, detect) == want


def test_parser_strict_lane(spark):
    """Spark's own reading of strict texts gives what the walk over marks gives, on texts of a generated grammar."""
    rng = random.Random(5)
    bits = ["<ALERT>", "</ALERT>", "<GUIDE>", "</GUIDE>", "< alert >", "</ guide", "\n", " ", "a car", "go\u00a0 left", "ALERT: ", "\n- **Guide**\uff1a ", "<SAFE/>", "\nSAFE\n", "<<SAFE>", "```\n", "{}", '{"alert": "q"}']
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 7))) for _ in range(1500)]
    texts += [f"{rng.choice(['', ' ', chr(10)])}<ALERT>{rng.choice(bits)}x </ALERT>{rng.choice(['', chr(10)])}<GUIDE>{rng.choice(bits)}</GUIDE>" for _ in range(500)] + [None]
    for detect in (False, True):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", parsed_output(F.col("t"), detect).alias("x")).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert tuple(r.x) == parse_output(texts[r.i] or "", detect), texts[r.i]


def flooded(mask):
    """Regions by flood filling, for comparison."""
    out, number = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask):
        if out[y, x] == 0:
            number += 1
            stack = [(y, x)]
            while stack:
                a, b = stack.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and out[a, b] == 0:
                    out[a, b] = number
                    stack += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    return out


def test_rasters():
    rng = np.random.default_rng(1)
    for _ in range(200):
        mask = rng.random(tuple(rng.integers(1, 9, 2))) < 0.6
        assert (raster.regions(mask) == flooded(mask)).all()
    ring = np.array([[0, 1, 1, 1], [0, 1, 0, 1], [0, 1, 1, 1], [1, 0, 0, 0]]) > 0
    assert raster.filled(ring)[1, 2] and not raster.filled(ring)[0, 0]
    assert raster.single_region(ring, (0, 3, 1, 4)).sum() == 1 and raster.single_region(ring, (1, 0, 4, 3)).sum() == 9
    assert raster.edge_correlation(np.zeros((4, 4)), rng.random((4, 4))) == 1.0
    a = rng.random((5, 6))
    assert raster.edge_correlation(a, a) == pytest.approx(1.0) and raster.near_regions(np.zeros((2, 2), np.uint8), 1) == (0.0, 0.0)


def test_assignment_is_optimal():
    rng = random.Random(3)
    for _ in range(300):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        edges = [(i, j, rng.choice([0, 2 / 3, 1, 4 / 3, 2])) for i in range(n) for j in range(m) if rng.random() < 0.7]
        if not edges:
            continue
        cost = {(i, j): c for i, j, c in edges}
        best = min((-k, sum(cost[e] for e in s)) for k in range(min(n, m) + 1) for s in itertools.combinations(cost, k) if len({e[0] for e in s}) == k == len({e[1] for e in s}))
        got = assignment._best_pairs(edges)
        assert (-len(got), pytest.approx(sum(cost[e] for e in got))) == best
        equal = [s for s in itertools.combinations(sorted(cost), len(got)) if len({e[0] for e in s}) == len(got) == len({e[1] for e in s}) and sum(cost[e] for e in s) == pytest.approx(best[1])]
        digits = lambda s: [dict(s).get(i, 0) for i in range(n)]
        columns = {p: at for at, p in enumerate(sorted({e[1] for e in edges}))}
        assert digits([(a, columns[b]) for a, b in got]) == min(digits([(a, columns[b]) for a, b in s]) for s in equal)
    edges = [(0, 0, 0.0), (0, 1, 0.0), (1, 0, 0.0), (1, 3, 0.0), (2, 2, 0.0)]
    assert sorted(pair for part in assignment._parts(edges) for pair in assignment._best_pairs(part)) == [(0, 0), (1, 3), (2, 2)]


def test_assigned_over_batches(spark):
    rows = [(s, g, p, float((g + p) % 3)) for s in range(50) for g in range(3) for p in range(2)] + [(99, 0, 0, 2.0)]
    got = assignment.assigned(spark.createDataFrame(rows, "s int, gt_index int, pred_index int, cost double"), ["s"]).collect()
    assert len(got) == 101 and {tuple(r) for r in got if r.s == 7} == {tuple(r) if r.s == 7 else (7, *tuple(r)[1:]) for r in got if r.s == 8}


def test_overrides(spark):
    pairs = spark.createDataFrame([(1, "m", 0, 0, "exact"), (1, "m", 1, 1, "exact"), (2, "m", 0, 0, "exact")], "record_index int, method string, gt_index int, pred_index int, source string")
    given = spark.createDataFrame([(1, 1, "m", 0, 1), (2, 1, "m", 1, None), (3, 3, "m", 0, 2)], "ord int, record_index int, method string, gt_index int, pred_index int")
    got = {tuple(r) for r in matching.overridden(pairs, given).collect()}
    assert got == {(1, "m", 0, 1, "manual"), (2, "m", 0, 0, "exact"), (3, "m", 0, 2, "manual")}


def test_synonyms_form_stars():
    assert matching.stars((("a", "b"), ("a", "c")))["b"] == ("a", False)
    with pytest.raises(ValueError, match="star"):
        matching.stars((("a", "b"), ("b", "c"), ("c", "d")))
    assert matching.stars(matching.synonyms("loose"))["fence"] == ("barrier", False)


def test_rank_matching_equals_greedy(spark):
    rng, names = random.Random(5), ["car", "vehicle", "truck", "bike", "Cars", "fence", "barrier", "x"]
    gt = [(r, "m", i, rng.choice(names)) for r in range(60) for i in range(rng.randint(0, 4))]
    pred = [(r, "m", i, rng.choice(names)) for r in range(60) for i in range(rng.randint(0, 4))]
    schema = "record_index int, method string, object_index int, name string"
    got = {tuple(r)[:1] + tuple(r)[2:4] for r in matching.rule_matches(spark.createDataFrame(gt, schema), spark.createDataFrame(pred, schema), "loose").collect()}
    norm = {n: n.lower().rstrip("s") for n in names}
    pairs = {frozenset(p) for p in matching.synonyms("loose")}
    want = set()
    for r in range(60):
        free_g, free_p = [(i, norm[n]) for s, _, i, n in gt if s == r], [(i, norm[n]) for s, _, i, n in pred if s == r]
        for same in (lambda a, b: a == b, lambda a, b: frozenset((a, b)) in pairs):
            for g in list(free_g):
                hit = next((p for p in free_p if same(g[1], p[1])), None)
                if hit:
                    want.add((r, g[0], hit[0]))
                    free_g.remove(g)
                    free_p.remove(hit)
    assert len(got) == len(want)


def test_record_readers(spark):
    raw = "﻿\n\na.png\nsafe\n\nb.png\n\n\nc.png\nx\ny.png\n"
    lines = records.lines_of(spark.createDataFrame([("f", raw.replace("﻿", ""))], "source string, text string"))
    assert [(r.image, r.text) for r in records.triplets(lines).orderBy("position").collect()] == [("a.png", "safe"), ("b.png", ""), ("c.png", "x"), ("y.png", "")]
    body = spark.createDataFrame([("f", "a.png\none\n\ntwo\n\nb.JPG\nthree")], "source string, text string")
    assert [(r.sample_id, r.raw_text) for r in records.header_blocks(records.lines_of(body)).orderBy("position").collect()] == [("a.png", "one\n\ntwo"), ("b.JPG", "three")]
    with pytest.raises(Exception, match="before the first header"):
        records.header_blocks(records.lines_of(spark.createDataFrame([("f", "x\na.png")], "source string, text string"))).collect()
    good = spark.createDataFrame([("f", '[{"a": 1, "b": "x"}]')], "source string, text string")
    assert records.json_objects(good, "a int, b string", ["a", "b"]).count() == 1
    for bad in ('[{"a": 1}]', '[{"a": 1, "b": "x", "c": 1}]', '[{"a": 1, "b": "x", "b": "y"}]'):
        with pytest.raises(Exception, match="wrong keys"):
            records.json_objects(spark.createDataFrame([("f", bad)], "source string, text string"), "a int, b string", ["a", "b"]).collect()
    over = '# note\n\n{"record_index": 1, "method": "ours", "gt_index": 0, "pred_index": null, "reason": "r"}'
    rows = records.overrides(records.lines_of(spark.createDataFrame([("f", over)], "source string, text string")), ("ours",)).collect()
    assert [(r.record_index, r.pred_index) for r in rows] == [(1, None)]
    label = spark.createDataFrame([("f", "0 0.5 0.5 0.2 0.2\n01 0.5 0.5 0.2 0.2\n1 0.5")], "source string, text string")
    classes = spark.createDataFrame([(0, "car"), (1, "pole")], "class_id int, name string")
    assert [r.valid for r in records.box_labels(records.lines_of(label), classes).orderBy("annotation_index").collect()] == [True, False, False]


def test_streaming(spark, small, tmp_path):
    from corvane.plans.adapters import observations
    from corvane.streaming.latency import stream_gaps, windowed_latency

    observations(spark, small).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("epoch", F.col("micros") / 1e6).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, frame, mode in (("windows", windowed_latency(stream()), "append"), ("gaps", stream_gaps(stream(), 3600.0), "update")):
        run = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        run.processAllAvailable()
        run.stop()
    assert spark.sql("SELECT sum(samples) AS n FROM gaps").first().n == spark.read.parquet(str(tmp_path / "in")).count()
    assert spark.sql("SELECT count(*) AS n FROM windows").first().n > 0


def test_assignment_costs():
    # Fifths and sevenths are compared exactly, where sixths would round them together.
    edges = [(0, 0, 2 * (1 - 3 / 7)), (0, 1, 2 * (1 - 2 / 5)), (1, 0, 2 * (1 - 1 / 5)), (1, 1, 2 * (1 - 1 / 7))]
    want = min(([(0, 0), (1, 1)], edges[0][2] + edges[3][2]), ([(0, 1), (1, 0)], edges[1][2] + edges[2][2]), key=lambda x: x[1])[0]
    assert assignment._best_pairs(edges) == want
    with pytest.raises(ValueError, match="ratio"):
        assignment._best_pairs([(0, 0, 0.1234567891), (0, 1, 0.5)])


def test_seen(spark):
    rows = [("ahead", 0.0, 0.0, 5.0, True), ("left", -4.0, 0.0, 4.5, True), ("right", 4.5, 0.0, 4.0, True), ("feet", 0.05, -1.0, 0.01, True), ("behind", 0.0, 0.0, -3.0, True), ("far", 0.0, 0.0, 11.0, True), ("off", 0.0, 0.0, 5.0, False), ("unknown", None, 0.0, 5.0, True)]
    table = spark.createDataFrame(rows, "name string, x double, y double, z double, active boolean")
    point = (F.col("x"), F.col("y"), F.col("z"))
    zero = F.lit(0.0)
    look = lambda forward, **more: {r.name: r.s for r in table.select("name", measures.seen((zero, zero, zero), forward, point, point, F.col("active"), half_angle=45, most_distance=10, **more).alias("s")).collect()}
    level = look((zero, zero, F.lit(1.0)))
    assert {n for n, s in level.items() if s.seen} == {"ahead", "left", "feet"}
    assert level["left"].direction == pytest.approx(41.63, abs=0.01) and level["right"].direction == pytest.approx(-48.37, abs=0.01) and level["behind"].direction == -180 and level["feet"].direction == 0
    assert look((zero, zero, F.lit(1.0)), inactive=True)["off"].seen and look((F.lit(1.0), zero, zero))["right"].seen
