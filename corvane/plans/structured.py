"""Queries on structured scoring: name rules, assignment, cohorts, field scores, judges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.measures import f1, post_hoc_distance_bin, prompt_distance_bin
from corvane.operators import assignment as s
from corvane.operators import matching as m
from corvane.operators import metrics as k
from corvane.operators.annotations import win_counts
from corvane.plans import adapters as a
from corvane.plans.confusion import EVENTS_SQL
from corvane.plans.recall import sides
from corvane.plans.registry import query

_KEYS = ["record_index", "method"]
_classes = ", ".join(f"({i}, '{c}', '{n}')" for i, (c, names) in enumerate(s.NAME_CLASSES) for n in names)
_EDGES = f"""{a.OBJECTS_SQL}, known AS (SELECT norm, max_by(class, ord) AS class FROM (SELECT ord, class, {a.simple_sql('name')} AS norm FROM (VALUES {_classes}) v(ord, class, name)) GROUP BY norm),
names AS (SELECT DISTINCT name FROM lines), normed AS (SELECT name, {a.simple_sql('name')} AS norm FROM names), classed AS (SELECT name, normed.norm, class FROM normed LEFT JOIN known USING (norm)),
ok AS (SELECT x.name AS gn, y.name AS pn FROM classed x, classed y WHERE x.norm = y.norm OR x.class = y.class
 OR EXISTS (FROM known c WHERE length(c.norm) >= 3 AND ((c.class = x.class AND contains(' ' || y.norm || ' ', ' ' || c.norm || ' ')) OR (c.class = y.class AND contains(' ' || x.norm || ' ', ' ' || c.norm || ' '))))
 OR len(list_intersect(string_split(x.norm, ' '), string_split(y.norm, ' '))) / len(list_distinct(list_concat(string_split(x.norm, ' '), string_split(y.norm, ' ')))) >= 0.4
 OR len(list_intersect(string_split(x.norm, ' '), string_split(y.norm, ' '))) IN (len(list_distinct(string_split(x.norm, ' '))), len(list_distinct(string_split(y.norm, ' '))))),
edges AS (SELECT g.record_index, g.method, g.object_index AS gt_index, p.object_index AS pred_index, 2 * (1 - len(list_intersect(g.categories, p.categories)) / len(list_distinct(list_concat(g.categories, p.categories)))) AS cost
 FROM gtm g JOIN pred p USING (record_index, method) JOIN ok ON ok.gn = g.name AND ok.pn = p.name)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.candidate_edges(*sides(spark, sf_dir), _KEYS)


@query(f"WITH {_EDGES} SELECT record_index, method, gt_index, pred_index, round(cost, 9) AS cost FROM edges")
def names_compatible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).withColumn("cost", F.round("cost", 9))


@query(f"""WITH {_EDGES}, gaps AS (SELECT *, cost - min(cost) OVER (PARTITION BY record_index, method, gt_index) AS g, cost - min(cost) OVER (PARTITION BY record_index, method, pred_index) AS p FROM edges)
SELECT record_index, method, gt_index, pred_index, count_if(abs(g) < 1e-12) OVER (PARTITION BY record_index, method, gt_index) > 1 OR count_if(abs(p) < 1e-12) OVER (PARTITION BY record_index, method, pred_index) > 1 AS competing FROM gaps""")
def competing_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.competing(edges(spark, sf_dir), _KEYS).select(*_KEYS, "gt_index", "pred_index", "competing")


@query()
def assignment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.assigned(edges(spark, sf_dir), _KEYS)


# Every way to pair the objects of a sample, in the order of its reference objects.
_WAYS = f"""WITH RECURSIVE {_EDGES}, gts AS (SELECT record_index, method, gt_index, row_number() OVER (PARTITION BY record_index, method ORDER BY gt_index) AS place FROM (SELECT DISTINCT record_index, method, gt_index FROM edges)),
ways(record_index, method, place, used, n, cost) AS (SELECT DISTINCT record_index, method, 0::BIGINT, []::INT[], 0, 0.0::DOUBLE FROM edges
 UNION ALL SELECT w.record_index, w.method, g.place, CASE WHEN e.pred_index IS NULL THEN w.used ELSE list_append(w.used, e.pred_index) END, w.n + CASE WHEN e.pred_index IS NULL THEN 0 ELSE 1 END, w.cost + coalesce(e.cost, 0)
 FROM ways w JOIN gts g ON g.record_index = w.record_index AND g.method = w.method AND g.place = w.place + 1
 JOIN (SELECT record_index, method, gt_index, pred_index, cost FROM edges UNION ALL SELECT record_index, method, gt_index, NULL, NULL FROM gts) e ON e.record_index = g.record_index AND e.method = g.method AND e.gt_index = g.gt_index
 WHERE e.pred_index IS NULL OR NOT list_contains(w.used, e.pred_index)),
most AS (SELECT record_index, method, max(n) AS pairs FROM ways GROUP BY ALL)"""


@query(f"""{_WAYS}
SELECT record_index, method, pairs::BIGINT AS pairs, round(min(cost), 6) AS cost FROM ways JOIN most USING (record_index, method) WHERE n = pairs GROUP BY ALL""")
def assignment_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and total cost of each sample's assignment, which an enumeration of all pairings confirms."""
    own = edges(spark, sf_dir)
    chosen = s.assigned(own, _KEYS).join(own, [*_KEYS, "gt_index", "pred_index"])
    return chosen.groupBy(*_KEYS).agg(F.count("*").alias("pairs"), F.round(F.sum("cost"), 6).alias("cost"))


@query(f"""{_WAYS} SELECT method, tp, n_pred - tp AS fp, n_gt - tp AS fn, round(2 * tp / (n_pred + n_gt), 9) AS f1 FROM (SELECT method, sum(pairs)::BIGINT AS tp FROM most GROUP BY method)
JOIN (SELECT method, count(*) AS n_gt FROM gtm GROUP BY method) USING (method) JOIN (SELECT method, count(*) AS n_pred FROM pred GROUP BY method) USING (method)""")
def hazard_f1_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pred = sides(spark, sf_dir)
    pairs = s.assigned(s.candidate_edges(gt, pred, _KEYS), _KEYS)
    count = lambda frame, name: frame.groupBy("method").agg(F.count("*").alias(name))
    c = count(pairs, "tp").join(count(gt, "n_gt"), "method").join(count(pred, "n_pred"), "method")
    c = c.select("method", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"))
    return c.withColumn("f1", F.round(f1(F.col("tp"), F.col("fp"), F.col("fn")), 9))


@query(f"""WITH {EVENTS_SQL}, c AS (SELECT method, CASE WHEN a = ['SAFE'] THEN [] ELSE list_distinct(a) END AS g, CASE WHEN p = ['SAFE'] THEN [] ELSE list_distinct(p) END AS q FROM ev),
n AS (SELECT method, sum(len(list_intersect(g, q)))::BIGINT AS tp, sum(len(q) - len(list_intersect(g, q)))::BIGINT AS fp, sum(len(g) - len(list_intersect(g, q)))::BIGINT AS fn FROM c GROUP BY method)
SELECT *, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM n""")
def category_f1_given_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.plans.confusion import events

    safe = F.array(F.lit("SAFE"))
    own = events(spark, sf_dir).select("method", F.when(F.col("a") != safe, F.col("a")).alias("g"), F.when(F.col("p") != safe, F.col("p")).alias("q"))
    return k.pair_category_counts(own).withColumn("f1", F.round("f1", 9))


_COHORT = """ref AS (SELECT o_orderkey AS id, o_orderkey % 7 <> 0 AS eligible FROM orders), ma AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'ok' END AS status, o_orderkey % 11 = 0 AS uncertain FROM orders),
mb AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'ok' END AS status, o_orderkey % 13 = 0 AS uncertain FROM orders WHERE o_orderkey % 17 <> 0),
r AS (SELECT id, list_filter([CASE WHEN NOT eligible THEN 'reference_not_eligible' END, CASE WHEN ma.status <> 'ok' THEN 'a_not_ok' END, CASE WHEN ma.uncertain THEN 'a_uncertain' END, CASE WHEN coalesce(mb.status, 'missing') <> 'ok' THEN 'b_not_ok' END, CASE WHEN mb.uncertain THEN 'b_uncertain' END], lambda x: x IS NOT NULL) AS reasons FROM ref JOIN ma USING (id) LEFT JOIN mb USING (id))"""


def _cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    i = F.col("id")
    first = orders.select("id", F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ok").alias("status"), (i % 11 == 0).alias("uncertain"))
    second = orders.where(i % 17 != 0).select("id", F.when(i % 5 == 0, "failed").otherwise("ok").alias("status"), (i % 13 == 0).alias("uncertain"))
    return k.cohort(orders.select("id", (i % 7 != 0).alias("eligible")), {"a": first, "b": second}, ["id"])


@query(f"WITH {_COHORT} SELECT id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS included FROM r")
def cohort_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cohort(spark, sf_dir).select("id", F.array_join("reasons", ",").alias("reasons"), "included")


@query(f"WITH {_COHORT}, x AS (SELECT unnest(CASE WHEN len(reasons) = 0 THEN ['included'] ELSE reasons END) AS reason FROM r) SELECT reason, count(*) AS n FROM x GROUP BY 1")
def cohort_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _cohort(spark, sf_dir).select(F.explode(F.when(F.col("included"), F.array(F.lit("included"))).otherwise(F.col("reasons"))).alias("reason"))
    return own.groupBy("reason").agg(F.count("*").alias("n"))


_FIELD = f"""{a.matches_sql('strict')}, {a.RECORDS_SQL},
fe AS (SELECT r.method, CASE WHEN r.detected THEN 'matched' ELSE 'unmatched_gt' END AS kind, role, r.categories[1] AS gc, p.categories[1] AS pc, r.distance_steps AS gd, p.distance_steps AS pd FROM results r JOIN records USING (record_index)
 LEFT JOIN pred p ON p.record_index = r.record_index AND p.method = r.method AND p.object_index = r.pred_index
 UNION ALL SELECT method, 'unmatched_pred', NULL, NULL, p.categories[1], NULL, distance_steps FROM pred p WHERE NOT EXISTS (FROM pairs q WHERE q.record_index = p.record_index AND q.method = p.method AND q.pred_index = p.object_index))"""


def field_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pred = sides(spark, sf_dir)
    roles = a.records(spark, sf_dir).select("record_index", "role", F.lit(True).alias("known"))
    found = m.matched_sides(gt, pred, ["categories", "distance_steps"]).join(roles, "record_index", "left")
    surplus = F.col("kind") == "unmatched_pred"
    part = lambda x: [F.col(f"{x}.categories")[0].alias(f"{x}c"), F.col(f"{x}.distance_steps").alias(f"{x}d")]
    return found.where(surplus | F.col("known")).select("method", "kind", F.when(~surplus, F.col("role")).alias("role"), *part("g"), *part("p"))


@query(f"WITH {_FIELD}, c AS (SELECT method, count_if(kind = 'matched') AS tp, count_if(kind = 'unmatched_pred') AS fp, count_if(kind = 'unmatched_gt' AND role = 'required') AS fn FROM fe GROUP BY method) SELECT *, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c")
def role_aware_hazard_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.hazard_counts(field_events(spark, sf_dir), ["method"]).withColumn("f1", F.round("f1", 9))


def _field_sql(gt: str, pred: str) -> str:
    return f"""WITH {_FIELD}, own AS (SELECT method, kind, role, {gt} AS g, {pred} AS p FROM fe),
l AS (SELECT method, g AS label, 1 AS tp, 0 AS fp, 0 AS fn FROM own WHERE kind = 'matched' AND g = p UNION ALL SELECT method, g, 0, 0, 1 FROM own WHERE g IS NOT NULL AND role = 'required' AND (kind = 'unmatched_gt' OR (kind = 'matched' AND g IS DISTINCT FROM p))
 UNION ALL SELECT method, p, 0, 1, 0 FROM own WHERE p IS NOT NULL AND (kind = 'unmatched_pred' OR (kind = 'matched' AND g IS NOT NULL AND g <> p))),
c AS (SELECT method, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM l GROUP BY ALL), s AS (SELECT *, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c)
SELECT method, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(coalesce(avg(f1) FILTER (tp + fn > 0), 0), 9) AS macro_f1, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS micro_f1 FROM s GROUP BY method"""


def _field(spark: SparkSession, sf_dir: str, gt: F.Column, pred: F.Column) -> DataFrame:
    found = k.field_scores(field_events(spark, sf_dir), ["method"], gt, pred)
    return found.withColumn("macro_f1", F.round("macro_f1", 9)).withColumn("micro_f1", F.round("micro_f1", 9))


@query(_field_sql("gc", "pc"))
def field_f1_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _field(spark, sf_dir, F.col("gc"), F.col("pc"))


_bin = lambda c, near, far: f"CASE WHEN {c} {near} THEN 'near' WHEN {c} <= {far} THEN 'medium' WHEN {c} > {far} THEN 'far' END"


@query(_field_sql(_bin("gd", "< 10", 15), _bin("pd", "< 10", 15)))
def field_f1_prompt_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _field(spark, sf_dir, prompt_distance_bin(F.col("gd")), prompt_distance_bin(F.col("pd")))


@query(_field_sql(_bin("gd", "<= 5", 8), _bin("pd", "<= 5", 8)))
def field_f1_post_hoc_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _field(spark, sf_dir, post_hoc_distance_bin(F.col("gd")), post_hoc_distance_bin(F.col("pd")))


_ERRORS = f"""{a.RECORDS_SQL}, d AS (SELECT image, role, CASE l_returnflag WHEN 'A' THEN 'GROUND' WHEN 'N' THEN 'PIT' ELSE 'OVERHEAD' END AS category, l_linenumber % 5 = 0 AS failed,
 CASE WHEN l_linenumber % 5 <> 0 THEN (l_quantity::INT % 13) - (l_suppkey % 12) END AS e FROM lineitem JOIN records ON l_orderkey = record_index),
x AS (SELECT 'all' AS slice, 'all' AS value, * FROM d UNION ALL SELECT 'role', role, * FROM d UNION ALL SELECT 'category', category, * FROM d)"""


@query(f"""WITH {_ERRORS} SELECT slice, value, count(*) AS eligible, count(e) AS successful, count_if(failed) AS failed, count(DISTINCT image) AS images, round(avg(abs(e)), 9) AS mae, round(sqrt(avg(e * e)), 9) AS rmse, round(avg(e), 9) AS bias, median(abs(e)) AS median_ae, round(avg((abs(e) <= 1)::INT), 9) AS within_1 FROM x GROUP BY slice, value""")
def distance_error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = a.table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    rows = line.join(a.records(spark, sf_dir), F.col("l_orderkey") == F.col("record_index")).select("image", "role", F.when(flag == "A", "GROUND").when(flag == "N", "PIT").otherwise("OVERHEAD").alias("category"), F.when(F.col("l_linenumber") % 5 == 0, "failed").otherwise("ok").alias("status"), (F.col("l_suppkey") % 12).cast("int").alias("reference_steps"), (F.col("l_quantity").cast("int") % 13).alias("predicted_steps"))
    found = k.distance_errors(rows)
    for c in ("mae", "rmse", "bias", "within_1"):
        found = found.withColumn(c, F.round(c, 9))
    return found


_JUDGED = "j AS (SELECT l_suppkey % 5 AS model, CASE WHEN l_linenumber = 7 THEN 'nan'::DOUBLE ELSE l_quantity::INT % 11 END AS hazard, (l_partkey % 11)::DOUBLE AS guide, (l_orderkey % 11)::DOUBLE AS format FROM lineitem), s AS (SELECT model, round(0.5 * hazard + 0.4 * guide + 0.1 * format, 6) AS o FROM j)"


@query(f"""WITH {_JUDGED} SELECT model, count(*) AS n, round(avg(o) FILTER (NOT isnan(o)), 6) AS mean, round(stddev_samp(o) FILTER (NOT isnan(o)), 6) AS std, round(median(o) FILTER (NOT isnan(o)), 6) AS median,
round(100 * avg((NOT isnan(o) AND o >= 8)::INT), 6) AS pct_8, round(100 * avg((NOT isnan(o) AND o >= 6)::INT), 6) AS pct_6 FROM s GROUP BY model""")
def judge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("model"), F.when(F.col("l_linenumber") == 7, float("nan")).otherwise(F.col("l_quantity").cast("int") % 11).alias("hazard"), (F.col("l_partkey") % 11).cast("double").alias("guide"), (F.col("l_orderkey") % 11).cast("double").alias("format"))
    found = k.judge_summary(rows, ["model"])
    return found.select("model", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median", "pct_8", "pct_6")])


@query("""WITH c AS (SELECT d.d AS dataset, m.m AS model FROM range(3) d(d), range(4) m(m)), s AS (SELECT l_suppkey % 3 AS dataset, l_suppkey % 4 AS model, l_quantity FROM lineitem)
SELECT dataset, model, count(l_quantity) AS n, coalesce(count_if(l_quantity > 45), 0) AS failed, round(avg(l_quantity) FILTER (l_quantity <= 45), 9) AS mean FROM c LEFT JOIN s USING (dataset, model) GROUP BY ALL""")
def judge_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = a.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 3).alias("dataset"), (F.col("l_suppkey") % 4).alias("model"), "l_quantity")
    conditions = spark.range(12).select((F.col("id") % 3).alias("dataset"), F.floor(F.col("id") / 3).alias("model"))  # twelve fixed conditions
    q = F.col("l_quantity")
    return conditions.join(line, ["dataset", "model"], "left").groupBy("dataset", "model").agg(F.count(q).alias("n"), F.count_if(q > 45).alias("failed"), F.round(F.avg(F.when(q <= 45, q)), 9).alias("mean"))


@query()
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("a"), (F.col("event_id") % 50).cast("double").alias("b"))
    return k.paired_bootstrap(rows, 200)


@query("""WITH w AS (SELECT user_id, CASE WHEN event_type = 'error' THEN '3' WHEN event_id % 2 = 0 THEN '1' ELSE '2' END AS v FROM events) SELECT user_id, count_if(v = '1') AS first, count_if(v = '2') AS second, count_if(v NOT IN ('1', '2')) AS invalid FROM w GROUP BY 1""")
def ablation_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_type") == "error", "3").when(F.col("event_id") % 2 == 0, "1").otherwise("2")
    return win_counts(a.table(spark, sf_dir, "events").select("user_id", v.alias("v")), ["user_id"], "v")
