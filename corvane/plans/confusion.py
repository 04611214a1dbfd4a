"""Queries on confusion matrices, presence and deduplicated images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import matching as m
from corvane.operators import metrics as k
from corvane.plans import adapters as a
from corvane.plans.recall import sides
from corvane.plans.registry import query


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pred = sides(spark, sf_dir)
    recs = m.with_methods(a.records(spark, sf_dir).select("record_index"), a.METHODS)
    return m.matched_events(gt, pred, recs)


EVENTS_SQL = f"""{a.matches_sql('strict')}, {a.RECORDS_SQL},
ev AS (SELECT r.record_index, r.method, r.categories AS a, coalesce(p.categories, ['SAFE']) AS p FROM results r LEFT JOIN pred p ON p.record_index = r.record_index AND p.method = r.method AND p.object_index = r.pred_index
 UNION ALL SELECT record_index, method, ['SAFE'], categories FROM pred p WHERE NOT EXISTS (FROM pairs q WHERE q.record_index = p.record_index AND q.method = p.method AND q.pred_index = p.object_index)
 UNION ALL SELECT record_index, method, ['SAFE'], ['SAFE'] FROM records, (VALUES ('ours'), ('fewshot')) v(method) WHERE NOT EXISTS (FROM gtm g WHERE g.record_index = records.record_index AND g.method = v.method) AND NOT EXISTS (FROM pred p WHERE p.record_index = records.record_index AND p.method = v.method)),
spread AS (SELECT method, unnest(a) AS actual, p, 1.0 / (len(a) * len(p)) AS w FROM ev), cells AS (SELECT method, actual, unnest(p) AS predicted, w FROM spread),
matrix AS (SELECT method, actual, predicted, sum(w) AS mass FROM cells GROUP BY ALL)"""


@query(f"WITH {EVENTS_SQL} SELECT method, actual, predicted, round(mass, 6) AS mass FROM matrix")
def confusion_fractional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.fractional_confusion(events(spark, sf_dir)).select("method", "actual", "predicted", F.round("mass", 6).alias("mass"))


_LABELS = "labels(label, place) AS (VALUES ('GROUND', 0), ('PIT', 1), ('OVERHEAD', 2), ('SAFE', 3))"


@query(f"""WITH {EVENTS_SQL}, {_LABELS}, whole AS (SELECT v.method, x.label AS actual, x.place AS "row", y.label AS predicted, y.place AS "column", coalesce(mass, 0) AS mass FROM (SELECT DISTINCT method FROM matrix) v, labels x, labels y LEFT JOIN matrix q ON q.method = v.method AND q.actual = x.label AND q.predicted = y.label)
SELECT method, actual, predicted, "row", "column", round(coalesce(mass * 100 / nullif(sum(mass) OVER (PARTITION BY method, actual), 0), 0), 6) AS percent FROM whole""")
def confusion_rownorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.row_normalised(k.fractional_confusion(events(spark, sf_dir)), "mass").select("method", "actual", "predicted", "row", "column", F.round("percent", 6).alias("percent"))


@query(f"""WITH {EVENTS_SQL}, n AS (SELECT method, count(*) AS events FROM ev GROUP BY method)
SELECT method, events, round(sum(mass), 4) AS mass, abs(sum(mass) - events) <= 1e-6 AS conserved, round(coalesce(sum(mass) FILTER (actual <> 'SAFE' AND actual <> predicted), 0), 4) AS off_diagonal,
round(coalesce(sum(mass) FILTER (actual <> 'SAFE' AND actual = predicted), 0) / sum(mass) FILTER (actual <> 'SAFE'), 9) AS diagonal_recall FROM matrix JOIN n USING (method) GROUP BY method, events""")
def confusion_mass_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir)
    found = k.mass_check(own, k.fractional_confusion(own))
    return found.select("method", "events", F.round("mass", 4).alias("mass"), "conserved", F.round("off_diagonal", 4).alias("off_diagonal"), F.round("diagonal_recall", 9).alias("diagonal_recall"))


@query(f"""WITH {EVENTS_SQL}, taken AS (SELECT method, unnest(a) AS actual, CASE WHEN a <> ['SAFE'] AND p <> ['SAFE'] THEN a ELSE p END AS p FROM ev), cells2 AS (SELECT method, actual, unnest(p) AS predicted FROM taken)
SELECT method, actual, predicted, count(*) AS n FROM cells2 GROUP BY ALL""")
def confusion_overwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.overwritten_confusion(events(spark, sf_dir))


@query(f"""WITH {a.OBJECTS_SQL}, g AS (SELECT record_index, method, label, count(*) AS a FROM (SELECT record_index, method, unnest(categories) AS label FROM gtm) GROUP BY ALL),
p AS (SELECT record_index, method, label, count(*) AS b FROM (SELECT record_index, method, unnest(categories) AS label FROM pred) GROUP BY ALL),
j AS (SELECT method, label, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM g FULL JOIN p USING (record_index, method, label)),
c AS (SELECT method, label AS actual, label AS predicted, least(a, b) AS n FROM j UNION ALL SELECT method, label, 'SAFE', greatest(a - b, 0) FROM j UNION ALL SELECT method, 'SAFE', label, greatest(b - a, 0) FROM j)
SELECT method, actual, predicted, sum(n)::BIGINT AS n FROM c GROUP BY ALL HAVING sum(n) > 0""")
def confusion_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pred = sides(spark, sf_dir)
    labels = lambda f: f.select("record_index", "method", F.explode("categories").alias("label"))
    return m.multiset_matches(labels(gt), labels(pred))


@query(f"""WITH {a.GT_SQL}, l AS (SELECT DISTINCT record_index AS image, unnest(categories) AS label FROM gt), s AS (SELECT label AS a, count(*) AS images FROM l GROUP BY 1)
SELECT x.label AS a, y.label AS b, count(*) AS n, round(count(*) / any_value(images), 9) AS share FROM l x JOIN l y USING (image) JOIN s ON s.a = x.label GROUP BY 1, 2""")
def category_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = a.gt_objects(spark, sf_dir).select(F.col("record_index").alias("image"), F.explode("categories").alias("label"))
    return k.cooccurrence(labels).select("a", "b", "n", F.round("share", 9).alias("share"))


@query(f"""WITH {a.OBJECTS_SQL}, {a.RECORDS_SQL}, g AS (SELECT DISTINCT record_index, method, unnest(categories) AS category FROM gtm), p AS (SELECT DISTINCT record_index, method, unnest(categories) AS category FROM pred),
f AS (SELECT v.method, c.category, g.category IS NOT NULL AS a, p.category IS NOT NULL AS b FROM records r, (VALUES ('ours'), ('fewshot')) v(method), (VALUES ('GROUND'), ('PIT'), ('OVERHEAD')) c(category)
 LEFT JOIN g ON g.record_index = r.record_index AND g.method = v.method AND g.category = c.category LEFT JOIN p ON p.record_index = r.record_index AND p.method = v.method AND p.category = c.category),
c AS (SELECT method, category, count_if(a AND b) AS tp, count_if(NOT a AND b) AS fp, count_if(a AND NOT b) AS fn, count_if(NOT a AND NOT b) AS tn FROM f GROUP BY ALL)
SELECT *, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""")
def category_presence_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pred = sides(spark, sf_dir)
    key = ["record_index", "method"]
    sets = lambda f, n: f.select(*key, F.explode("categories").alias("c")).groupBy(*key).agg(F.collect_set("c").alias(n))
    none = F.array().cast("array<string>")
    recs = m.with_methods(a.records(spark, sf_dir).select("record_index"), a.METHODS)
    own = recs.join(sets(gt, "g"), key, "left").join(sets(pred, "q"), key, "left").select("method", F.coalesce("g", none).alias("g"), F.coalesce("q", none).alias("q"))
    found = k.presence_scores(own)
    return found.select("method", "category", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


_SIZED = f"{a.GT_SQL}, {a.RECORDS_SQL}, sized AS (SELECT record_index, image, coalesce(n, 0) AS n FROM records LEFT JOIN (SELECT record_index, count(*) AS n FROM gt GROUP BY 1) USING (record_index))"


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = a.gt_objects(spark, sf_dir).groupBy("record_index").agg(F.count("*").alias("n"))
    return a.records(spark, sf_dir).select("record_index", "image").join(n, "record_index", "left").na.fill(0, ["n"])


@query(f"WITH {_SIZED} SELECT image, record_index, n FROM sized QUALIFY row_number() OVER (PARTITION BY image ORDER BY n = 0, record_index) = 1")
def dedup_prefer_hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.first_by_priority(_sized(spark, sf_dir), ["image"], F.col("n") == 0, F.col("record_index")).select("image", "record_index", "n")


@query(f"""WITH {_SIZED}, g AS (SELECT image, count(*) AS c, count_if(n > 0) AS h, min_by(n, record_index) AS first_n FROM sized GROUP BY image)
SELECT sum(c)::BIGINT AS records, count(*) AS images, sum(c - 1)::BIGINT AS removed, count_if(c > 1) AS duplicate_groups, count_if(h > 0 AND h < c) AS mixed_groups, count_if(h > 0 AND first_n = 0) AS hazard_preferred FROM g""")
def dedup_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _sized(spark, sf_dir).groupBy("image").agg(F.count("*").alias("c"), F.count_if(F.col("n") > 0).alias("h"), F.min_by("n", "record_index").alias("first_n"))
    return groups.agg(F.sum("c").alias("records"), F.count("*").alias("images"), F.sum(F.col("c") - 1).alias("removed"), F.count_if(F.col("c") > 1).alias("duplicate_groups"), F.count_if((F.col("h") > 0) & (F.col("h") < F.col("c"))).alias("mixed_groups"), F.count_if((F.col("h") > 0) & (F.col("first_n") == 0)).alias("hazard_preferred"))


_SAFE = "safe AS (SELECT doc_id, quality = 1 AS r, toxic = 0 AS p FROM labels)"


@query(f"""WITH {_SAFE}, c AS (SELECT count_if(r AND p) AS safe_safe, count_if(r AND NOT p) AS safe_danger, count_if(NOT r AND p) AS danger_safe, count_if(NOT r AND NOT p) AS danger_danger FROM safe)
SELECT *, round(safe_safe / (safe_safe + danger_safe), 9) AS safe_precision, round(danger_danger / (danger_danger + danger_safe), 9) AS danger_recall, round((safe_safe + danger_danger) / (safe_safe + safe_danger + danger_safe + danger_danger), 9) AS accuracy FROM c""")
def safe_danger_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = k.safe_danger(a.safe_labels(spark, sf_dir))
    return found.select("safe_safe", "safe_danger", "danger_safe", "danger_danger", *[F.round(c, 9).alias(c) for c in ("safe_precision", "danger_recall", "accuracy")])


_SCORED = f"{_SAFE}, scored AS (SELECT r, p, doc_id % 7 <> 0 AS same_name, n_chars / 1000 AS score FROM safe JOIN documents USING (doc_id))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = a.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("score"))
    return a.safe_labels(spark, sf_dir).join(docs, "doc_id").withColumn("same_name", F.col("doc_id") % 7 != 0)


@query(f"""WITH {_SCORED} SELECT count(*) AS pairs, count_if(NOT same_name) AS name_mismatches, count_if(r) AS ref_safe_count, count_if(p) AS pred_safe_count, round(avg((r = p)::INT), 9) AS safe_accuracy, count_if(NOT r AND NOT p) AS hazard_pairs, round(avg(score) FILTER (NOT r AND NOT p), 6) AS mean_score FROM scored""")
def safe_accuracy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = k.safe_summary(_scored(spark, sf_dir))
    return found.withColumn("safe_accuracy", F.round("safe_accuracy", 9)).withColumn("mean_score", F.round("mean_score", 6))


@query(f"WITH {_SCORED.replace('SELECT r, p', 'SELECT doc_id, r, p')} SELECT doc_id FROM scored WHERE same_name AND NOT r AND NOT p")
def danger_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where(F.col("same_name") & ~F.col("ref_safe") & ~F.col("pred_safe")).select("doc_id")


@query(f"""WITH {a.matches_sql('loose')}, loose AS (FROM pairs WHERE source = 'synonym'), {a.RECORDS_SQL}
SELECT l.record_index, l.method, l.gt_index, l.pred_index FROM loose l JOIN gtm g ON g.record_index = l.record_index AND g.method = l.method AND g.object_index = l.gt_index
WHERE {a.cautious_sql('g.name')} NOT IN ('car', 'vehicle', 'bike', 'bicycle')""")
def added_loose_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pred = sides(spark, sf_dir)
    key = ["record_index", "method", "gt_index", "pred_index"]
    return m.rule_matches(gt, pred, "loose").select(*key).join(m.rule_matches(gt, pred, "strict").select(*key), key, "left_anti")


@query(f"""WITH {a.RECORDS_SQL}, single AS (SELECT image, min(record_index) AS record_index FROM records GROUP BY image), r AS (SELECT image, record_index, row_number() OVER (PARTITION BY image ORDER BY record_index DESC) AS n FROM records)
SELECT image, record_index FROM r WHERE n = 1""")
def last_record_of_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("image").orderBy(F.desc("record_index"))
    return a.records(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n = 1").select("image", "record_index")
