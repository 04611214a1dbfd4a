"""Queries on model answers, annotation stores and tables for display."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as t
from corvane.operators import annotations as work
from corvane.operators import matching as m
from corvane.operators.validation import quality_decision
from corvane.plans import adapters as a
from corvane.plans.registry import query
from corvane.sources import records as r


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '[ALTER_EXTRACTION_FAILED]' ELSE event_type || ' ahead' END AS answer FROM events")
def answer_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("event_id") % 5 == 0, F.lit("no JSON { here")).otherwise(F.concat(F.lit('Here:\n{"alter": "'), "event_type", F.lit(' ahead",\n "n": 1}\nend')))
    return a.table(spark, sf_dir, "events").select("event_id", t.answer_of(body).alias("answer"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN NULL ELSE 'plain' END AS content FROM events""")
def response_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, e = F.col("event_id") % 4, F.col("event_type")
    body = F.when(k == 0, F.concat(F.lit('{"choices": [{"message": {"content": "'), e, F.lit('"}}]}'))).when(k == 1, F.concat(F.lit('{"output_text": 7, "response": "'), e, F.lit('"}'))).when(k == 2, F.lit('{"other": "x"}')).otherwise(F.lit('{"text": "plain"}'))
    return a.table(spark, sf_dir, "events").select("event_id", t.response_text(body).alias("content"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'The path is clear. Go ahead.' WHEN 1 THEN event_type || ' near keep left' ELSE event_type END AS scored FROM events")
def scoring_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, e = F.col("event_id") % 3, F.col("event_type")
    raw = F.when(k == 0, F.lit(" <SAFE />\n")).when(k == 1, F.concat(F.lit("<ALERT> "), e, F.lit("\n near</ALERT><GUIDE>keep  left</GUIDE>"))).otherwise(F.concat(F.lit("  "), e, F.lit(" ")))
    return a.table(spark, sf_dir, "events").select("event_id", t.scoring_text(raw).alias("scored"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1 END AS objects, CASE WHEN event_id % 4 > 1 THEN 'PIT' END AS category FROM events")
def category_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    body = F.when(k == 0, F.lit("none")).when(k == 1, F.lit('{"objects": [{"name": "x", "categories": ["other"]}]}')).otherwise(F.lit('so: {"objects": [{"name": " hole ", "categories": [" pit", "PIT", "sky"]}, {"name": "", "categories": ["PIT"]}]}'))
    own = a.table(spark, sf_dir, "events").select("event_id", t.category_objects(body).alias("o"))
    return own.select("event_id", F.when(F.col("o").isNotNull(), F.size("o")).alias("objects"), F.get("o", F.lit(0))["categories"][0].alias("category"))


@query("SELECT event_id, event_type || ' ' || user_id AS body FROM events")
def unwrapped_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat_ws(" ", "event_type", F.col("user_id").cast("string"))
    raw = F.concat(F.lit("<think>well\nso</think>\n"), F.lit("```json\n"), own, F.lit("\n```"))
    return a.table(spark, sf_dir, "events").select("event_id", t.unfenced(t.without_thinking(raw)).alias("body"))


@query("SELECT event_id, 'call token=[REDACTED] with Bearer [REDACTED] and [DATA]' AS body FROM events")
def redacted_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("call token="), F.md5(F.col("event_id").cast("string").cast("binary")), F.lit(" with Bearer abc."), F.col("user_id").cast("string"), F.lit(" and data:image/png;base64,"), F.base64(F.col("event_type").cast("binary")))
    return a.table(spark, sf_dir, "events").select("event_id", t.redacted(raw).alias("body"))


@query("""WITH s AS (SELECT user_id, event_id, event_type IN ('error', 'view') AS finished FROM events), n AS (SELECT user_id, event_id, min(CASE WHEN NOT finished THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later, min(CASE WHEN NOT finished THEN event_id END) OVER (PARTITION BY user_id) AS first FROM s)
SELECT user_id, event_id, coalesce(later, first) AS next_open FROM n""")
def next_unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = work.next_open(a.table(spark, sf_dir, "events"), "user_id", "event_id", ~F.col("event_type").isin("error", "view"))
    return found.select("user_id", "event_id", "next_open")


@query("SELECT c_mktsegment AS dataset, count(*) AS n, count_if(c_acctbal > 5000) AS completed, count_if(c_acctbal BETWEEN 0 AND 5000) AS draft, count_if(c_acctbal < 0) AS unstarted, count_if(c_acctbal > 5000 AND c_custkey % 3 <> 0) AS role_pending FROM customer GROUP BY 1")
def annotation_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("c_acctbal")
    status = F.when(b > 5000, "completed").when(b >= 0, "draft")
    return work.progress(a.table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "dataset"), ["dataset"], status, F.col("c_custkey") % 3 == 0)


@query("SELECT lower(p_name) AS folded, min(p_name) AS name, count(*) AS n FROM part GROUP BY 1")
def name_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.folded_names(a.table(spark, sf_dir, "part"), "p_name").orderBy("folded")


@query("""WITH o AS (SELECT l_suppkey % 3 AS method, CASE WHEN l_linenumber % 4 = 0 THEN 'exact' WHEN l_linenumber % 4 = 1 THEN 'adjacent' WHEN l_linenumber % 4 = 2 THEN 'mirror' ELSE 'mismatch' END AS outcome FROM lineitem)
SELECT method, count(*) AS n, round(count_if(outcome = 'exact') / count(*), 9) AS exact, round(count_if(outcome IN ('exact', 'adjacent')) / count(*), 9) AS adjacent FROM o GROUP BY method""")
def direction_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber") % 4
    own = a.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 3).alias("method"), F.when(k == 0, "exact").when(k == 1, "adjacent").when(k == 2, "mirror").otherwise("mismatch").alias("outcome"))
    share = lambda *names: F.round(F.try_divide(F.count_if(F.col("outcome").isin(*names)), F.count("*")), 9)
    return own.groupBy("method").agg(F.count("*").alias("n"), share("exact").alias("exact"), share("exact", "adjacent").alias("adjacent"))


@query("SELECT l_shipmode AS method, GROUND, PIT, OVERHEAD FROM (SELECT l_suppkey % 4 AS l_shipmode, count_if(l_returnflag = 'A') AS GROUND, count_if(l_returnflag = 'N') AS PIT, count_if(l_returnflag = 'R') AS OVERHEAD FROM lineitem GROUP BY 1)")
def matrix_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    cells = a.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).alias("method"), F.when(flag == "A", "GROUND").when(flag == "N", "PIT").otherwise("OVERHEAD").alias("label"), F.lit(1).alias("n"))
    return r.matrix_table(cells, "method", "label", "n", t.CATEGORIES)


@query("""WITH w AS (SELECT p_partkey, [p_name || '.png', p_type || '.png', p_brand || '.png'] AS keys FROM part), c AS (SELECT DISTINCT p_name || '.png' AS k FROM part WHERE p_size > 45 UNION SELECT DISTINCT p_brand || '.png' FROM part),
x AS (SELECT p_partkey, unnest(keys) AS k, unnest(range(3)) AS priority FROM w) SELECT p_partkey, min_by(k, priority) AS candidate, min(priority)::INT AS priority FROM x SEMI JOIN c USING (k) GROUP BY 1""")
def image_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = a.table(spark, sf_dir, "part")
    png = lambda c: F.concat(F.col(c), F.lit(".png"))
    items = p.select("p_partkey", png("p_name").alias("k0"), png("p_type").alias("k1"), png("p_brand").alias("k2"))
    there = p.where("p_size > 45").select(png("p_name").alias("candidate")).union(p.select(png("p_brand").alias("candidate")))
    return r.paired_by_priority(items, there, "p_partkey", ["k0", "k1", "k2"])


@query("""SELECT p_partkey, stored <> now AS stale FROM (SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN 'passed' ELSE CASE WHEN (p_size % 30) / 500 < 0.02 THEN 'rejected' ELSE 'passed' END END AS stored, CASE WHEN (p_size % 30) / 500 < 0.02 THEN 'rejected' ELSE 'passed' END AS now FROM part)""")
def cached_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sky = F.col("p_size") % 30 / 500
    now = quality_decision(F.lit(0.0), F.lit(0.0), F.lit(1.0), sky, least_sky=0.02)["status"]
    return a.table(spark, sf_dir, "part").select("p_partkey", (F.when(F.col("p_partkey") % 8 == 0, "passed").otherwise(now) != now).alias("stale"))


@query("SELECT (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation)) = 0 AND (SELECT count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer)) = 0 AS same")
def key_sets_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.same_keys(a.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), a.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), ["k"])


@query("SELECT s_suppkey AS sample, i AS \"index\", CASE WHEN i % 2 = 0 THEN 'GROUND' ELSE 'PIT' END AS category, s_suppkey % 10 <> 0 AS valid FROM supplier, range(3) t(i)")
def manual_category_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    mark = F.when(F.col("s_suppkey") % 10 == 0, "0").otherwise("")
    item = lambda i, c: F.concat(F.lit('"'), mark, F.lit(f'{i}": "{c}"'))
    body = F.concat(F.lit('{"'), k, F.lit('": {'), F.concat_ws(", ", item(0, "GROUND"), item(1, "PIT"), item(2, "GROUND")), F.lit("}}"))
    own = r.manual_categories(a.table(spark, sf_dir, "supplier").select(k.alias("source"), body.alias("text")))
    return own.select(F.col("sample").cast("bigint").alias("sample"), F.col("index").cast("bigint").alias("index"), "category", "valid")
