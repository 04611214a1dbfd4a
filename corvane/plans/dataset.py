"""Queries on samples, audits, overlaps and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import dataset as d
from corvane.operators import matching as m
from corvane.plans import adapters as a
from corvane.plans.registry import query


@query("SELECT doc_id FROM documents ORDER BY md5('s1' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.seeded_sample(a.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, "s1")


@query("SELECT count(*) AS n, count(DISTINCT text) AS \"distinct\", count(text) - count(DISTINCT text) AS surplus, count_if(text IS NULL OR trim(text) = '') AS empty, min(text) AS first, max(text) AS last FROM documents")
def data_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.audit(a.table(spark, sf_dir, "documents").select("text"), "text", "text")


@query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1")
def segment_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.distribution(a.table(spark, sf_dir, "customer"), "c_mktsegment")


@query("SELECT md5(text) AS text FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 1)")
def train_test_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = a.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"))
    return d.overlap(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "text")


@query("SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = a.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey")
    return d.only_in(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), "custkey")


@query("""SELECT side, key FROM (SELECT 'missing' AS side, c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'unknown', k FROM (SELECT DISTINCT o_custkey AS k FROM orders) WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0) AND k IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 = 0))""")
def model_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = a.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    o = a.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    missing = m.key_differences(c, o, ["key"]).where("side = 'missing'")
    unknown = m.key_differences(c.where("key % 9 <> 0"), o.join(c.where("key % 9 = 0"), "key", "left_semi"), ["key"]).where("side = 'unknown'")
    return missing.unionByName(unknown)


@query("""WITH r AS (SELECT o_custkey AS sample_id, o_orderpriority AS raw_text, o_orderkey AS source_index FROM orders), t AS (SELECT c_custkey AS sample_id FROM customer)
SELECT t.sample_id, min_by(raw_text, source_index) AS raw_text, count(source_index) AS n, CASE WHEN count(source_index) > 0 THEN count(DISTINCT raw_text) > 1 END AS conflict FROM t LEFT JOIN r USING (sample_id) GROUP BY 1""")
def target_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = a.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderpriority").alias("raw_text"), F.col("o_orderkey").alias("source_index"))
    t = a.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"))
    n = F.coalesce(F.size("source_indices"), F.lit(0)).cast("bigint")
    return m.selected_targets(t, r).select("sample_id", "raw_text", n.alias("n"), "conflict")


@query("SELECT o_orderkey AS record_index, o_orderstatus AS gt_status, CASE WHEN o_orderkey % 3 = 0 THEN 'O' ELSE o_orderstatus END AS ours_status, o_orderpriority AS few_status FROM orders")
def aligned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_index"), a.image_of(F.col("o_orderkey")).alias("image"), "o_orderstatus", "o_orderpriority")
    side = lambda status: o.select("record_index", "image", status.alias("status"))
    frames = {"gt": side(F.col("o_orderstatus")), "ours": side(F.when(F.col("record_index") % 3 == 0, "O").otherwise(F.col("o_orderstatus"))), "few": side(F.col("o_orderpriority"))}
    return m.aligned(frames, "record_index", "image").select("record_index", "gt_status", "ours_status", "few_status")


@query("SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'Other' ELSE 'classify' END AS part FROM part")
def non_risk_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.partitioned_by_list(a.table(spark, sf_dir, "part"), "p_type", ("ECONOMY", "STANDARD")).select("p_partkey", "part")


@query("SELECT o_orderkey, count(*) AS objects, count_if(l_returnflag <> 'A') AS counted, count_if(l_returnflag <> 'A') >= 3 AS rejected FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def object_count_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = a.table(spark, sf_dir, "lineitem").join(a.table(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    counted = F.count_if(F.col("l_returnflag") != "A")
    return line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("objects"), counted.alias("counted"), (counted >= 3).alias("rejected"))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier ORDER BY s_suppkey DESC LIMIT 5)")
def backup_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.surplus_victims(a.table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", 5)


@query("SELECT c_nationkey AS nation, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 3")
def first_per_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = a.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    return d.first_of_each(c, ["nation"], F.col("c_custkey"), 3)
