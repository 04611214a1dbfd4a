"""Queries on record validators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.measures import MIRRORED
from corvane.operators import validation as v
from corvane.plans import adapters as a
from corvane.plans.registry import query


@query(f"""WITH {a.LINES_SQL}, o AS (SELECT record_index, l_linenumber, l_partkey, CASE WHEN l_partkey % 19 = 0 THEN ' ' ELSE name END AS name, CASE WHEN l_partkey % 23 = 0 THEN ['GROUND', 'GROUND'] ELSE categories END AS categories, CASE WHEN l_partkey % 29 = 0 THEN -1 ELSE distance_steps END AS d, distance_raw FROM lines)
SELECT record_index, l_linenumber, l_partkey, list_filter([CASE WHEN trim(name) = '' THEN 'name' END, CASE WHEN len(list_distinct(categories)) <> len(categories) THEN 'categories' END, CASE WHEN d < 0 THEN 'distance' END], lambda x: x IS NOT NULL) AS violations FROM o""")
def object_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    rows = a._lines(spark, sf_dir).withColumn("name", F.when(k % 19 == 0, " ").otherwise(F.col("name"))).withColumn("categories", F.when(k % 23 == 0, F.array(F.lit("GROUND"), F.lit("GROUND"))).otherwise(F.col("categories"))).withColumn("distance_steps", F.when(k % 29 == 0, -1).otherwise(F.col("distance_steps")))
    return v.object_violations(rows).select("record_index", "l_linenumber", "l_partkey", "violations")


_STATES = "CASE doc_id % 5 WHEN 0 THEN 'hazard_described' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'explicitly_safe' WHEN 3 THEN 'no_extractable_hazard' ELSE 'other' END"


@query(f"""WITH e AS (SELECT doc_id, text, {_STATES} AS state, doc_id % 5 = 1 OR doc_id % 35 = 0 AS uncertain, CASE WHEN doc_id % 3 = 0 THEN [] ELSE [string_split(text, ' ')[1], CASE WHEN doc_id % 7 = 0 THEN 'not in the text ~' ELSE string_split(text, ' ')[2] END] END AS ev FROM documents WHERE text IS NOT NULL)
SELECT doc_id, list_filter([CASE WHEN state = 'other' THEN 'state' END, CASE WHEN (state = 'ambiguous') <> uncertain THEN 'ambiguity' END, CASE WHEN len(list_filter(ev, lambda x: x IS NULL OR trim(x) = '' OR NOT contains(text, x))) > 0 THEN 'evidence' END,
 CASE WHEN (len(ev) > 0 AND state IN ('explicitly_safe', 'no_extractable_hazard')) OR (len(ev) = 0 AND state = 'hazard_described') THEN 'objects_of_state' END], lambda x: x IS NOT NULL) AS violations, len(ev)::INT AS objects FROM e""")
def extraction_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    state = F.when(k % 5 == 0, "hazard_described").when(k % 5 == 1, "ambiguous").when(k % 5 == 2, "explicitly_safe").when(k % 5 == 3, "no_extractable_hazard").otherwise("other")
    parts = F.split("text", " ")
    thing = lambda name, e: F.struct(F.lit(name).alias("name"), e.alias("evidence"), F.array(F.lit("GROUND")).alias("categories"), F.lit("resolved").alias("category_status"))
    none = F.array().cast("array<struct<name:string,evidence:string,categories:array<string>,category_status:string>>")
    objects = F.when(k % 3 == 0, none).otherwise(F.array(thing("a", F.get(parts, F.lit(0))), thing("b", F.when(k % 7 == 0, "not in the text ~").otherwise(F.get(parts, F.lit(1))))))
    rows = a.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", state.alias("state"), ((k % 5 == 1) | (k % 35 == 0)).alias("uncertain"), objects.alias("objects"))
    return v.extraction_violations(rows).select("doc_id", "violations", F.size("object_ids").alias("objects"))


@query("""WITH p AS (SELECT o_orderkey, [{'g': o_orderkey % 4, 'p': o_orderkey % 3}, {'g': (o_orderkey + 1) % 5, 'p': (o_orderkey * 2) % 3}] AS pairs FROM orders)
SELECT o_orderkey, list_filter([CASE WHEN len(list_filter(pairs, lambda x: x.g >= 4 OR x.p >= 3)) > 0 THEN 'range' END, CASE WHEN pairs[1].g = pairs[2].g THEN 'gt_once' END, CASE WHEN pairs[1].p = pairs[2].p THEN 'pred_once' END], lambda x: x IS NOT NULL) AS violations FROM p""")
def pair_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pair = lambda g, p: F.struct(g.alias("gt_index"), p.alias("pred_index"))
    rows = a.table(spark, sf_dir, "orders").select("o_orderkey", F.array(pair(k % 4, k % 3), pair((k + 1) % 5, (k * 2) % 3)).alias("pairs"), F.lit(4).alias("n_gt"), F.lit(3).alias("n_pred"))
    return v.pair_violations(rows).select("o_orderkey", "violations")


_turn = " ".join(f"WHEN '{x}' THEN '{y}'" for x, y in MIRRORED.items())
_directions = "[" + ", ".join(f"'{d}'" for d in MIRRORED) + "]"


@query(f"""WITH h AS (SELECT s_suppkey, ({_directions})[(s_suppkey % 7 + 1)::INT] AS direction, (s_suppkey % 8) / 10 AS x, CASE s_suppkey % 3 WHEN 0 THEN 'required' ELSE 'optional' END AS role FROM supplier)
SELECT 'im' || s_suppkey || '_m' AS image, s_suppkey % 4 <> 0 AS mirrored, CASE WHEN s_suppkey % 4 <> 0 THEN [role] END AS roles FROM h""")
def mirror_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    names = F.array(*map(F.lit, MIRRORED))
    turn = F.create_map(*[F.lit(x) for pair in MIRRORED.items() for x in pair])
    own = a.table(spark, sf_dir, "supplier").select(k, F.element_at(names, (k % 7 + 1).cast("int")).alias("direction"), (k % 8 / 10).alias("x"), F.when(k % 3 == 0, "required").otherwise("optional").alias("role"))
    hazard = lambda d, x: F.array(F.struct(d.alias("direction"), x.alias("x"), F.lit(0.1).alias("y"), F.lit(0.2).alias("w"), F.col("role")))
    plain = own.select(F.concat(F.lit("im"), k.cast("string")).alias("image"), hazard(F.col("direction"), F.col("x")).alias("hazards"))
    turned = own.select(F.concat(F.lit("im"), k.cast("string"), F.lit("_m")).alias("image"), hazard(turn[F.col("direction")], F.when(k % 4 == 0, F.col("x")).otherwise(1 - F.col("x") - 0.2) + F.when((k % 4 == 0) & (F.abs(1 - 2 * F.col("x") - 0.2) <= 1e-6), 0.05).otherwise(0.0)).alias("hazards"))
    return v.mirror_roles(plain.unionByName(turned))


@query("""SELECT s_suppkey, list_filter([CASE WHEN s_suppkey % 6 = 0 THEN 'hazards' END, CASE WHEN s_suppkey % 6 <> 0 AND (s_suppkey % 10) / 10 + 0.3 > 1.000001 THEN 'boxes' END, CASE WHEN s_suppkey % 6 <> 0 AND s_suppkey % 9 = 0 THEN 'names' END, CASE WHEN s_suppkey % 6 <> 0 AND s_suppkey % 11 = 0 THEN 'distance' END], lambda x: x IS NOT NULL) AS violations,
CASE WHEN s_suppkey % 6 = 0 OR (s_suppkey % 10) / 10 + 0.3 > 1.000001 OR s_suppkey % 9 = 0 OR s_suppkey % 11 = 0 THEN 'draft' ELSE 'completed' END AS status_after FROM supplier""")
def annotation_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    one = F.struct(F.lit("h1").alias("id"), F.when(k % 9 == 0, "Pfütze").otherwise("low fence").alias("name"), (k % 11).alias("distance_steps"), F.lit("ahead").alias("direction"), (k % 10 / 10).alias("x"), F.lit(0.1).alias("y"), F.lit(0.3).alias("w"), F.lit(0.2).alias("h"))
    none = F.array().cast("array<struct<id:string,name:string,distance_steps:bigint,direction:string,x:double,y:double,w:double,h:double>>")
    rows = a.table(spark, sf_dir, "supplier").select(k, F.lit("completed").alias("status"), F.when(k % 6 == 0, none).otherwise(F.array(one)).alias("hazards"))
    return v.annotation_violations(rows).select("s_suppkey", "violations", "status_after")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN true ELSE o_orderstatus = 'F' AND o_orderkey % 5 <> 0 END AS hazard_eligible, o_orderstatus = 'F' AND o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AS category_eligible FROM orders""")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    one = F.struct(F.when(k % 3 == 0, "missing").otherwise("resolved").alias("category_status"), F.array(F.lit("PIT")).alias("categories"))
    rows = a.table(spark, sf_dir, "orders").select(k, F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status"), (k % 5 == 0).alias("uncertain"), F.array(one).alias("objects"), F.when(k % 17 == 0, True).alias("hazard_flag"), F.lit(None).cast("boolean").alias("category_flag"))
    return v.eligible(rows).select("o_orderkey", "hazard_eligible", "category_eligible")


@query("""SELECT CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_mktsegment = 'BUILDING' THEN 'segment' WHEN c_custkey % 10 = 0 THEN 'held_out' ELSE 'accepted' END AS reason, count(*) AS n FROM customer GROUP BY 1""")
def reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = v.first_reason(("negative", F.col("c_acctbal") < 0), ("segment", F.col("c_mktsegment") == "BUILDING"), ("held_out", F.col("c_custkey") % 10 == 0))
    return a.table(spark, sf_dir, "customer").select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT doc_id AS position, source AS image, contains(text, 'the') AS has_phrase, lang AS answer FROM documents), s AS (SELECT doc_id AS position, CASE WHEN doc_id % 31 = 0 THEN 'x' ELSE source END AS image, contains(text, 'the') AS has_phrase, CASE WHEN doc_id % 41 = 0 THEN 'x' ELSE lang END AS answer FROM documents WHERE doc_id % 53 <> 0)
SELECT count_if(f.image IS NULL OR s.image IS NULL) AS one_sided, count_if(f.image <> s.image) AS other_images, count_if(f.has_phrase OR s.has_phrase) AS leaked, count_if(f.answer <> s.answer) AS other_answers FROM f FULL JOIN s USING (position)""")
def variant_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    docs = a.table(spark, sf_dir, "documents")
    first = docs.select(k.alias("position"), F.col("source").alias("image"), "text", F.col("lang").alias("answer"))
    second = docs.where(k % 53 != 0).select(k.alias("position"), F.when(k % 31 == 0, "x").otherwise(F.col("source")).alias("image"), "text", F.when(k % 41 == 0, "x").otherwise(F.col("lang")).alias("answer"))
    return v.variant_parity(first, second, "the")
