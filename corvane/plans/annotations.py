"""Queries on annotation work lists and on answers that list pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import annotations as o
from corvane.plans import adapters as a
from corvane.plans.registry import query

_STATUS = "CASE WHEN event_type = 'purchase' THEN 'completed' WHEN event_type IN ('click', 'view') THEN 'draft' END"


@query(f"SELECT event_id, user_id FROM (SELECT *, {_STATUS} AS status FROM events) WHERE status = 'completed' AND value > 20 UNION ALL SELECT event_id, -user_id FROM (SELECT *, {_STATUS} AS status FROM events) WHERE status IS NULL")
def annotation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("value") > 20, "pending").otherwise("done")
    rows = a.table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(_STATUS).alias("status"), role.alias("role_status"))
    pending, fresh = o.filtered(rows, "completed", "pending"), o.filtered(rows, "unstarted")
    return pending.select("event_id", "user_id").unionByName(fresh.select("event_id", (-F.col("user_id")).alias("user_id")))


@query("SELECT l_orderkey, counter, sum(c)::BIGINT AS total FROM (SELECT l_orderkey, 'flag ' || l_returnflag AS counter, 1 AS c FROM lineitem UNION ALL SELECT l_orderkey, 'size', coalesce(nullif(l_linenumber, 3), 0) FROM lineitem) GROUP BY ALL")
def summed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber").cast("bigint")
    counters = F.create_map(F.concat(F.lit("flag "), F.col("l_returnflag")), F.lit(1).cast("bigint"), F.lit("size"), F.when(n != 3, n))
    return o.summed(a.table(spark, sf_dir, "lineitem").select("l_orderkey", counters.alias("counters")), ["l_orderkey"], "counters")


# Pairs of an order's lines; some repeat an index, are negative, no whole number, or have a field too many.
_PAIR = """'{"gt_index":' || CASE WHEN l_tax = 0.08 THEN '-1' ELSE CAST(l_linenumber AS STRING) END || ',"pred_index":' || CASE WHEN l_discount = 0.1 THEN '"2"' ELSE CAST(CAST(l_quantity AS INT) % 9 AS STRING) END || CASE WHEN l_quantity = 7 THEN ',"why":"x"' ELSE '' END || '}'"""
_ANSWERS = f"""l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, {_PAIR} AS item, CASE WHEN l_tax = 0.08 THEN -1 ELSE l_linenumber END AS g, CASE WHEN l_discount <> 0.1 THEN l_quantity::INT % 9 END AS p, l_quantity = 7 AS more FROM lineitem)"""


@query(f"""WITH RECURSIVE {_ANSWERS}, sizes AS (SELECT k, max(n) AS most, bool_and(g >= 0 AND p IS NOT NULL AND NOT more) AND count(DISTINCT g) = count(*) AND count(DISTINCT p) = count(*) AND k % 4 <> 1 AS strict FROM l GROUP BY k),
kept(k, n, gs, ps) AS (SELECT k, 0::BIGINT, []::INT[], []::INT[] FROM sizes UNION ALL SELECT c.k, l.n, CASE WHEN fine THEN list_append(gs, g) ELSE gs END, CASE WHEN fine THEN list_append(ps, p) ELSE ps END
  FROM kept c JOIN l ON l.k = c.k AND l.n = c.n + 1, LATERAL (SELECT coalesce(g >= 0 AND p >= 0 AND NOT list_contains(gs, g) AND NOT list_contains(ps, p), false) AS fine))
SELECT k, CASE WHEN strict THEN array_to_string(list_transform(range(1, len(gs) + 1), lambda i: gs[i] || '-' || ps[i]), ',') END AS strict, array_to_string(list_transform(range(1, len(gs) + 1), lambda i: gs[i] || '-' || ps[i]), ',') AS tolerant FROM kept JOIN sizes USING (k) WHERE n = most""")
def pair_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with pairs, a quarter of them with words around the JSON, read strictly and tolerantly."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    own = a.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct(*order, F.expr(_PAIR).alias("item")))).alias("items"))
    body = F.concat(F.lit('{"pairs": ['), F.array_join(F.transform("items", lambda x: x["item"]), ", "), F.lit("]}"))
    text = F.when(F.col("k") % 4 == 1, F.concat(F.lit("Here: "), body, F.lit(" done."))).otherwise(body)
    shown = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws("-", p["gt_index"].cast("string"), p["pred_index"].cast("string"))), ",")
    return own.select("k", text.alias("text")).select("k", shown(o.pair_list(F.col("text"))).alias("strict"), shown(o.pair_list(F.col("text"), tolerant=True)).alias("tolerant"))
