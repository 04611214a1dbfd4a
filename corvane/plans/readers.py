"""Queries on readers and writers: texts made from the tables are read back, and files written and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.measures import fits_context, half_away
from corvane.functions.text import formatted
from corvane.operators.dataset import side_by_side, union_all
from corvane.plans import adapters as a
from corvane.plans.registry import query
from corvane.sources import records as r
from corvane.sources.shared import shared_path


def _texts(rows: DataFrame, by: str, order: str, part: Column, between: str) -> DataFrame:
    """(source, text): for each key the parts of its rows in order."""
    own = rows.groupBy(F.col(by).alias("source")).agg(F.sort_array(F.collect_list(F.struct(order, part.alias("part")))).alias("parts"))
    return own.select("source", F.array_join(F.transform("parts", lambda x: x["part"]), between).alias("text"))


def _user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "events")


@query("""WITH b AS (SELECT user_id AS source, 'im' || (event_id % 9) || CASE WHEN event_id % 4 = 0 THEN '.txt' ELSE '.PNG' END AS image, event_id % 4 = 0 AS other, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type || ' ' || event_id END AS text, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position FROM events)
SELECT source, position::INT AS position, image, text FROM b WHERE NOT other QUALIFY row_number() OVER (PARTITION BY source, image ORDER BY position DESC) = 1""")
def block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    image = F.concat(F.lit("  im"), (n % 9).cast("string"), F.when(n % 4 == 0, ".txt").otherwise(".PNG"))
    body = F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("\n"), F.col("event_type"), F.lit(" "), n.cast("string"), F.lit(" \nmore\nand more")))
    return r.blocks(_texts(_user_events(spark, sf_dir), "user_id", "event_id", F.concat(image, body), "\n \t\n"))


_RECORD = "struct<k:bigint,v:double,t:string>"


@query("SELECT user_id AS source, CASE WHEN user_id % 2 = 0 THEN 'array' ELSE 'lines' END AS format, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS record_index, event_id AS k, value AS v, CASE WHEN event_id % 5 <> 0 THEN event_type END AS t FROM events")
def json_array_or_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.to_json(F.struct(F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("t"), F.col("value").alias("v"), F.col("event_id").alias("k")))
    texts = _texts(_user_events(spark, sf_dir), "user_id", "event_id", own, "\n")
    array = F.concat(F.lit(" \n["), F.regexp_replace("text", "\n", " ,\n"), F.lit("]"))
    return r.json_or_lines(texts.select("source", F.when(F.col("source") % 2 == 0, array).otherwise(F.concat("text", F.lit("\n\n"))).alias("text")), _RECORD)


@query("SELECT user_id AS source, (2 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS line_no, event_id % 7 <> 0 AS good, CASE WHEN event_id % 7 <> 0 THEN event_id END AS k FROM events")
def json_lines_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    line = F.concat(F.lit('{"k": '), n.cast("string"), F.when(n % 7 == 0, ', "v": ').otherwise("}"))
    good, bad = r.json_lines(r.lines_of(_texts(_user_events(spark, sf_dir), "user_id", "event_id", line, "\r\n \r\n")), "struct<k:bigint>")
    return good.select("source", "line_no", F.lit(True).alias("good"), "k").unionByName(bad.select("source", "line_no", F.lit(False).alias("good"), F.lit(None).cast("bigint").alias("k")))


@query("SELECT user_id AS source, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::BIGINT AS position, 'im' || event_id || '.png' AS image, event_type AS text FROM events")
def log_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    two = F.concat(F.lit("im"), n.cast("string"), F.lit(".png "), F.when(n % 3 == 0, "\n \n\n").otherwise("\n"), F.lit(" "), F.col("event_type"))
    return r.line_pairs(r.lines_of(_texts(_user_events(spark, sf_dir), "user_id", "event_id", two, "\n")))


@query("SELECT 'nation ' || n_nationkey AS key, CASE WHEN n_nationkey % 5 = 0 THEN 'again' ELSE n_name || ': ' || n_regionkey END AS value FROM nation")
def settings_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, key = F.col("n_nationkey"), F.concat(F.lit("nation "), F.col("n_nationkey").cast("string"))
    mark, quote = F.when(n % 2 == 0, ":").otherwise("："), F.when(n % 3 == 0, '"').when(n % 3 == 1, "'").otherwise("")
    line = F.concat(F.lit("  "), key, mark, F.lit(" "), quote, F.col("n_name"), F.lit(": "), F.col("n_regionkey").cast("string"), quote)
    again = F.when(n % 5 == 0, F.concat(F.lit("\n"), key, F.lit(" ： again\n")))
    texts = _texts(a.table(spark, sf_dir, "nation").withColumn("one", F.lit(1)), "one", "n_nationkey", F.concat_ws("\n", line, again, F.lit("no pair")), "\n")
    return r.settings(r.lines_of(texts))


@query("SELECT l_orderkey AS source, 'part ' || l_partkey AS name, printf('%.2f', l_extendedprice / 7)::DOUBLE AS distance, printf('%.1f', l_quantity / 4)::DOUBLE AS direction FROM lineitem")
def scene_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.to_json(F.struct(F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("name"), (F.col("l_extendedprice") / 7).alias("distance"), (F.col("l_quantity") / 4).alias("direction")))
    own = _texts(a.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", model, ",\n")
    return r.scene_objects(own.select("source", F.concat(F.lit('{"camera": 1, "models": ['), "text", F.lit("]}")).alias("text")))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, 'none') AS role, coalesce(nullif(event_id % 4, 0), 7) AS steps, 'draft' AS status FROM events")
def annotations_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    own = _user_events(spark, sf_dir).select("event_id", F.when(n % 3 == 0, F.col("event_type")).alias("role"), F.when(n % 4 != 0, n % 4).alias("steps"))
    return r.with_defaults(own, {"role": "none", "steps": 7, "status": "draft"})


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def last_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.last_by_key(_user_events(spark, sf_dir).select("user_id", "event_id", "value"), "user_id", "event_id")


@query("SELECT p_partkey, coalesce(printf('%.2f', CASE WHEN p_size % 10 <> 0 THEN p_retailprice / p_size END), '--') AS price, round(p_retailprice / 4) AS whole, p_size > 0 AND p_partkey > 0 AND p_size * 100 + p_partkey <= 3000 AS fits FROM part")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    price = F.when(size % 10 != 0, F.col("p_retailprice") / size)
    return a.table(spark, sf_dir, "part").select("p_partkey", formatted(price, 2).alias("price"), half_away(F.col("p_retailprice") / 4).alias("whole"), fits_context(size * 100, F.col("p_partkey"), 3000).alias("fits"))


@query("SELECT s_suppkey AS k, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer UNION ALL SELECT n_nationkey, NULL, NULL FROM nation")
def union_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = lambda name: a.table(spark, sf_dir, name)
    return union_all(table("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), table("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), table("nation").select(F.col("n_nationkey").alias("k")))


@query("""SELECT o_orderkey AS k, o_orderstatus AS a_text, l_returnflag AS b_text, '' AS side FROM orders JOIN (SELECT l_orderkey, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
UNION ALL SELECT o_orderkey, NULL, NULL, 'b' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, NULL, NULL, 'a' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def reviewed_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("text"))
    second = a.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_returnflag").alias("text"))
    both, missing = side_by_side(first, second, "k")
    nothing = F.lit(None).cast("string")
    return both.withColumn("side", F.lit("")).unionByName(missing.select("k", nothing.alias("a_text"), nothing.alias("b_text"), "side"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON lines and read again."""
    path, own = shared_path(spark, "lines"), a.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own.write.json(path)
    return spark.read.schema(own.schema).json(path)


@query("SELECT event_id, 'im' || event_id || '.png' AS image, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS text FROM events")
def triplet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as records of three lines and read again; what stands in a part is a file of its own."""
    path, n = shared_path(spark, "triplets"), F.col("event_id")
    own = _user_events(spark, sf_dir).select(F.col("event_id").alias("position"), F.concat(F.lit("im"), n.cast("string"), F.lit(".png")).alias("image"), F.when(n % 5 == 0, "").otherwise(F.col("event_type")).alias("text"))
    r.write_triplets(own, path)
    found = r.triplets(r.lines_of(r.read_texts(spark, path)))
    return found.select(F.regexp_extract("image", r"(\d+)", 1).cast("bigint").alias("event_id"), "image", "text")


@query("SELECT conv_id, turn, text, role || '.png' AS image FROM conversations")
def conversation_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON of messages and images, and taken apart again."""
    path, c = shared_path(spark, "conversations"), a.table(spark, sf_dir, "conversations")
    key = F.concat_ws(" ", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    r.conversation_json(c.select(key.alias("prompt"), F.col("text").alias("answer"), F.concat("role", F.lit(".png")).alias("image"))).write.text(path)
    v = F.try_parse_json("value")
    get = lambda p: F.try_variant_get(v, p, "string")
    own = spark.read.text(path).select(F.split(get("$.messages[0].content"), " ").alias("key"), get("$.messages[1].content").alias("text"), get("$.images[0]").alias("image"))
    return own.select(F.col("key")[0].cast("bigint").alias("conv_id"), F.col("key")[1].cast("bigint").alias("turn"), "text", "image")
