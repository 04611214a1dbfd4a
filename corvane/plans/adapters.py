"""Domain shapes over the given tables, each as a DataFrame and as SQL of the same rows.

Orders are records, their lines are objects: those with status F are reference
objects, the others predictions of one of two methods.  Names, categories and
stated distances follow from the lines' columns by fixed rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METHODS = ("ours", "fewshot")
NAMES = ("Cars", "vehicle", "bikes", "Bicycle", "barriers", "fence", "Pit", "manholes")
FLAGS = {"A": ("GROUND", "PIT"), "N": ("PIT", "OVERHEAD"), "R": ("OVERHEAD", "GROUND")}
IMAGES = 4999


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    line = line.repartition("l_orderkey") if dealt else line
    flag = F.col("l_returnflag")
    label = lambda place: reduce(lambda out, item: F.when(flag == item[0], item[1][place]).otherwise(out), FLAGS.items(), F.lit(None))
    steps = (F.col("l_quantity").cast("int") % 15).cast("int")
    n = steps.cast("string")
    kind = F.col("l_linenumber") % 7
    tenths = (steps * 6).cast("int")
    raw = (
        F.when(kind == 1, F.concat(F.lit("about "), n, F.lit(" steps ahead")))
        .when(kind == 2, F.concat(n, F.lit(" steps")))
        .when(kind == 3, F.concat(F.lit("possibly "), n, F.lit(" steps")))
        .when(kind == 4, F.concat(n, F.lit(" steps behind the car")))
        .when(kind == 5, F.concat(F.lit("between "), (steps - 1).cast("string"), F.lit(" and "), (steps + 1).cast("string"), F.lit(" steps")))
        .when(kind == 6, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" meters ahead")))
    )
    names = F.array(*map(F.lit, NAMES))
    return line.select(
        F.col("l_orderkey").alias("record_index"),
        "l_linestatus",
        F.when(F.col("l_suppkey") % 2 == 0, METHODS[0]).otherwise(METHODS[1]).alias("method"),
        F.element_at(names, (F.col("l_partkey") % len(NAMES) + 1).cast("int")).alias("name"),
        F.when(F.col("l_quantity") % 2 == 0, F.array(label(0), label(1))).otherwise(F.array(label(0))).alias("categories"),
        F.when(steps != 0, steps).alias("distance_steps"),
        F.when(steps != 0, raw).alias("distance_raw"),
        *_ORDER,
    )


_ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate"]


def _numbered(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.withColumn("object_index", (F.row_number().over(Window.partitionBy(*keys).orderBy(*_ORDER)) - 1).cast("int")).drop("l_linestatus", *_ORDER)


def gt_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference objects: record_index, object_index, name, categories, distance_steps, distance_raw."""
    return _numbered(_lines(spark, sf_dir).where("l_linestatus = 'F'").drop("method"), "record_index")


def pred_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions: those columns and method."""
    return _numbered(_lines(spark, sf_dir).where("l_linestatus = 'O'"), "record_index", "method")


def both_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference objects, once for each method, and predictions (_pred), dealt out once by record_index."""
    rows, pred = _lines(spark, sf_dir, dealt=True).where("l_linestatus in ('F', 'O')"), F.col("l_linestatus") == "O"
    place = F.row_number().over(Window.partitionBy("record_index", pred, F.when(pred, F.col("method"))).orderBy(*_ORDER)) - 1
    numbered = rows.select("record_index", "method", pred.alias("_pred"), place.cast("int").alias("object_index"), "name", "categories")
    return numbered.withColumn("method", F.explode(F.when(F.col("_pred"), F.array("method")).otherwise(F.array(*map(F.lit, METHODS)))))


def image_of(key: Column) -> Column:
    return F.concat(F.lit("img_"), (key % IMAGES).cast("string"), F.lit(".png"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_index, image, role of every order."""
    p = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_index"), image_of(F.col("o_orderkey")).alias("image"), F.when(p.isin("1", "2"), "required").when(p == "3", "optional").otherwise("ignore").alias("role"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timed runs: model, replica, branch, record_id, seconds, status and more."""
    e = table(spark, sf_dir, "events")
    ok = F.col("event_id") % 97 != 0
    return e.select(
        F.col("event_id").alias("record_id"),
        F.col("user_id").alias("series"),
        "ts",
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("micros"),
        F.concat(F.lit("m"), (F.col("user_id") % 2).cast("string")).alias("model"),
        (F.col("user_id") % 4).alias("replica"),
        F.when(F.col("event_type") == "error", "hazard").otherwise("safe").alias("branch"),
        F.when(ok, "ok").otherwise("error").alias("status"),
        F.when(ok, F.col("value") / 100).alias("seconds"),
        F.when(F.col("event_type") == "error", "<ALERT>a</ALERT><GUIDE>b</GUIDE>").otherwise("<SAFE/>").alias("response_text"),
        (F.col("event_id") % 50 % 3 + 1).alias("last_token_id"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as a record file: source, line_no, line; every third is an image name, and some are blank."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    n = F.col("n")
    own = F.when(n % 3 == 0, F.concat(F.lit("im"), n.cast("string"), F.when(n % 2 == 0, ".png").otherwise(".txt"))).when((n % 3 == 1) & (n % 2 == 0), F.concat(F.lit("<ALERT>"), F.col("line"), F.lit("</ALERT> <GUIDE>go</GUIDE>"))).when((n % 3 == 2) & (n % 4 != 0), F.lit("")).otherwise(F.col("line"))
    return docs.select("source", (n + 1).alias("line_no"), own.alias("line"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and messages (role, content) in the order of turns."""
    c = table(spark, sf_dir, "conversations")
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))


def safe_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("ref_safe"), (F.col("toxic") == 0).alias("pred_safe"))


# The same rows in SQL.
_names = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
_label = lambda place: "CASE l_returnflag " + " ".join(f"WHEN '{f}' THEN '{own[place]}'" for f, own in FLAGS.items()) + " END"
LINES_SQL = f"""
lines AS (SELECT l_orderkey AS record_index, l_linestatus, CASE WHEN l_suppkey % 2 = 0 THEN '{METHODS[0]}' ELSE '{METHODS[1]}' END AS method,
  ({_names})[(l_partkey % {len(NAMES)} + 1)::INT] AS name,
  CASE WHEN l_quantity % 2 = 0 THEN [{_label(0)}, {_label(1)}] ELSE [{_label(0)}] END AS categories,
  nullif(l_quantity::INT % 15, 0) AS distance_steps,
  CASE WHEN l_quantity::INT % 15 = 0 THEN NULL ELSE CASE l_linenumber % 7
    WHEN 1 THEN 'about ' || (l_quantity::INT % 15) || ' steps ahead' WHEN 2 THEN (l_quantity::INT % 15) || ' steps'
    WHEN 3 THEN 'possibly ' || (l_quantity::INT % 15) || ' steps' WHEN 4 THEN (l_quantity::INT % 15) || ' steps behind the car'
    WHEN 5 THEN 'between ' || (l_quantity::INT % 15 - 1) || ' and ' || (l_quantity::INT % 15 + 1) || ' steps'
    WHEN 6 THEN (l_quantity::INT % 15 * 6 // 10) || '.' || (l_quantity::INT % 15 * 6 % 10) || ' meters ahead' END END AS distance_raw,
  {", ".join(_ORDER)} FROM lineitem)"""
GT_SQL = f"""{LINES_SQL},
gt AS (SELECT record_index, name, categories, distance_steps, distance_raw, (row_number() OVER (PARTITION BY record_index ORDER BY {", ".join(_ORDER)}) - 1)::INT AS object_index FROM lines WHERE l_linestatus = 'F')"""
OBJECTS_SQL = f"""{GT_SQL},
pred AS (SELECT record_index, method, name, categories, distance_steps, distance_raw, (row_number() OVER (PARTITION BY record_index, method ORDER BY {", ".join(_ORDER)}) - 1)::INT AS object_index FROM lines WHERE l_linestatus = 'O'),
gtm AS (SELECT gt.*, m.method FROM gt, (VALUES ('{METHODS[0]}'), ('{METHODS[1]}')) m(method))"""
RECORDS_SQL = f"records AS (SELECT o_orderkey AS record_index, 'img_' || (o_orderkey % {IMAGES}) || '.png' AS image, CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'required' WHEN o_orderpriority[1] = '3' THEN 'optional' ELSE 'ignore' END AS role FROM orders)"
OBSERVATIONS_SQL = """obs AS (SELECT event_id AS record_id, user_id AS series, ts, epoch_us(ts) AS micros, 'm' || (user_id % 2) AS model, user_id % 4 AS replica,
  CASE WHEN event_type = 'error' THEN 'hazard' ELSE 'safe' END AS branch, CASE WHEN event_id % 97 <> 0 THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN event_id % 97 <> 0 THEN value / 100 END AS seconds,
  CASE WHEN event_type = 'error' THEN '<ALERT>a</ALERT><GUIDE>b</GUIDE>' ELSE '<SAFE/>' END AS response_text, event_id % 50 % 3 + 1 AS last_token_id FROM events)"""
FILE_LINES_SQL = r"""raw AS (SELECT doc_id AS source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
cut AS (SELECT source, unnest(range(len(parts))) AS n, unnest(parts) AS line FROM raw),
file_lines AS (SELECT source, n + 1 AS line_no, CASE WHEN n % 3 = 0 THEN 'im' || n || CASE WHEN n % 2 = 0 THEN '.png' ELSE '.txt' END
  WHEN n % 3 = 1 AND n % 2 = 0 THEN '<ALERT>' || line || '</ALERT> <GUIDE>go</GUIDE>' WHEN n % 3 = 2 AND n % 4 <> 0 THEN '' ELSE line END AS line FROM cut)"""
MESSAGES_SQL = "turns AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn, role, text) AS messages FROM conversations GROUP BY conv_id)"


def cautious_sql(c: str) -> str:
    """SQL of the cautious name of a column."""
    one = "CASE WHEN w = 'buses' THEN 'bus' WHEN w IN ('species', 'news', 'status', 'glass', 'glasses', 'gas', 'bus') THEN w WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN length(w) > 4 AND regexp_matches(w, '(ches|shes|xes|zes|sses)$') THEN w[:-3] WHEN length(w) > 3 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is|ses)$') THEN w[:-2] ELSE w END"
    return f"array_to_string(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: {one}), ' ')"


def simple_sql(c: str) -> str:
    """SQL of the simple name of a column (ASCII)."""
    one = "CASE WHEN length(w) > 2 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END"
    return f"array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda w: w <> ''), lambda w: {one}), ' ')"


def rank_join_sql(gt: str, pred: str, keys: str, source: str) -> str:
    ranked = lambda frame, name: f"SELECT record_index, method, {keys}, object_index AS {name}, row_number() OVER (PARTITION BY record_index, method, {keys} ORDER BY object_index) AS rank FROM {frame}"
    return f"SELECT record_index, method, gt_index, pred_index, '{source}' AS source FROM ({ranked(gt, 'gt_index')}) g JOIN ({ranked(pred, 'pred_index')}) p USING (record_index, method, {keys}, rank)"


def matches_sql(profile: str) -> str:
    """CTEs up to pairs: exact and synonym matches of gtm and pred."""
    from corvane.operators.matching import stars, synonyms

    dimension = ", ".join(f"('{n}', '{s}', {str(c).lower()})" for n, (s, c) in sorted(stars(synonyms(profile)).items()))
    return f"""{OBJECTS_SQL},
gn AS (SELECT *, {cautious_sql('name')} AS norm FROM gtm), pn AS (SELECT *, {cautious_sql('name')} AS norm FROM pred),
exact AS ({rank_join_sql("(SELECT * FROM gn WHERE norm <> '')", "(SELECT * FROM pn WHERE norm <> '')", 'norm', 'exact')}),
star(norm, star, central) AS (VALUES {dimension}),
gs AS (SELECT g.*, star, central AS gt_central FROM gn g JOIN star USING (norm) WHERE NOT EXISTS (FROM exact e WHERE e.record_index = g.record_index AND e.method = g.method AND e.gt_index = g.object_index)),
ps AS (SELECT p.*, star, NOT central AS gt_central FROM pn p JOIN star USING (norm) WHERE NOT EXISTS (FROM exact e WHERE e.record_index = p.record_index AND e.method = p.method AND e.pred_index = p.object_index)),
pairs AS (FROM exact UNION ALL ({rank_join_sql('gs', 'ps', 'star, gt_central', 'synonym')})),
results AS (SELECT g.*, pairs.pred_index, pairs.source, p.name AS pred_name, pairs.pred_index IS NOT NULL AS detected FROM gtm g LEFT JOIN pairs ON pairs.record_index = g.record_index AND pairs.method = g.method AND pairs.gt_index = g.object_index
  LEFT JOIN pred p ON p.record_index = pairs.record_index AND p.method = pairs.method AND p.object_index = pairs.pred_index)"""


BIN_SQL = "CASE WHEN distance_steps IS NULL THEN 'Unknown' WHEN distance_steps <= 5 THEN 'Near' WHEN distance_steps <= 8 THEN 'Medium' ELSE 'Far' END"
