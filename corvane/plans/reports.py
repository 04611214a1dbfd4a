"""Queries on sinks and readers: ordered CSV reports, the append log, class lists, and tables put together by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import CATEGORIES, LABELS, fixed
from corvane.operators.matching import assembled
from corvane.plans import adapters as a
from corvane.plans.registry import ORACLE_SQL, QUERIES, query
from corvane.sources import class_names as c
from corvane.sources import sinks
from corvane.sources.shared import shared_path

BINS = ("Close", "Medium", "Far", "Unknown")


def _listed(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _file(spark: SparkSession, frame: DataFrame, columns: dict[str, Column], order: list[Column], line_end: str = "\n", mark: bool = False) -> DataFrame:
    """(n, line) of a report, as it stands in the parts of its file."""
    path = shared_path(spark, "report")
    sinks.write_ordered_csv(frame, path, columns, order, mark=mark, line_end=line_end, parts=3)
    # A report has a bounded number of rows: its labels are fixed.
    whole = sinks.ordered_parts(spark, path).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "content"))), lambda p: p["content"]), "").alias("text"))
    return whole.select(F.posexplode(F.split("text", line_end)).alias("n", "line")).where("line <> ''")


def _lines_sql(title: str, rows: str, order: str) -> str:
    return f"SELECT 0 AS n, '{title}' AS line UNION ALL SELECT row_number() OVER (ORDER BY {order}, line)::INT, line FROM ({rows})"


_RECALL = ORACLE_SQL["recall_by_category_bin"]


@query(_lines_sql("category,distance_bin,method,total,recall", f"SELECT *, concat_ws(',', category, distance_bin, method, total::VARCHAR, coalesce(printf('%.3f', recall), '')) AS line FROM ({_RECALL})", f"coalesce(nullif(list_position({_listed(CATEGORIES)}, category), 0), 9), coalesce(nullif(list_position({_listed(BINS)}, distance_bin), 0), 9), method"))
def csv_recall_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = QUERIES["recall_by_category_bin"](spark, sf_dir)
    columns = {n: F.col(n) for n in ("category", "distance_bin", "method", "total")} | {"recall": fixed(F.col("recall"), 3)}
    return _file(spark, rows, columns, [sinks.place_in(F.col("category"), CATEGORIES), sinks.place_in(F.col("distance_bin"), BINS), F.col("method")])


_CELLS = ", ".join(f"coalesce(printf('%.6f', max(CASE WHEN predicted = '{p}' THEN percent END)), '0.000000') AS c_{p}" for p in LABELS)


@query(_lines_sql("method,actual," + ",".join(LABELS), f"SELECT method, actual, concat_ws(',', method, actual, {', '.join(f'c_{p}' for p in LABELS)}) AS line FROM (SELECT method, actual, {_CELLS} FROM ({ORACLE_SQL['confusion_rownorm']}) GROUP BY ALL)", f"method, list_position({_listed(LABELS)}, actual)"))
def csv_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = QUERIES["confusion_rownorm"](spark, sf_dir).groupBy("method", "actual").pivot("predicted", list(LABELS)).agg(F.max("percent")).na.fill(0.0)
    columns = {"method": F.col("method"), "actual": F.col("actual")} | {p: fixed(F.col(p), 6) for p in LABELS}
    return _file(spark, wide, columns, [F.col("method"), sinks.place_in(F.col("actual"), LABELS)])


@query(_lines_sql("﻿model,branch,attempts,successes,mean,p95", f"""SELECT *, concat_ws(',', coalesce(model, 'overall'), coalesce(branch, 'all'), attempts::VARCHAR, successes::VARCHAR, printf('%.6f', mean), printf('%.6f', p95)) AS line
FROM (WITH {a.OBSERVATIONS_SQL} SELECT model, branch, count(*) AS attempts, count(seconds) AS successes, round(avg(seconds), 9) AS mean, round(quantile_cont(seconds, 0.95), 9) AS p95 FROM obs GROUP BY GROUPING SETS ((model, branch), ()))""", "model IS NULL, model, branch"))
def csv_latency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.operators.latency import latency_summary

    rows = latency_summary(a.observations(spark, sf_dir), [["model", "branch"], []]).withColumns({n: F.round(n, 9) for n in ("mean", "p95")})
    columns = {"model": F.coalesce("model", F.lit("overall")), "branch": F.coalesce("branch", F.lit("all")), "attempts": F.col("attempts"), "successes": F.col("successes")} | {n: fixed(F.col(n), 6) for n in ("mean", "p95")}
    return _file(spark, rows, columns, [F.col("model").isNull(), F.col("model"), F.col("branch")], "\r\n", True)


@query("SELECT user_id % 4 AS batch, count(*) AS n, count(DISTINCT event_id) AS ids, sum(event_id)::BIGINT AS total FROM events WHERE user_id % 4 < 3 GROUP BY 1")
def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches of the events: the first repeated, the second killed before its commit and repeated, the last only killed."""
    path, own = shared_path(spark, "log"), a.table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    batch = lambda n: own.where(F.col("user_id") % 4 == n)
    sinks.append_batch(batch(0), path, 0)
    for n in (1, 3):  # what a killed write leaves: rows without a commit
        batch(n).limit(7).write.json(f"{path}/rows/batch={n}")
    for n in (0, 1, 2):
        sinks.append_batch(batch(n), path, n)
    log = sinks.read_log(spark, path, own.schema)
    return log.groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.sum("event_id").alias("total"))


_KIND = "CAST(substring(p_brand, 7, 9) AS INT) % 5"


@query(f"""WITH b AS (SELECT p_brand, {_KIND} AS kind, p_name || ' ' || p_partkey AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INT - 1 AS i FROM part)
SELECT p_brand, i AS class_id, name, NULL::VARCHAR AS problem FROM b""")
def class_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand is an image set that names its parts, in one of five forms of text."""
    part = a.table(spark, sf_dir, "part").select("p_brand", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), "p_partkey", F.expr(_KIND).alias("kind"))
    own = part.groupBy("p_brand", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "name"))), lambda x: x["name"]).alias("names"))
    names, kind = F.col("names"), F.col("kind")
    with_numbers = lambda mark: F.transform(names, lambda x, i: F.concat(i.cast("string"), F.lit(": "), F.lit(mark), x, F.lit(mark)))
    head = F.lit("path: ../sets\ntrain: images/train # all\nnames:")
    texts = (
        F.when(kind == 0, F.concat(head, F.lit(" ["), F.array_join(F.transform(names, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]\nval: images/val\n")))
        .when(kind == 1, F.concat(head, F.lit("  # a list\n"), F.array_join(F.transform(names, lambda x: F.concat(F.lit("  - "), x)), "\n"), F.lit("\nnc: 5\n")))
        .when(kind == 2, F.concat(head, F.lit("\n"), F.array_join(F.transform(with_numbers("'"), lambda x: F.concat(F.lit("  "), x)), "\n"), F.lit("\nval: x\n")))
        .when(kind == 3, F.concat(head, F.lit(" {"), F.array_join(with_numbers(""), ", "), F.lit("}\n"))).otherwise(F.lit("train: x\n"))
    )
    plain = F.concat(F.array_join(names, "\n\n"), F.lit("\n"))
    files = own.select("p_brand", F.inline(F.array(F.struct(F.lit("dataset.yaml").alias("file"), texts.alias("text")), F.struct(F.lit("classes.txt").alias("file"), F.when(kind == 4, plain).otherwise("other").alias("text")))))
    return c.class_lists(files, "p_brand")


_SIDES = """objects AS (SELECT p_partkey AS k, p_size FROM part WHERE p_size > 5), masks AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
distances AS (SELECT l_partkey AS k, max(l_quantity) AS far FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), kinds AS (SELECT vec_id AS k, label FROM embeddings UNION ALL SELECT vec_id, label FROM embeddings WHERE label = 3)"""


@query(f"""WITH {_SIDES}, keys AS (SELECT k FROM objects UNION SELECT k FROM masks UNION SELECT k FROM distances UNION SELECT k FROM kinds), one AS (SELECT k, any_value(label) AS label, count(*) AS c FROM kinds GROUP BY k)
SELECT k, p_size, n, far, label, concat_ws(',', CASE WHEN p_size IS NULL THEN 'objects' END, CASE WHEN n IS NULL THEN 'masks' END, CASE WHEN far IS NULL THEN 'distances' END, CASE WHEN label IS NULL THEN 'kinds' END) AS missing, CASE WHEN c > 1 THEN 'kinds' ELSE '' END AS repeated
FROM keys LEFT JOIN objects USING (k) LEFT JOIN masks USING (k) LEFT JOIN distances USING (k) LEFT JOIN one USING (k)""")
def four_way_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, kinds = a.table(spark, sf_dir, "lineitem"), a.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), "label")
    sides = {
        "objects": a.table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("k"), "p_size"),
        "masks": line.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n")),
        "distances": line.where("l_linestatus = 'F'").groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_quantity").alias("far")),
        "kinds": kinds.unionByName(kinds.where("label = 3")),
    }
    found = assembled(sides, ["k"])
    return found.select("k", "objects.p_size", "masks.n", "distances.far", "kinds.label", F.array_join("missing", ",").alias("missing"), F.array_join("repeated", ",").alias("repeated"))
