"""Queries on boxes, angles, depths and small rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import measures as f
from corvane.functions.raster import edge_correlation_udf, near_regions_udf, single_region_udf
from corvane.operators.matching import top_candidates
from corvane.operators.validation import quality_decision
from corvane.plans import adapters as a
from corvane.plans.registry import query

_BOXES = """boxes AS (SELECT l_orderkey AS object_id, l_partkey AS candidate_id, l_linenumber, (l_partkey % 100) / 100 AS cx, (l_suppkey % 10) / 10 AS cy, (l_quantity::INT % 20) / 20 AS w, (l_quantity::INT % 7) / 7 AS h, l_discount, l_tax, l_extendedprice FROM lineitem),
corners AS (SELECT *, (cx - w / 2) * 640 AS x1, (cy - h / 2) * 480 AS y1, (cx + w / 2) * 640 AS x2, (cy + h / 2) * 480 AS y2 FROM boxes)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    line = a.table(spark, sf_dir, "lineitem")
    own = line.select(F.col("l_orderkey").alias("object_id"), F.col("l_partkey").alias("candidate_id"), "l_linenumber", (F.col("l_partkey") % 100 / 100).alias("cx"), (F.col("l_suppkey") % 10 / 10).alias("cy"), (q % 20 / 20).alias("w"), (q % 7 / 7).alias("h"), "l_discount", "l_tax", "l_extendedprice")
    corners = f.corners(*(F.col(c) for c in ("cx", "cy", "w", "h")), F.lit(640), F.lit(480))
    return own.select("*", *[c.alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"), strict=True)])


_IOU = """iou AS (SELECT *, greatest(0, least(x2, 400) - greatest(x1, 100)) * greatest(0, least(y2, 300) - greatest(y1, 50)) AS inner_, greatest(0, x2 - x1) * greatest(0, y2 - y1) AS area FROM corners),
scored AS (SELECT *, CASE WHEN area <= 0 THEN 0 ELSE inner_ / (area + 75000 - inner_) END AS iou FROM iou)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    return _boxes(spark, sf_dir).withColumn("iou", f.box_iou(box, tuple(F.lit(float(v)) for v in (100, 50, 400, 300))))


@query(f"WITH {_BOXES}, {_IOU} SELECT object_id, candidate_id, l_linenumber, round(iou, 9) AS iou FROM scored")
def bbox_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("object_id", "candidate_id", "l_linenumber", F.round("iou", 9).alias("iou"))


@query(f"WITH {_BOXES} SELECT object_id, candidate_id, l_linenumber, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, w > 0 AND h > 0 AND cx - w / 2 >= -1e-6 AND cy - h / 2 >= -1e-6 AND cx + w / 2 <= 1 + 1e-6 AND cy + h / 2 <= 1 + 1e-6 AS valid FROM corners")
def yolo_to_xyxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = f.box_is_valid(*(F.col(c) for c in ("cx", "cy", "w", "h")))
    return _boxes(spark, sf_dir).select("object_id", "candidate_id", "l_linenumber", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")], valid.alias("valid"))


@query(f"""WITH {_BOXES}, {_IOU} SELECT object_id, candidate_id, l_discount AS score FROM scored WHERE iou >= 0.01
QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY l_discount DESC, iou DESC, l_tax DESC, candidate_id, l_linenumber) = 1""")
def top_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _scored(spark, sf_dir).withColumnRenamed("l_discount", "score").withColumnRenamed("l_tax", "grounding")
    return top_candidates(own, 0.01).select("object_id", "candidate_id", "score")


_P = "p AS (SELECT p_partkey, p_size, p_partkey % 641 AS x, p_partkey % 480 AS y, (p_partkey % 256)::DOUBLE AS depth FROM part)"


@query(f"""WITH {_P} SELECT p_partkey, CASE WHEN p_size <= 1 THEN 0 ELSE round(90 - 180 * (x % p_size) / (p_size - 1), 9) END AS degrees, 479 - y AS from_bottom, greatest(0, least(479, 480 - y)) AS clamped FROM {'p'}""")
def direction_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = a.table(spark, sf_dir, "part")
    x, y = F.col("p_partkey") % 641, F.col("p_partkey") % 480
    return p.select("p_partkey", F.round(f.direction_degrees(x % F.col("p_size"), F.col("p_size")), 9).alias("degrees"), f.from_bottom(y, F.lit(480)).alias("from_bottom"), f.from_bottom_clamped(y, F.lit(480)).alias("clamped"))


@query(f"WITH {_P} SELECT p_partkey, CASE WHEN depth > 0 THEN round(3.876 + 5.197 * (ln(255.0) - ln(depth)))::INT END AS steps FROM p")
def depth_to_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "part").select("p_partkey", f.depth_steps((F.col("p_partkey") % 256).cast("double")).alias("steps"))


@query("""SELECT s_suppkey, round(degrees(atan2(-((s_suppkey % 21) - 10), (s_suppkey % 7) - 3)), 6) AS bearing, (s_suppkey % 7) - 3 > 0 AND abs(degrees(atan2(-((s_suppkey % 21) - 10), (s_suppkey % 7) - 3))) <= 45 AND sqrt(pow((s_suppkey % 21) - 10, 2) + pow((s_suppkey % 7) - 3, 2)) <= 8 AS visible FROM supplier""")
def visible_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, z = (F.col("s_suppkey") % 21 - 10).cast("double"), (F.col("s_suppkey") % 7 - 3).cast("double")
    turn = f.bearing(x, z)
    return a.table(spark, sf_dir, "supplier").select("s_suppkey", F.round(turn, 6).alias("bearing"), ((z > 0) & (F.abs(turn) <= 45) & (F.sqrt(x * x + z * z) <= 8)).alias("visible"))


# Cameras stand at suppliers and look along one of eight directions, a little downwards; lines are objects around them.
_SEEN = """v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, 0.0::DOUBLE AS cx, 1.6::DOUBLE AS cy, 0.0::DOUBLE AS cz, (l_suppkey % 3 - 1)::DOUBLE AS fx, -0.2::DOUBLE AS fy, CASE WHEN l_suppkey % 3 = 1 AND l_suppkey % 2 = 0 THEN -1 ELSE l_suppkey % 2 END::DOUBLE AS fz, l_returnflag <> 'R' AS active,
  (l_partkey % 21 - 10) / 2.0::DOUBLE AS px, (l_partkey % 5) / 2.0::DOUBLE AS py, (l_quantity - 25) / 4 AS pz FROM lineitem),
w AS (SELECT *, px * 0.75 AS nx, py * 0.75 AS ny, pz * 0.75 AS nz FROM v), t AS (SELECT *, px - cx AS ax, py - cy AS ay, pz - cz AS az, nx - cx AS bx, ny - cy AS by_, nz - cz AS bz FROM w)"""


@query(f"""WITH {_SEEN} SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, active AND fx * ax + fy * ay + fz * az > 0 AND (ax * ax + az * az < 0.01 OR abs(degrees(atan2(fx * az - fz * ax, fx * ax + fz * az))) <= 45) AND sqrt(ax * ax + ay * ay + az * az) <= 6 AND fx * bx + fy * by_ + fz * bz > 0 AS seen,
round(CASE WHEN bx * bx + bz * bz < 0.01 THEN 0 ELSE -degrees(atan2(fz * bx - fx * bz + 0.0, fx * bx + fz * bz)) END, 6) AS direction, round(sqrt(bx * bx + by_ * by_ + bz * bz), 6) AS distance FROM t""")
def seen_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, zero = a.table(spark, sf_dir, "lineitem"), F.lit(0.0)
    s = F.col("l_suppkey")
    forward = ((s % 3 - 1).cast("double"), F.lit(-0.2), F.when((s % 3 == 1) & (s % 2 == 0), -1).otherwise(s % 2).cast("double"))
    position = ((F.col("l_partkey") % 21 - 10) / 2.0, (F.col("l_partkey") % 5) / 2.0, (F.col("l_quantity") - 25) / 4)
    found = f.seen((zero, F.lit(1.6), zero), forward, position, tuple(p * 0.75 for p in position), F.col("l_returnflag") != "R", half_angle=45, most_distance=6)
    own = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", found.alias("s"))
    return own.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "s.seen", F.round("s.direction", 6).alias("direction"), F.round("s.distance", 6).alias("distance"))


@query("""SELECT p_partkey, list_filter([CASE WHEN nf > 0 AND nf <= 0.05 AND nc >= 0.8 AND co < 0.1 THEN 'near_artifact' END, CASE WHEN sky < 0.01 THEN 'sky_missing' END], lambda x: x IS NOT NULL) AS reasons,
CASE WHEN (nf > 0 AND nf <= 0.05 AND nc >= 0.8 AND co < 0.1) OR sky < 0.01 THEN 'rejected' ELSE 'passed' END AS status FROM (SELECT p_partkey, (p_partkey % 11) / 100 AS nf, (p_partkey % 6) / 5 AS nc, (p_partkey % 9) / 20 AS co, (p_size % 30) / 500 AS sky FROM part)""")
def quality_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    d = quality_decision(k % 11 / 100, k % 6 / 5, k % 9 / 20, F.col("p_size") % 30 / 500)
    return a.table(spark, sf_dir, "part").select("p_partkey", d.alias("d")).select("p_partkey", "d.reasons", "d.status")


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 rasters: an 8-bit depth and its mirror image."""
    e = a.table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    low, high = F.array_min("embedding"), F.array_max("embedding")
    depth = F.transform("embedding", lambda v: F.rint((v - low) * 255 / F.when(high > low, high - low).otherwise(1)).cast("int"))
    return e.select("vec_id", depth.alias("depth"), F.reverse(depth).alias("mirror"))


@query()
def near_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rasters(spark, sf_dir).select("vec_id", near_regions_udf(200)("depth", F.lit(8)).alias("n")).select("vec_id", "n.fraction", "n.concentration")


# Gradients of 8 x 8 rasters cell by cell; the borders repeat their own cells.
_AT = lambda c, dy, dx: f"{c}[8 * least(greatest(k // 8 + {dy}, 0), 7) + least(greatest(k % 8 + {dx}, 0), 7) + 1]"
_SIDE = lambda c, dy, dx: f"({_AT(c, dy or -1, dx or -1)} + 2 * {_AT(c, dy, dx)} + {_AT(c, dy or 1, dx or 1)})"
_EDGE = lambda c: f"sqrt(pow({_SIDE(c, 0, 1)} - {_SIDE(c, 0, -1)}, 2) + pow({_SIDE(c, 1, 0)} - {_SIDE(c, -1, 0)}, 2))"
_RASTERS_SQL = "e AS (SELECT vec_id, embedding AS v, list_min(embedding) AS low, list_max(embedding) AS high FROM embeddings WHERE len(embedding) = 64), r AS (SELECT vec_id, list_transform(v, lambda x: round_even(((x - low) * 255)::DOUBLE / CASE WHEN high > low THEN (high - low)::DOUBLE ELSE 1 END, 0)) AS depth FROM e)"


def _correlation_sql(first: str, second: str) -> str:
    return f"""WITH {_RASTERS_SQL}, b AS (SELECT vec_id, {first} AS a, {second} AS b FROM r), k AS (SELECT vec_id, a, b, unnest(range(64)) AS k FROM b), g AS (SELECT vec_id, {_EDGE('a')} AS x, {_EDGE('b')} AS y FROM k)
SELECT vec_id, round(CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN greatest(-1, least(1, corr(x, y))) ELSE 1 END, 6) AS correlation FROM g GROUP BY vec_id"""


@query(_correlation_sql("depth", "list_reverse(depth)"))
def edge_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rasters(spark, sf_dir).select("vec_id", F.round(edge_correlation_udf()("depth", "mirror", F.lit(8)), 6).alias("correlation"))


@query(_correlation_sql("list_transform(range(64), lambda i: 0.299 * depth[64 - i] + 0.587 * (255 - depth[i + 1]) + 0.114 * depth[i % 8 * 8 + i // 8 + 1])", "depth"))
def colour_edge_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of a colour image and its depth; the channels are the mirrored, the inverted and the turned depth."""
    depth = F.col("depth")
    red, green, blue = F.reverse(depth), F.transform(depth, lambda v: 255 - v), F.transform(depth, lambda _, i: F.get(depth, i % 8 * 8 + F.floor(i / 8).cast("int")))
    return _rasters(spark, sf_dir).select("vec_id", F.round(edge_correlation_udf()(f.luminance(red, green, blue), depth.cast("array<double>"), F.lit(8)), 6).alias("correlation"))


@query()
def component_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.transform("depth", lambda v: (v >= 110).cast("int"))
    box = F.array(*[F.lit(v) for v in (1.0, 1.0, 6.5, 6.5)])
    return _rasters(spark, sf_dir).select("vec_id", single_region_udf()(mask, F.lit(8), box).alias("r")).select("vec_id", "r.*")


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings WHERE len(embedding) = 64)
SELECT vec_id, round(median(v::DOUBLE), 6) AS depth, round(avg(i % 8), 6) AS cx, round(avg(i // 8), 6) AS cy, min(i % 8)::INT AS x1, max(i % 8 + 1)::INT AS x2 FROM e WHERE v > 0 GROUP BY vec_id""")
def mask_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v")).where("v > 0")
    x, y = F.col("i") % 8, F.floor(F.col("i") / 8)
    return e.groupBy("vec_id").agg(F.round(F.median("v"), 6).alias("depth"), F.round(F.avg(x), 6).alias("cx"), F.round(F.avg(y), 6).alias("cy"), F.min(x).cast("int").alias("x1"), F.max(x + 1).cast("int").alias("x2"))
