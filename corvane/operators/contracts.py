"""Contracts between tables that a step reads: what breaks them is a row, and a strict form raises on the first ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.cached_records import kind


class ContractError(ValueError):
    """Problems of the input of a strict step, of which the message names some."""


def held_to(frame: DataFrame, problems: DataFrame, most: int = 5) -> DataFrame:
    """The frame, if there are no problems; runs a job that looks for some."""
    found = problems.limit(most).collect()
    if found:
        raise ContractError("; ".join(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in found))
    return frame


def pair_problems(reference: DataFrame, prediction: DataFrame, key: str, text: str) -> DataFrame:
    """(problem, key) of two tables of texts that must have equal sets of keys.

    A reference may be repeated with the same text, else it is
    conflicting_reference; a prediction may not (duplicate_prediction); and
    reference_only and prediction_only keys.  A null text is one like others.
    """
    side = lambda frame, n: frame.select(key, F.lit(n).alias("_side"), F.struct(F.col(text).alias("t")).alias("_text"))
    both = side(reference, 0).unionByName(side(prediction, 1))
    given = lambda n: F.when(F.col("_side") == n, F.col("_text"))
    # The least and the greatest text tell whether there are two, without holding them all.
    own = both.groupBy(key).agg(F.count(given(0)).alias("r"), F.count(given(1)).alias("p"), F.min(given(0)).alias("least"), F.max(given(0)).alias("most"))
    checks = {"conflicting_reference": ~F.col("least").eqNullSafe(F.col("most")), "duplicate_prediction": F.col("p") > 1, "reference_only": F.col("p") == 0, "prediction_only": F.col("r") == 0}
    named = F.filter(F.array(*[F.when(c, name) for name, c in checks.items()]), lambda x: x.isNotNull())
    return own.select(F.explode(named).alias("problem"), key)


def paired_strictly(reference: DataFrame, prediction: DataFrame, key: str, text: str) -> DataFrame:
    """Predictions with their reference's text as reference_text; raises unless pair_problems has none."""
    own = reference.groupBy(key).agg(F.any_value(text).alias("reference_text"))
    return held_to(prediction.join(own, key), pair_problems(reference, prediction, key, text))


def looked_up(rows: DataFrame, reference: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with their reference, one row with the numbers of rows matched and skipped); both come from one left join."""
    marked = rows.join(reference.dropDuplicates(keys).withColumn("_found", F.lit(True)), keys, "left")
    counts = marked.agg(F.count("_found").alias("matched"), F.count_if(F.col("_found").isNull()).alias("skipped"))
    return marked.where("_found").drop("_found"), counts


def target_problems(targets: DataFrame, records: DataFrame, key: str, text: str) -> DataFrame:
    """(problem, key): duplicate_target, missing_target, and conflicting_record for targets whose records differ."""
    want = targets.groupBy(key).agg(F.count("*").alias("wanted"))
    have = records.groupBy(key).agg(F.count("*").alias("held"), F.min(F.struct(text)).alias("least"), F.max(F.struct(text)).alias("most"))
    own = want.join(have, key, "left")
    checks = {"duplicate_target": F.col("wanted") > 1, "missing_target": F.col("held").isNull(), "conflicting_record": F.col("held").isNotNull() & ~F.col("least").eqNullSafe(F.col("most"))}
    return own.select(F.explode(F.filter(F.array(*[F.when(c, name) for name, c in checks.items()]), lambda x: x.isNotNull())).alias("problem"), key)


def assignment_violations(responses: DataFrame, key: str, body: str, expected: str, categories: tuple[str, ...], *, index: str = "annotation_index", category: str = "category", field: str = "assignments") -> DataFrame:
    """(key, violations) of JSON answers that give each of some expected ids a category.

    Checks, in order: `schema` (an object with the list alone, of objects with
    the two fields alone), `index` (whole numbers from 0), `repeated`,
    `category` (exactly one of the known) and `ids` (exactly the expected set).
    An answer that fails the schema fails nothing else.
    """
    v = F.try_parse_json(F.col(body))
    rows = responses.select(key, F.array_distinct(expected).alias("want"), v.alias("v"))
    list_ = F.when(kind(F.col("v"), f"$.{field}") == "array", F.try_variant_get("v", f"$.{field}", "array<variant>"))
    rows = rows.withColumn("items", list_)
    items = F.col("items")
    exact = lambda o: F.sort_array(F.json_object_keys(F.to_json(o))) == F.array(*map(F.lit, sorted((index, category))))
    sound = (kind(F.col("v")) == "object") & (F.json_object_keys(F.to_json(F.col("v"))) == F.array(F.lit(field))) & F.forall(items, lambda o: F.coalesce((kind(o) == "object") & exact(o), F.lit(False)))
    ids = F.transform(items, lambda o: F.when(kind(o, f"$.{index}") == "integer", F.try_variant_get(o, f"$.{index}", "bigint")))
    names = F.transform(items, lambda o: F.when(kind(o, f"$.{category}") == "string", F.try_variant_get(o, f"$.{category}", "string")))
    checks = {
        "index": F.exists(ids, lambda i: F.coalesce(i < 0, F.lit(True))),
        "repeated": F.size(F.array_distinct(ids)) < F.size(ids),
        "category": F.exists(names, lambda n: ~F.coalesce(n.isin(*categories), F.lit(False))),
        "ids": F.sort_array(F.array_distinct(F.array_compact(ids))) != F.sort_array(F.col("want").cast("array<bigint>")),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), name) for name, c in checks.items()]), lambda x: x.isNotNull())
    return rows.select(key, F.when(F.coalesce(sound, F.lit(False)), found).otherwise(F.array(F.lit("schema"))).alias("violations"))


def merged_assignments(objects: DataFrame, groups: list[DataFrame], sample: str, index: str, category: str) -> tuple[DataFrame, DataFrame]:
    """(objects with their category, problems): assignments of several groups must cover a sample's objects exactly.

    problems has (sample, index, problem): repeated, missing or unknown.  A
    repeated object keeps the least category.
    """
    given = reduce(DataFrame.unionByName, [g.select(sample, index, F.struct(F.col(category).alias("c")).alias("_c"), F.lit(None).cast("boolean").alias("_own")) for g in groups])
    own = objects.select(sample, index, F.lit(None).cast(given.schema["_c"].dataType).alias("_c"), F.lit(True).alias("_own"))
    whole = own.unionByName(given).groupBy(sample, index).agg(F.count("_c").alias("n"), F.min("_c").alias("_c"), F.max("_own").alias("_own"))
    problem = F.when(F.col("_own").isNull(), "unknown").when(F.col("n") == 0, "missing").when(F.col("n") > 1, "repeated")
    marked = whole.withColumn("problem", problem)
    return marked.where("_own and n > 0").select(sample, index, F.col("_c.c").alias(category)), marked.where("problem is not null").select(sample, index, "problem")


def counted_objects(objects: DataFrame, sample: str, listed: Column, limit: int = 15) -> DataFrame:
    """For each sample its objects, those not listed as harmless, and whether these reach the limit."""
    counted = F.count_if(~F.coalesce(listed, F.lit(False)))
    return objects.groupBy(sample).agg(F.count("*").alias("objects"), counted.alias("counted"), (counted >= limit).alias("rejected"))


#: The outcomes of a batch's items that count as succeeded.
SUCCEEDED = ("safe", "hazard", "warning", "category_pending")


def batch_summary(outcomes: DataFrame, by: list[str], status: str = "status", succeeded: tuple[str, ...] = SUCCEEDED) -> DataFrame:
    """For each batch the numbers of items: all, succeeded, rejected, failed, filtered, and of any other status."""
    s = F.col(status)
    one = lambda name: F.count_if(s == name)
    ok = F.count_if(s.isin(*succeeded))
    parts = [ok.alias("succeeded"), *[one(n).alias(n) for n in ("rejected", "failed", "filtered")]]
    return outcomes.groupBy(*by).agg(F.count("*").alias("items"), *parts, (F.count("*") - ok - one("rejected") - one("failed") - one("filtered")).alias("other"))
