"""Checks of cached model records: JSON bodies held against the samples they answer.

Bodies are parsed to VARIANT, whose objects keep their keys in order at every
depth; its JSON is thus a canonical form, which digests are taken of.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """What a record may hold."""

    statuses: tuple[str, ...] = ("ok", "review_required", "failed")
    states: tuple[str, ...] = ("hazard_described", "explicitly_safe", "no_extractable_hazard", "ambiguous")
    states_without_objects: tuple[str, ...] = ("explicitly_safe", "no_extractable_hazard")
    hazard_state: str = "hazard_described"
    open_state: str = "ambiguous"
    categories: tuple[str, ...] = ("GROUND", "PIT", "OVERHEAD")
    category_statuses: tuple[str, ...] = ("resolved", "missing", "uncertain")
    most_attempts: int = 3


def canonical(value: Column) -> Column:
    """A JSON value of a VARIANT with the keys of all its objects in order and without white space."""
    return F.to_json(value)


def canonical_text(text: Column) -> Column:
    """The canonical form of a JSON text; null where it isn't JSON."""
    return canonical(F.try_parse_json(text))


def kind(value: Column, path: str = "$") -> Column:
    """The JSON type of what is at a path: object, array, string, integer, number, boolean, null, or SQL null where nothing is."""
    name = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").when(name == "BIGINT", "integer")
        .when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").when(name.isNotNull(), "number")
    )


def identity_digest(**parts: Column) -> Column:
    """SHA-256 of the canonical form of an object of named texts."""
    return F.sha2(canonical_text(F.to_json(F.struct(*[value.alias(name) for name, value in parts.items()]))), 256)


def chain_digest(attempts: Column) -> Column:
    """SHA-256 over an array of VARIANT attempts: each one's digest covers its canonical form and the digest before it."""
    return F.aggregate(F.transform(attempts, canonical), F.lit(""), lambda before, own: F.sha2(F.concat(before, own), 256))


def _text(value: Column, path: str) -> Column:
    """The string at a path; null where there is none, or something else."""
    return F.when(kind(value, path) == "string", F.try_variant_get(value, path, "string"))


def _object_faults(objects: Column, source: Column, rules: Rules) -> dict[str, Column]:
    """Faults of a record's objects, each true if any of them has it."""
    some = lambda check: F.exists(objects, lambda o: F.coalesce(check(o), F.lit(True)))
    names = lambda o: F.try_variant_get(o, "$.categories", "array<string>")
    status = lambda o: _text(o, "$.category_status")
    evidence = lambda o: _text(o, "$.text_evidence")
    ids = F.transform(objects, lambda o: _text(o, "$.object_id"))
    named = F.transform(objects, lambda o: F.struct(F.lower(F.trim(_text(o, "$.name"))).alias("name"), evidence(o).alias("evidence")))
    return {
        "object_incomplete": some(lambda o: (kind(o) != "object") | F.coalesce(*[F.when(F.coalesce(kind(o, f"$.{f}"), F.lit("null")) == "null", True) for f in ("categories", "category_status", "text_evidence", "visual_evidence", "review_status")], F.lit(False))),
        "object_id": some(lambda o: F.coalesce(_text(o, "$.object_id"), F.lit("")) == ""),
        "object_name": some(lambda o: F.trim(F.coalesce(_text(o, "$.name"), F.lit(""))) == ""),
        "object_categories": some(lambda o: (kind(o, "$.categories") != "array") | (F.size(F.array_distinct(names(o))) != F.size(names(o))) | F.exists(names(o), lambda c: ~F.coalesce(c.isin(*rules.categories), F.lit(False)))),
        "object_category_status": some(lambda o: ~status(o).isin(*rules.category_statuses)),
        "object_resolved_empty": some(lambda o: (status(o) == "resolved") & (F.size(names(o)) == 0)),
        "object_unresolved_filled": some(lambda o: (status(o) != "resolved") & (F.size(names(o)) > 0)),
        "object_evidence": some(lambda o: (F.trim(evidence(o)) == "") | ~F.contains(source, evidence(o))),
        "object_id_repeated": F.size(F.array_distinct(ids)) < F.size(ids),
        "object_repeated": F.size(F.array_distinct(named)) < F.size(named),
    }


def record_violations(records: DataFrame, samples: DataFrame, key: str, *, body: str = "body", source: str = "raw_text", equal: tuple[str, ...] = (), rules: Rules = Rules()) -> DataFrame:
    """(key, violations): for each record the names of the checks that it fails, in a fixed order; none if it passes.

    samples has, by key, the text that objects quote (source) and the values
    that the record must repeat (equal, compared as text with the fields of that
    name).  Records of no sample fail `sample`; a body that isn't a JSON object
    fails `not_an_object` alone.  Repeated records are judged each on its own.
    """
    rows = records.select(key, F.try_parse_json(F.col(body)).alias("v"))
    wanted = samples.select(F.col(key).alias("_key"), F.col(source).alias("_source"), *[F.col(c).cast("string").alias(f"_{c}") for c in equal])
    rows = rows.join(wanted, F.col(key) == F.col("_key"), "left")
    v = F.col("v")
    history, objects, attempts = F.try_variant_get(v, "$.attempt_history", "array<variant>"), F.try_variant_get(v, "$.objects", "array<variant>"), F.try_variant_get(v, "$.attempts", "bigint")
    rows = rows.withColumns({"history": history, "objects": F.when(kind(v, "$.objects") == "array", objects), "n": F.when(kind(v, "$.attempts") == "integer", attempts)})
    history, objects, n = F.col("history"), F.col("objects"), F.col("n")
    status, state, raw, error = (_text(v, f"$.{f}") for f in ("status", "scene_text_state", "raw_response", "error"))
    some = F.size(objects) > 0
    numbers = F.transform(history, lambda a: F.try_variant_get(a, "$.attempt", "bigint"))
    last = _text(F.try_element_at(history, F.lit(-1)), "$.raw_response")
    sound_history = (F.size(history) == n) & (numbers == F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n)).otherwise(F.array().cast("array<bigint>")))
    open_error = F.coalesce(kind(v, "$.error"), F.lit("null"))
    faults = {"sample": F.col("_key").isNull()}
    faults |= {c: ~F.try_variant_get(v, f"$.{c}", "string").eqNullSafe(F.col(f"_{c}")) for c in equal}
    faults |= {
        "status": ~status.isin(*rules.statuses),
        "state": ~state.isin(*rules.states),
        "scope_uncertain": kind(v, "$.scope_uncertain") != "boolean",
        "attempts": ~n.between(0, rules.most_attempts),
        "attempt_history": ~sound_history,
        "chain_sha256": ~(_text(v, "$.chain_sha256") == chain_digest(history)),
        "raw_response": ~F.when(n > 0, raw == last).otherwise(raw == ""),
        "error": ~open_error.isin("null", "string"),
        "objects": objects.isNull(),
    }
    faults |= {name: F.coalesce(fault, F.lit(False)) & objects.isNotNull() for name, fault in _object_faults(objects, F.col("_source"), rules).items()}
    failed = status == "failed"
    optional = {
        "safe_with_objects": some & state.isin(*rules.states_without_objects),
        "hazard_without_objects": (F.size(objects) == 0) & (state == rules.hazard_state),
        "failed_not_open": failed & ~F.coalesce((state == rules.open_state) & F.try_variant_get(v, "$.scope_uncertain", "boolean"), F.lit(False)),
        "failed_without_error": failed & (F.coalesce(error, F.lit("")) == ""),
        "generation_empty": ~((open_empty := F.coalesce(kind(v, "$.generation_empty"), F.lit("null"))) == "null") & ~F.coalesce((open_empty == "boolean") & F.try_variant_get(v, "$.generation_empty", "boolean"), F.lit(False)),
    }
    faults = {name: F.coalesce(fault, F.lit(True)) for name, fault in faults.items()} | {name: F.coalesce(fault, F.lit(False)) for name, fault in optional.items()}
    faults |= {f: F.coalesce(kind(v, f"$.{f}") != "string", F.lit(True)) for f in ("human_review_status", "agent_review_status")}
    found = F.filter(F.array(*[F.when(fault, name) for name, fault in faults.items()]), lambda x: x.isNotNull())
    return rows.select(key, F.when(F.coalesce(kind(v), F.lit("")) == "object", found).otherwise(F.array(F.lit("not_an_object"))).alias("violations"))


def log_violations(logs: DataFrame, records: DataFrame, key: str, fields: tuple[str, ...], *, body: str = "body") -> DataFrame:
    """(key, violations): fields in which a log's body differs from its record's, compared in canonical form; `record` where there is none."""
    own = logs.select(key, F.try_parse_json(F.col(body)).alias("l"))
    other = records.select(F.col(key).alias("_key"), F.try_parse_json(F.col(body)).alias("r"))
    at = lambda v, f: canonical(F.try_variant_get(F.col(v), f"$.{f}", "variant"))
    rows = own.join(other, F.col(key) == F.col("_key"), "left")
    differs = F.filter(F.array(*[F.when(~at("l", f).eqNullSafe(at("r", f)), f) for f in fields]), lambda x: x.isNotNull())
    return rows.select(key, F.when(F.col("_key").isNull(), F.array(F.lit("record"))).when(F.coalesce(kind(F.col("l")), F.lit("")) != "object", F.array(F.lit("not_an_object"))).otherwise(differs).alias("violations"))


#: The metrics of a quality payload and their ranges; near_candidate is true or false.
METRIC_RANGES = {"near_fraction": (0.0, 1.0), "near_concentration": (0.0, 1.0), "sky_fraction": (0.0, 1.0), "depth_rgb_edge_correlation": (-1.0, 1.0)}
QUALITY_STATUSES, QUALITY_REASONS = ("passed", "warning", "rejected"), ("near_artifact", "sky_missing")


def revalidated_quality(payloads: DataFrame, key: str, body: str, **thresholds) -> DataFrame:
    """(key, problems, status, reasons, stale) of cached quality payloads: only their metrics are trusted, and the decision is made anew.

    Problems are `fields` (other than status, metrics and reasons, or other
    metrics), `status`, `reasons` and the name of each metric that is no finite
    number in its range.  A payload with problems has no decision; one whose
    stored status or reasons differ from the new ones is stale.  thresholds go
    to quality_decision.
    """
    from corvane.operators.validation import quality_decision

    rows = payloads.select(key, F.try_parse_json(F.col(body)).alias("v"))
    v = F.col("v")
    keys = lambda path: F.sort_array(F.json_object_keys(F.to_json(F.try_variant_get(v, path, "variant"))))
    exactly = lambda names: F.array(*map(F.lit, sorted(names)))
    number = lambda name: F.when(kind(v, f"$.metrics.{name}").isin("integer", "number"), F.try_variant_get(v, f"$.metrics.{name}", "double"))
    reasons = F.when(kind(v, "$.reasons") == "array", F.try_variant_get(v, "$.reasons", "array<variant>"))
    sound = F.forall(reasons, lambda x: F.coalesce((kind(x) == "object") & _text(x, "$.code").isin(*QUALITY_REASONS) & (_text(x, "$.message") != "") & (F.size(F.json_object_keys(F.to_json(x))) == 2), F.lit(False)))
    checks = {
        "fields": (kind(v) == "object") & (keys("$") == exactly(("status", "metrics", "reasons"))) & (kind(v, "$.metrics") == "object") & (keys("$.metrics") == exactly((*METRIC_RANGES, "near_candidate"))),
        "status": _text(v, "$.status").isin(*QUALITY_STATUSES),
        "reasons": sound,
        "near_candidate": kind(v, "$.metrics.near_candidate") == "boolean",
    } | {name: number(name).between(*ends) & ~F.isnan(number(name)) for name, ends in METRIC_RANGES.items()}
    problems = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), name) for name, c in checks.items()]), lambda x: x.isNotNull())
    decision = quality_decision(number("near_fraction"), number("near_concentration"), number("depth_rgb_edge_correlation"), number("sky_fraction"), **thresholds)
    made = rows.select(key, problems.alias("problems"), _text(v, "$.status").alias("_status"), F.transform(reasons, lambda x: _text(x, "$.code")).alias("_codes"), decision.alias("_now"))
    good = F.size("problems") == 0
    same = (F.col("_status") == F.col("_now.status")) & (F.sort_array("_codes") == F.sort_array("_now.reasons"))
    return made.select(key, "problems", F.when(good, F.col("_now.status")).alias("status"), F.when(good, F.col("_now.reasons")).alias("reasons"), F.when(good, ~F.coalesce(same, F.lit(False))).alias("stale"))
