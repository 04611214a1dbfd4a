"""Validators: each returns its rows with a list of violations, or a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.measures import MIRRORED
from corvane.functions.text import CATEGORIES, json_block, tag

# Fixed values.
TEXT_STATES = ("hazard_described", "explicitly_safe", "no_extractable_hazard", "ambiguous")
CATEGORY_STATES = ("resolved", "missing", "uncertain")
FORMAT_ERRORS = ("ImageNameError", "AnnotationMissingError", "AlertFormatError", "MissingEmptyLineError", "UnexpectedExtraLineError", "IncompleteBlockError")


def violations(*checks: tuple[str, Column]) -> Column:
    """Names of the checks that fail; a check that is null fails too."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]))


def object_violations(objects: DataFrame) -> DataFrame:
    """Checks of object records: a name, known unrepeated categories, whole steps from 0, a raw text or none."""
    c, d = F.col("categories"), F.col("distance_steps")
    return objects.withColumn(
        "violations",
        violations(
            ("name", F.trim("name") != ""),
            ("categories", (F.size(c) > 0) & (F.size(F.array_distinct(c)) == F.size(c)) & F.forall(c, lambda x: x.isin(*CATEGORIES))),
            ("distance", d.isNull() | ((d >= 0) & (d == F.floor(d)))),
            ("raw", F.col("distance_raw").isNull() | (F.trim("distance_raw") != "")),
        ),
    )


def direct_state(text: Column) -> Column:
    """What a text's state is without a model: ok states, review_required for a broken wrapper, or null."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    whole = bare.rlike(r"(?is)\A<ALERT>.*?</ALERT>\s*<GUIDE>.*?</GUIDE>\z") & (tag(bare, "ALERT") != "") & (tag(bare, "GUIDE") != "") & ~bare.rlike(r"(?i)<SAFE\s*/>")
    return F.when(bare.rlike(r"(?i)\A<SAFE\s*/>\z"), "explicitly_safe").when(bare == "", "no_extractable_hazard").when(~whole, "review_required")


def extraction_violations(rows: DataFrame) -> DataFrame:
    """Checks of extracted records (text, state, uncertain, objects of name, evidence, categories, category_status)."""
    o = F.col("objects")
    keys = F.transform(o, lambda x: F.concat_ws("\u0001", F.lower(F.trim(x["name"])), x["evidence"]))
    checks = violations(
        ("state", F.col("state").isin(*TEXT_STATES)),
        ("ambiguity", (F.col("state") == "ambiguous") == F.col("uncertain")),
        ("names", F.forall(o, lambda x: F.trim(x["name"]) != "")),
        ("evidence", F.forall(o, lambda x: (F.trim(x["evidence"]) != "") & F.col("text").contains(x["evidence"]))),
        ("categories", F.forall(o, lambda x: F.forall(x["categories"], lambda c: c.isin(*CATEGORIES)))),
        ("category_status", F.forall(o, lambda x: x["category_status"].isin(*CATEGORY_STATES) & ((x["category_status"] != "resolved") | (F.size(x["categories"]) > 0)))),
        ("duplicates", F.size(F.array_distinct(keys)) == F.size(keys)),
        ("objects_of_state", ((F.size(o) == 0) | ~F.col("state").isin("explicitly_safe", "no_extractable_hazard")) & ((F.size(o) > 0) | (F.col("state") != "hazard_described"))),
    )
    ids = F.transform(o, lambda x, i: F.format_string("o%03d", i + 1))
    return rows.withColumn("violations", checks).withColumn("object_ids", ids)


def eligible(rows: DataFrame) -> DataFrame:
    """hazard_eligible and category_eligible: explicit flags, else ok and certain; for categories, all resolved and some."""
    plain = (F.col("status") == "ok") & ~F.col("uncertain")
    resolved = F.forall("objects", lambda x: (x["category_status"] == "resolved") & (F.size(x["categories"]) > 0))
    return rows.withColumn("hazard_eligible", F.coalesce("hazard_flag", plain)).withColumn("category_eligible", F.coalesce("category_flag", plain & resolved))


def pair_violations(rows: DataFrame) -> DataFrame:
    """Checks of pair lists (pairs of gt_index and pred_index, n_gt, n_pred): indices in range and each used once."""
    p = F.col("pairs")
    side = lambda name: F.transform(p, lambda x: x[name])
    once = lambda name: F.size(F.array_distinct(side(name))) == F.size(p)
    inside = F.forall(p, lambda x: (x["gt_index"] >= 0) & (x["gt_index"] < F.col("n_gt")) & (x["pred_index"] >= 0) & (x["pred_index"] < F.col("n_pred")))
    return rows.withColumn("violations", violations(("range", inside), ("gt_once", once("gt_index")), ("pred_once", once("pred_index"))))


def judge_scores(text: Column) -> Column:
    """struct(hazard, guide, format) from the first { to the last } of an answer, or null.

    Numbers are cut to whole ones, digits in quotes count, and all must be from 0 to 10.
    """
    parsed = F.try_parse_json(json_block(text))

    def number(name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
        whole = F.try_variant_get(parsed, f"$.{name}", "string")
        value = F.when(kind == "STRING", F.when(whole.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(whole).try_cast("int"))).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), whole.try_cast("double").cast("int"))
        return F.when((value >= 0) & (value <= 10), value)

    parts = [number(n) for n in ("hazard", "guide", "format")]
    return F.when(parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull(), F.struct(*[p.alias(n) for p, n in zip(parts, ("hazard", "guide", "format"), strict=True)]))


def annotation_violations(rows: DataFrame) -> DataFrame:
    """Checks of complete annotations: hazards with unique ids, boxes inside the image, ASCII names, steps from 1, known directions."""
    h = F.col("hazards")
    ids = F.transform(h, lambda x: x["id"])
    box = lambda x: (x["x"] >= 0) & (x["y"] >= 0) & (x["w"] > 0) & (x["h"] > 0) & (x["x"] + x["w"] <= 1.000001) & (x["y"] + x["h"] <= 1.000001)
    checks = violations(
        ("hazards", F.size(h) > 0),
        ("ids", F.size(F.array_distinct(ids)) == F.size(ids)),
        ("boxes", F.forall(h, box)),
        ("names", F.forall(h, lambda x: x["name"].rlike(r"^[A-Za-z][A-Za-z0-9 _-]*$"))),
        ("distance", F.forall(h, lambda x: x["distance_steps"] >= 1)),
        ("direction", F.forall(h, lambda x: x["direction"].isin(*MIRRORED))),
    )
    return rows.withColumn("violations", checks).withColumn("status_after", F.when((F.col("status") == "completed") & (F.size(checks) > 0), "draft").otherwise(F.col("status")))


def mirror_roles(annotations: DataFrame) -> DataFrame:
    """Roles for images whose name ends in _m from the image without it, where all hazards mirror each other in order."""
    a, m = annotations.alias("a"), annotations.where(F.col("image").endswith("_m")).alias("m")
    turn = F.create_map(*[F.lit(x) for pair in MIRRORED.items() for x in pair])
    joined = m.join(a, F.expr("a.image = substring(m.image, 1, length(m.image) - 2)"))
    same = F.forall(
        F.arrays_zip(F.col("a.hazards").alias("s"), F.col("m.hazards").alias("t")),
        lambda z: (z["t"]["direction"] == turn[z["s"]["direction"]]) & (F.abs(z["t"]["x"] - (1 - z["s"]["x"] - z["s"]["w"])) <= 1e-6) & (F.abs(z["t"]["y"] - z["s"]["y"]) <= 1e-6) & (F.abs(z["t"]["w"] - z["s"]["w"]) <= 1e-6),
    )
    mirrored = (F.size("a.hazards") == F.size("m.hazards")) & F.coalesce(same, F.lit(False))
    return joined.select(F.col("m.image").alias("image"), mirrored.alias("mirrored"), F.when(mirrored, F.transform("a.hazards", lambda x: x["role"])).alias("roles"))


def format_errors(lines: DataFrame) -> DataFrame:
    """(source, error, n): errors of the three-line grammar (image name, annotation, blank) by line number from 1.

    An unterminated last block counts as IncompleteBlockError.
    """
    place = F.pmod(F.col("line_no") - 1, F.lit(3))
    bare = F.trim("line")
    image = bare.rlike(r"(?i)\.(jpg|jpeg|png|bmp)$")
    annotation = bare.rlike(r"(?i)^(<SAFE\s*/>|<ALERT>.*</ALERT>\s*<GUIDE>.*</GUIDE>)$")
    error = F.when((place == 0) & ~image, "ImageNameError").when((place == 1) & (bare == ""), "AnnotationMissingError").when((place == 1) & ~annotation, "AlertFormatError").when((place == 2) & (bare != ""), "MissingEmptyLineError")
    found = lines.select("source", error.alias("error")).where("error is not null")
    ends = lines.groupBy("source").agg(F.max("line_no").alias("n")).where(F.pmod("n", F.lit(3)) != 0).select("source", F.lit("IncompleteBlockError").alias("error"))
    return found.unionByName(ends).groupBy("source", "error").agg(F.count("*").alias("n"))


def quality_decision(near_fraction: Column, near_concentration: Column, correlation: Column, sky_fraction: Column, mode: str = "reject", *, most_near: float = 0.05, least_concentration: float = 0.8, least_correlation: float = 0.1, least_sky: float = 0.01) -> Column:
    """struct(status, reasons) from the figures of an image; mode is reject, warn or off."""
    if mode not in ("reject", "warn", "off"):
        raise ValueError("mode must be reject, warn or off")
    candidate = (near_fraction > 0) & (near_fraction <= most_near) & (near_concentration >= least_concentration)
    reasons = F.array_compact(F.array(F.when(candidate & (correlation < least_correlation), F.lit("near_artifact")), F.when(sky_fraction < least_sky, F.lit("sky_missing"))))
    outcome = {"reject": "rejected", "warn": "warning", "off": "passed"}[mode]
    return F.struct(F.when(F.size(reasons) == 0, "passed").otherwise(outcome).alias("status"), reasons.alias("reasons"))


def leaks(prompt: Column, forbidden: Column) -> Column:
    """Whether a prompt contains a forbidden word of at least one character."""
    return (forbidden != "") & F.lower(prompt).contains(F.lower(forbidden))


def variant_parity(first: DataFrame, second: DataFrame, phrase: str) -> DataFrame:
    """One row: rows on one side only, images that differ, texts with a leaked phrase and answers that differ, by position."""
    side = lambda rows: rows.select("position", "image", "answer", F.col("text").contains(phrase).alias("has_phrase"))
    joined = side(first).alias("f").join(side(second).alias("s"), "position", "full")
    return joined.agg(
        F.count_if(F.col("f.image").isNull() | F.col("s.image").isNull()).alias("one_sided"),
        F.count_if(F.col("f.image") != F.col("s.image")).alias("other_images"),
        F.count_if(F.col("f.has_phrase") | F.col("s.has_phrase")).alias("leaked"),
        F.count_if(F.col("f.answer") != F.col("s.answer")).alias("other_answers"),
    )


def first_reason(*reasons: tuple[str, Column]) -> Column:
    """The name of the first condition that holds, or accepted."""
    out = F.lit("accepted")
    for name, when in reversed(reasons):
        out = F.when(when, F.lit(name)).otherwise(out)
    return out
