"""One-to-one matching of reference and predicted objects, and joins of records.

Objects are rows (record_index, method, object_index, name, categories, ...);
reference objects stand for every method.  All matches are equi-joins on ranks:
within equal names the n-th reference object takes the n-th prediction, which is
what taking the first free one in order comes to.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.functions.text import cautious_name

# Pairs of names that mean the same; the loose ones extend the strict.
STRICT_SYNONYMS = (("bike", "bicycle"), ("car", "vehicle"))
LOOSE_SYNONYMS = (
    ("barricade", "barrier"), ("fence", "barrier"), ("hole", "pit"), ("manhole", "pit"), ("opening", "pit"), ("pole", "post"),
    ("signpost", "pole"), ("beam", "bar"), ("crossbar", "beam"), ("truck", "vehicle"), ("van", "vehicle"), ("motorcycle", "bike"),
    ("obstacle", "barrier"), ("debris", "brick"), ("rubble", "brick"), ("sign", "board"), ("advertisement", "sign"), ("box", "container"),
    ("bin", "container"), ("trash can", "container"), ("cart", "trolley"), ("pallet truck", "cart"), ("step", "stair"), ("wire", "cable"),
    ("rope", "cable"), ("hydrant", "pipe"), ("antenna", "pole"), ("scaffolding", "barrier"),
)


def synonyms(profile: str = "strict") -> tuple[tuple[str, str], ...]:
    if profile not in ("strict", "loose"):
        raise ValueError("profile must be strict or loose")
    return STRICT_SYNONYMS + (LOOSE_SYNONYMS if profile == "loose" else ())


def stars(pairs: tuple[tuple[str, str], ...]) -> dict[str, tuple[str, bool]]:
    """name: (centre of its star, whether it is the centre).

    Synonym pairs must form stars: one name in all pairs of each connected
    part.  Otherwise greedy matching by ranks isn't maximal, and this raises.
    """
    near: dict[str, set[str]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out: dict[str, tuple[str, bool]] = {}
    for name, others in near.items():
        if len(others) > 1 or (len(near[next(iter(others))]) == 1 and name < next(iter(others))):
            if any(len(near[o]) > 1 for o in others):
                raise ValueError(f"synonyms of {name!r} form no star")
            out[name] = (name, True)
            out |= {o: (name, False) for o in others}
    return out


def star_dimension(spark: SparkSession, profile: str) -> DataFrame:
    """(name, star, central): at most as many rows as the synonym table has names."""
    rows = [(name, star, central) for name, (star, central) in sorted(stars(synonyms(profile)).items())]
    return spark.createDataFrame(rows, "name string, star string, central boolean")


def with_methods(gt: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """Each reference object once for each method."""
    return gt.withColumn("method", F.explode(F.array(*map(F.lit, methods))))


def rank_join(gt: DataFrame, pred: DataFrame, keys: list[str], source: str) -> DataFrame:
    """(record_index, method, gt_index, pred_index, source): n-th with n-th among equal keys."""
    ranked = lambda frame, name: frame.select("record_index", "method", *keys, F.col("object_index").alias(name), F.row_number().over(Window.partitionBy("record_index", "method", *keys).orderBy("object_index")).alias("rank"))
    return ranked(gt, "gt_index").join(ranked(pred, "pred_index"), ["record_index", "method", *keys, "rank"]).select("record_index", "method", "gt_index", "pred_index", F.lit(source).alias("source"))


def exact_matches(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """First tier: equal normalised names that aren't empty."""
    named = lambda frame: frame.withColumn("norm", cautious_name(F.col("name"))).where("norm <> ''")
    return rank_join(named(gt), named(pred), ["norm"], "exact")


def unmatched(objects: DataFrame, pairs: DataFrame, index: str) -> DataFrame:
    taken = pairs.select("record_index", "method", F.col(index).alias("object_index"))
    return objects.join(taken, ["record_index", "method", "object_index"], "left_anti")


def tiered(objects: DataFrame, profile: str, carried: list[str], *, dealt: bool = False) -> DataFrame:
    """Objects of both sides with _source, and _pair: what the matched object of the other side carries.

    objects has record_index, method, _pred (false for reference objects),
    object_index, name and the columns to carry.  They are dealt out once by
    record and method, unless they are dealt out by record, and windows within
    that rank them by name, then those left over by star.  An object is matched
    if the other side has as many of its kind as its rank; rows of equal kind
    and rank are a pair.
    """
    key = ["record_index", "method"]
    stars_ = F.broadcast(star_dimension(objects.sparkSession, profile).withColumnRenamed("name", "_norm"))
    named = objects.withColumn("_norm", cautious_name(F.col("name")))
    placed = (named if dealt else named.repartition(*key)).join(stars_, "_norm", "left").withColumn("_centre", F.col("_pred") != F.col("central"))

    def ranked(frame: DataFrame, kind: list[str], rank: str) -> DataFrame:
        """Adds a rank among a side's objects of one kind, null where the other side has fewer."""
        frame = frame.withColumn(rank, F.row_number().over(Window.partitionBy(*key, *kind, "_pred").orderBy("object_index")))
        count = lambda of: F.count_if(of).over(Window.partitionBy(*key, *kind))
        frame = frame.withColumn("_preds", count(F.col("_pred"))).withColumn("_gts", count(~F.col("_pred")))
        return frame.withColumn(rank, F.when(F.col(rank) <= F.least("_preds", "_gts"), F.col(rank))).drop("_preds", "_gts")

    exact = ranked(placed, ["_norm"], "_first").withColumn("_first", F.when(F.col("_norm") != "", F.col("_first")))
    left = exact.withColumn("_kind", F.when(F.col("_first").isNull(), F.struct("star", "_centre")))
    tiers = ranked(left, ["_kind"], "_second").withColumn("_second", F.when(F.col("_kind.star").isNotNull(), F.col("_second")))
    source = F.when(F.col("_first").isNotNull(), "exact").when(F.col("_second").isNotNull(), "synonym")
    kind = F.when(F.col("_first").isNotNull(), F.col("_norm")).otherwise(F.concat_ws(" ", "star", "_centre"))
    named = tiers.withColumn("_source", source).withColumn("_same", kind).withColumn("_rank", F.coalesce("_first", "_second"))
    other = lambda side: F.max(F.when(F.col("_pred") == side, F.struct("object_index", *carried))).over(Window.partitionBy(*key, "_source", "_same", "_rank"))
    known = F.col("_source").isNotNull() & F.col("record_index").isNotNull() & F.col("method").isNotNull()
    return named.withColumn("_pair", F.when(known, F.when(F.col("_pred"), other(False)).otherwise(other(True))))


def matched_results(gt: DataFrame, pred: DataFrame, profile: str = "strict") -> DataFrame:
    """A row for each reference object: its columns, pred_index, pred_name and source of its match, and detected."""
    part = lambda frame, is_pred, *more: frame.select("record_index", "method", F.lit(is_pred).alias("_pred"), "object_index", "name", *more)
    both = part(gt, False, F.struct(*gt.columns).alias("_gt")).unionByName(part(pred, True), allowMissingColumns=True)
    found = tiered(both, profile, ["name"]).where(~F.col("_pred"))
    return found.select("_gt.*", F.col("_pair.object_index").alias("pred_index"), F.col("_pair.name").alias("pred_name"), F.when(F.col("_pair").isNotNull(), F.col("_source")).alias("source"), F.col("_pair").isNotNull().alias("detected"))


def matched_events(gt: DataFrame, pred: DataFrame, records: DataFrame, profile: str = "strict") -> DataFrame:
    """Events (method, record_index, a, p): matched, missed and surplus objects; SAFE for both where a record has none.

    Records, given by record_index and method, pass through the matching as rows
    without a side, so that objects and records are dealt out together once.
    """
    part = lambda frame, is_pred: frame.select("record_index", "method", F.lit(is_pred).alias("_pred"), "object_index", "name", "categories")
    both = part(gt, False).unionByName(part(pred, True)).unionByName(records.select("record_index", "method"), allowMissingColumns=True)
    found = tiered(both, profile, ["categories"])
    held = F.count("_pred").over(Window.partitionBy("record_index", "method"))
    safe = F.array(F.lit("SAFE"))
    matched = F.col("_pair").isNotNull()
    keep = F.when(F.col("_pred").isNull(), F.col("_objects") == 0).otherwise(~F.col("_pred") | ~matched)
    a = F.when(F.col("_pred").isNull() | F.col("_pred"), safe).otherwise(F.col("categories"))
    p = F.when(F.col("_pred").isNull(), safe).when(F.col("_pred"), F.col("categories")).otherwise(F.coalesce("_pair.categories", safe))
    return found.withColumn("_objects", held).where(keep).select("record_index", "method", a.alias("a"), p.alias("p"))


def matched_sides(gt: DataFrame, pred: DataFrame, columns: list[str], profile: str = "strict") -> DataFrame:
    """(record_index, method, kind, g, p): matched pairs, unmatched_gt and unmatched_pred objects, with some columns of either side."""
    part = lambda frame, is_pred: frame.select("record_index", "method", F.lit(is_pred).alias("_pred"), "object_index", "name", *columns)
    found = tiered(part(gt, False).unionByName(part(pred, True)), profile, columns).where(~F.col("_pred") | F.col("_pair").isNull())
    kind = F.when(F.col("_pred"), "unmatched_pred").when(F.col("_pair").isNull(), "unmatched_gt").otherwise("matched")
    own, other = F.struct(*columns), F.when(F.col("_pair").isNotNull(), F.struct(*[F.col(f"_pair.{c}").alias(c) for c in columns]))
    return found.select("record_index", "method", kind.alias("kind"), F.when(~F.col("_pred"), own).alias("g"), F.when(F.col("_pred"), own).otherwise(other).alias("p"))


def rule_matches(gt: DataFrame, pred: DataFrame, profile: str = "strict") -> DataFrame:
    """(record_index, method, gt_index, pred_index, source): exact names first, synonyms among the rest."""
    slim = gt.select("record_index", "method", "object_index", "name")
    return matched_results(slim, pred, profile).where("detected").select("record_index", "method", F.col("object_index").alias("gt_index"), "pred_index", "source")


def decided_matches(gt: DataFrame, pred: DataFrame, pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds decided pairs (record_index, method, gt_index, pred_index) between objects that no rule has matched."""
    free = lambda objects, index: unmatched(objects, pairs, index).select("record_index", "method", F.col("object_index").alias(index))
    more = decisions.join(free(gt, "gt_index"), ["record_index", "method", "gt_index"]).join(free(pred, "pred_index"), ["record_index", "method", "pred_index"])
    return pairs.unionByName(more.select("record_index", "method", "gt_index", "pred_index", F.lit("decision").alias("source")))


def overridden(pairs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Pairs after manual overrides (ord, record_index, method, gt_index, pred_index or null).

    In their order, each override frees its reference object, and if it names a
    prediction, frees that and pairs the two.  Only records with overrides are
    folded; a record's pairs are as many as its objects.
    """
    key = ["record_index", "method"]
    given = overrides.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("ord", "gt_index", "pred_index"))).alias("changes"))
    pair_type = "array<struct<gt_index:int,pred_index:int,source:string>>"
    typed = pairs.select(*key, F.col("gt_index").cast("int").alias("gt_index"), F.col("pred_index").cast("int").alias("pred_index"), "source")
    held = typed.join(given.select(*key), key, "left_semi").groupBy(*key).agg(F.collect_list(F.struct("gt_index", "pred_index", "source")).alias("own"))

    def step(own: Column, change: Column) -> Column:
        rest = F.filter(own, lambda p: (p["gt_index"] != change["gt_index"]) & (change["pred_index"].isNull() | (p["pred_index"] != change["pred_index"])))
        new = F.array(F.struct(change["gt_index"].cast("int").alias("gt_index"), change["pred_index"].cast("int").alias("pred_index"), F.lit("manual").alias("source")))
        return F.when(change["pred_index"].isNull(), rest).otherwise(F.concat(rest, new))

    folded = given.join(held, key, "left").select(*key, F.inline(F.aggregate("changes", F.coalesce("own", F.array()).cast(pair_type), step)))
    return typed.join(given.select(*key), key, "left_anti").unionByName(folded)


def profile_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """newly_detected, lost or changed_pair for keys in both results, by (record_index, method, object_index)."""
    key = ["record_index", "method", "object_index"]
    a, b = (f.select(*key, F.col("pred_index").alias(n)) for f, n in ((before, "before"), (after, "after")))
    both = a.join(b, key)
    kind = F.when(F.col("before").isNull() & F.col("after").isNotNull(), "newly_detected").when(F.col("before").isNotNull() & F.col("after").isNull(), "lost").when(F.col("before") != F.col("after"), "changed_pair")
    return both.withColumn("change", kind).where("change is not null")


def method_disagreements(results: DataFrame, first: str, second: str) -> DataFrame:
    """Reference objects that one method detects and the other doesn't."""
    one = lambda method: F.max(F.when(F.col("method") == method, F.col("detected")))
    return results.groupBy("record_index", "object_index").agg(one(first).alias("first_detected"), one(second).alias("second_detected")).where("first_detected <> second_detected")


def multiset_matches(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(actual, predicted, n): labels matched as multisets in each record; what is left over meets SAFE."""
    count = lambda frame, name: frame.groupBy("record_index", "method", "label").agg(F.count("*").alias(name))
    both = count(gt, "a").join(count(pred, "b"), ["record_index", "method", "label"], "full").na.fill(0, ["a", "b"])
    cells = F.array(
        F.struct(F.col("label").alias("actual"), F.col("label").alias("predicted"), F.least("a", "b").alias("n")),
        F.struct(F.col("label").alias("actual"), F.lit("SAFE").alias("predicted"), F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("n")),
        F.struct(F.lit("SAFE").alias("actual"), F.col("label").alias("predicted"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("n")),
    )
    return both.select("method", F.inline(cells)).groupBy("method", "actual", "predicted").agg(F.sum("n").alias("n")).where("n > 0")


def aligned(frames: dict[str, DataFrame], key: str, same: str) -> DataFrame:
    """Frames side by side by position; raises where a position is missing in one or `same` differs."""
    renamed = [f.select(key, *[F.col(c).alias(f"{name}_{c}") for c in f.columns if c != key]) for name, f in frames.items()]
    joined = reduce(lambda a, b: a.join(b, key, "full"), renamed)
    names = list(frames)
    agree = reduce(lambda a, b: a & b, [F.col(f"{names[0]}_{same}").eqNullSafe(F.col(f"{n}_{same}")) for n in names[1:]])
    return joined.where(F.when(agree, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("records don't align at "), F.col(key).cast("string"))).cast("boolean")))


def key_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(side, keys): those of a missing in b, and those of b unknown to a."""
    only = lambda x, y, side: x.select(*keys).distinct().join(y.select(*keys), keys, "left_anti").select(F.lit(side).alias("side"), *keys)
    return only(a, b, "missing").unionByName(only(b, a, "unknown"))


def duplicate_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: whether two frames have equal sets of keys."""
    return key_differences(a, b, keys).agg((F.count("*") == 0).alias("same"))


def selected_targets(targets: DataFrame, records: DataFrame) -> DataFrame:
    """For each target its first record, with all source positions and whether their texts conflict."""
    rows = records.groupBy("sample_id").agg(F.min_by("raw_text", "source_index").alias("raw_text"), F.sort_array(F.collect_list("source_index")).alias("source_indices"), (F.countDistinct("raw_text") > 1).alias("conflict"))
    return targets.join(rows, "sample_id", "left")


def top_candidates(candidates: DataFrame, least_iou: float) -> DataFrame:
    """For each object the candidate with the best score, overlap, grounding and then least id, of those that overlap enough."""
    w = Window.partitionBy("object_id").orderBy(F.desc("score"), F.desc("iou"), F.desc("grounding"), "candidate_id")
    return candidates.where(F.col("iou") >= least_iou).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_by_priority(frame: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the given order."""
    return frame.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def assembled(sides: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Keys of several tables with each one's row as a struct, and the names of the sides that lack the key or repeat it.

    All sides go through one shuffle, as one tagged table; a repeated key keeps
    any one of its rows and is named.  A key with a null is one like others.
    """
    tagged = []
    for n, (name, frame) in enumerate(sides.items()):
        own = F.struct(*[c for c in frame.columns if c not in keys])
        others = [F.lit(None).cast(_payload(f, keys)).alias(m) for m, f in sides.items() if m != name]
        tagged.append(frame.select(*keys, F.lit(1 << n).alias("_side"), own.alias(name), *others))
    both = reduce(DataFrame.unionByName, tagged)
    held = {name: F.count_if(F.col("_side") == 1 << n).alias(f"_n_{name}") for n, name in enumerate(sides)}
    whole = both.groupBy(*keys).agg(F.bit_or("_side").alias("_mask"), *held.values(), *[F.any_value(name, True).alias(name) for name in sides])
    named = lambda check: F.filter(F.array(*[F.when(check(n, name), name) for n, name in enumerate(sides)]), lambda x: x.isNotNull())
    missing = named(lambda n, name: F.col("_mask").bitwiseAND(1 << n) == 0)
    return whole.select(*keys, *sides, missing.alias("missing"), named(lambda n, name: F.col(f"_n_{name}") > 1).alias("repeated"))


def _payload(frame: DataFrame, keys: list[str]) -> StructType:
    return StructType([f for f in frame.schema.fields if f.name not in keys])
