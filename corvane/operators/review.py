"""The queue of what people should look at after matching: six kinds of items in one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from corvane.operators.matching import tiered

#: Categories whose objects are looked at in any case.
ELEVATED = ("PIT", "OVERHEAD")
_KEY = ["record_index", "method"]


def matched_objects(gt: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """(record_index, method, gts, preds, pairs): the objects of either side and their pairs as arrays, in order.

    gt and pred have object_index, name and categories; pairs gt_index,
    pred_index and source.  One shuffle by record; a record's objects are few.
    """
    part = lambda frame, side: frame.select(*_KEY, F.lit(side).alias("_side"), F.struct("object_index", "name", "categories").alias("o"))
    own = part(gt, "g").unionByName(part(pred, "p")).unionByName(pairs.select(*_KEY, F.lit("m").alias("_side"), F.struct("gt_index", "pred_index", "source").alias("m")), allowMissingColumns=True)
    held = lambda side, what: F.when(F.col("_side") == side, F.col(what))
    return _collected(own.repartition("record_index"), gts=held("g", "o"), preds=held("p", "o"), pairs=held("m", "m"))


def rule_matched_objects(objects: DataFrame, profile: str = "strict") -> DataFrame:
    """matched_objects of both sides in one frame, with the pairs that the rules make.

    objects has record_index, method, _pred (false for reference objects),
    object_index, name and categories, and is dealt out by record; it isn't
    dealt out again.
    """
    own, pred, pair = F.struct("object_index", "name", "categories"), F.col("_pred"), F.col("_pair")
    made = F.struct(F.col("object_index").alias("gt_index"), pair["object_index"].alias("pred_index"), F.col("_source").alias("source"))
    return _collected(tiered(objects, profile, [], dealt=True), gts=F.when(~pred, own), preds=F.when(pred, own), pairs=F.when(~pred & pair.isNotNull(), made))


def _collected(rows: DataFrame, **columns: Column) -> DataFrame:
    return rows.groupBy(*_KEY).agg(*[F.sort_array(F.collect_list(c)).alias(name) for name, c in columns.items()])


def review_items(gt: DataFrame, pred: DataFrame, pairs: DataFrame, decisions: DataFrame, methods: tuple[str, str], *, decided: str = "decision") -> DataFrame:
    """Items by type of records whose decisions are (record_index, method, status, error); see queued()."""
    records = matched_objects(gt, pred, pairs).join(decisions.select(*_KEY, "status", "error"), _KEY, "left")
    return queued(records, methods, decided=decided)


def queued(records: DataFrame, methods: tuple[str, str], *, decided: str = "decision") -> DataFrame:
    """Items by type, with the columns of that type and null in others, of matched_objects with the status and error of their decision.

    decision_match: pairs that a decision made.  decision_failure: records whose
    decision is unresolved, with what is left over.  pit_overhead: objects of
    elevated categories.  competing_candidates: records with objects left over
    on both sides.  rule_match_sample: a record's pairs by rules.
    detection_disagreement: objects that only one of two methods found.

    All items of a record are made in one row, so that records are read once;
    if they are dealt out by record_index, they stay where they are.
    """
    held = F.col("pairs")
    of = lambda c: records.schema[c].dataType
    index, name, categories = (of("gts").elementType[n].dataType for n in ("object_index", "name", "categories"))
    pred_index, text, flag = of("pairs").elementType["pred_index"].dataType, StringType(), BooleanType()
    fields = {
        "type": text, "method": of("method"), "gt_index": index, "gt_name": name, "pred_index": pred_index, "pred_name": name, "error": of("error"), "unresolved_gt": ArrayType(index), "unresolved_pred": ArrayType(index), "categories": categories, "detected": flag,
        "match_source": text, "rule_matches": of("pairs"), "first_detected": flag, "first_pred_index": pred_index, "second_detected": flag, "second_pred_index": pred_index,
    }

    def item(kind: str, **columns: Column) -> Column:
        given = {"type": F.lit(kind)} | columns
        return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields.items()])

    def item_if(condition: Column, kind: str, **columns: Column) -> Column:
        return F.when(condition, F.array(item(kind, **columns)))

    left = lambda objects, side: F.filter(F.col(objects), lambda o: ~F.exists(held, lambda m: m[side] == o["object_index"]))
    first = lambda found: F.get(found, F.lit(0))
    name_of = lambda objects, at: first(F.filter(F.col(objects), lambda o: o["object_index"] == at))["name"]
    places = lambda c: F.transform(c, lambda o: o["object_index"])
    records = records.withColumns({
        "unresolved_gt": places(left("gts", "gt_index")), "unresolved_pred": places(left("preds", "pred_index")), "made": F.filter(held, lambda m: m["source"] == decided), "rules": F.filter(held, lambda m: m["source"] != decided),
        "found": F.transform("gts", lambda o: F.struct(o.alias("o"), first(F.filter(held, lambda m: m["gt_index"] == o["object_index"])).alias("m"))),
    })
    method, rest = F.col("method"), {"unresolved_gt": F.col("unresolved_gt"), "unresolved_pred": F.col("unresolved_pred")}
    elevated = F.filter("found", lambda f: F.arrays_overlap(f["o"]["categories"], F.array(*map(F.lit, ELEVATED))))
    parts = [
        F.transform("made", lambda m: item("decision_match", method=method, gt_index=m["gt_index"], gt_name=name_of("gts", m["gt_index"]), pred_index=m["pred_index"], pred_name=name_of("preds", m["pred_index"]))),
        item_if(F.col("status") == "unresolved", "decision_failure", method=method, error=F.col("error"), **rest),
        F.transform(elevated, lambda f: item("pit_overhead", method=method, gt_index=f["o"]["object_index"], gt_name=f["o"]["name"], categories=f["o"]["categories"], detected=f["m"].isNotNull(), match_source=F.coalesce(f["m"]["source"], F.lit("unresolved")))),
        item_if((F.size("unresolved_gt") > 0) & (F.size("unresolved_pred") > 0), "competing_candidates", method=method, **rest),
        item_if(F.size("rules") > 0, "rule_match_sample", method=method, rule_matches=F.col("rules")),
    ]
    own = F.transform("found", lambda f: F.struct(f["o"]["object_index"].alias("at"), F.struct(f["m"].isNotNull().alias("detected"), f["m"]["pred_index"].alias("pred_index"), f["o"]["name"].alias("name")).alias("side")))
    by_method = records.select("record_index", "method", F.flatten(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("items"), own.alias("own"))
    seen = lambda m: F.flatten(F.collect_list(F.when(method == m, F.col("own"))))
    whole = by_method.groupBy("record_index").agg(F.flatten(F.collect_list("items")).alias("items"), seen(methods[0]).alias("a"), seen(methods[1]).alias("b"))
    # An object that a method has twice is the one that max() takes.
    side = lambda c, at: F.array_max(F.transform(F.filter(F.col(c), lambda x: x["at"].eqNullSafe(at)), lambda x: x["side"]))
    both = F.transform(F.array_distinct(F.transform("a", lambda x: x["at"])), lambda at: F.struct(at.alias("at"), side("a", at).alias("a"), side("b", at).alias("b")))
    differ = F.filter(both, lambda x: x["a"]["detected"] != x["b"]["detected"])
    named = F.transform(differ, lambda x: item("detection_disagreement", gt_index=x["at"], gt_name=F.coalesce(x["a"]["name"], x["b"]["name"]), first_detected=x["a"]["detected"], first_pred_index=x["a"]["pred_index"], second_detected=x["b"]["detected"], second_pred_index=x["b"]["pred_index"]))
    found = whole.select("record_index", F.inline(F.concat("items", named)))
    return found.select("type", "record_index", *[n for n in fields if n != "type"])
