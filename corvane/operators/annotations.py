"""Work lists of an annotation team: filters, what is next, progress, names in use, and judges' verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import json_block


def filtered(rows: DataFrame, status: str | None = None, role_status: str | None = None, *, columns: tuple[str, str] = ("status", "role_status")) -> DataFrame:
    """Rows of a status and a role status; None lets all through, and a null counts as the status `unstarted`."""
    for column, wanted in zip(columns, (status, role_status), strict=True):
        if wanted is not None:
            rows = rows.where(F.coalesce(F.col(column), F.lit("unstarted")) == wanted)
    return rows


def next_open(rows: DataFrame, series: str, order: str, open_: Column) -> DataFrame:
    """Adds next_open: the place of the next open row of the series after each one, from the start again after the last; null where none is."""
    place = F.when(open_, F.col(order))
    after = Window.partitionBy(series).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("next_open", F.coalesce(F.min(place).over(after), F.min(place).over(Window.partitionBy(series))))


def progress(rows: DataFrame, by: list[str], status: Column, role_done: Column) -> DataFrame:
    """For each set its rows: all, completed, draft, unstarted (null too), and completed ones whose roles are still open."""
    is_ = lambda name: F.count_if(F.coalesce(status, F.lit("unstarted")) == name).alias(name)
    pending = (status == "completed") & ~F.coalesce(role_done, F.lit(False))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), is_("completed"), is_("draft"), is_("unstarted"), F.count_if(pending).alias("role_pending"))


def folded_names(rows: DataFrame, name: str) -> DataFrame:
    """(folded, name, n): names that differ in case only are one, shown by the least spelling; blank ones are left out."""
    own = rows.where(F.trim(name) != "")
    return own.groupBy(F.lower(F.trim(name)).alias("folded")).agg(F.min(F.trim(name)).alias("name"), F.count("*").alias("n"))


def summed(rows: DataFrame, by: list[str], counters: str) -> DataFrame:
    """(by, counter, total) of a map column of counters, added up over records; a null count is 0."""
    each = rows.select(*by, F.explode(counters).alias("counter", "count"))
    return each.groupBy(*by, "counter").agg(F.sum(F.coalesce("count", F.lit(0))).alias("total"))


def win_counts(rows: DataFrame, by: list[str], verdict: str, *, strict: bool = False) -> DataFrame:
    """first and second wins of a judge's verdicts "1" and "2", and invalid ones, nulls too; strict raises where there is one."""
    v = F.trim(verdict)
    known = F.coalesce(v.isin("1", "2"), F.lit(False))
    if strict:
        rows = rows.where(F.when(known, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no verdict: "), F.coalesce(v, F.lit("null")))).cast("boolean")))
    return rows.groupBy(*by).agg(F.count_if(v == "1").alias("first"), F.count_if(v == "2").alias("second"), F.count_if(~known).alias("invalid"))


def pair_list(text: Column, *, tolerant: bool = False) -> Column:
    """array of (gt_index, pred_index) of a JSON answer {"pairs": [...]}, or null where it isn't one.

    The object has that field alone, its items just these two whole numbers from
    0.  A tolerant reader takes the text from the first { to the last }, and
    leaves out items that are wrong or use an index again.
    """
    # Each step is bound to a name of a lambda function, so that it is evaluated once and not wherever it is used.
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    number = lambda v: F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "int"))
    fields = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    good = lambda p: F.coalesce((p["gt_index"] >= 0) & (p["pred_index"] >= 0), F.lit(False))
    bare = lambda p: F.struct(p["gt_index"].alias("gt_index"), p["pred_index"].alias("pred_index"))

    def read(item: Column) -> Column:
        """An item's two numbers, null where they aren't whole, and whether it has no other field."""
        return F.struct(*[number(F.try_element_at(item, F.lit(n))).alias(n) for n in ("gt_index", "pred_index")], F.coalesce(F.size(item) == 2, F.lit(False)).alias("exact"))

    def first_ones(pairs: Column) -> Column:
        """The first of pairs that share an index, in the order of the answer."""
        step = lambda out, p: F.when(F.exists(out, lambda q: (q["gt_index"] == p["gt_index"]) | (q["pred_index"] == p["pred_index"])), out).otherwise(F.concat(out, F.array(bare(p))))
        return F.aggregate(F.filter(pairs, good), F.array().cast("array<struct<gt_index:int,pred_index:int>>"), step)

    def whole(pairs: Column) -> Column:
        single = lambda f: F.size(F.array_distinct(F.transform(pairs, lambda p: p[f]))) == F.size(pairs)
        sound = F.forall(pairs, lambda p: p["exact"] & good(p)) & single("gt_index") & single("pred_index")
        return F.when(F.coalesce(sound, F.lit(False)), F.transform(pairs, bare))

    def answer(found: Column) -> Column:
        items = F.transform(F.try_variant_get(F.try_element_at(found, F.lit("pairs")), "$", "array<variant>"), lambda o: once(fields(o), read))
        return first_ones(items) if tolerant else F.when(F.size(found) == 1, once(items, whole))

    return once(fields(F.try_parse_json(json_block(text) if tolerant else text)), answer)
