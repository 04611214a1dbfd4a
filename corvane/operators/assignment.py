"""Minimum-cost one-to-one assignment within samples, and the name rules that allow a pair.

Samples are dealt out by key; a sample's objects are few, so each is solved by
itself in a grouped task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import simple_name, token_jaccard, token_subset

# Classes of names that mean the same; where a name is in two, the later class counts.
NAME_CLASSES = (
    ("traffic cone", ("traffic cone", "cone", "cones", "red cone", "red cones", "red traffic cone", "red traffic cones", "orange cone", "orange cones", "construction cone", "construction cones")),
    ("barrier", ("barrier", "barriers", "construction barrier", "construction barriers", "barrier tape", "tape", "striped barrier", "striped barriers", "green-and-white striped barrier", "green-and-white striped barriers", "fence", "fences", "low fence", "low fences", "hoop barrier", "hoop barriers", "iron barrier", "iron barriers", "concrete barrier", "concrete barriers", "construction fence", "construction fences", "green construction barrier", "green construction barriers", "red-and-white barrier", "red-and-white barriers", "red-and-white barrier post", "red-and-white barrier posts", "low concrete barrier", "low concrete barriers", "bicycle rack", "bicycle racks", "gate", "gates", "metal gate", "metal gate with vertical bars", "barrier rope", "rope barrier")),
    ("construction area", ("construction area", "construction site", "construction", "construction zone")),
    ("construction workers", ("construction worker", "construction workers", "worker", "workers")),
    ("construction machinery", ("construction machinery", "machinery", "machine", "machines")),
    ("open manhole", ("open manhole", "manhole", "missing manhole cover", "pothole", "potholes", "large hole in the pavement", "tree pit", "hole in the pavement")),
    ("manhole cover", ("manhole cover", "open manhole cover", "manhole cover missing")),
    ("construction pit", ("construction pit", "pit", "construction pits", "pits")),
    ("hole", ("hole", "holes", "ditch", "ditches", "trench", "trenches")),
    ("car", ("car", "cars", "vehicle", "vehicles", "parked car", "parked cars", "small vehicle", "small vehicles", "electric vehicle", "electric vehicles", "minivan", "white minivan", "small truck", "truck", "trucks", "pickup truck", "pickup trucks")),
    ("bicycle", ("bicycle", "bicycles", "bike", "bikes", "bicyclist", "bicycle rider", "electric bicycle", "electric bicycles", "e-bike", "e-bikes", "motorcycle", "motorcycles", "scooter", "scooters", "electric scooter", "electric scooters", "parked scooter", "parked scooters", "electric tricycle", "electric tricycles", "tricycle", "tricycles", "two-wheeler", "two-wheelers")),
    ("pole", ("pole", "poles", "utility pole", "utility poles", "antenna pole", "antenna poles", "post", "posts", "blue pole", "lamppost", "lampposts", "signpost", "signposts", "streetlight pole", "streetlight poles", "column", "columns", "raking column", "concrete column", "support pillar", "pillar", "pillars", "overhanging pillar", "overhanging structure", "overhanging support pillar")),
    ("pile of debris", ("pile of debris", "debris pile", "debris", "pile of bricks", "pile of soil", "piles of soil", "piles of soil and bricks", "pile of bricks and soil", "debris on the ground", "wooden debris", "wooden boards", "broken pavement with debris", "cracked pavement with debris", "construction debris", "pile of construction debris", "large pile of debris", "rusty cart with debris", "brick", "bricks", "construction materials", "pavement debris", "broken pavement", "cracked pavement", "pile of debris and bricks")),
    ("suspended chain", ("suspended chain", "chain", "hanging chain", "yellow caution tape", "caution tape", "warning tape", "barrier rope", "rope barrier")),
    ("outdoor unit", ("outdoor unit", "air conditioner unit", "air conditioner", "ac unit", "low-hanging air conditioner unit", "low-hanging ac unit")),
    ("trash can", ("trash can", "trash cans", "garbage can", "garbage cans", "bin", "bins", "waste bin", "waste bins", "dustbin", "dustbins", "trash bag", "trash bags", "garbage bag", "garbage bags")),
    ("tree", ("tree", "trees", "tree trunk", "tree trunks", "trunk", "trunks")),
    ("sign", ("sign", "signs", "signboard", "signboards", "signage", "sandwich board", "sandwich boards", "signpost", "signposts")),
    ("pedestrian", ("pedestrian", "pedestrians", "person", "people", "persons")),
    ("traffic cone and barrier", ("traffic cone and barrier", "traffic cones and barriers", "cones and barriers", "cone and barrier")),
)


def name_classes(spark, classes=NAME_CLASSES) -> DataFrame:
    """(norm, class): one row for each normalised name."""
    rows = spark.createDataFrame([(at, name, own) for at, (name, names) in enumerate(classes) for own in names], "ord int, class string, name string")
    return rows.select("ord", "class", simple_name(F.col("name")).alias("norm")).groupBy("norm").agg(F.max_by("class", "ord").alias("class"))


def with_classes(objects: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds norm, class and the classes that have a name (of three letters or more) among the words of norm."""
    named = objects.withColumn("norm", simple_name(F.col("name")))
    words = F.split("norm", " ")
    longest = classes.agg(F.max(F.size(F.split("norm", " ")))).first()[0] or 1
    # Every run of words of a name, up to the longest known one: an equi-join instead of a scan of all known names.
    runs = F.array_distinct(F.flatten(F.transform(words, lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - i)), lambda n: F.array_join(F.slice(words, i + 1, n), " ")))))
    distinct = named.select("norm").distinct()
    inner = distinct.select("norm", F.explode(runs).alias("part")).join(F.broadcast(classes.where(F.length("norm") >= 3).withColumnRenamed("norm", "part").withColumnRenamed("class", "inner_class")), "part").groupBy("norm").agg(F.sort_array(F.collect_set("inner_class")).alias("inner_classes"))
    placed = distinct.join(F.broadcast(classes), "norm", "left").join(inner, "norm", "left")
    return named.join(placed, "norm", "left")


def compatible(a: str, b: str) -> Column:
    """Whether names may match: equal, of one class, holding a name of the other's class, or with enough words in common."""
    n = lambda side, c: F.col(f"{side}_{c}")
    named = (n(a, "name") != "") & (n(b, "name") != "") & (n(a, "name") != "not_mentioned") & (n(b, "name") != "not_mentioned")
    holds = lambda x, y: F.coalesce(F.array_contains(n(y, "inner_classes"), n(x, "class")), F.lit(False))
    words = F.coalesce(token_jaccard(n(a, "norm"), n(b, "norm")) >= 0.4, F.lit(False)) | token_subset(n(a, "norm"), n(b, "norm"))
    return F.coalesce(named, F.lit(False)) & ((n(a, "norm") == n(b, "norm")) | F.coalesce(n(a, "class") == n(b, "class"), F.lit(False)) | holds(a, b) | holds(b, a) | words)


def candidate_edges(gt: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gt_index, pred_index, cost): compatible pairs of each sample; cost 2 (1 - Jaccard of categories), 0 if a side has none.

    Both sides have name, object_index and categories.  Pairs are made within a
    sample only, by an equi-join on its keys.
    """
    classes = name_classes(gt.sparkSession)
    side = lambda frame, s: with_classes(frame, classes).select(*keys, *[F.col(c).alias(f"{s}_{c}") for c in ("object_index", "name", "norm", "class", "inner_classes", "categories")])
    both = side(gt, "g").join(side(pred, "p"), keys).where(compatible("g", "p"))
    g, p = F.array_distinct(F.col("g_categories")), F.array_distinct(F.col("p_categories"))
    cost = F.when((F.size(g) > 0) & (F.size(p) > 0), 2 * (1 - F.size(F.array_intersect(g, p)) / F.size(F.array_union(g, p)))).otherwise(0.0)
    return both.select(*keys, F.col("g_object_index").alias("gt_index"), F.col("p_object_index").alias("pred_index"), cost.alias("cost"))


def competing(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with `competing`: their object, on either side, has two or more edges of its least cost."""
    def flag(side: str) -> Column:
        w = Window.partitionBy(*keys, side)
        return F.col("cost") - F.min("cost").over(w)

    near = edges.withColumn("g_gap", flag("gt_index")).withColumn("p_gap", flag("pred_index"))
    many = lambda side, gap: F.sum((F.abs(gap) < 1e-12).cast("int")).over(Window.partitionBy(*keys, side)) > 1
    return near.withColumn("competing", many("gt_index", F.col("g_gap")) | many("pred_index", F.col("p_gap"))).drop("g_gap", "p_gap")


def solve(cost: np.ndarray) -> list[int]:
    """For each row the column it gets: the least total over complete assignments of the shorter side; -1 for none.

    Shortest augmenting paths with potentials, on whole-number costs.
    """
    n, m = cost.shape
    if n > m:
        back = solve(cost.T)
        out = [-1] * n
        for column, row in enumerate(back):
            if row >= 0:
                out[row] = column
        return out
    rows, columns = [0] * (n + 1), [0] * (m + 1)
    owner = [0] * (m + 1)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, came, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[at]:
            used[at] = True
            step, nearest = float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    slack = int(cost[owner[at] - 1, j - 1]) - rows[owner[at]] - columns[j]
                    if slack < least[j]:
                        least[j], came[j] = slack, at
                    if least[j] < step:
                        step, nearest = least[j], j
            for j in range(m + 1):
                if used[j]:
                    rows[owner[j]] += step
                    columns[j] -= step
                else:
                    least[j] -= step
            at = nearest
        while at:
            owner[at] = owner[came[at]]
            at = came[at]
    out = [-1] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def _parts(edges: list[tuple[int, int, float]]) -> list[list[tuple[int, int, float]]]:
    """Edges by connected component of their objects."""
    root: dict[tuple[str, int], tuple[str, int]] = {}

    def find(node: tuple[str, int]) -> tuple[str, int]:
        root.setdefault(node, node)
        while root[node] != node:
            root[node] = node = root[root[node]]
        return node

    for a, b, _ in edges:
        root[find(("g", a))] = find(("p", b))
    out: dict[tuple[str, int], list] = {}
    for edge in edges:
        out.setdefault(find(("g", edge[0])), []).append(edge)
    return list(out.values())


def _best_pairs(edges: list[tuple[int, int, float]], solver: Callable = solve) -> list[tuple[int, int]]:
    """The pairs of one component's edges (gt_index, pred_index, cost): the most pairs, then the least cost, then ties.

    Among equal sums the first reference object gets the lowest prediction it
    can, then the second one, and so on.
    """
    g, p = sorted({e[0] for e in edges}), sorted({e[1] for e in edges})
    g_at, p_at = {x: i for i, x in enumerate(g)}, {x: i for i, x in enumerate(p)}
    exact = [_ratio(c) for _, _, c in edges]
    unit = math.lcm(*[c.denominator for c in exact])
    base = len(p) + 1
    tie = base ** len(g)  # more than all digits together
    # A barred place costs more than the dearest full set of pairs.
    barred = (int(max(abs(c) for c in exact) * unit) + 2) * tie * (2 * min(len(g), len(p)) + 1)
    cost = np.full((len(g), len(p)), barred, dtype=object)
    for (a, b, _), c in zip(edges, exact, strict=True):
        cost[g_at[a], p_at[b]] = int(c * unit) * tie + base ** (len(g) - 1 - g_at[a]) * p_at[b]
    return [(g[i], p[j]) for i, j in enumerate(solver(cost)) if j >= 0 and cost[i, j] < barred]


def _ratio(cost: float, most: int = 10_000) -> Fraction:
    """The ratio of whole numbers that a cost stands for; costs that are none of small denominators are refused."""
    found = Fraction(cost).limit_denominator(most)
    if abs(float(found) - cost) > 1e-12 * max(1.0, abs(cost)):
        raise ValueError(f"{cost} is no ratio with a denominator of at most {most}")
    return found


def _assign_sorted(keys: list[str], solver: Callable):
    """Solves samples whose rows follow each other, over the borders of batches."""

    def pairs(key: list, held: list) -> list[tuple]:
        return [(*key, *pair) for part in _parts(held) for pair in _best_pairs(part, solver)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for frame in frames:
            out: list[tuple] = []
            for *key, a, b, c in frame[[*keys, "gt_index", "pred_index", "cost"]].itertuples(index=False, name=None):
                if key != now:
                    out += pairs(now, held) if held else []
                    now, held = key, []
                held.append((a, b, c))
            yield pd.DataFrame(out, columns=[*keys, "gt_index", "pred_index"])
        if held:
            yield pd.DataFrame(pairs(now, held), columns=[*keys, "gt_index", "pred_index"])

    return run


def assigned(edges: DataFrame, keys: list[str], solver: Callable = solve) -> DataFrame:
    """(keys, gt_index, pred_index): in each sample as many pairs as can be, at the least total cost.

    An edge that both its objects have alone is a pair without more ado; the
    rest of the samples are cut into connected components and solved in Python
    tasks, many in each.  solver takes a matrix of whole-number costs and gives
    each row's column, or -1; `solve` is exact.  Costs are ratios of whole numbers
    with denominators up to 10,000, which are compared exactly; others raise.
    """
    kinds = dict(edges.dtypes)
    alone = lambda side: F.count("*").over(Window.partitionBy(*keys, side)) == 1
    marked = edges.withColumn("_alone", alone("gt_index") & alone("pred_index"))
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", gt_index {kinds['gt_index']}, pred_index {kinds['pred_index']}"
    rest = marked.where(~F.col("_alone")).select(*keys, "gt_index", "pred_index", "cost")
    solved = rest.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_assign_sorted(keys, solver), schema)
    return marked.where("_alone").select(*keys, "gt_index", "pred_index").unionByName(solved)
