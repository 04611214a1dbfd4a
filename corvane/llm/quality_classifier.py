"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated.

Each text becomes a fixed set of statistics.  Random Fourier features of these,
once standardised, approximate a Gaussian kernel.  Every partition sums its part
of the normal equations, for each fold; the sums of all partitions are small and
are solved on the driver.  Each fold is scored by the model of the other folds,
and isotonic regression of the labels on these scores calibrates the final one.

Statistics and features are rounded to whole numbers, so that all sums are exact
and nothing depends on how rows are dealt out over partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.textkit import batches_of, by_text, checkpointed, lower_ascii, numbered_words, partitions, slices, word_spans

#: Features, width of the kernel in standard deviations, and the seed that both are drawn with.
FEATURES, WIDTH, SEED = 256, 6.0, 7
#: Weight of the ridge penalty, as a share of the labelled rows.
RIDGE = 1e-4
#: Folds of labelled rows: each is scored by the model of the others for the calibration.
FOLDS = 4
#: Units of a statistic and of a feature, and cells that scores are calibrated in, for each unit of score.
STAT_UNIT, FEATURE_UNIT, SCORE_UNIT = 1024, 1024, 1024
#: From this score on the prediction is 1.
THRESHOLD = 0.3

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_spread", "longest_word", "digits", "capitals", "symbols", "other_marks", "sentence_ends", "non_ascii", "white_space",
    "log_lines", "words_a_line", "repeated_lines", "ended_lines", "distinct_words", "echoed_words", "repeated_pairs", "commonest_word", "lone_marks", "marked_words", "capital_words", "one_letter_words",
)


def _class(characters: str) -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    table[list(characters.encode())] = 1
    return table


_DIGIT, _CAPITAL, _SYMBOL, _OTHER, _END = _class("0123456789"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("#*$%&|<>@{}[]\\^~_=+`"), _class("()\"'/:;,-"), _class(".!?")
_HIGH, _TAIL, _BLANK, _LINE = (np.arange(256) >= 0x80).astype(np.int64), ((np.arange(256) & 0xC0) == 0x80).astype(np.int64), _class(" \t\n\r\v\f"), _class("\n")
_LETTER = np.array([chr(b).isalnum() or b >= 0x80 for b in range(256)])
_BREAK = np.zeros(256, dtype=bool)
_BREAK[0x0A] = True


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[edges[1:]] - total[edges[:-1]]


def _repeats(owner: np.ndarray, value: np.ndarray, count: int) -> np.ndarray:
    """For each text its items that equal an earlier one."""
    if not len(owner):
        return np.zeros(count, np.int64)
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    return np.bincount(o[1:][(o[1:] == o[:-1]) & (v[1:] == v[:-1])], minlength=count)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The STATISTICS of each text of a UTF-8 buffer, a row each, in units of 1 / STAT_UNIT."""
    count = len(offsets) - 1
    of = lambda table: _sums(table[data], offsets)
    share = lambda part, whole: part / np.maximum(whole, 1)
    starts, ends, owner = word_spans(data, offsets)
    edges = by_text(owner, count)
    words = np.diff(edges)
    inner = np.concatenate(([0], np.cumsum(_TAIL[data])))
    length = (ends - starts) - (inner[ends] - inner[starts])  # in characters
    _, number = numbered_words(lower_ascii(data), starts, ends) if len(starts) else (None, np.zeros(0, np.int64))
    number = number.astype(np.int64)
    chars, letters = of(1 - _TAIL), _sums(length, edges)
    mean = share(letters, words)
    spread = np.sqrt(np.maximum(share(_sums(length * length, edges), words) - mean * mean, 0))
    longest = np.zeros(count, np.int64)
    held = np.flatnonzero(words)
    if len(held):
        longest[held] = np.maximum.reduceat(length, edges[:-1][held])
    key = owner * (number.max(initial=0) + 1) + number
    each, times = np.unique(key, return_counts=True)
    most = np.zeros(count, np.int64)
    np.maximum.at(most, each // (number.max(initial=0) + 1), times)
    kinds = np.bincount(each // (number.max(initial=0) + 1), minlength=count)
    near = owner[1:] == owner[:-1]
    echoed = np.bincount(owner[1:][near & (number[1:] == number[:-1])], minlength=count)
    pairs = np.bincount(owner[1:][near], minlength=count)
    again = _repeats(owner[1:][near], (number[:-1] * (number.max(initial=0) + 1) + number[1:])[near], count)
    marks = np.concatenate(([0], np.cumsum(_LETTER[data])))
    plain = (marks[ends] - marks[starts]) > 0
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    first = data[starts] if len(starts) else np.zeros(0, np.uint8)
    lone = np.bincount(owner[~plain], minlength=count)
    marked = np.bincount(owner[plain & (_SYMBOL[last] > 0)], minlength=count)
    raised = np.bincount(owner[_CAPITAL[first] > 0], minlength=count)
    single = np.bincount(owner[(length == 1) & plain], minlength=count)
    a, b, line_owner = word_spans(data, offsets, _BREAK)  # lines that aren't empty
    lines = np.bincount(line_owner, minlength=count)
    _, line = numbered_words(data, a, b) if len(a) else (None, np.zeros(0, np.int64))
    ended = np.bincount(line_owner[_END[data[b - 1]] > 0], minlength=count) if len(a) else np.zeros(count, np.int64)
    found = (
        np.log1p(chars), np.log1p(words), mean, spread, np.log1p(longest), share(of(_DIGIT), chars), share(of(_CAPITAL), chars), share(of(_SYMBOL), chars), share(of(_OTHER), chars), share(of(_END), words), share(of(_HIGH) - of(_TAIL), chars), share(of(_BLANK), chars),
        np.log1p(of(_LINE)), np.log1p(share(words, lines)), share(_repeats(line_owner, line.astype(np.int64), count), lines), share(ended, lines), share(kinds, words), share(echoed, words), share(again, pairs), share(most, words), share(lone, words), share(marked, words), share(raised, words), share(single, words),
    )
    return np.rint(np.minimum(np.stack(found, axis=1), 1000) * STAT_UNIT).astype(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel(), pa.int64()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _statistic_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches):
        columns = [*(rows.column(i) for i in range(rows.num_columns) if rows.schema.names[i] != "text"), _lists(statistics(data, offsets))]
        yield pa.RecordBatch.from_arrays(columns, names=[*(n for n in rows.schema.names if n != "text"), "stats"])


def document_statistics(docs: DataFrame, *, key: str = "doc_id", text: str = "text", columns: dict[str, Column] | None = None) -> DataFrame:
    """key, further columns, and stats: the STATISTICS of every whole text, as whole numbers."""
    rows = docs.select(F.col(key).alias("id"), *[c.alias(n) for n, c in (columns or {}).items()], F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return batches_of(rows, _statistic_rows, f"{schema}, stats array<bigint>").withColumnRenamed("id", key)


@dataclass(frozen=True)
class Kernel:
    """Standardisation of the statistics and the random directions and phases of the features."""

    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    @staticmethod
    def of(mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED) -> Kernel:
        draws = np.random.default_rng(seed)
        return Kernel(mean, np.where(spread > 0, spread, 1.0), draws.normal(size=(len(mean), features)) / width, draws.uniform(0, 2 * np.pi, features))

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Whole numbers: a constant, and the cosines in units of 1 / FEATURE_UNIT."""
        x = np.clip((stats - self.mean) / self.spread, -6, 6)
        z = np.rint(np.cos(x @ self.directions + self.phases) * FEATURE_UNIT)
        return np.concatenate([np.full((len(z), 1), float(FEATURE_UNIT)), z], axis=1)


def _equations(kernel: Kernel, folds: int):
    """A partition's sums: for each fold and row of the normal equations that row, right side last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(kernel.phases) + 1
        total = np.zeros((folds, size, size + 1), np.int64)
        for batch in batches:
            z = kernel.features(_matrix(batch["stats"], len(kernel.mean)))
            y = np.rint(batch["label"].to_numpy(zero_copy_only=False) * FEATURE_UNIT)
            fold = batch["fold"].to_numpy(zero_copy_only=False)
            for f in range(folds):
                own = fold == f
                # Products of whole numbers under 2 ** 21, of one batch: exact in doubles.
                total[f] += np.rint(z[own].T @ np.concatenate([z[own], y[own, None]], axis=1)).astype(np.int64)
        for f in range(folds):
            if total[f].any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, f)), pa.array(np.arange(size)), _lists(total[f])], names=["fold", "row", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the sums of equal (fold, row); a task holds one for each of these keys, of which there are few."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        if batch.num_rows:
            sums = _matrix(batch["sums"], len(batch["sums"][0]))
            for key, own in zip(zip(batch["fold"].to_pylist(), batch["row"].to_pylist(), strict=True), sums, strict=True):
                held[key] = held[key] + own if key in held else own.copy()
    if held:
        keys = sorted(held)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), _lists(np.stack([held[k] for k in keys]))], names=["fold", "row", "sums"])


def _solved(total: np.ndarray, ridge: float) -> np.ndarray:
    """The weights of the features, for features and labels in units of FEATURE_UNIT."""
    a = total[:, :-1].astype(float) / FEATURE_UNIT**2
    penalty = np.eye(len(a)) * ridge * max(a[0, 0], 1.0)  # a[0, 0] counts the rows
    penalty[0, 0] = 1e-9
    return np.linalg.solve(a + penalty, total[:, -1].astype(float) / FEATURE_UNIT**2)


def isotonic(scores: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over rising scores: the mean score and the rising mean label of each pool."""
    pools: list[list[float]] = []
    for s, n, y in zip(scores.tolist(), counts.tolist(), sums.tolist(), strict=True):
        pools.append([s * n, n, y])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    at = np.array(pools, float).reshape(-1, 3)
    return at[:, 0] / at[:, 1], at[:, 2] / at[:, 1]


@dataclass(frozen=True)
class Model:
    """A fitted classifier; without labels kernel is None and every score 0.5."""

    kernel: Kernel | None
    weights: np.ndarray
    points: np.ndarray
    values: np.ndarray

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(stats), 0.5)
        return np.interp(_cells(self.kernel, self.weights, stats) / SCORE_UNIT, self.points, self.values)


def _cells(kernel: Kernel, weights: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Uncalibrated scores from -1 to 2, in whole units of 1 / SCORE_UNIT."""
    raw = kernel.features(stats) @ weights / FEATURE_UNIT
    return np.rint(np.clip(raw, -1, 2) * SCORE_UNIT).astype(np.int64)


def _fold_cells(kernel: Kernel, weights: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats, fold = _matrix(batch["stats"], len(kernel.mean)), batch["fold"].to_numpy(zero_copy_only=False)
            cells = np.zeros(len(stats), np.int64)
            for f, own in enumerate(weights):
                cells[fold == f] = _cells(kernel, own, stats[fold == f])
            yield pa.RecordBatch.from_arrays([pa.array(cells), batch["label"]], names=["cell", "label"])

    return run


def fit(labelled: DataFrame, *, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, folds: int = FOLDS, seed: int = SEED) -> Model:
    """Fits a model on all rows of labelled: stats (as of document_statistics) and label, from 0 to 1.

    Rows with a null label are left out.  The driver receives the moments of the
    statistics, folds * (features + 1) rows of the normal equations and at most
    3 * SCORE_UNIT + 1 cells of the calibration, whatever the input.
    """
    n = len(STATISTICS)
    rows = labelled.where("label is not null").select("stats", F.col("label").cast("double").alias("label"))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("stats"), F.lit(folds)).cast("bigint"))  # equal texts share a fold
    wide = lambda c: F.coalesce(F.sum(c.cast("decimal(38,0)")), F.lit(0)).cast("double")
    moments = rows.agg(F.count("*").alias("n"), *[wide(F.col("stats")[i]).alias(f"s{i}") for i in range(n)], *[wide(F.col("stats")[i] * F.col("stats")[i]).alias(f"q{i}") for i in range(n)]).first()
    if not moments["n"]:
        return Model(None, np.zeros(0), np.zeros(0), np.zeros(0))
    mean = np.array([moments[f"s{i}"] for i in range(n)]) / moments["n"]
    spread = np.sqrt(np.maximum(np.array([moments[f"q{i}"] for i in range(n)]) / moments["n"] - mean * mean, 0))
    kernel = Kernel.of(mean, spread, features, width, seed)
    sums = "fold bigint, row bigint, sums array<bigint>"
    parts = rows.mapInArrow(_equations(kernel, folds), sums).repartition(partitions(labelled.sparkSession), "fold", "row").mapInArrow(_added, sums)
    total = np.zeros((folds, features + 1, features + 2), np.int64)
    for r in parts.collect():  # folds * (features + 1) rows
        total[r["fold"], r["row"]] = r["sums"]
    whole = total.sum(axis=0)
    without = [_solved(whole - total[f], ridge) for f in range(folds)]
    cells = rows.mapInArrow(_fold_cells(kernel, without), "cell bigint, label double").groupBy("cell").agg(F.count("*").alias("n"), F.sum("label").alias("y")).orderBy("cell").collect()
    at, count, y = (np.array([r[c] for r in cells], float) for c in ("cell", "n", "y"))
    points, values = isotonic(at / SCORE_UNIT, count, y)
    return Model(kernel, _solved(whole, ridge), points, values)


def _score_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [i for i, name in enumerate(batch.schema.names) if name != "stats"]
            scores = model.scores(_matrix(batch["stats"], len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(scores)], names=[*(batch.schema.names[i] for i in kept), "score"])

    return run


def score(stats: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of document_statistics with score and predicted in place of stats."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema.fields if f.name != "stats")
    rows = stats.mapInArrow(_score_rows(model), f"{schema}, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, *, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: key, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    The model learns from documents that are not held_out and have a label in
    labels, by key.  A key with several labels counts once with their mean; null
    labels and keys are left out.  A null or empty text has the statistics of an
    empty one and is scored like others; repeated rows are scored alike, and
    each counts where it is labelled; without labels every score is 0.5; an
    empty table gives no rows; other columns are not read.
    """
    stats = checkpointed(document_statistics(docs, key=key, text=text, columns={"held_out": F.coalesce(held_out, F.lit(False))}))
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.avg(F.col(label).cast("double")).alias("label"))
    learned = stats.where(~F.col("held_out")).join(known, F.col(key) == F.col("_key")).select("stats", "label")
    return score(stats, fit(checkpointed(learned)), threshold=threshold)
