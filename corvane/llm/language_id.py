"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

The weights are learned by follow-the-regularised-leader with elastic-net
penalties, which leaves most of them at zero, and the probabilities are then
calibrated by one temperature on held-out texts, whole and cut short.

The probabilities only compare the learned languages.  Whether a text is in any
of them is told by its margin: what its n-grams alone, without the bias, say for
the best language over the second, held against what held-out texts of that size
have.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.textkit import batches_of

#: N-grams of 1 to GRAM characters are hashed into 2**BITS features, of which a smallint holds the number.
GRAM = 3
BITS = 15
#: The classifier is fitted on so many distinct labelled texts of each language, at most; everything counted of the corpus covers all its documents.
FIT_DOCUMENTS = 1500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.001
#: Probabilities are never made sharper than by this temperature.
LEAST_TEMPERATURE = 0.1
UNKNOWN = "und"
#: Margins are judged apart for texts of so many characters up to the next number; below the first they tell nothing.
SIZES = (8, 16, 32, 64, 128, 256)
#: A text is not known with less than SLACK times the margin that all but LEAST of the held-out texts of its size exceed.
LEAST, SLACK = 0.01, 0.5

_FACTORS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263))


def features(text: str, gram: int = GRAM, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text, in lower case between two spaces, and how often each occurs."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = np.where(codes <= 32, np.uint32(32), codes)
    found = []
    for n in range(1, gram + 1):
        if len(codes) < n:
            break
        key = np.full(len(codes) - n + 1, n * 40503, dtype=np.uint32)
        for at in range(n):
            key = (key ^ codes[at : len(codes) - n + 1 + at]) * _FACTORS[at % 4]
        found.append((key ^ (key >> np.uint32(15))) * _FACTORS[3] >> np.uint32(32 - bits))
    counts = np.bincount(np.concatenate(found), minlength=1)
    which = np.flatnonzero(counts)
    return which, counts[which]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # a row for each feature, the last for the bias
    temperature: float = 1.0
    limits: np.ndarray = field(default_factory=lambda: np.zeros(len(SIZES) + 1))  # the least margin for each size

    def vector(self, which: np.ndarray, counts: np.ndarray) -> np.ndarray:
        values = (1 + np.log(counts)) * self.idf[which]
        return values / max(math.sqrt(float(values @ values)), 1e-12)

    def logits(self, which: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values @ self.weights[which] + self.weights[-1]

    def margins(self, which: np.ndarray, values: np.ndarray) -> np.ndarray:
        """What the n-grams say for each language over the best of the others; zero if there are none."""
        z = values @ self.weights[which]
        if len(z) < 2:
            return np.zeros(len(z))
        best, others = int(z.argmax()), np.full(len(z), z.max())
        others[best] = np.delete(z, best).max()
        return z - others

    def predict(self, text: str) -> tuple[str, float, bool]:
        """The best language, its probability, and whether the text is in a language that was learned."""
        which, counts = features(text)
        values = self.vector(which, counts)
        z = self.logits(which, values) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        known = self.margins(which, values).max() >= self.limits[np.searchsorted(SIZES, len(text), side="right")]
        return self.languages[best], float(p[best] / p.sum()), bool(known)


class Examples(Sequence):
    """(class, features, values) of rows of a table, in the order given.

    The features and their counts stay in the Arrow buffers that they came in,
    and the values are worked out whenever an example is asked for, so that the
    driver holds one copy of them and nothing made from it.
    """

    def __init__(self, model: Model, rows: pa.Table, order: np.ndarray):
        self.model, self.order = model, order
        number = {name: i for i, name in enumerate(model.languages)}
        self.labels = [number[name] for name in rows["lang"].to_pylist()]
        self.parts = [tuple(batch[c].flatten().to_numpy() for c in ("which", "counts")) for batch in rows.to_batches()]
        lengths = [pa.compute.list_value_length(batch["which"]).to_numpy() for batch in rows.to_batches()]
        self.part = np.repeat(np.arange(len(lengths)), [len(x) for x in lengths])
        self.stops = np.concatenate([np.zeros(0, np.int64), *map(np.cumsum, lengths)])
        self.starts = self.stops - np.concatenate([np.zeros(0, np.int64), *lengths])

    def __len__(self) -> int:
        return len(self.order)

    def __getitem__(self, at: int) -> tuple[int, np.ndarray, np.ndarray]:
        row = self.order[at]
        which, counts = (x[self.starts[row] : self.stops[row]] for x in self.parts[self.part[row]])
        return self.labels[row], which, self.model.vector(which, counts)


def follow_the_leader(model: Model, examples: Sequence[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
    """Fits the weights: FTRL-proximal over (class, features, values) examples."""
    shape = model.weights.shape
    z, n = np.zeros(shape), np.zeros(shape)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for at in order.permutation(len(examples)):
            label, which, values = examples[at]
            rows, x = np.append(which, shape[0] - 1), np.append(values, 1.0)[:, None]
            zr, nr = z[rows], n[rows]
            w = np.where(np.abs(zr) <= l1, 0.0, (np.sign(zr) * l1 - zr) / ((beta + np.sqrt(nr)) / alpha + l2))
            score = (w * x).sum(axis=0)
            p = np.exp(score - score.max())
            p /= p.sum()
            p[label] -= 1
            g = x * p
            z[rows] += g - (np.sqrt(nr + g * g) - np.sqrt(nr)) / alpha * w
            n[rows] += g * g
    model.weights = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))


def snippets(examples: Iterable[tuple[int, np.ndarray, np.ndarray]], heads: list[str], model: Model) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Examples from the first characters of held-out texts, cut to each of SIZES, with a letter."""
    letter = _letter()
    for (label, _, _), head in zip(examples, heads, strict=True):
        for size in SIZES:
            if size < len(head) and letter.search(head[:size]):
                which, counts = features(head[:size])
                yield label, which, model.vector(which, counts)


def calibrate(model: Model, examples: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """Sets the temperature that gives held-out examples the least log loss.

    Whole texts alone are told apart without a fault, so that any low
    temperature would fit; short ones, of which some are wrong, make it
    meaningful.  It is never below LEAST_TEMPERATURE.
    """
    found = [(label, model.logits(which, values)) for label, which, values in examples]
    if not found:
        return
    labels, scores = np.array([label for label, _ in found]), np.array([score for _, score in found])

    def loss(log_t: float) -> float:
        z = scores / math.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(labels)), labels]).mean())

    low, high, ratio = math.log(LEAST_TEMPERATURE), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    model.temperature = math.exp((low + high) / 2)


def set_limits(model: Model, examples: Iterable[tuple[int, np.ndarray, np.ndarray]], heads: list[str]) -> None:
    """Sets the least margins from held-out examples and the first characters of their texts, cut to each of SIZES too."""
    found: list[list[float]] = [[] for _ in model.limits]
    for (label, which, values), head in zip(examples, heads, strict=True):
        if not _letter().search(head):
            continue
        found[np.searchsorted(SIZES, len(head), side="right")].append(model.margins(which, values)[label])
        for at, size in enumerate(SIZES, 1):
            if size < len(head):
                part = features(head[:size])
                found[at].append(model.margins(part[0], model.vector(*part))[label])
    model.limits = np.array([0.0] + [max(0.0, SLACK * float(np.quantile(x, LEAST))) if x else 0.0 for x in found[1:]])


def _letter():
    import regex

    return regex.compile(r"\p{L}")


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, documents = np.zeros(1 << BITS, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            total[features(text or "")[0]] += 1
            documents += 1
    which = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(which, -1)), pa.array(np.append(total[which], documents))], names=["feature", "n"])


def _least_hashes(most: int):
    """For each language the `most` least distinct hashes of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names, h = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            which = names.indices.to_numpy()
            for at, name in enumerate(names.dictionary.to_pylist()):
                held[name] = np.unique(np.append(held.get(name, h[:0]), h[which == at]))[:most]
        for name, h in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array(h)], names=["lang", "h"])

    return run


def _example_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(text or "") for text in batch.column(1).to_pylist()]
        lists = [pa.array([x[i].astype(kind) for x in found], pa.list_(pa.from_numpy_dtype(kind))) for i, kind in enumerate((np.int16, np.int32))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists, batch.column(2), batch.column(3)], names=["lang", "which", "counts", "h", "head"])


def fit_sample(rows: DataFrame, most: int) -> tuple[list[str], DataFrame]:
    """The languages of rows (text, lang), and lang, text and h of the distinct texts with the `most` least hashes of each.

    A text that stands in many rows counts once for each of its languages, and
    no language takes another's place.  Only hashes are shuffled to find them.
    """
    hashed = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("text", F.lit(1)), 1))
    least = batches_of(hashed.select("lang", "h"), _least_hashes(most), "lang string, h bigint").distinct()
    ranked = least.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("at") <= most)
    limits = {r.lang: r.h for r in ranked.groupBy("lang").agg(F.max("h").alias("h")).collect()}
    if not limits:
        return [], hashed.select("lang", "text", "h")
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    chosen = hashed.where(F.col("h") <= limit[F.col("lang")]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    return sorted(limits), chosen.select("lang", "text", "h")


def learn(model: Model, rows: pa.Table) -> None:
    """Fits the model on rows (lang, which, counts, h, head): the weights on four fifths by h, the rest on the others."""
    order = pa.compute.sort_indices(rows.select(["h", "lang"]), [("h", "ascending"), ("lang", "ascending")]).to_numpy()
    held = rows["h"].to_numpy()[order] % 5 == 0
    fitted, others = Examples(model, rows, order[~held]), Examples(model, rows, order[held])
    follow_the_leader(model, fitted or others)
    heads = rows["head"].take(pa.array(order[held])).to_pylist()
    calibrate(model, chain(others, snippets(others, heads, model)))
    set_limits(model, others, heads)


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", fit_documents: int = FIT_DOCUMENTS) -> Model:
    """A model learned from the rows of labelled that have a lang.

    The document frequencies behind the TF-IDF weights are counted over all
    these rows.  The classifier is fitted on the distinct texts with the least
    hashes, fit_documents of each language at most.
    """
    rows = labelled.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).alias("lang")).where("lang is not null")
    languages, chosen = fit_sample(rows, fit_documents)
    counted = batches_of(rows.select("text"), _document_counts, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, n = (counted[c].to_numpy() for c in ("feature", "n"))
    documents = max([1, *n[feature == -1].tolist()])
    df = np.zeros(1 << BITS)
    df[feature[feature >= 0]] = n[feature >= 0]
    model = Model(languages, np.log((1 + documents) / (1 + df)) + 1, np.zeros(((1 << BITS) + 1, len(languages))))
    if not languages:
        return model
    head = F.when(F.col("h") % 5 == 0, F.left("text", F.lit(SIZES[-1] + 1)))
    learn(model, batches_of(chosen.select("lang", "text", "h", head.alias("head")), _example_rows, "lang string, which array<smallint>, counts array<int>, h bigint, head string").toArrow())
    pa.default_memory_pool().release_unused()
    return model


def _predictions(model: Model, returned: list[str], added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = _letter()
        for batch in batches:
            found = [model.predict(text) if model.languages and text and letter.search(text) else (UNKNOWN, 0.0, False) for text in batch.column(batch.num_columns - 1).to_pylist()]
            kept = [batch.column(i) for i in range(len(returned))]
            new = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*kept, *new[: len(added)]], names=[*returned, *added])

    return run


def predict(docs: DataFrame, model: Model, *, text: str = "text", columns: list[str] | None = None, with_known: bool = False) -> DataFrame:
    """The named columns of each row (all if None), with lang_pred and score, from the text alone.

    with_known adds known: whether the text seems to be in one of the learned
    languages at all.  It is true of all texts with a letter if only one was
    learned, as margins need two.

    A text that is null, empty or without a letter is `und` with score 0; so are
    all where nothing was learned.  Repeated rows get a row each; an empty table
    gives none.
    """
    added = ["lang_pred", "score", "known"][: 2 + with_known]
    returned = [c for c in (docs.columns if columns is None else columns) if c not in added]
    rest = [c for c in returned if c != text]
    names = rest + [text] * (text in returned)
    rows = docs.select(*[docs[c] for c in rest], docs[text])
    schema = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes[: len(names)])
    found = batches_of(rows, _predictions(model, names, added), ", ".join(filter(None, [schema, "lang_pred string, score double" + ", known boolean" * with_known])))
    return found.select(*[f"`{c}`" for c in returned], *added)
