"""The quality classifier: statistics by hand, calibration against enumeration, held-out accuracy, odd rows."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import quality_classifier as qc
from corvane.llm.textkit import crc_remainder


def by_hand(text):
    """The same statistics from Python strings, one text at a time."""
    white = " \t\n\r\v\f"
    words = "".join(" " if c in white else c for c in text).split(" ")
    words = [w for w in words if w]
    lower = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    lines = [x for x in text.split("\n") if x]
    n, k, sizes = len(text), len(words), [len(w) for w in words]
    share = lambda a, b: a / max(b, 1)
    among = lambda marks: sum(text.count(c) for c in marks)
    symbols = "#*$%&|<>@{}[]\\^~_=+`"
    plain = [any(c.isalnum() or ord(c) > 127 for c in w) for w in words]
    pairs = list(itertools.pairwise(lower))
    mean = share(sum(sizes), k)
    found = [
        np.log1p(n), np.log1p(k), mean, np.sqrt(max(share(sum(s * s for s in sizes), k) - mean**2, 0)), np.log1p(max(sizes, default=0)), share(among("0123456789"), n), share(sum("A" <= c <= "Z" for c in text), n), share(among(symbols), n),
        share(among("()\"'/:;,-"), n), share(among(".!?"), k), share(sum(ord(c) > 127 for c in text), n), share(among(white), n), np.log1p(text.count("\n")), np.log1p(share(k, len(lines))), share(len(lines) - len(set(lines)), len(lines)),
        share(sum(x[-1] in ".!?" for x in lines), len(lines)), share(len(set(lower)), k), share(sum(a == b for a, b in pairs), k), share(len(pairs) - len(set(pairs)), len(pairs)), share(max(Counter(lower).values(), default=0), k),
        share(sum(not p for p in plain), k), share(sum(p and w[-1] in symbols for p, w in zip(plain, words, strict=True)), k), share(sum("A" <= w[0] <= "Z" for w in words), k), share(sum(len(w) == 1 and p for p, w in zip(plain, words, strict=True)), k),
    ]
    return [int(np.rint(min(x, 1000) * qc.STAT_UNIT)) for x in found]


def test_statistics(spark):
    texts = ["", None, " ", "\n\n", "one", "Zwei Wörter.\nZwei Wörter.", "a | b | c |\n| d", "中文 é É x x X\n", "the the the The\nthe the", "x" * 50_000, "a$ b% c", "\x1c \x7f 1.5, (ok)!"]
    rng = random.Random(5)
    texts += ["".join(rng.choices("ab Z9.|$é中\n\t,", k=rng.randint(1, 200))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: list(r.stats) for r in qc.document_statistics(docs).collect()}
    assert len(qc.STATISTICS) == len(got[0]) and got == {i: by_hand(t or "") for i, t in enumerate(texts)}


def test_isotonic():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(1, 8))
        counts, sums = rng.integers(1, 5, n).astype(float), np.zeros(n)
        sums[:] = [rng.integers(0, c + 1) for c in counts]
        points, values = qc.isotonic(np.arange(n, dtype=float), counts, sums)
        assert (np.diff(values) > 0).all() and (np.diff(points) > 0).all()
        means, best, chosen = sums / counts, np.inf, None
        for cuts in itertools.product([False, True], repeat=n - 1):  # every way to pool neighbours
            pools = np.concatenate(([0], np.cumsum(np.array(cuts, dtype=np.int64)))).astype(np.int64)
            level = np.bincount(pools, sums) / np.bincount(pools, counts)
            loss = float((counts * (means - level[pools]) ** 2).sum())
            if (np.diff(level) >= 0).all() and loss < best - 1e-12:
                best, chosen = loss, level
        assert values == pytest.approx(np.unique(np.round(chosen, 12)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    good = ["alpha", "river", "stone", "window", "evening", "letter", "simple"]
    out = []
    for i in range(600):
        bad = rng.random() < 0.3
        words = [rng.choice(good) for _ in range(rng.randint(5, 60))]
        text = " ".join(w + rng.choice("$%#") if bad else w for w in words) if rng.random() < 0.6 else (" ".join([words[0]] * 40) if bad else " ".join(words).capitalize() + ".")
        out.append((i, text, 0 if bad else 1))
    return out


def test_scores(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash", 5) for i, t, _ in rows] + [(9000, None, "", 0), (9001, "", "", 0), (9002, " \n", "", 0), (None, "alpha river", "", 0), (3, rows[3][1], "", 0), (9003, "word " * 100_000, "", 0)], "doc_id bigint, text string, held_out string, stats int")
    labels = spark.createDataFrame([(i, y, "clash") for i, _, y in rows if i % 7] + [(3, rows[3][2], ""), (None, 1, ""), (9000, None, "")], "doc_id bigint, quality int, text string")
    held = crc_remainder(F.col("doc_id"), 5) == 0
    first = qc.quality_scores(docs.repartition(2), labels, held)
    assert first.columns == ["doc_id", "held_out", "score", "predicted"]
    key = lambda r: repr(tuple(r))
    a, b = (sorted(qc.quality_scores(docs.repartition(n), labels.repartition(n), held).collect(), key=key) for n in (2, 7))
    assert a == b and len(a) == 606  # nothing depends on the partitions
    truth = {i: y for i, _, y in rows}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in a)
    apart = [r for r in a if r.held_out and r.doc_id in truth]
    assert len(apart) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in apart]) > 0.97
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(qc.quality_scores(docs.repartition(2), flipped, held).collect(), key=key) == a  # held-out labels change nothing


def test_little_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {(r.score, r.predicted) for r in qc.quality_scores(docs, none, F.lit(False)).collect()} == {(0.5, 1)}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id bigint, quality int")
    assert all(r.score == 1.0 for r in qc.quality_scores(docs, one, F.lit(False)).collect())
    assert qc.quality_scores(docs.where("false"), one, F.lit(False)).count() == 0
