"""Ranked lexical search against a brute-force version, and its skipping against plain sums."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corvane.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, top):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_all, l_all = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for key, text in items:
        found = []
        for i, c in held:
            m = 25 + (75 * sum(c.values()) * n_all) // max(l_all, 1)
            score = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(key, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:top], 1)]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = ["the"] * 20 + ["of", "The", "été", "Été", "中文", "a1", "don't"] + [f"w{i}" for i in range(60)]
    docs = [(i * 7 % 401, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 20, 60])))) for i in range(400)]
    docs += [(900 + i, "same same text") for i in range(30)] + [(3, docs[0][1]), (3, docs[0][1]), (None, "same same text w1"), (None, None), (990, ""), (991, " ,;"), (992, "rare " * 5000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 9, 30])))) for i in range(25)]
    items += [(100, "same"), (101, "same same rare w1"), (102, None), (103, ""), (104, "unknown words"), (7, "the the the été"), (None, "w1"), (None, "w1")]
    return docs, items


@pytest.mark.parametrize("parts, top, terms_each, items_each", [(1, 10, 10**6, 10**6), (7, 10, 40, 5), (5, 3, 10**6, 1)])
def test_search(spark, rows, parts, top, terms_each, items_each):
    docs, items = rows
    table = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in docs], "doc_id bigint, text string, item_id string, score double").repartition(parts)
    asked = spark.createDataFrame([(k, t, "clash") for k, t in items], "item_id int, text string, doc_id string")
    found = ls.lexical_search(ls.lexical_index(table), asked, top=top, block_terms=terms_each, block_items=items_each)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute(docs, items, top), key=repr)


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert ls.lexical_search(ls.lexical_index(docs), items).count() == 0
    full = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert ls.lexical_search(ls.lexical_index(full), items.where("false")).count() == 0
    with pytest.raises(ValueError):
        ls.lexical_index(spark.createDataFrame([("x", "a")], "doc_id string, text string"))


def test_hybrid_loses_nothing():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        blocks = -(-n // ls.BLOCK)
        made = []
        for _ in range(int(rng.integers(1, 6))):
            docs = np.sort(rng.choice(n, int(rng.integers(1, n + 1)), replace=False)).astype(np.int64)
            made.append((docs, rng.integers(0, 50, len(docs)), int(rng.integers(1, 4))))
        split = int(rng.integers(0, len(made) + 1))
        whole = np.zeros(n, np.int64)
        for docs, scores, times in made:
            whole[docs] += scores * times
        least = int(rng.integers(1, max(2, whole.max() + 2)))
        short = [(d, s * t) for d, s, t in made[:split]]
        docs, scores = ls.hybrid(short, [(ls._List(d, s, blocks), t) for d, s, t in made[split:]], least, blocks)
        assert docs.tolist() == np.flatnonzero(whole >= least).tolist() and scores.tolist() == whole[docs].tolist()
