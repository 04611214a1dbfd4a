"""The language model's probabilities sum to one, and its seating has the exact mean at every size."""

import random

import numpy as np
import pytest

from corvane.llm import lm_scoring as lm
from corvane.llm import pitman_yor as py
from corvane.llm.textkit import mixed


def bucket_of(pairs):
    """A bucket of (word, class, customers), as if read from slices."""
    out = object.__new__(lm._Bucket)
    names = sorted({w for w, _, _ in pairs})
    out.words = mixed(np.array(names, np.uint64))
    out.word = np.array([names.index(w) for w, _, _ in pairs])
    out.context, out.customers = np.array([c for _, c, _ in pairs]), np.array([float(n) for _, _, n in pairs])
    out.counts = np.bincount(out.word, out.customers, len(names))
    out.seen = np.flatnonzero(out.customers > 0)
    out.many = out.seen[out.customers[out.seen] > 1]
    return out


@pytest.mark.parametrize("parts", [1, 3])
def test_probabilities_sum_to_one(parts):
    rng = random.Random(6)
    pairs = {}
    for _ in range(6000):
        pairs[rng.choice([1, 2, 3, rng.randint(4, 300)]), rng.choice([0, 5, rng.randint(6, 80)])] = rng.choice([0, 1, 1, 2, 40, 3000])
    rows = [(w, c, n) for (w, c), n in sorted(pairs.items())]
    buckets = [bucket_of([r for r in rows if r[0] % parts == p]) for p in range(parts)]

    def summed(seatings):
        found = [lm._sums_of(seatings)(b) for b in buckets]
        return sum(np.stack(f[0]) for f in found), sum(np.array(f[1]) for f in found)

    firsts = [lm._first_sums(b) for b in buckets]
    (customers, tables), (words, root) = sum(np.stack(f[0]) for f in firsts), sum(np.array(f[1]) for f in firsts)
    start = lm.Totals(words, customers, tables[None], np.array([root]))
    totals = lm.Totals(words, customers, *summed(lambda b: lm._sweeps(b, start, lm.FIRST_SWEEPS, 1)))
    samples = lm.Totals(words, customers, *summed(lambda b: lm._samples(b, totals, 2)))
    mean = [(np.zeros(len(b.word)), np.zeros(len(b.words))) for b in buckets]
    masses = []
    for found in zip(*(lm.predictions(b, totals, samples, 2) for b in buckets), strict=True):
        at = len(masses)
        learned = [b.counts > 0 for b in buckets]
        above, over = samples.tables[at].sum(), samples.root_tables[at]
        unknown = (lm.ROOT_STRENGTH + lm.ROOT_DISCOUNT * over) / (words + 1) / (lm.ROOT_STRENGTH + above)
        assert sum(root[k].sum() for (_, root), k in zip(found, learned, strict=True)) + unknown == pytest.approx(1, abs=1e-9)
        mass = []
        for c in sorted({c for _, c, _ in rows}):
            room, own = customers[c], samples.tables[at][c]
            back = (lm.STRENGTH + lm.DISCOUNT * own) / (lm.STRENGTH + room)
            total, rest = 0.0, 1.0
            for (p, root), b, k in zip(found, buckets, learned, strict=True):
                held = (b.context == c) & k[b.word]
                total += p[held].sum()
                rest -= root[b.word[held]].sum()
            mass.append(total + rest * back)  # words that the class lacks, and the unknown one, come from the parent
        assert mass == pytest.approx([1] * len(mass), abs=1e-9)
        masses.append(mass)
        for (m, _), (p, _) in zip(mean, found, strict=True):
            m += p / lm.SAMPLES
    assert len(masses) == lm.SAMPLES and all((m > 0).all() for m, _ in mean)


@pytest.mark.parametrize("customers", [2, 30, 33, 34, 300, 3000, 20_000])
@pytest.mark.parametrize("strength, discount", [(0.4, 0.75), (8.0, 0.75), (300.0, 0.6)])
def test_seating(customers, strength, discount):
    n = 20_000 if customers <= 300 else 2000
    tables = py.seat(np.full(n, float(customers)), np.full(n, strength), discount, py.Draws(np.arange(n), 3))
    chance = np.array([1.0])  # the exact distribution of the number of tables
    for seated in range(1, min(customers, 3000)):
        k = np.arange(1, len(chance) + 1)
        new = (strength + discount * k) / (strength + seated)
        chance = np.append(chance * (1 - new), 0) + np.concatenate(([0], chance * new))
    mean, k = 1.0, np.arange(1, len(chance) + 1)
    for seated in range(1, customers):
        mean += (strength + discount * mean) / (strength + seated)
    assert tables.mean() == pytest.approx(mean, rel=max(0.01, 4 * tables.std() / mean / np.sqrt(n)))
    if customers <= 3000:
        spread = np.sqrt((chance * k * k).sum() - (chance * k).sum() ** 2)
        assert mean == pytest.approx((chance * k).sum(), rel=1e-6) and tables.std() == pytest.approx(spread, rel=0.1)
