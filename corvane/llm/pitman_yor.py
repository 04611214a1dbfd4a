"""Pitman-Yor restaurants: seating by Gibbs sampling, and predictive probabilities.

A dish of a restaurant has customers at tables; each table is one customer of
the same dish in the parent restaurant.  A step of the sampler reseats dishes
given the parent's predictive probabilities: the number of tables is proposed by
seating a dish's customers one by one, and accepted or not by
Metropolis-Hastings.
"""

from __future__ import annotations

import numpy as np

from corvane.llm.textkit import mixed

#: Customers are seated in groups of this share of those seated, of one at least.
GROUP = 1 / 16
#: Both ways to draw a group's new tables are exact; inversion serves up to so many expected ones.
INVERTED_MEAN = 10
#: The group number of the draws that accept proposals.
_ACCEPT = -1


class Draws:
    """Uniform draws that belong to keys: equal keys get equal draws, however they are dealt out over tasks."""

    def __init__(self, keys: np.ndarray, seed: int):
        self.keys, self.sweep = mixed(keys.astype(np.uint64) + self._step(seed, 0x9E3779B97F4A7C15)), 0

    @staticmethod
    def _step(number: int, factor: int) -> np.uint64:
        return np.uint64(number * factor % 2**64)

    def __call__(self, which: np.ndarray | slice, group: int, part: int) -> np.ndarray:
        """Draws between 0 and 1 for some keys, one for each sweep, group and part."""
        at = self._step(self.sweep, 0xD1B54A32D192ED03) ^ self._step(group + 1, 0xA24BAED4963EE407) ^ self._step(part + 1, 0x8CB92BA72F3D8DD7)
        return ((mixed(self.keys[which] + at) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53

    def binomial(self, size: np.ndarray, chance: np.ndarray, which: np.ndarray, group: int) -> np.ndarray:
        """Binomial draws: by inversion for all keys at once where few are expected, else from a generator of the key's own."""
        many = np.flatnonzero(size * chance > INVERTED_MEAN)
        few = np.flatnonzero(size * chance <= INVERTED_MEAN)
        out = np.zeros(len(size))
        out[few] = self._inverted(size[few], chance[few], self(which[few], group, 0))
        for at in many.tolist():
            own = np.random.Philox(key=[int(self.keys[which[at]]), ((self.sweep << 32) | (group + 1)) & (2**64 - 1)])
            out[at] = np.random.Generator(own).binomial(int(size[at]), float(chance[at]))
        return out

    @staticmethod
    def _inverted(size: np.ndarray, chance: np.ndarray, u: np.ndarray) -> np.ndarray:
        chance = np.minimum(chance, 1 - 1e-12)
        term, odds = np.exp(size * np.log1p(-chance)), chance / (1 - chance)
        out, total = np.zeros(len(size)), term.copy()
        active = np.flatnonzero((u > total) & (size > 0))
        while len(active):
            k = out[active]
            term[active] *= odds[active] * (size[active] - k) / (k + 1)
            out[active] += 1
            total[active] += term[active]
            active = active[(u[active] > total[active]) & (out[active] < size[active])]
        return out


def lgamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function for positive numbers."""
    shift, x = np.zeros_like(x), x.copy()
    for _ in range(8):
        small = x < 8
        shift[small] -= np.log(x[small])
        x[small] += 1
    return shift + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def seat(customers: np.ndarray, strength: np.ndarray, discount: float, draws: Draws) -> np.ndarray:
    """Numbers of tables after so many customers (one at least) in one-dish restaurants of given strengths.

    Each step seats a group, a fixed share of those seated already, or one
    customer.  A group's new tables are binomial with the exact mean that seating
    it one by one would have; only their spread within a group is approximate.
    """
    tables, seated, number = np.ones(len(customers)), 1, 0
    left = np.flatnonzero(customers > seated)
    while len(left):
        group = max(1, int(seated * GROUP))
        size = np.minimum(group, customers[left] - seated)
        if group == 1:
            new = (strength[left] + discount * tables[left]) / (strength[left] + seated)
        else:
            # The product of 1 + discount / (strength + n) over the group's customers n is a ratio of gamma functions.
            middle = strength[left] + seated + (discount - 1) / 2
            new = (strength[left] / discount + tables[left]) * np.expm1(discount * np.log1p(size / middle))
        chance = np.clip(new / size, 0.0, 1.0)
        tables[left] += draws.binomial(size, chance, left, number)
        seated, number = seated + group, number + 1
        left = left[customers[left] > seated]
    return tables


def reseat(customers: np.ndarray, tables: np.ndarray, others: np.ndarray, above: np.ndarray, strength: float, discount: float, draws: Draws) -> np.ndarray:
    """Draws the tables of dishes: others are the tables of the other dishes of each one's restaurant, above the parent's probabilities."""
    a = above * (strength + discount * others)
    proposed = seat(customers, a, discount, draws)
    current = np.minimum(tables, customers)
    weight = lambda t: t * np.log(above) + lgamma(a / (above * discount) + t) - lgamma(a / discount + t)
    ratio = np.where(proposed != current, weight(proposed) - weight(current), 0.0)
    accept = draws(slice(None), _ACCEPT, 0)
    draws.sweep += 1
    return np.where(np.log(accept) < ratio, proposed, current)


def predictive(customers: np.ndarray, tables: np.ndarray, all_customers, all_tables, above: np.ndarray, strength: float, discount: float) -> np.ndarray:
    """Probabilities of dishes in restaurants of so many customers and tables in all."""
    return (customers - discount * tables + (strength + discount * all_tables) * above) / (strength + all_customers)
