"""Small raster kernels as Arrow functions: regions, holes, edges.  A raster is a flat list of numbers with its width."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def regions(mask: np.ndarray) -> np.ndarray:
    """Numbers from 1 for the four-connected regions of a mask, in the order of their first cells; 0 outside.

    Every cell takes the least number among its neighbours until none changes,
    along whole rows and columns at a time.
    """
    height, width = mask.shape
    far = height * width + 1
    number = np.where(mask, np.arange(1, height * width + 1).reshape(height, width), far)
    while True:
        before = number.copy()
        for view in (number, number[::-1], number.T, number.T[::-1]):
            own = view != far
            for i in range(1, len(view)):
                both = own[i] & own[i - 1]
                view[i][both] = np.minimum(view[i][both], view[i - 1][both])
        if (before == number).all():
            break
    _, ranks = np.unique(number[mask], return_inverse=True)
    out = np.zeros(mask.shape, dtype=np.int64)
    out[mask] = ranks + 1
    return out


def near_regions(depth: np.ndarray, threshold: int) -> tuple[float, float]:
    """The share of cells at the threshold or above, and of these the share of the largest region."""
    near = depth >= threshold
    count = int(near.sum())
    return (count / near.size, int(np.bincount(regions(near)[near]).max()) / count) if count else (0.0, 0.0)


def filled(mask: np.ndarray) -> np.ndarray:
    """A mask with the holes filled that its border doesn't reach."""
    outside = regions(np.pad(~mask, 1, constant_values=True))
    return (outside != outside[0, 0])[1:-1, 1:-1]


def overlap_weights(shape: tuple[int, int], box: tuple[float, float, float, float]) -> np.ndarray:
    """The area of each unit cell inside a box."""
    inside = lambda n, a, b: np.clip(np.minimum(np.arange(n) + 1.0, b) - np.maximum(np.arange(n), a), 0, None)
    return inside(shape[0], box[1], box[3])[:, None] * inside(shape[1], box[0], box[2])[None, :]


def single_region(mask: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The region of a mask, holes filled, that has most of a box; of equal ones the first."""
    numbers = regions(filled(mask))
    sums = np.bincount(numbers.ravel(), overlap_weights(mask.shape, box).ravel(), int(numbers.max()) + 1)
    return numbers == 1 + int(sums[1:].argmax()) if len(sums) > 1 else np.zeros(mask.shape, dtype=bool)


def gradient(image: np.ndarray) -> np.ndarray:
    """The length of the Sobel gradient; the borders mirror, their own cells repeated."""
    p = np.pad(image.astype(float), 1, mode="symmetric")
    smooth_y, smooth_x = p[:-2] + 2 * p[1:-1] + p[2:], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return np.hypot(smooth_x[2:] - smooth_x[:-2], smooth_y[:, 2:] - smooth_y[:, :-2])


def edge_correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Pearson's correlation of two images' gradients; 1 if either has no variance."""
    x, y = gradient(a).ravel(), gradient(b).ravel()
    x, y = x - x.mean(), y - y.mean()
    scale = float(np.linalg.norm(x) * np.linalg.norm(y))
    return float(np.clip(float(x @ y) / scale, -1, 1)) if scale else 1.0


def eight_bit(values: np.ndarray) -> np.ndarray:
    """Numbers scaled to 0-255 from least to most, halves to even; all 0 where they are equal."""
    spread = values.max() - values.min()
    return np.rint((values - values.min()) * (255 / spread)).astype(np.uint8) if spread > 0 else np.zeros(values.shape, np.uint8)


def near_regions_udf(threshold: int):
    """Column function of (flat 8-bit depth, width): struct(fraction, concentration)."""

    def run(depth: pd.Series, width: pd.Series) -> pd.DataFrame:
        found = [near_regions(np.asarray(d).reshape(-1, w), threshold) for d, w in zip(depth, width, strict=True)]
        return pd.DataFrame(found, columns=["fraction", "concentration"])

    return F.pandas_udf(run, "fraction double, concentration double")


def edge_correlation_udf():
    """Column function of (flat image, flat image, width): the correlation of their edges."""

    def run(a: pd.Series, b: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([edge_correlation(np.asarray(x).reshape(-1, w), np.asarray(y).reshape(-1, w)) for x, y, w in zip(a, b, width, strict=True)], dtype=float)

    return F.pandas_udf(run, T.DoubleType())


def single_region_udf():
    """Column function of (flat mask of 0 and 1, width, box as a list): struct(cells, x1, y1, x2, y2) of the cleaned mask."""

    def run(mask: pd.Series, width: pd.Series, box: pd.Series) -> pd.DataFrame:
        out = []
        for m, w, b in zip(mask, width, box, strict=True):
            ys, xs = np.nonzero(single_region(np.asarray(m).reshape(-1, w) > 0, tuple(b)))
            out.append((len(ys), *((int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1) if len(ys) else (0, 0, 0, 0))))
        return pd.DataFrame(out, columns=["cells", "x1", "y1", "x2", "y2"])

    return F.pandas_udf(run, "cells int, x1 int, y1 int, x2 int, y2 int")
