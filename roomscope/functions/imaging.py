"""Scores of pixel and depth grids, in numpy over whole Arrow batches; one grid is one row, row-major.

The functions take one grid (h, w) or many (n, h, w), and reduce the last two axes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = (-2, -1)


def py_slice(n: int, start: int, stop: int) -> slice:
    """The range that a sequence of length ``n`` gives for [start:stop]: negative ends count from its end."""
    return slice(*slice(start, stop).indices(n)[:2])


def sharpness(gray: np.ndarray) -> np.ndarray:
    """Population variance of the 3x3 Laplacian with mirrored edges, over 500, at most 1."""
    p = np.pad(gray, [(0, 0)] * (gray.ndim - 2) + [(1, 1), (1, 1)], mode="symmetric")
    edge = p[..., :-2, 1:-1] + p[..., 2:, 1:-1] + p[..., 1:-1, :-2] + p[..., 1:-1, 2:] - 4 * gray
    return np.minimum(1.0, edge.var(axis=GRID) / 500)


def brightness(rgb: np.ndarray) -> np.ndarray:
    return rgb @ np.array([0.299, 0.587, 0.114])


def exposure_of(light: np.ndarray) -> np.ndarray:
    """Mean brightness and contrast, less for shares of very dark and very bright pixels; from 0 to 1."""
    penalty = 2 * ((light < 20).mean(axis=GRID) + (light > 235).mean(axis=GRID))
    score = (0.5 * (1 - abs(light.mean(axis=GRID) - 128) / 128) + 0.5 * np.minimum(1.0, light.std(axis=GRID) / 60)) * (1 - penalty)
    return np.clip(score, 0.0, 1.0)


def exposure(rgb: np.ndarray) -> np.ndarray:
    """``exposure_of`` the brightness of colour grids (h, w, 3)."""
    return exposure_of(brightness(rgb))


def composition(gray: np.ndarray) -> np.ndarray:
    """Edge strength along the thirds and in the centre, relative to the whole. Sides under 2 have no gradient: ValueError."""
    h, w = gray.shape[-2:]
    if min(h, w) < 2:
        raise ValueError("a side is shorter than 2")
    gy, gx = np.gradient(gray, axis=GRID)
    edge = np.sqrt(gx * gx + gy * gy)
    whole = edge.mean(axis=GRID) + 1e-8

    def share(part: np.ndarray) -> np.ndarray:
        return part.mean(axis=GRID) if part.shape[-1] and part.shape[-2] else np.full(gray.shape[:-2], np.nan)

    across = [edge[..., py_slice(h, k - 10, k + 10), :] for k in (h // 3, h // 3 * 2)]
    down = [edge[..., py_slice(w, k - 10, k + 10)] for k in (w // 3, w // 3 * 2)]
    thirds = sum(share(b) for b in across + down) / 4
    centre = share(edge[..., h // 3 : 2 * h // 3, w // 3 : 2 * w // 3])
    cap = lambda x: np.fmin(1.0, x / whole / 2)  # noqa: E731  a part without pixels counts in full
    return 0.6 * cap(thirds) + 0.4 * cap(centre)


def depth(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variance of the grid scaled to 0..1, and how many of ten equal bins hold over a twentieth of it."""
    low, high = grid.min(axis=GRID, keepdims=True), grid.max(axis=GRID, keepdims=True)
    d = (grid - low) / (high - low + 1e-8)
    top = d.max(axis=GRID, keepdims=True)
    edges = np.linspace(0, 1, 11) * np.where(top > 0, top, 1)[..., 0]
    place = sum((d >= edges[..., k][..., None, None]).astype(np.int64) for k in range(1, 10))
    counts = np.stack([(place == k).sum(axis=GRID) for k in range(10)])
    return d.var(axis=GRID), (counts > 0.05 * d.shape[-1] * d.shape[-2]).sum(axis=0)


def _whole(grids: pd.Series, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The grids that are there, of the right size and finite, as one array, and which of the rows they are."""
    sized = [i for i, v in enumerate(grids) if v is not None and len(v) == height * width]
    g = np.array([grids.iloc[i] for i in sized], np.float64).reshape(-1, height, width)
    good = np.isfinite(g).all(axis=GRID)
    return g[good], np.array(sized, np.int64)[good]


def gray_scores(grid: Column, height: int, width: int) -> Column:
    """struct<sharpness, exposure, composition> of gray grids; those of grids that are missing, broken or too small are 0.5."""

    @F.pandas_udf("sharpness double, exposure double, composition double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for grids in batches:
            out = np.full((len(grids), 3), 0.5)
            g, at = _whole(grids, height, width)
            if len(g) and min(height, width) >= 2:
                out[at] = np.stack([sharpness(g), exposure_of(g), composition(g)], axis=1)
            yield pd.DataFrame(out, columns=["sharpness", "exposure", "composition"], index=grids.index)

    return run(grid)


def depth_metrics(grid: Column, height: int, width: int) -> Column:
    """struct<variance, layers> of depth grids; missing or broken ones have 0 and 1."""

    @F.pandas_udf("variance double, layers int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for grids in batches:
            variance, layers = np.zeros(len(grids)), np.ones(len(grids), np.int64)
            g, at = _whole(grids, height, width)
            if len(g):
                variance[at], layers[at] = depth(g)
            yield pd.DataFrame({"variance": variance, "layers": layers}, index=grids.index)

    return run(grid)
