"""Models as columns: a model is loaded once per Python worker, when its first batch comes, and gets whole batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_LOADED: dict[Any, Callable] = {}


def loaded(key: Any, load: Callable[[], Callable]) -> Callable:
    """The model of this worker under ``key``."""
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]


def pick_device(there: Callable[[str], bool], order: tuple[str, ...] = ("mps", "cuda", "cpu")) -> str:
    """The first device that is there."""
    return next((d for d in order if there(d)), "cpu")


def _model_column(load: Callable[[], Callable], key: str, kind: str, finish: Callable, images: Column) -> Column:
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            model, out = loaded(key, load), [None] * len(batch)
            there = [i for i, v in enumerate(batch) if v is not None]
            try:
                made = model([batch.iloc[i] for i in there]) if there else []
            except Exception:  # one broken image mustn't cost the batch its results
                made = []
                for i in there:
                    try:
                        made.append(model([batch.iloc[i]])[0])
                    except Exception:
                        made.append(None)
            for i, v in zip(there, made, strict=True):
                out[i] = None if v is None else finish(v)
            yield pd.Series(out, index=batch.index, dtype="object")

    return run(images)


def _unit(v) -> list[float] | None:
    v = np.asarray(v, np.float64).ravel()
    n = np.linalg.norm(v)
    return (v / n).tolist() if np.isfinite(n) and n > 0 else None


def embedding(images: Column, load: Callable[[], Callable[[list], list]], key: str) -> Column:
    """array<double> of length 1 by the model that ``load`` gives, called with a list of images; null for null and where the model fails."""
    return _model_column(load, key, "array<double>", _unit, images)


def depth_map(images: Column, load: Callable[[], Callable[[list], list]], key: str) -> Column:
    """array<array<double>> of rows of depths, as ``embedding``."""
    return _model_column(load, key, "array<array<double>>", lambda v: np.asarray(v, np.float64).tolist(), images)
