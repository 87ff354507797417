"""Plug-in points for learned models: a probability column, or a function over whole tiles. No weights are part of this library."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landcube.functions.indices import clamp
from landcube.operators.blocks import mapped


def with_probability(cells: DataFrame, model: Column | None = None) -> DataFrame:
    """``model_prob`` in 0..1 from any column expression; 0.5, which says nothing, without a model or where it gives NULL."""
    return cells.withColumn("model_prob", clamp(F.coalesce(F.lit(0.5) if model is None else model, F.lit(0.5)), 0.0, 1.0))


def segmented(blocks: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], years: list[int], channel: str = "cls") -> DataFrame:
    """Blocks of the classes, or of any one value, that a model gives each pixel of whole tiles (:mod:`blocks`).

    ``load`` runs once for each task and returns the model, which gets (year, channel, row, column), zeros beyond the image,
    and gives (year, row, column) for ``years``.
    """
    return mapped(blocks, load, years, [channel])


def linear_model(weights: np.ndarray, bias: float) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A model of one probability a pixel: the logistic of a weighted sum over years and channels. Weights: (year, channel)."""

    def load() -> Callable[[np.ndarray], np.ndarray]:
        return lambda x: 1 / (1 + np.exp(-(np.einsum("tcrk,tc->rk", x, weights) + bias)))

    return load
