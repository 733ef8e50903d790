"""SplitMix64 as a function of a row's number, so that any row's draw can be made anywhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

#: The generator's increment and multipliers.
GAMMA, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def splitmix64(seed: int, number: np.ndarray) -> np.ndarray:
    """The outputs number 1, 2, ... of the generator."""
    u = np.uint64
    z = u(seed) + np.asarray(number).astype(u) * u(GAMMA)
    z = (z ^ (z >> u(30))) * u(FIRST)
    z = (z ^ (z >> u(27))) * u(SECOND)
    return z ^ (z >> u(31))


def unit_floats(seed: int, number: np.ndarray) -> np.ndarray:
    """Floats in [0, 1): the top 24 bits."""
    return ((splitmix64(seed, number) >> np.uint64(40)).astype(np.float32)) / np.float32(1 << 24)


def bounded(seed: int, number: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Draws below `bound`; 0 where bound is 1 or less."""
    b = np.maximum(np.asarray(bound), 1).astype(np.uint64)
    return (splitmix64(seed, number) % b).astype(np.int64)


def bounded_column(seed: int, number: Column, bound: Column) -> Column:
    @F.pandas_udf("bigint")
    def draw(n: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(bounded(seed, n.to_numpy(), b.to_numpy()))

    return draw(number, bound)
