"""Random places that depend on a seed and an ordinal alone, by one rule in numpy, in columns and in SQL.

Two draws of 31 bits, each from three steps of a linear congruence with the high bits folded in, make a place of 62 bits modulo the total.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The modulus 2^31 - 1 and a multiplier of full period.
P, A, C, STEPS = 2147483647, 48271, 12345, 3


def _seeded(seed: int) -> int:
    return seed % P * 7919 % P


def places(ordinals: np.ndarray, total: int, seed: int) -> np.ndarray:
    """A place from 0 to total - 1 for each ordinal."""

    def draw(x: np.ndarray) -> np.ndarray:
        x = x % P
        for _ in range(STEPS):
            x = (x * A + C) % P
            x = (x ^ (x >> 15)) % P
        return x

    o = ordinals.astype(np.int64) * 2 + _seeded(seed)
    return (draw(o) * (1 << 31) + draw(o + 1)) % total


def place_column(ordinal: Column, total: Column | int, seed: int) -> Column:
    def draw(x: Column) -> Column:
        x = x % P
        for _ in range(STEPS):
            x = (x * A + C) % P
            x = x.bitwiseXOR(F.shiftright(x, 15)) % P
        return x

    o = ordinal.cast("long") * 2 + _seeded(seed)
    return (draw(o) * F.lit(1 << 31) + draw(o + 1)) % (F.lit(total) if isinstance(total, int) else total)


def places_sql(ordinal: str, total: str, seed: int) -> str:
    """The same as an expression of SQL."""

    def draw(x: str) -> str:
        x = f"(({x}) % {P})"
        for _ in range(STEPS):
            x = f"list_transform([({x} * {A} + {C}) % {P}], lambda y: xor(y, y >> 15) % {P})[1]"
        return x

    o = f"(CAST({ordinal} AS BIGINT) * 2 + {_seeded(seed)})"
    return f"({draw(o)} * {1 << 31} + {draw(f'{o} + 1')}) % ({total})"
