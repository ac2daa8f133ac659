"""Seeded draws that depend only on the row's key, never on partitioning (FN19).

A draw is the first 60 bits of an md5 over ``seed|part|part...``. The same value comes out of any
engine with md5, on any number of executors and after any retry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def draw_hex(*parts, seed: int = SEED) -> Column:
    """Hex digest of the key; sorts like the draw and can be cut into range buckets."""
    return F.md5(F.concat_ws("|", F.lit(seed).cast("string"), *[_col(p).cast("string") for p in parts]))


def hex_to_long(hex_col: Column, digits: int = 15) -> Column:
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("long")


def draw(*parts, seed: int = SEED) -> Column:
    """60-bit non-negative integer draw."""
    return hex_to_long(draw_hex(*parts, seed=seed))


def seed_for(*parts, seed: int = SEED) -> Column:
    """31-bit seed for an id tuple."""
    return F.pmod(draw(*parts, seed=seed), F.lit(2147483648)).cast("long")


def int_div(a, b) -> Column:
    return F.call_function("div", _col(a), _col(b))


class Digits:
    """Reads one draw as mixed-radix digits, so one md5 serves several choices."""

    def __init__(self, value: Column):
        self._value = value
        self._used = 1

    def take(self, n: int) -> Column:
        rest = self._value if self._used == 1 else int_div(self._value, F.lit(self._used).cast("long"))
        self._used *= n
        return F.pmod(rest, F.lit(n).cast("long"))


def choose(values, index: Column) -> Column:
    """Element of a fixed list of texts by zero-based index; the list is one constant in the plan."""
    return F.get(F.split(F.lit(",".join(values)), ","), index.cast("int"))
