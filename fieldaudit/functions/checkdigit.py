"""Verhoeff check digit (FN1, FN2) as codegen-friendly column expressions.

The scheme multiplies permuted digits in the dihedral group of order ten. Because that product is
associative, a 12-digit string is four products of three digits. Each three-digit product is one
lookup in a 1000-entry table made below from the group rule, so one check costs four lookups
and three multiplications instead of a twelve-step loop.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value of the scheme: the generating permutation of the digits.
GENERATOR = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def multiply(a: int, b: int) -> int:
    """Product in the dihedral group of the pentagon: 0-4 rotations, 5-9 reflections."""
    ra, rb = a % 5, b % 5
    rotation = (ra + rb) % 5 if a < 5 else (ra - rb) % 5
    return rotation + 5 * ((a >= 5) != (b >= 5))


def permute(position: int, digit: int) -> int:
    """The generating permutation applied ``position`` times (its order is eight)."""
    for _ in range(position % 8):
        digit = GENERATOR[digit]
    return digit


def inverse(a: int) -> int:
    return (5 - a) % 5 if a < 5 else a


class _Table:
    """Lookup table as one constant text, which the optimizer folds into an array once per plan."""

    def __init__(self, values):
        self._cells = F.split(F.lit(",".join(str(v) for v in values)), ",")

    def at(self, index: Column) -> Column:
        return F.get(self._cells, index).cast("int")


def multiplication_table() -> list[int]:
    return [multiply(a, b) for a in range(10) for b in range(10)]


def permutation_table() -> list[int]:
    return [permute(i, d) for i in range(8) for d in range(10)]


def triple_table(offset: int) -> list[int]:
    """Product of a three-digit block whose last digit stands ``offset`` places from the right."""
    return [
        multiply(multiply(permute(offset, v % 10), permute(offset + 1, v // 10 % 10)), permute(offset + 2, v // 100))
        for v in range(1000)
    ]


def _product12(s: Column) -> Column:
    table = _Table(multiplication_table())
    block = [_Table(triple_table(offset)).at(F.substring(s, 10 - offset, 3).cast("int")) for offset in (0, 3, 6, 9)]
    result = block[0]
    for b in block[1:]:
        result = table.at(result * 10 + b)
    return result


def product(s: Column) -> Column:
    """Group product of a digit string of any length."""
    table, perm = _Table(multiplication_table()), _Table(permutation_table())
    places = F.sequence(F.lit(0), F.length(s) - 1)

    def step(c, i):
        digit = F.substr(s, F.length(s) - i, F.lit(1)).cast("int")
        return table.at(c * 10 + perm.at(F.pmod(i, F.lit(8)) * 10 + digit))

    return F.when(F.length(s) > 0, F.aggregate(places, F.lit(0), step))


def is_consistent(s: Column) -> Column:
    """FN1. True if the digit string carries its own check digit; null for anything but ASCII digits."""
    digits = s.rlike(r"\A[0-9]+\z")
    return F.when(digits & (F.length(s) == 12), _product12(s) == 0).when(digits, product(s) == 0)


def is_consistent12(s: Column) -> Column:
    """FN1 for a string already known to hold twelve ASCII digits."""
    return _product12(s) == 0


def check_digit(payload: Column) -> Column:
    """FN2. Check digit of the preceding digits; null for anything but ASCII digits."""
    digit = _Table(inverse(a) for a in range(10)).at(product(F.concat(payload, F.lit("0"))))
    return F.when(payload.rlike(r"\A[0-9]+\z"), digit.cast("string"))


def append_check_digit(payload: Column) -> Column:
    return F.concat(payload, check_digit(payload))


def append_check_digit11(payload: Column) -> Column:
    """FN2 for a payload already known to hold eleven ASCII digits."""
    digit = _Table(inverse(a) for a in range(10)).at(_product12(F.concat(payload, F.lit("0"))))
    return F.concat(payload, digit.cast("string"))
