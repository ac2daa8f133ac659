"""Bit fingerprints and Hamming distance: FN23, FN24, FN26."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def median(sorted_values: Column) -> Column:
    n = F.size(sorted_values)
    low = F.element_at(sorted_values, F.floor((n + 1) / 2).cast("int"))
    high = F.element_at(sorted_values, F.floor(n / 2).cast("int") + 1)
    return (low.cast("double") + high.cast("double")) / 2


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bits_above(values: Column, threshold: Column) -> Column:
    """One bit per value, the first is the top bit: whether it is above the threshold."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda h, v: F.shiftleft(h, 1).bitwiseOR(
        F.when(v.cast("double") > threshold, F.lit(1)).otherwise(F.lit(0)).cast("long")))


def threshold_of(values: Column) -> Column:
    """The median of all values but the first."""
    return held(F.sort_array(F.slice(values, 2, F.size(values) - 1)), median)


def fingerprint(values: Column) -> Column:
    """FN23. One bit per value: above the median of all values but the first; first value is the top bit.

    Up to 64 values; the result is a signed long (XOR and bit counts do not mind the sign).
    """
    return held(threshold_of(values), lambda t: bits_above(values, t))


def fingerprint_words(values: Column, words: int) -> Column:
    """FN23 for 64 x ``words`` values (256 bits is four longs): one threshold, one long per 64 values."""
    return held(threshold_of(values), lambda t: F.array(*[bits_above(F.slice(values, 64 * w + 1, 64), t) for w in range(words)]))


def hamming(a: Column, b: Column) -> Column:
    """FN24."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_words(a: Column, b: Column, words: int) -> Column:
    """FN24 for fingerprints of several longs."""
    total = hamming(F.get(a, F.lit(0)), F.get(b, F.lit(0)))
    for w in range(1, words):
        total = total + hamming(F.get(a, F.lit(w)), F.get(b, F.lit(w)))
    return total


def content_digest(content: Column) -> Column:
    """FN26."""
    return F.sha2(content, 256)
