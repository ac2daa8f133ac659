"""Named overlapping subsets of cases (FLT1, FLT2, FLT4).

Subsets are defined on a handful of low-cardinality columns. So a query aggregates to the finest cells first
and only then copies each cell into the subsets it belongs to: rows are never multiplied.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldaudit.functions.fields import CATEGORIES, COARSE_OPS, DOC_TYPES, FINE_OPS, SPLITS, TIERS

CELL = ("doc_type", "forgery_category", "quality_tier", "c1_op", "expected_rule")


def in_split(split: str, categories=CATEGORIES) -> Column:
    """FLT1; both terms reach a scan that stores the columns."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split}")
    return (F.col("split") == split) & F.col("forgery_category").isin(*categories)


#: The names of the analysis's subsets. A name is a path of dimension values, "/" between them.
NAMED = {
    "forged": {"forged": True}, "c0": {"forgery_category": ("C0",)}, "c1": {"forgery_category": ("C1",)}, "eligible": {"expected_rule": ("FAIL",)},
    "c1_fine": {"forgery_category": ("C1",), "c1_op": FINE_OPS}, "c1_coarse": {"forgery_category": ("C1",), "c1_op": COARSE_OPS},
}
#: Subsets made by narrowing a named one (or none) down to every value of further dimensions.
NARROWED = (("", ("forgery_category",)), ("", ("doc_type", "forgery_category")), ("c1", ("c1_op",)), ("forged", ("doc_type",)), ("forged", ("quality_tier",)),
            ("c0", ("doc_type",)), ("c0", ("quality_tier",)), ("c0", ("doc_type", "quality_tier")), ("c1", ("quality_tier",)))
VALUES = {"forgery_category": CATEGORIES, "doc_type": DOC_TYPES, "quality_tier": TIERS, "c1_op": FINE_OPS + COARSE_OPS}


def _predicate(filters: dict) -> Column:
    """All filters of a subset: the values a dimension may have; ``forged`` is any category but C0."""
    terms = [F.col("forgery_category") != "C0" if d == "forged" else F.col(d).isin(*allowed) for d, allowed in filters.items()]
    return reduce(lambda a, b: a & b, terms)


def case_filters() -> dict[str, dict]:
    """FLT2. The named subsets of the analysis: per CELL column the values it may have; ``forged``: any category but C0."""
    subsets = dict(NAMED)
    for base, dimensions in NARROWED:
        for values in product(*(VALUES[d] for d in dimensions)):
            name = "/".join([base] * bool(base) + list(values))
            subsets[name] = NAMED.get(base, {}) | {d: (v,) for d, v in zip(dimensions, values)}
    return subsets


def case_masks() -> dict[str, Column]:
    """The named subsets as predicates on CELL columns."""
    return {name: _predicate(filters) for name, filters in case_filters().items()}


def explode_masks(cells: DataFrame, masks: dict[str, Column], name: str = "mask") -> DataFrame:
    """One row per (input row, subset it belongs to). Feed it pre-aggregated cells."""
    member = F.array_compact(F.array(*[F.when(p, F.lit(m)) for m, p in masks.items()]))
    return cells.withColumn(name, F.explode(member))


def genuine_strata() -> dict[str, Column]:
    """FLT4. Overlapping strata of genuine rows used by the loose/strict comparison."""
    ns, src = F.col("naming_stratum"), F.col("pan_fifth_source")
    return {
        "ALL": F.lit(True), "surname_last": ns == "surname_last", "initial_first": ns == "initial_first",
        "mononymic": ns == "mononymic", "p5src:leading_initial": src == "leading_initial",
        "p5src:given_name": src == "given_name",
    }


def has_text(map_col: str) -> Column:
    """FLT3: rows with extracted text."""
    return F.coalesce(F.size(map_col) > 0, F.lit(False))


def valid_score(score: str) -> Column:
    """FLT5: present and finite."""
    c = F.col(score)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def valid_decision(decision: str) -> Column:
    """FLT5: 0 or 1."""
    return F.coalesce(F.col(decision).isin(0, 1), F.lit(False))


def labelled_tiles(tiles: DataFrame) -> DataFrame:
    """FLT6: drops tiles marked to be ignored."""
    return tiles.where(F.col("label") != -1)
