"""Exact global positions without one task seeing everything (WIN8, WIN9, WIN13, WIN14 build on these).

Rows are ordered by a hash of their id. Its first three hex digits cut the order into 4096 ranges, the next three cut each of
these again, so a position is the count of all earlier ranges, of the earlier parts of its range, and the row number inside
its part: one row in 2^24. Only the table of the 4096 range counts is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldaudit.functions.draws import SEED, draw_hex

# The 20-step cycle that the largest-deficit rule for shares 70/15/15 settles into.
SPLIT_CYCLE = ("train train test train val train train train test train "
               "train val train train train test train val train train").split()


def with_position(df: DataFrame, id_col: str, strata=(), within=(), tag: str = "order", seed: int = SEED,
                  out: str = "position") -> DataFrame:
    """Zero-based position in the order (strata..., hash of id, id).

    With ``within`` the count restarts in every group of those columns. ``strata`` only order.
    """
    strata, within = list(strata), list(within)
    df = df.withColumn("_h", draw_hex(F.col(id_col), tag, seed=seed))
    df = df.withColumns({"_b": F.substring("_h", 1, 3), "_c": F.substring("_h", 4, 3)})
    wide = within + strata + ["_b"]
    cells = df.groupBy(*wide, "_c").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy(*strata, "_b") if not within else Window.partitionBy(*within).orderBy(*strata, "_b")
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outer = cells.groupBy(*wide).agg(F.sum("_n").alias("_n")).withColumn("_off", before(order)).drop("_n")
    inner = cells.withColumn("_in", before(Window.partitionBy(*wide).orderBy("_c"))).drop("_n").join(outer, wide)
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*wide, "_c").orderBy("_h", id_col)))
    joined = ranked.join(inner, [*wide, "_c"])
    return joined.withColumn(out, (F.col("_off") + F.col("_in") + F.col("_rn") - 1).cast("long")).drop("_h", "_b", "_c", "_off", "_in", "_rn")


def assign_splits(people: DataFrame, id_col: str, strata, seed: int = SEED) -> DataFrame:
    """WIN8, WIN9. Person-level split, stratified and shuffled inside each stratum.

    The running largest-deficit rule depends on positions only, so the split is a lookup in its cycle.
    """
    out = with_position(people, id_col, strata=strata, tag="split", seed=seed)
    cycle = F.array(*[F.lit(s) for s in SPLIT_CYCLE])
    return out.withColumn("split", F.element_at(cycle, (F.pmod("position", F.lit(20)) + 1).cast("int")))


def first_by_hash(df: DataFrame, id_col: str, quota: DataFrame, within, tag: str, seed: int = SEED) -> DataFrame:
    """Rows that come first in their group by the hash of their id, as many as the group's quota (column ``quota``).

    Bottom-k by a threshold: two histograms of the hash (4096 cells, then 4096 parts of the border cell) say which cells lie
    wholly below the quota. Their rows are kept in the scan; only the rows of the border part, one in 2^24, are ranked.
    ``quota`` has one row per group, as have the borders, so these are broadcast. Groups are matched like join keys: null in none.
    """
    within = list(within)
    rows = df.join(F.broadcast(quota), within).withColumn("_h", draw_hex(F.col(id_col), tag, seed=seed))
    rows = rows.withColumns({"_b": F.substring("_h", 1, 3), "_c": F.substring("_h", 4, 3)})

    def border(cells: DataFrame, cell: str, room: str, out: str) -> DataFrame:
        """Per group the cell in which the quota runs out, and the room left there; none where all rows fit."""
        sums = cells.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*within).orderBy(cell)))
        first = sums.where(F.col("_upto") > F.col(room)).groupBy(*within).agg(F.min(F.struct(cell, (F.col(room) - F.col("_upto") + F.col("_n")).alias("_room"))).alias("_m"))
        return first.select(*within, F.col(f"_m.{cell}").alias(f"{out}"), F.col("_m._room").alias(f"{out}_room"))

    outer = border(rows.groupBy(*within, "_b").agg(F.count(F.lit(1)).alias("_n"), F.first("quota").alias("_q")), "_b", "_q", "_edge")
    rows = rows.join(F.broadcast(outer), within, "left")
    at_edge = rows.where(F.col("_b") == F.col("_edge"))
    inner = border(at_edge.groupBy(*within, "_c").agg(F.count(F.lit(1)).alias("_n"), F.first("_edge_room").alias("_q")), "_c", "_q", "_part")
    rows = rows.join(F.broadcast(inner), within, "left")
    on_edge = F.col("_b") == F.col("_edge")
    whole = F.col("_edge").isNull() | (F.col("_b") < F.col("_edge")) | (on_edge & (F.col("_c") < F.col("_part")))
    last = rows.where(on_edge & (F.col("_c") == F.col("_part"))).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*within).orderBy("_h", id_col))).where(F.col("_rn") <= F.col("_part_room")).drop("_rn")
    return rows.where(whole).unionByName(last).select(*df.columns)


def balanced_sample(df: DataFrame, id_col: str, label: str, cap: int | None = None, seed: int = SEED) -> DataFrame:
    """WIN13. The same number of rows per class: the smallest class size, or ``cap`` where the rows are for a fit of bounded size.

    The quota table has one row per class, so it is broadcast. ``position`` numbers the rows that are kept.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    least = sizes.agg(F.least(F.min("n"), F.lit(cap).cast("long")).alias("quota"))
    quota = sizes.select(label, least.scalar().alias("quota"))
    return with_position(first_by_hash(df, id_col, quota, [label], "balance", seed), id_col, within=[label], tag="balance", seed=seed)


def epoch_sample(df: DataFrame, id_col: str, label: str, ratio: int, epochs: int, seed: int = SEED) -> DataFrame:
    """WIN14. Per epoch all positives and ``ratio`` times as many negatives, drawn anew.

    Every epoch keeps the negatives with the smallest draws of that epoch.
    """
    positives = df.where(F.col(label) == 1)
    n = positives.agg((F.count(F.lit(1)) * ratio).alias("quota"))
    epoch = F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch")
    negatives = df.where(F.col(label) == 0).select(epoch, "*")
    negatives = negatives.withColumn("_key", F.concat_ws(":", "epoch", id_col))
    quota = df.sparkSession.range(1, epochs + 1).select(F.col("id").cast("int").alias("epoch"), n.scalar().alias("quota"))
    drawn = first_by_hash(negatives, "_key", quota, ["epoch"], "epoch", seed).drop("_key")
    return positives.select(epoch, "*").unionByName(drawn)


def first_seen(df: DataFrame, key, arrival: Column) -> DataFrame:
    """WIN12, SET7. First row per key in arrival order; partial aggregation keeps hot keys cheap."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(arrival.alias("_at"), *rest)).alias("_first"))
    return best.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def epoch_plan(epochs: DataFrame, metric: str, patience: int, run: str = "run") -> DataFrame:
    """WIN15. Best epoch and stop epoch per run under patience (strict improvement).

    Every improvement is a first occurrence of the running maximum. The run stops at the first epoch
    that is ``patience`` past the last improvement; epochs after that are not seen.
    """
    w = Window.partitionBy(run).orderBy("epoch")
    before = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = epochs.withColumn("_gain", before.isNull() | (F.col(metric) > before))
    df = df.withColumn("_last", F.max(F.when(F.col("_gain"), F.col("epoch"))).over(w))
    df = df.withColumn("_stop", F.col("epoch") - F.col("_last") >= patience)
    stop = df.groupBy(run).agg(F.min(F.when(F.col("_stop"), F.col("epoch"))).alias("_s"), F.max("epoch").alias("_e"))
    seen = df.join(stop, run).where(F.col("epoch") <= F.coalesce("_s", "_e"))
    return seen.groupBy(run).agg(
        F.max(F.when(F.col("_gain"), F.col("epoch"))).alias("best_epoch"),
        F.max("epoch").alias("stop_epoch"), F.max(metric).alias("best_value"))
