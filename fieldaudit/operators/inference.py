"""Cluster bootstrap and multiple testing: STA1-STA9, STA18, WIN7.

Rows are reduced to counts per (cluster, cell) first. The weight of a cluster in a replicate is a Poisson(1) count, a function
of (seed, replicate, cluster) alone: it is computed where it is needed, at every table size, so paired measures share
their weights without a weight table or a join. Eight replicates share one digest. Tasks take the clusters in batches and add
counts times weights as matrix products; what is exchanged has a row per task, cell and eight replicates, never one per cluster
and replicate.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldaudit.functions.draws import SEED, draw_hex
from fieldaudit.operators.ranking import running_totals

LANES = 8  # replicates that one digest serves, four hexadecimal digits each
#: A draw of 16 bits counts the borders it reaches. P(weight > 7) is 1.0e-5, and 1.1e-6 for 8: no more borders fit below 2^16.
POISSON_BORDERS = tuple(f"{round(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))):04x}" for k in range(8))


def lane_weights(cluster: Column, block: Column, seed: int = SEED) -> list[Column]:
    """STA3. The weights of a cluster in the replicates ``LANES * block`` and following."""
    digest = draw_hex(block, cluster, "boot", seed=seed)
    out = []
    for lane in range(LANES):
        u = F.substring(digest, 4 * lane + 1, 4)
        w = F.when(u < POISSON_BORDERS[0], 0)
        for k, border in enumerate(POISSON_BORDERS[1:], 1):
            w = w.when(u < border, k)
        out.append(w.otherwise(len(POISSON_BORDERS)))
    return out


def with_lanes(counts: DataFrame, cluster: str, replicates: int, seed: int = SEED) -> DataFrame:
    """Every row once per block of replicates, with its weights ``_w0`` and following."""
    blocks = F.sequence(F.lit(0), F.lit((replicates - 1) // LANES))
    df = counts.withColumn("_block", F.explode(blocks))
    return df.withColumns({f"_w{k}": w for k, w in enumerate(lane_weights(F.col(cluster), F.col("_block"), seed))})


def weights(clusters: DataFrame, cluster: str, replicates: int, seed: int = SEED) -> DataFrame:
    """STA3. The same weights as rows (b, cluster, w), for callers that want them; zero weights are left out."""
    df = with_lanes(clusters.select(cluster).distinct(), cluster, replicates, seed)
    return by_replicate(df, [cluster], {"w": "_w{}"}, replicates).where("w > 0").select("b", cluster, "w")


def by_replicate(df: DataFrame, keys, columns: dict[str, str], replicates: int) -> DataFrame:
    """(keys, b, columns) from rows whose columns stand side by side for the replicates of a block."""
    lanes = F.explode(F.array(*[F.struct((F.col("_block") * LANES + k).alias("b"), *[F.col(c.format(k)).alias(n) for n, c in columns.items()])
                                for k in range(LANES)]))
    return df.select(*keys, lanes.alias("_lane")).select(*keys, "_lane.*").where(F.col("b") < replicates)


#: The same borders as a table over all draws of 16 bits.
POISSON_OF = np.searchsorted([int(x, 16) for x in POISSON_BORDERS], np.arange(65536), side="right").astype("float32")
POISSON_SWAPPED = POISSON_OF.reshape(256, 256).T.reshape(-1).copy()  # by the draw's two bytes in the other order
SIDE, BLOCKS = 1024, 64  # clusters and blocks of replicates whose weights a task holds at a time
SUMS_BYTES = 128 << 20  # sums that a task holds before it gives them out


def draw_tail(cluster: str) -> Column:
    """What follows the block's number in the text that ``lane_weights`` digests."""
    return F.concat_ws("|", F.lit(""), F.col(cluster).cast("string"), F.lit("boot"))


#: Fixed values of md5 (RFC 1321): shifts per round of 16 steps, additive constants, first state.
MD5_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
MD5_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


MD5_BATCH = 16384  # texts whose state stays in a core's cache


def md5_all(texts: np.ndarray) -> np.ndarray:
    """md5 of many texts of one length, at most 55 bytes, (n, length) to (n, 16), a step for a batch at once: several times as fast as hashlib."""
    n, length = texts.shape
    words = length // 4 + 1  # with the end mark; the others are 0, but for the length
    out = np.empty((n, 4), "<u4")
    for low in range(0, n, MD5_BATCH):
        part = texts[low:low + MD5_BATCH]
        block = np.zeros((len(part), 4 * words), "uint8")
        block[:, :length], block[:, length] = part, 0x80
        m = np.ascontiguousarray(block.view("<u4").T)
        a, b, c, d = (np.full(len(part), x, "uint32") for x in MD5_START)
        f, other = np.empty(len(part), "uint32"), np.empty(len(part), "uint32")
        for i in range(64):
            turn, g = divmod(i, 16)
            if turn == 0:
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
            elif turn == 1:
                g = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
            elif turn == 2:
                g = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
            else:
                g = 7 * i % 16
                np.invert(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
            f += a
            f += np.uint32(MD5_ADDED[i] + (8 * length if g == 14 and words <= 14 else 0) & 0xFFFFFFFF)
            if g < words:
                f += m[g]
            shift = MD5_SHIFTS[turn][i % 4]
            np.left_shift(f, np.uint32(shift), out=other)
            np.right_shift(f, np.uint32(32 - shift), out=f)
            np.bitwise_or(f, other, out=f)
            f += b
            a, d, c, b, f = d, c, b, f, a
        for i, (x, start) in enumerate(zip((a, b, c, d), MD5_START)):
            out[low:low + len(part), i] = x + np.uint32(start)
    return out.view("uint8")


def weight_matrix(tails: list[bytes], blocks: range, seed: int) -> np.ndarray:
    """``lane_weights`` of clusters (columns) in the replicates of the blocks (rows); a cluster's weights lie side by side in memory."""
    out = np.empty((len(tails), len(blocks), LANES), "float32")
    heads = [b"%d|%d" % (seed, block) for block in blocks]
    alike = lambda texts: [(n, [i for i, t in enumerate(texts) if len(t) == n]) for n in sorted({len(t) for t in texts})]
    for size, which in alike(tails):
        body = np.frombuffer(b"".join(tails[i] for i in which), "uint8").reshape(len(which), 1, size)
        for length, rows in alike(heads):
            if length + size <= 55:
                texts = np.empty((len(which), len(rows), length + size), "uint8")
                texts[:, :, :length] = np.frombuffer(b"".join(heads[r] for r in rows), "uint8").reshape(len(rows), length)
                texts[:, :, length:] = body
                digests = md5_all(texts.reshape(-1, length + size))
            else:
                digests = np.frombuffer(b"".join(hashlib.md5(heads[r] + tails[i], usedforsecurity=False).digest() for i in which for r in rows), "uint8")
            weights_of = POISSON_SWAPPED[digests.reshape(-1).view("<u2").reshape(len(which), len(rows), LANES)]
            if len(which) == len(tails) and len(rows) == len(heads):
                out = weights_of
            else:
                out[np.ix_(which, rows)] = weights_of
    return out.reshape(len(tails), -1).T


def key_codes(columns: list[pa.Array], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by their combination of key values: the first row of each combination, and every row's combination."""
    codes = np.zeros(n, "int64")
    for c in columns:
        d = c.dictionary_encode(null_encoding="encode")
        codes = np.unique(codes * max(len(d.dictionary), 1) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return np.unique(codes, return_index=True, return_inverse=True)[1:]


def numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64(), safe=False).fill_null(0.0).to_numpy(zero_copy_only=False)


def sum_parts(df: DataFrame) -> int:
    """Tasks of the weighted sums: by the cluster, not by the data, as each gives out sums of one size."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, 24)


def block_sums(counts: DataFrame, cluster: str, replicates: int, keys, values, seed: int = SEED) -> DataFrame:
    """Weighted sums of per-cluster counts (keys, _block, and ``_<value>_<lane>`` for the replicates of the block).

    The cells of a cluster are nested in one row first: keys name a few cells (a subset, a class), not a score. Whole numbers are
    added exactly up to 2^53.
    """
    keys, values = list(keys), list(values)
    kinds = {c: counts.schema[c].dataType for c in [*keys, *values]}
    out = {v: T.LongType() if isinstance(kinds[v], T.IntegralType) else T.DoubleType() for v in values}
    lanes = [f"_{v}_{k}" for v in values for k in range(LANES)]
    schema = T.StructType([*[T.StructField(k, kinds[k]) for k in keys], T.StructField("_block", T.IntegerType()),
                           *[T.StructField(f"_{v}_{k}", out[v]) for v in values for k in range(LANES)]])
    n_blocks, width = (replicates - 1) // LANES + 1, len(values)
    nested = counts.groupBy(cluster).agg(F.collect_list(F.struct(*keys, *values)).alias("_cells")).select(draw_tail(cluster).alias("_tail"), "_cells")

    def emit(names, sums, seen):
        cells = len(names[0]) if keys else 1
        # (cells, values, blocks, lanes) to one row per cell and block
        table = sums.reshape(cells, width, n_blocks, LANES).transpose(1, 3, 0, 2).reshape(width, LANES, -1)
        there = np.repeat(seen, n_blocks, axis=0)
        row = np.repeat(np.arange(cells), n_blocks)
        columns = [pa.array(n).take(pa.array(row)) if not isinstance(n, pa.Array) else n.take(pa.array(row)) for n in names]
        columns.append(pa.array(np.tile(np.arange(n_blocks, dtype="int32"), cells)))
        for i, v in enumerate(values):
            for k in range(LANES):
                x = pa.array(table[i, k], mask=~there[:, i])
                columns.append(x.cast(pa.int64()) if isinstance(out[v], T.LongType) else x)
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "_block", *lanes])

    def add_up(batches):
        places, names, sums, seen = {}, [[] for _ in keys], np.zeros((0, n_blocks * LANES)), np.zeros((0, width), bool)
        kinds_of = None
        for batch in batches:
            for start in range(0, batch.num_rows, SIDE):
                part = batch.slice(start, SIDE)
                cells = part.column(1)
                who = np.repeat(np.arange(part.num_rows), cells.value_lengths().to_numpy(zero_copy_only=False))
                flat = cells.flatten()
                kinds_of = [flat.field(i).type for i in range(len(keys))]
                first, code = key_codes([flat.field(i) for i in range(len(keys))], len(flat))
                found = list(zip(*[flat.field(i).take(pa.array(first)).to_pylist() for i in range(len(keys))])) if keys else [()]
                if sums.nbytes and (len(places) + len(found)) * width * n_blocks * LANES * 8 > SUMS_BYTES and any(f not in places for f in found):
                    yield emit([pa.array(n, t) for n, t in zip(names, kinds_of)], sums, seen)
                    places, names, sums, seen = {}, [[] for _ in keys], np.zeros((0, n_blocks * LANES)), np.zeros((0, width), bool)
                for f in found:
                    if f not in places:
                        places[f] = len(places)
                        for n, x in zip(names, f):
                            n.append(x)
                grown = len(places) - len(seen)
                if grown:
                    sums = np.concatenate([sums, np.zeros((grown * width, n_blocks * LANES))])
                    seen = np.concatenate([seen, np.zeros((grown, width), bool)])
                held = np.zeros((len(found) * width, part.num_rows))
                rows = np.array([places[f] for f in found])
                for i in range(width):
                    v = flat.field(len(keys) + i)
                    np.add.at(held, (code * width + i, who), numbers(v))
                    seen[rows, i] |= np.bincount(code, v.is_valid().to_numpy(zero_copy_only=False), len(found)) > 0
                into = (rows[:, None] * width + np.arange(width)).ravel()
                tails = [t.encode() for t in part.column(0).to_pylist()]
                # Whole numbers whose weighted sums stay below 2^24 are added exactly in single precision, at twice the speed.
                if np.abs(held).sum(axis=1).max(initial=0.0) * len(POISSON_BORDERS) < 2**24 and (held == np.rint(held)).all():
                    held = held.astype("float32")
                for low in range(0, n_blocks, BLOCKS):
                    some = range(low, min(low + BLOCKS, n_blocks))
                    sums[into, low * LANES:some.stop * LANES] += held @ weight_matrix(tails, some, seed).T
        if len(places):
            yield emit([pa.array(n, t) for n, t in zip(names, kinds_of or [])], sums, seen)

    return nested.mapInArrow(add_up, schema).groupBy(*keys, "_block").agg(*[F.sum(c).alias(c) for c in lanes])


def replicate_sums(counts: DataFrame, cluster: str, replicates: int, keys, values, seed: int = SEED) -> DataFrame:
    """Weighted sums of per-cluster counts for every replicate: (keys, b, values)."""
    return by_replicate(block_sums(counts, cluster, replicates, keys, values, seed), keys, {v: f"_{v}_{{}}" for v in values}, replicates)


BETWEEN = "\x1f"  # between the subsets in the name of a cell


def rate_counts(df: DataFrame, cluster: str, systems: dict[str, str], masks: dict[str, Column]) -> DataFrame:
    """Numerators k_<system> and the shared denominator ``den`` of flag rates per (cluster, cell).

    A cell is a combination of the subsets ``masks``, named after them; rows in none of them are in no rate. Systems stay side by side as
    columns, and subsets are not multiplied out, until replicates have been summed. Rows meet by cluster once, for the cells and for all that follows.
    """
    cell = F.concat_ws(BETWEEN, *[F.when(p, F.lit(m)) for m, p in masks.items()])
    rows = df.select(cluster, cell.alias("cell"), *[F.col(c).alias(f"k_{s}") for s, c in systems.items()]).where("cell <> ''")
    rows = rows.repartition(max(sum_parts(df), df.rdd.getNumPartitions()), cluster)
    return rows.groupBy(cluster, "cell").agg(
        F.count(F.lit(1)).alias("den"), *[F.sum(f"k_{s}").cast("long").alias(f"k_{s}") for s in systems])


def _by_mask(sums: DataFrame, keys) -> DataFrame:
    """Sums of cells put together to sums of the subsets."""
    values = [c for c in sums.columns if c not in ("cell", *keys)]
    return sums.select(F.explode(F.split("cell", BETWEEN)).alias("mask"), *keys, *values).groupBy("mask", *keys).agg(
        *[F.sum(v).alias(v) for v in values])


def _rates(sums: DataFrame, keys, systems) -> DataFrame:
    rows = F.explode(F.array(*[
        F.struct(F.lit(s).alias("system"), (F.col(f"k_{s}") / F.nullif(F.col("den"), F.lit(0))).alias("value"))
        for s in systems]))
    return sums.select(*keys, rows.alias("_r")).select(*keys, "_r.*")


def rates(counts: DataFrame, systems) -> DataFrame:
    """STA4, point values (mask, system, value); null on an empty subset."""
    sums = counts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("den", *[f"k_{s}" for s in systems])])
    return _rates(_by_mask(sums, []), ["mask"], systems)


def rate_replicates(counts: DataFrame, replicates: int, cluster: str, systems) -> DataFrame:
    """STA4, replicates (mask, system, b, value)."""
    values = ["den", *[f"k_{s}" for s in systems]]
    sums = _by_mask(block_sums(counts, cluster, replicates, ["cell"], values), ["_block"])
    return _rates(by_replicate(sums, ["mask"], {v: f"_{v}_{{}}" for v in values}, replicates), ["mask", "b"], systems)


def finite(c: str) -> Column:
    return F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))


def intervals(replicates: DataFrame, keys, value: str = "value") -> DataFrame:
    """STA6. 95% percentile interval and two-sided p over the finite replicates."""
    x = finite(value)
    out = replicates.groupBy(*keys).agg(
        F.percentile(x, F.array(F.lit(0.025), F.lit(0.975))).alias("_q"),
        F.avg((x <= 0).cast("double")).alias("_le"), F.avg((x >= 0).cast("double")).alias("_ge"),
        F.count(x).alias("n_resamples"))
    p = F.least(F.lit(1.0), 2 * F.least("_le", "_ge"))
    return out.select(*keys, F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"), p.alias("p"), "n_resamples")


def with_intervals(point: DataFrame, replicates: DataFrame, keys) -> DataFrame:
    return point.join(intervals(replicates, keys), list(keys), "left")


def bootstrap(df: DataFrame, cluster: str, label: str, decision: str, replicates: int, seed: int = SEED) -> DataFrame:
    """STA1. Recall, false-positive rate and precision with intervals; undefined replicates are skipped."""
    y, f = F.col(label) == 1, F.col(decision) == 1
    one = lambda p: F.sum(F.when(p, 1).otherwise(0))
    values = ["tp", "fp", "pos", "neg"]
    base = df.groupBy(cluster).agg(one(y & f).alias("tp"), one(~y & f).alias("fp"), one(y).alias("pos"), one(~y).alias("neg"))

    def measures(sums, keys):
        part = lambda name, num, den: F.struct(
            F.lit(name).alias("metric"), (num / F.nullif(den, F.lit(0))).alias("value"))
        rows = F.explode(F.array(part("recall", F.col("tp"), F.col("pos")), part("fpr", F.col("fp"), F.col("neg")),
                                 part("precision", F.col("tp"), F.col("tp") + F.col("fp"))))
        return sums.select(*keys, rows.alias("_m")).select(*keys, "_m.*")

    point = measures(base.agg(*[F.sum(v).alias(v) for v in values]), [])
    reps = measures(replicate_sums(base, cluster, replicates, [], values, seed), ["b"])
    return with_intervals(point, reps, ["metric"]).drop("p")


def comparisons(values: DataFrame, spec: DataFrame, extra=()) -> DataFrame:
    """STA2, STA7, STA8. Signed sums of rates, per comparison (and per replicate through ``extra``).

    ``spec`` has one row per term: (family, comparison, mask, system, sign). It is a fixed list, so it is
    broadcast. A comparison with an undefined term is null.
    """
    keys = ["family", "comparison", *extra]
    terms = values.join(F.broadcast(spec), ["mask", "system"])
    out = terms.groupBy(*keys).agg(
        F.sum(F.col("sign") * F.col("value")).alias("_v"), F.count("value").alias("_n"), F.max("terms").alias("_t"))
    return out.select(*keys, F.when(F.col("_n") == F.col("_t"), F.col("_v")).alias("value"))


def comparison_spec(spark, families: dict[str, dict[str, list[tuple[int, str, str]]]]) -> DataFrame:
    """Spec rows from {family: {comparison: [(sign, system, mask), ...]}}."""
    rows = [(f, c, mask, system, sign, len(terms)) for f, comps in families.items()
            for c, terms in comps.items() for sign, system, mask in terms]
    return spark.createDataFrame(rows, "family string, comparison string, mask string, system string, sign int, terms int")


def holm(df: DataFrame, p: str = "p", family: str = "family", id_col: str = "comparison") -> DataFrame:
    """WIN7. Step-down adjusted p values per family."""
    order = Window.partitionBy(family).orderBy(p, id_col)
    size = F.count(F.lit(1)).over(Window.partitionBy(family))
    step = F.least(F.lit(1.0), (size - F.row_number().over(order) + 1) * F.col(p))
    out = df.withColumn("_step", step)
    return out.withColumn("p_holm", F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def tested_families(counts: DataFrame, replicates: int, cluster: str, systems, spec: DataFrame) -> DataFrame:
    """STA8. Point difference, interval, p and adjusted p of every declared comparison."""
    keys = ["family", "comparison"]
    point = comparisons(rates(counts, systems), spec)
    reps = comparisons(rate_replicates(counts, replicates, cluster, systems), spec, ["b"])
    return holm(with_intervals(point, reps, keys))


def ratios(point: DataFrame, reps: DataFrame, pairs: DataFrame, compat_round: bool = False) -> DataFrame:
    """STA7. Ratio of two comparisons with an interval from ratios of replicates.

    ``pairs`` lists (ratio, top, bottom). ``compat_round`` divides percentages rounded to one decimal.
    """
    def divide(values, keys):
        v = F.round(100 * F.col("value"), 1) if compat_round and not keys else F.col("value")
        values = values.select("comparison", *keys, v.alias("value"))
        top = values.join(F.broadcast(pairs), values["comparison"] == pairs["top"]).select(
            "ratio", *keys, F.col("value").alias("_a"))
        bottom = values.join(F.broadcast(pairs), values["comparison"] == pairs["bottom"]).select(
            "ratio", *keys, F.col("value").alias("_b"))
        return top.join(bottom, ["ratio", *keys]).select(
            "ratio", *keys, F.when(F.col("_b") != 0, F.col("_a") / F.col("_b")).alias("value"))

    return with_intervals(divide(point, []), divide(reps, ["b"]), ["ratio"]).drop("p")


def auroc_replicates(df: DataFrame, replicates: int, cluster: str, label: str, score: str, keys, seed: int = SEED) -> DataFrame:
    """STA5, STA9. Weighted AUROC per replicate and curve; a replicate without both classes is null.

    Rows are ordered by score over all tasks. A batch of that order gives its least score, its greatest score and what lies between
    as three pieces, with the pairs inside the middle piece counted; a score that goes on in other batches is put together again by
    the sums. Running totals are taken over the pieces, for the replicates of a block at once. Rows without a score are a piece that lies
    below all others and counts in no class total.
    """
    keys, y, lanes, n_blocks = list(keys), F.col(label), range(LANES), (replicates - 1) // LANES + 1
    per = df.groupBy(cluster, *keys, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(y == 0, 1).otherwise(0)).alias("neg"))
    per = per.dropna(subset=keys) if keys else per  # a row without a curve is in no running total
    order = [*keys, "score", "_tail"]
    per = per.select(*keys, "score", draw_tail(cluster).alias("_tail"), "pos", "neg")
    # Equal rows may lie in several tasks: ties are put together by the sums.
    per = per.repartitionByRange(sum_parts(df), *order).sortWithinPartitions(*order)
    sides = [f"{v}_{k}" for v in ("pos", "neg", "inner") for k in lanes]
    schema = T.StructType([*[per.schema[k] for k in keys], T.StructField("_block", T.IntegerType()), T.StructField("score", T.DoubleType()),
                           T.StructField("one", T.BooleanType()), *[T.StructField(c, T.DoubleType()) for c in sides]])

    def pieces(batches):
        for batch in (b.slice(i, 4 * SIDE) for b in batches for i in range(0, b.num_rows, 4 * SIDE)):
            n = batch.num_rows
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            s, curve = at["score"].to_numpy(zero_copy_only=False), key_codes([at[k] for k in keys], n)[1]
            there = at["score"].is_valid().to_numpy(zero_copy_only=False)
            same = (there[1:] == there[:-1]) & ((s[1:] == s[:-1]) | (np.isnan(s[1:]) & np.isnan(s[:-1])))
            starts = np.flatnonzero(np.concatenate([[True], ~same | (curve[1:] != curve[:-1])]))  # rows where a score begins
            new = np.concatenate([[True], curve[starts][1:] != curve[starts][:-1]])
            last = np.concatenate([new[1:], [True]])
            # A piece begins at a curve's first score, at the one after it and at the last.
            begins = np.flatnonzero(new | last | np.concatenate([[False], new[:-1]]))
            one, first = (new | last)[begins], starts[begins]
            d = at["_tail"].dictionary_encode()
            tails, who = [t.encode() for t in d.dictionary.to_pylist()], d.indices.to_numpy(zero_copy_only=False)
            p, q = numbers(at["pos"]), numbers(at["neg"])
            hit = np.flatnonzero(p)
            place = np.searchsorted(starts, hit, side="right") - 1
            low_end, high_end = starts[place], np.append(starts, n)[place + 1]  # where the hit's score begins and ends
            cuts = np.append(np.searchsorted(hit, first), len(hit))
            ends = np.append(first, n)
            got = np.zeros((3, len(begins), n_blocks * LANES))
            for low in range(0, n_blocks, BLOCKS // 4):
                some = range(low, min(low + BLOCKS // 4, n_blocks))
                w = np.ascontiguousarray(weight_matrix(tails, some, seed))[:, who]
                upto = np.zeros((len(w), n + 1))
                np.cumsum(w * q, axis=1, out=upto[:, 1:])
                pos = w[:, hit] * p[hit]
                pairs = pos * ((upto[:, low_end] + upto[:, high_end]) / 2)  # negatives below, ties one half
                columns = slice(low * LANES, some.stop * LANES)
                for i in range(len(begins)):
                    part = slice(cuts[i], cuts[i + 1])
                    got[0, i, columns] = pos[:, part].sum(axis=1)
                    got[1, i, columns] = upto[:, ends[i + 1]] - upto[:, ends[i]]
                    got[2, i, columns] = pairs[:, part].sum(axis=1) - got[0, i, columns] * upto[:, ends[i]]
            row = np.repeat(starts[begins], n_blocks)
            columns = [at[k].take(pa.array(row)) for k in keys]
            columns += [pa.array(np.tile(np.arange(n_blocks, dtype="int32"), len(begins))), at["score"].take(pa.array(row)), pa.array(np.repeat(one, n_blocks))]
            columns += [pa.array(got[i].reshape(-1, LANES)[:, k]) for i in range(3) for k in lanes]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    sums = per.mapInArrow(pieces, schema).groupBy(*keys, "_block", "score").agg(F.bool_and("one").alias("one"), *[F.sum(c).alias(c) for c in sides])
    run = running_totals(sums, "score", [f"neg_{k}" for k in lanes], [*keys, "_block"])
    inside = lambda k: F.when(F.col("one"), F.col(f"pos_{k}") * F.col(f"neg_{k}") / 2).otherwise(F.col(f"inner_{k}"))
    out = run.groupBy(*keys, "_block").agg(
        *[F.sum(F.col(f"pos_{k}") * F.col(f"below_neg_{k}") + inside(k)).alias(f"u_{k}") for k in lanes],
        *[F.sum(f"{v}_{k}").alias(f"n_{v}_{k}") for v in ("pos", "neg") for k in lanes])
    out = by_replicate(out, keys, {"u": "u_{}", "n_pos": "n_pos_{}", "n_neg": "n_neg_{}"}, replicates)
    return out.select(*keys, "b", (F.col("u") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0.0))).alias("value"))


def decision_rule(df: DataFrame) -> DataFrame:
    """STA18. Gain proven (interval above 0) and false positives up by at most two points."""
    return df.withColumns({"gain_proven": F.col("recall_lo") > 0, "like_for_like": F.col("fpr_diff") <= 0.02})
