"""Fingerprint distances: JOI9-JOI12, AGG29-AGG31, TOP3, TOP4, AUD2.

All joins run on distinct fingerprints with multiplicities, so a third of all rows sharing one fingerprint
is one row here. Distances are kept as histograms (at most 65 values), never as lists of pairs.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldaudit.functions.bits import hamming, median
from fieldaudit.functions.draws import SEED, draw
from fieldaudit.functions.fields import SPLITS
from fieldaudit.operators.ranking import round_bits, separability
from fieldaudit.sources.store import cut

ARRAY_LIMIT = 200_000  # distinct reference fingerprints (8 bytes and an id each) that every task may hold
SALT_ROWS = 2000  # rows of one band value that one task compares with the whole band


CHARACTERS = 1 << 20  # characters of texts that a task counts at a time; a longer text is counted alone


def character_counts(df: DataFrame, id_col: str, text: str, features: str, stretches: int = 1) -> DataFrame:
    """(id, v): how often each character occurs in each of ``stretches`` equal stretches of a text (the last may be shorter).

    The scan counts all characters in one pass, so only the counts are exchanged afterwards. A row without a text has nulls.
    """
    n, width = len(features), len(features) * stretches
    place = np.full(0x110000 + 1, n, "int32")  # the place of every code point; those that are not counted share the last
    place[[ord(c) for c in features]] = np.arange(n)
    small = place[:0x3000] if max(map(ord, features)) < 0x3000 else place
    schema = T.StructType([df.schema[id_col], T.StructField("v", T.ArrayType(T.IntegerType()))])

    def groups(sizes):
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > CHARACTERS:
                yield start, i
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield start, len(sizes)

    def count(batches):
        for batch in batches:
            there = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            texts = [(b or b"").decode("utf-8", "replace") for b in batch.column(1).cast(pa.binary()).to_pylist()]
            sizes = np.array([len(t) for t in texts], "int64")
            for low, high in groups(sizes.tolist()):
                rows, size = high - low, sizes[low:high]
                points = np.frombuffer("".join(texts[low:high]).encode("utf-32-le"), "<u4")
                kind = small[np.minimum(points, len(small) - 1)]
                cell = np.repeat(np.arange(rows) * stretches, size)
                if stretches > 1:
                    each = np.maximum(-(-size // stretches), 1)
                    cell += (np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)) // np.repeat(each, size)
                held = np.bincount(cell * (n + 1) + kind, minlength=rows * stretches * (n + 1)).reshape(rows, stretches, n + 1)[:, :, :n]
                values = pa.array(held.reshape(-1).astype("int32"), mask=np.repeat(~there[low:high], width))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype="int32") * width), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, rows), lists], names=[id_col, "v"])

    return df.select(id_col, text).mapInArrow(count, schema)


def signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def band_masks(radius: int, blocks: int) -> list[int]:
    """Bit masks of every choice of blocks that two fingerprints within ``radius`` must share at least once.

    ``radius`` flipped bits spoil at most ``radius`` of the blocks, so some choice of ``blocks - radius``
    blocks is equal. More blocks give more and rarer keys.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    return [signed(sum(block[i] for i in pick)) for pick in combinations(range(blocks), blocks - radius)]


def distinct_hashes(df: DataFrame, h: str, id_col: str, split: str = "split") -> DataFrame:
    """One row per fingerprint: first id, rows per split, rows in all."""
    per_split = [F.sum(F.when(F.col(split) == s, 1).otherwise(0)).cast("long").alias(f"n_{s}") for s in SPLITS]
    return df.groupBy(F.col(h).alias("h")).agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("n"), *per_split)


def blocks_for(n: int, radius: int) -> int:
    """Fewest blocks whose band keys are wide enough that n spread-out fingerprints share few of them."""
    blocks = radius + 1
    while blocks < radius + 5 and 64 * (blocks - radius) // blocks < math.log2(max(n, 2)) - 3:
        blocks += 1
    return blocks


def radius_pairs(df: DataFrame, h: str, id_col: str, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """JOI9. Pairs of fingerprints within a radius that occur across splits, with the number of row pairs.

    Equi-join on bands instead of a comparison of everything; the number of bands follows from the number of
    fingerprints unless given. A pair that shares several bands is kept only
    for the first, so no distinct is needed. Bands of one member drop out before the join; large bands
    are split over tasks by salt. Equal fingerprints are counted without a join.
    """
    members = distinct_hashes(df, h, id_col)
    masks = band_masks(radius, blocks or blocks_for(members.count(), radius))
    bands = members.select("*", F.posexplode(F.array(*[F.col("h").bitwiseAND(F.lit(m)) for m in masks])).alias("k", "v"))
    sizes = bands.groupBy("k", "v").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    keyed = bands.join(sizes, ["k", "v"]).withColumn("salts", F.ceil(F.col("size") / SALT_ROWS).cast("int"))
    cols = ["h", "id", "n", *[f"n_{s}" for s in SPLITS]]
    left = keyed.select("k", "v", F.pmod(F.xxhash64("h"), F.col("salts")).cast("int").alias("salt"),
                        F.struct(*cols).alias("a"))
    right = keyed.select("k", "v", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                         F.struct(*cols).alias("b"))
    x = F.col("a.h").bitwiseXOR(F.col("b.h"))
    first = F.coalesce(*[F.when(x.bitwiseAND(F.lit(m)) == 0, i) for i, m in enumerate(masks)])
    near = left.join(right, ["k", "v", "salt"]).where(
        (F.col("a.h") < F.col("b.h")) & (F.bit_count(x) <= radius) & (first == F.col("k")))
    within = sum((F.col(f"a.n_{s}") * F.col(f"b.n_{s}") for s in SPLITS[1:]), F.col("a.n_train") * F.col("b.n_train"))
    apart = near.select(
        F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"),
        F.bit_count(x).alias("distance"), (F.col("a.n") * F.col("b.n") - within).alias("n_pairs"))
    squares = sum((F.col(f"n_{s}") * F.col(f"n_{s}") for s in SPLITS[1:]), F.col("n_train") * F.col("n_train"))
    same = members.where(F.col("n") > 1).select(
        F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit(0).alias("distance"),
        F.expr("n * n").alias("_t"), squares.alias("_s")).select(
        "id_a", "id_b", "distance", ((F.col("_t") - F.col("_s")) / 2).cast("long").alias("n_pairs"))
    return apart.unionByName(same).where(F.col("n_pairs") > 0)


def closest_pairs(pairs: DataFrame, limit: int = 20) -> DataFrame:
    """SNK7's order, TOP3's cut: the closest pairs, ties by id."""
    return pairs.orderBy("distance", "id_a", "id_b").limit(limit)


def disjoint_closest(pairs: DataFrame, limit: int = 12) -> DataFrame:
    """TOP4. The pairs that a pass in order of (distance, id_a, id_b) takes when it skips every pair with an end that was taken.

    In rounds: a pair that is the least one at both its ends is taken by that pass for certain, so all of these are taken at once, and
    the pairs that touch them go. What remains can only add pairs from its least one on; once ``limit`` taken pairs lie before it,
    the answer is complete.
    """
    order = F.struct("distance", "id_a", "id_b")
    todo = cut(pairs.select(*pairs.columns))
    taken = None
    while True:
        ends = todo.select(order.alias("p"), F.explode(F.array(F.col("id_a"), F.col("id_b"))).alias("e"))
        best = ends.groupBy("e").agg(F.min("p").alias("p"))
        mutual = best.groupBy("p").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") == 2).select("p.*")
        taken = cut(mutual if taken is None else taken.unionByName(mutual))
        used = taken.select(F.explode(F.array("id_a", "id_b")).alias("e"))
        todo = cut(todo.join(used, F.col("id_a") == F.col("e"), "left_anti").join(used, F.col("id_b") == F.col("e"), "left_anti"))
        least = todo.agg(F.min(order).alias("p")).first().p
        if least is None or taken.where(order < F.struct(*[F.lit(least[c]).alias(c) for c in ("distance", "id_a", "id_b")])).limit(limit).count() == limit:
            return taken.orderBy("distance", "id_a", "id_b").limit(limit)


def nearest(queries: DataFrame, refs: DataFrame, h: str, id_col: str, array_limit: int = ARRAY_LIMIT,
            blocks: int = 4) -> DataFrame:
    """JOI10. Distance and first id of the nearest reference fingerprint for every distinct query fingerprint.

    A reference set of at most ``array_limit`` fingerprints is held by every task as one array. A larger
    one is searched through bands in rounds: round s finds every neighbour that differs by at most s bits in some
    block, which is certain up to distance blocks * (s + 1) - 1; only queries without such a neighbour go on.
    """
    q = queries.select(F.col(h).alias("h")).distinct()
    r = refs.groupBy(F.col(h).alias("rh")).agg(F.min(id_col).alias("rid"))
    if r.limit(array_limit + 1).count() <= array_limit:
        # One broadcast row, its size checked just above.
        table = r.agg(F.collect_list(F.struct("rh", "rid")).alias("t")).withColumn("one", F.lit(1))
        best = F.array_min(F.transform("t", lambda x: F.struct(
            F.bit_count(F.col("h").bitwiseXOR(x["rh"])).alias("distance"), x["rid"].alias("nearest"))))
        joined = q.withColumn("one", F.lit(1)).join(F.broadcast(table), "one")
        return joined.select("h", best.alias("_b")).select("h", "_b.distance", "_b.nearest")
    width = 64 // blocks
    part = lambda c, i: F.shiftrightunsigned(c, width * i).bitwiseAND(F.lit((1 << width) - 1))
    index = r.select("rh", "rid", F.posexplode(F.array(*[part(F.col("rh"), i) for i in range(blocks)])).alias("k", "v"))
    found, todo, s = None, cut(q), 0
    while s <= width and not todo.isEmpty():
        flips = [0] + [sum(1 << i for i in c) for n in range(1, s + 1) for c in combinations(range(width), n)]
        masks = F.expr("array(" + ",".join(f"{m}L" for m in flips) + ")")
        probes = todo.select("h", F.posexplode(F.array(*[part(F.col("h"), i) for i in range(blocks)])).alias("k", "v0"))
        probes = probes.select("h", "k", F.explode(F.transform(masks, lambda m: F.col("v0").bitwiseXOR(m))).alias("v"))
        hits = probes.join(index, ["k", "v"]).groupBy("h").agg(
            F.min(F.struct(hamming(F.col("h"), F.col("rh")).alias("distance"), F.col("rid").alias("nearest"))).alias("_b"))
        sure = cut(hits.select("h", "_b.distance", "_b.nearest").where(F.col("distance") <= blocks * (s + 1) - 1))
        found = sure if found is None else found.unionByName(sure)
        todo = cut(todo.join(sure.select("h"), "h", "left_anti"))
        s += 1
    return found if found is not None else q.select("h", F.lit(None).cast("int").alias("distance"), F.lit(None).alias("nearest"))


def split_nearest(df: DataFrame, h: str, id_col: str, split: str = "split") -> DataFrame:
    """AUD2's last part: every validation and test row with its nearest train fingerprint."""
    out = df.where(F.col(split) != "train")
    best = nearest(out, df.where(F.col(split) == "train"), h, id_col)
    return out.join(best.withColumnRenamed("h", h), h)


def within_group_distances(df: DataFrame, group: str, h: str) -> DataFrame:
    """JOI11. Histogram (distance, n) over all pairs inside a group; groups are captures of one document.

    Copies inside a group are one weighted row, so only distinct fingerprints meet each other.
    """
    members = df.groupBy(F.col(group).alias("g"), F.col(h).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    b = members.select("g", F.col("h").alias("h2"), F.col("n").alias("n2"))
    apart = members.join(b, "g").where(F.col("h") < F.col("h2")).select(
        hamming(F.col("h"), F.col("h2")).alias("distance"), (F.col("n") * F.col("n2")).alias("n"))
    same = members.where(F.col("n") > 1).select(F.lit(0).alias("distance"), F.expr("n * (n - 1) div 2").alias("n"))
    return apart.unionByName(same).groupBy("distance").agg(F.sum("n").alias("n"))


def paired_by_draw(members: DataFrame, keys, u: str, cols) -> DataFrame:
    """One pair per group: the members with the least and the greatest draw, which are two distinct ones at random.

    An aggregate of two rows per group, so large groups are reduced before they are shuffled. Groups of one member give no pair.
    """
    row = F.struct(u, *cols)
    ends = members.groupBy(*keys).agg(F.min(row).alias("a"), F.max(row).alias("b"), F.count(F.lit(1)).alias("_n"))
    return ends.where(F.col("_n") > 1).select(*keys, "a", "b")


def same_person_sample(df: DataFrame, id_col: str, h: str, tries: int = 4, seed: int = SEED) -> DataFrame:
    """JOI12. Histogram of distances between two random members of a person, ``tries`` times, other documents only."""
    t = df.select("person_id", "document_id", F.col(id_col), F.col(h).alias("h"), F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("t"))
    t = t.withColumn("u", draw(F.col(id_col), F.col("t"), "member", seed=seed))
    pairs = paired_by_draw(t, ["person_id", "t"], "u", [id_col, "document_id", "h"]).where(F.col("a.document_id") != F.col("b.document_id"))
    return pairs.groupBy(hamming(F.col("a.h"), F.col("b.h")).alias("distance")).agg(F.count(F.lit(1)).alias("n"))


def cross_person_sample(df: DataFrame, id_col: str, h: str, repeats: int = 16, share: float = 1.0, seed: int = SEED) -> DataFrame:
    """JOI12. Histogram of distances between random rows of different persons in the same split.

    The scan chooses a ``share`` of the rows by a hash of their id. In each of ``repeats`` rounds a second hash deals a split's
    chosen rows to half as many cells as there are rows, and a cell with two rows or more gives one pair. So some 0.3 pairs a
    round come of every chosen row: the sample grows with the table, and no row needs a position.
    """
    chosen = df.where(F.col("split").isin(*SPLITS)).select("split", "person_id", F.col(id_col), F.col(h).alias("h"))
    if share < 1:
        chosen = chosen.where(draw(F.col(id_col), "share", seed=seed) < int(share * 2**60))
    cells = chosen.groupBy("split").agg(F.greatest(F.expr("count(*) div 2"), F.lit(1).cast("long")).alias("cells"))
    t = chosen.join(F.broadcast(cells), "split").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    t = t.withColumns({"cell": F.pmod(draw(F.col(id_col), F.col("t"), "cell", seed=seed), F.col("cells")),
                       "u": draw(F.col(id_col), F.col("t"), "cross", seed=seed)})
    pairs = paired_by_draw(t, ["split", "t", "cell"], "u", [id_col, "person_id", "h"]).where(F.col("a.person_id") != F.col("b.person_id"))
    return pairs.groupBy(hamming(F.col("a.h"), F.col("b.h")).alias("distance")).agg(F.count(F.lit(1)).alias("n"))


def distance_summary(histogram: DataFrame, keys=()) -> DataFrame:
    """AGG29. n, min, p1, median, mean, max from a distance histogram (linear percentiles)."""
    d = F.col("distance").cast("double")
    pct = F.percentile("distance", F.array(F.lit(0.01), F.lit(0.5)), F.col("n"))
    out = histogram.groupBy(*keys).agg(
        F.sum("n").alias("pairs"), F.min("distance").alias("min"), pct.alias("_q"),
        (F.sum(d * F.col("n")) / F.sum("n")).alias("mean"), F.max("distance").alias("max"))
    return out.select(*keys, "pairs", "min", F.col("_q")[0].alias("p1"), F.col("_q")[1].alias("median"), "mean", "max")


def near_duplicate_summary(df: DataFrame, id_col: str, h: str) -> DataFrame:
    """AUD2. The three distance samples and the nearest-train distances, one summary row each."""
    hist = lambda d, name: d.select(F.lit(name).alias("sample"), "distance", F.col("n").cast("long").alias("n"))
    near = split_nearest(df, h, id_col).groupBy("split", "distance").agg(F.count(F.lit(1)).alias("n"))
    nearest_hist = near.select(F.concat(F.lit("nearest_train/"), F.col("split")).alias("sample"), "distance", "n")
    parts = hist(within_group_distances(df, "document_id", h), "within_document").unionByName(
        hist(same_person_sample(df, id_col, h), "same_person")).unionByName(
        hist(cross_person_sample(df, id_col, h), "cross_person")).unionByName(nearest_hist)
    return distance_summary(parts, ["sample"])


def near_duplicate_overlap(df: DataFrame, id_col: str, h: str) -> DataFrame:
    """AUD2, AGG30, WIN11. Separability, overlap share below the within-document median, distinct fingerprints."""
    within = within_group_distances(df, "document_id", h)
    cross = cross_person_sample(df, id_col, h)
    median = within.agg(F.percentile("distance", F.lit(0.5), F.col("n"))).scalar()
    tag = lambda d: d.withColumn("curve", F.lit("all"))
    auc = separability(tag(within), tag(cross), "distance", ["curve"]).agg(F.max("auroc"))
    share = cross.agg((F.sum(F.when(F.col("distance") <= median, F.col("n")).otherwise(0)) / F.sum("n")).alias("overlap"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(h).alias("distinct_hashes")).select(
        "rows", "distinct_hashes", auc.scalar().alias("separability"), share.scalar().alias("overlap"))


def median_ratio(df: DataFrame, value: str, keys) -> DataFrame:
    """AGG31. Median per group with NaN left out, per (first key, second key) and per first key.

    Two coarser copies of the value (9 and 31 significant bits) nest around it. Their counts say which cell holds the middle, and only
    rows of that cell are counted by the next finer copy: values are exchanged for two narrow cells of a group, never for all of it.
    The cells found have two rows a group and are broadcast.
    """
    keys, every, null = list(keys), "\x00every", "\x00null"
    kept = df.where(~F.isnan(value) & F.col(value).isNotNull())
    name = lambda k, i: (F.coalesce(F.col(keys[k]).cast("string"), F.lit(null)) if k < i else F.lit(every)).alias(f"_k{k}")
    sets = F.explode(F.array(*[F.struct(*[name(k, i) for k in range(len(keys))]) for i in range(1, len(keys) + 1)])).alias("_s")
    group, levels = [f"_k{k}" for k in range(len(keys))], ["_t", "_m", "_x"]
    # Never null after the filter; said so, every pass reads the same exchange, without filters of its own.
    x, huge = F.coalesce(F.col(value).cast("double"), F.lit(0.0)), 1e290  # rounding would overflow beyond
    coarse = lambda drop: F.when(x >= huge, float("inf")).when(x <= -huge, float("-inf")).otherwise(round_bits(x, drop))
    rows = kept.select(coarse(44).alias("_t"), coarse(22).alias("_m"), x.alias("_x"), sets).select(*levels, "_s.*")
    size, wanted = F.sum("_n").over(Window.partitionBy(*group)), None
    for depth, cell in enumerate(levels):
        part, carried = [*group, *levels[:depth]], ["n", "_which", "_place"] if depth else []
        some = rows.join(F.broadcast(wanted), part) if depth else rows
        before = Window.partitionBy(*part, *carried[1:2]).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        run = some.groupBy(*part, *carried, cell).agg(F.count(F.lit(1)).alias("_n")).withColumn("_below", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        if not depth:
            run = run.withColumn("n", size).select("*", F.posexplode(F.expr("array((n - 1) div 2, n div 2)")).alias("_which", "_place"))
        wanted = run.where((F.col("_below") <= F.col("_place")) & (F.col("_place") < F.col("_below") + F.col("_n"))).select(
            *part, cell, "n", "_which", (F.col("_place") - F.col("_below")).alias("_place"))
    out = wanted.groupBy(*group).agg(F.max("n").alias("n"), (F.sum("_x") / 2).alias("median"))
    kinds = dict(df.dtypes)
    return out.select(*[F.when(~F.col(g).isin(every, null), F.col(g)).cast(kinds[k]).alias(k) for g, k in zip(group, keys)],
                      *[(F.col(g) == every).alias(f"all_{k}") for g, k in zip(group[1:], keys[1:])], "n", "median")


def with_extremes(df: DataFrame, values: str, out: str, k: int = 6) -> DataFrame:
    """WIN16. Largest and smallest ``k`` of an array over its median, with mean, sd and max over median.

    The sorted array and its moments are columns of their own, so each is computed once per row.
    """
    df = df.withColumn("_v", F.transform(F.sort_array(values), lambda v: v.cast("double")))
    n = F.size("_v")
    df = df.withColumns({
        "_mid": median(F.col("_v")) + 1e-6,
        "_mean": F.aggregate("_v", F.lit(0.0), lambda a, v: a + v) / n,
    })
    square = F.aggregate("_v", F.lit(0.0), lambda a, v: a + (v - F.col("_mean")) * (v - F.col("_mean"))) / n
    over = lambda a: F.transform(a, lambda v: v / F.col("_mid"))
    features = F.concat(over(F.slice("_v", n - k + 1, k)), over(F.slice("_v", 1, k)),
                        F.array(F.col("_mean"), F.sqrt(square), F.element_at("_v", -1) / F.col("_mid")))
    return df.withColumn(out, features).drop("_v", "_mid", "_mean")
