"""Mixing sources to target weights by Pareto order sampling (operator 7).

Every source gets a target number of words: a share of a total by weight, at most ``most`` times its own size, with
the excess shared again by weight. Inside a source a document's expected number of copies is proportional to the square
root of its size, at most ``most``, and scaled so that the expected words equal the target. Its whole part is taken for
certain. The rest is an inclusion probability p below one: documents are ranked by random odds u/(1-u) divided by p/(1-p),
and the first ones are taken until their words reach what the target still lacks (to the nearest document).

The ranking is never a sort of a source. The rank lies in (0, 1) and is cut into 4096 ranges, of which only the one
holding the border is cut into 4096 again; only what lies in that second range (one row in 2^24) is put in order.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; a document of size 0 is taken 0
times; identical rows share their draw and so their fate; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldaudit.llm.common import WORD, keep, uniform

FINE = 4096
SALT = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill_level(order: list[Column], cap: Column, weight: Column, total: Column, *groups: str) -> Column:
    """The level L at which the sum of min(cap, L * weight) is ``total``; rows come in rising order of cap / weight.

    With the first k rows at their caps, the others need (total - their caps) / (the other weights). That quotient
    rises as long as the next row is over its cap too and falls from then on, so the level is its maximum.
    """
    upto = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy(*groups).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    need = (total - F.coalesce(F.sum(cap).over(upto), F.lit(0.0))) / F.nullif(F.sum(weight).over(rest), F.lit(0.0))
    return need


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows of (source, size): one row per source, whatever the number of rows."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    place = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1)))
    cap = F.col("source_size") * F.lit(float(most))
    total = F.least(F.lit(float(share)), F.lit(float(most))) * F.sum("source_size").over(everything)
    order = [(cap / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    sources = sources.withColumn("need", fill_level(order, cap, F.col("weight"), total))
    level = F.max("need").over(everything)
    return sources.select("source", "source_size", F.coalesce(F.least(cap, level * F.col("weight")), F.lit(0.0)).alias("target"))


def expected_copies(size: Column, scale: Column, full: Column, most: float) -> Column:
    return F.when(full, F.lit(float(most))).otherwise(F.least(F.lit(float(most)), scale * F.sqrt(size)))


def copy_scales(sizes: DataFrame, targets: DataFrame, most: float = 2.0) -> DataFrame:
    """Adds to each source the factor of the expected copies, and the words that whole copies leave to be drawn.

    Works on (source, size) cells: the cells of a source are as many as its distinct sizes, not its documents.
    """
    cells = sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    cells = cells.withColumnRenamed("source", "cell_source")
    cells = targets.join(cells, F.col("source").eqNullSafe(F.col("cell_source")), "left").drop("cell_source")
    words = F.col("n") * F.col("size")
    need = fill_level([F.col("size").desc()], words * F.lit(float(most)), words * F.sqrt("size"), F.col("target"), "source")
    cells = cells.withColumn("need", need)
    cells = cells.withColumn("scale", F.coalesce(F.max("need").over(Window.partitionBy("source")), F.lit(0.0)))
    full = F.col("target") >= F.lit(float(most)) * F.col("source_size")
    whole = F.sum(words * F.floor(expected_copies(F.col("size"), F.col("scale"), full, most)))
    out = cells.groupBy("source", "source_size", "target", "scale").agg(F.coalesce(whole, F.lit(0)).alias("whole"))
    return out.withColumns({"full": full, "left_over": F.col("target") - F.col("whole")})


def ranked(docs: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """Rows of (row, key, source, size) with their whole copies and rank; the plan has one row per source."""
    plan = plan.withColumnRenamed("source", "plan_source")
    df = docs.join(plan, F.col("source").eqNullSafe(F.col("plan_source")), "inner").drop("plan_source")
    df = df.withColumn("expected", expected_copies(F.col("size"), F.col("scale"), F.col("full"), most))
    df = df.withColumn("whole", F.floor("expected").cast("long"))
    p, u = F.col("expected") - F.col("whole"), uniform(F.col("key"), SALT)
    return df.withColumn("rank", F.when(p > 0, u * (1 - p) / (u * (1 - p) + (1 - u) * p)))


def border(cells: DataFrame, place: str) -> DataFrame:
    """Per source the first cell at which the running words pass ``left_over``, and the words before it."""
    run = Window.partitionBy("source").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("upto", F.col("before") + F.sum("words").over(run))
    first = F.min(F.when(F.col("upto") > F.col("left_over"), F.struct(place, (F.col("upto") - F.col("words")).alias("before"))))
    return cells.groupBy("source").agg(first.alias("at"))


def mixing_plan(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5,
                most: float = 2.0) -> DataFrame:
    """One row per source with its target and the rank at which its draw ends, from rows of (key, source, size)."""
    plan = keep(copy_scales(sizes, source_targets(sizes, weights, share, most), most), "mix-scales")
    rows = ranked(sizes, plan, most).where("rank is not null").select("key", "source", "size", "rank", "left_over")
    coarse, fine = F.floor(F.col("rank") * FINE), F.floor(F.col("rank") * (FINE * FINE))
    cells = rows.groupBy("source", "left_over", coarse.alias("cell")).agg(F.sum("size").alias("words"))
    first = keep(border(cells.withColumn("before", F.lit(0).cast("long")), "cell").where("at is not null"), "mix-first")

    def inside(at: DataFrame, place: Column) -> DataFrame:
        at = at.select(F.col("source").alias("at_source"), F.col("at.cell").alias("at_cell"), F.col("at.before").alias("before"))
        return rows.join(at, F.col("source").eqNullSafe(F.col("at_source")) & (place == F.col("at_cell"))).drop("at_source", "at_cell")

    cells = inside(first, coarse).groupBy("source", "left_over", "before", fine.alias("cell")).agg(F.sum("size").alias("words"))
    second = keep(border(cells, "cell").where("at is not null"), "mix-second")
    run = Window.partitionBy("source").orderBy("rank", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = inside(second, fine).withColumn("upto", F.col("before") + F.sum("size").over(run))
    last = last.where(F.col("upto") - F.col("size") / 2 <= F.col("left_over"))
    last = last.groupBy("source").agg(F.max(F.struct("rank", "key", "size")).alias("cut"))
    ends = second.select(F.col("source").alias("end_source"), F.col("at.cell").alias("end_cell"))
    cuts = last.select(F.col("source").alias("cut_source"), "cut")
    plan = plan.join(ends, F.col("source").eqNullSafe(F.col("end_source")), "left").drop("end_source")
    return keep(plan.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source", "whole"), "mix-plan")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
        weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per document: ``row`` (all its columns), size, source_size, target, copies, taken.

    No step shuffles texts: the sizes are counted once into a narrow table, and the documents then meet the plan, which
    has one row per source.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    plan = mixing_plan(keep(narrow, "mix-sizes"), weights, share, most)
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(source).alias("source"),
                       word_count(F.col(text)).alias("size"))
    df = ranked(rows, plan, most)
    cell = F.floor(F.col("rank") * (FINE * FINE))
    inside = F.coalesce(F.struct("rank", "key", "size") <= F.col("cut"), F.lit(False))
    drawn = F.col("rank").isNotNull() & (F.col("end_cell").isNull() | (cell < F.col("end_cell")) | ((cell == F.col("end_cell")) & inside))
    copies = F.col("whole") + F.coalesce(drawn, F.lit(False)).cast("long")
    copies = F.when(F.col("size") > 0, copies).otherwise(F.lit(0).cast("long"))
    return df.withColumn("copies", copies).select(
        "row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each as often as it was taken."""
    taken = mix(docs, **options).where("copies > 0")
    copies = F.transform(F.sequence(F.lit(1).cast("long"), F.col("copies")), lambda _: F.col("row"))
    return taken.select(F.explode(copies).alias("row")).select("row.*")
