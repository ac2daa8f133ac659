"""Joins that check tables against each other: JOI1-JOI4, JOI6, JOI13-JOI15, JOI17-JOI21, SET4."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldaudit.functions.measures import sigmoid
from fieldaudit.operators.masks import valid_decision, valid_score


def coverage_problems(pred: DataFrame, manifest: DataFrame, split: str, categories, key: str = "image_id",
                      shared=("label", "split", "forgery_category", "doc_type"), threshold: float | None = None) -> DataFrame:
    """JOI1, JOI2, FLT5. Every reason a prediction table is not exactly one valid row per expected image.

    One full outer join on the key; a row may report several problems. An empty result means full coverage.
    """
    columns = pred.columns
    if key not in columns:
        raise ValueError(f"prediction table has no {key} column")
    if "decision" not in columns and "score" not in columns:
        raise ValueError("prediction table needs a decision or a score column")
    if "decision" not in columns and threshold is None:
        raise ValueError("scores without a threshold leave decisions undefined")
    checks = {}
    if "score" in columns:
        checks["score not finite"] = ~valid_score("score")
    if "decision" in columns:
        checks["decision not 0 or 1"] = ~valid_decision("decision")
    # Of a repeated id every row is tested: a fault of any of them is one of the id.
    compared = [c for c in shared if c in columns]
    per_key = pred.groupBy(key).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.bool_or(F.coalesce(test, F.lit(True))).alias(f"_bad_{k}") for k, test in enumerate(checks.values())],
        *[a for c in compared for a in (F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"), F.count(c).alias(f"_n_{c}"))])
    m = manifest.select(F.col(key), F.struct(*shared).alias("m"))
    joined = per_key.join(m, key, "full_outer")

    def agrees(c: str) -> Column:
        """All rows of the id have the manifest's value, null among them only where it is null there."""
        want, all_null = F.col(f"m.{c}"), F.col(f"_n_{c}") == 0
        same = (F.col(f"_lo_{c}") == want) & (F.col(f"_hi_{c}") == want) & (F.col(f"_n_{c}") == F.col("_rows"))
        return F.when(want.isNull(), all_null).otherwise(F.coalesce(same, F.lit(False)))

    here, known = F.col("_rows").isNotNull(), F.col("m").isNotNull()
    in_cats = F.col("m.forgery_category").isin(*categories)
    wanted = known & (F.col("m.split") == split) & in_cats
    tests = [
        F.when(here & ~known, "unknown id"), F.when(F.col("_rows") > 1, "duplicate id"),
        F.when(here & known & (F.col("m.split") != split), "other split"),
        F.when(here & known & ~in_cats, "outside category set"), F.when(wanted & ~here, "missing"),
        *[F.when(here & F.col(f"_bad_{k}"), name) for k, name in enumerate(checks)],
        *[F.when(here & known & ~agrees(c), f"{c} disagrees") for c in compared],
    ]
    return joined.select(key, F.explode(F.array_compact(F.array(*tests))).alias("problem"))


def decisions_of(pred: DataFrame, threshold: float | None = None) -> DataFrame:
    """Decision column of a prediction table: as given, else score >= threshold."""
    if "decision" in pred.columns:
        return pred
    return pred.withColumn("decision", (F.col("score") >= threshold).cast("int"))


def field_differences(a: DataFrame, b: DataFrame, key: str, columns) -> DataFrame:
    """JOI2, JOI3. Cells that differ between two tables of the same rows, as (key, field, left, right).

    A row missing on one side reports the field ``row``.
    """
    left = a.select(F.col(key), F.struct(*columns).alias("a"))
    right = b.select(F.col(key), F.struct(*columns).alias("b"))
    j = left.join(right, key, "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    cell = lambda c: F.struct(F.lit(c).alias("field"), F.col(f"a.{c}").cast("string").alias("left"),
                              F.col(f"b.{c}").cast("string").alias("right"))
    present = F.struct(F.lit("row").alias("field"), F.when(F.col("a").isNotNull(), "present").alias("left"),
                       F.when(F.col("b").isNotNull(), "present").alias("right"))
    diffs = [F.when(both & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), cell(c)) for c in columns]
    return j.select(key, F.explode(F.array_compact(F.array(F.when(~both, present), *diffs))).alias("d")).select(key, "d.*")


def seed_ensemble(scores: DataFrame, temperatures: DataFrame, n_seeds: int, key: str = "image_id") -> DataFrame:
    """JOI4, JOI18, AGG27. Mean over seeds of temperature-scaled probabilities.

    ``temperatures`` has one row per seed and is broadcast. A row without all seeds, or with one of them twice, is an error.
    """
    p = scores.join(F.broadcast(temperatures), "seed").withColumn("p", sigmoid(F.col("logit"), F.col("temperature")))
    out = p.groupBy(key).agg(F.avg("p").alias("prob"), F.countDistinct("seed").alias("_n"), F.count("*").alias("_rows"))
    short = F.raise_error(F.lit("a row lacks some seeds or repeats one")).cast("double")
    whole = (F.col("_n") == n_seeds) & (F.col("_rows") == n_seeds)
    return out.select(key, F.when(whole, F.col("prob")).otherwise(short).alias("prob"))


def aligned(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """JOI6. Inner join of several tables on one key; ``key_gaps`` reports what it would lose."""
    return reduce(lambda a, b: a.join(b, key), tables.values())


def key_gaps(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """JOI6, SET4. Keys that some table lacks, as (key, missing_from). One aggregate over all tables."""
    tagged = reduce(DataFrame.unionByName, [t.select(key, F.lit(n).alias("_t")) for n, t in tables.items()])
    seen = tagged.groupBy(key).agg(*[F.max((F.col("_t") == n).cast("int")).alias(f"_{n}") for n in tables])
    lacks = F.array_compact(F.array(*[F.when(F.col(f"_{n}") == 0, F.lit(n)) for n in tables]))
    return seen.select(key, F.explode(lacks).alias("missing_from"))


def shared_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """JOI13. Values of one corpus found in another."""
    return a.select(column).distinct().join(b.select(column).distinct(), column, "left_semi")


def file_status(listed: DataFrame, found: DataFrame, key: str = "file", size: str = "bytes") -> DataFrame:
    """JOI14. Listed files against found ones: ok, missing, wrong size, extra."""
    j = listed.select(key, F.col(size).alias("want")).join(found.select(key, F.col(size).alias("got")), key, "full_outer")
    status = (F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "extra")
              .when(F.col("want") != F.col("got"), "wrong size").otherwise("ok"))
    return j.withColumn("status", status)


def digest_status(frozen: DataFrame, rebuilt: DataFrame, key: str = "file") -> DataFrame:
    """JOI15. Rebuilt files against a frozen hash list: counts of identical, different, missing."""
    j = frozen.select(key, F.col("sha").alias("want")).join(rebuilt.select(key, F.col("sha").alias("got")), key, "left")
    status = F.when(F.col("got").isNull(), "missing").when(F.col("want") == F.col("got"), "identical").otherwise("different")
    return j.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def align_epochs(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """JOI17. Epoch logs of two runs side by side; the longer run keeps its tail."""
    return a.select("epoch", F.col(metric).alias("first")).join(
        b.select("epoch", F.col(metric).alias("second")), "epoch", "full_outer")


def term_grid(spark, groups: dict[str, list[str]]) -> DataFrame:
    """JOI19. All combinations of fixed term lists, one row each, with the joined text."""
    df = spark.range(1).select(F.lit(0).alias("_one"))
    for name, terms in groups.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(t) for t in terms])))
    return df.drop("_one").withColumn("query", F.concat_ws(" ", *groups))


def map_differences(a: Column, b: Column) -> Column:
    """Keys whose values differ between two maps, as a sorted array."""
    keys = F.array_sort(F.array_distinct(F.concat(F.map_keys(a), F.map_keys(b))))
    return F.filter(keys, lambda k: ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k)))


def field_changes(control: DataFrame, modified: DataFrame, keys) -> DataFrame:
    """JOI21. Modified rows against their control: the fields that changed, and whether only the named one did."""
    c = control.select(*keys, F.col("printed_values").alias("before"))
    j = modified.join(c, list(keys))
    changed = F.array_join(map_differences(F.col("before"), F.col("printed_values")), "|")
    return j.withColumn("changed", changed).withColumn(
        "only_named", F.col("changed") == F.coalesce("forgery_field", F.lit("")))
