"""Leakage and consistency audits: SET1-SET3, AUD1, AUD3-AUD5, AUD7, AUD8, AGG32."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldaudit.functions.fields import SPLITS, map_key
from fieldaudit.operators.characterise import total
from fieldaudit.operators.reconcile import coverage_problems, field_differences


def split_flags(df: DataFrame, key, split: str = "split") -> DataFrame:
    """Which splits each key occurs in, as 0/1 columns. Partial aggregation, so hot keys cost one row per task."""
    return df.groupBy(*([key] if isinstance(key, (str, Column)) else key)).agg(
        *[F.max((F.col(split) == s).cast("int")).alias(s) for s in SPLITS])


def split_intersections(df: DataFrame, value) -> DataFrame:
    """SET1. Number of values shared by each pair of splits; pairs without any stay as 0."""
    seen = split_flags(df, value)
    pairs = list(combinations(sorted(SPLITS), 2))
    one = seen.agg(*[total((F.col(a) == 1) & (F.col(b) == 1)).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(f"{a}|{b}").alias("pair"), F.coalesce(F.col(f"{a}|{b}"), F.lit(0)).cast("long").alias("shared"))
        for a, b in pairs])).alias("r")).select("r.*")


def spanning(df: DataFrame, key) -> DataFrame:
    """SET2. Keys in all and keys whose members span more than one split."""
    seen = split_flags(df, key)
    here = sum((F.col(s) for s in SPLITS[1:]), F.col(SPLITS[0]))
    return seen.agg(F.count(F.lit(1)).alias("groups"), total(here > 1).alias("spanning"))


def missing_variants(df: DataFrame, variant) -> DataFrame:
    """SET3. Variants that a split lacks although another split has them: (split, variant...)."""
    seen = split_flags(df, variant)
    lacks = F.array_compact(F.array(*[F.when(F.col(s) == 0, F.lit(s)) for s in SPLITS]))
    return seen.select(*variant, F.explode(lacks).alias("split"))


def check_row(df: DataFrame, name: str, violations: str, gating: bool = True) -> DataFrame:
    passed = (F.col(violations) == 0) if gating else F.lit(None).cast("boolean")
    return df.select(F.lit(name).alias("check"), F.col(violations).cast("long").alias("violations"), passed.alias("passed"))


def with_overall(checks: DataFrame, *measures: Column) -> DataFrame:
    """The checks, each a row of its own, and their total under the name ``all``, from one pass over them."""
    out = checks.groupingSets([["check"], []], "check").agg(*measures, F.grouping("check").alias("_total"))
    return out.withColumn("check", F.when(F.col("_total") == 1, "all").otherwise(F.col("check"))).drop("_total")


def leakage_audit(cases: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """AUD1. The five gating checks and the overall verdict; with ``near`` also the row of near-duplicates across splits.

    ``near`` has one row per pair of fingerprints (``n_pairs``: pairs of rows). Fingerprints of one layout saturate, so the row reports
    and does not gate: its ``passed`` is null, and the total leaves its pairs out.
    """
    shared = lambda d, v: split_intersections(d, v).agg(F.sum("shared").alias("v"))
    span = lambda d, k: spanning(d, k).select(F.col("spanning").alias("v"))
    ids = cases.where(F.col("own_id").isNotNull() & (F.col("own_id") != ""))
    printed = F.create_map(F.lit("id"), F.col("print_id"), F.lit("name"), F.col("print_name"), F.lit("dob"), F.col("print_dob"),
                           F.lit("father"), F.coalesce("print_father", F.lit("")),
                           F.lit("devanagari"), F.coalesce("print_devanagari", F.lit("")))
    values = cases.select("split", F.sha2(map_key(printed), 256).alias("printed"))
    lacks = missing_variants(cases, ["doc_type", "template_variant"]).agg(F.count(F.lit(1)).alias("v"))
    checks = reduce(DataFrame.unionByName, [
        check_row(shared(cases, "person_id"), "identity", "v"), check_row(shared(ids, "own_id"), "identifier", "v"),
        check_row(lacks, "template", "v"), check_row(span(cases, "document_id"), "augmentation", "v"),
        check_row(span(values, "printed"), "printed_values", "v")])
    out = with_overall(checks, F.sum("violations").alias("violations"), F.bool_and("passed").alias("passed"))
    if near is None:
        return out
    return out.unionByName(check_row(near.agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("v")), "near_duplicates", "v", gating=False))


def equal_fingerprints(rows: DataFrame, h: str, content: str) -> DataFrame:
    """TOP3. Per fingerprint that several rows share: the rows, their contents, all pairs, and the pairs with the same content.

    Pairs are counted from the sizes of the contents, never made. A row whose content is not there (null) pairs with none.
    """
    sizes = rows.where(F.col(h).isNotNull()).groupBy(F.col(h).alias("h"), F.col(content).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    there = F.col("c").isNotNull()
    out = sizes.groupBy("h").agg(F.sum("n").alias("n_rows"), F.sum(there.cast("long")).alias("contents"),
                                 F.sum(F.when(there, F.expr("n * (n - 1) div 2")).otherwise(0)).alias("same_pairs"),
                                 F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("_m"))
    return out.where("n_rows > 1").select("h", "n_rows", "contents", F.expr("n_rows * (n_rows - 1) div 2").alias("pairs"),
                                          F.expr("_m * (_m - 1) div 2").alias("compared"), "same_pairs")


def split_check(rows: DataFrame, found: DataFrame) -> DataFrame:
    """AUD3. People crossing splits, referenced files not found, identical bytes across splits.

    ``rows`` has person_id, split, file; ``found`` has file and sha.
    """
    absent = rows.select("file").distinct().join(found.select("file"), "file", "left_anti").agg(F.count(F.lit(1)).alias("v"))
    crossing = spanning(rows, "person_id").select(F.col("spanning").alias("v"))
    same = spanning(rows.join(found.select("file", "sha"), "file"), "sha").select(F.col("spanning").alias("v"))
    return reduce(DataFrame.unionByName, [
        check_row(crossing, "people_crossing", "v"), check_row(absent, "missing_files", "v"),
        check_row(same, "same_bytes_across_splits", "v")])


def fresh_check(fresh: DataFrame, known: DataFrame, persons: int, id_columns) -> DataFrame:
    """AUD4. Problems of a fresh corpus: ids shared with the known one, counts off the design, wrong verdicts.

    The design is persons x documents x (two controls, four alterations) x three tiers.
    """
    parts = []
    for c in id_columns:
        shared = fresh.select(c).distinct().join(known.select(c).distinct(), c, "left_semi")
        parts.append(check_row(shared.agg(F.count(F.lit(1)).alias("v")), f"shared {c}", "v"))
    n = fresh.agg(F.abs(F.count(F.lit(1)) - persons * 36).alias("v"))
    parts.append(check_row(n, "image count", "v"))
    parts.append(check_row(fresh.agg(F.abs(F.countDistinct("person_id") - persons).alias("v")), "person count", "v"))
    want = F.when(F.col("forgery_category") == "C0", 2 * persons).otherwise(persons)
    cells = fresh.groupBy("doc_type", "forgery_category", "quality_tier").agg(F.count(F.lit(1)).alias("n"))
    parts.append(check_row(cells.agg((total(F.col("n") != want) + F.abs(F.count(F.lit(1)) - 30)).alias("v")), "cell counts", "v"))
    parts.append(check_row(fresh.agg(total(F.col("rule_gt_verdict") != F.col("expected_rule")).alias("v")), "verdict off design", "v"))
    parts.append(check_row(fresh.agg((F.count(F.lit(1)) - F.countDistinct("image_id")).alias("v")), "repeated image_id", "v"))
    return reduce(DataFrame.unionByName, parts)


def score_rows_digest(scores: DataFrame, key: str = "image_id", score: str = "logit") -> DataFrame:
    """One row with the digest of a score table: its ids, scores (as text) and stated columns. ``tree_digest`` of the rows."""
    rest = [c for c in sorted(scores.columns) if c != key]
    line = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in rest]), 256)
    return tree_digest(scores.select(F.col(key), line.alias("sha")), key, "sha")


def score_run_check(scores: DataFrame, manifest: DataFrame, splits, stored: DataFrame | None = None) -> DataFrame:
    """AUD5, AUD7. A score table against its manifest and its stored digest, as counts per problem.

    Exact ids of the splits, finite logits, agreement on split, document type, category and label where the table states them, and,
    with ``stored`` (one row with ``digest``, of ``score_rows_digest``), the problem ``digest differs`` where the table is not the
    one that was stored, or nothing was stored.
    """
    pred = scores.withColumnRenamed("logit", "score")
    wanted = manifest.where(F.col("split").isin(*splits)).withColumn("stated_split", F.col("split"))
    pred = pred.withColumnRenamed("split", "stated_split") if "split" in pred.columns else pred
    both = lambda d: d.withColumn("split", F.lit("run"))
    shared = ("label", "stated_split", "split", "forgery_category", "doc_type")
    problems = coverage_problems(pred, both(wanted), "run", ("C0", "C1", "C2", "C3", "C4"), shared=shared, threshold=0.0)
    out = problems.groupBy(F.regexp_replace("problem", "^stated_", "").alias("problem")).agg(F.count(F.lit(1)).alias("n"))
    if stored is None:
        return out
    pair = score_rows_digest(scores).select(F.lit(1).alias("side"), "digest").unionByName(stored.select(F.lit(2).alias("side"), "digest"))
    same = pair.agg((F.coalesce(F.min("digest") == F.max("digest"), F.lit(False)) & (F.countDistinct("side") == 2)).alias("same"))
    return out.unionByName(same.where("not same").select(F.lit("digest differs").alias("problem"), F.lit(1).cast("long").alias("n")))


def index_check(a: DataFrame, b: DataFrame, key: str, columns) -> DataFrame:
    """AUD7. Two manifests agree row for row, and labels follow from categories: counts per problem."""
    diff = field_differences(a, b, key, columns).groupBy(F.concat(F.col("field"), F.lit(" differs")).alias("problem")).agg(
        F.count(F.lit(1)).alias("n"))
    bad = a.where(F.col("label") != (F.col("forgery_category") != "C0").cast("int")).agg(F.count(F.lit(1)).alias("n"))
    return diff.unionByName(bad.select(F.lit("label off category").alias("problem"), "n").where("n > 0"))


def self_check(stored: DataFrame, again: DataFrame, key: str, score: str, rows: int = 40, tolerance: float = 0.01) -> DataFrame:
    """AUD8, TOP2. First rows by key, scored again: largest difference within the tolerance."""
    first = stored.orderBy(key).limit(rows).select(key, F.col(score).alias("a"))
    j = first.join(again.select(key, F.col(score).alias("b")), key)
    return j.agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_diff")).withColumn(
        "passed", F.col("max_diff") <= tolerance)


DIGITS = 8  # hexadecimal digits of the id's hash that name a leaf of the digest tree: 2^32 leaves at every table size


def _joined_digest(lines: Column, sep: str) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(lines)), sep), 256)


def _line(key: str, sha: str) -> Column:
    return F.concat(F.col(key).cast("string"), F.lit(":"), F.col(sha), F.lit("\n"))


def tree_digest(rows: DataFrame, key: str, sha: str) -> DataFrame:
    """AGG32. Digest of ``id:sha`` lines: leaves by the first digits of the id's hash, folded two digits at a time.

    The shape is fixed, so the digest depends on the rows alone. An inner node has at most 256 children, and a leaf one row in
    2^32.
    """
    level = rows.select(F.substring(F.md5(F.col(key).cast("string")), 1, DIGITS).alias("node"), _line(key, sha).alias("line"))
    level = level.groupBy("node").agg(_joined_digest(F.col("line"), "").alias("leaf"), F.count(F.lit(1)).alias("n"))
    for d in range(DIGITS - 2, -1, -2):
        level = level.groupBy(F.substring("node", 1, d).alias("node")).agg(
            _joined_digest(F.concat("node", F.lit(":"), "leaf"), "\n").alias("leaf"), F.sum("n").alias("n"))
    return level.select(F.col("leaf").alias("digest"), "n")
