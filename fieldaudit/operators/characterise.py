"""Characterisation of a case table: AGG1-AGG14, AGG34, AGG35, TOP1, TOP2, SRT1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldaudit.functions.fields import FAIL, SKIPPED, char_error_rate, exact_match
from fieldaudit.functions.measures import coincidence, wilson
from fieldaudit.operators.masks import explode_masks, genuine_strata


def total(predicate: Column) -> Column:
    """Number of rows meeting a predicate, as a partial-aggregating sum."""
    return F.sum(F.when(predicate, 1).otherwise(0)).cast("long")


def with_wilson(df: DataFrame, k: str, n: str, digits: int = 6) -> DataFrame:
    ci = wilson(F.col(k), F.col(n))
    return df.withColumn("_w", ci).withColumns({
        "rate": F.round("_w.rate", digits), "lo": F.round("_w.lo", digits), "hi": F.round("_w.hi", digits),
    }).drop("_w")


def unpivot_counts(df: DataFrame, keys, name: str, columns: dict[str, list[str]], out: list[str]) -> DataFrame:
    """Turns column groups of an aggregated frame into rows: {label: [columns]} -> (keys, name, out...)."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(label).alias(name), *[F.col(c).alias(o) for c, o in zip(cols, out)])
        for label, cols in columns.items()
    ]))
    return df.select(*keys, rows.alias("_r")).select(*keys, "_r.*")


def total_name(df: DataFrame, column: str, name: str) -> DataFrame:
    """Names the total row of a grouping-sets result; a null of the data stays null."""
    return df.withColumn(column, F.when(F.col("_total") == 1, name).otherwise(F.col(column))).drop("_total")


def composition(cases: DataFrame) -> DataFrame:
    """AGG1. Counts per (doc, category, tier) with the (doc, category) totals, in one pass."""
    out = cases.groupingSets(
        [["doc_type", "forgery_category", "quality_tier"], ["doc_type", "forgery_category"]],
        "doc_type", "forgery_category", "quality_tier",
    ).agg(F.count(F.lit(1)).alias("n"), F.grouping("quality_tier").alias("_total"))
    return total_name(out, "quality_tier", "ALL")


def totals(cases: DataFrame) -> DataFrame:
    """AGG2."""
    return cases.agg(
        F.countDistinct("person_id").alias("persons"), F.countDistinct("document_id").alias("documents"),
        F.count(F.lit(1)).alias("images"), total(F.col("label") == 0).alias("genuine"),
        total(F.col("label") == 1).alias("forged"))


def split_sizes(cases: DataFrame) -> DataFrame:
    """AGG3."""
    return cases.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("person_id").alias("persons"))


def person_attributes(people: DataFrame, attributes) -> DataFrame:
    """AGG4. Value counts of several attributes as (attribute, value, n, share), one scan."""
    n_sets = [[a] for a in attributes]
    counts = people.groupingSets(n_sets, *attributes).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id(*attributes).alias("_g"))
    width = len(attributes)
    name = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for i, a in enumerate(attributes):
        here = F.col("_g") == (2**width - 1) - 2 ** (width - 1 - i)
        name = F.when(here, a).otherwise(name)
        value = F.when(here, F.col(a).cast("string")).otherwise(value)
    return counts.select(name.alias("attribute"), value.alias("value"), "n")


def honorific_rate(people: DataFrame) -> DataFrame:
    """AGG4. Share of persons with an honorific, four decimals."""
    return people.agg(F.round(F.avg((F.col("honorific") != "").cast("double")), 4).alias("honorific_rate"))


def storage(files: DataFrame, group: str) -> DataFrame:
    """AGG5. Bytes in total and on average, and mean pixels, per group."""
    return files.groupBy(group).agg(
        F.sum("bytes").alias("total_bytes"), F.round(F.avg("bytes") / 1024, 4).alias("mean_kib"),
        F.floor(F.avg(F.col("width") * F.col("height"))).alias("mean_pixels"))


def verdict_counts(cases: DataFrame, keys, verdict: str) -> DataFrame:
    """AGG6. Counts of each verdict per cell."""
    return cases.groupBy(*keys).agg(
        *[total(F.col(verdict) == v).alias(v.lower()) for v in ("PASS", "FAIL", "SKIPPED")])


def check_status_counts(cases: DataFrame, keys, detail: str, checks) -> DataFrame:
    """AGG6 for every check of a rule detail: (keys, check, pass, fail, skipped)."""
    aggs, layout = [], {}
    for c in checks:
        cols = []
        for v in ("PASS", "FAIL", "SKIPPED"):
            col = f"{c}_{v}"
            aggs.append(total(F.col(f"{detail}.{c}") == v).alias(col))
            cols.append(col)
        layout[c] = cols
    return unpivot_counts(cases.groupBy(*keys).agg(*aggs), keys, "check", layout, ["pass", "fail", "skipped"])


def field_rows(cases: DataFrame) -> DataFrame:
    """One row per (case, extractable field) with reference and extracted text."""
    pair = lambda name, ref, hyp: F.struct(name.alias("field"), ref.alias("ref"), hyp.alias("hyp"))
    own = F.array(
        pair(F.col("id_field"), F.col("print_id"), F.col("ocr_id")),
        pair(F.lit("name"), F.col("print_name"), F.col("ocr_name")),
        pair(F.lit("dob"), F.col("print_dob"), F.col("ocr_dob")))
    father = F.array(pair(F.lit("father_name"), F.col("print_father"), F.col("ocr_father")))
    entries = F.when(F.col("doc_type") == "pan", F.concat(own, father)).otherwise(own)
    return cases.select("doc_type", "quality_tier", F.explode(entries).alias("f")).select(
        "doc_type", "quality_tier", "f.*")


def extraction_quality(fields: DataFrame) -> DataFrame:
    """AGG7. Exact-match rate with interval, mean character error rate, empty share per (doc, field, tier).

    Equal texts, which are most of them, never reach the edit distance.
    """
    cer = F.when(F.col("ref") == F.col("hyp"), 0.0).otherwise(char_error_rate(F.col("ref"), F.col("hyp")))
    out = fields.groupBy("doc_type", "field", "quality_tier").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(exact_match(F.col("ref"), F.col("hyp"))).alias("exact"),
        F.round(F.avg(cer), 6).alias("mean_cer"),
        F.round(F.avg((F.col("hyp") == "").cast("double")), 6).alias("empty_rate"))
    return with_wilson(out, "exact", "n")


def char_confusions(cases: DataFrame, top: int = 20) -> DataFrame:
    """AGG8, TOP1. Most frequent character confusions on identifiers of equal length.

    Ties are broken by the confusion itself. Only differing texts of equal length are cut into characters.
    """
    pairs = cases.where((F.length("print_id") == F.length("ocr_id")) & (F.col("print_id") != F.col("ocr_id")))
    spots = F.sequence(F.lit(1), F.length("print_id"))
    swaps = F.filter(
        F.transform(spots, lambda i: F.struct(
            F.substr("print_id", i, F.lit(1)).alias("a"), F.substr("ocr_id", i, F.lit(1)).alias("b"))),
        lambda p: p["a"] != p["b"])
    counted = pairs.select(F.explode(swaps).alias("p")).groupBy(
        F.concat(F.col("p.a"), F.lit("->"), F.col("p.b")).alias("confusion")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "confusion").limit(top)


def flips(cases: DataFrame) -> DataFrame:
    """AGG9. Verdict on true text against verdict on extracted text, per (doc, category, tier)."""
    a, b = F.col("rule_gt_verdict"), F.col("rule_ocr_verdict")
    induced = (a == "PASS") & (b == "FAIL")
    return cases.where(b.isNotNull()).groupBy("doc_type", "forgery_category", "quality_tier").agg(
        total(a == b).alias("stable"), total(induced).alias("ocr_induced"),
        total((a != b) & ~induced).alias("ocr_masked"))


def flips_all_tier(cases: DataFrame) -> DataFrame:
    """AGG10. As AGG9 with stable passes and failures apart, plus a row for all tiers."""
    gt, ocr = F.col("rule_gt") == 1, F.col("rule_ocr") == 1
    out = cases.groupingSets(
        [["forgery_category", "doc_type", "quality_tier"], ["forgery_category", "doc_type"]],
        "forgery_category", "doc_type", "quality_tier",
    ).agg(F.count(F.lit(1)).alias("n"), total(~gt & ~ocr).alias("stable_pass"), total(gt & ocr).alias("stable_fail"),
          total(~gt & ocr).alias("ocr_induced"), total(gt & ~ocr).alias("ocr_masked"), F.grouping("quality_tier").alias("_total"))
    return total_name(out, "quality_tier", "all")


def fpr_by_tier(cases: DataFrame) -> DataFrame:
    """AGG11. False positives on genuine rows per (doc, tier) and per doc."""
    out = cases.where(F.col("label") == 0).groupingSets(
        [["doc_type", "quality_tier"], ["doc_type"]], "doc_type", "quality_tier",
    ).agg(F.count(F.lit(1)).alias("n"), total(F.col("rule_ocr") == 1).alias("fp"),
          total(F.col("rule_gt") == 1).alias("fp_gt"), F.grouping("quality_tier").alias("_total"))
    return with_wilson(total_name(out, "quality_tier", "ALL"), "fp", "n")


def fpr_by_naming(cases: DataFrame) -> DataFrame:
    """AGG12. False positives on genuine PAN rows per naming stratum."""
    out = cases.where((F.col("label") == 0) & (F.col("doc_type") == "pan")).groupBy("naming_stratum").agg(
        F.count(F.lit(1)).alias("n"), total(F.col("rule_ocr") == 1).alias("fp"))
    return with_wilson(out, "fp", "n")


def loose_and_strict(cases: DataFrame) -> DataFrame:
    """AGG13. Loose fails, strict fails and skips of the name check over overlapping strata and both texts."""
    cells = cases.where((F.col("label") == 0) & (F.col("doc_type") == "pan")).groupBy(
        "naming_stratum", "pan_fifth_source").agg(
        F.count(F.lit(1)).alias("n"),
        *[total(F.col(f"{s}.semantic_check") == FAIL).alias(f"{s}_loose") for s in ("gt", "ocr")],
        *[total(F.col(f"{s}.semantic_strict") == FAIL).alias(f"{s}_strict") for s in ("gt", "ocr")],
        *[total(F.col(f"{s}.semantic_check") == SKIPPED).alias(f"{s}_skip") for s in ("gt", "ocr")])
    names = ["n"] + [f"{s}_{m}" for s in ("gt", "ocr") for m in ("loose", "strict", "skip")]
    summed = explode_masks(cells, genuine_strata(), "stratum").groupBy("stratum").agg(
        *[F.sum(c).alias(c) for c in names])
    out = unpivot_counts(
        summed, ["stratum"], "text",
        {s: ["n", f"{s}_loose", f"{s}_strict", f"{s}_skip"] for s in ("gt", "ocr")},
        ["n", "loose_fail", "strict_fail", "skipped"])
    for k in ("loose_fail", "strict_fail", "skipped"):
        w = wilson(F.col(k), F.col("n"))
        out = out.withColumns({f"{k}_rate": F.round(w["rate"], 6), f"{k}_lo": F.round(w["lo"], 6),
                               f"{k}_hi": F.round(w["hi"], 6)})
    return out


def flag_rate(cases: DataFrame) -> DataFrame:
    """AGG14. Flag rate per (doc, category, text source). Counts both sources in one pass."""
    cells = cases.groupBy("doc_type", "forgery_category").agg(
        F.count(F.lit(1)).alias("n"), total(F.col("rule_gt") == 1).alias("k_gt"),
        total(F.col("rule_ocr") == 1).alias("k_ocr"))
    out = unpivot_counts(cells, ["doc_type", "forgery_category"], "text",
                         {"gt": ["n", "k_gt"], "ocr": ["n", "k_ocr"]}, ["n", "flagged"])
    return with_wilson(out, "flagged", "n")


def coincidences(cases: DataFrame, issued: dict[str, list[float]], spaces: dict[str, int]) -> DataFrame:
    """AGG34, FN18. Distinct identifiers in play against register sizes."""
    ident = F.coalesce(F.when(F.col("forged_value") != "", F.col("forged_value")), F.col("own_id"))
    distinct = cases.select("doc_type", ident.alias("v")).where(F.col("v") != "").groupBy("doc_type").agg(
        F.countDistinct("v").alias("n_distinct"))
    sizes = F.lit(None)
    space = F.lit(None).cast("double")
    for doc, values in issued.items():
        sizes = F.when(F.col("doc_type") == doc, F.array(*[F.lit(float(v)) for v in values])).otherwise(sizes)
        space = F.when(F.col("doc_type") == doc, F.lit(float(spaces[doc]))).otherwise(space)
    out = distinct.withColumn("issued", F.explode(sizes)).withColumn("space", space)
    c = coincidence(F.col("n_distinct").cast("double"), F.col("issued"), F.col("space"))
    return out.select("doc_type", "n_distinct", "issued", F.round(c["p_single"], 9).alias("p_single"),
                      F.round(c["expected"], 6).alias("expected"),
                      F.round(c["p_at_least_one"], 9).alias("p_at_least_one"))


def preflight(cases: DataFrame) -> DataFrame:
    """AGG35. Verdicts on true text per cell, and how many differ from the design."""
    return cases.groupBy("doc_type", "forgery_category", "expected_rule").agg(
        total(F.col("rule_gt_verdict") == "PASS").alias("passed"),
        total(F.col("rule_gt_verdict") == "FAIL").alias("failed"),
        total(F.col("rule_gt_verdict") != F.col("expected_rule")).alias("violations"))


def violations(cases: DataFrame, verdict: str = "rule_gt_verdict", limit: int = 50) -> DataFrame:
    """AGG35, TOP2. First rows, by id, whose verdict differs from the design."""
    return cases.where(F.col(verdict) != F.col("expected_rule")).select(
        "image_id", "doc_type", "forgery_category", F.col(verdict).alias("verdict"), "expected_rule"
    ).orderBy("image_id").limit(limit)
