"""Detector and rule evaluation: AGG15-AGG25, PRJ7, JOI5, JOI20, SET5, STA12."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldaudit.functions.fields import CATEGORIES, CHECKS, DOC_TYPES, failed_text, mechanism_match, op_group
from fieldaudit.functions.measures import ratio, wilson_percent
from fieldaudit.operators.characterise import total, unpivot_counts
from fieldaudit.operators.masks import CELL, case_masks, explode_masks


def core_metrics(counts: DataFrame) -> DataFrame:
    """AGG15, AGG16. Measures from columns tp, fp, tn, fn; an undefined ratio is null, with its reason beside it."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    df = counts.withColumns({
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "fpr": ratio(fp, fp + tn),
        "fnr": ratio(fn, fn + tp), "specificity": ratio(tn, tn + fp),
        "undefined": F.concat_ws("; ", F.when(tp + fp == 0, "no row is flagged"), F.when(tp + fn == 0, "no row is forged"),
                                 F.when(fp + tn == 0, "no row is genuine")),
    })
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p.isNull() | r.isNull(), None).when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return df.withColumn("f1", f1)


def confusion_aggs(truth: Column, flagged: Column):
    return [total(truth & flagged).alias("tp"), total(~truth & flagged).alias("fp"),
            total(~truth & ~flagged).alias("tn"), total(truth & ~flagged).alias("fn")]


def confusion(df: DataFrame, keys, label: str, decision: str) -> DataFrame:
    """AGG15 per group."""
    return core_metrics(df.groupBy(*keys).agg(*confusion_aggs(F.col(label) == 1, F.col(decision) == 1)))


def unpivot_systems(df: DataFrame, systems: dict[str, str], keys) -> DataFrame:
    """SET5. Cell counts per system from one aggregate: (keys, system, n, flagged)."""
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c)).cast("long").alias(f"k_{s}") for s, c in systems.items()])
    return unpivot_counts(counts, keys, "system", {s: ["n", f"k_{s}"] for s in systems}, ["n", "flagged"])


def slice_report(cases: DataFrame, systems: dict[str, str]) -> DataFrame:
    """AGG17, SNK5's shape. Every slice of the evaluation as (system, section, cell, n, flagged, rate).

    Rows are counted once per finest cell; sections are built from the cells.
    """
    cells = unpivot_systems(cases, systems, list(CELL))
    doc, cat, tier, op = (F.col(c) for c in ("doc_type", "forgery_category", "quality_tier", "c1_op"))
    piece = lambda section, cell, keep=F.lit(True): F.when(
        keep, F.struct(F.lit(section).alias("section"), cell.alias("cell")))
    c0, c1 = cat == "C0", cat == "C1"
    slices = F.array_compact(F.array(
        piece("flag_rate", F.concat_ws("/", doc, cat)), piece("flag_rate_by_category", cat),
        piece("c0_fpr_by_tier", F.concat_ws("/", doc, tier), c0), piece("c1_recall_by_op", op, c1),
        piece("c1_recall_by_group", op_group(op), c1), piece("c1_recall_by_tier", tier, c1),
        piece("detection_recall", F.lit("all"), ~c0), piece("fpr", F.lit("all"), c0),
        piece("recall_by_doc", doc, ~c0), piece("fpr_by_doc", doc, c0),
        piece("rule_coverage_recall", F.lit("all"), F.col("expected_rule") == "FAIL")))
    out = cells.select("system", "n", "flagged", F.explode(slices).alias("s")).groupBy(
        "system", "s.section", "s.cell").agg(F.sum("n").alias("n"), F.sum("flagged").alias("flagged"))
    return out.withColumn("rate", F.round(ratio(F.col("flagged"), F.col("n")), 6))


def core_report(cases: DataFrame, systems: dict[str, str]) -> DataFrame:
    """AGG17. Core metrics of every system over all rows (``doc_type`` is ``all``) and per document type, from one aggregate."""
    cells = unpivot_systems(cases, systems, ["doc_type", "label"])
    forged, n, hit = F.col("label") == 1, F.col("n"), F.col("flagged")
    part = lambda p, v: F.sum(F.when(p, v).otherwise(0)).cast("long")
    counts = cells.groupingSets([["system", "doc_type"], ["system"]], "system", "doc_type").agg(
        part(forged, hit).alias("tp"), part(~forged, hit).alias("fp"), part(~forged, n - hit).alias("tn"), part(forged, n - hit).alias("fn"),
        F.grouping("doc_type").alias("_total"))
    return core_metrics(counts.withColumn("doc_type", F.when(F.col("_total") == 1, "all").otherwise(F.col("doc_type"))).drop("_total"))


def mask_rates(cases: DataFrame, systems: dict[str, str]) -> DataFrame:
    """FLT2 over the finest cells: (mask, system, n, flagged, rate)."""
    cells = unpivot_systems(cases, systems, list(CELL))
    out = explode_masks(cells, case_masks()).groupBy("mask", "system").agg(
        F.sum("n").alias("n"), F.sum("flagged").alias("flagged"))
    return out.withColumn("rate", F.round(ratio(F.col("flagged"), F.col("n")), 6))


def rule_metrics(cases: DataFrame, verdicts: dict[str, str]) -> DataFrame:
    """AGG18. Rule verdict against the designed verdict: overall, by document, by category.

    Unlike AGG15 an undefined ratio counts as 0 here.
    """
    aggs, layout = [F.count(F.lit(1)).alias("n")], {}
    truth = F.col("expected_rule") == "FAIL"
    for text, column in verdicts.items():
        cols = [f"{text}_{m}" for m in ("tp", "fp", "tn", "fn")]
        aggs += [a.alias(c) for a, c in zip(confusion_aggs(truth, F.col(column) == "FAIL"), cols)]
        layout[text] = ["n"] + cols
    g = cases.groupingSets([[], ["doc_type"], ["forgery_category"]], "doc_type", "forgery_category").agg(
        *aggs, *[F.grouping(c).alias(f"_all_{c}") for c in ("doc_type", "forgery_category")])
    g = g.withColumns({c: F.when(F.col(f"_all_{c}") == 1, "all").otherwise(F.col(c)) for c in ("doc_type", "forgery_category")})
    keys = ["doc_type", "forgery_category"]
    out = unpivot_counts(g, keys, "text", layout, ["n", "tp", "fp", "tn", "fn"])
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    out = out.withColumns({"precision": zero(tp, tp + fp), "recall": zero(tp, tp + fn), "fpr": zero(fp, fp + tn)})
    p, r = F.col("precision"), F.col("recall")
    out = out.withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))
    return out.withColumns({m: F.round(m, 6) for m in ("precision", "recall", "fpr", "f1")})


def rule_decisions(cases: DataFrame) -> DataFrame:
    """SNK8's table: per case and text the decision, failed checks, mechanism match and reason."""
    cols = {"eligible": (F.col("expected_rule") == "FAIL").cast("int")}
    for s in ("gt", "ocr"):
        cols |= {f"{s}_decision": F.col(f"rule_{s}"), f"{s}_failed_checks": failed_text(F.col(s)),
                 f"{s}_mechanism_match": mechanism_match(F.col("doc_type"), F.col("forgery_category"), F.col(s)),
                 f"{s}_reason": F.col(f"{s}.reason")}
    return cases.select("image_id", "split", "doc_type", "forgery_category", "label", "quality_tier", "expected_rule",
                        F.coalesce("forgery_field", F.lit("")).alias("forgery_field"),
                        *[v.alias(k) for k, v in cols.items()])


def mechanism_aware(cases: DataFrame) -> DataFrame:
    """AGG19, FN17b. Flagged, mechanism-aware and over-attributed counts of the eligible cells and the expected miss."""
    d = rule_decisions(cases).where(F.col("forgery_category").isin("C2", "C3"))
    keys = ["split", "doc_type", "forgery_category"]
    aggs, layout = [F.count(F.lit(1)).alias("n")], {}
    for s in ("gt", "ocr"):
        hit = F.col(f"{s}_mechanism_match") == 1
        flagged = F.col(f"{s}_decision") == 1
        names = [f"{s}_{x}" for x in ("flagged", "aware", "over")]
        aggs += [total(flagged).alias(names[0]), total(hit).alias(names[1]),
                 total((F.col("eligible") == 1) & flagged & ~hit).alias(names[2])]
        layout[s] = ["n"] + names
    out = unpivot_counts(d.groupBy(*keys).agg(*aggs), keys, "text", layout, ["n", "flagged", "aware", "over"])
    ci = wilson_percent(F.col("aware"), F.col("n"))
    return out.withColumns({"recall": F.round(ratio(F.col("aware"), F.col("n")), 4), "lo": ci["lo"], "hi": ci["hi"]})


def explanations(cases: DataFrame) -> DataFrame:
    """AGG24. Share of right reasons among flags, and which checks wrong reasons name, as ``checks:count`` text."""
    d = rule_decisions(cases).where(F.col("eligible") == 1)
    keys = ["doc_type", "forgery_category"]
    long = d.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(s).alias("text"), F.col(f"{s}_decision").alias("flag"), F.col(f"{s}_mechanism_match").alias("hit"),
                 F.col(f"{s}_failed_checks").alias("failed")) for s in ("gt", "ocr")])).alias("x")).select(*keys, "x.*")
    cells = long.groupBy(*keys, "text", "flag", "hit", "failed").agg(F.count(F.lit(1)).alias("c"))
    n = lambda p: F.sum(F.when(p, F.col("c")).otherwise(0))
    flagged, hit = F.col("flag") == 1, F.col("hit") == 1
    wrong = F.when(flagged & ~hit, F.concat(F.col("failed"), F.lit(":"), F.col("c").cast("string")))
    out = cells.groupBy(*keys, "text").agg(
        F.sum("c").alias("n"), n(flagged).alias("flagged"), n(hit).alias("aware"), n(flagged & ~hit).alias("over"),
        F.array_join(F.array_sort(F.collect_list(wrong)), ",").alias("over_attributed_to"))
    return out.withColumn("share_correct", F.round(ratio(F.col("aware"), F.col("flagged")), 6))


def outcome(first: Column, second: Column) -> Column:
    """JOI5's four-way outcome of two decisions."""
    return (F.when((first == 1) & (second == 1), "both").when(first == 1, "first_only")
            .when(second == 1, "second_only").otherwise("neither"))


def recovery(cases: DataFrame) -> DataFrame:
    """AGG20. Detector and rules against each other per (text, doc, group); C1 rows also count in their sub-group."""
    cell = ["doc_type", "forgery_category", "c1_op"]
    aggs, layout = [], {}
    for s in ("gt", "ocr"):
        o = outcome(F.col("visual"), F.col(f"rule_{s}"))
        names = [f"{s}_{x}" for x in ("both", "first_only", "second_only", "neither")]
        aggs += [total(o == x).alias(c) for x, c in zip(("both", "first_only", "second_only", "neither"), names)]
        layout[s] = names
    cells = cases.groupBy(*cell).agg(*aggs)
    groups = F.array_compact(F.array(F.col("forgery_category"),
                                     F.when(F.col("forgery_category") == "C1", F.concat(F.lit("C1-"), op_group(F.col("c1_op"))))))
    outs = ["both", "first_only", "second_only", "neither"]
    long = unpivot_counts(cells, cell, "text", layout, outs)
    summed = long.withColumn("group", F.explode(groups)).groupBy("text", "doc_type", "group").agg(
        *[F.sum(c).alias(c) for c in outs])
    return summed.withColumn("n", sum((F.col(c) for c in outs[1:]), F.col("both")))


def join_decisions(first: DataFrame, second: DataFrame, key: str = "image_id") -> DataFrame:
    """JOI5. Two decision tables side by side with their outcome."""
    joined = first.select(key, F.col("decision").alias("first")).join(
        second.select(key, F.col("decision").alias("second")), key)
    return joined.withColumn("outcome", outcome(F.col("first"), F.col("second")))


def missed_by_detector(cases: DataFrame) -> DataFrame:
    """AGG25. What the rules catch among altered rows the detector missed."""
    keys = ["doc_type", "forgery_category"]
    missed = cases.where((F.col("visual") == 0) & F.col("forgery_category").isin("C2", "C3", "C4"))
    counts = missed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"rule_{s}").cast("long").alias(f"k_{s}") for s in ("gt", "ocr")])
    out = unpivot_counts(counts, keys, "text", {s: ["n", f"k_{s}"] for s in ("gt", "ocr")}, ["missed", "caught"])
    return out.withColumn("rate", F.round(ratio(F.col("caught"), F.col("missed")), 6))


def combined_systems(cases: DataFrame) -> DataFrame:
    """STA12. Detector, rules, and their OR and AND on both texts, as 0/1 columns."""
    cols = {}
    for s in ("gt", "ocr"):
        cols[f"or_{s}"] = F.greatest("visual", f"rule_{s}")
        cols[f"and_{s}"] = F.least("visual", f"rule_{s}")
    return cases.withColumns(cols)


SYSTEM_COLUMNS = {"visual": "visual", "rules_gt": "rule_gt", "rules_ocr": "rule_ocr", "or_gt": "or_gt", "or_ocr": "or_ocr",
                  "and_gt": "and_gt", "and_ocr": "and_ocr"}


def system_summary(cases: DataFrame, systems: dict[str, str]) -> DataFrame:
    """AGG21. One row per system: false-positive rates and recalls per document and category."""
    cells = unpivot_systems(cases, systems, ["doc_type", "forgery_category"])
    doc, cat = F.col("doc_type"), F.col("forgery_category")
    share = lambda p: F.round(
        F.sum(F.when(p, F.col("flagged"))) / F.sum(F.when(p, F.col("n"))), 6)
    aggs = [F.sum("flagged").alias("n_flagged"), share(cat == "C0").alias("fpr"), share(cat != "C0").alias("recall_all")]
    aggs += [share((doc == d) & (cat == "C0")).alias(f"fpr_{d}") for d in DOC_TYPES]
    aggs += [share(cat == c).alias(f"recall_{c}") for c in CATEGORIES[1:]]
    aggs += [share((doc == d) & (cat == c)).alias(f"recall_{d}_{c}") for d in DOC_TYPES for c in CATEGORIES[1:]]
    return cells.groupBy("system").agg(*aggs)


def stratified_fpr(cases: DataFrame, systems: dict[str, str]) -> DataFrame:
    """AGG22. False positives on genuine rows over overlapping strata, per system."""
    df = cases.where(F.col("label") == 0).withColumns({
        "id_ok": (F.col("print_id") == F.col("ocr_id")).cast("int"),
        "name_ok": (F.col("print_name") == F.col("ocr_name")).cast("int")})
    keys = ["doc_type", "quality_tier", "naming_stratum", "pan_fifth_source", "id_ok", "name_ok"]
    cells = unpivot_systems(df, systems, keys)
    doc, pan = F.col("doc_type"), F.col("doc_type") == "pan"
    strata = F.array_compact(F.array(
        F.concat_ws("/", doc, F.col("quality_tier")),
        F.concat(doc, F.lit("/id_read_exact="), F.col("id_ok").cast("string")),
        F.when(pan, F.concat(F.lit("pan/naming="), F.col("naming_stratum"))),
        F.when(pan, F.concat(F.lit("pan/fifth="), F.col("pan_fifth_source"))),
        F.when(pan, F.concat(F.lit("pan/name_read_exact="), F.col("name_ok").cast("string")))))
    out = cells.withColumn("stratum", F.explode(strata)).groupBy("system", "stratum").agg(
        F.sum("n").alias("n"), F.sum("flagged").alias("flagged"))
    return out.withColumn("fpr", F.round(ratio(F.col("flagged"), F.col("n")), 6))


def failing_checks_on_genuine(cases: DataFrame) -> DataFrame:
    """AGG23."""
    return cases.where((F.col("label") == 0) & (F.col("rule_ocr") == 1)).groupBy(
        "doc_type", failed_text(F.col("ocr")).alias("failed")).agg(F.count(F.lit(1)).alias("n"))


def check_indicators(cases: DataFrame, source: str) -> dict[str, Column]:
    """PRJ7. One 0/1 column per (document, check)."""
    return {f"{d}_{c}": ((F.col("doc_type") == d) & (F.col(f"{source}.{c}") == "FAIL")).cast("double")
            for d, checks in CHECKS.items() for c in checks}


def side_by_side(first: DataFrame, second: DataFrame, key: str, columns, names=("a", "b")) -> DataFrame:
    """JOI20. The same measures of two corpora next to each other, per system."""
    left = first.select(key, *[F.col(c).alias(f"{c}_{names[0]}") for c in columns])
    right = second.select(key, *[F.col(c).alias(f"{c}_{names[1]}") for c in columns])
    return left.join(right, key, "full_outer")
