"""Evaluation queries over the case table, and over labels joined to documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldaudit.functions.fields import CATEGORIES, DOC_TYPES
from fieldaudit.operators import evaluate as op
from fieldaudit.operators.masks import in_split
from fieldaudit.plans import sql
from fieldaudit.sources.tables import cases, spread, table

BASIC = {"visual": "visual", "rules_gt": "rule_gt", "rules_ocr": "rule_ocr"}
VAL, TEST = "split = 'val'", "split = 'test'"
MEASURES = ("precision", "recall", "fpr", "fnr", "specificity", "f1")


def rounded(df, names=MEASURES):
    return df.withColumns({m: F.round(m, 6) for m in names})


def long_documents(spark, d):
    """Documents flagged as good when long, against their quality label."""
    docs = table(spark, d, "documents").select("doc_id", "source", (F.col("n_chars") >= 1000).cast("int").alias("decision"))
    return spread(table(spark, d, "labels"), "doc_id").join(docs, "doc_id")


def two_splits(spark, d):
    """FPR and recall of each system on validation and test, side by side."""
    df = op.combined_systems(cases(spark, d))
    parts = [op.system_summary(df.where(in_split(s)), op.SYSTEM_COLUMNS) for s in ("val", "test")]
    return op.side_by_side(*parts, "system", ["fpr", "recall_all"], ("val", "test"))


QUERIES = {
    "confusion_metrics": lambda s, d: rounded(op.confusion(cases(s, d), ["doc_type"], "label", "rule_ocr")),
    "confusion_metrics_labels": lambda s, d: rounded(op.confusion(long_documents(s, d), ["source"], "quality", "decision")),
    "slice_report": lambda s, d: op.slice_report(cases(s, d), BASIC),
    "slice_report_core": lambda s, d: rounded(op.core_report(op.combined_systems(cases(s, d)), op.SYSTEM_COLUMNS)),
    "mask_rates": lambda s, d: op.mask_rates(cases(s, d), BASIC),
    "rule_metrics_grouping_sets": lambda s, d: op.rule_metrics(
        cases(s, d).where(in_split("test")), {"gt": "rule_gt_verdict", "ocr": "rule_ocr_verdict"}),
    "rule_decisions": lambda s, d: op.rule_decisions(cases(s, d)).drop("gt_reason", "ocr_reason"),
    "mechanism_aware": lambda s, d: op.mechanism_aware(cases(s, d)),
    "explanation_quality": lambda s, d: op.explanations(cases(s, d)),
    "recovery_matrix": lambda s, d: op.recovery(cases(s, d)),
    "missed_by_detector": lambda s, d: op.missed_by_detector(cases(s, d)),
    "or_and_fusion": lambda s, d: op.system_summary(op.combined_systems(cases(s, d)), op.SYSTEM_COLUMNS),
    "two_splits_side_by_side": two_splits,
    "stratified_fpr": lambda s, d: op.stratified_fpr(cases(s, d), {"visual": "visual", "rules_ocr": "rule_ocr"}),
    "failing_checks_on_genuine": lambda s, d: op.failing_checks_on_genuine(cases(s, d)),
}

_cases = sql.with_(sql.cases())


def confusion_sql(relation, key, truth, flag):
    return f"""select {key}, tp, fp, tn, fn,
      round(case when tp + fp > 0 then tp::double / (tp + fp) end, 6) as precision,
      round(case when tp + fn > 0 then tp::double / (tp + fn) end, 6) as recall,
      round(case when fp + tn > 0 then fp::double / (fp + tn) end, 6) as fpr,
      round(case when tp + fn > 0 then fn::double / (tp + fn) end, 6) as fnr,
      round(case when fp + tn > 0 then tn::double / (fp + tn) end, 6) as specificity,
      round(case when tp + fp > 0 and tp + fn > 0 then case when tp = 0 then 0 else 2.0::double * tp / (2 * tp + fp + fn) end end, 6) as f1,
      concat_ws('; ', case when tp + fp = 0 then 'no row is flagged' end, case when tp + fn = 0 then 'no row is forged' end,
        case when fp + tn = 0 then 'no row is genuine' end) as undefined
      from (select {key}, count(*) filter (where {truth} = 1 and {flag} = 1) as tp, count(*) filter (where {truth} = 0 and {flag} = 1) as fp,
        count(*) filter (where {truth} = 0 and {flag} = 0) as tn, count(*) filter (where {truth} = 1 and {flag} = 0) as fn
        from {relation} group by 1)"""


def systems_cte(systems):
    return "sys as (" + " union all ".join(f"select *, '{s}' as system, {c} as flag from cx" for s, c in systems.items()) + ")"


_combined = """cx as (select *, greatest(visual, rule_gt) as or_gt, greatest(visual, rule_ocr) as or_ocr,
  least(visual, rule_gt) as and_gt, least(visual, rule_ocr) as and_ocr from cases)"""
_basic = sql.with_(sql.cases(), "cx as (select * from cases)", systems_cte(BASIC))
_all_systems = sql.with_(sql.cases(), _combined, systems_cte(op.SYSTEM_COLUMNS))
_group = "case when c1_op in ('local_recompression', 'resample_patch') then 'fine' else 'coarse' end"


def _slices():
    parts = [
        ("flag_rate", "doc_type || '/' || forgery_category", "true"), ("flag_rate_by_category", "forgery_category", "true"),
        ("c0_fpr_by_tier", "doc_type || '/' || quality_tier", "label = 0"), ("c1_recall_by_op", "c1_op", "forgery_category = 'C1'"),
        ("c1_recall_by_group", _group, "forgery_category = 'C1'"), ("c1_recall_by_tier", "quality_tier", "forgery_category = 'C1'"),
        ("detection_recall", "'all'", "label = 1"), ("fpr", "'all'", "label = 0"), ("recall_by_doc", "doc_type", "label = 1"),
        ("fpr_by_doc", "doc_type", "label = 0"), ("rule_coverage_recall", "'all'", "expected_rule = 'FAIL'")]
    return _basic + " union all ".join(
        f"select system, '{s}' as section, {c} as cell, count(*) as n, sum(flag)::bigint as flagged, round(avg(flag), 6) as rate "
        f"from sys where {p} group by system, {c}" for s, c, p in parts)


def _masks():
    m = {"forged": "label = 1", "c0": "label = 0", "eligible": "expected_rule = 'FAIL'", "c1": "forgery_category = 'C1'",
         "c1_fine": f"forgery_category = 'C1' and {_group} = 'fine'", "c1_coarse": f"forgery_category = 'C1' and {_group} = 'coarse'"}
    m |= {c: f"forgery_category = '{c}'" for c in CATEGORIES}
    for d in DOC_TYPES:
        m |= {f"forged/{d}": f"label = 1 and doc_type = '{d}'", f"c0/{d}": f"label = 0 and doc_type = '{d}'"}
        m |= {f"{d}/{c}": f"doc_type = '{d}' and forgery_category = '{c}'" for c in CATEGORIES}
    for t in ("clean", "mild", "severe"):
        for name, p in (("c0", "label = 0"), ("c1", "forgery_category = 'C1'"), ("forged", "label = 1")):
            m[f"{name}/{t}"] = f"{p} and quality_tier = '{t}'"
        m |= {f"c0/{d}/{t}": f"label = 0 and doc_type = '{d}' and quality_tier = '{t}'" for d in DOC_TYPES}
    m |= {f"c1/{o}": f"c1_op = '{o}'" for o in ("local_recompression", "resample_patch", "font_substitution",
                                               "field_displacement", "patch_splice")}
    return _basic + " union all ".join(
        f"select '{k}' as mask, system, count(*) as n, sum(flag)::bigint as flagged, round(avg(flag), 6) as rate from sys where {p} group by system"
        for k, p in m.items())


def _rule_metrics():
    parts = []
    for text in ("gt", "ocr"):
        f = f"rule_{text}"
        parts.append(f"""select coalesce(doc_type, 'all') as doc_type, coalesce(forgery_category, 'all') as forgery_category, '{text}' as text, count(*) as n,
          count(*) filter (where expected_rule = 'FAIL' and {f} = 1) as tp, count(*) filter (where expected_rule = 'PASS' and {f} = 1) as fp,
          count(*) filter (where expected_rule = 'PASS' and {f} = 0) as tn, count(*) filter (where expected_rule = 'FAIL' and {f} = 0) as fn
          from cases where split = 'test' group by grouping sets ((), (doc_type), (forgery_category))""")
    return f"""{_cases} select *, round(coalesce(tp::double / nullif(tp + fp, 0), 0), 6) as precision,
      round(coalesce(tp::double / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(fp::double / nullif(fp + tn, 0), 0), 6) as fpr,
      round(case when tp = 0 then 0 else 2.0::double * tp / (2 * tp + fp + fn) end, 6) as f1 from ({' union all '.join(parts)})"""


_match = """((forgery_category = 'C2' and doc_type = 'aadhaar' and ({s}_format = 'FAIL' or {s}_checksum = 'FAIL'))
  or (forgery_category = 'C2' and doc_type = 'pan' and ({s}_format = 'FAIL' or {s}_category = 'FAIL'))
  or (forgery_category = 'C3' and doc_type = 'pan' and {s}_semantic = 'FAIL'))::int"""
_dec = sql.with_(sql.cases(), "rd as (select *, (expected_rule = 'FAIL')::int as eligible, "
                 + ", ".join(_match.format(s=s) + f" as {s}_hit" for s in ("gt", "ocr")) + " from cases)")


def _mechanism():
    z = "1.959963985::double"
    p, d = "(aware::double / n)", f"(1 + {z} * {z} / n)"
    c = f"(({p} + {z} * {z} / (2 * n)) / {d})"
    h = f"({z} * sqrt({p} * (1 - {p}) / n + {z} * {z} / (4.0::double * n * n)) / {d})"
    parts = " union all ".join(
        f"select split, doc_type, forgery_category, '{s}' as text, count(*) as n, sum(rule_{s})::bigint as flagged, sum({s}_hit)::bigint as aware, "
        f"count(*) filter (where eligible = 1 and rule_{s} = 1 and {s}_hit = 0) as over from rd where forgery_category in ('C2', 'C3') group by 1, 2, 3"
        for s in ("gt", "ocr"))
    return f"{_dec} select *, round({p}, 4) as recall, round(100 * ({c} - {h}), 1) as lo, round(100 * ({c} + {h}), 1) as hi from ({parts})"


def _explanations():
    long = " union all ".join(
        f"select doc_type, forgery_category, '{s}' as text, rule_{s} as flag, {s}_hit as hit, {s}_failed as failed from rd where eligible = 1"
        for s in ("gt", "ocr"))
    return f"""{_dec}, l as ({long}), w as (select doc_type, forgery_category, text, string_agg(failed || ':' || c::varchar, ',' order by failed || ':' || c::varchar) as over_attributed_to
      from (select doc_type, forgery_category, text, failed, count(*) as c from l where flag = 1 and hit = 0 group by 1, 2, 3, 4) group by 1, 2, 3)
      select doc_type, forgery_category, text, count(*) as n, sum(flag)::bigint as flagged, sum(hit)::bigint as aware,
        count(*) filter (where flag = 1 and hit = 0) as over, coalesce(any_value(over_attributed_to), '') as over_attributed_to,
        round(sum(hit)::double / nullif(sum(flag), 0), 6) as share_correct from l left join w using (doc_type, forgery_category, text) group by 1, 2, 3"""


def _recovery():
    parts = []
    for s in ("gt", "ocr"):
        for g in ("forgery_category", f"'C1-' || {_group}"):
            where = "true" if g == "forgery_category" else "forgery_category = 'C1'"
            parts.append(f"""select '{s}' as text, doc_type, {g} as "group", count(*) filter (where visual = 1 and rule_{s} = 1) as both,
              count(*) filter (where visual = 1 and rule_{s} = 0) as first_only, count(*) filter (where visual = 0 and rule_{s} = 1) as second_only,
              count(*) filter (where visual = 0 and rule_{s} = 0) as neither, count(*) as n from cases where {where} group by 1, 2, 3""")
    return _cases + " union all ".join(parts)


def summary_select(where="true"):
    share = lambda p, name: f"round(avg(flag) filter (where {p}), 6) as {name}"
    cols = [share("label = 0", "fpr"), share("label = 1", "recall_all")]
    cols += [share(f"label = 0 and doc_type = '{d}'", f"fpr_{d}") for d in DOC_TYPES]
    cols += [share(f"forgery_category = '{c}'", f"recall_{c}") for c in CATEGORIES[1:]]
    cols += [share(f"forgery_category = '{c}' and doc_type = '{d}'", f"recall_{d}_{c}") for d in DOC_TYPES for c in CATEGORIES[1:]]
    return f"select system, sum(flag)::bigint as n_flagged, {', '.join(cols)} from sys where {where} group by system"


def _stratified():
    parts = [("doc_type || '/' || quality_tier", "true"), ("doc_type || '/id_read_exact=' || (print_id = ocr_id)::int::varchar", "true"),
             ("'pan/naming=' || naming_stratum", "doc_type = 'pan'"), ("'pan/fifth=' || pan_fifth_source", "doc_type = 'pan'"),
             ("'pan/name_read_exact=' || (print_name = ocr_name)::int::varchar", "doc_type = 'pan'")]
    return _basic + " union all ".join(
        f"select system, {c} as stratum, count(*) as n, sum(flag)::bigint as flagged, round(avg(flag), 6) as fpr "
        f"from sys where label = 0 and system <> 'rules_gt' and {p} group by 1, 2" for c, p in parts)


ORACLES = {
    "confusion_metrics": _cases + confusion_sql("cases", "doc_type", "label", "rule_ocr"),
    "confusion_metrics_labels": "with ld as (select source, quality, (n_chars >= 1000)::int as decision from labels join documents using (doc_id)) "
        + confusion_sql("ld", "source", "quality", "decision"),
    "slice_report": _slices(),
    "slice_report_core": _all_systems + """, rk as (select *, system || '|' || doc_type as k from sys union all select *, system || '|all' from sys) select split_part(k, '|', 1) as system,
        split_part(k, '|', 2) as doc_type, * exclude (k) from (""" + confusion_sql("rk", "k", "label", "flag") + ")",
    "mask_rates": _masks(),
    "rule_metrics_grouping_sets": _rule_metrics(),
    "rule_decisions": f"""{_dec} select image_id, split, doc_type, forgery_category, label, quality_tier, expected_rule,
        coalesce(forgery_field, '') as forgery_field, eligible, rule_gt as gt_decision, gt_failed as gt_failed_checks, gt_hit as gt_mechanism_match,
        rule_ocr as ocr_decision, ocr_failed as ocr_failed_checks, ocr_hit as ocr_mechanism_match from rd""",
    "mechanism_aware": _mechanism(),
    "explanation_quality": _explanations(),
    "recovery_matrix": _recovery(),
    "missed_by_detector": _cases + " union all ".join(
        f"select doc_type, forgery_category, '{s}' as text, count(*) as missed, sum(rule_{s})::bigint as caught, round(avg(rule_{s}), 6) as rate "
        f"from cases where visual = 0 and forgery_category in ('C2', 'C3', 'C4') group by 1, 2" for s in ("gt", "ocr")),
    "or_and_fusion": _all_systems + summary_select(),
    "two_splits_side_by_side": f"{_all_systems}, v as ({summary_select(VAL)}), t as ({summary_select(TEST)}) "
        "select system, v.fpr as fpr_val, v.recall_all as recall_all_val, t.fpr as fpr_test, t.recall_all as recall_all_test from v full join t using (system)",
    "stratified_fpr": _stratified(),
    "failing_checks_on_genuine": f"{_cases} select doc_type, ocr_failed as failed, count(*) as n from cases where label = 0 and rule_ocr = 1 group by 1, 2",
}
