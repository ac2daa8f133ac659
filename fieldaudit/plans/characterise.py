"""Characterisation queries over the case table."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldaudit.operators import characterise as op
from fieldaudit.operators import synth
from fieldaudit.plans import sql
from fieldaudit.sources.tables import cases, spread, table

CELL = ("doc_type", "forgery_category")
# Sizes of the issued registers, two estimates per document type.
ISSUED = {"aadhaar": [1.0e9, 1.42e9], "pan": [7.0e8, 8.0e8]}
# Identifier spaces under the generator's constraints.
SPACES = {"aadhaar": 80_000_000_000, "pan": 26**3 * 10 * 10_000 * 26}


def all_documents(spark, d):
    return spread(table(spark, d, "documents"), "doc_id")


def people(spark, d):
    """Persons of the synthetic identities, one per customer."""
    return synth.with_identity(spread(table(spark, d, "customer"), "c_custkey"), "c_custkey")


def files(spark, d):
    """Documents seen as stored files: size in bytes, and lines times longest line as extent."""
    df = all_documents(spark, d)
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    return df.select("source", F.octet_length("text").cast("long").alias("bytes"), F.length("text").alias("width"),
                     lines.alias("height"))


QUERIES = {
    "rule_flag_rate": lambda s, d: op.flag_rate(cases(s, d)),
    "rule_check_status": lambda s, d: op.check_status_counts(
        cases(s, d), CELL, "ocr", ("format_check", "checksum_check", "category_check", "semantic_check",
                                   "semantic_strict")),
    "rule_verdict_counts": lambda s, d: op.verdict_counts(
        cases(s, d), ("doc_type", "forgery_category", "quality_tier"), "rule_ocr_verdict"),
    "verdict_flips": lambda s, d: op.flips(cases(s, d)),
    "verdict_flips_all_tier": lambda s, d: op.flips_all_tier(cases(s, d)),
    "field_extraction_quality": lambda s, d: op.extraction_quality(op.field_rows(cases(s, d))),
    "char_confusions_top20": lambda s, d: op.char_confusions(cases(s, d)),
    "composition_grouping_sets": lambda s, d: op.composition(cases(s, d)),
    "composition_totals": lambda s, d: op.totals(cases(s, d)),
    "split_sizes": lambda s, d: op.split_sizes(cases(s, d)),
    "person_attribute_counts": lambda s, d: op.person_attributes(
        people(s, d), ["naming_stratum", "pan_fifth_source", "gender"]),
    "honorific_rate": lambda s, d: op.honorific_rate(people(s, d)),
    "storage_by_source": lambda s, d: op.storage(files(s, d), "source"),
    "fpr_by_tier_all": lambda s, d: op.fpr_by_tier(cases(s, d)),
    "fpr_by_naming_stratum": lambda s, d: op.fpr_by_naming(cases(s, d)),
    "permissive_vs_strict": lambda s, d: op.loose_and_strict(cases(s, d)),
    "coincidence": lambda s, d: op.coincidences(cases(s, d), ISSUED, SPACES),
    "preflight_counts": lambda s, d: op.preflight(cases(s, d)),
    "design_violations_top50": lambda s, d: op.violations(cases(s, d), "rule_ocr_verdict"),
}

_cases = sql.with_(sql.cases())
_flips = """count(*) filter (where rule_gt = 0 and rule_ocr = 0) as stable_pass,
 count(*) filter (where rule_gt = 1 and rule_ocr = 1) as stable_fail,
 count(*) filter (where rule_gt = 0 and rule_ocr = 1) as ocr_induced,
 count(*) filter (where rule_gt = 1 and rule_ocr = 0) as ocr_masked"""
_strata = {
    "ALL": "true", "surname_last": "naming_stratum = 'surname_last'", "initial_first": "naming_stratum = 'initial_first'",
    "mononymic": "naming_stratum = 'mononymic'", "p5src:leading_initial": "pan_fifth_source = 'leading_initial'",
    "p5src:given_name": "pan_fifth_source = 'given_name'",
}


def _loose_strict():
    parts = []
    for name, pred in _strata.items():
        for s in ("gt", "ocr"):
            parts.append(f"select '{name}' as stratum, '{s}' as text, count(*) as n, "
                         f"count(*) filter (where {s}_semantic = 'FAIL') as loose_fail, "
                         f"count(*) filter (where {s}_strict = 'FAIL') as strict_fail, "
                         f"count(*) filter (where {s}_semantic = 'SKIPPED') as skipped "
                         f"from cases where label = 0 and doc_type = 'pan' and {pred}")
    w = []
    for k in ("loose_fail", "strict_fail", "skipped"):
        w.append(sql.wilson(k, "n", f"{k}_"))
    return f"{_cases} select *, {', '.join(w)} from ({' union all '.join(parts)})"


def _coincidence():
    size = " union all ".join(
        f"select '{doc}' as doc_type, {v}::double as issued, {SPACES[doc]}::double as space"
        for doc, values in ISSUED.items() for v in values)
    return f"""{_cases}, n as (select doc_type, count(distinct coalesce(nullif(forged_value, ''), own_id)) as n_distinct
      from cases group by 1), r as ({size})
      select doc_type, n_distinct, issued, round(issued / space, 9) as p_single,
        round(n_distinct * issued / space, 6) as expected,
        round(1.0::double - exp(n_distinct * ln(1.0::double - issued / space)), 9) as p_at_least_one from n join r using (doc_type)"""


_people = sql.with_(sql.identity_ctes("customer", "c_custkey"))
_checks = (("format_check", "format"), ("checksum_check", "checksum"), ("category_check", "category"),
           ("semantic_check", "semantic"), ("semantic_strict", "strict"))

ORACLES = {
    "rule_flag_rate": f"""{_cases} select doc_type, forgery_category, text, n, flagged, {sql.wilson('flagged', 'n')} from (
        select doc_type, forgery_category, 'gt' as text, count(*) as n, sum(rule_gt)::bigint as flagged from cases group by 1, 2
        union all select doc_type, forgery_category, 'ocr', count(*), sum(rule_ocr)::bigint from cases group by 1, 2)""",
    "rule_check_status": _cases + " union all ".join(
        f"""select doc_type, forgery_category, '{name}' as "check", count(*) filter (where ocr_{c} = 'PASS') as pass,
        count(*) filter (where ocr_{c} = 'FAIL') as fail, count(*) filter (where ocr_{c} = 'SKIPPED') as skipped
        from cases group by 1, 2""" for name, c in _checks),
    "rule_verdict_counts": f"""{_cases} select doc_type, forgery_category, quality_tier,
        count(*) filter (where rule_ocr_verdict = 'PASS') as pass, count(*) filter (where rule_ocr_verdict = 'FAIL') as fail,
        count(*) filter (where rule_ocr_verdict = 'SKIPPED') as skipped from cases group by 1, 2, 3""",
    "verdict_flips": f"""{_cases} select doc_type, forgery_category, quality_tier,
        count(*) filter (where rule_gt_verdict = rule_ocr_verdict) as stable,
        count(*) filter (where rule_gt_verdict = 'PASS' and rule_ocr_verdict = 'FAIL') as ocr_induced,
        count(*) filter (where rule_gt_verdict = 'FAIL' and rule_ocr_verdict = 'PASS') as ocr_masked from cases group by 1, 2, 3""",
    "verdict_flips_all_tier": f"""{_cases} select forgery_category, doc_type, quality_tier, count(*) as n, {_flips} from cases group by 1, 2, 3
        union all select forgery_category, doc_type, 'all', count(*), {_flips} from cases group by 1, 2""",
    "field_extraction_quality": sql.with_(sql.cases(), sql.fields()) + f"""
        select doc_type, field, quality_tier, n, exact, mean_cer, empty_rate, {sql.wilson('exact', 'n')} from (
        select doc_type, field, quality_tier, count(*) as n, count(*) filter (where ref = hyp) as exact,
          round(avg(case when length(ref) = 0 then (length(hyp) > 0)::int::double else levenshtein(ref, hyp)::double / length(ref) end), 6) as mean_cer,
          round(avg((hyp = '')::int::double), 6) as empty_rate from fields group by 1, 2, 3)""",
    "char_confusions_top20": f"""{_cases}, p as (select print_id as a, ocr_id as b, unnest(range(1, length(print_id) + 1)) as i
        from cases where length(print_id) = length(ocr_id))
        select substr(a, i::int, 1) || '->' || substr(b, i::int, 1) as confusion, count(*) as n from p
        where substr(a, i::int, 1) <> substr(b, i::int, 1) group by 1 order by n desc, confusion limit 20""",
    "composition_grouping_sets": f"""{_cases} select doc_type, forgery_category, coalesce(quality_tier, 'ALL') as quality_tier, count(*) as n
        from cases group by grouping sets ((doc_type, forgery_category, quality_tier), (doc_type, forgery_category))""",
    "composition_totals": f"""{_cases} select count(distinct person_id) as persons, count(distinct document_id) as documents,
        count(*) as images, count(*) filter (where label = 0) as genuine, count(*) filter (where label = 1) as forged from cases""",
    "split_sizes": f"{_cases} select split, count(*) as n, count(distinct person_id) as persons from cases group by 1",
    "person_attribute_counts": _people + " union all ".join(
        f"select '{a}' as attribute, {a} as value, count(*) as n from id5 group by 2"
        for a in ("naming_stratum", "pan_fifth_source", "gender")),
    "honorific_rate": f"{_people} select round(avg((honorific <> '')::int::double), 4) as honorific_rate from id5",
    "storage_by_source": """select source, sum(strlen(text))::bigint as total_bytes, round(avg(strlen(text)) / 1024, 4) as mean_kib,
        floor(avg(length(text)::bigint * (length(text) - length(replace(text, chr(10), '')) + 1)))::bigint as mean_pixels
        from documents group by 1""",
    "fpr_by_tier_all": f"""{_cases} select doc_type, quality_tier, n, fp, fp_gt, {sql.wilson('fp', 'n')} from (
        select doc_type, coalesce(quality_tier, 'ALL') as quality_tier, count(*) as n, sum(rule_ocr)::bigint as fp, sum(rule_gt)::bigint as fp_gt
        from cases where label = 0 group by grouping sets ((doc_type, quality_tier), (doc_type)))""",
    "fpr_by_naming_stratum": f"""{_cases} select naming_stratum, n, fp, {sql.wilson('fp', 'n')} from (
        select naming_stratum, count(*) as n, sum(rule_ocr)::bigint as fp from cases where label = 0 and doc_type = 'pan' group by 1)""",
    "permissive_vs_strict": _loose_strict(),
    "coincidence": _coincidence(),
    "preflight_counts": f"""{_cases} select doc_type, forgery_category, expected_rule,
        count(*) filter (where rule_gt_verdict = 'PASS') as passed, count(*) filter (where rule_gt_verdict = 'FAIL') as failed,
        count(*) filter (where rule_gt_verdict <> expected_rule) as violations from cases group by 1, 2, 3""",
    "design_violations_top50": f"""{_cases} select image_id, doc_type, forgery_category, rule_ocr_verdict as verdict, expected_rule
        from cases where rule_ocr_verdict <> expected_rule order by image_id limit 50""",
}
