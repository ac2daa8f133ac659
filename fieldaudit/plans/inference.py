"""Bootstrap and multiple-testing queries over events (clusters: users) and cases (clusters: persons)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldaudit.operators import inference as op
from fieldaudit.operators.evaluate import SYSTEM_COLUMNS, combined_systems
from fieldaudit.operators.masks import CELL, case_filters, case_masks
from fieldaudit.plans import sql
from fieldaudit.plans.evaluate import _combined, systems_cte
from fieldaudit.plans.ranking import _ev, events
from fieldaudit.sources.tables import case_columns

#: Replicates: of the evaluator's intervals, of ranking measures, of the published comparisons.
B_EVENTS, B_AUROC, B_CASES = 2_000, 2_000, 10_000


def _filter_sql(filters):
    return " and ".join("forgery_category <> 'C0'" if d == "forged" else f"{d} in ({', '.join(repr(v) for v in allowed)})" for d, allowed in filters.items())


FAMILIES = {
    "fusion": {
        "recall: or_gt - visual": [(1, "or_gt", "forged"), (-1, "visual", "forged")],
        "recall: or_ocr - visual": [(1, "or_ocr", "forged"), (-1, "visual", "forged")],
        "recall: or_ocr - rules_ocr": [(1, "or_ocr", "forged"), (-1, "rules_ocr", "forged")],
        "recall: or_gt - or_ocr": [(1, "or_gt", "forged"), (-1, "or_ocr", "forged")],
        "coverage: rules_gt - rules_ocr": [(1, "rules_gt", "eligible"), (-1, "rules_ocr", "eligible")],
        "fpr: rules_ocr - rules_gt": [(1, "rules_ocr", "c0"), (-1, "rules_gt", "c0")],
    },
    "trace": {
        "c1 fine recall: or_ocr - visual": [(1, "or_ocr", "c1_fine"), (-1, "visual", "c1_fine")],
        "c1 coarse recall: or_ocr - visual": [(1, "or_ocr", "c1_coarse"), (-1, "visual", "c1_coarse")],
    },
    "document": {
        "gain(aadhaar) - gain(pan), gt": [(1, "or_gt", "forged/aadhaar"), (-1, "visual", "forged/aadhaar"),
                                          (-1, "or_gt", "forged/pan"), (1, "visual", "forged/pan")],
        "gain(aadhaar) - gain(pan), ocr": [(1, "or_ocr", "forged/aadhaar"), (-1, "visual", "forged/aadhaar"),
                                           (-1, "or_ocr", "forged/pan"), (1, "visual", "forged/pan")],
        "fpr rules_ocr: pan - aadhaar": [(1, "rules_ocr", "c0/pan"), (-1, "rules_ocr", "c0/aadhaar")],
    },
    "tier": {"fpr rules_ocr: severe - clean": [(1, "rules_ocr", "c0/severe"), (-1, "rules_ocr", "c0/clean")]},
}
DELTAS = {"delta": {
    f"Delta_{t}/{m}": [(1, f"or_{t}", m), (-1, "visual", m)]
    for t in ("gt", "ocr") for m in ("forged", "forged/aadhaar", "forged/pan")}}


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def case_counts(spark, d, families=None):
    """Counts of the systems and subsets that the comparisons name, or of all."""
    systems, masks = SYSTEM_COLUMNS, case_masks()
    if families is not None:
        terms = [t for comps in families.values() for terms in comps.values() for t in terms]
        systems = {s: c for s, c in systems.items() if s in {t[1] for t in terms}}
        masks = {m: p for m, p in masks.items() if m in {t[2] for t in terms}}
    rows = combined_systems(case_columns(spark, d, ("person_id", *CELL, "rule_gt", "rule_ocr", "visual")))
    return op.rate_counts(rows, "person_id", systems, masks), list(systems)


def bootstrap_ci(spark, d):
    ev = events(spark, d).withColumn("flag", (F.col("score") >= 30).cast("int"))
    return r6(op.bootstrap(ev, "user_id", "label", "flag", B_EVENTS), "value", "lo", "hi")


def bootstrap_rates(spark, d):
    counts, systems = case_counts(spark, d)
    out = op.with_intervals(op.rates(counts, systems), op.rate_replicates(counts, B_CASES, "person_id", systems), ["mask", "system"])
    return r6(out.drop("p"), "value", "lo", "hi")


def holm_families(spark, d):
    spec = op.comparison_spec(spark, FAMILIES)
    counts, systems = case_counts(spark, d, FAMILIES)
    return r6(op.tested_families(counts, B_CASES, "person_id", systems, spec),
              "value", "lo", "hi", "p", "p_holm")


def delta_rho(spark, d):
    counts, systems = case_counts(spark, d, DELTAS)
    spec = op.comparison_spec(spark, DELTAS)
    point = op.comparisons(op.rates(counts, systems), spec)
    reps = op.comparisons(op.rate_replicates(counts, B_CASES, "person_id", systems), spec, ["b"])
    pairs = spark.createDataFrame(
        [(f"rho/{m}", f"Delta_ocr/{m}", f"Delta_gt/{m}") for m in ("forged", "forged/aadhaar", "forged/pan")],
        "ratio string, top string, bottom string")
    deltas = op.with_intervals(point, reps, ["comparison"]).select(
        F.col("comparison").alias("quantity"), "value", "lo", "hi")
    rho = op.ratios(point, reps, pairs).select(F.col("ratio").alias("quantity"), "value", "lo", "hi")
    return r6(deltas.unionByName(rho), "value", "lo", "hi")


def paired(spark, d):
    """STA2 and STA18: recall and FPR difference of two systems on the same replicates, as one decision row."""
    families = {"paired": {
        "recall": [(1, "or_ocr", "forged"), (-1, "visual", "forged")], "fpr": [(1, "or_ocr", "c0"), (-1, "visual", "c0")]}}
    counts, systems = case_counts(spark, d, families)
    out = op.tested_families(counts, B_CASES, "person_id", systems, op.comparison_spec(spark, families))
    pick = lambda c, col, name: F.max(F.when(F.col("comparison") == c, F.col(col))).alias(name)
    row = out.groupBy("family").agg(
        pick("recall", "value", "recall_diff"), pick("recall", "lo", "recall_lo"), pick("recall", "hi", "recall_hi"),
        pick("fpr", "value", "fpr_diff"), pick("fpr", "lo", "fpr_lo"), pick("fpr", "hi", "fpr_hi"),
        pick("recall", "p", "p_two_sided"))
    return r6(op.decision_rule(row), "recall_diff", "recall_lo", "recall_hi", "fpr_diff", "fpr_lo", "fpr_hi", "p_two_sided")


def bootstrap_auroc(spark, d):
    ev = events(spark, d)
    reps = op.auroc_replicates(ev, B_AUROC, "user_id", "label", "score", ["system"])
    return r6(op.intervals(reps, ["system"]).drop("p"), "lo", "hi")


def bootstrap_auroc_difference(spark, d):
    """STA9. AUROC of two scores on the same replicates, and their difference."""
    ev = events(spark, d)
    two = ev.select("user_id", "label", F.explode(F.array(
        F.struct(F.lit("value").alias("system"), F.col("score").alias("score")),
        F.struct(F.lit("coarse").alias("system"), F.floor(F.col("score") / 10).cast("double").alias("score")))).alias("x")
    ).select("user_id", "label", "x.*")
    reps = op.auroc_replicates(two, B_AUROC, "user_id", "label", "score", ["system"])
    diff = reps.groupBy("b").agg(F.sum(F.when(F.col("system") == "value", F.col("value")).otherwise(-F.col("value"))).alias("value"))
    return r6(op.intervals(diff.withColumn("quantity", F.lit("value - coarse")), ["quantity"]), "lo", "hi", "p")


QUERIES = {
    "bootstrap_ci": bootstrap_ci, "bootstrap_rates": bootstrap_rates, "holm_families": holm_families,
    "delta_rho": delta_rho, "paired_bootstrap": paired, "bootstrap_auroc": bootstrap_auroc,
    "bootstrap_auroc_difference": bootstrap_auroc_difference,
}


def weights_sql(relation, cluster, b):
    """Every (replicate, cluster) weight: four digits of a digest, counted against the borders of a Poisson(1)."""
    steps = " ".join(f"when u < '{border}' then {k}" for k, border in enumerate(op.POISSON_BORDERS))
    return f"""w as materialized (select b, {cluster}, w from (select b, {cluster}, case {steps} else {len(op.POISSON_BORDERS)} end as w
   from (select block * {op.LANES} + lane as b, {cluster}, substr(digest, (4 * lane + 1)::int, 4) as u
     from (select {cluster}, block, md5(concat_ws('|', '42', block::varchar, {cluster}::varchar, 'boot')) as digest
       from (select distinct {cluster} from {relation}), range(0, {(b - 1) // op.LANES + 1}) tb(block)), range(0, {op.LANES}) tl(lane))) where w > 0 and b < {b})"""


MASK_SQL = {name: _filter_sql(filters) for name, filters in case_filters().items()}
_q = "round(quantile_cont(value, 0.025), 6) as lo, round(quantile_cont(value, 0.975), 6) as hi"
_systems = list(SYSTEM_COLUMNS)
_counts = ", ".join([
    sql.cases().strip(), _combined, systems_cte(SYSTEM_COLUMNS),
    "pc as materialized (" + " union all ".join(
        f"select person_id, '{m}' as mask, system, sum(flag) as num, count(*) as den from sys where {p} group by 1, 3"
        for m, p in MASK_SQL.items()) + ")",
    weights_sql("cases", "person_id", B_CASES),
    "pt as (select mask, system, sum(num)::double / sum(den) as value from pc group by 1, 2)",
    "wide as materialized (select person_id, mask, any_value(den)::int as den, "
    + ", ".join(f"sum(case when system = '{s}' then num else 0 end)::int as k_{s}" for s in _systems) + " from pc group by 1, 2)",
    "rw as materialized (select mask, b, sum(den * w) as den, " + ", ".join(f"sum(k_{s} * w) as k_{s}" for s in _systems)
    + " from wide join w using (person_id) group by 1, 2)",
    "rp as materialized (" + " union all ".join(f"select mask, '{s}' as system, b, k_{s}::double / nullif(den, 0) as value from rw" for s in _systems) + ")",
])


def spec_sql(families):
    rows = ", ".join(f"('{f}', '{c}', '{mask}', '{s}', {sign}, {len(terms)})" for f, comps in families.items()
                     for c, terms in comps.items() for sign, s, mask in terms)
    return f"""spec(family, comparison, mask, system, sign, terms) as (values {rows}),
 cp as (select family, comparison, sum(sign * value) as value from pt join spec using (mask, system) group by 1, 2),
 cr as (select family, comparison, b, case when count(value) = any_value(terms) then sum(sign * value) end as value
   from rp join spec using (mask, system) group by 1, 2, 3),
 ci as (select family, comparison, quantile_cont(value, 0.025) as lo, quantile_cont(value, 0.975) as hi, count(value) as n_resamples,
   least(1.0::double, 2 * least(avg((value <= 0)::int::double), avg((value >= 0)::int::double))) as p from cr group by 1, 2)"""


_auc_w = _ev + ", " + weights_sql("ev", "user_id", B_AUROC)


def _auc(score):
    return f"""(select b, (sum(case when label = 1 then w * (below + tied / 2.0::double) else 0 end)) / (sum(w * label)::double * sum(w * (1 - label))) as value from (
      select b, label, w, coalesce(sum(w * (1 - label)) over (partition by b order by {score} range between unbounded preceding and current row), 0)
        - sum(w * (1 - label)) over (partition by b, {score}) as below, sum(w * (1 - label)) over (partition by b, {score}) as tied
      from ev join w using (user_id)) group by b)"""


ORACLES = {
    "bootstrap_ci": f"""with {_ev}, {weights_sql('ev', 'user_id', B_EVENTS)},
      c as (select user_id, label, (score >= 30)::int as f from ev),
      u as (select user_id, 'recall' as metric, sum(label * f) as num, sum(label) as den from c group by 1
        union all select user_id, 'fpr', sum((1 - label) * f), sum(1 - label) from c group by 1
        union all select user_id, 'precision', sum(label * f), sum(f) from c group by 1),
      r as (select metric, b, sum(num * w)::double / nullif(sum(den * w), 0) as value from u join w using (user_id) group by 1, 2),
      i as (select metric, {_q}, count(value) as n_resamples from r group by 1)
      select metric, round(sum(num)::double / sum(den), 6) as value, any_value(lo) as lo, any_value(hi) as hi, any_value(n_resamples) as n_resamples
      from u join i using (metric) group by 1""",
    "bootstrap_rates": f"""with {_counts}, i as (select mask, system, {_q}, count(value) as n_resamples from rp group by 1, 2)
      select mask, system, round(value, 6) as value, lo, hi, n_resamples from pt join i using (mask, system)""",
    "holm_families": f"""with {_counts}, {spec_sql(FAMILIES)}, h as (select *, count(*) over (partition by family) as m,
        row_number() over (partition by family order by p, comparison) as rk from cp join ci using (family, comparison))
      select family, comparison, round(value, 6) as value, round(lo, 6) as lo, round(hi, 6) as hi, round(p, 6) as p, n_resamples,
        round(max(least(1.0::double, (m - rk + 1) * p)) over (partition by family order by rk), 6) as p_holm from h""",
    "delta_rho": f"""with {_counts}, {spec_sql(DELTAS)},
      rho as (select 'rho/' || substr(a.comparison, 11) as quantity, a.b, a.value / nullif(c.value, 0) as value from cr a join cr c
        on a.b = c.b and a.comparison like 'Delta_ocr/%' and c.comparison = 'Delta_gt/' || substr(a.comparison, 11)),
      rp0 as (select 'rho/' || substr(a.comparison, 11) as quantity, a.value / c.value as value from cp a join cp c
        on a.comparison like 'Delta_ocr/%' and c.comparison = 'Delta_gt/' || substr(a.comparison, 11))
      select comparison as quantity, round(value, 6) as value, round(lo, 6) as lo, round(hi, 6) as hi from cp join ci using (family, comparison)
      union all select quantity, round(rp0.value, 6), lo, hi from rp0 join (select quantity, {_q} from rho group by 1) using (quantity)""",
    "paired_bootstrap": f"""with {_counts}, {spec_sql({"paired": {"recall": [(1, "or_ocr", "forged"), (-1, "visual", "forged")], "fpr": [(1, "or_ocr", "c0"), (-1, "visual", "c0")]}})},
      f as (select * from cp join ci using (family, comparison))
      select r.family, round(r.value, 6) as recall_diff, round(r.lo, 6) as recall_lo, round(r.hi, 6) as recall_hi,
        round(q.value, 6) as fpr_diff, round(q.lo, 6) as fpr_lo, round(q.hi, 6) as fpr_hi, round(r.p, 6) as p_two_sided,
        r.lo > 0 as gain_proven, q.value <= 0.02 as like_for_like from f r join f q on r.comparison = 'recall' and q.comparison = 'fpr'""",
    "bootstrap_auroc": f"with {_auc_w} select 'all' as system, {_q}, count(value) as n_resamples from {_auc('score')}",
    "bootstrap_auroc_difference": f"""with {_auc_w}, d as (select a.value - c.value as value from {_auc('score')} a join {_auc('floor(score / 10)')} c using (b))
      select 'value - coarse' as quantity, {_q}, round(least(1.0::double, 2 * least(avg((value <= 0)::int::double), avg((value >= 0)::int::double))), 6) as p,
        count(value) as n_resamples from d""",
}
