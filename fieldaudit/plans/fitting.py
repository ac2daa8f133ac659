"""Calibration and fusion queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldaudit.functions.fields import CHECKS
from fieldaudit.functions.measures import logit
from fieldaudit.operators import evaluate as ev
from fieldaudit.operators import boosting, positions, ranking
from fieldaudit.operators import fitting as op
from fieldaudit.operators.masks import in_split
from fieldaudit.operators.similarity import with_extremes
from fieldaudit.plans import sql
from fieldaudit.plans.evaluate import summary_select
from fieldaudit.plans.ranking import events
from fieldaudit.sources.tables import cases, spread, table

LOG_TS = [-4 + i * 0.5 for i in range(17)]
FEATURES = ("z", "r", "r_pan")
# Frozen parameters of the fixed-score query: intercept, then weights of z, r and r on PAN cards.
FROZEN = (0.4, [0.9, 2.5, -0.7], "val")


def fusion_frame(spark, d, text="ocr"):
    c = cases(spark, d)
    return c.withColumns(op.fusion_features(F.col("score"), F.col(f"rule_{text}"), F.col("doc_type") == "pan"))


def event_logits(spark, d):
    return events(spark, d).select((F.col("score") / 10 - 1).alias("z"), "label")


def case_logits(spark, d):
    """Detector logits of genuine and C1 cases on validation."""
    c = cases(spark, d).where(in_split("val", ("C0", "C1")))
    return c.select(logit(F.col("score")).alias("z"), "label")


def temperature_fit(spark, d):
    frame = case_logits(spark, d)
    t = op.fit_temperature(frame, "z", "label")
    grid = op.loss_grid(frame, "z", "label", [0.0, math.log(t)])
    at = lambda i, c: F.max(F.when(F.col("i") == i, c))
    return grid.agg(F.round(at(1, F.exp("log_t")), 4).alias("temperature"), F.round(at(0, F.col("nll")), 6).alias("nll_before"),
                    F.round(at(1, F.col("nll")), 6).alias("nll_after"))


def frozen_scores(spark, d):
    p = spark.createDataFrame([FROZEN], "intercept double, coef array<double>, fit_split string")
    df = fusion_frame(spark, d).where(F.col("split") == "test")
    out = op.frozen_score(df, p, FEATURES)
    return out.select("image_id", F.round("fused", 6).alias("fused"), (F.col("fused") >= 0.9).cast("int").alias("decision"))


def fused_summary(fit_frame, features):
    """Fit and threshold on validation, applied once to test: the system summary row."""
    val, test = (fit_frame.where(F.col("split") == s) for s in ("val", "test"))
    fitted = op.fit_logistic(val, features, "label")
    scored = op.score_with(val, fitted).withColumn("system", F.lit("fused"))
    point = ranking.operating_point(ranking.score_counts(scored, "label", "fused", ["system"]), ["system"], 0.05)
    t = point.select("threshold").scalar()
    flagged = op.score_with(test, fitted).withColumn("flag", (F.col("fused") >= t).cast("int"))
    return ev.system_summary(flagged, {"fused": "flag"})


def logistic_fusion(spark, d):
    return fused_summary(fusion_frame(spark, d), FEATURES)


def per_check_fusion(spark, d):
    df = fusion_frame(spark, d)
    checks = ev.check_indicators(df, "ocr")
    return fused_summary(df.withColumns(checks), ["z", *checks])


def fitted_coefficients(spark, d):
    fitted = op.fit_logistic(fusion_frame(spark, d).where(F.col("split") == "val"), FEATURES, "label")
    rows = [("intercept", fitted["intercept"])] + list(zip(FEATURES, fitted["coef"]))
    return spark.createDataFrame(rows, "name string, value double").withColumn("value", F.round("value", 4))


FIT_ROWS = 2200  # rows a class that the probe is fitted on


def probe_scores(spark, d):
    """(vec_id, label, prob): one embedding class half against the other, fitted on balanced even rows (FIT_ROWS a class), for all odd ones."""
    v = spread(table(spark, d, "embeddings"), "vec_id").select(
        "vec_id", (F.col("label") >= 5).cast("int").alias("label"), "embedding")
    v = with_extremes(v, "embedding", "f").drop("embedding")
    train = positions.balanced_sample(v.where("vec_id % 2 = 0"), "vec_id", "label", FIT_ROWS)
    test = v.where("vec_id % 2 = 1")
    return boosting.scored(test, boosting.fit(train, "f", "label"), "f").drop("f")


def tree_probe(spark, d):
    """STA15. Ranking quality and balanced accuracy of the probe: 220 rounds of trees with up to 31 leaves."""
    out = probe_scores(spark, d).withColumn("system", F.lit("probe"))
    auc = ranking.auroc(ranking.score_counts(out, "label", "prob", ["system"]), ["system"], strict=False)
    acc = ranking.balanced_accuracy(out, "label", "prob", ["system"])
    return auc.join(acc, "system")


QUERIES = {
    "temperature_grid": lambda s, d: op.loss_grid(event_logits(s, d), "z", "label", LOG_TS).select(
        "i", "log_t", F.round("nll", 6).alias("nll")),
    "temperature_fit": temperature_fit,
    "frozen_logistic_score": frozen_scores,
    "logistic_fit": fitted_coefficients, "logistic_fusion": logistic_fusion, "per_check_fusion": per_check_fusion,
    "tree_probe": tree_probe,
}

_z = "ez as (select value / 10 - 1 as z, (event_type = 'error')::int as y from events)"
_p = "greatest(1e-12::double, least(1.0::double - 1e-12::double, 1.0::double / (1.0::double + exp(-z / exp(log_t)))))"



def grid_sql(steps=8, points=17):
    """The nested search of the temperature: every CTE is one pass over the counts with a grid around the best point so far."""
    out = [f"l0 as (select {op.LOG_T_RANGE[0]}::double as low, {op.LOG_T_RANGE[1]}::double as high)"]
    p = "greatest(1e-12::double, least(1.0::double - 1e-12::double, 1.0::double / (1.0::double + exp(-z / exp(t)))))"
    for k in range(steps):
        out.append(f"""g{k} as materialized (select i, t, low, (high - low) / {points - 1}.0::double as step, sum(-n * (y * ln({p}) + (1 - y) * ln(1.0::double - {p}))) as nll
      from zc, (select *, low + i * (high - low) / {points - 1}.0::double as t from l{k}, range(0, {points}) r(i)) group by 1, 2, 3, 4),
      b{k} as (select * from g{k} order by nll, i limit 1),
      l{k + 1} as (select low + greatest(i - 1, 0) * step as low, low + least(i + 1, {points - 1}) * step as high from b{k})""")
    return ",\n ".join(out)


def newton_sql(rows, features, steps=14):
    """CTEs of a logistic fit by Newton steps: sums of every step, elimination of the matrix column by column, back substitution.

    ``rows`` has the features and y; the last CTE is ``s{steps}`` with one row b0 (intercept), b1, ...
    """
    k = len(features) + 1
    x = ["1.0::double", *features]
    line = " + ".join(f"b{i} * {v}" for i, v in enumerate(x))
    out = [f"nx as materialized (select {', '.join(features)}, y, count(*) as n from {rows} group by all)",
           "s0 as (select " + ", ".join(f"0.0::double as b{i}" for i in range(k)) + ")"]
    betas = ", ".join(f"b{i}" for i in range(k))
    for step in range(steps):
        cells = [f"sum(n * p * (1 - p) * {x[i]} * {x[j]}){' + 1.0::double' if i == j and i else ''} as h{i}_{j}" for i in range(k) for j in range(i, k)]
        cells += [f"sum(n * (p - y) * {x[i]}){f' + any_value(b{i})' if i else ''} as h{i}_{k}" for i in range(k)]
        out.append(f"m{step}_0 as materialized (select {betas}, {', '.join(cells)} from (select nx.*, {betas}, 1.0::double / (1.0::double + exp(-({line}))) as p from nx, s{step}) group by {betas})")
        for c in range(k - 1):
            low = [f"h{i}_{j} - h{c}_{i} / h{c}_{c} * h{c}_{j} as h{i}_{j}" for i in range(c + 1, k) for j in range(i, k + 1)]
            kept = [f"h{i}_{j}" for i in range(c + 1) for j in range(i, k + 1)]
            out.append(f"m{step}_{c + 1} as materialized (select {betas}, {', '.join(kept + low)} from m{step}_{c})")
        last = f"m{step}_{k - 1}"
        for i in range(k - 1, -1, -1):
            done = "".join(f" - h{i}_{j} * d{j}" for j in range(i + 1, k))
            out.append(f"d{step}_{i} as materialized (select *, (h{i}_{k}{done}) / h{i}_{i} as d{i} from {last})")
            last = f"d{step}_{i}"
        out.append(f"s{step + 1} as materialized (select {', '.join(f'b{i} - d{i} as b{i}' for i in range(k))} from {last})")
    return ",\n ".join(out), f"s{steps}"


def fused_sql(features, steps=14):
    """Fit and threshold on validation, then the summary row of the test rows."""
    fit, beta = newton_sql("fv", features, steps)
    line = " + ".join(["b0", *[f"b{i} * {v}" for i, v in enumerate(features, 1)]])
    return f"""{_c}, {_fusion}, fv as (select * from fu where split = 'val'), {fit},
      sc0 as materialized (select fu.*, 1.0::double / (1.0::double + exp(-({line}))) as fused from fu, {beta}),
      vc as (select fused, sum(y) as pos, sum(1 - y) as neg from sc0 where split = 'val' group by 1),
      vt as (select *, sum(neg) over (order by fused desc) as fp, sum(neg) over () as nn from vc),
      th as (select case when any_value(nn) <= floor(0.05::double * any_value(nn)) then min(fused) filter (where neg > 0)
        else (max(fused) filter (where fp > floor(0.05::double * nn)) + min(fused) filter (where fp <= floor(0.05::double * nn))) / 2 end as t from vt),
      sys as (select sc0.*, 'fused' as system, (fused >= t)::int as flag from sc0, th) {summary_select("split = 'test'")}"""


_c = sql.with_(sql.cases())
_score = "greatest(1e-6::double, least(1.0::double - 1e-6::double, score))"
_checks = [f"{d}_{c}" for d, checks in CHECKS.items() for c in checks]
_fusion = f"""fu as materialized (select *, label as y, ln({_score} / (1.0::double - {_score})) as z, rule_ocr::double as r, rule_ocr * (doc_type = 'pan')::int::double as r_pan, """ + ", ".join(
    f"(doc_type = '{d}' and rule_ocr = 1 and ocr_failed = '{c}')::int::double as {d}_{c}" for d, checks in CHECKS.items() for c in checks) + " from cases)"
_newton, _last = newton_sql("fv", FEATURES)

ORACLES = {
    "temperature_fit": f"""{_c}, {_fusion}, zc as materialized (select z, y, count(*) as n from fu where split = 'val' and forgery_category in ('C0', 'C1') group by all), {grid_sql()},
      e as (select (low + high) / 2 as t from l8 union all select 0.0::double)
      select round(exp(max(t) filter (where k)), 4) as temperature, round(max(nll) filter (where not k), 6) as nll_before, round(max(nll) filter (where k), 6) as nll_after
      from (select t, t <> 0 as k, sum(-n * (y * ln({{p}}) + (1 - y) * ln(1.0::double - {{p}}))) / sum(n) as nll from zc, e group by 1, 2)""".replace(
          "{p}", "greatest(1e-12::double, least(1.0::double - 1e-12::double, 1.0::double / (1.0::double + exp(-z / exp(t)))))"),
    "logistic_fit": f"""{_c}, {_fusion}, fv as (select * from fu where split = 'val'), {_newton}
      select name, round(value, 4) as value from (""" + " union all ".join(
          f"select '{n}' as name, b{i} as value from {_last}" for i, n in enumerate(("intercept", *FEATURES))) + ")",
    "logistic_fusion": fused_sql(FEATURES),
    "per_check_fusion": fused_sql(["z", *_checks]),
    "temperature_grid": f"""with {_z}, g as (select i::int as i, -4 + i * 0.5::double as log_t from range(0, 17) t(i))
      select i, log_t, round(avg(-(y * ln({_p}) + (1 - y) * ln(1.0::double - {_p}))), 6) as nll from ez, g group by 1, 2""",
    "frozen_logistic_score": sql.with_(sql.cases()) + """, q as (select image_id, rule_ocr as r, rule_ocr * (doc_type = 'pan')::int as rp,
        greatest(1e-6::double, least(1.0::double - 1e-6::double, score)) as p from cases where split = 'test'),
      f as (select image_id, 1.0::double / (1.0::double + exp(-(0.4::double + 0.9::double * ln(p / (1 - p)) + 2.5::double * r - 0.7::double * rp))) as fused from q)
      select image_id, round(fused, 6) as fused, (fused >= 0.9::double)::int as decision from f""",
}
