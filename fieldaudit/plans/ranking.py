"""Ranking, calibration and sampling queries over events, and labels joined to documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldaudit.operators import positions, ranking
from fieldaudit.plans import sql
from fieldaudit.sources.tables import person_splits, spread, table


def events(spark, d):
    """Detector view of the events: score ``value``, label error or not, one curve."""
    e = spread(table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), "event_id")
    return e.select("event_id", "user_id", F.lit("all").alias("system"), F.col("value").alias("score"),
                    (F.col("event_type") == "error").cast("int").alias("label"))


def graded_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    return spread(table(spark, d, "labels"), "doc_id").join(docs, "doc_id").select(
        "doc_id", "lang", F.col("lang").alias("system"), "score", F.col("quality").alias("label"))


def counts(df):
    return ranking.score_counts(df, "label", "score", ["system"])


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def with_prob(df):
    """Score squeezed into [0, 1) without a global maximum."""
    return df.withColumn("prob", F.greatest(F.lit(0.0), F.col("score")) / (F.greatest(F.lit(0.0), F.col("score")) + 10.0))


def reliability(spark, d):
    return ranking.reliability(with_prob(events(spark, d)), "label", "prob", ["system"])


def matched(spark, d):
    """Threshold that gives the score the false-positive rate of a reference rule (value >= 30)."""
    ev = events(spark, d)
    target = ev.where(F.col("label") == 0).groupBy("system").agg(F.avg((F.col("score") >= 30).cast("double")).alias("target"))
    return ranking.operating_point(counts(ev), ["system"], target.where(F.col("target") > 0.05))


def epochs(spark, d):
    """Hourly mean event value per event type, as epochs of a run."""
    e = spread(table(spark, d, "events"), "event_id")
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    return e.groupBy(F.col("event_type").alias("run"), hour.alias("epoch")).agg(F.round(F.avg("value"), 6).alias("metric"))


def rank_pair(spark, d):
    """Spearman correlation per language of two document scores: length, and id modulo 97 (which has many ties)."""
    g = graded_documents(spark, d)
    other = g.withColumn("second", F.pmod("doc_id", F.lit(97)).cast("double"))
    a = ranking.ordinal_ranks(other, "score", "doc_id", ["system"], "rank_a")
    b = ranking.ordinal_ranks(a, "second", "doc_id", ["system"], "rank_b")
    return b.groupBy("system").agg(F.round(F.corr("rank_a", "rank_b"), 6).alias("spearman"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    "auroc": lambda s, d: r6(ranking.auroc(counts(events(s, d)), ["system"]), "auroc"),
    "auroc_by_language": lambda s, d: r6(ranking.auroc(counts(graded_documents(s, d)), ["system"], strict=False), "auroc"),
    "pr_auc": lambda s, d: r6(ranking.average_precision(counts(events(s, d)), ["system"]), "pr_auc"),
    "roc_points": lambda s, d: r6(ranking.roc_points(counts(events(s, d)), ["system"]), "fpr", "tpr"),
    "roc_points_thinned": lambda s, d: r6(ranking.thin_curve(
        ranking.roc_points(counts(events(s, d)), ["system"]), ["system"]), "fpr", "tpr"),
    "operating_point": lambda s, d: r6(ranking.operating_point(counts(events(s, d)), ["system"], 0.05),
                                       "threshold", "fpr", "recall"),
    "matched_threshold": lambda s, d: r6(matched(s, d), "target", "threshold", "fpr", "recall"),
    "reliability_table": lambda s, d: r6(reliability(s, d), "confidence", "observed"),
    "calibration_error": lambda s, d: r6(ranking.calibration_error(reliability(s, d), ["system"]), "ece"),
    "balanced_accuracy": lambda s, d: r6(ranking.balanced_accuracy(
        with_prob(events(s, d)), "label", "prob", ["system"], 0.6), "balanced_accuracy"),
    "ordinal_rank_correlation": rank_pair,
    "split_assignment": lambda s, d: person_splits(s, d).select("person_id", "position", "split"),
    "balanced_sample": lambda s, d: positions.balanced_sample(
        spread(table(s, d, "labels"), "doc_id"), "doc_id", "quality").select("doc_id", "quality", "position"),
    "epoch_sample": lambda s, d: positions.epoch_sample(
        spread(table(s, d, "labels"), "doc_id").select("doc_id", F.col("toxic").alias("label")), "doc_id", "label", 2, 3),
    "early_stop": lambda s, d: positions.epoch_plan(epochs(s, d), "metric", 4),
    "first_seen_dedup": lambda s, d: positions.first_seen(
        spread(table(s, d, "documents"), "doc_id").select(F.sha2("text", 256).alias("digest"), "doc_id", "source"),
        "digest", F.col("doc_id")),
}

_ev = "ev as (select event_id, user_id, value as score, (event_type = 'error')::int as label from events)"
_sc = _ev + """, sc as (select score, sum(label)::bigint as pos, count(*) - sum(label)::bigint as neg from ev group by 1),
 tot as (select sum(pos)::bigint as n_pos, sum(neg)::bigint as n_neg from sc),
 cum as (select *, sum(pos) over (order by score desc)::bigint as tp, sum(neg) over (order by score desc)::bigint as fp from sc, tot)"""
_prob = _ev + ", pr as (select label, greatest(0.0::double, score) / (greatest(0.0::double, score) + 10.0::double) as prob from ev)"
_rel = _prob + """, bn as (select label, prob, (select count(*) from range(1, 10) t(i) where prob >= i * (1.0::double / 10)) as bin from pr),
 rel as (select i::int as bin, coalesce(n, 0) as n, confidence, observed from range(0, 10) t(i) left join
   (select bin, count(*) as n, avg(prob) as confidence, avg(label) as observed from bn group by 1) q on q.bin = t.i)"""
_roc = """roc as (select score, 100.0::double * fp / n_neg as fpr, 100.0::double * tp / n_pos as tpr from cum union all select null, 0, 0)"""
_graded = "gd as (select doc_id, lang as system, n_chars::double as score, quality as label from labels join documents using (doc_id))"


def _point(target):
    return f"""k as (select floor({target} * n_neg)::bigint as k from tot),
 th as (select max(score) filter (where fp > k) as s0, min(score) filter (where fp <= k) as up,
   min(score) filter (where neg > 0) as lowest, max((k >= n_neg)::int) as everything from cum, k),
 t as (select case when everything = 1 then lowest else coalesce((s0 + up) / 2, s0 + abs(s0) * 2.220446049250313e-16) end as threshold from th)
 select 'all' as system, round({target}, 6) as target, round(threshold, 6) as threshold,
   round((select sum(neg) from sc where score >= threshold)::double / n_neg, 6) as fpr,
   round((select sum(pos) from sc where score >= threshold)::double / n_pos, 6) as recall, n_pos, n_neg from t, tot"""


ORACLES = {
    "auroc": f"""with {_ev}, r as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as rk from ev),
      n as (select sum(label)::bigint as n_pos, count(*) - sum(label)::bigint as n_neg from ev)
      select 'all' as system, n_pos, n_neg, round(((select sum(rk) from r where label = 1) - n_pos * (n_pos + 1) / 2.0::double) / (n_pos::double * n_neg), 6) as auroc from n""",
    "auroc_by_language": f"""with {_graded}, p as (select a.system, avg(case when a.score > b.score then 1.0::double when a.score = b.score then 0.5::double else 0.0::double end) as auroc
      from gd a join gd b on a.system = b.system and a.label = 1 and b.label = 0 group by 1)
      select system, sum(label)::bigint as n_pos, count(*) - sum(label)::bigint as n_neg, round(any_value(auroc), 6) as auroc from gd left join p using (system) group by 1""",
    "pr_auc": f"with {_sc} select 'all' as system, round(sum(pos::double / n_pos * tp / (tp + fp)), 6) as pr_auc from cum",
    "roc_points": f"with {_sc}, {_roc} select 'all' as system, score, round(fpr, 6) as fpr, round(tpr, 6) as tpr from roc",
    "roc_points_thinned": f"""with {_sc}, {_roc}, c as (select min((fpr, tpr)) as v from roc group by floor(fpr / 0.5::double), floor(tpr / 0.5::double)
      union select min((fpr, tpr)) from roc union select max((fpr, tpr)) from roc)
      select 'all' as system, round(v[1], 6) as fpr, round(v[2], 6) as tpr from c""",
    "operating_point": f"with {_sc}, {_point('0.05::double')}",
    "matched_threshold": f"with {_sc}, {_point('(select avg((score >= 30)::int::double) from ev where label = 0)')}",
    "reliability_table": f"with {_rel} select 'all' as system, bin, n, round(confidence, 6) as confidence, round(observed, 6) as observed from rel",
    "calibration_error": f"with {_rel} select 'all' as system, round(sum(n * abs(confidence - observed)) / sum(n), 6) as ece from rel where n > 0",
    "balanced_accuracy": f"with {_prob} select 'all' as system, round((avg((prob > 0.6)::int) filter (where label = 1) + avg((prob <= 0.6)::int) filter (where label = 0)) / 2, 6) as balanced_accuracy from pr",
    "ordinal_rank_correlation": f"""with {_graded}, h as (select *, md5(concat_ws('|', '42', doc_id::varchar, 'tie')) as h from gd),
      r as (select system, row_number() over (partition by system order by score, h, doc_id) as ra,
        row_number() over (partition by system order by doc_id % 97, h, doc_id) as rb from h)
      select system, round(corr(ra, rb), 6) as spearman, count(*) as n from r group by 1""",
    "split_assignment": sql.with_(sql.splits()) + "select person_id, position, split from splits",
    "balanced_sample": """with q as (select min(n) as quota from (select count(*) as n from labels group by quality)),
      r as (select doc_id, quality, row_number() over (partition by quality order by md5(concat_ws('|', '42', doc_id::varchar, 'balance')), doc_id) - 1 as position from labels)
      select doc_id, quality, position from r, q where position < quota""",
    "epoch_sample": """with e as (select e::int as epoch from range(1, 4) t(e)),
      r as (select epoch, doc_id, toxic as label, row_number() over (partition by epoch order by md5(concat_ws('|', '42', epoch::varchar || ':' || doc_id::varchar, 'epoch')), epoch::varchar || ':' || doc_id::varchar) - 1 as p
        from labels, e where toxic = 0)
      select epoch, doc_id, toxic as label from labels, e where toxic = 1
      union all select epoch, doc_id, label from r where p < 2 * (select count(*) from labels where toxic = 1)""",
    "early_stop": """with recursive ep as (select event_type as run, floor(epoch(ts) / 3600)::bigint as epoch, round(avg(value), 6) as metric from events group by 1, 2),
      g as (select *, coalesce(metric > max(metric) over (partition by run order by epoch rows between unbounded preceding and 1 preceding), true) as gain from ep),
      l as (select *, max(case when gain then epoch end) over (partition by run order by epoch) as last from g),
      s as (select run, coalesce(min(case when epoch - last >= 4 then epoch end), max(epoch)) as stop from l group by 1)
      select run, max(case when gain then epoch end) as best_epoch, max(epoch) as stop_epoch, max(metric) as best_value
      from l join s using (run) where epoch <= stop group by 1""",
    "first_seen_dedup": """select digest, doc_id, source from (select sha256(text) as digest, doc_id, source,
      row_number() over (partition by text order by doc_id) as rn from documents) where rn = 1""",
}
