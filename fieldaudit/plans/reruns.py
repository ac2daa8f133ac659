"""Re-run queries: two runs over the events, their settings, scores, metrics, regions and epochs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldaudit.operators import audits, ranking, reconcile
from fieldaudit.operators import reruns as op
from fieldaudit.plans.audits import _regions, _seeds, regions, seeds
from fieldaudit.plans.ranking import epochs
from fieldaudit.sources.store import cut
from fieldaudit.sources.tables import spread, table

IGNORED = ("$.commit", "$.env")


def settings(spark, d, run):
    """A run's settings, from the events it has seen: the repetition missed one event in 101 and lists its classes the other way round."""
    e = spread(table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_id")
    if run == "again":
        e = e.where("event_id % 101 <> 7")
    per = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("user_id").alias("user"))
    pairs = F.array_sort(F.collect_list(F.struct("event_type", F.struct("n", F.array("first", "user").alias("span")).alias("s"))))
    names = F.array_sort(F.collect_list("event_type"))
    return per.agg(F.map_from_entries(pairs).alias("classes"), names.alias("names"), F.sum("n").alias("rows")).select(F.to_json(F.struct(
        F.lit(0).alias("seed"), F.md5(F.lit(run)).alias("commit"), F.struct(F.lit(run).alias("run"), F.struct(F.lit(8).alias("slots")).alias("host")).alias("env"),
        F.struct("rows", F.lit("events.parquet").alias("file.name")).alias("data"), "classes",
        (F.reverse("names") if run == "again" else F.col("names")).alias("order"), F.struct().alias("extra"))).alias("settings"))


def differences(spark, d):
    return op.settings_differences(settings(spark, d, "first"), settings(spark, d, "again"), "settings", IGNORED)


def run_scores(spark, d):
    """(event_id, seed, logit, label): the five seeds, and the repetition of the first (seed -1) with scores rounded to three digits."""
    s = seeds(spark, d)
    label = table(spark, d, "events").select("event_id", (F.col("event_type") == "error").cast("int").alias("label"))
    again = s.where("seed = 0").select("event_id", F.lit(-1).alias("seed"), F.round("logit", 3).alias("logit"))
    return s.unionByName(again).join(label, "event_id")


def metrics(scores):
    """(seed, metric, value) for both ranking measures. The curves are counted once for both, and the few values stored once for all that compare them."""
    counts = cut(ranking.score_counts(scores, "label", "logit", ["seed"]))
    both = ranking.auroc(counts, ["seed"]).select("seed", F.lit("AUROC").alias("metric"), F.col("auroc").alias("value"))
    return cut(both.unionByName(ranking.average_precision(counts, ["seed"]).select("seed", F.lit("PR-AUC").alias("metric"), F.col("pr_auc").alias("value"))))


def region_digests(spark, d):
    """Digest of all edit regions for each run; the repetition was given one region in 1,009 anew."""
    r = regions(spark, d)
    box = lambda x0: F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (x0, F.col("y0"), F.col("x1"), F.col("y1"))]), 256)
    moved = F.when(F.col("image_id") % 1009 == 5, F.col("x0") - 1).otherwise(F.col("x0"))
    both = [audits.tree_digest(r.select("image_id", box(x0).alias("sha")), "image_id", "sha") for x0 in (F.col("x0"), moved)]
    return both[0].unionByName(both[1])


def ranges(spark, d):
    m = metrics(run_scores(spark, d))
    return op.inside_ranges(m.where("seed >= 0"), m.where("seed = -1").drop("seed"))


def rerun(spark, d):
    """The stored metrics of the repetition are those of the unrounded scores; its score table has them rounded."""
    m = metrics(run_scores(spark, d))
    again = m.where("seed = -1").drop("seed")
    return op.rerun_checks(differences(spark, d), region_digests(spark, d), op.inside_ranges(m.where("seed >= 0"), again),
                           op.recomputed(m.where("seed = 0").drop("seed"), again))


def agreement(spark, d):
    s = seeds(spark, d)
    out = op.agreement(s.where("seed = 0"), s.where("seed = 1"), "event_id", "logit")
    return out.withColumns({c: F.round(c, 6) for c in ("pearson", "spearman", "max_abs_diff")})


def metric_spread(spark, d):
    """AGG28. Mean and sample deviation over the five seeds of every ranking measure."""
    m = metrics(run_scores(spark, d)).where("seed >= 0")
    return m.groupBy("metric").agg(F.count(F.lit(1)).alias("seeds"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"))


def rerun_epochs(spark, d):
    """JOI17. Epochs of two runs side by side; the second run stops at three quarters of the first, or goes on where it is longer."""
    e = epochs(spark, d)
    a, b = e.where("run = 'click'"), e.where("run = 'error'")
    return reconcile.align_epochs(a, b, "metric")


QUERIES = {
    "settings_difference": differences, "rerun_ranges": lambda s, d: ranges(s, d).withColumns({c: F.round(c, 6) for c in ("value", "low", "high")}),
    "seed_metric_spread": metric_spread, "rerun_check": rerun, "run_agreement": agreement, "rerun_epochs": rerun_epochs,
}


def _settings(run):
    names = "list(event_type order by event_type desc)" if run == "again" else "list(event_type order by event_type)"
    return f"""select to_json(struct_pack(seed := 0, "commit" := md5('{run}'), env := struct_pack(run := '{run}', host := struct_pack(slots := 8)),
      data := struct_pack("rows" := sum(n)::bigint, "file.name" := 'events.parquet'),
      classes := map(list(event_type order by event_type), list(struct_pack(n := n, span := [f, u]) order by event_type)),
      "order" := {names}, extra := json('{{}}'))) as j
     from (select event_type, count(*) as n, min(event_id) as f, max(user_id) as u from events {"where event_id % 101 <> 7" if run == "again" else ""} group by 1)"""


def _leaves(run):
    return f"""select t.fullkey as path, t.value::varchar as value from ({_settings(run)}) s, json_tree(s.j) t
      where t.type not in ('OBJECT', 'ARRAY') or t.value::varchar in ('{{}}', '[]')"""


_differ = f"""df as (select coalesce(a.path, b.path) as path, a.value as "first", b.value as "second" from ({_leaves('first')}) a full join ({_leaves('again')}) b
    on a.path = b.path where a.value is distinct from b.value and not (coalesce(a.path, b.path) = '$.commit' or starts_with(coalesce(a.path, b.path), '$.env')))"""
_metrics = f"""{_seeds}, rs as materialized (select x.event_id, x.seed, x.logit, (event_type = 'error')::int as label from (select event_id, seed, logit from sd
    union all select event_id, -1, round(logit, 3) from sd where seed = 0) x join events using (event_id)),
 rc as (select seed, logit, sum(label)::bigint as pos, count(*) - sum(label)::bigint as neg from rs group by all),
 rt as (select *, sum(neg) over (partition by seed order by logit) as upto, sum(pos) over w as tp, sum(neg) over w as fp,
    sum(pos) over (partition by seed) as np, sum(neg) over (partition by seed) as nn from rc window w as (partition by seed order by logit desc)),
 me as (select seed, 'AUROC' as metric, sum(pos * (upto - neg / 2.0::double)) / (any_value(np)::double * any_value(nn)) as value from rt group by 1
    union all select seed, 'PR-AUC', sum(pos / np::double * (tp / (tp + fp)::double)) from rt group by 1),
 rr as (select a.metric, a.value, low, high, a.value between low and high as inside from me a
    join (select metric, min(value) as low, max(value) as high from me where seed >= 0 group by 1) s using (metric) where a.seed = -1)"""

ORACLES = {
    "settings_difference": f"with {_differ} select * from df",
    "rerun_ranges": f"with {_metrics} select metric, round(value, 6) as value, round(low, 6) as low, round(high, 6) as high, inside from rr",
    "seed_metric_spread": f"with {_metrics} select metric, count(*) as seeds, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd from me where seed >= 0 group by 1",
    "rerun_check": f"""with {_differ}, {_metrics}, {_regions},
      rd as (select string_agg(concat_ws('|', image_id, coalesce(x0::varchar, ''), coalesce(y0::varchar, '')), ',' order by image_id) as a,
        string_agg(concat_ws('|', image_id, coalesce((case when image_id % 1009 = 5 then x0 - 1 else x0 end)::varchar, ''), coalesce(y0::varchar, '')), ',' order by image_id) as b from rg),
      k as (select 'settings identical' as "check", (select count(*) from df) = 0 as passed union all select 'regions identical', a = b from rd
        union all select metric || ' in the range of the seeds', inside from rr
        union all select 'stored metrics recomputed', bool_and(abs(a.value - b.value) < 1e-4::double) from me a join me b on a.metric = b.metric and a.seed = 0 and b.seed = -1)
      select * from k union all select 'all', bool_and(passed) from k""",
    "run_agreement": f"""with {_seeds}, j as (select a.event_id, a.logit as x, b.logit as y, md5(concat_ws('|', '42', a.event_id::varchar, 'tie')) as h
        from sd a join sd b on a.event_id = b.event_id and a.seed = 0 and b.seed = 1),
      r as (select *, row_number() over (order by x, h, event_id) as rx, row_number() over (order by y, h, event_id) as ry from j)
      select count(*) as n, round(corr(x, y), 6) as pearson, round(corr(rx, ry), 6) as spearman, round(max(abs(x - y)), 6) as max_abs_diff,
        sum((x = y)::int)::bigint as identical from r""",
    "rerun_epochs": """with ep as (select event_type as run, floor(epoch(ts) / 3600)::bigint as epoch, round(avg(value), 6) as metric from events group by 1, 2)
      select coalesce(a.epoch, b.epoch) as epoch, a.metric as "first", b.metric as "second"
      from (select * from ep where run = 'click') a full join (select * from ep where run = 'error') b on a.epoch = b.epoch""",
}
