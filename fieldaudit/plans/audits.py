"""Audit, reconciliation, tile and generator queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldaudit.functions import geometry as g
from fieldaudit.functions.draws import Digits, draw
from fieldaudit.functions.fields import document_rule, field_map
from fieldaudit.functions.measures import logit
from fieldaudit.operators import audits, reconcile, synth, tiles
from fieldaudit.plans import sql
from fieldaudit.operators.similarity import radius_pairs
from fieldaudit.plans.similarity import _pairs, bits_text, text_hashes
from fieldaudit.sources.tables import cases, spread, table

CATS = ("C0", "C1", "C2", "C3", "C4")


def planted_predictions(spark, d):
    """Predictions of the test split with defects planted by key: lost, repeated, renamed, invalid rows."""
    c = cases(spark, d)
    k = F.substring("image_id", 2, 20).cast("long")
    wanted = c.where(((F.col("split") == "test") & (k % 97 != 0)) | ((F.col("split") == "val") & (k % 89 == 0)))
    p = wanted.select(
        F.when(k % 83 == 0, F.concat(F.lit("x"), "image_id")).otherwise(F.col("image_id")).alias("image_id"),
        F.when(k % 79 == 0, 2).otherwise(F.col("visual")).alias("decision"),
        F.when(k % 73 == 0, float("nan")).otherwise(F.col("score")).alias("score"),
        F.when(k % 71 == 0, 1 - F.col("label")).otherwise(F.col("label")).alias("label"))
    return p.unionByName(p.where(F.substring("image_id", 2, 20).try_cast("long") % 67 == 0))


def coverage(spark, d):
    return reconcile.coverage_problems(planted_predictions(spark, d), cases(spark, d), "test", CATS)


def altered_cases(spark, d):
    c = cases(spark, d).select("image_id", "split", "doc_type", "rule_ocr_verdict", "label")
    k = F.substring("image_id", 2, 20).cast("long")
    return c.where(k % 61 != 0).withColumns({
        "rule_ocr_verdict": F.when(k % 59 == 0, "SKIPPED").otherwise(F.col("rule_ocr_verdict")),
        "label": F.when(k % 53 == 0, 1 - F.col("label")).otherwise(F.col("label"))})


def seeds(spark, d):
    """Logits of five seeds per event, from the event value and a draw."""
    e = spread(table(spark, d, "events").select("event_id", "value"), "event_id")
    noise = F.pmod(draw(F.col("event_id"), F.col("seed"), "seed"), F.lit(1000)) / 1000.0
    return e.select("event_id", "value", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("seed")).select(
        "event_id", "seed", (F.col("value") / 10 - 1 + noise).alias("logit"))


def ensemble(spark, d):
    t = spark.range(5).select(F.col("id").cast("int").alias("seed"), (1 + F.col("id") / 4).alias("temperature"))
    return reconcile.seed_ensemble(seeds(spark, d), t, 5, "event_id").withColumn("prob", F.round("prob", 6))


def seed_spread(spark, d):
    """AGG28. Per-seed mean logit of error events, then mean and sample deviation over seeds."""
    ev = table(spark, d, "events").where(F.col("event_type") == "error").select("event_id")
    per = seeds(spark, d).join(ev, "event_id").groupBy("seed").agg(F.avg("logit").alias("m"))
    return per.agg(F.count(F.lit(1)).alias("seeds"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("sd"))


def self_check(spark, d):
    s = seeds(spark, d)
    out = audits.self_check(s.where("seed = 0"), s.where("seed = 1"), "event_id", "logit")
    return out.withColumn("max_diff", F.round("max_diff", 6))


def document_files(spark, d):
    """Documents as files: path, split of the person, bytes, digest."""
    h = text_hashes(spark, d).select("doc_id", "person_id", "split")
    t = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return t.join(h, "doc_id").select(
        "doc_id", "person_id", "split", F.concat(F.lit("texts/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"),
        F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha"))


def split_check(spark, d):
    f = document_files(spark, d)
    return audits.split_check(f.select("person_id", "split", "file"), f.where("doc_id % 50 <> 7").select("file", "sha"))


def file_audit(spark, d):
    f = document_files(spark, d)
    found = f.where("doc_id % 41 <> 3").select(
        F.when(F.col("doc_id") % 43 == 5, F.concat("file", F.lit("~"))).otherwise(F.col("file")).alias("file"),
        (F.col("bytes") + (F.col("doc_id") % 47 == 2).cast("int")).alias("bytes"))
    return reconcile.file_status(f, found).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def digest_audit(spark, d):
    f = document_files(spark, d)
    again = f.where("doc_id % 41 <> 3").select("file", F.when(F.col("doc_id") % 43 == 5, F.sha2("sha", 256)).otherwise(F.col("sha")).alias("sha"))
    return reconcile.digest_status(f, again)


def regions(spark, d):
    """Edit regions from part rows; every seventh part is genuine and has none."""
    p = spread(table(spark, d, "part").select("p_partkey"), "p_partkey")
    n = Digits(draw(F.col("p_partkey"), "box"))
    genuine = F.col("p_partkey") % 7 == 0
    x, y, w, h = n.take(900), n.take(560), n.take(200) + 4, n.take(76) + 4
    p = p.select("p_partkey", genuine.alias("genuine"), x.alias("x"), y.alias("y"), (x + w).alias("xe"), (y + h).alias("ye"))
    some = lambda c: F.when(~F.col("genuine"), F.col(c).cast("int"))
    return p.select(F.col("p_partkey").alias("image_id"), some("x").alias("x0"), some("y").alias("y0"),
                    F.least(some("xe"), F.lit(1024)).alias("x1"), F.least(some("ye"), F.lit(640)).alias("y1"))


def tile_scores(spark, d):
    t = tiles.with_tiles(regions(spark, d))
    logit_ = F.pmod(draw(F.col("image_id"), F.col("tile"), "tile"), F.lit(1000)) / 100.0 + F.when(F.col("tile_label") == 1, 5.0).otherwise(0.0)
    return tiles.document_scores(t.withColumn("logit", logit_), "image_id", "tile", "logit")


def mapped_boxes(spark, d):
    """FN20, FN21: region areas, padded boxes, and boxes under a fixed homography."""
    r = regions(spark, d).where(F.col("x0").isNotNull())
    box = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1"))
    h = [F.lit(v) for v in (1.02, 0.05, 3.0, -0.04, 0.98, 7.0, 0.00001, 0.00002, 1.0)]
    m = g.map_box(h, box, F.lit(1024), F.lit(640))
    p = g.pad_clamp(box, 12, F.lit(1024), F.lit(640))
    i = g.intersection(m, p)
    return r.select("image_id", g.area(*box).alias("area"), *[c.alias(n) for c, n in zip(m, ("mx0", "my0", "mx1", "my1"))],
                    g.area(*p).alias("padded_area"), g.area(*i).alias("common_area"))


def printed(df):
    return field_map(F.col("doc_type"), F.col("print_id"), F.col("print_name"), F.col("print_dob"), F.col("print_father"))


def fault_audit(spark, d):
    """JOI21: every altered case against the unaltered print of the same document."""
    c = cases(spark, d)
    control = c.select("image_id", field_map(F.col("doc_type"), F.col("own_id"), F.col("print_name"), F.col("print_dob"),
                                             F.col("print_father")).alias("printed_values"))
    modified = c.where(F.col("forged_value").isNotNull()).select("image_id", "doc_type", "forgery_category", "forgery_field",
                                                                 printed(c).alias("printed_values"))
    out = reconcile.field_changes(control, modified, ["image_id"])
    return out.groupBy("doc_type", "forgery_category", "forgery_field", "changed").agg(F.count(F.lit(1)).alias("n"))


def design(spark, d):
    """GEN6 with GEN5 and the fresh-corpus check AUD4: one corpus of customers' identities against another seed's."""
    def corpus(seed):
        people = synth.with_identity(spread(table(spark, d, "customer").select(F.col("c_custkey").alias("person_id")), "person_id"),
                                     "person_id", seed)
        df = synth.print_fields(synth.expand_design(people, spark))
        df = synth.with_fault(df, "image_id", seed)
        gt = document_rule(F.col("doc_type"), F.col("print_id"), F.col("print_name"))
        expected = F.when((F.col("forgery_category") == "C2") | ((F.col("doc_type") == "pan") & (F.col("forgery_category") == "C3")), "FAIL").otherwise("PASS")
        return df.select("image_id", "person_id", "doc_type", "forgery_category", "quality_tier", "aadhaar", "pan",
                         gt["overall"].alias("rule_gt_verdict"), expected.alias("expected_rule"))

    n = table(spark, d, "customer").count()
    return audits.fresh_check(corpus(42), corpus(7).select("aadhaar", "pan"), n, ["aadhaar", "pan"])


def index_audit(spark, d):
    c = cases(spark, d).select("image_id", "split", "doc_type", "rule_ocr_verdict", "label", "forgery_category")
    a = altered_cases(spark, d).join(c.select("image_id", "forgery_category"), "image_id")
    return audits.index_check(a, c, "image_id", ["split", "doc_type", "rule_ocr_verdict", "label", "forgery_category"])


def score_table(spark, d, planted):
    """Scores with the columns they state; planted: some rows state another split, type or category, as after an edit of the file."""
    c = cases(spark, d).select("image_id", "split", "doc_type", "forgery_category")
    k = F.substring("image_id", 2, 20).try_cast("long")
    rows = planted_predictions(spark, d).select("image_id", F.when(F.isnan("score"), F.col("score")).otherwise(logit(F.col("score"))).alias("logit"), "label")
    rows = rows.join(c, "image_id", "left")
    if not planted:
        return rows
    return rows.withColumns({"split": F.when(k % 103 == 0, "train").otherwise(F.col("split")),
                             "doc_type": F.when(k % 107 == 0, F.lit(None)).otherwise(F.col("doc_type")),
                             "forgery_category": F.when(k % 109 == 0, "C9").otherwise(F.col("forgery_category"))})


def score_run(spark, d):
    stored = audits.score_rows_digest(score_table(spark, d, False))
    return audits.score_run_check(score_table(spark, d, True), cases(spark, d), ("test", "val"), stored)


def zero_distance(spark, d):
    """Documents with equal fingerprints, and whether their texts are equal."""
    df = text_hashes(spark, d).select("doc_id", "h").join(document_files(spark, d).select("doc_id", "sha"), "doc_id")
    return audits.equal_fingerprints(df, "h", "sha").withColumn("h", bits_text(F.col("h")))


QUERIES = {
    "prediction_coverage": coverage,
    "score_run_check": score_run,
    "reconcile_fields": lambda s, d: reconcile.field_differences(
        cases(s, d), altered_cases(s, d), "image_id", ["split", "doc_type", "rule_ocr_verdict", "label"]),
    "index_check": index_audit,
    "key_gaps": lambda s, d: reconcile.key_gaps({
        "cases": cases(s, d).select("image_id"), "altered": altered_cases(s, d).select("image_id"),
        "tests": cases(s, d).where("split <> 'train'").select("image_id")}, "image_id"),
    "seed_ensemble": ensemble, "seed_spread": seed_spread, "self_check": self_check,
    "leakage_audit": lambda s, d: audits.leakage_audit(cases(s, d), radius_pairs(text_hashes(s, d), "h", "doc_id")),
    "zero_distance_contents": zero_distance,
    "leakage_pairs": lambda s, d: audits.split_intersections(
        document_files(s, d).select("sha", "split"), "sha"),
    "missing_variants": lambda s, d: audits.missing_variants(
        cases(s, d).where("not (split = 'val' and doc_type = 'pan' and template_variant = 2)"), ["doc_type", "template_variant"]),
    "dup_text_across_splits": split_check,
    "file_status": file_audit, "digest_status": digest_audit,
    "tree_digest": lambda s, d: audits.tree_digest(document_files(s, d), "doc_id", "sha"),
    "shared_identifiers": lambda s, d: reconcile.shared_values(
        cases(s, d).where("split = 'test'").select("print_name"), cases(s, d).where("split = 'train'"), "print_name"),
    "region_grid_labels": lambda s, d: tiles.with_tiles(regions(s, d)).select("image_id", "tile", "tx", "ty", "tile_label"),
    "tile_document_scores": tile_scores, "mapped_boxes": mapped_boxes,
    "example_person": lambda s, d: tiles.best_person(
        cases(s, d), {"font_substitution": 5, "field_displacement": 4, "patch_splice": 4, "resample_patch": 2, "local_recompression": 1},
        {"identifier": 7, "name": 3, "dob": 2}),
    "synthetic_identities": lambda s, d: synth.with_identity(
        spread(table(s, d, "customer").select("c_custkey"), "c_custkey"), "c_custkey").select(
        "c_custkey", "gender", "naming_stratum", "honorific", "name_latin", "name_devanagari", "printed_name", "surname", "dob",
        "father_name", "aadhaar", "pan", "pan_fifth", "pan_fifth_source"),
    "fault_injection": lambda s, d: cases(s, d).select(
        "image_id", "doc_type", "forgery_category", "forgery_field", "forgery_detail", "gt_value", "forged_value", "print_id",
        "ocr_id", "ocr_name", "rule_gt_verdict", "rule_ocr_verdict"),
    "fault_content_audit": fault_audit,
    "design_expansion_check": design,
}

_c = sql.with_(sql.cases())
_k = "substr(image_id, 2)::bigint"
_planted = f"""p0 as (select case when {_k} % 83 = 0 then 'x' || image_id else image_id end as image_id,
   case when {_k} % 79 = 0 then 2 else visual end as decision, case when {_k} % 73 = 0 then 'nan'::double else score end as score,
   case when {_k} % 71 = 0 then 1 - label else label end as label
   from cases where (split = 'test' and {_k} % 97 <> 0) or (split = 'val' and {_k} % 89 = 0)),
 pp as (select * from p0 union all select * from p0 where try_cast(substr(image_id, 2) as bigint) % 67 = 0),
 pk as (select image_id, count(*) as rows, any_value(decision) as decision, any_value(score) as score, any_value(label) as label from pp group by 1)"""
_altered = f"""al as (select image_id, split, doc_type, case when {_k} % 59 = 0 then 'SKIPPED' else rule_ocr_verdict end as rule_ocr_verdict,
   case when {_k} % 53 = 0 then 1 - label else label end as label, forgery_category from cases where {_k} % 61 <> 0)"""


def _problems(split_test, missing):
    return f"""select image_id, 'unknown id' as problem from pk anti join cases using (image_id)
   union all select image_id, 'duplicate id' from pk where rows > 1
   union all select image_id, 'other split' from pk join cases c using (image_id) where {split_test}
   union all select image_id, 'missing' from cases c anti join pk using (image_id) where {missing}
   union all select image_id, 'score not finite' from pk where isnan(score)"""


_fields = ("split", "doc_type", "rule_ocr_verdict", "label")
_seeds = """sd as (select event_id, s::int as seed, value / 10 - 1 + (('0x' || substr(md5(concat_ws('|', '42', event_id::varchar, s::varchar, 'seed')), 1, 15))::bigint % 1000) / 1000.0::double as logit
   from events, range(0, 5) t(s))"""
_files = f"""fl as (select doc_id, doc_id // 6 as person_id, {sql.texts(sql.SPLIT_CYCLE)}[((doc_id // 6) % 20 + 1)::int] as split,
   'texts/' || doc_id::varchar || '.txt' as file, strlen(text)::bigint as bytes, sha256(text) as sha from documents)"""
_regions = f"""rg0 as (select p_partkey, {sql.draw('p_partkey', 'box')} as b from part),
 rg as (select p_partkey as image_id, case when p_partkey % 7 <> 0 then (b % 900)::int end as x0, case when p_partkey % 7 <> 0 then ({sql.take('b', 900, 560)})::int end as y0,
   case when p_partkey % 7 <> 0 then least(b % 900 + {sql.take('b', 504000, 200)} + 4, 1024)::int end as x1,
   case when p_partkey % 7 <> 0 then least({sql.take('b', 900, 560)} + {sql.take('b', 100800000, 76)} + 4, 640)::int end as y1 from rg0),
 tl0 as (select rg.*, (j * 5 + i)::int as tile, (i * 192)::int as tx, (j * 192)::int as ty from rg, range(0, 5) a(i), range(0, 3) b(j)),
 tl1 as (select *, greatest(0, x1 - x0) * greatest(0, y1 - y0) as whole,
   greatest(0, least(x1, tx + 256) - greatest(x0, tx)) * greatest(0, least(y1, ty + 256) - greatest(y0, ty)) as part from tl0),
 tl as (select *, case when x0 is null then 0 when part >= 0.25::double * whole then 1 when part > 0 then -1 else 0 end as tile_label from tl1)"""
_span = lambda rel, key: f"(select count(*) from (select {key} from {rel} group by {key} having count(distinct split) > 1))"


def _check(name, value):
    return f"select '{name}' as \"check\", {value}::bigint as violations, {value} = 0 as passed"


def _mapped():
    pts = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
    w = [f"(0.00001::double * {x} + 0.00002::double * {y} + 1.0::double)" for x, y in pts]
    xs = ", ".join(f"(1.02::double * {x} + 0.05::double * {y} + 3.0::double) / {v}" for (x, y), v in zip(pts, w))
    ys = ", ".join(f"(-0.04::double * {x} + 0.98::double * {y} + 7.0::double) / {v}" for (x, y), v in zip(pts, w))
    return f"""with {_regions}, m as (select *, greatest(0, floor(least({xs}))::int) as mx0, greatest(0, floor(least({ys}))::int) as my0,
      least(1024, ceil(greatest({xs}))::int) as mx1, least(640, ceil(greatest({ys}))::int) as my1,
      greatest(0, x0 - 12) as px0, greatest(0, y0 - 12) as py0, least(1024, x1 + 12) as px1, least(640, y1 + 12) as py1 from rg where x0 is not null)
      select image_id, greatest(0, x1 - x0) * greatest(0, y1 - y0) as area, mx0, my0, mx1, my1, (px1 - px0) * (py1 - py0) as padded_area,
        greatest(0, least(mx1, px1) - greatest(mx0, px0)) * greatest(0, least(my1, py1) - greatest(my0, py0)) as common_area from m"""


_variants = """vs as (select distinct doc_type, template_variant, split from cases where not (split = 'val' and doc_type = 'pan' and template_variant = 2))"""
_shared = lambda key: f"(select coalesce(sum(n * (n - 1) / 2), 0) from (select count(distinct split) as n from cases group by {key}))"
_leak = f"""{_c}, ck as (
   {_check('identity', _shared('person_id'))} union all {_check('identifier', _shared('own_id'))}
   union all {_check('template', "(select 3 * count(distinct (doc_type, template_variant)) - count(distinct (doc_type, template_variant, split)) from cases)")}
   union all {_check('augmentation', _span('cases', 'document_id'))}
   union all {_check('printed_values', _span("cases", "(print_id, print_name, print_dob, coalesce(print_father, ''), case when doc_type = 'aadhaar' then case when forgery_category = 'C3' then forged_value else name_devanagari end else '' end)"))})"""

ORACLES = {
    "prediction_coverage": f"""{_c}, {_planted} {_problems("c.split <> 'test'", "c.split = 'test'")}
      union all select image_id, 'decision not 0 or 1' from pk where decision not in (0, 1)
      union all select image_id, 'label disagrees' from pk join cases c using (image_id) where pk.label <> c.label""",
    "score_run_check": f"""{_c}, {_planted}, q as ({_problems("c.split = 'train'", "c.split <> 'train'")}
      union all select image_id, 'label disagrees' from pk join cases c using (image_id) where pk.label <> c.label),
      st as (select p.image_id, p.score, p.label, c.split, c.doc_type, c.forgery_category, try_cast(substr(p.image_id, 2) as bigint) as k from pp p left join cases c using (image_id)),
      sp as (select image_id, score, label, case when k % 103 = 0 then 'train' else split end as split, case when k % 107 = 0 then null else doc_type end as doc_type,
        case when k % 109 = 0 then 'C9' else forgery_category end as forgery_category from st),
      w as (select distinct sp.image_id, sp.split is distinct from c.split as s, sp.doc_type is distinct from c.doc_type as t, sp.forgery_category is distinct from c.forgery_category as f
        from sp join cases c using (image_id) where c.split <> 'train'),
      dg as (select (select md5(string_agg(concat_ws('|', image_id, split, coalesce(doc_type, '-'), forgery_category), ',' order by image_id, split, doc_type, forgery_category)) from st) as a,
        (select md5(string_agg(concat_ws('|', image_id, split, coalesce(doc_type, '-'), forgery_category), ',' order by image_id, split, doc_type, forgery_category)) from sp) as b)
      select problem, count(*) as n from q group by 1 union all select 'split disagrees', count(*) from w where s having count(*) > 0
      union all select 'doc_type disagrees', count(*) from w where t having count(*) > 0 union all select 'forgery_category disagrees', count(*) from w where f having count(*) > 0
      union all select 'digest differs', 1 from dg where a <> b""",
    "zero_distance_contents": f"""with {_pairs}, {_files}, c as (select hash, sha, count(*) as n from hs join fl using (doc_id) group by all)
      select hash as h, sum(n)::bigint as n_rows, count(sha) as contents, (sum(n) * (sum(n) - 1) // 2)::bigint as pairs,
        coalesce(sum(n) filter (where sha is not null) * (sum(n) filter (where sha is not null) - 1) // 2, 0)::bigint as compared,
        sum(case when sha is null then 0 else n * (n - 1) // 2 end)::bigint as same_pairs
      from c where hash is not null group by 1 having sum(n) > 1""",
    "reconcile_fields": f"{_c}, {_altered} " + " union all ".join(
        f"select image_id, '{f}' as field, c.{f}::varchar as \"left\", al.{f}::varchar as \"right\" from cases c join al using (image_id) where c.{f} is distinct from al.{f}"
        for f in _fields) + " union all select image_id, 'row', 'present', null from cases anti join al using (image_id)",
    "index_check": f"""{_c}, {_altered}, q as (""" + " union all ".join(
        f"select '{f} differs' as problem from cases c join al using (image_id) where c.{f} is distinct from al.{f}" for f in _fields)
        + """ union all select 'row differs' from cases anti join al using (image_id)
        union all select 'label off category' from al where label <> (forgery_category <> 'C0')::int) select problem, count(*) as n from q group by 1""",
    "key_gaps": f"""{_c}, {_altered} select image_id, 'altered' as missing_from from cases anti join al using (image_id)
      union all select image_id, 'tests' from cases where split = 'train'""",
    "seed_ensemble": f"with {_seeds} select event_id, round(avg(1.0::double / (1.0::double + exp(-logit / (1 + seed / 4.0::double)))), 6) as prob from sd group by 1",
    "seed_spread": f"""with {_seeds}, p as (select seed, avg(logit) as m from sd join events using (event_id) where event_type = 'error' group by 1)
      select count(*) as seeds, round(avg(m), 6) as mean, round(stddev_samp(m), 6) as sd from p""",
    "self_check": f"""with {_seeds}, f as (select event_id, logit from sd where seed = 0 order by event_id limit 40)
      select count(*) as rows, round(max(abs(f.logit - sd.logit)), 6) as max_diff, max(abs(f.logit - sd.logit)) <= 0.01 as passed from f join sd using (event_id) where seed = 1""",
    "leakage_audit": f"{_leak}, {_pairs} select * from ck union all select 'all', sum(violations)::bigint, bool_and(passed) from ck "
                     "union all select 'near_duplicates', coalesce(sum(n_pairs), 0)::bigint, null from pairs",
    "leakage_pairs": f"""with {_files}, p(pair, a, b) as (values ('test|train', 'test', 'train'), ('test|val', 'test', 'val'), ('train|val', 'train', 'val'))
      select pair, (select count(*) from (select sha from fl where split = a intersect select sha from fl where split = b)) as shared from p""",
    "missing_variants": f"""{_c}, {_variants} select doc_type, template_variant, split from (select distinct doc_type, template_variant from vs), (select unnest(['train', 'val', 'test']) as split)
      except select doc_type, template_variant, split from vs""",
    "dup_text_across_splits": f"""with {_files}, fd as (select * from fl where doc_id % 50 <> 7) {_check('people_crossing', _span('fl', 'person_id'))}
      union all {_check('missing_files', "(select count(*) from (select distinct file from fl) anti join fd using (file))")} union all {_check('same_bytes_across_splits', _span('fd', 'sha'))}""",
    "file_status": f"""with {_files}, fd as (select case when doc_id % 43 = 5 then file || '~' else file end as file, bytes + (doc_id % 47 = 2)::int as bytes from fl where doc_id % 41 <> 3)
      select case when fd.file is null then 'missing' when fl.file is null then 'extra' when fl.bytes <> fd.bytes then 'wrong size' else 'ok' end as status, count(*) as n
      from fl full join fd on fl.file = fd.file group by 1""",
    "digest_status": f"""with {_files}, ag as (select file, case when doc_id % 43 = 5 then sha256(sha) else sha end as sha from fl where doc_id % 41 <> 3)
      select case when ag.file is null then 'missing' when ag.sha = fl.sha then 'identical' else 'different' end as status, count(*) as n
      from fl left join ag on fl.file = ag.file group by 1""",
    "tree_digest": f"""with {_files}, l as (select substr(md5(doc_id::varchar), 1, 8) as node, doc_id::varchar || ':' || sha || chr(10) as line from fl),
      d8 as (select node, sha256(string_agg(line, '' order by line)) as leaf, count(*) as n from l group by 1)
      """ + "".join(f""", d{d} as (select substr(node, 1, {d}) as node, sha256(string_agg(node || ':' || leaf, chr(10) order by node)) as leaf, sum(n)::bigint as n
      from d{d + 2} group by 1)""" for d in (6, 4, 2, 0)) + " select leaf as digest, n from d0",
    "shared_identifiers": f"{_c} select print_name from cases where split = 'test' intersect select print_name from cases where split = 'train'",
    "region_grid_labels": f"with {_regions} select image_id, tile, tx, ty, tile_label from tl",
    "tile_document_scores": f"""with {_regions}, s as (select image_id, tile, (('0x' || substr(md5(concat_ws('|', '42', image_id::varchar, tile::varchar, 'tile')), 1, 15))::bigint % 1000) / 100.0::double
        + case when tile_label = 1 then 5.0::double else 0.0::double end as logit from tl), r as (select *, row_number() over (partition by image_id order by logit desc, tile) as rn from s)
      select image_id, logit, tile as top_tile from r where rn = 1""",
    "mapped_boxes": _mapped(),
    "example_person": f"""{_c}, s as (select person_id, count(distinct doc_type) as docs, max((naming_stratum = 'surname_last')::int) as last,
        sum(case c1_op when 'font_substitution' then 5 when 'field_displacement' then 4 when 'patch_splice' then 4 when 'resample_patch' then 2 else 1 end
          + case c1_field when 'identifier' then 7 when 'name' then 3 when 'dob' then 2 else 0 end) as s
        from cases where forgery_category = 'C1' and quality_tier = 'clean' group by 1)
      select person_id, (s + 2 * last)::bigint as points from s where docs = 2 order by points desc, person_id limit 1""",
    "synthetic_identities": sql.with_(sql.identity_ctes("customer", "c_custkey")) + """select c_custkey, gender, naming_stratum, honorific, name_latin,
      name_devanagari, printed_name, surname, dob, father_name, aadhaar, pan, pan_fifth, pan_fifth_source from id5""",
    "fault_injection": f"""{_c} select image_id, doc_type, forgery_category, forgery_field, forgery_detail, gt_value, forged_value, print_id, ocr_id, ocr_name,
      rule_gt_verdict, rule_ocr_verdict from cases""",
    "fault_content_audit": f"""{_c} select doc_type, forgery_category, forgery_field, case when print_id <> own_id then id_field else '' end as changed, count(*) as n
      from cases where forged_value is not null group by all""",
}
