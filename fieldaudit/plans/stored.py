"""Sinks and sources together: every query writes derived rows in a stored format, reads them back and returns what it read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from fieldaudit.functions.bits import content_digest
from fieldaudit.functions.fields import image_key, person_part, slash_path
from fieldaudit.functions.measures import normal_half_width, p_value_text, percent_text
from fieldaudit.operators import characterise, evaluate, reconcile, tiles
from fieldaudit.operators.masks import has_text
from fieldaudit.operators.similarity import radius_pairs
from fieldaudit.plans import sql
from fieldaudit.plans.audits import _regions, _seeds, regions, seeds
from fieldaudit.plans.characterise import ORACLES as _characterise
from fieldaudit.plans.evaluate import ORACLES as _evaluate
from fieldaudit.plans.ranking import epochs
from fieldaudit.plans.similarity import _pairs, text_hashes
from fieldaudit.sources import json_object, manifested, readers, writers
from fieldaudit.sources.store import shared_root
from fieldaudit.sources.tables import cases, reach_workers, spread, table

_own: list[str] = []
SEEDS = 5  # that ``seeds`` gives an event


def folder(spark, name):
    """A new folder in the one the cluster names in spark.checkpoint.dir. Only a local session may go without."""
    root = shared_root(spark)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors reach")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="fieldaudit-"))
        root = _own[0]
    reach_workers(spark)
    return f"{root}/stored/{name}-{uuid.uuid4().hex}"


def flat(spark, d):
    path = folder(spark, "flat")
    writers.flat_manifest(cases(spark, d).withColumn("file", F.concat(F.lit("images/"), image_key(F.col("document_id"), F.col("quality_tier")), F.lit(".jpg"))), path)
    return readers.flat_manifest(spark, path).select("image_id", person_part(F.col("document_id")).alias("person"), "split", "label", "template_variant",
                                                     "forgery_field", "c1_op", "file", "width")


def nested(spark, d):
    path = folder(spark, "nested")
    c = cases(spark, d).select("image_id", "label", "split", F.create_map(F.lit("name"), F.col("print_name"), F.lit("dob"), F.col("print_dob")).alias("printed_values"),
                               F.struct(F.col("rule_gt_verdict").alias("overall")).alias("rule_gt_detail"))
    writers.json_lines(c, path)
    return readers.manifest(spark, path).select("image_id", "label", "split", F.col("printed_values")["name"].alias("name"), F.col("printed_values")["dob"].alias("dob"),
                                                F.col("rule_gt_detail.overall").alias("verdict"), F.col("rule_gt_detail.category").alias("category"))


def prediction_files(spark, d):
    path = folder(spark, "predictions")
    writers.predictions(cases(spark, d).select("image_id", F.col("visual").alias("decision"), "score"), path)
    return readers.predictions(spark, path).select("image_id", "decision", "score")


def seed_files(spark, d):
    """One folder of scores a seed; the seed is read from the path. A task keeps a file of every seed open, so that it need not sort its rows."""
    root, ids, side = folder(spark, "seeds"), F.col("event_id"), spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        side.conf.set(name, spark.conf.get(name))
    side.conf.set("spark.sql.maxConcurrentOutputFileWriters", SEEDS)
    s = seeds(side, d).select(ids.cast("string").alias("image_id"), F.lit("val").alias("split"), F.lit("pan").alias("doc_type"), F.lit("C0").alias("forgery_category"),
                               F.lit(0).alias("label"), "logit", F.pmod(ids, F.lit(15)).cast("int").alias("top_tile"),
                               *[(ids + i).cast("double").alias(f"tile{i}") for i in range(15)], F.concat(F.lit("seed"), "seed").alias("run"))
    s.write.partitionBy("run").option("header", True).csv(root)
    return readers.seed_scores(spark, f"{root}/run=*/*.csv", r"run=seed(\d+)").select(
        F.col("image_id").cast("long").alias("event_id"), "seed", F.round("logit", 6).alias("logit"), "top_tile", F.col("tiles")[14].alias("last_tile"))


def rule_files(spark, d):
    path = folder(spark, "rules")
    writers.rule_decisions(evaluate.rule_decisions(cases(spark, d)), path)
    return readers.rule_decisions(spark, path).select("image_id", "ocr_decision", "gt_decision", F.size("ocr_failed_checks").alias("n_failed"))


def parameter_files(spark, d):
    """Metric rows as JSON text, read back as parameter documents."""
    path = folder(spark, "parameters")
    totals = characterise.totals(cases(spark, d))
    writers.report_json(totals, path)
    return readers.parameters(spark, path, totals.schema)


def file_tree(spark, d):
    """Part rows as files in folders, listed with size and digest, and held against a hash list in text."""
    root, listed = folder(spark, "tree"), folder(spark, "hashes")
    rows = regions(spark, d).where(F.col("x0").isNotNull()).select((F.col("image_id") % 16).alias("bucket"), "image_id", F.concat_ws(",", "image_id", "x0", "y0", "x1", "y1").alias("line"))
    rows.repartition(16, "bucket").sortWithinPartitions("bucket", "image_id").select("bucket", "line").write.partitionBy("bucket").text(root)
    found = readers.files(spark, root, "*.txt").select("bytes", "sha", F.concat(F.regexp_extract(slash_path(F.col("file")), r"bucket=\d+", 0), F.lit("/rows.txt")).alias("file"))
    # The list names every third file with another digest and leaves every seventh out.
    k = F.regexp_extract("file", r"(\d+)", 1).cast("int")
    lines = found.where(k % 7 != 3).select(F.concat_ws("  ", F.when(k % 3 == 1, content_digest(F.lit("x").cast("binary"))).otherwise(F.col("sha")), "file").alias("value"))
    lines.unionByName(spark.createDataFrame([("# sha256 path",), ("",)], "value string")).write.text(listed)
    known = readers.hash_list(spark, listed).withColumnRenamed("sha", "want")
    status = F.when(F.col("want").isNull(), "not listed").when(F.col("want") == F.col("sha"), "identical").otherwise("different")
    return found.join(known, "file", "left").select("file", "bytes", "sha", status.alias("status"))


def epoch_files(spark, d):
    path = folder(spark, "epochs")
    e = epochs(spark, d).where("run = 'error'").select(F.col("epoch").cast("int").alias("epoch"), F.col("metric").alias("val_pr_auc"))
    writers.json_lines(e, path)
    return readers.epochs(spark, path).select("epoch", "val_pr_auc", "lr_end")


def split_files(spark, d):
    """The map of persons to splits as JSON objects, read in byte ranges of 4 KB."""
    path = folder(spark, "splits")
    s = cases(spark, d).groupBy(F.concat(F.lit("P"), F.col("person_id")).alias("person_id")).agg(F.min("split").alias("split"))
    json_object.write_json_objects(s, "person_id", "split", path)
    return json_object.json_object(spark, path, 4096).select(F.col("key").alias("person_id"), F.col("value").alias("split"))


def report_files(spark, d):
    """Two metric frames as tidy rows with texts of their rates."""
    path = folder(spark, "report")
    c = cases(spark, d)
    strata = characterise.fpr_by_tier(c)
    writers.report([writers.report_rows(strata, "fpr", ["doc_type", "quality_tier"], "n", ["rate"], {"rate": ("lo", "hi")}),
                    writers.report_rows(evaluate.system_summary(evaluate.combined_systems(c), evaluate.SYSTEM_COLUMNS), "systems", ["system"], "n_flagged", ["fpr", "recall_all"])], path)
    r = spark.read.parquet(path)
    return r.select("section", "cell", "metric", F.round("value", 6).alias("value"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n",
                    percent_text(F.col("value")).alias("percent"), F.round(normal_half_width(F.col("value"), F.col("n")), 6).alias("half_width"))


def added_column(spark, d):
    """A table and the same with one more column; rows and digests are those that the writing passes reported."""
    a, b = folder(spark, "table"), folder(spark, "table")
    c = cases(spark, d).select("image_id", "print_name", "split")
    first = manifested.totals(manifested.write_manifested(c, a))
    wider = manifested.read_manifested(spark, a, c.schema).withColumn("digest", F.sha2("print_name", 256))
    second = manifested.write_manifested(wider, b)
    again = manifested.read_manifested(spark, b, wider.schema).drop("digest").repartition(3)
    third = manifested.totals(manifested.write_manifested(again, folder(spark, "table")))
    same = first.unionByName(third).agg(F.min("rows").alias("rows"), (F.min("digest") == F.max("digest")).alias("same_rows"))
    return same.select(F.lit("first").alias("pass"), "rows", "same_rows").unionByName(
        second.agg(F.sum("rows").alias("rows")).select(F.lit("second").alias("pass"), "rows", F.lit(True).alias("same_rows")))


def pair_files(spark, d):
    path = folder(spark, "pairs")
    writers.candidate_pairs(radius_pairs(text_hashes(spark, d), "h", "doc_id"), path)
    return spark.read.option("header", True).schema("id_a long, id_b long, distance int, n_pairs long").csv(path)


def ensemble_files(spark, d):
    path = folder(spark, "ensemble")
    t = spark.range(5).select(F.col("id").cast("int").alias("seed"), (1 + F.col("id") / 4).alias("temperature"))
    e = reconcile.seed_ensemble(seeds(spark, d), t, 5, "event_id")
    writers.ensemble_and_reliability(e, e.groupBy(F.floor(F.col("prob") * 10).alias("bin")).agg(F.count(F.lit(1)).alias("n")), path)
    probs = spark.read.option("header", True).schema("event_id long, prob double").csv(f"{path}/ensemble")
    bins = spark.read.option("header", True).schema("bin long, n long").csv(f"{path}/reliability")
    return probs.select(F.lit("event").alias("part"), F.col("event_id").alias("key"), F.col("prob").alias("value")).unionByName(
        bins.select(F.lit("bin").alias("part"), F.col("bin").alias("key"), F.col("n").cast("double").alias("value")))


def fingerprint_files(spark, d):
    """Fingerprints in a listed table: rows as read, and the rows that its manifest says."""
    path = folder(spark, "fingerprints")
    h = text_hashes(spark, d).select("doc_id", F.lower(F.lpad(F.hex("h"), 16, "0")).alias("hash"))
    listed = manifested.write_manifested(h, path)
    return manifested.read_manifested(spark, path, h.schema).withColumn("listed", listed.agg(F.sum("rows").alias("n")).scalar())


def joined_decisions(spark, d):
    """JOI5 on two decision tables: outcomes of detector and rules on the rows that have extracted text."""
    c = cases(spark, d).withColumn("texts", F.when(F.col("ocr_name").isNotNull(), F.create_map(F.lit("name"), F.col("ocr_name"))).otherwise(F.create_map().cast("map<string,string>")))
    c = c.where(has_text("texts"))
    out = evaluate.join_decisions(c.select("image_id", F.col("visual").alias("decision")), c.select("image_id", F.col("rule_ocr").alias("decision")))
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def tile_rows(spark, d):
    """JOI7, FLT6. Training tiles of part images, ignored tiles left out, as counts per label and position."""
    r = regions(spark, d)
    images = spread(table(spark, d, "part").select("p_partkey"), "p_partkey").select(
        F.col("p_partkey").alias("image_id"), F.when(F.col("p_partkey") % 7 == 0, "C0").when(F.col("p_partkey") % 5 == 0, "C4").otherwise("C1").alias("forgery_category"))
    return tiles.training_tiles(images, r.where("x0 is not null")).groupBy("tile", "tile_label").agg(F.count(F.lit(1)).alias("n"))


def p_texts(spark, d):
    """FN16. p values of event rates per type against 0.2, as text."""
    e = table(spark, d, "events").groupBy("event_type").agg((F.count(F.lit(1)) % 1000).alias("k"))
    p = F.col("k") / 1000 * F.when(F.col("event_type") == "click", 0.0).when(F.col("event_type") == "view", 0.009).otherwise(1.0)
    return e.select("event_type", p_value_text(p).alias("p"), percent_text(F.nullif(p, F.lit(0.0)), 2).alias("percent"))


QUERIES = {
    "roundtrip_flat": flat, "roundtrip_nested": nested, "roundtrip_predictions": prediction_files, "roundtrip_seeds": seed_files, "roundtrip_rules": rule_files,
    "roundtrip_parameters": parameter_files, "roundtrip_files": file_tree, "roundtrip_epochs": epoch_files, "roundtrip_splits": split_files,
    "roundtrip_report": report_files, "roundtrip_added_column": added_column, "roundtrip_pairs": pair_files, "roundtrip_ensemble": ensemble_files,
    "roundtrip_fingerprints": fingerprint_files, "decision_outcomes": joined_decisions, "training_tile_counts": tile_rows, "p_value_texts": p_texts,
}

_c = sql.with_(sql.cases())
_percent = "case when value is null then 'n/a' else format('{:.1f}', round(100 * value, 1)) end as percent"
_half = "round(1.959963985::double * sqrt(value * (1 - value) / greatest(1, n)), 6) as half_width"

ORACLES = {
    "roundtrip_flat": f"""{_c} select image_id, person_id::varchar as person, split, label, template_variant, forgery_field, c1_op,
      'images/' || document_id || '_' || quality_tier || '.jpg' as file, null as width from cases""",
    "roundtrip_nested": f"{_c} select image_id, label, split, print_name as name, print_dob as dob, rule_gt_verdict as verdict, null as category from cases",
    "roundtrip_predictions": f"{_c} select image_id, visual as decision, round(score, 6) as score from cases",
    "roundtrip_seeds": f"with {_seeds} select event_id, seed, round(logit, 6) as logit, (event_id % 15)::int as top_tile, (event_id + 14)::double as last_tile from sd",
    "roundtrip_rules": f"""select image_id, ocr_decision, gt_decision, len(list_filter(string_split(coalesce(ocr_failed_checks, ''), '|'), lambda x: x <> ''))::int as n_failed
      from ({_evaluate['rule_decisions']})""",
    "roundtrip_parameters": _characterise["composition_totals"],
    "roundtrip_report": f"""with r as (select 'fpr' as section, doc_type || '/' || quality_tier as cell, 'rate' as metric, rate as value, lo, hi, n from ({_characterise['fpr_by_tier_all']})
        union all select 'systems', system, 'fpr', fpr, null, null, n_flagged from ({_evaluate['or_and_fusion']})
        union all select 'systems', system, 'recall_all', recall_all, null, null, n_flagged from ({_evaluate['or_and_fusion']}))
      select section, cell, metric, round(value, 6) as value, round(lo, 6) as lo, round(hi, 6) as hi, n, {_percent}, {_half} from r""",
    "roundtrip_epochs": """with e as (select floor(epoch(ts) / 3600)::int as epoch, round(avg(value), 6) as val_pr_auc from events where event_type = 'error' group by 1)
      select epoch, val_pr_auc, null::double as lr_end from e""",
    "roundtrip_splits": f"{_c} select 'P' || person_id as person_id, min(split) as split from cases group by 1",
    "roundtrip_files": f"""with {_regions}, f as (select image_id % 16 as k, string_agg(concat_ws(',', image_id, x0, y0, x1, y1) || chr(10), '' order by image_id) as t from rg where x0 is not null group by 1)
      select 'bucket=' || k || '/rows.txt' as file, strlen(t)::bigint as bytes, sha256(t) as sha,
        case when k % 7 = 3 then 'not listed' when k % 3 = 1 then 'different' else 'identical' end as status from f""",
    "roundtrip_added_column": f"""{_c}, n as (select count(*) as rows from cases)
      select 'first' as pass, rows, true as same_rows from n union all select 'second', rows, true from n""",
    "roundtrip_pairs": f"with {_pairs} select * from pairs",
    "roundtrip_ensemble": f"""with {_seeds}, e as (select event_id, avg(1.0::double / (1.0::double + exp(-logit / (1 + seed / 4.0::double)))) as prob from sd group by 1)
      select 'event' as part, event_id as key, round(prob, 6) as value from e union all select 'bin', floor(prob * 10)::bigint, count(*)::double from e group by 2""",
    "roundtrip_fingerprints": f"""with {_pairs}, x as (select doc_id, string_agg(substr('0123456789abcdef', (8 * substr(hash, 4 * i + 1, 1)::int + 4 * substr(hash, 4 * i + 2, 1)::int
        + 2 * substr(hash, 4 * i + 3, 1)::int + substr(hash, 4 * i + 4, 1)::int + 1)::int, 1), '' order by i) as hash from hs, range(0, 16) r(i) group by 1)
      select doc_id, hash, (select count(*) from hs) as listed from x""",
    "decision_outcomes": f"""{_c} select case when visual = 1 and rule_ocr = 1 then 'both' when visual = 1 then 'first_only' when rule_ocr = 1 then 'second_only' else 'neither' end as outcome,
      count(*) as n from cases where ocr_name is not null group by 1""",
    "training_tile_counts": f"""with {_regions} select tile, tile_label, count(*) as n from tl where tile_label <> -1 and (image_id % 7 = 0 or image_id % 5 <> 0) group by 1, 2""",
    "p_value_texts": """with e as (select event_type, count(*) % 1000 as k from events group by 1),
      p as (select event_type, k / 1000.0::double * case event_type when 'click' then 0.0::double when 'view' then 0.009::double else 1.0::double end as p from e)
      select event_type, case when p = 0 then '< 1e-4' when p < 0.01 then format('{:.4f}', p) else format('{:.3f}', p) end as p,
        case when p = 0 then 'n/a' else format('{:.2f}', 100 * p) end as percent from p""",
}
