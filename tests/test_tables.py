import pytest
from pyspark.sql import functions as F

from fieldaudit.functions import geometry as g
from fieldaudit.operators import audits, characterise, evaluate, reconcile, synth, tiles
from fieldaudit.operators.masks import case_masks, labelled_tiles
from fieldaudit.plans import audits as plan
from fieldaudit.sources import readers, writers
from fieldaudit.sources.tables import cases
from fieldaudit.streaming import validated


def test_design_corpus_is_clean(spark, tiny):
    rows = {r["check"]: (r["violations"], r["passed"]) for r in plan.design(spark, tiny).collect()}
    assert rows and all(v == (0, True) for v in rows.values())


def test_fresh_check_reports_defects(spark, tiny):
    df = cases(spark, tiny).withColumns({"aadhaar": F.col("own_id")})
    rows = {r["check"]: r["passed"] for r in audits.fresh_check(df, df, 5, ["aadhaar"]).collect()}
    assert rows["shared aadhaar"] is False and rows["image count"] is False and rows["repeated image_id"] is True


def test_identities_do_not_depend_on_partitioning(spark):
    a = synth.identities(spark, 50).orderBy("person_id").collect()
    b = synth.with_identity(spark.range(50).repartition(7), "id").orderBy("id").select("aadhaar", "pan").collect()
    assert [(r["aadhaar"], r["pan"]) for r in a] == [tuple(r) for r in b]


def test_true_text_meets_the_design(spark, tiny):
    c = cases(spark, tiny)
    assert c.where("rule_gt_verdict <> expected_rule").count() == 0
    assert c.where((F.col("forgery_category") == "C3") & (F.col("doc_type") == "pan") & (F.col("gt.semantic_check") != "FAIL")).count() == 0
    assert c.where("forged_value = gt_value").count() == 0
    assert len(case_masks()) == 45


def test_or_and_identity(spark, tiny):
    c = evaluate.combined_systems(cases(spark, tiny))
    assert c.where("or_ocr + and_ocr <> visual + rule_ocr").count() == 0
    total = characterise.composition(cases(spark, tiny)).where("quality_tier <> 'ALL'").agg(F.sum("n")).first()[0]
    assert total == cases(spark, tiny).count()


def manifest(spark):
    rows = [(f"i{k}", "test" if k < 6 else "val", "pan", f"C{k % 5}", int(k % 5 > 0)) for k in range(10)]
    return spark.createDataFrame(rows, "image_id string, split string, doc_type string, forgery_category string, label int")


@pytest.mark.parametrize("change,problem", [
    ("missing", "missing"), ("duplicate", "duplicate id"), ("unknown", "unknown id"), ("split", "other split"),
    ("decision", "decision not 0 or 1"), ("nan", "score not finite"), ("label", "label disagrees"), ("category", "outside category set")])
def test_coverage_errors(spark, change, problem):
    m = manifest(spark)
    p = m.where("split = 'test'").select("image_id", F.lit(1).alias("decision"), F.lit(0.5).alias("score"), "label")
    first = F.col("image_id") == "i1"
    cats = ("C0", "C1", "C2", "C3", "C4")
    if change == "missing":
        p = p.where(~first)
    elif change == "duplicate":
        p = p.unionByName(p.where(first))
    elif change == "unknown":
        p = p.unionByName(p.where(first).withColumn("image_id", F.lit("zz")))
    elif change == "split":
        p = p.unionByName(p.where(first).withColumns({"image_id": F.lit("i7"), "label": F.lit(1)}))
    elif change == "decision":
        p = p.withColumn("decision", F.when(first, 2).otherwise(1))
    elif change == "nan":
        p = p.withColumn("score", F.when(first, float("nan")).otherwise(0.5))
    elif change == "label":
        p = p.withColumn("label", F.when(first, 0).otherwise(F.col("label")))
    else:
        cats = ("C0", "C2", "C3", "C4")
    got = reconcile.coverage_problems(p, m, "test", cats).collect()
    assert [r["problem"] for r in got] == [problem]


def test_coverage_needs_columns(spark):
    m = manifest(spark)
    for cols, kw in ((["decision"], {}), (["image_id"], {}), (["image_id", "score"], {})):
        p = m.select(F.col("image_id"), F.lit(1).alias("decision"), F.lit(.5).alias("score")).select(*cols)
        with pytest.raises(ValueError):
            reconcile.coverage_problems(p, m, "test", ("C0",), **kw)
    ok = m.where("split = 'test'").select("image_id", F.lit(.5).alias("score"))
    assert reconcile.coverage_problems(ok, m, "test", ("C0", "C1", "C2", "C3", "C4"), threshold=.4).count() == 0
    assert reconcile.decisions_of(ok, .5).agg(F.sum("decision")).first()[0] == 6


def test_reconcile_small_operators(spark):
    assert reconcile.term_grid(spark, {"a": list("1234"), "b": list("1234"), "c": list("1234")}).count() == 64
    e1 = spark.createDataFrame([(1, .1), (2, .2)], "epoch int, m double")
    e2 = spark.createDataFrame([(1, .3)], "epoch int, m double")
    assert reconcile.align_epochs(e1, e2, "m").where("second is null").count() == 1
    s = spark.createDataFrame([("i", 0, 0.0), ("i", 1, 2.0)], "image_id string, seed int, logit double")
    t = spark.createDataFrame([(0, 1.0), (1, 2.0)], "seed int, temperature double")
    assert reconcile.seed_ensemble(s, t, 2).first()["prob"] == pytest.approx((0.5 + 0.7310585786) / 2)
    with pytest.raises(Exception):
        reconcile.seed_ensemble(s.where("seed = 0"), t, 2).collect()
    j = reconcile.aligned({"a": e1, "b": e2.withColumnRenamed("m", "k")}, "epoch")
    assert j.count() == 1 and reconcile.key_gaps({"a": e1, "b": e2}, "epoch").collect()[0]["missing_from"] == "b"
    dec = spark.createDataFrame([("i", 1)], "image_id string, decision int")
    assert evaluate.join_decisions(dec, dec.withColumn("decision", F.lit(0))).first()["outcome"] == "first_only"


def test_digests(spark):
    df = spark.createDataFrame([("b", "22"), ("a", "11")], "image_id string, sha string")
    import hashlib

    level = {hashlib.md5(k.encode()).hexdigest()[:8]: hashlib.sha256(f"{k}:{v}\n".encode()).hexdigest() for k, v in (("a", "11"), ("b", "22"))}
    for d in (6, 4, 2, 0):
        nodes = {n[:d] for n in level}
        level = {p: hashlib.sha256("\n".join(sorted(f"{n}:{x}" for n, x in level.items() if n.startswith(p))).encode()).hexdigest() for p in nodes}
    assert audits.tree_digest(df, "image_id", "sha").first()[0] == level[""]
    assert audits.tree_digest(df, "image_id", "sha").first() == audits.tree_digest(df.repartition(5), "image_id", "sha").first()


def test_tiles(spark):
    df = spark.createDataFrame([("a", 0, 0, 10, 10), ("b", None, None, None, None)], "image_id string, x0 int, y0 int, x1 int, y1 int")
    out = tiles.with_tiles(df)
    assert out.count() == 30 and out.where("tile_label = 1").select("tile").collect()[0][0] == 0
    assert out.where("image_id = 'b' and tile_label <> 0").count() == 0
    with pytest.raises(Exception):
        tiles.with_tiles(spark.createDataFrame([("c", 5, 5, 5, 9)], df.schema)).collect()
    images = spark.createDataFrame([("a", "C1"), ("b", "C0"), ("z", "C4")], "image_id string, forgery_category string")
    assert tiles.training_tiles(images, df.where("x0 is not null")).count() == 30
    assert labelled_tiles(spark.createDataFrame([(-1,), (0,)], "label int")).count() == 1
    box = tuple(F.lit(v) for v in (10, 20, 30, 40))
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(g.scale_box(box, 0.25, 1, 2))],
                                *[c.alias(f"u{i}") for i, c in enumerate(g.union_box(box, tuple(F.lit(v) for v in (0, 25, 5, 90))))]).first()
    assert tuple(row) == (3, 7, 9, 12, 0, 20, 30, 90)


def test_readers_and_writers(spark, tiny, tmp_path):
    p = str(tmp_path)
    c = cases(spark, tiny).limit(50)
    writers.flat_manifest(c, f"{p}/flat")
    flat = readers.flat_manifest(spark, f"{p}/flat")
    assert flat.count() == 50 and len(flat.columns) == 24
    text = "﻿" + ",".join(flat.columns) + "\nx1" + "," * 23 + "\n"
    (tmp_path / "bom.csv").write_text(text, encoding="utf-8")
    assert readers.flat_manifest(spark, f"{p}/bom.csv").first()["image_id"] == "x1"
    nested = c.select("image_id", F.create_map(F.lit("name"), F.col("print_name")).alias("printed_values"), "label")
    writers.json_lines(nested, f"{p}/rows")
    assert readers.manifest(spark, f"{p}/rows").where("printed_values['name'] is null").count() == 0
    (tmp_path / "rec.jsonl").write_text('{"person_id":"P1","name_tokens":["A","B"],"extra":{"k":"v"}}\n\n{"person_id":"P2"}\n')
    assert readers.records(spark, f"{p}/rec.jsonl").count() == 2
    writers.predictions(c.select("image_id", F.col("visual").alias("decision"), "score"), f"{p}/pred")
    back = readers.predictions(spark, f"{p}/pred")
    assert dict(back.dtypes) == {"image_id": "string", "decision": "int", "score": "double"}
    (tmp_path / "bad.csv").write_text("image_id\nx\n")
    with pytest.raises(ValueError):
        readers.predictions(spark, f"{p}/bad.csv")
    header = "image_id,split,doc_type,forgery_category,label,logit,top_tile," + ",".join(f"tile{i}" for i in range(15))
    for s in (0, 1):
        (tmp_path / f"seed{s}").mkdir()
        (tmp_path / f"seed{s}" / "scores.csv").write_text(header + "\nx,val,pan,C0,0,1.5,3," + ",".join("0" for _ in range(15)) + "\n")
    assert sorted(r["seed"] for r in readers.seed_scores(spark, [f"{p}/seed0/scores.csv", f"{p}/seed1/scores.csv"]).collect()) == [0, 1]
    writers.rule_decisions(evaluate.rule_decisions(c), f"{p}/rules")
    r = readers.rule_decisions(spark, f"{p}/rules")
    assert dict(r.dtypes)["ocr_failed_checks"] == "array<string>"
    assert r.where(F.size("ocr_failed_checks") != F.col("ocr_decision")).count() == 0
    (tmp_path / "params.json").write_text('{"intercept": 1.5,\n "coef": [1, 2]}')
    assert readers.parameters(spark, f"{p}/params.json", "intercept double, coef array<double>").first()["intercept"] == 1.5
    (tmp_path / "hash.txt").write_text("# list\nabc  images/a b.jpg\n\ndef x.jpg\n")
    assert [tuple(x) for x in readers.hash_list(spark, f"{p}/hash.txt").collect()] == [("abc", "images/a b.jpg"), ("def", "x.jpg")]
    (tmp_path / "splits.json").write_text('{"P1": "train",\n "P2": "val"}')
    assert readers.split_map(spark, f"{p}/splits.json").count() == 2
    (tmp_path / "epochs.jsonl").write_text('{"epoch": 1, "val_pr_auc": 0.5}\n')
    assert readers.epochs(spark, f"{p}/epochs.jsonl").first()["val_pr_auc"] == 0.5
    (tmp_path / "tree" / "sub").mkdir(parents=True)
    (tmp_path / "tree" / "sub" / "a.bin").write_bytes(b"abc")
    f = readers.files(spark, f"{p}/tree").first()
    assert (f["file"], f["bytes"], f["sha"][:8]) == ("sub/a.bin", 3, "ba7816bf")
    rep = writers.report_rows(characterise.fpr_by_tier(c), "fpr", ["doc_type", "quality_tier"], "n", ["rate"], {"rate": ("lo", "hi")})
    writers.report([rep], f"{p}/report")
    assert spark.read.parquet(f"{p}/report").columns == ["section", "cell", "metric", "value", "lo", "hi", "n"]
    writers.report_json(characterise.totals(c), f"{p}/json")
    assert '"images":50' in spark.read.text(f"{p}/json").first()[0]
    writers.with_added_column(c.select("image_id"), "h", F.xxhash64("image_id"), f"{p}/added")
    pairs = spark.createDataFrame([(1, 2, 3, 1), (1, 3, 0, 1)], "id_a int, id_b int, distance int, n_pairs int")
    writers.candidate_pairs(pairs, f"{p}/pairs")
    writers.ensemble_and_reliability(spark.createDataFrame([("x", .25)], "image_id string, prob double"), pairs, f"{p}/ens")
    writers.fingerprint_manifest(pairs, pairs, f"{p}/fp")
    assert spark.read.option("header", True).csv(f"{p}/ens/ensemble").first()["prob"] == "0.250000"


def test_rules_on_a_stream(spark, tmp_path):
    rows = [("aadhaar", "499785203517", ""), ("pan", "ABCPZ1234K", "Ananya Shukla")]
    src = spark.createDataFrame(rows, "doc_type string, identifier string, name string")
    src.write.parquet(str(tmp_path / "in"))
    stream = validated(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")))
    q = stream.select("doc_type", "rule.overall").writeStream.format("memory").queryName("ruled").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("ruled").collect()} == {("aadhaar", "PASS"), ("pan", "FAIL")}
