"""Settings as rows, agreement of scores, and the checks of a re-run."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fieldaudit.operators import audits, reruns


def leaves(value, path="$"):
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in leaves(v, path + (f".{k}" if k.replace("_", "").isalnum() and k.isascii() else f'."{k}"'))]
    if isinstance(value, list) and value:
        return [x for k, v in enumerate(value) for x in leaves(v, f"{path}[{k}]")]
    return [(path, json.dumps(value, separators=(",", ":"), ensure_ascii=False))]


DEEP = {"a": {"b": [1, {"c": "x", "d": [[], {}, [True, None]]}], "e": {}}, "k.z": None, "n": 2, "s": "q é", "sp ace": {"x_1": [0]}}


def test_flattening_at_any_depth(spark):
    nested = DEEP
    for k in range(9):
        nested = {f"level{k}": [nested, k]}
    df = spark.createDataFrame([(1, json.dumps(DEEP)), (2, json.dumps(nested)), (3, None), (4, "{broken"), (5, "7"), (6, "[]")], "id int, j string").repartition(3)
    got = {}
    for r in reruns.flattened(df, ["id"], "j").collect():
        got.setdefault(r.id, []).append((r.path, r.value))
    assert {k: sorted(v) for k, v in got.items()} == {1: sorted(leaves(DEEP)), 2: sorted(leaves(nested)), 5: [("$", "7")], 6: [("$", "[]")]}
    assert reruns.flattened(df.where("id > 9"), ["id"], "j").collect() == []


def test_differences_by_path(spark):
    frame = lambda v: spark.createDataFrame([(json.dumps(v),)], "s string")
    a = {"lr": 1, "env": {"commit": "x", "host": {"n": 1}}, "environment": 1, "list": [1, 2], "same": {"x": None}}
    b = {"lr": 2, "env": {"commit": "y"}, "environment": 2, "list": [1, 2, 3], "same": {"x": None}, "new": ""}
    got = sorted(tuple(r) for r in reruns.settings_differences(frame(a), frame(b), "s", ("$.env", "$.none")).collect())
    assert got == [("$.environment", "1", "2"), ("$.list[2]", None, "3"), ("$.lr", "1", "2"), ("$.new", None, '""')]
    assert reruns.settings_differences(frame(a), frame(a), "s").count() == 0


def test_agreement(spark):
    rng = random.Random(1)
    rows = [(k, rng.random()) for k in range(200)]
    a = spark.createDataFrame(rows, "id int, s double")
    cubed = spark.createDataFrame([(k, x ** 3 if k % 2 else x) for k, x in rows if k != 7], "id int, s double")
    r = reruns.agreement(a, a.where("id <> 7"), "id", "s").first()
    assert r.n == 199 and r.identical == 199 and r.max_abs_diff == 0 and r.spearman == pytest.approx(1) and r.pearson == pytest.approx(1)
    r = reruns.agreement(a, cubed, "id", "s").first()
    assert r.identical < 120 and 0 < r.spearman < 1
    monotone = a.withColumn("s", F.pow("s", 5))
    r = reruns.agreement(a, monotone, "id", "s").first()
    assert r.spearman == pytest.approx(1) and r.pearson < 0.95


def test_checks_of_a_rerun(spark):
    none = spark.createDataFrame([], "path string, first string, second string")
    digest = lambda *d: spark.createDataFrame([(x,) for x in d], "digest string")
    metric = lambda **m: spark.createDataFrame(list(m.items()), "metric string, value double")
    seeds = metric(A=0.7).union(metric(A=0.8)).union(metric(B=0.5))
    checks = lambda s, d, rerun, again: {r.check: r.passed for r in reruns.rerun_checks(
        s, d, reruns.inside_ranges(seeds, rerun), reruns.recomputed(rerun, again)).collect()}
    good = checks(none, digest("x", "x"), metric(A=0.75, B=0.5), metric(A=0.75001, B=0.5))
    assert good == {"settings identical": True, "regions identical": True, "A in the range of the seeds": True, "B in the range of the seeds": True,
                    "stored metrics recomputed": True, "all": True}
    bad = checks(spark.createDataFrame([("$.lr", "1", "2")], none.schema), digest("x"), metric(A=0.81, C=0.5), metric(A=0.82))
    assert bad == {"settings identical": False, "regions identical": False, "A in the range of the seeds": False, "C in the range of the seeds": False,
                   "stored metrics recomputed": False, "all": False}


def test_score_table_against_its_digest_and_manifest(spark):
    m = spark.createDataFrame([(f"i{k}", "val" if k % 2 else "test", "pan", "C0", 0) for k in range(20)],
                              "image_id string, split string, doc_type string, forgery_category string, label int")
    s = m.withColumn("logit", F.substring("image_id", 2, 3).cast("double"))
    stored = audits.score_rows_digest(s)
    run = lambda table, digest=stored: {r.problem: r.n for r in audits.score_run_check(table, m, ("val", "test"), digest).collect()}
    assert run(s) == {} and run(s.repartition(7).select(*sorted(s.columns))) == {}
    assert run(s.withColumn("logit", F.col("logit") + 1e-9)) == {"digest differs": 1}
    assert run(s.withColumn("split", F.when(F.col("image_id") == "i3", "test").otherwise(F.col("split")))) == {"digest differs": 1, "split disagrees": 1}
    assert run(s.where("image_id <> 'i4'")) == {"digest differs": 1, "missing": 1}
    assert run(s, stored.where("digest is null")) == {"digest differs": 1}


def test_equal_fingerprints_count_pairs(spark):
    rows = [(1, "a")] * 3 + [(1, "b")] * 2 + [(1, None)] + [(2, "a"), (3, None), (3, None), (None, "a"), (None, "a")]
    got = sorted(tuple(r) for r in audits.equal_fingerprints(spark.createDataFrame(rows, "f long, c string"), "f", "c").collect())
    assert got == [(1, 6, 2, 15, 10, 4), (3, 2, 0, 1, 0, 0)]


def test_near_duplicate_row_does_not_gate(spark, tiny):
    from fieldaudit.sources.tables import cases
    near = spark.createDataFrame([(5,), (6,)], "n_pairs long")
    rows = {r.check: (r.violations, r.passed) for r in audits.leakage_audit(cases(spark, tiny), near).collect()}
    plain = {r.check: (r.violations, r.passed) for r in audits.leakage_audit(cases(spark, tiny)).collect()}
    assert rows.pop("near_duplicates") == (11, None) and rows == plain
