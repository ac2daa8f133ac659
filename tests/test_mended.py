"""Cases that once gave wrong or switching results: repeated ids and seeds, null group values, continuous medians."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from fieldaudit.operators import audits, characterise, evaluate, masks, reconcile, similarity
from fieldaudit.operators.positions import balanced_sample


def test_faults_of_all_rows_of_a_repeated_id(spark):
    pred = spark.createDataFrame([("a", 0, 0.1), ("a", 2, float("nan")), ("b", 1, 0.5)], "image_id string, decision int, score double")
    manifest = spark.createDataFrame([(i, 0, "test", "C0", "pan") for i in "ab"], "image_id string, label int, split string, forgery_category string, doc_type string")
    got = {(r.image_id, r.problem) for r in reconcile.coverage_problems(pred, manifest, "test", ("C0",)).collect()}
    assert got == {("a", "duplicate id"), ("a", "decision not 0 or 1"), ("a", "score not finite")}


def test_shared_columns_of_a_repeated_id(spark):
    pred = spark.createDataFrame([("a", 0, "pan"), ("a", 0, "aadhaar"), ("b", 0, None)], "image_id string, decision int, doc_type string")
    manifest = spark.createDataFrame([(i, 0, "test", "C0", "pan") for i in "ab"], "image_id string, label int, split string, forgery_category string, doc_type string")
    got = {(r.image_id, r.problem) for r in reconcile.coverage_problems(pred, manifest, "test", ("C0",)).collect()}
    assert got == {("a", "duplicate id"), ("a", "doc_type disagrees"), ("b", "doc_type disagrees")}


def test_a_repeated_seed_is_an_error(spark):
    t = spark.createDataFrame([(0, 1.0), (1, 1.0)], "seed int, temperature double")
    s = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 1.0), ("a", 1, 0.0)], "image_id string, seed int, logit double")
    with pytest.raises(Exception, match="repeats one"):
        reconcile.seed_ensemble(s, t, 2).collect()


def test_null_values_are_not_the_total(spark):
    rows = [("pan", "C0", None, 0, 0, 0), ("pan", "C0", "clean", 0, 1, 0), ("pan", "C0", None, 0, 0, 1)]
    df = spark.createDataFrame(rows, "doc_type string, forgery_category string, quality_tier string, label int, rule_gt int, rule_ocr int")
    n = {r.quality_tier: r.n for r in characterise.composition(df).collect()}
    assert n == {None: 2, "clean": 1, "ALL": 3}
    assert {r.quality_tier: r.n for r in characterise.flips_all_tier(df).collect()} == {None: 2, "clean": 1, "all": 3}
    assert {r.quality_tier: r.n for r in characterise.fpr_by_tier(df).collect()} == {None: 2, "clean": 1, "ALL": 3}
    two = df.withColumns({"expected_rule": F.lit("FAIL"), "v": F.lit("FAIL"), "doc_type": F.lit(None).cast("string")})
    got = sorted((str(r.doc_type), str(r.forgery_category), r.n) for r in evaluate.rule_metrics(two, {"gt": "v"}).collect())
    assert got == [("None", "all", 3), ("all", "C0", 3), ("all", "all", 3)]


def test_continuous_median(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice(("x", "y", None)), rng.random() * 1e6 if k % 50 else float("nan")) for k in range(4001)]
    got = {(r.g, r.h, r.all_h): (r.n, r.median) for r in similarity.median_ratio(spark.createDataFrame(rows, "g string, h string, v double"), "v", ["g", "h"]).collect()}
    for g in "ab":
        for h in ("x", "y", None):
            v = [x for a, b, x in rows if a == g and b == h and x == x]
            assert got[(g, h, False)] == (len(v), pytest.approx(statistics.median(v)))
        v = [x for a, _, x in rows if a == g and x == x]
        assert got[(g, None, True)] == (len(v), pytest.approx(statistics.median(v)))


def test_digest_of_rows_does_not_depend_on_their_number(spark):
    """The digest of a table is that of its rows: splitting it differently or adding partitions changes nothing."""
    df = spark.range(300).select("id", F.sha2(F.col("id").cast("string"), 256).alias("sha"))
    a, b = audits.tree_digest(df, "id", "sha").first(), audits.tree_digest(df.repartition(7), "id", "sha").first()
    assert a == b and a.n == 300
    assert audits.tree_digest(df.where("id < 299"), "id", "sha").first().digest != a.digest


def test_balanced_sample_has_no_bound_of_its_own(spark):
    df = spark.range(6000).select("id", F.pmod("id", F.lit(2)).alias("y"))
    assert balanced_sample(df, "id", "y").count() == 6000 and balanced_sample(df, "id", "y", 10).count() == 20


def test_subsets_are_the_named_ones():
    names = set(masks.case_masks())
    assert len(names) == 45 and {"forged/pan", "c0/aadhaar/severe", "pan/C2", "C4", "eligible", "c1_fine", "c1/mild"} <= names


def test_rows_with_text(spark):
    df = spark.createDataFrame([({"a": "1"},), ({},), (None,)], "m map<string, string>")
    assert df.where(masks.has_text("m")).count() == 1


def test_every_catalog_query_has_sql_or_is_named():
    import check
    from fieldaudit.plans import catalog

    assert set(catalog.QUERIES) - set(catalog.ORACLES) == set(check.ROWS_ONLY)


def test_median_exchanges_narrow_cells(spark):
    """Infinite values take their place in the order, and values meet the cells found without a sort or a second exchange of the rows."""
    inf = float("inf")
    rows = [("a", "x", -inf), ("a", "x", 1.0), ("a", "x", 2.0), ("a", "y", inf), ("a", "y", 1e300), ("a", "y", -1e300), (None, "x", 0.0), (None, "x", -0.0)]
    out = similarity.median_ratio(spark.createDataFrame(rows, "g string, h string, v double").repartition(3, "v"), "v", ["g", "h"])
    got = {(r.g, r.h, r.all_h): (r.n, r.median) for r in out.collect()}
    assert got == {("a", "x", False): (3, 1.0), ("a", "y", False): (3, 1e300), ("a", None, True): (6, 1.5), (None, "x", False): (2, 0.0), (None, None, True): (2, 0.0)}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" not in plan and plan.count("ReusedExchange") + plan.count("ResultQueryStage") >= 2
