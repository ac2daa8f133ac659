import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldaudit.operators import fitting, inference
from fieldaudit.plans import inference as inference_plans


def test_holm(spark):
    df = spark.createDataFrame([("f", "a", .01), ("f", "b", .04), ("f", "c", .03), ("g", "d", .6)], "family string, comparison string, p double")
    got = {r["comparison"]: r["p_holm"] for r in inference.holm(df).collect()}
    assert got == pytest.approx({"a": .03, "b": .06, "c": .06, "d": .6})


def test_weights(spark):
    clusters = spark.range(400).select(F.col("id").alias("c"))
    w = inference.weights(clusters, "c", 50)
    total = w.groupBy("b").agg(F.sum("w").alias("s")).agg(F.avg("s"), F.count("*"), F.max("b")).first()
    assert abs(total[0] - 400) < 15 and total[1] == 50 and total[2] == 49
    shares = {r["w"]: r["n"] / (50 * 400) for r in w.groupBy("w").agg(F.count("*").alias("n")).collect()}
    assert shares[1] == pytest.approx(0.3679, abs=0.02) and shares[2] == pytest.approx(0.1839, abs=0.02)


def test_weights_do_not_depend_on_the_other_clusters(spark):
    """One rule at every size: a cluster's weights are the same in a table of 3 and of 3,000 clusters."""
    rows = lambda n: {(r["b"], r["c"]): r["w"] for r in inference.weights(spark.range(n).select(F.col("id").alias("c")), "c", 20).where("c < 3").collect()}
    assert rows(3) == rows(3000)


def test_replicate_sums_equal_joined_weights(spark):
    counts = spark.range(60).select((F.col("id") % 20).alias("c"), (F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    got = {(r["g"], r["b"]): r["v"] for r in inference.replicate_sums(counts, "c", 13, ["g"], ["v"]).collect()}
    w = inference.weights(counts, "c", 13)
    want = counts.join(w, "c").groupBy("g", "b").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    assert {k: v for k, v in got.items() if v} == {(r["g"], r["b"]): r["v"] for r in want.collect() if r["v"]} and len(got) == 39


def test_no_exchange_of_clusters_by_replicates(spark):
    counts = spark.range(60).select(F.col("id").alias("c"), F.lit(1).alias("v"))
    plan = inference.replicate_sums(counts, "c", 1000, [], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_weight_matrix_is_lane_weights(spark):
    """The weights that tasks make in arrays are those of the column form, for ids of any length and none."""
    ids = [None, "", "7", "abc", "x" * 60, *[str(i * i) for i in range(40)]]
    df = spark.createDataFrame([(i,) for i in ids], "c string")
    rows = inference.with_lanes(df.select("c", inference.draw_tail("c").alias("t")), "c", 24).collect()
    tails = sorted({r["t"] for r in rows})
    got = inference.weight_matrix([t.encode() for t in tails], range(3), 42)
    assert all(got[8 * r["_block"] + k, tails.index(r["t"])] == r[f"_w{k}"] for r in rows for k in range(8)) and len(rows) == 3 * len(ids)
    texts = np.frombuffer(b"".join(b"%055d" % i for i in range(9)), "uint8").reshape(9, 55)
    assert [x.tobytes() for x in inference.md5_all(texts)] == [hashlib.md5(t.tobytes()).digest() for t in texts]


def test_clusters_are_not_multiplied_by_blocks(spark):
    """Neither sums nor AUROC make a row per cluster and block of replicates."""
    df = spark.range(60).select(F.col("id").alias("c"), (F.col("id") % 2).cast("int").alias("y"), F.rand(1).alias("s"), F.lit("a").alias("g"), F.lit(1).alias("v"))
    for out in (inference.replicate_sums(df, "c", 1000, ["g"], ["v"]), inference.auroc_replicates(df, 1000, "c", "y", "s", ["g"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "sequence(" not in plan and "md5(" not in plan


def test_sums_keep_nulls_and_flush(spark, monkeypatch):
    """Null keys, null values (null only where all are), and sums given out in several pieces."""
    rows = [(i % 9 if i % 9 else None, i % 4 if i % 4 else None, None if i % 4 == 1 or i % 7 == 0 else i) for i in range(200)]
    df = spark.createDataFrame(rows, "c int, g int, v long")
    w = inference.with_lanes(df.select("c").distinct(), "c", 13)
    want = {(r["g"], r["_block"]): r["s"] for r in df.join(w, df["c"].eqNullSafe(w["c"])).groupBy("g", "_block").agg(F.sum(F.col("v") * F.col("_w3")).alias("s")).collect()}
    got = lambda: {(r["g"], r["_block"]): r["_v_3"] for r in inference.block_sums(df, "c", 13, ["g"], ["v"]).collect()}
    assert got() == want and want[(1, 0)] is None
    monkeypatch.setattr(inference, "SUMS_BYTES", 300)
    assert got() == want


def test_auroc_replicates_of_ties_over_many_batches(spark):
    """Hot scores that run over batches and tasks, several curves, rows without a score (below all others, in no class total)."""
    n = 20000
    df = spark.range(n).select((F.col("id") * 7 % 5 == 0).cast("int").alias("y"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"),
                               F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 3 == 0, 4.0).when(F.col("id") % 13 == 5, float("nan")).otherwise((F.col("id") * 31 % 997).cast("double") - 50).alias("s"),
                               F.col("id"))
    got = {(r["g"], r["b"]): r["value"] for r in inference.auroc_replicates(df.withColumn("c", F.col("id")), 8, "c", "y", "s", ["g"]).collect()}
    w = inference.weight_matrix([b"|%d|boot" % i for i in range(n)], range(1), 42)
    rows = [r for r in df.collect() if r["s"] is not None]
    for g in "ab":
        part, unscored = [r for r in rows if r["g"] == g], [r["id"] for r in df.where("s is null and y = 0").collect() if r["g"] == g]
        s = np.array([np.inf if np.isnan(r["s"]) else r["s"] for r in part])
        y, x = np.array([r["y"] for r in part]), w[:, [r["id"] for r in part]]
        values = np.unique(s)
        at = np.searchsorted(values, s)
        for b in range(8):
            pos, neg = (np.bincount(at, x[b] * (y == k), len(values)) for k in (1, 0))
            assert got[(g, b)] == pytest.approx((pos * (w[b, unscored].sum() + np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum()), abs=1e-12)


def test_bootstrap_skips_undefined(spark):
    df = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "c int, y int, f int")
    out = {r["metric"]: r for r in inference.bootstrap(df, "c", "y", "f", 20).collect()}
    assert out["precision"]["value"] is None and out["precision"]["n_resamples"] == 0
    assert out["recall"]["value"] == 0.0 and out["recall"]["lo"] == 0.0


def test_logistic_gradient_is_zero(spark):
    df = spark.range(500).select((F.col("id") % 17 / 8.0 - 1).alias("z"), (F.col("id") % 3 == 0).cast("double").alias("r"),
                                 ((F.col("id") * 7 % 11 + F.col("id") % 17) > 13).cast("int").alias("y"))
    m = fitting.fit_logistic(df, ["z", "r"], "y")
    s = fitting.score_with(df, m)
    g = s.agg(F.sum(F.col("fused") - F.col("y")), F.sum((F.col("fused") - F.col("y")) * F.col("z")),
              F.sum((F.col("fused") - F.col("y")) * F.col("r"))).first()
    assert abs(g[0]) < 1e-3 and abs(g[1] + m["coef"][0]) < 1e-3 and abs(g[2] + m["coef"][1]) < 1e-3


def test_temperature(spark):
    z = [2.0] * 100 + [-2.0] * 100
    y = [1] * 80 + [0] * 20 + [0] * 80 + [1] * 20
    df = spark.createDataFrame(list(zip(z, y)), "z double, y int")
    assert fitting.fit_temperature(df, "z", "y") == pytest.approx(2 / 1.3862943611, rel=1e-5)
    with pytest.raises(ValueError):
        fitting.fit_temperature(df.withColumn("y", (F.col("z") > 0).cast("int")), "z", "y")


def test_frozen_scores_refuse_their_fit_split(spark):
    p = spark.createDataFrame([(0.0, [1.0], "val")], "intercept double, coef array<double>, fit_split string")
    df = spark.createDataFrame([("test", 0.0)], "split string, z double")
    assert fitting.frozen_score(df, p, ["z"]).first()["fused"] == 0.5
    with pytest.raises(Exception):
        fitting.frozen_score(df.withColumn("split", F.lit("val")), p, ["z"]).collect()


def test_logistic_fit_of_hard_rows(spark):
    """Separated classes are held by the penalty; null rows do not count; copies weigh; one class is an error."""
    rows = [(float(x), int(x > 0)) for x in (-3, -2, -1, 1, 2, 3)] * 50 + [(None, 1), (1.0, None)]
    df = spark.createDataFrame(rows, "x double, y int")
    m = fitting.fit_logistic(df, ["x"], "y")
    w, b = m["coef"][0], m["intercept"]
    import math
    p = [1 / (1 + math.exp(-(b + w * x))) for x, y in rows[:300]]
    assert abs(sum(a - y for a, (_, y) in zip(p, rows))) < 1e-7 and abs(sum((a - y) * x for a, (x, y) in zip(p, rows)) + w) < 1e-7
    weak = fitting.fit_logistic(df, ["x"], "y", c=0.01)
    assert 0 < weak["coef"][0] < w
    with pytest.raises(ValueError):
        fitting.fit_logistic(df.where("y = 1"), ["x"], "y")


def test_sums_hold_what_the_comparisons_name(spark, tiny):
    """Cells are combinations of the subsets asked for, rows in none are left out, and rows meet by cluster once."""
    rows = [(i % 7 or None, "AB"[i % 2], "xyz"[i % 3], i % 5, 1 if i % 4 else None) for i in range(210)]
    df = spark.createDataFrame(rows, "c int, g string, h string, other int, f int")
    masks = {"a": F.col("g") == "A", "a/x": (F.col("g") == "A") & (F.col("h") == "x"), "none": F.col("h") == "w"}
    counts = inference.rate_counts(df, "c", {"s": "f"}, masks)
    assert counts.select("cell").distinct().count() == 2 and counts.agg(F.sum("den")).first()[0] == 105
    reps = inference.block_sums(counts, "c", 100, ["cell"], ["den", "k_s"])
    reps.collect()
    plan = reps._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 2 and plan.count("REPARTITION_BY_NUM") == 1
    got = {(r["mask"], r["system"]): r["value"] for r in inference.rates(counts, ["s"]).collect()}
    share = lambda some: sum(r[4] or 0 for r in some) / len(some)
    of_a = [r for r in rows if r[1] == "A"]
    assert got == {("a", "s"): pytest.approx(share(of_a)), ("a/x", "s"): pytest.approx(share([r for r in of_a if r[2] == "x"]))}
    counts, systems = inference_plans.case_counts(spark, tiny, inference_plans.DELTAS)
    assert systems == ["visual", "or_gt", "or_ocr"] and counts.columns == ["person_id", "cell", "den", "k_visual", "k_or_gt", "k_or_ocr"]
