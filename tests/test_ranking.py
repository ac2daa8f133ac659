import random

import pytest
from pyspark.sql import functions as F

from fieldaudit.operators import ranking as rk
from fieldaudit.operators.positions import SPLIT_CYCLE, assign_splits, balanced_sample, epoch_plan, with_position

K = ["system"]


def frame(spark, scores, labels):
    return spark.createDataFrame([("a", float(s), y) for s, y in zip(scores, labels)], "system string, score double, label int")


def counts(spark, scores, labels):
    return rk.score_counts(frame(spark, scores, labels), "label", "score", K)


def brute_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(scores, labels):
    total, out, last = sum(labels), 0.0, 0.0
    for t in sorted(set(scores), reverse=True):
        tp = sum(y for s, y in zip(scores, labels) if s >= t)
        fp = sum(1 - y for s, y in zip(scores, labels) if s >= t)
        out += (tp / total - last) * tp / (tp + fp)
        last = tp / total
    return out


@pytest.mark.parametrize("scores,labels,auc", [
    ([0, 0, 1, 1], [0, 0, 1, 1], 1.0), ([1, 1, 0, 0], [0, 0, 1, 1], 0.0), ([.5] * 4, [0, 0, 1, 1], 0.5)])
def test_auroc_vectors(spark, scores, labels, auc):
    assert rk.auroc(counts(spark, scores, labels), K).first()["auroc"] == auc


@pytest.mark.parametrize("kind", ["ties", "dense", "wide", "negative", "narrow"])
def test_against_brute_force(spark, kind):
    rng = random.Random(kind)
    draw = {"ties": lambda: rng.randrange(6), "dense": rng.random, "wide": lambda: rng.choice((-1, 1)) * 10 ** rng.uniform(-200, 200),
            "negative": lambda: -rng.random(), "narrow": lambda: 1 + rng.randrange(300) * 2.0**-52}[kind]
    scores = [draw() for _ in range(300)]
    labels = [int(rng.random() < 0.4) for _ in scores]
    c = counts(spark, scores, labels)
    assert rk.auroc(c, K).first()["auroc"] == pytest.approx(brute_auc(scores, labels), abs=1e-12)
    assert rk.average_precision(c, K).first()["pr_auc"] == pytest.approx(brute_ap(scores, labels), abs=1e-12)
    flipped = counts(spark, [-s for s in scores], labels)
    assert rk.auroc(flipped, K).first()["auroc"] == pytest.approx(1 - brute_auc(scores, labels), abs=1e-12)


@pytest.mark.parametrize("scores,labels", [([1, 2], [1, 1]), ([1, float("nan")], [0, 1]), ([1, 2], [0, 2]), ([1, float("inf")], [0, 1])])
def test_bad_input_raises(spark, scores, labels):
    with pytest.raises(Exception):
        rk.auroc(counts(spark, scores, labels), K).collect()


@pytest.mark.parametrize("scores,labels,target,want", [
    ([.1, .2, .3, .4, .9, .8], [0, 0, 0, 0, 1, 1], 0.25, (0.35, 0.25, 1.0)),
    ([.1, .2, .3, .4, .9, .8], [0, 0, 0, 0, 1, 1], 0.0, (0.6, 0.0, 1.0)),
    ([.5, .5, .5, .9], [0, 0, 1, 1], 0.5, (0.7, 0.0, 0.5)),
    ([.1, .2, .9], [0, 0, 1], 1.0, (0.1, 1.0, 1.0))])
def test_operating_point(spark, scores, labels, target, want):
    r = rk.operating_point(counts(spark, scores, labels), K, target).first()
    assert (r["threshold"], r["fpr"], r["recall"]) == pytest.approx(want)


def test_threshold_above_every_score(spark):
    r = rk.operating_point(counts(spark, [.5, .9], [1, 0]), K, 0.0).first()
    assert r["threshold"] > 0.9 and r["fpr"] == 0.0 and r["recall"] == 0.0


def test_reliability_edges(spark):
    df = spark.createDataFrame([("a", p, 1) for p in (0.0, 0.1, 0.3, 0.999, 1.0)], "system string, p double, y int")
    t = {r["bin"]: r["n"] for r in rk.reliability(df, "y", "p", K).collect()}
    edge = 2 if 0.3 < 3 * (1.0 / 10) else 3
    assert t == {b: {0: 1, 1: 1, edge: 1, 9: 2}.get(b, 0) for b in range(10)}


def test_split_cycle_is_the_deficit_rule():
    shares, have, out = {"train": 70, "val": 15, "test": 15}, {"train": 0, "val": 0, "test": 0}, []
    for n in range(1, 4001):
        pick = min(shares, key=lambda s: (-(shares[s] * n - 100 * have[s]), s))
        have[pick] += 1
        out.append(pick)
    assert out == [SPLIT_CYCLE[i % 20] for i in range(4000)]


def test_positions_with_a_hot_stratum(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("s"))
    out = with_position(df, "k", strata=["s"])
    got = out.agg(F.min("position"), F.max("position"), F.countDistinct("position")).first()
    assert tuple(got) == (0, 4999, 5000)
    assert out.groupBy("s").agg((F.max("position") - F.min("position") + 1).alias("w"), F.count("*").alias("n")).where("w <> n").count() == 0
    sizes = {r["split"]: r["count"] for r in assign_splits(df, "k", ["s"]).groupBy("split").count().collect()}
    assert sizes == {"train": 3500, "val": 750, "test": 750}


def test_balanced_sample(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    assert sorted(tuple(r) for r in balanced_sample(df, "id", "y", 500).groupBy("y").count().collect()) == [(0, 100), (1, 100)]
    assert balanced_sample(df, "id", "y", 30).count() == 60


def test_early_stop(spark):
    values = [.1, .5, .4, .5, .3, .9]
    df = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate(values)], "run string, epoch int, m double")
    assert tuple(epoch_plan(df, "m", 3).first())[1:] == (2, 5, 0.5)
    assert tuple(epoch_plan(df, "m", 10).first())[1:] == (6, 6, 0.9)
