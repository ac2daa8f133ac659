"""Samples by thresholds of draws: the same rows as a full order gives, and pairs without positions."""

import hashlib
import random

from pyspark.sql import functions as F

from fieldaudit.operators import positions, similarity


def test_bottom_k_equals_the_full_order(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["hot"] * 8 + ["a", "b", None])) for k in range(30_000)]
    df = spark.createDataFrame(rows, "id long, g string").repartition(7)
    for quota in ({"hot": 9_000, "a": 17, "b": 10**9}, {"hot": 0, "a": 1, "b": 2}):
        q = spark.createDataFrame(list(quota.items()), "g string, quota long")
        got = {}
        for r in positions.first_by_hash(df, "id", q, ["g"], "t").collect():
            got.setdefault(r.g, set()).add(r.id)
        for g, n in quota.items():
            order = sorted((hashlib.md5(f"42|{k}|t".encode()).hexdigest(), k) for k, h in rows if h == g)
            assert got.get(g, set()) == {k for _, k in order[:n]}, g
        assert None not in got


def test_quota_with_repeated_ids_and_empty_frames(spark):
    df = spark.createDataFrame([(5, "a")] * 40 + [(6, "a")] * 40, "id long, g string")
    q = spark.createDataFrame([("a", 50)], "g string, quota long")
    assert positions.first_by_hash(df, "id", q, ["g"], "t").count() == 50
    assert positions.first_by_hash(df.where("id < 0"), "id", q, ["g"], "t").count() == 0
    assert positions.first_by_hash(df, "id", q.where("quota < 0"), ["g"], "t").count() == 0


def test_only_the_border_is_ranked(spark):
    df = spark.range(200_000).select("id", F.lit("x").alias("g"))
    q = spark.createDataFrame([("x", 77_777)], "g string, quota long")
    out = positions.first_by_hash(df, "id", q, ["g"], "t")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 77_777 and "row_number" in plan and "rangepartitioning" not in plan


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, person_id long, document_id long, split string, h long").repartition(5)


def pairs_of(spark, n, **options):
    rng = random.Random(n)
    # The fingerprint holds the person, so a distance of zero would be a pair of one person.
    rows = [(k, (0 if k % 3 == 0 else k // 4), k // 2, rng.choice(["train", "train", "val", "other", None]), 1 << (20 + (0 if k % 3 == 0 else 1 + k // 4 % 30))) for k in range(n)]
    return {r.distance: r.n for r in similarity.cross_person_sample(frame(spark, rows), "doc_id", "h", **options).collect()}


def test_cross_person_pairs_grow_with_the_table(spark):
    small, large = sum(pairs_of(spark, 1000).values()), sum(pairs_of(spark, 4000).values())
    assert 3.4 < large / small < 4.6
    assert 0.35 < sum(pairs_of(spark, 4000, share=0.5).values()) / large < 0.65
    assert pairs_of(spark, 2000) == pairs_of(spark, 2000)
    assert pairs_of(spark, 1) == {}


def test_same_person_pairs(spark):
    rows = [(k, k // 3 if k < 300 else 1000, k // 2 if k < 300 else 5000 + k % 2, "train", k % 2 if k >= 300 else k) for k in range(900)]
    got = {r.distance: r.n for r in similarity.same_person_sample(frame(spark, rows), "doc_id", "h", tries=6).collect()}
    # The large person has two documents with codes 0 and 1: pairs of one document do not count.
    assert got.keys() <= set(range(64)) and sum(got.values()) <= 6 * 101 and 0 not in got


def test_every_pair_of_members_is_as_likely(spark):
    rows = [(k, 1, k, "train", 1 << k) for k in range(4)]
    df = frame(spark, rows).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(5999))))
    from fieldaudit.functions.draws import draw
    df = df.withColumn("u", draw(F.col("doc_id"), F.col("t"), "x"))
    got = similarity.paired_by_draw(df, ["t"], "u", ["doc_id"]).groupBy(F.least("a.doc_id", "b.doc_id"), F.greatest("a.doc_id", "b.doc_id")).count().collect()
    assert len(got) == 6 and all(850 < r["count"] < 1150 for r in got)
