import random
import statistics

import pytest
from pyspark.sql import functions as F

from fieldaudit.functions.bits import fingerprint, fingerprint_words, hamming_words
from fieldaudit.operators import similarity as sim

SPLITS = ("train", "val", "test")


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def planted(n=300, seed=3):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 6)]
    rows = []
    for i in range(n):
        h = rng.choice(base) if rng.random() < 0.7 else base[0]
        for _ in range(rng.choice((0, 0, 1, 2, 4, 5, 9))):
            h ^= 1 << rng.randrange(64)
        rows.append((i, signed(h), rng.choice(SPLITS)))
    return rows


def d(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


@pytest.mark.parametrize("radius,blocks", [(4, 6), (4, 5), (3, 6), (0, 1)])
def test_radius_join_counts_every_pair(spark, monkeypatch, radius, blocks):
    monkeypatch.setattr(sim, "SALT_ROWS", 10)  # hot bands must split
    rows = planted()
    df = spark.createDataFrame(rows, "id int, h long, split string")
    out = sim.radius_pairs(df, "h", "id", radius, blocks).collect()
    want = {}
    for i, a, s in rows:
        for j, b, t in rows:
            if i < j and s != t and d(a, b) <= radius:
                want[d(a, b)] = want.get(d(a, b), 0) + 1
    got = {}
    for r in out:
        got[r["distance"]] = got.get(r["distance"], 0) + r["n_pairs"]
    assert got == want
    assert len({(r["id_a"], r["id_b"]) for r in out}) == len(out)


@pytest.mark.parametrize("limit", [10_000, 0])
def test_nearest(spark, limit):
    rows = planted(200)
    df = spark.createDataFrame(rows, "id int, h long, split string")
    refs, queries = df.where("split = 'train'"), df.where("split <> 'train'")
    got = {r["h"]: (r["distance"], r["nearest"]) for r in sim.nearest(queries, refs, "h", "id", array_limit=limit).collect()}
    train = [(i, h) for i, h, s in rows if s == "train"]
    want = {h: min((d(h, r), i) for i, r in train) for _, h, s in rows if s != "train"}
    assert got == want


def test_within_group_counts_copies(spark):
    df = spark.createDataFrame([("g", 5), ("g", 5), ("g", 4), ("k", 1)], "g string, h long")
    assert sorted(tuple(r) for r in sim.within_group_distances(df, "g", "h").collect()) == [(0, 1), (1, 2)]


def test_summary_of_weighted_histogram(spark):
    df = spark.createDataFrame([(1, 3), (5, 1)], "distance int, n long")
    r = sim.distance_summary(df).first()
    assert (r["pairs"], r["min"], r["median"], r["mean"], r["max"]) == (4, 1, 1.0, 2.0, 5)


def test_disjoint_pairs(spark):
    df = spark.createDataFrame([(1, 2, 0, 1), (2, 3, 1, 1), (3, 4, 2, 1)], "id_a int, id_b int, distance int, n_pairs int")
    out = sim.disjoint_closest(df).collect()
    ends = [e for r in out for e in (r["id_a"], r["id_b"])]
    assert (out[0]["id_a"], out[0]["id_b"]) == (1, 2) and len(ends) == len(set(ends))


def test_wide_fingerprint(spark):
    v = [float((i * 37) % 101) for i in range(256)]
    df = spark.createDataFrame([(v,)], "v array<double>").select(fingerprint_words(F.col("v"), 4).alias("w"), fingerprint(F.slice("v", 1, 64)).alias("h"))
    r = df.first()
    t = sorted(v[1:])[127]
    want = [signed(int("".join("1" if x > t else "0" for x in v[i:i + 64]), 2)) for i in range(0, 256, 64)]
    assert list(r["w"]) == want
    assert df.select(hamming_words(F.col("w"), F.transform("w", lambda x: x.bitwiseXOR(F.lit(1).cast("long"))), 4)).first()[0] == 4


@pytest.mark.parametrize("seed, limit", [(1, 12), (2, 5), (3, 1000), (4, 1)])
def test_disjoint_pairs_equal_the_sequential_pass(spark, seed, limit):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(300)} | {(k, k + 1) for k in range(100, 130)}
    rows = [(a, b, k if a >= 100 else rng.randrange(4), 1) for k, (a, b) in enumerate(sorted(pairs))]
    taken, used = [], set()
    for a, b, d_, _ in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if len(taken) < limit and not {a, b} & used:
            taken.append((d_, a, b))
            used |= {a, b}
    df = spark.createDataFrame(rows, "id_a int, id_b int, distance int, n_pairs int").repartition(4)
    assert [(r.distance, r.id_a, r.id_b) for r in sim.disjoint_closest(df, limit).collect()] == taken


def test_no_pairs(spark):
    df = spark.createDataFrame([], "id_a int, id_b int, distance int, n_pairs int")
    assert sim.disjoint_closest(df).collect() == []


def test_character_counts_are_those_of_replacing(spark, monkeypatch):
    """Counts in one pass equal what a text loses when a character is taken out, in every stretch; the scan is not dealt out first."""
    monkeypatch.setattr(sim, "CHARACTERS", 20)
    texts = ["", None, "abc é aéa", "ñ" * 7, "a😀b" * 5, "x", "aaa bbb ccc ddd eee", "é"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(2)
    for stretches in (1, 4):
        got = {r.id: r.v for r in sim.character_counts(df, "id", "t", "abé ñ", stretches).collect()}
        for k, t in enumerate(texts):
            each = -(-len(t or "") // stretches)
            parts = [(t or "")[each * s:each * (s + 1)] for s in range(stretches)]
            assert got[k] == [None if t is None else p.count(c) for p in parts for c in "abé ñ"], (k, stretches)
    plan = sim.character_counts(df.coalesce(1), "id", "t", "ab")._jdf.queryExecution().executedPlan().toString()
    assert "replace(" not in plan


def test_threshold_is_computed_once_a_row(spark):
    rng = random.Random(13)
    values = [[rng.randrange(9) for _ in range(n)] for n in (256, 256, 200, 64, 3)] + [None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v array<int>")
    out = df.select("k", "v", fingerprint_words(F.col("v"), 4).alias("h"), fingerprint(F.slice("v", 1, 64)).alias("one"))
    for column in ("h", "one"):
        assert out.select(column)._jdf.queryExecution().optimizedPlan().toString().count("sort_array(") == 1
    plain = lambda part, t: signed(sum((x > t) << (len(part) - 1 - i) for i, x in enumerate(part)))
    for r in out.collect():
        if r.v is None:
            assert r.h == [None] * 4 and r.one is None
        else:
            assert r.h == [plain(r.v[64 * w:64 * w + 64], statistics.median(r.v[1:])) for w in range(4)]
            assert r.one == plain(r.v[:64], statistics.median(r.v[1:64]))
