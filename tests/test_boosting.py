"""Boosted trees against a plain version that tries every cut, and the probe's row against SQL over its scores."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldaudit.operators import boosting
from fieldaudit.plans import fitting


def rows_of(n, seed, width=4, distinct=12):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x = [float(rng.randrange(distinct)) for _ in range(width)]
        out.append((k, x, int(x[0] > 5) ^ int(x[1] > 7) if rng.random() < 0.9 else rng.randrange(2)))
    return out


def plain_fit(rows, rounds, leaves, rate=0.1):
    """Probabilities of the rows after so many rounds; plain lists, every cut of every leaf tried anew."""
    x, y = [r[1] for r in rows], [r[2] for r in rows]
    share = sum(y) / len(y)
    raw = [math.log(share / (1 - share))] * len(y)
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-v)) for v in raw]
        g, h = [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p]
        add = lambda of, ids: sum(of[i] for i in ids)
        tree = [list(range(len(y)))]

        def best(ids):
            found = None
            for f in range(len(x[0])):
                for at in sorted({x[i][f] for i in range(len(x))}):
                    a, b = [i for i in ids if x[i][f] <= at], [i for i in ids if x[i][f] > at]
                    if min(len(a), len(b)) < 20 or min(add(h, a), add(h, b)) < 1e-3:
                        continue
                    more = add(g, a) ** 2 / add(h, a) + add(g, b) ** 2 / add(h, b) - add(g, ids) ** 2 / add(h, ids)
                    if more > 1e-9 and (found is None or round(more, 9) > round(found[0], 9)):
                        found = more, a, b
            return found

        cuts = [best(tree[0])]
        while len(tree) < leaves and any(cuts):
            k = max((k for k in range(len(tree)) if cuts[k]), key=lambda k: round(cuts[k][0], 9))
            _, a, b = cuts[k]
            tree[k:k + 1] = []
            cuts[k:k + 1] = []
            tree += [a, b]
            cuts += [best(a), best(b)]
        for ids in tree:
            for i in ids:
                raw[i] -= rate * add(g, ids) / add(h, ids)
    return [1 / (1 + math.exp(-v)) for v in raw]


@pytest.mark.parametrize("leaves, rounds, task_rows", [(2, 3, 20_000), (6, 4, 20_000), (5, 2, 100)])
def test_equals_the_plain_version(spark, monkeypatch, leaves, rounds, task_rows):
    monkeypatch.setattr(boosting, "TASK_ROWS", task_rows)
    rows = rows_of(400, leaves)
    df = spark.createDataFrame(rows, "id long, x array<double>, y int").repartition(3)
    model = boosting.fit(df, "x", "y", rounds=rounds, leaves=leaves)
    got = [r.prob for r in boosting.scored(df, model, "x").orderBy("id").collect()]
    assert np.allclose(got, plain_fit(rows, rounds, leaves), atol=1e-9)
    assert all(sum(f < 0 for f in t.feature) <= leaves for t in model.trees) and max(sum(f < 0 for f in t.feature) for t in model.trees) == leaves


def test_partitions_and_written_scores_do_not_matter(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(900, 9), "id long, x array<double>, y int")
    one = boosting.fit(df.repartition(1), "x", "y", rounds=5, leaves=5)
    monkeypatch.setattr(boosting, "TASK_ROWS", 100)
    monkeypatch.setattr(boosting, "WRITE_ROUNDS", 2)
    many = boosting.fit(df.repartition(9), "x", "y", rounds=5, leaves=5)
    x = np.array([r[1] for r in rows_of(900, 9)])
    assert [(t.feature, t.bin, t.left) for t in one.trees] == [(t.feature, t.bin, t.left) for t in many.trees]
    assert np.allclose(one.raw(x), many.raw(x), atol=1e-9)


def test_rounds_lower_the_loss(spark):
    rows = rows_of(600, 3)
    df = spark.createDataFrame(rows, "id long, x array<double>, y int")
    model = boosting.fit(df, "x", "y", rounds=40, leaves=8)
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    loss = []
    for k in (0, 5, 20, 40):
        p = 1 / (1 + np.exp(-boosting.Model(model.borders, model.start, model.trees[:k]).raw(x)))
        loss.append(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    assert loss == sorted(loss, reverse=True) and loss[-1] < 0.6 * loss[0]


def test_odd_rows(spark):
    rows = [(k, [1.0, float("nan") if k % 3 else float(k % 10)], k % 2) for k in range(100)] + [(200, None, 1), (201, [1.0, None], None)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int")
    model = boosting.fit(df, "x", "y", rounds=2, leaves=3)
    out = {r.id: r.prob for r in boosting.scored(df, model, "x").collect()}
    assert out[200] is None and 0 < out[201] < 1 and len(out) == 102
    one_class = boosting.fit(df.where("y = 1"), "x", "y", rounds=5)
    assert [t.feature for t in one_class.trees] == [[-1]]
    few = boosting.fit(df.where("id < 30"), "x", "y", rounds=5)
    assert [t.feature for t in few.trees] == [[-1]]
    with pytest.raises(ValueError):
        boosting.fit(df.where("id < 0"), "x", "y")
    with pytest.raises(ValueError):
        boosting.fit(df.withColumn("x", F.when(F.col("id") == 5, F.array(F.lit(1.0))).otherwise(F.col("x"))), "x", "y")


def test_probe_row_against_sql_over_its_scores(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(boosting, "ROUNDS", 3)
    fit = boosting.fit
    monkeypatch.setattr(boosting, "fit", lambda df, f, y: fit(df, f, y, rounds=3))
    d = "/root/testdata/sf0.01"
    fitting.probe_scores(spark, d).write.parquet(str(tmp_path / "scores"))
    got = fitting.tree_probe(spark, d).first().asDict()
    sql = f"""with s as (select label, prob, rank() over (order by prob) + (count(*) over (partition by prob) - 1) / 2 r from '{tmp_path}/scores/*.parquet')
      select (sum(r) filter (where label = 1) - count(*) filter (where label = 1) * (count(*) filter (where label = 1) + 1) / 2)
          / (count(*) filter (where label = 1) * count(*) filter (where label = 0)) auroc,
        (avg((prob > 0.5)::int) filter (where label = 1) + avg((prob <= 0.5)::int) filter (where label = 0)) / 2 accuracy, count(*) n from s"""
    auroc, accuracy, n = duckdb.sql(sql).fetchall()[0]
    assert n > 200 and 0 < auroc < 1
    values = [v for v in got.values() if isinstance(v, float)]
    assert any(abs(v - auroc) < 1e-5 for v in values) and any(abs(v - accuracy) < 1e-5 for v in values), (got, auroc, accuracy)
