"""Objects read by byte ranges, and files that count only when they are listed."""

import json
import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from fieldaudit.plans import stored
from fieldaudit.sources import json_object, manifested

NASTY = ['","', '":"', "\\", '\\"', '"', "}", "{", "a,b", "", "é\U0001f600", "\n", "\\\\", ':"x","y":', "[1]"]


@pytest.mark.parametrize("step", [1, 2, 3, 7, 64, 1 << 20])
def test_ranges_equal_the_whole_object(spark, tmp_path, step):
    rng = random.Random(step)
    n = 25 if step < 7 else 120
    want = {f"{k}{rng.choice(NASTY)}": rng.choice([*NASTY, None, 3, True, 2.5]) for k in range(n)}
    (tmp_path / "o.json").write_text("﻿ \n" + json.dumps(want, indent=rng.choice([None, 1]), ensure_ascii=step % 2 == 0), encoding="utf-8")
    got = json_object.json_object(spark, str(tmp_path / "o.json"), step).collect()
    told = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    assert sorted((r.key, r.value or "", r.value is None) for r in got) == sorted((k, told(v) or "", v is None) for k, v in want.items())


def test_strings_of_separators_only(spark, tmp_path):
    """No range can be told from its own bytes here."""
    text = "{" + ",".join('",":":"' for _ in range(50)) + "}"
    (tmp_path / "o.json").write_text(text)
    got = json_object.json_object(spark, str(tmp_path / "o.json"), 5).collect()
    assert len(got) == 50 and {(r.key, r.value) for r in got} == {(",", ":")}


def test_empty_and_wrong_objects(spark, tmp_path):
    for name, text in (("empty", " { } "), ("nested", '{"a": {"b": 1}}'), ("list", '{"a": [1]}'), ("none", "[1, 2]"), ("open", '{"a": "b'), ("half", '{"a": "b",')):
        (tmp_path / name).write_text(text)
    assert json_object.json_object(spark, str(tmp_path / "empty"), 2).count() == 0
    for name in ("nested", "list", "none", "open", "half"):
        with pytest.raises(Exception):
            json_object.json_object(spark, str(tmp_path / name)).collect()


def test_objects_written_and_read_over_several_tasks(spark, tmp_path):
    df = spark.range(5000).select(F.concat(F.lit('k"'), "id").alias("k"), F.when(F.col("id") % 3 > 0, F.concat(F.lit(",\\"), "id")).alias("v"))
    json_object.write_json_objects(df.repartition(3).unionByName(df.limit(0)), "k", "v", str(tmp_path / "out"))
    for f in (tmp_path / "out").glob("*.txt"):
        json.loads(f.read_text())
    back = json_object.json_object(spark, str(tmp_path / "out"), 10_000)
    assert back.select(F.spark_partition_id()).distinct().count() > 3
    assert sorted((r.key, r.value or "") for r in back.collect()) == sorted((r.k, r.v or "") for r in df.collect())


def frame(spark, n=1000):
    return spark.range(n).select("id", F.concat(F.lit("x"), F.col("id") % 7).alias("s"), F.when(F.col("id") % 5 > 0, F.col("id") / 3).alias("d"))


def test_manifest_lists_what_was_written(spark, tmp_path):
    df, path = frame(spark), str(tmp_path / "t")
    listed = manifested.write_manifested(df.repartition(4), path)
    rows = {r.file: r for r in listed.collect()}
    assert sum(r.rows for r in rows.values()) == 1000
    import hashlib
    for name, r in rows.items():
        data = (tmp_path / "t" / name).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r.bytes, r.sha)
    back = manifested.read_manifested(spark, path, df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    other = manifested.write_manifested(df.orderBy(F.desc("id")).repartition(3, "s"), str(tmp_path / "u"))
    assert manifested.totals(other).first().digest == manifested.totals(listed).first().digest
    changed = manifested.write_manifested(df.withColumn("d", F.when(F.col("id") == 3, 0.0).otherwise(F.col("d"))), str(tmp_path / "v"))
    assert manifested.totals(changed).first().digest != manifested.totals(listed).first().digest
    with pytest.raises(ValueError):
        manifested.write_manifested(df, path)


def test_a_failed_task_lists_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(Exception):
        manifested.write_manifested(frame(spark).repartition(4), path, fail_once="2")
    assert not (tmp_path / "t" / manifested.MANIFEST).exists()
    listed = manifested.write_manifested(frame(spark).repartition(4), path)
    files = list((tmp_path / "t").glob("*.parquet"))
    assert listed.count() == 4 and len(files) > 4
    assert manifested.read_manifested(spark, path, frame(spark).schema).count() == 1000


def test_empty_table(spark, tmp_path):
    listed = manifested.write_manifested(frame(spark, 0), str(tmp_path / "t"))
    assert tuple(manifested.totals(listed).first())[:3] == (0, 0, 0)
    assert manifested.read_manifested(spark, str(tmp_path / "t"), frame(spark).schema).count() == 0


def test_seed_folders_are_written_without_a_sort(spark, tiny, monkeypatch):
    """Rows of all seeds pass through open files: a task that sorts them first holds all of its rows."""
    seen, partition_by = [], DataFrameWriter.partitionBy
    monkeypatch.setattr(DataFrameWriter, "partitionBy", lambda self, *c: seen.append(int(self._spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"))) or partition_by(self, *c))
    got = stored.seed_files(spark, tiny)
    n = spark.read.parquet(f"{tiny}/events.parquet").count()
    assert seen == [stored.SEEDS] and got.count() == stored.SEEDS * n and got.select("seed").distinct().count() == stored.SEEDS
