from collections import Counter

import pytest

from fieldaudit.llm import sharding as s

NAMES = [f"s{k}" for k in range(7)]


def plain_table(shards, slots):
    """The fill with whole preference lists."""
    names = sorted(shards)
    prefer = {n: [(s._hash(n, "offset") % slots + k * (s._hash(n, "skip") % (slots - 1) + 1)) % slots for k in range(slots)] for n in names}
    owner = {}
    while len(owner) < slots:
        for n in names:
            if len(owner) < slots:
                owner[next(x for x in prefer[n] if x not in owner)] = n
    return [owner[k] for k in range(slots)]


def test_table_equals_the_plain_fill():
    assert [NAMES[k] for k in s.lookup_table(NAMES, 101)] == plain_table(NAMES, 101)


def test_slots_are_shared_evenly_and_order_of_names_is_free():
    n = Counter(s.lookup_table(NAMES))
    assert max(n.values()) - min(n.values()) <= 1 and sum(n.values()) == s.SLOTS
    turned = NAMES[::-1]
    assert [NAMES[k] for k in s.lookup_table(NAMES, 211)] == [turned[k] for k in s.lookup_table(turned, 211)]


def test_few_slots_move():
    assert s.moved_slots(NAMES, NAMES[:-1]) < 0.25 * s.SLOTS
    assert s.moved_slots(NAMES, [*NAMES, "new"]) < 0.22 * s.SLOTS


def test_wrong_tables():
    for shards, slots in (([], 7), (["a", "a"], 7), (["a"], 8), ([str(k) for k in range(9)], 7)):
        with pytest.raises(ValueError):
            s.lookup_table(shards, slots)


def test_placing(docs_of, awkward):
    df = docs_of(awkward, clash=True)
    rows = s.placed(df, "doc_id", NAMES, 101).collect()
    assert len(rows) == len(awkward)
    table = s.lookup_table(NAMES, 101)
    assert all(r.shard == NAMES[table[r.slot]] for r in rows)
    assert len({r.shard for r in rows if r["row"]["doc_id"] == 8}) == 1
    assert s.placed(docs_of([]), "doc_id", NAMES).count() == 0
    assert {r.shard for r in s.placed(df, "doc_id", ["only"], 101).collect()} == {"only"}


def test_hot_source_is_spread(spark):
    n = Counter(r.shard for r in s.placed(spark.range(20_000).withColumnRenamed("id", "doc_id"), "doc_id", NAMES).collect())
    assert min(n.values()) > 0.85 * 20_000 / 7


def test_plan_is_native_and_has_no_shuffle(docs_of, awkward):
    plan = s.placed(docs_of(awkward), "doc_id", NAMES)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("Exchange RoundRobin")[0] if "RoundRobin" in plan else plan
    assert "Python" not in plan and "Exchange hashpartitioning" not in above


def test_written_shards_hold_all_rows(spark, docs_of, awkward, tmp_path):
    s.write_shards(docs_of(awkward), "doc_id", NAMES, str(tmp_path / "out"), 101)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(awkward)
