"""Fingerprint queries over embeddings and document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldaudit.functions.bits import fingerprint, fingerprint_words
from fieldaudit.operators import multiindex as wide
from fieldaudit.operators import similarity as op
from fieldaudit.operators.positions import SPLIT_CYCLE
from fieldaudit.plans import sql
from fieldaudit.sources.store import stored
from fieldaudit.sources.tables import parts_of, spread, table

# Characters whose counts make up a text's 64 values.
FEATURES = "abcdefghijklmnopqrstuvwxyz0123456789 .,;:!?-_/@#()[]éèêàçöüäßñóí"


def text_hashes(spark, d):
    """Fingerprint of each document's character counts, with capture group, person and split. Written once."""
    def build(session):
        docs = table(session, d, "documents").select("doc_id", "text")
        person = F.floor(F.col("doc_id") / 6)
        return op.character_counts(docs, "doc_id", "text", FEATURES).repartition(parts_of(docs), "doc_id").select(
            "doc_id", F.floor(F.col("doc_id") / 3).alias("document_id"), person.alias("person_id"),
            F.element_at(F.array(*[F.lit(s) for s in SPLIT_CYCLE]), (F.pmod(person, F.lit(20)) + 1).cast("int")).alias("split"),
            fingerprint(F.col("v")).alias("h"))

    return stored(spark, "text_hashes", d, build)


def text_hashes256(spark, d):
    """Fingerprints of 256 bits: the counts of the same characters in each quarter of a text. Written once."""
    def build(session):
        docs = table(session, d, "documents").select("doc_id", "text")
        counts = op.character_counts(docs, "doc_id", "text", FEATURES, 4).repartition(parts_of(docs), "doc_id")
        return counts.select("doc_id", F.when(F.get("v", F.lit(0)).isNotNull(), fingerprint_words(F.col("v"), 4)).alias("h"))

    groups = text_hashes(spark, d).select("doc_id", "document_id", "person_id", "split")
    return groups.join(stored(spark, "text_hashes256", d, build), "doc_id")


def embedding_values256(v):
    """256 values of a vector: its own, and its differences to those one, two and three places on (in a ring)."""
    n = F.size(v)
    at = lambda i: F.get(v, i.cast("int")).cast("double")
    ring = lambda s: F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(i) - at(F.pmod(i + s, n)))
    return F.concat(F.transform(v, lambda x: x.cast("double")), ring(1), ring(2), ring(3))


RADIUS256 = 16  # a sixteenth of the bits, as 4 is of 64


def bits_text(c):
    return F.lpad(F.bin(c), 64, "0")


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def vectors(spark, d):
    return spread(table(spark, d, "embeddings"), "vec_id")


def extremes(spark, d):
    df = op.with_extremes(vectors(spark, d).select("vec_id", "embedding"), "embedding", "f")
    return r6(df.select("vec_id", F.posexplode("f").alias("place", "value")), "value")


def nearest256(spark, d):
    """Every validation and test document with its nearest train fingerprint, where one lies within the radius."""
    df = text_hashes256(spark, d)
    best = wide.nearest_words(df.where("split <> 'train'"), df.where("split = 'train'"), "h", "doc_id", 4, RADIUS256)
    return df.where("split <> 'train'").join(best, "h", "left").select("doc_id", "split", "distance", "nearest")


QUERIES = {
    "fingerprint64": lambda s, d: vectors(s, d).select("vec_id", bits_text(fingerprint(F.col("embedding"))).alias("hash")),
    "text_fingerprint": lambda s, d: text_hashes(s, d).select("doc_id", "split", bits_text(F.col("h")).alias("hash")),
    "fingerprint256": lambda s, d: vectors(s, d).select("vec_id", F.array_join(F.transform(
        fingerprint_words(embedding_values256(F.col("embedding")), 4), bits_text), "").alias("hash")),
    "radius_pairs256": lambda s, d: wide.radius_pairs_words(text_hashes256(s, d), "h", "doc_id", 4, RADIUS256),
    "nearest256": lambda s, d: nearest256(s, d),
    "hamming_radius_join": lambda s, d: op.radius_pairs(text_hashes(s, d), "h", "doc_id"),
    "closest_pairs_top20": lambda s, d: op.closest_pairs(op.radius_pairs(text_hashes(s, d), "h", "doc_id")),
    "disjoint_closest_pairs": lambda s, d: op.disjoint_closest(
        op.radius_pairs(text_hashes(s, d), "h", "doc_id").where("id_a <> id_b")),
    "nearest_hash": lambda s, d: op.split_nearest(text_hashes(s, d), "h", "doc_id").select(
        "doc_id", "split", "distance", "nearest"),
    "distance_histogram": lambda s, d: op.within_group_distances(text_hashes(s, d), "document_id", "h"),
    "distance_summary": lambda s, d: r6(op.near_duplicate_summary(text_hashes(s, d), "doc_id", "h"), "p1", "median", "mean"),
    "distance_auc": lambda s, d: r6(op.near_duplicate_overlap(text_hashes(s, d), "doc_id", "h"), "separability", "overlap"),
    "ordered_extremes": extremes,
    "median_ratio": lambda s, d: r6(op.median_ratio(
        spread(table(s, d, "lineitem"), "l_orderkey").select(
            "l_returnflag", "l_linestatus",
            F.when(F.col("l_quantity") > 1, F.col("l_extendedprice") / F.col("l_quantity")).otherwise(float("nan")).alias("ratio")),
        "ratio", ["l_returnflag", "l_linestatus"]).withColumn(
        "l_linestatus", F.when(F.col("all_l_linestatus"), "ALL").otherwise(F.col("l_linestatus"))).drop("all_l_linestatus"), "median"),
}


def hash_sql(values):
    """Bits as text; ``values`` is a list expression of 64 numbers."""
    return (f"array_to_string(list_transform({values}, lambda e: case when e::double > "
            f"list_sort({values}[2:])[32]::double then '1' else '0' end), '')")


_quote = "''"
_counts = "[" + ", ".join("length(text) - length(replace(text, '" + c.replace("'", _quote) + "', ''))" for c in FEATURES) + "]"
_h = f"""hv as (select doc_id, {_counts} as v from documents),
 hs as materialized (select doc_id, doc_id // 3 as document_id, doc_id // 6 as person_id,
   {sql.texts(SPLIT_CYCLE)}[((doc_id // 6) % 20 + 1)::int] as split, {hash_sql('v')} as hash, ({hash_sql('v')})::bit as h from hv)"""
_dist = "bit_count(xor({a}, {b}))::int"
_pairs = f"""{_h}, dh as (select h, min(doc_id) as id, count(*) as n, count(*) filter (where split = 'train') as tr,
   count(*) filter (where split = 'val') as va, count(*) filter (where split = 'test') as te from hs group by 1),
 pr as (select least(a.id, b.id) as id_a, greatest(a.id, b.id) as id_b, {_dist.format(a='a.h', b='b.h')} as distance,
   case when a.h = b.h then (a.n * a.n - a.tr * a.tr - a.va * a.va - a.te * a.te) // 2
        else a.n * b.n - a.tr * b.tr - a.va * b.va - a.te * b.te end as n_pairs
   from dh a join dh b on a.h <= b.h where {_dist.format(a='a.h', b='b.h')} <= 4),
 pairs as (select * from pr where n_pairs > 0)"""


_counts256 = "[" + ", ".join(f"length({t}) - length(replace({t}, '" + c.replace("'", _quote) + "', ''))" for t in ("t0", "t1", "t2", "t3") for c in FEATURES) + "]"
_quarters = ", ".join(f"substr(text, {k} * ceil(length(text) / 4)::bigint + 1, ceil(length(text) / 4)::bigint) as t{k}" for k in range(4))


def hash256_sql(values):
    return (f"array_to_string(list_transform({values}, lambda e: case when e::double > "
            f"list_sort({values}[2:])[128]::double then '1' else '0' end), '')")


_h256 = f"""t4 as (select doc_id, {_quarters} from documents), wv as (select doc_id, {_counts256} as v from t4),
 ws as materialized (select doc_id, {sql.texts(SPLIT_CYCLE)}[((doc_id // 6) % 20 + 1)::int] as split, ({hash256_sql('v')})::bit as h from wv),
 dh as (select h, min(doc_id) as id, count(*) as n, count(*) filter (where split = 'train') as tr,
   count(*) filter (where split = 'val') as va, count(*) filter (where split = 'test') as te from ws group by 1)"""
_embedded = ("list_concat(list_transform(embedding, lambda x: x::double), " + ", ".join(
    f"list_transform(range(0, 64), lambda i: embedding[i + 1]::double - embedding[(i + {s}) % 64 + 1]::double)" for s in (1, 2, 3)) + ")")


def _d2(k1, k2, tag):
    return f"('0x' || substr(md5(concat_ws('|', '42', {k1}::varchar, {k2}::varchar, '{tag}')), 1, 15))::bigint"


_samples = f"""{_h},
 within_d as (select {_dist.format(a='a.h', b='b.h')} as distance from hs a join hs b on a.document_id = b.document_id and a.doc_id < b.doc_id),
 mt as (select *, {_d2('doc_id', 't', 'member')} as u from hs, range(0, 4) r(t)),
 same_d as (select {_dist.format(a='a.h', b='b.h')} as distance from (select arg_min(struct_pack(document_id := document_id, h := h), u) as a,
   arg_max(struct_pack(document_id := document_id, h := h), u) as b from mt group by person_id, t having count(*) > 1) where a.document_id <> b.document_id),
 ce as (select split, greatest(count(*) // 2, 1) as cells from hs group by 1),
 ct as (select hs.*, t, {_d2('doc_id', 't', 'cell')} % cells as cell, {_d2('doc_id', 't', 'cross')} as u from hs join ce using (split), range(0, 16) r(t)),
 cross_d as materialized (select {_dist.format(a='a.h', b='b.h')} as distance from (select arg_min(struct_pack(person_id := person_id, h := h), u) as a,
   arg_max(struct_pack(person_id := person_id, h := h), u) as b from ct group by split, t, cell having count(*) > 1) where a.person_id <> b.person_id),
 nn as materialized (select q.doc_id, q.split, min(struct_pack(d := {_dist.format(a='q.h', b='r.h')}, id := r.doc_id)) as m from hs q join hs r on r.split = 'train' and q.split <> 'train' group by 1, 2)"""

ORACLES = {
    "fingerprint64": f"select vec_id, {hash_sql('embedding')} as hash from embeddings",
    "text_fingerprint": f"with {_h} select doc_id, split, hash from hs",
    "hamming_radius_join": f"with {_pairs} select * from pairs",
    "fingerprint256": f"with e as (select vec_id, {_embedded} as v from embeddings) select vec_id, {hash256_sql('v')} as hash from e",
    "radius_pairs256": f"""with {_h256}, pr as (select least(a.id, b.id) as id_a, greatest(a.id, b.id) as id_b, {_dist.format(a='a.h', b='b.h')} as distance,
       case when a.h = b.h then (a.n * a.n - a.tr * a.tr - a.va * a.va - a.te * a.te) // 2
            else a.n * b.n - a.tr * b.tr - a.va * b.va - a.te * b.te end as n_pairs
       from dh a join dh b on a.h <= b.h where {_dist.format(a='a.h', b='b.h')} <= {RADIUS256}) select * from pr where n_pairs > 0""",
    "nearest256": f"""with {_h256}, n as (select q.h, min(struct_pack(d := {_dist.format(a='q.h', b='r.h')}, id := r.doc_id)) as m
       from (select distinct h from ws where split <> 'train') q join ws r on r.split = 'train' where {_dist.format(a='q.h', b='r.h')} <= {RADIUS256} group by 1)
      select doc_id, split, m.d as distance, m.id as nearest from ws left join n on ws.h = n.h where split <> 'train'""",
    "closest_pairs_top20": f"with {_pairs} select * from pairs order by distance, id_a, id_b limit 20",
    "disjoint_closest_pairs": f"""with recursive {_pairs}, o as materialized (select *, row_number() over (order by distance, id_a, id_b) as r from pairs where id_a <> id_b),
      g(k, r, used) as (select 0, 0::bigint, []::bigint[] union all
        select k + 1, n.r, list_concat(used, [n.id_a::bigint, n.id_b::bigint]) from g, lateral (select o.r, id_a, id_b from o where o.r > g.r and not list_contains(g.used, id_a)
          and not list_contains(g.used, id_b) order by o.r limit 1) n where k < 12)
      select distance, id_a, id_b from o join g using (r)""",
    "nearest_hash": f"with {_samples} select doc_id, split, m.d as distance, m.id as nearest from nn",
    "distance_histogram": f"with {_samples} select distance, count(*) as n from within_d group by 1",
    "distance_summary": f"""with {_samples}, al as (select 'within_document' as sample, distance from within_d union all select 'same_person', distance from same_d
      union all select 'cross_person', distance from cross_d union all select 'nearest_train/' || split, m.d from nn)
      select sample, count(*) as pairs, min(distance) as min, round(quantile_cont(distance::double, 0.01), 6) as p1,
        round(quantile_cont(distance::double, 0.5), 6) as median, round(avg(distance), 6) as mean, max(distance) as max from al group by 1""",
    "distance_auc": f"""with {_samples}, wh as (select distance, count(*) as n from within_d group by 1), ch as (select distance, count(*) as n from cross_d group by 1)
      select (select count(*) from hs) as rows, (select count(distinct hash) from hs) as distinct_hashes,
        round((select sum(w.n * c.n * case when c.distance > w.distance then 1.0::double when c.distance = w.distance then 0.5::double else 0.0::double end)
          / (sum(w.n * c.n)) from wh w, ch c), 6) as separability,
        round((select avg((distance <= (select median(distance) from within_d))::int::double) from cross_d), 6) as overlap""",
    "ordered_extremes": """with s as (select vec_id, list_transform(list_sort(embedding), lambda v: v::double) as v from embeddings),
      m as (select vec_id, v, (v[32] + v[33]) / 2 + 1e-6::double as med from s),
      f as (select vec_id, list_concat(list_transform(v[59:64], lambda x: x / med), list_transform(v[1:6], lambda x: x / med),
        [list_avg(v), list_stddev_pop(v), v[64] / med]) as f from m)
      select vec_id, (i - 1)::int as place, round(f[i], 6) as value from f, range(1, 16) t(i)""",
    "median_ratio": """select l_returnflag, coalesce(l_linestatus, 'ALL') as l_linestatus, count(*) as n, round(quantile_cont(l_extendedprice / l_quantity, 0.5), 6) as median
      from lineitem where l_quantity > 1 group by grouping sets ((l_returnflag), (l_returnflag, l_linestatus))""",
}
