from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldaudit.llm.common import table
from fieldaudit.llm.mixing import mix


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents: sources weigh 5, 2, 1 and share 150 % of all words, at most twice their own."""
    return mix(table(spark, sf_dir, "documents")).select("row.doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "copies")


QUERIES = {"op7_mixing": op7_mixing}

ORACLES = {"op7_mixing": r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size from documents),
s0 as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 place from d group by source),
s1 as (select *, [5.0, 2.0, 1.0][(place % 3 + 1)::int]::double weight, source_size * 2.0::double cap,
         1.5::double * sum(source_size) over () total from s0),
s2 as (select *, (total - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
         / nullif(sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following), 0) need from s1),
s as (select source, source_size, coalesce(least(cap, max(need) over () * weight), 0.0) target from s2),
c0 as (select s.source, s.target, s.source_size, d.size, count(*) n from d join s on d.source is not distinct from s.source
         where size > 0 group by all),
c1 as (select *, (target - coalesce(sum(2.0::double * n * size) over (partition by source order by size desc rows between unbounded preceding and 1 preceding), 0.0))
         / sum(n * size * sqrt(size)) over (partition by source order by size desc rows between current row and unbounded following) need from c0),
c as (select source, any_value(target) target, any_value(source_size) source_size, max(need) scale from c1 group by source),
e as (select d.*, c.target, c.source_size, case when c.target >= 2.0::double * c.source_size then 2.0::double
         else least(2.0::double, c.scale * sqrt(d.size)) end expected,
         (('0x' || substr(md5('mix|' || doc_id), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double u
       from d join c on d.source is not distinct from c.source where d.size > 0),
p as (select *, floor(expected)::bigint whole, expected - floor(expected) p from e),
r as (select *, target - sum(whole * size) over (partition by source) left_over,
         case when p > 0 then u * (1 - p) / (u * (1 - p) + (1 - u) * p) end rank from p),
t as (select *, sum(case when rank is null then 0 else size end) over (partition by source order by rank nulls last, doc_id, size
         rows between unbounded preceding and current row) upto from r),
k as (select doc_id, size, source_size, target, whole + (rank is not null and upto - size / 2.0::double <= left_over)::bigint copies from t)
select doc_id, size, source_size, round(target, 6) target, copies * size taken, copies from k
union all
select d.doc_id, d.size, s.source_size, round(s.target, 6), 0, 0 from d join s on d.source is not distinct from s.source where d.size = 0
"""}
