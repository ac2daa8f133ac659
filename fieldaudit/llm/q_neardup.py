from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldaudit.llm.common import table
from fieldaudit.llm.neardup import near_duplicates


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document, at 85 % shared 5-word shingles."""
    df = near_duplicates(table(spark, sf_dir, "documents"))
    return df.select(F.col("key").alias("doc_id"), "n_shingles", "component_id",
                     F.when(F.col("key").isNull(), F.col("stays")).otherwise(F.col("key") == F.col("component_id")).alias("kept"))


QUERIES = {"op4_near_duplicates": op4_near_duplicates}

ORACLES = {"op4_near_duplicates": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end g
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from w where len(w) > 0)),
n as (select doc_id, count(*)::bigint n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) both_have from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * both_have >= 85 * (x.n + y.n - both_have)),
r as (select doc_id, doc_id other from n union select r.doc_id, l.b from r join l on l.a = r.other),
c as (select doc_id, min(other) component_id from r group by 1)
select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(component_id, w.doc_id) component_id,
       w.doc_id = coalesce(component_id, w.doc_id) kept
from w left join n using (doc_id) left join c using (doc_id)
"""}
