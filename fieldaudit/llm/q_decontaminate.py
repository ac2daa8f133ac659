from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldaudit.llm.common import table
from fieldaudit.llm.decontaminate import contaminated, digest


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark, by windows of 10 words."""
    df = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return df.select("row.doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"),
                     digest(F.col("found.items")).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"))


QUERIES = {"op2_decontaminate": op2_decontaminate}

ORACLES = {"op2_decontaminate": r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item_id, least(len(w), 10) k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') g
       from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) i from b where len(w) > 0)),
dw as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') g
       from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from w, (select distinct k from bw))),
h as (select doc_id, i, dw.k, item_id from dw join bw on dw.k = bw.k and dw.g = bw.g),
p as (select doc_id, count(distinct pos)::bigint n_hit from (select doc_id, unnest(range(i, i + k)) pos from h) group by 1),
q as (select doc_id, count(*)::bigint n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) ids
      from (select distinct doc_id, item_id from h) group by 1)
select w.doc_id, len(w.w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from w left join p using (doc_id) left join q using (doc_id)
"""}
