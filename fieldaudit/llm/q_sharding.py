from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldaudit.llm.common import table
from fieldaudit.llm.sharding import lookup_table, placed

SHARDS = tuple(f"shard-{k:03d}" for k in range(256))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    df = placed(table(spark, sf_dir, "documents"), "doc_id", SHARDS)
    return df.select("row.doc_id", F.col("slot").cast("long").alias("slot"), "shard")


QUERIES = {"op3_sharding": op3_sharding}


def _oracle() -> str:
    owners = ",".join(map(str, lookup_table(SHARDS)))
    return f"""
with t as (select string_split('{owners}', ',') owners),
d as (select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, chr(0) || 'null')), 1, 15))::bigint % {65537} slot from documents)
select doc_id, slot, 'shard-' || lpad(owners[(slot + 1)::int], 3, '0') shard from d, t"""


ORACLES = {"op3_sharding": _oracle()}
