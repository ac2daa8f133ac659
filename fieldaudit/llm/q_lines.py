from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldaudit.llm.common import table
from fieldaudit.llm.lines import line_repeats


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and the digest of what is left of every document."""
    df = line_repeats(table(spark, sf_dir, "documents"))
    return df.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op13_line_dedup": op13_line_dedup}

ORACLES = {"op13_line_dedup": """
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i
           from documents),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l),
r as (select key, max(doc_id) last from k where length(key) >= 20 group by 1 having count(distinct doc_id) >= 3),
d as (select k.*, r.key is not null and doc_id is distinct from last gone from k left join r on k.key = r.key)
select doc_id, count(*)::bigint n_lines, count(*) filter (where gone)::bigint n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) kept_sha256
from d group by 1
"""}
