from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldaudit.llm.common import table
from fieldaudit.llm.merkle import manifest, proof

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and the version of every document under the contract's tampering."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    df = manifest(docs, COLUMNS, "lang", "doc_id", {"text": lower}, tampered)
    folded = F.element_at("nodes", -1)
    return df.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"),
                     folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


QUERIES = {"op11_merkle": op11_merkle}


def _field(value: str) -> str:
    return f"case when {value} is null then '-' else strlen({value}::varchar)::varchar || ':' || {value}::varchar end"


def _tree(name: str, levels: int) -> str:
    """CTEs of the levels over ``{name}0`` (tree, pos, d): the runs' parents, siblings before and after, and every tree's top."""
    out = []
    for k in range(levels + 1):
        run = "partition by tree, pos // 8 order by pos rows between"
        out.append(f"""
{name}s{k} as (select *, count(*) over (partition by tree) n, coalesce(string_agg(d, '') over ({run} unbounded preceding and 1 preceding), '') a,
        coalesce(string_agg(d, '') over ({run} 1 following and unbounded following), '') z from {name}{k})""")
        if k < levels:
            out.append(f"""
{name}{k + 1} as (select tree, pos // 8 pos, sha256(string_agg(d, '' order by pos)) d from {name}s{k} where n > 1 group by all)""")
    tops = " union all ".join(f"select tree, d from {name}s{k} where n = 1" for k in range(levels + 1))
    return ",".join(out) + f",\n{name}top as ({tops})"


def _climb(rows: str, name: str, levels: int, out: str) -> str:
    """CTEs that take rows (id, tree, pos, p, f) up the tree: proof text p and folded digest f grow on every level."""
    steps, last = [], rows
    for k in range(levels):
        steps.append(f"""
{out}{k + 1} as (select r.id, r.tree, r.pos // 8 pos, case when s.n > 1 then p || a || z else p end p,
        case when s.n > 1 then sha256(a || f || z) else f end f
    from {last} r left join {name}s{k} s on r.tree = s.tree and r.pos = s.pos)""")
        last = f"{out}{k + 1}"
    return ",".join(steps)


#: Levels that the SQL unrolls: 8 ** 9 documents of a language, 8 ** 3 languages.
DEEP, FLAT = 9, 3

ORACLES = {"op11_merkle": f"""
with crc as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t),
docs as (select *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 bad from documents, crc),
l as (select doc_id, case when lang is null then '' else '+' || lang end tree, bad,
        sha256({" || ".join(map(_field, COLUMNS))}) leaf,
        sha256({" || ".join(map(_field, [*COLUMNS[:4], f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"]))}) changed from docs),
r as (select *, row_number() over (order by tree, doc_id nulls first, leaf) id,
        row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 pos from l),
t0 as (select tree, pos, leaf d from r),{_tree("t", DEEP)},
u0 as (select '' tree, row_number() over (order by tree) - 1 pos, d, tree lang_tree from ttop),{_tree("u", FLAT)},
v0 as (select id, tree, pos, '' p, case when bad then changed else leaf end f from r),{_climb("v0", "t", DEEP, "v")},
w0 as (select v.id, '' tree, u0.pos, p, f from v{DEEP} v join u0 on v.tree = u0.lang_tree),{_climb("w0", "u", FLAT, "w")}
select doc_id, leaf, ttop.d subroot, utop.d root, sha256(p) proof_sha256, f folded_root, f = utop.d verified
from r join w{FLAT} w using (id) join ttop on r.tree = ttop.tree cross join utop
"""}
