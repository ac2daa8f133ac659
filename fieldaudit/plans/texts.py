"""Rules over the given texts, and ranking measures of the case table without a threshold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldaudit.functions import checkdigit
from fieldaudit.functions.fields import PASS, aadhaar_rule
from fieldaudit.operators import ranking
from fieldaudit.plans import sql
from fieldaudit.sources.tables import cases, table

ORIGINS = {"documents": ("lang", "text"), "pages": (None, "html"), "conversations": ("role", "text")}


def digit_runs(spark, d) -> DataFrame:
    """Every run of ASCII digits of the given texts: (origin, part, run)."""
    def of(name, part, text):
        rows = table(spark, d, name).select(F.lit(name).alias("origin"), (F.col(part) if part else F.lit("")).alias("part"), F.col(text).alias("text"))
        return rows.select("origin", "part", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("run"))

    return reduce(DataFrame.unionByName, [of(name, *columns) for name, columns in ORIGINS.items()])


def text_digit_rules(spark, d):
    """FN1, FN3 over given text: runs that are well formed, that carry their own check digit, that pass the rule."""
    runs = digit_runs(spark, d).where(F.length("run") >= 4)
    # Equal runs are judged once.
    counts = runs.groupBy("origin", "part", "run").agg(F.count("*").alias("n"))
    judged = counts.select("origin", "part", "n", (F.length("run") == 12).alias("formed"), checkdigit.is_consistent(F.col("run")).alias("consistent"),
                           (aadhaar_rule(F.col("run"))["overall"] == PASS).alias("passed"))
    total = lambda p: F.sum(F.when(F.col(p), F.col("n")).otherwise(0))
    return judged.groupBy("origin", "part").agg(F.sum("n").alias("runs"), total("formed").alias("formed"), total("consistent").alias("consistent"),
                                                total("passed").alias("passed"))


def threshold_free_by_category(spark, d):
    """AGG17, threshold-free part: AUROC and average precision of each forgery category, and of all, against C0.

    Rows are counted per score first; the C0 counts then take part in every curve.
    """
    cells = cases(spark, d).groupBy("forgery_category", "score").agg(F.count("*").alias("n"))
    names = ("all", "C1", "C2", "C3", "C4")
    genuine = F.col("forgery_category") == "C0"
    curves = F.when(genuine, F.array(*map(F.lit, names))).otherwise(F.array(F.lit("all"), F.col("forgery_category")))
    rows = cells.select(F.explode(curves).alias("category"), "score", F.when(genuine, 0).otherwise(F.col("n")).alias("pos"),
                        F.when(genuine, F.col("n")).otherwise(0).alias("neg"))
    counts = rows.groupBy("category", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    both = ranking.auroc(counts, ["category"]).join(ranking.average_precision(counts, ["category"]), "category")
    return both.select("category", "n_pos", "n_neg", F.round("auroc", 6).alias("auroc"), F.round("pr_auc", 6).alias("pr_auc"))


QUERIES = {"text_digit_rules": text_digit_rules, "threshold_free_by_category": threshold_free_by_category}

_runs = " union all ".join(
    f"select '{name}' as origin, {part or repr('')} as part, unnest(regexp_extract_all({text}, '[0-9]+')) as run from {name}" for name, (part, text) in ORIGINS.items())

ORACLES = {
    "text_digit_rules": f"""with r as (select * from ({_runs}) where length(run) >= 4),
      j as (select origin, part, length(run) = 12 as formed, {sql.verhoeff_product('run', 'length(run)')} = 0 as consistent from r)
      select origin, part, count(*) as runs, sum(formed::int)::bigint as formed, sum(consistent::int)::bigint as consistent,
        sum((formed and consistent)::int)::bigint as passed from j group by 1, 2""",
    "threshold_free_by_category": sql.with_(sql.cases()) + """, k as (select unnest(['all', 'C1', 'C2', 'C3', 'C4']) as category),
      c as (select category, score, sum(label)::double as pos, sum(1 - label)::double as neg from cases, k
        where forgery_category = 'C0' or category = 'all' or forgery_category = category group by 1, 2),
      t as (select *, sum(pos) over (partition by category) as p, sum(neg) over (partition by category) as q,
        sum(neg) over (partition by category order by score) - neg as below,
        sum(pos) over (partition by category order by score desc) as tp, sum(neg) over (partition by category order by score desc) as fp from c)
      select category, any_value(p)::bigint as n_pos, any_value(q)::bigint as n_neg, round(sum(pos * (below + neg / 2)) / any_value(p * q), 6) as auroc,
        round(sum(pos / p * (tp / (tp + fp))), 6) as pr_auc from t group by 1""",
}
