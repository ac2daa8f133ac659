import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from conftest_llm import sentence
from fieldaudit.llm import quality


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            covered |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_counts_equal_plain_ones(docs_of, awkward):
    rows = awkward + [(100, "a b c a b c a b c", "a"), (101, "x\nx\n\n \nx \nx", "a"), (102, "# * $%&|<> a|b", "a"), (103, "a b c d a b c", "a"), (104, "q q q q", None)]
    got = Counter(tuple(r) for r in quality.judged(docs_of(rows, clash=True)).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == Counter((i, *plain_counts(t)) for i, t, _ in rows)


def plain_model(patterns, n_rules):
    """The same steps in numpy."""
    votes, n = np.array([p for p, _ in patterns]), np.array([c for _, c in patterns], float)
    logs = [(math.log(0.7), [(0.005, 0.4975, 0.4975)] * n_rules)]
    logs += [(math.log(0.3 / n_rules), [(0.9, 0.05, 0.05) if j == k else (0.1, 0.45, 0.45) for j in range(n_rules)]) for k in range(n_rules)]
    prior, chance = np.array([a for a, _ in logs]), np.log(np.array([b for _, b in logs]))

    def shares():
        fit = prior[None, :] + chance[:, np.arange(n_rules), votes].sum(2).T
        fit = np.exp(fit - fit.max(1, keepdims=True))
        return fit / fit.sum(1, keepdims=True)

    for _ in range(quality.STEPS):
        w = shares() * n[:, None]
        prior = np.log((w.sum(0) + 1) / (n.sum() + n_rules + 1))
        for v in range(3):
            chance[:, :, v] = np.log(((w.T @ (votes == v)) + 1) / (w.sum(0)[:, None] + 3))
        chance[0, :, 0] = np.minimum(chance[0, :, 0], math.log(quality.MOST_FALSE))
    return shares()[:, 0]


def test_posteriors_equal_plain_ones(spark):
    rng = random.Random(5)
    patterns = Counter(tuple(rng.choice((0, 1, 2, 2)) for _ in range(4)) for _ in range(300))
    rows = [(list(p),) for p, n in patterns.items() for _ in range(n)]
    voted = spark.createDataFrame(rows, "pattern array<int>")
    got = {tuple(r.pattern): r.posterior for r in quality.pattern_posteriors(voted, 4).collect()}
    want = plain_model(sorted(patterns.items()), 4)
    assert len(got) == len(patterns)
    for (p, _), x in zip(sorted(patterns.items()), want):
        assert abs(got[p] - x) < 1e-6


def test_kept_follows_base_and_posterior(docs_of):
    rng = random.Random(1)
    clean = [(k, ". ".join(sentence(rng, 9).capitalize() for _ in range(12)) + ".", "a") for k in range(60)]
    junk = [(100 + k, " ".join(f"{w}%%% {w}***" for w in sentence(rng, 60).split()), "a") for k in range(10)]
    short = [(200, "too short", "a"), (201, None, None), (202, "again and again " * 100, "a")]
    df = quality.judged(docs_of(clean + junk + short)).cache()
    kept = {r.doc_id for r in df.where("kept").select("row.doc_id").collect()}
    assert kept == {i for i, _, _ in clean}
    failed = {r.doc_id for r in df.where("base_failed").select("row.doc_id").collect()}
    assert failed == {200, 201, 202}
    good = quality.good_documents(docs_of(clean + junk + short, clash=True))
    assert {r.doc_id for r in good.collect()} == kept and "posterior" in good.columns


def test_empty_table(docs_of):
    assert quality.judged(docs_of([])).count() == 0


def test_labels_agree(spark, tiny):
    """Labels take no part in the model; they must agree with it on texts that pass the base."""
    labels = spark.read.parquet(f"{tiny}/../sf0.01/labels.parquet")
    df = quality.judged(spark.read.parquet(f"{tiny}/../sf0.01/documents.parquet")).where("not base_failed")
    df = df.select(F.col("row.doc_id").alias("doc_id"), "kept").join(labels, "doc_id")
    right, n = df.agg(F.sum((F.col("kept") == (F.col("quality") == 1)).cast("int")), F.count("*")).first()
    assert right >= 0.98 * n


def test_main_path_is_native(docs_of, awkward):
    plan = quality.judged(docs_of(awkward))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
