"""Weak supervision of text quality, in SQL functions only (operator 1).

Counts of a text feed ``RULES``; each rule votes good or bad, or abstains. Texts of one vote pattern are alike to the model, so
the patterns are counted (at most 3 to the number of rules) and expectation-maximisation runs over these counts as one
expression: the posterior of each pattern given the chances of each vote in each class, then the chances given the posteriors.
The classes are good texts and one kind of bad text for each rule: bad texts have different faults, and in a single bad class the
commonest fault would crowd out the others. The posterior of the good class replaces a demand that a text pass all rules.

Repeated 3-word windows are found inside the row: a set of hashes tells whether there are any, and only then the windows
are sorted with their positions. No text is ever spread over rows.

Defined cases: a null or wordless text has no words, fails the base and is not kept; empty tables give no rows; all documents
being alike gives one pattern, whose posterior is the prior; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldaudit.llm.common import keep, let

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
WIDTH = 3
STEPS = 40
#: Pseudo-counts of each vote and class.
SMOOTH = 1.0
#: A rule votes bad on at most this share of good texts. Without the bound a fault common enough could settle among the good.
MOST_FALSE = 0.01
BAD, GOOD, NONE = 0, 1, 2


def words_of(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def repeated_words(words: Column, width: int = WIDTH) -> Column:
    """Words inside windows that occur twice or more in the text."""

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(ranked: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(ranked, k)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(ranked, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

        def span(places: Column) -> Column:
            return F.aggregate(F.transform(places, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(places, k + 1) - p, F.lit(width)))),
                               F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(let(placed, again), span))

    def hashed(h: Column) -> Column:
        parts = lambda x, i: [x, *(F.get(h, i + k) for k in range(1, width))]
        return let(F.transform(F.slice(h, 1, F.greatest(F.size(h) - (width - 1), F.lit(0))), lambda x, i: F.xxhash64(*parts(x, i))), covered)

    return let(F.transform(words, lambda w: F.xxhash64(w)), hashed).cast("long")


def counts(text: Column) -> Column:
    """All that the base and the rules ask of a text, as a struct."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(words: Column) -> Column:
        times = lambda pattern: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            times(SYMBOLS).alias("n_symbols"), let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x)))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"), F.size(lines).cast("long").alias("n_lines"),
            times("[A-Z]").alias("n_capitals"), times("!").alias("n_shouts"), times(r"[.?](?=[\x20\x09-\x0D]|$)").alias("n_stops"))

    return let(words_of(text), of)


def band(value: Column, good: tuple[float, float] | None, fair: tuple[float, float]) -> Column:
    """Bad outside the second range, good inside the first, no vote between, of null, and of a rule that only finds faults."""
    bad = F.when((value < fair[0]) | (value > fair[1]), BAD)
    return (bad.when(value.between(*good), GOOD) if good else bad).otherwise(NONE)


def per(a: str, b: str) -> Callable[[Column], Column]:
    return lambda c: c[a] / F.nullif(c[b], F.lit(0).cast("long"))


#: name: (measure of the counts, range of a good vote, range outside of which the vote is bad). A rule that looks for a fault
#: abstains where it finds none: that most texts lack a given fault says nothing about the other faults.
RULES: dict[str, tuple[Callable[[Column], Column], tuple[float, float] | None, tuple[float, float]]] = {
    "symbols": (per("n_symbols", "n_words"), None, (0, 0.1)),
    "lines": (per("n_dup_lines", "n_lines"), None, (0, 0.6)),
    "repeats": (per("n_repeat_words", "n_words"), None, (0, 0.3)),
    "capitals": (per("n_capitals", "word_chars"), None, (0, 0.4)),
    "shouting": (per("n_shouts", "n_words"), None, (0, 0.15)),
    "word_length": (per("word_chars", "n_words"), (3, 9), (2, 14)),
    "sentences": (per("n_stops", "n_words"), (0.02, 0.5), (0.008, 0.8)),
}


def votes(c: Column, rules=RULES) -> Column:
    return F.array(*(band(measure(c), good, fair) for measure, good, fair in rules.values()))


def start(n_rules: int) -> Column:
    """The classes [(prior, log chance of each vote of each rule)]: good texts first, then one kind of bad text for each rule."""
    def chances(kind: int) -> list[float]:
        sure = {0: (0.005, 0.4975, 0.4975)}.get(kind)
        return [math.log(x) for j in range(n_rules) for x in (sure or ((0.9, 0.05, 0.05) if j == kind - 1 else (0.1, 0.45, 0.45)))]

    kinds = range(n_rules + 1)
    return F.array(*(F.struct(F.lit(math.log(0.7 if k == 0 else 0.3 / n_rules)).alias("prior"), F.array(*map(F.lit, chances(k))).alias("chances"))
                     for k in kinds))


def added(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def posterior(pattern: Column, model: Column) -> Column:
    """The chance of each class, given the votes."""
    fit = F.transform(model, lambda c: c["prior"] + added(F.transform(pattern, lambda v, j: F.element_at(c["chances"], (j * 3 + v + 1).cast("int")))))
    share = lambda logs: let(F.transform(logs, lambda x: F.exp(x - F.array_max(logs))), lambda e: F.transform(e, lambda x: x / added(e)))
    return let(fit, share)


def refit(patterns: Column, model: Column, n_rules: int) -> Column:
    """One step of expectation-maximisation over [(pattern, n)]: posteriors, then priors and chances by weighted counts."""

    def maximise(weighed: Column) -> Column:
        def kind(k: Column) -> Column:
            of = lambda rows: added(F.transform(rows, lambda p: p["n"] * F.element_at(p["shares"], (k + 1).cast("int")))) + SMOOTH

            def chance(cell: Column) -> Column:
                j, v = (F.floor(cell / 3) + 1).cast("int"), F.pmod(cell, F.lit(3))
                found = of(F.filter(weighed, lambda p: F.element_at(p["pattern"], j) == v)) / (of(weighed) + 2 * SMOOTH)
                return F.log(F.when((k == 0) & (v == BAD), F.least(found, F.lit(MOST_FALSE))).otherwise(found))

            everything = added(F.transform(weighed, lambda p: p["n"].cast("double"))) + (n_rules + 1) * SMOOTH
            return F.struct(F.log(of(weighed) / everything).alias("prior"),
                            F.transform(F.sequence(F.lit(0), F.lit(3 * n_rules - 1)), chance).alias("chances"))

        return F.transform(F.sequence(F.lit(0), F.lit(n_rules)), kind)

    weigh = lambda p: F.struct(p["pattern"].alias("pattern"), p["n"].alias("n"), posterior(p["pattern"], model).alias("shares"))
    return let(F.transform(patterns, weigh), maximise)


def pattern_posteriors(voted: DataFrame, n_rules: int, steps: int = STEPS) -> DataFrame:
    """(pattern, posterior) of every vote pattern in a frame with a column ``pattern``: the chance that its texts are good."""
    seen = voted.groupBy("pattern").agg(F.count("*").alias("n"))
    one = seen.agg(F.array_sort(F.collect_list(F.struct("pattern", "n"))).alias("patterns"))
    model = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start(n_rules), lambda m, _: refit(F.col("patterns"), m, n_rules))
    fitted = one.select("patterns", model.alias("model")).select(F.transform(
        "patterns", lambda p: F.struct(p["pattern"].alias("pattern"), posterior(p["pattern"], F.col("model"))[0].alias("posterior"))).alias("all"))
    return fitted.select(F.inline("all"))


def judged(docs: DataFrame, text: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """``row`` (the columns in ``carry``, or all) with the counts, base_failed, posterior and kept of every document."""
    columns = [F.col(c) for c in carry] if carry else [F.col("*")]
    df = docs.select(F.struct(*columns).alias("row"), counts(F.col(text)).alias("c"))
    df = keep(df.select("row", "c.*", votes(F.col("c")).alias("pattern")), "votes")
    fitted = pattern_posteriors(df, len(RULES))
    # A table of patterns has at most 3 ** len(RULES) rows.
    df = df.join(F.broadcast(fitted), "pattern")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def good_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, with their own columns."""
    return judged(docs, text).where("kept").select("row.*")
