import random

import pytest
from pyspark.sql import functions as F

from fieldaudit.functions import checkdigit, fields, measures
from fieldaudit.functions.registry import register

AADHAAR = [
    ("499785203517", "PASS", "PASS", "PASS"), ("499786203517", "PASS", "FAIL", "FAIL"),
    ("49978520351", "FAIL", "SKIPPED", "FAIL"), ("789456123005", "PASS", "PASS", "PASS"),
    ("4997B5203517", "FAIL", "SKIPPED", "FAIL"), ("", "FAIL", "SKIPPED", "FAIL"), (None, "FAIL", "SKIPPED", "FAIL"),
    ("499785203517\n", "FAIL", "SKIPPED", "FAIL"), ("49978520351²", "FAIL", "SKIPPED", "FAIL"),
]
PAN = [
    ("ABCPS1234K", "Ananya Shukla", "PASS", "PASS", "PASS", "PASS", "PASS"),
    ("ABCPZ1234K", "Ananya Shukla", "PASS", "PASS", "FAIL", "FAIL", "FAIL"),
    ("ABCXS1234K", "Ananya Shukla", "PASS", "FAIL", "SKIPPED", "SKIPPED", "FAIL"),
    ("ABCCS1234K", "Shukla Traders Private Limited", "PASS", "PASS", "PASS", "PASS", "PASS"),
    ("ABCCZ1234K", "Shukla Traders Private Limited", "PASS", "PASS", "FAIL", "FAIL", "FAIL"),
    ("ABCPS1234K", "", "PASS", "PASS", "SKIPPED", "SKIPPED", "PASS"),
    ("ABCPS1234K", None, "PASS", "PASS", "SKIPPED", "SKIPPED", "PASS"),
    ("ABCPV1234K", "V. Lakshmi", "PASS", "PASS", "PASS", "FAIL", "PASS"),
    ("ABCPL1234K", "V. Lakshmi", "PASS", "PASS", "PASS", "PASS", "PASS"),
    ("ABCPS1234K", "Smt. Ananya Shukla", "PASS", "PASS", "PASS", "PASS", "PASS"),
    ("ABCPR1234K", "Rajesh", "PASS", "PASS", "PASS", "PASS", "PASS"),
    ("ABCPS1234", "Rajesh", "FAIL", "SKIPPED", "SKIPPED", "SKIPPED", "FAIL"),
    ("A2CPS1234K", "Rajesh", "FAIL", "SKIPPED", "SKIPPED", "SKIPPED", "FAIL"),
    ("ABCPSI234K", "Rajesh", "FAIL", "SKIPPED", "SKIPPED", "SKIPPED", "FAIL"),
    ("abcps1234k", "Rajesh", "FAIL", "SKIPPED", "SKIPPED", "SKIPPED", "FAIL"),
    (None, "Rajesh", "FAIL", "SKIPPED", "SKIPPED", "SKIPPED", "FAIL"),
]
TOKENS = [("Smt. Ananya Shukla", ["Ananya", "Shukla"]), ("V. Lakshmi", ["V", "Lakshmi"]), ("Rajesh", ["Rajesh"]), ("", []),
          (None, []), ("Dr. Shri  K.  Subramanian", ["K", "Subramanian"]), ("Late Mr O'Neil-Das", ["O", "Neil", "Das"]),
          ("Kumar Kmart", ["Kumar", "Kmart"]), ("12 Dr3sri", [])]


def values(df):
    return [tuple(r) for r in df.collect()]


def test_aadhaar_vectors(spark):
    df = spark.createDataFrame([(a[0],) for a in AADHAAR], "t string").select(fields.aadhaar_rule(F.col("t")).alias("r"))
    assert values(df.select("r.format_check", "r.checksum_check", "r.overall")) == [a[1:] for a in AADHAAR]


def test_pan_vectors(spark):
    df = spark.createDataFrame([p[:2] for p in PAN], "p string, n string").select(fields.pan_rule(F.col("p"), F.col("n")).alias("r"))
    got = values(df.select("r.format_check", "r.category_check", "r.semantic_check", "r.semantic_strict", "r.overall"))
    assert got == [p[2:] for p in PAN]


def test_staged_rule_equals_column_rule(spark):
    rows = [("pan", p[0], p[1]) for p in PAN] + [("aadhaar", a[0], "x") for a in AADHAAR]
    df = spark.createDataFrame(rows, "d string, i string, n string")
    df = fields.with_rule(df, "a", "d", "i", "n").withColumn("b", fields.document_rule(F.col("d"), F.col("i"), F.col("n")))
    assert df.where("a.overall <> b.overall or a.format_check <> b.format_check or a.checksum_check <> b.checksum_check "
                    "or a.category_check <> b.category_check or a.semantic_check <> b.semantic_check "
                    "or a.semantic_strict <> b.semantic_strict or a.reason <> b.reason").count() == 0
    assert df.where(~fields.verdict_consistent(F.col("a"))).count() == 0
    assert df.where(F.array_join(fields.failed_checks(F.col("a")), "|") != fields.failed_text(F.col("a"))).count() == 0


def test_tokens_and_initials(spark):
    df = spark.createDataFrame([(t[0],) for t in TOKENS], "n string")
    got = values(df.select(fields.name_tokens(F.col("n")), fields.name_initials(F.col("n"))))
    assert [g[0] for g in got] == [t[1] for t in TOKENS]
    assert [g[1] for g in got] == ["".join(w[0].upper() for w in t[1]) for t in TOKENS]


def test_check_digit_examples(spark):
    df = spark.createDataFrame([("499785203517", True), ("499786203517", False), ("789456123005", True)], "s string, ok boolean")
    assert df.where(checkdigit.is_consistent(F.col("s")) != F.col("ok")).count() == 0
    df = spark.createDataFrame([("49978520351", "499785203517"), ("78945612300", "789456123005")], "s string, t string")
    assert df.where(checkdigit.append_check_digit(F.col("s")) != F.col("t")).count() == 0
    assert df.where(checkdigit.append_check_digit11(F.col("s")) != F.col("t")).count() == 0
    bad = spark.createDataFrame([("12a4",), ("",), ("١٢٣",)], "s string").select(checkdigit.is_consistent(F.col("s")).alias("c"))
    assert bad.where("c is not null").count() == 0


def test_check_digit_properties(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice("0123456789") for _ in range(rng.choice((3, 8, 11, 11, 15)))),) for _ in range(400)]
    df = spark.createDataFrame(rows, "p string").withColumn("s", checkdigit.append_check_digit(F.col("p")))
    assert df.where(~checkdigit.is_consistent(F.col("s"))).count() == 0
    spots = df.select("s", F.explode(F.sequence(F.lit(1), F.length("s"))).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("d"))
    changed = spots.withColumn("t", F.overlay("s", F.col("d").cast("string"), "i", F.lit(1))).where("s <> t")
    assert changed.count() > 0 and changed.where(checkdigit.is_consistent(F.col("t"))).count() == 0
    swapped = spots.where("d = 0 and i < length(s)").withColumn("t", F.concat(
        F.expr("substr(s, 1, i - 1)"), F.expr("substr(s, i + 1, 1)"), F.expr("substr(s, i, 1)"), F.expr("substr(s, i + 2)"))).where("s <> t")
    assert swapped.count() > 0 and swapped.where(checkdigit.is_consistent(F.col("t"))).count() == 0


def test_sql_functions_agree(spark):
    register(spark)
    row = spark.sql("select verhoeff_check('499785203517'), verhoeff_check('499786203517'), verhoeff_append('49978520351'), "
                    "parse_field('pan_number', ' ab c'), parse_field('name', '  A   b '), char_error_rate('abcd', 'abxd'), "
                    "char_error_rate('', 'x'), verhoeff_check('12x')").first()
    assert tuple(row) == (True, False, "499785203517", "ABC", "A b", 0.25, 1.0, None)


def test_text_functions(spark):
    df = spark.createDataFrame([("aadhaar_number", "4997 8520\t3517"), ("pan_number", " abcps 1234k"), ("name", "  A   B \n")], "f string, r string")
    assert [r[0] for r in df.select(fields.parse_field(F.col("f"), F.col("r"))).collect()] == ["499785203517", "ABCPS1234K", "A B"]
    cer = spark.createDataFrame([("", ""), ("", "a"), ("abcd", "abd"), ("ab", "")], "r string, h string")
    assert [r[0] for r in cer.select(fields.char_error_rate(F.col("r"), F.col("h"))).collect()] == [0.0, 1.0, 0.25, 1.0]
    one = spark.range(1)
    assert one.select(fields.group4(F.lit("499785203517"))).first()[0] == "4997 8520 3517"
    assert one.select(fields.slash_path(F.lit("a\\b\\c"))).first()[0] == "a/b/c"
    a = F.create_map(F.lit("x"), F.lit("1"), F.lit("a"), F.lit("2"))
    b = F.create_map(F.lit("a"), F.lit("2"), F.lit("x"), F.lit("1"))
    assert one.select(fields.map_key(a) == fields.map_key(b)).first()[0]
    assert one.select(fields.person_part(fields.image_key(F.lit("P1_pan"), F.lit("mild")))).first()[0] == "P1"


def test_expected_verdicts(spark):
    df = spark.createDataFrame([(d, c) for d in fields.DOC_TYPES for c in fields.CATEGORIES], "d string, c string")
    fails = df.where(fields.expected_rule(F.col("d"), F.col("c")) == "FAIL")
    assert {tuple(r) for r in fails.collect()} == {("aadhaar", "C2"), ("pan", "C2"), ("pan", "C3")}


def test_measures(spark):
    one = spark.range(1)
    w = one.select(measures.wilson(F.lit(0), F.lit(10)).alias("w"), measures.wilson(F.lit(1), F.lit(0)).alias("e"),
                   measures.wilson_percent(F.lit(103), F.lit(135)).alias("p"), measures.wilson_percent(F.lit(1), F.lit(0)).alias("q")).first()
    assert w["w"]["lo"] == 0.0 and 0.27 < w["w"]["hi"] < 0.28 and w["e"]["rate"] != w["e"]["rate"]
    assert (w["p"]["lo"], w["p"]["hi"]) == (68.5, 82.7) and w["q"] is None
    r = one.select(measures.ratio_cell(F.lit(0), F.lit(0), "nothing").alias("c")).first()["c"]
    assert r["value"] is None and r["undefined"] == "nothing"
    c = one.select(measures.coincidence(F.lit(1000.0), 1e9, 8e10).alias("c")).first()["c"]
    assert c["expected"] == pytest.approx(12.5) and c["p_at_least_one"] == pytest.approx(1 - (1 - 1 / 80) ** 1000)
    t = one.select(measures.p_value_text(F.lit(0.0)), measures.p_value_text(F.lit(0.0042)), measures.p_value_text(F.lit(0.5)),
                   measures.percent_text(F.lit(None).cast("double")), measures.percent_text(F.lit(0.126))).first()
    assert tuple(t) == ("< 1e-4", "0.0042", "0.500", "n/a", "12.6")
    assert one.select(measures.logit(F.lit(0.0))).first()[0] == pytest.approx(-13.815509, abs=1e-5)
    assert one.select(measures.sigmoid(F.lit(2.0), 2.0)).first()[0] == pytest.approx(0.7310585786)
