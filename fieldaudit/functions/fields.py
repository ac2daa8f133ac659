"""Field rules on text columns: FN3-FN12 and the projections PRJ1-PRJ5, PRJ9, PRJ11."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldaudit.functions import checkdigit

PASS, FAIL, SKIPPED, NA = "PASS", "FAIL", "SKIPPED", "N/A"

# Domains of the data model.
DOC_TYPES = ("aadhaar", "pan")
CATEGORIES = ("C0", "C1", "C2", "C3", "C4")
TIERS = ("clean", "mild", "severe")
SPLITS = ("train", "val", "test")
FINE_OPS = ("local_recompression", "resample_patch")
COARSE_OPS = ("font_substitution", "field_displacement", "patch_splice")
# Fixed value: taxpayer category letters allowed at position 4.
PAN_CATEGORY_LETTERS = "PCHFATBLJG"
# Fixed value: honorific words dropped from names.
HONORIFICS = ("shri", "sri", "smt", "smt.", "km", "kum", "ms", "mr", "mrs", "dr", "late", "shrimati", "sushri")
# Checks per document type, in evaluation order.
CHECKS = {
    "aadhaar": ("format_check", "checksum_check"),
    "pan": ("format_check", "category_check", "semantic_check"),
}
# Checks that name the corrupted field's mechanism, per (document, category).
MECHANISM = {
    ("aadhaar", "C2"): ("format_check", "checksum_check"),
    ("pan", "C2"): ("format_check", "category_check"),
    ("pan", "C3"): ("semantic_check",),
}
# Cells whose true text must fail the rules; all other cells pass.
EXPECTED_FAIL = (("aadhaar", "C2"), ("pan", "C2"), ("pan", "C3"))

PAN_PATTERN = r"\A[A-Z]{5}[0-9]{4}[A-Z]\z"
_HONORIFIC_WORD = r"(?i)(?<![A-Za-z])(" + "|".join(h for h in HONORIFICS if h.isalpha()) + r")(?![A-Za-z])"
_INITIALS_ONLY = r"([A-Za-z])[A-Za-z]*|[^A-Za-z]+"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


# ---- names ------------------------------------------------------------------------------------

def name_tokens(name: Column) -> Column:
    """FN4. Alphabetic tokens of a name without honorifics; empty array for no name."""
    words = F.regexp_extract_all(_text(name), F.lit("[A-Za-z]+"), F.lit(0))
    return F.filter(words, lambda w: ~F.lower(w).isin(*HONORIFICS))


def name_initials(name: Column) -> Column:
    """Upper-case initials of FN4's tokens as one string, in order, without leaving codegen."""
    kept = F.regexp_replace(_text(name), _HONORIFIC_WORD, " ")
    return F.upper(F.regexp_replace(kept, _INITIALS_ONLY, "$1"))


# ---- rules ------------------------------------------------------------------------------------

def aadhaar_status(well_formed: Column, checked: Column, length: Column) -> Column:
    """FN3's result from its two tests: format first, then check digit."""
    return F.struct(
        F.when(well_formed, PASS).otherwise(FAIL).alias("format_check"),
        F.when(~well_formed, SKIPPED).when(checked, PASS).otherwise(FAIL).alias("checksum_check"),
        F.when(well_formed & checked, PASS).otherwise(FAIL).alias("overall"),
        F.when(~well_formed, F.concat(F.lit("format: want 12 digits, characters found: "), length.cast("string")))
        .when(checked, F.lit("format and check digit agree"))
        .otherwise(F.lit("checksum: last digit does not check the first eleven"))
        .alias("reason"),
    )


def aadhaar_rule(text: Column) -> Column:
    """FN3. Format (twelve ASCII digits), then check digit."""
    s = _text(text)
    well_formed = s.rlike(r"\A[0-9]{12}\z")
    return aadhaar_status(well_formed, F.when(well_formed, checkdigit.is_consistent12(s)), F.length(s))


def pan_status(well_formed: Column, s: Column, initials: Column) -> Column:
    """FN5's result: pattern, then category at position 4, then name initial at position 5.

    A name without usable tokens leaves the last check SKIPPED, which is no failure. The strict
    form wants the last token's initial for category P; otherwise the first token's.
    """
    fourth, fifth = F.substring(s, 4, 1), F.substring(s, 5, 1)
    known = well_formed & (F.instr(F.lit(PAN_CATEGORY_LETTERS), fourth) > 0)
    named = known & (F.length(initials) > 0)
    first, last = F.substring(initials, 1, 1), F.substring(initials, -1, 1)
    person = fourth == "P"
    loose = F.when(person, F.instr(initials, fifth) > 0).otherwise(first == fifth)
    strict = F.when(person, last == fifth).otherwise(first == fifth)
    verdict = lambda ok: F.when(~named, SKIPPED).when(ok, PASS).otherwise(FAIL)
    return F.struct(
        F.when(well_formed, PASS).otherwise(FAIL).alias("format_check"),
        F.when(~well_formed, SKIPPED).when(known, PASS).otherwise(FAIL).alias("category_check"),
        verdict(loose).alias("semantic_check"),
        verdict(strict).alias("semantic_strict"),
        F.when(known & (~named | loose), PASS).otherwise(FAIL).alias("overall"),
        F.when(well_formed, fourth).otherwise("").alias("category"),
        F.when(~well_formed, F.lit("format: want five letters, four digits, one letter"))
        .when(~known, F.concat(F.lit("category: unknown letter "), fourth))
        .when(~named, F.lit("cross-field: no usable name"))
        .when(loose, F.concat(fifth, F.lit(" is a name initial")))
        .otherwise(F.concat(F.lit("cross-field: "), fifth, F.lit(" is no name initial")))
        .alias("reason"),
    )


def pan_rule(code: Column, name: Column) -> Column:
    """FN5."""
    s = _text(code)
    return pan_status(s.rlike(PAN_PATTERN), s, name_initials(name))


def _merged(is_pan: Column, aadhaar: Column, pan: Column) -> Column:
    def pick(field, in_aadhaar, in_pan):
        left = aadhaar[field] if in_aadhaar else F.lit(NA)
        right = pan[field] if in_pan else F.lit(NA)
        return F.when(is_pan, right).otherwise(left).alias(field)

    return F.struct(
        pick("format_check", True, True), pick("checksum_check", True, False), pick("category_check", False, True),
        pick("semantic_check", False, True), pick("semantic_strict", False, True), pick("overall", True, True),
        pick("reason", True, True),
    )


def document_rule(doc_type: Column, identifier: Column, name: Column) -> Column:
    """FN6. One struct for both document types; checks the type does not have are N/A."""
    return _merged(doc_type == "pan", aadhaar_rule(identifier), pan_rule(identifier, name))


def with_rule(df: DataFrame, out: str, doc_type: str, identifier: str, name: str) -> DataFrame:
    """FN6 added as a column. Tests run once each in a projection of their own, then the statuses follow."""
    is_pan = F.col(doc_type) == "pan"
    df = df.withColumns({
        f"_{out}_s": _text(F.col(identifier)),
        f"_{out}_n": F.when(is_pan, name_initials(F.col(name))).otherwise(""),
    })
    s = F.col(f"_{out}_s")
    df = df.withColumn(f"_{out}_f", F.when(is_pan, s.rlike(PAN_PATTERN)).otherwise(s.rlike(r"\A[0-9]{12}\z")))
    well_formed = F.col(f"_{out}_f")
    df = df.withColumn(f"_{out}_c", F.when(~is_pan & well_formed, checkdigit.is_consistent12(s)).otherwise(False))
    df = df.withColumns({
        f"_{out}_a": aadhaar_status(well_formed, F.col(f"_{out}_c"), F.length(s)),
        f"_{out}_p": pan_status(well_formed, s, F.col(f"_{out}_n")),
    })
    df = df.withColumn(out, _merged(is_pan, F.col(f"_{out}_a"), F.col(f"_{out}_p")))
    return df.drop(*[f"_{out}_{x}" for x in "snfcap"])


def failed_checks(detail: Column) -> Column:
    """FN7. Names of the failed checks, as an array."""
    names = ("category_check", "checksum_check", "format_check", "semantic_check")
    flagged = F.array(*[F.when(detail[n] == FAIL, F.lit(n)) for n in names])
    return F.array_compact(flagged)


def failed_text(detail: Column) -> Column:
    """FN7 joined with ``|``; stays in codegen."""
    names = ("category_check", "checksum_check", "format_check", "semantic_check")
    return F.concat_ws("|", *[F.when(detail[n] == FAIL, F.lit(n)) for n in names])


def verdict_consistent(detail: Column) -> Column:
    """FN7's assertion: some check failed exactly when the verdict is FAIL."""
    return (F.length(failed_text(detail)) > 0) == (detail["overall"] == FAIL)


def mechanism_match(doc_type: Column, category: Column, detail: Column) -> Column:
    """FN8. 1 if a failed check belongs to the corrupted field's mechanism."""
    hit = F.lit(False)
    for (doc, cat), checks in MECHANISM.items():
        failed = F.lit(False)
        for c in checks:
            failed = failed | (detail[c] == FAIL)
        hit = hit | ((doc_type == doc) & (category == cat) & failed)
    return hit.cast("int")


# ---- extracted text ---------------------------------------------------------------------------

def parse_field(field, raw: Column) -> Column:
    """FN9. Minimal parsing of extracted text by field name; corrects nothing."""
    field = field if isinstance(field, Column) else F.lit(field)
    packed = F.regexp_replace(raw, r"\s+", "")
    return (
        F.when(field == "aadhaar_number", packed)
        .when(field == "pan_number", F.upper(packed))
        .otherwise(F.trim(F.regexp_replace(raw, r"\s+", " ")))
    )


def char_error_rate(ref: Column, hyp: Column) -> Column:
    """FN10. Edit distance over reference length; empty reference scores 0 or 1."""
    distance = F.levenshtein(ref, hyp).cast("double") / F.length(ref)
    return F.when(F.length(ref) == 0, F.when(F.length(hyp) == 0, 0.0).otherwise(1.0)).otherwise(distance)


def exact_match(ref: Column, hyp: Column) -> Column:
    """FN11."""
    return (ref == hyp).cast("int")


def group4(number: Column) -> Column:
    """FN12. Prints twelve digits as 4-4-4."""
    return F.concat_ws(" ", F.substring(number, 1, 4), F.substring(number, 5, 4), F.substring(number, 9, 4))


# ---- projections ------------------------------------------------------------------------------

def label_of(category: Column) -> Column:
    """PRJ2."""
    return F.when(category == "C0", 0).otherwise(1)


def image_key(document_id: Column, tier: Column) -> Column:
    """PRJ1."""
    return F.concat_ws("_", document_id, tier)


def person_part(composite_id: Column) -> Column:
    """PRJ1, the other way."""
    return F.split(composite_id, "_")[0]


def op_group(op: Column) -> Column:
    """PRJ5. Null for rows without an edit operation."""
    return F.when(op.isin(*FINE_OPS), "fine").when(op.isin(*COARSE_OPS), "coarse")


def flag(verdict: Column) -> Column:
    """PRJ6."""
    return (verdict == FAIL).cast("int")


def expected_rule(doc_type: Column, category: Column) -> Column:
    """PRJ9 as an expression over the fixed cells."""
    hit = F.lit(False)
    for doc, cat in EXPECTED_FAIL:
        hit = hit | ((doc_type == doc) & (category == cat))
    return F.when(hit, FAIL).otherwise(PASS)


def slash_path(path: Column) -> Column:
    """PRJ11."""
    return F.translate(path, "\\", "/")


def base_fields(doc_type: Column) -> dict[str, Column]:
    """PRJ3. Printed fields per document type, from identity columns; PAN cards print in capitals."""
    is_pan = doc_type == "pan"
    return {
        "print_id": F.when(is_pan, F.col("pan")).otherwise(F.col("aadhaar")),
        "print_name": F.when(is_pan, F.upper("printed_name")).otherwise(F.col("printed_name")),
        "print_father": F.when(is_pan, F.upper("father_name")),
        "print_devanagari": F.when(~is_pan, F.col("name_devanagari")),
        "print_dob": F.col("dob"),
    }


def field_map(doc_type: Column, identifier: Column, name: Column, dob: Column, father: Column) -> Column:
    """PRJ4. Extractable fields of a document as a map."""
    pan = F.create_map(F.lit("pan_number"), identifier, F.lit("name"), name,
                       F.lit("father_name"), father, F.lit("dob"), dob)
    aadhaar = F.create_map(F.lit("aadhaar_number"), identifier, F.lit("name"), name, F.lit("dob"), dob)
    return F.when(doc_type == "pan", pan).otherwise(aadhaar)


def map_key(m: Column) -> Column:
    """FN25. Canonical text of a map: equal maps give equal text whatever the entry order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
