"""SQL names for the row functions FN1, FN2, FN9 and FN10: temporary SQL functions, no Python at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

from fieldaudit.functions import checkdigit


def _text(values) -> str:
    return "split('" + ",".join(str(v) for v in values) + "', ',')"


def _product(s: str) -> str:
    mult, perm = _text(checkdigit.multiplication_table()), _text(checkdigit.permutation_table())
    digit = f"cast(substr({s}, length({s}) - i, 1) as int)"
    step = f"cast(get({mult}, c * 10 + cast(get({perm}, pmod(i, 8) * 10 + {digit}) as int)) as int)"
    return f"aggregate(sequence(0, length({s}) - 1), 0, (c, i) -> {step})"


def register(spark: SparkSession) -> None:
    inverse = _text(checkdigit.inverse(a) for a in range(10))
    digits = "rlike(s, '\\\\A[0-9]+\\\\z')"
    functions = {
        "verhoeff_check(s string) returns boolean": f"case when {digits} then {_product('s')} = 0 end",
        "verhoeff_append(s string) returns string":
            f"case when {digits} then concat(s, get({inverse}, {_product('concat(s, chr(48))')})) end",
        "parse_field(field string, s string) returns string":
            "case when field = 'aadhaar_number' then regexp_replace(s, '\\\\s+', '') "
            "when field = 'pan_number' then upper(regexp_replace(s, '\\\\s+', '')) else trim(regexp_replace(s, '\\\\s+', ' ')) end",
        "char_error_rate(ref string, hyp string) returns double":
            "case when length(ref) = 0 then if(length(hyp) = 0, 0d, 1d) else cast(levenshtein(ref, hyp) as double) / length(ref) end",
    }
    for signature, body in functions.items():
        spark.sql(f"create or replace temporary function {signature} return {body}")
