"""SQL fragments for the DuckDB side of the comparison: the same tables, written as plain SQL."""

from __future__ import annotations

from fieldaudit.functions import checkdigit
from fieldaudit.functions.fields import HONORIFICS, PAN_CATEGORY_LETTERS
from fieldaudit.operators import synth
from fieldaudit.operators.positions import SPLIT_CYCLE


def draw(key: str, tag: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {key}::varchar, '{tag}')), 1, 15))::bigint"


def texts(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def take(value: str, used: int, n: int) -> str:
    return f"(({value} // {used}) % {n})"


def at(values, index: str) -> str:
    return f"{texts(values)}[({index} + 1)::int]"


def verhoeff_product(s: str, n: int = 12) -> str:
    """Group product digit by digit, the long way round."""
    perm = "[" + ", ".join(str(v) for v in checkdigit.permutation_table()) + "]"
    mult = "[" + ", ".join(str(v) for v in checkdigit.multiplication_table()) + "]"
    digits = f"list_transform(range(0, {n}), lambda i: {perm}[((i % 8) * 10 + substr({s}, ({n} - i)::int, 1)::int + 1)::int])"
    return f"list_reduce({digits}, lambda a, b: {mult}[(a * 10 + b + 1)::int])"


def with_check(s11: str) -> str:
    inverse = "[" + ", ".join(str(checkdigit.inverse(a)) for a in range(10)) + "]"
    return f"({s11} || {inverse}[({verhoeff_product(f'({s11} || chr(48))')} + 1)::int]::varchar)"


def letter(i: str) -> str:
    return f"chr((65 + {i})::int)"


def pan_code(serial: str, fifth: str) -> str:
    return (
        f"({letter(take(serial, 1, 26))} || {letter(take(serial, 26, 26))} || {letter(take(serial, 676, 26))} || 'P' || "
        f"{fifth} || lpad({take(serial, 17576, 10000)}::varchar, 4, '0') || {letter(take(serial, 175760000, 26))})"
    )


def initials(name: str) -> str:
    words = ", ".join(f"'{h}'" for h in HONORIFICS)
    tokens = f"list_filter(regexp_extract_all(coalesce({name}, ''), '[A-Za-z]+'), lambda t: lower(t) not in ({words}))"
    return f"coalesce(upper(array_to_string(list_transform({tokens}, lambda t: t[1:1]), '')), '')"


def devanagari(given: str) -> str:
    g = (f"case when gender = 'M' then {at(synth.MALE_GIVEN_DEVANAGARI, given)} "
         f"else {at(synth.FEMALE_GIVEN_DEVANAGARI, given)} end")
    name = (f"case naming_stratum when 'surname_last' then ({g}) || ' ' || {at(synth.SURNAMES_DEVANAGARI, 'sur')} "
            f"when 'initial_first' then {at(synth.LEADS_DEVANAGARI, 'lead')} || '. ' || ({g}) else ({g}) end")
    return f"(case when hon_dev <> '' then hon_dev || ' ' else '' end || ({name}))"


def identity_ctes(source: str, key: str, prefix: str = "id") -> str:
    """GEN1 over a relation: ends in ``{prefix}5`` with the relation's columns plus the identity."""
    d = synth
    g_m, g_f = d.MALE_GIVEN, d.FEMALE_GIVEN
    return f"""
{prefix}1 as (select *, {draw(key, 'who')} as who, {draw(key, 'pan')} as num,
   {draw(key, 'aadhaar')} % {d.AADHAAR_SPACE} as aadhaar_payload from {source}),
{prefix}2 as (select *, case when who % 2 = 0 then 'M' else 'F' end as gender,
   {at(d.STRATA, take('who', 2, 3))} as naming_stratum, {take('who', 6, 100)} < 18 as titled,
   {take('who', 600, 4)} as title, {take('who', 2400, 8)} as given, {take('who', 19200, 8)} as sur,
   {take('who', 153600, 16)} as lead, {take('who', 2457600, 100)} < 35 as from_lead,
   {take('who', 245760000, 8)} as father, num % {d.PAN_SERIAL_SPACE} as pan_serial,
   num // {d.PAN_SERIAL_SPACE} as dobn from {prefix}1),
{prefix}3 as (select *,
   case when not titled then '' when gender = 'M' then {at(d.MALE_TITLES, 'title')} else {at(d.FEMALE_TITLES, 'title')} end as honorific,
   case when not titled then '' when gender = 'M' then {at(d.MALE_TITLES_DEVANAGARI, 'title')} else {at(d.FEMALE_TITLES_DEVANAGARI, 'title')} end as hon_dev,
   case when gender = 'M' then {at(g_m, 'given')} else {at(g_f, 'given')} end as g,
   {at(d.SURNAMES, 'sur')} as s, {at(d.LEADS, 'lead')} as l,
   lpad((dobn % 28 + 1)::varchar, 2, '0') || '/' || lpad({take('dobn', 28, 12)}::bigint::varchar, 2, '0') as dob0,
   lpad((dobn % 28 + 1)::varchar, 2, '0') || '/' || lpad(({take('dobn', 28, 12)} + 1)::varchar, 2, '0') || '/' || ({take('dobn', 336, 51)} + 1955)::varchar as dob
   from {prefix}2),
{prefix}4 as (select *, case when naming_stratum = 'surname_last' then s else '' end as surname,
   case naming_stratum when 'surname_last' then g || ' ' || s when 'initial_first' then l || '. ' || g else g end as name_latin,
   {devanagari('given')} as name_devanagari,
   case when naming_stratum = 'surname_last' then 'surname' when naming_stratum = 'initial_first' and from_lead then 'leading_initial'
        when naming_stratum = 'initial_first' then 'given_name' else 'mononym' end as pan_fifth_source,
   {at(d.MALE_GIVEN, 'father')} || case when naming_stratum = 'surname_last' then ' ' || s else '' end as father_name,
   {with_check('(aadhaar_payload + 20000000000)::varchar')} as aadhaar from {prefix}3),
{prefix}4b as (select *, case when honorific <> '' then honorific || ' ' || name_latin else name_latin end as printed_name,
   case pan_fifth_source when 'surname' then s[1:1] when 'leading_initial' then l else g[1:1] end as pan_fifth from {prefix}4),
{prefix}5 as (select *, {pan_code('pan_serial', 'pan_fifth')} as pan from {prefix}4b)"""


def _noise(text: str, d: str, used: int) -> str:
    hit, kind, p, c = take(d, used, 1000), take(d, used * 1000, 4), take(d, used * 4000, 64), take(d, used * 256000, 36)
    pos = f"({p} % greatest(length({text}), 1) + 1)::int"
    ch = f"substr('{synth.NOISE_CHARS}', ({c} + 1)::int, 1)"
    rate = "case quality_tier when 'clean' then 20 when 'mild' then 30 else 200 end"
    put = f"case {kind} when 0 then {ch} when 2 then ' ' || {ch} else '' end"
    return (f"case when {text} is null then null when not ({hit} < {rate}) or length({text}) = 0 then {text} when {kind} = 3 then '' "
            f"else substr({text}, 1, {pos} - 1) || {put} || substr({text}, {pos} + 1) end")


def rule(out: str, ident: str, name: str) -> str:
    """FN3/FN5 as SQL columns ``{out}_format`` ... ``{out}_verdict`` over ident/name/ini columns."""
    s, ini = f"coalesce({ident}, '')", f"{out}_ini"
    wf_a = f"regexp_full_match({s}, '[0-9]{{12}}')"
    wf_p = f"regexp_full_match({s}, '[A-Z]{{5}}[0-9]{{4}}[A-Z]')"
    known = f"({wf_p} and contains('{PAN_CATEGORY_LETTERS}', substr({s}, 4, 1)))"
    loose = f"(case when substr({s}, 4, 1) = 'P' then contains({ini}, substr({s}, 5, 1)) else {ini}[1:1] = substr({s}, 5, 1) end)"
    strict = f"(case when substr({s}, 4, 1) = 'P' then right({ini}, 1) else {ini}[1:1] end = substr({s}, 5, 1))"
    check = f"({out}_prod = 0)"
    three = lambda test: (f"case when doc_type = 'aadhaar' then 'N/A' when not {known} or {ini} = '' then 'SKIPPED' "  # noqa: E731
                          f"when {test} then 'PASS' else 'FAIL' end")
    return f"""
   case when case when doc_type = 'pan' then {wf_p} else {wf_a} end then 'PASS' else 'FAIL' end as {out}_format,
   case when doc_type = 'pan' then 'N/A' when not {wf_a} then 'SKIPPED' when {check} then 'PASS' else 'FAIL' end as {out}_checksum,
   case when doc_type = 'aadhaar' then 'N/A' when not {wf_p} then 'SKIPPED' when {known} then 'PASS' else 'FAIL' end as {out}_category,
   {three(loose)} as {out}_semantic, {three(strict)} as {out}_strict"""


def _prod(out: str, ident: str, name: str) -> str:
    safe = f"case when regexp_full_match(coalesce({ident}, ''), '[0-9]{{12}}') then {ident} else '000000000001' end"
    return f"{verhoeff_product(f'({safe})')} as {out}_prod, {initials(name)} as {out}_ini"


def _verdict(out: str) -> str:
    fields = ("category", "checksum", "format", "semantic")
    failed = ", ".join(f"case when {out}_{f} = 'FAIL' then '{f}_check' end" for f in fields)
    any_fail = " or ".join(f"{out}_{f} = 'FAIL'" for f in fields)
    return (f"concat_ws('|', {failed}) as {out}_failed, "
            f"case when {any_fail} then 'FAIL' else 'PASS' end as rule_{out}_verdict, ({any_fail})::int as rule_{out}")


def splits() -> str:
    """WIN8 over customers, as one global row number."""
    cycle = texts(SPLIT_CYCLE)
    return f"""splits as (select *, {cycle}[(position % 20 + 1)::int] as split from (
   select c_custkey as person_id, c_mktsegment, c_nationkey % 3 as nation_group,
     row_number() over (order by c_mktsegment, c_nationkey % 3, md5(concat_ws('|', '42', c_custkey::varchar, 'split')), c_custkey) - 1 as position
   from customer))"""


def cases() -> str:
    """The ``cases`` relation as a chain of common table expressions."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
    fault_at = (f"case fault % 4 when 0 then [1, 2, 3, 10][({take('fault', 1040, 4)} + 1)::int] when 1 then {take('fault', 4160, 4)} + 6 "
                f"when 2 then case when {take('fault', 29286400, 2)} = 1 then {take('fault', 166400, 11)} + 1 else {take('fault', 16640, 10)} + 1 end "
                f"else 4 end")
    any_letter = letter(take("fault", 40, 26))
    put = (f"case fault % 4 when 0 then {take('fault', 4, 10)}::varchar when 1 then {any_letter} "
           f"when 2 then case when {take('fault', 29286400, 2)} = 1 then {any_letter} else '' end "
           f"else substr('{synth.BAD_CATEGORY_LETTERS}', ({take('fault', 1830400, 16)} + 1)::int, 1) end")
    cut = f"case when fault % 4 = 2 and {take('fault', 29286400, 2)} = 1 then 0 else 1 end"
    old_digit = "substr(aadhaar, (fault % 10 + 2)::int, 1)::int"
    new_digit = f"(({old_digit} + 1 + {take('fault', 10, 9)}) % 10)::varchar"
    fresh_a, fresh_p = f"fault % {synth.AADHAAR_SPACE}", f"fault % {synth.PAN_SERIAL_SPACE}"
    return f"""
case0 as (select o_orderkey, 'o' || o_orderkey::varchar as image_id, o_custkey as person_id,
   o_custkey::varchar || '_' || (o_orderkey // 3)::varchar as document_id,
   case when o_orderkey % 2 = 0 then 'aadhaar' else 'pan' end as doc_type,
   case o_orderstatus when 'F' then 'clean' when 'O' then 'mild' else 'severe' end as quality_tier,
   ['C0', 'C0', 'C1', 'C2', 'C3', 'C4'][({draw('o_orderkey', 'cat')} % 6 + 1)::int] as forgery_category,
   {draw('o_orderkey', 'op')} as opd, {draw('o_orderkey', 'score')} % 1000003 as scored,
   {draw('o_orderkey', 'ocr1')} as d1, {draw('o_orderkey', 'ocr2')} as d2, {draw('o_orderkey', 'fault')} as fault from orders),
case1 as (select *, (forgery_category <> 'C0')::int as label,
   case when forgery_category = 'C1' then {at(synth.OPERATIONS, 'opd % 5')} end as c1_op,
   case when forgery_category = 'C1' then {at(synth.OPERATION_FIELDS, take('opd', 5, 4))} end as c1_field,
   {take('opd', 20, 3)}::int as template_variant,
   case when forgery_category = 'C2' or (doc_type = 'pan' and forgery_category = 'C3') then 'FAIL' else 'PASS' end as expected_rule,
   (scored / 1000003.0 + case when forgery_category = 'C1' then 0.2::double else 0.0::double end) / 1.2::double as score from case0),
{identity_ctes('case1', 'person_id')},
case2 as (select *, case when doc_type = 'pan' then upper(printed_name) else printed_name end as print_name,
   case when doc_type = 'pan' then upper(father_name) end as print_father, dob as print_dob,
   case when doc_type = 'pan' then pan else aadhaar end as own_id from id5),
case3 as (select *, case
   when forgery_category = 'C2' and doc_type = 'aadhaar' then
      substr(aadhaar, 1, (fault % 10 + 1)::int) || {new_digit} || substr(aadhaar, (fault % 10 + 3)::int)
   when forgery_category = 'C2' then substr(pan, 1, ({fault_at} - 1)::int) || {put} || substr(pan, ({fault_at} + {cut})::int)
   when forgery_category = 'C3' and doc_type = 'pan' then
      substr(pan, 1, 4) || substr(translate({letters}, {initials('print_name')}, ''),
         (fault % length(translate({letters}, {initials('print_name')}, '')) + 1)::int, 1) || substr(pan, 6)
   when forgery_category = 'C3' then {devanagari('((given + 1 + fault % 7) % 8)')}
   when forgery_category = 'C4' and doc_type = 'aadhaar' then
      {with_check(f"(case when {fresh_a} = aadhaar_payload then (aadhaar_payload + 1) % {synth.AADHAAR_SPACE} else {fresh_a} end + 20000000000)::varchar")}
   when forgery_category = 'C4' then
      {pan_code(f"(case when {fresh_p} = pan_serial then (pan_serial + 1) % {synth.PAN_SERIAL_SPACE} else {fresh_p} end)", 'pan_fifth')}
   end as forged_value from case2),
case4 as (select *, case when forged_value is not null and not (forgery_category = 'C3' and doc_type = 'aadhaar') then forged_value else own_id end as print_id,
   case when forged_value is null then null when forgery_category = 'C3' and doc_type = 'aadhaar' then 'name_devanagari'
        when doc_type = 'pan' then 'pan_number' else 'aadhaar_number' end as forgery_field,
   case when forgery_category = 'C2' and doc_type = 'pan' then {at(synth.FAULT_KINDS, 'fault % 4')}
        when forgery_category = 'C2' then 'checksum_break' when forgery_category = 'C3' and doc_type = 'aadhaar' then 'script_mismatch'
        when forgery_category = 'C3' then 'fifth_mismatch' when forgery_category = 'C4' then 'fabricated' end as forgery_detail,
   case when forgery_category = 'C3' and doc_type = 'aadhaar' then name_devanagari when forged_value is not null then own_id end as gt_value,
   case when doc_type = 'pan' then 'pan_number' else 'aadhaar_number' end as id_field from case3),
case5 as (select *, case when doc_type = 'pan' then print_id else print_id[1:4] || ' ' || print_id[5:8] || ' ' || print_id[9:12] end as shown_id from case4),
case6 as (select *, {_noise('shown_id', 'd1', 1)} as raw_id, {_noise('print_name', 'd1', 9216000)} as raw_name,
   {_noise('print_dob', 'd2', 1)} as raw_dob, {_noise('print_father', 'd2', 9216000)} as raw_father from case5),
case7 as (select *, case when doc_type = 'pan' then upper(regexp_replace(raw_id, '\\s+', '', 'g')) else regexp_replace(raw_id, '\\s+', '', 'g') end as ocr_id,
   trim(regexp_replace(raw_name, '\\s+', ' ', 'g')) as ocr_name, trim(regexp_replace(raw_dob, '\\s+', ' ', 'g')) as ocr_dob,
   trim(regexp_replace(raw_father, '\\s+', ' ', 'g')) as ocr_father from case6),
case8 as (select *, {_prod('gt', 'print_id', 'print_name')}, {_prod('ocr', 'ocr_id', 'ocr_name')} from case7),
case9 as (select *, {rule('gt', 'print_id', 'print_name')}, {rule('ocr', 'ocr_id', 'ocr_name')} from case8),
{splits()},
cases as materialized (select case9.*, splits.split, {_verdict('gt')}, {_verdict('ocr')}, (score >= 0.75)::int as visual from case9 left join splits using (person_id))"""


def fields(relation: str = "cases") -> str:
    """One row per (case, extractable field) with reference and extracted text."""
    return f"""
fields as (
  select doc_type, quality_tier, forgery_category, label, id_field as field, print_id as ref, ocr_id as hyp from {relation}
  union all select doc_type, quality_tier, forgery_category, label, 'name', print_name, ocr_name from {relation}
  union all select doc_type, quality_tier, forgery_category, label, 'dob', print_dob, ocr_dob from {relation}
  union all select doc_type, quality_tier, forgery_category, label, 'father_name', print_father, ocr_father from {relation} where doc_type = 'pan')"""


def wilson(k: str, n: str, prefix: str = "") -> str:
    """Rate with clamped score interval, rounded to six decimals."""
    z = "1.959963985::double"
    p = f"({k}::double / {n})"
    d = f"(1 + {z} * {z} / {n})"
    c = f"(({p} + {z} * {z} / (2 * {n})) / {d})"
    h = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0::double * {n} * {n})) / {d})"
    return (f"round({p}, 6) as {prefix}rate, round(greatest(0.0::double, {c} - {h}), 6) as {prefix}lo, "
            f"round(least(1.0::double, {c} + {h}), 6) as {prefix}hi")


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(c.strip() for c in ctes) + "\n"
