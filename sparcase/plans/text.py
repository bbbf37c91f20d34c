"""Sanitising, validating, extracting and comparing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import normalize as N
from ..functions import similarity as S
from ..functions import validate as V
from ..functions.jsontext import json_repaired
from ..operators import templates
from . import inputs as I
from .registry import query, table

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_REMARKS = ", ".join(f"'{r}'" for r in N.REMARKS)
_PLAIN = "translate({0}, 'ÁÀÄÂÃÅÉÈËÊÍÌÏÎÓÒÖÔÕÚÙÜÛÑÇáàäâãåéèëêíìïîóòöôõúùüûñç', 'AAAAAAEEEEIIIIOOOOOUUUUNCaaaaaaeeeeiiiiooooouuuunc')"


def _sanitized(c: str) -> str:
    step = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '&nbsp;', ' ', 'gi'), '&amp;nbsp;', ' ', 'gi'), '&lt;', ' ', 'gi'), '&gt;', ' ', 'gi'), '&amp;', ' ', 'gi'), '\r\n|\n|\r', ' ', 'g'), ' {{2,}}', ' ', 'g'))".format(c)
    return f"CASE WHEN upper({step}) IN ({_REMARKS}) OR regexp_matches({step}, '^[ _]*$') THEN NULL ELSE {step} END"


_RAW = """CASE c.turn % 6 WHEN 0 THEN '  ' || text || '&nbsp;  x ' WHEN 1 THEN 'no aplica' WHEN 2 THEN '_ _' WHEN 3 THEN text || chr(13) || chr(10) || 'a  b' WHEN 4 THEN '&amp;nbsp;' ELSE text END"""


def _raw(spark, d):
    turn, text = F.col("turn") % 6, F.col("text")
    raw = F.when(turn == 0, F.concat(F.lit("  "), text, F.lit("&nbsp;  x "))).when(turn == 1, "no aplica").when(turn == 2, "_ _").when(turn == 3, F.concat(text, F.lit("\r\na  b"))).when(turn == 4, "&amp;nbsp;").otherwise(text)
    return table(spark, d, "conversations").select("conv_id", "turn", raw.alias("raw"))


@query(f"SELECT conv_id, turn, {_sanitized('raw')} AS clean FROM (SELECT conv_id, turn, {_RAW} AS raw FROM conversations c)")
def san01_sanitize(spark, d):
    return _raw(spark, d).select("conv_id", "turn", N.sanitize(F.col("raw")).alias("clean"))


@query(
    f"""WITH {I.IDENTIFIERS}, b AS (SELECT case_id, regexp_replace(regexp_replace({_sanitized('amount')}, '\\$|MXN|USD|EUR', '', 'gi'), '[, ]', '', 'g') AS bare FROM identifiers)
    SELECT case_id, CASE WHEN try_cast(bare AS decimal(38,6)) >= 0 THEN round(try_cast(bare AS decimal(38,6)), 0)::decimal(38,0)::varchar END AS amount FROM b"""
)
def san02_amount(spark, d):
    return I.identifiers(spark, d).select("case_id", N.sanitize_amount(F.col("amount")).alias("amount"))


@query(
    f"""WITH {I.IDENTIFIERS}, b AS (SELECT case_id, regexp_replace(account, '^\\s*(CUENTA|ACCOUNT|CTA|NO\\s*DE\\s*CUENTA|NUM|NUMERO|NUMBER)\\s*[:.\\-]?\\s*', '', 'i') AS bare,
      regexp_replace(bare, '[^0-9]', '', 'g') AS cleaned FROM identifiers)
    SELECT case_id, cleaned, concat_ws(',', CASE WHEN cleaned = '' THEN 'AccountMissing' END, CASE WHEN cleaned <> '' AND length(cleaned) NOT BETWEEN 6 AND 20 THEN 'AccountLengthSuspect' END,
      CASE WHEN cleaned <> '' AND cleaned <> bare THEN 'AccountNormalized' END) AS warnings FROM b"""
)
def san03_account(spark, d):
    out = N.clean_account(F.col("account"))
    return I.identifiers(spark, d).select("case_id", out["cleaned"].alias("cleaned"), F.array_join(out["warnings"], ",").alias("warnings"))


_SWIFT = """b AS (SELECT case_id, regexp_replace(swift, '^\\s*(SWIFT|BIC|CODIGO|CODE|SWIFT\\s*CODE|BIC\\s*CODE)\\s*[:.\\-]?\\s*', '', 'i') AS bare, upper(regexp_replace(bare, '[^A-Za-z0-9]', '', 'g')) AS code,
      code <> bare AND length(code) = 9 AND NOT regexp_matches(bare, '\\s') AS pad, CASE WHEN pad THEN code || 'XX' ELSE code END AS cleaned FROM identifiers)"""


@query(
    f"""WITH {I.IDENTIFIERS}, {_SWIFT} SELECT case_id, cleaned, concat_ws(',', CASE WHEN code = '' THEN 'SwiftMissing' END,
      CASE WHEN code <> '' AND length(cleaned) NOT IN (8, 11) AND NOT (NOT pad AND length(cleaned) = 9) THEN 'SwiftLengthSuspect' END, CASE WHEN code <> '' AND code <> bare THEN 'SwiftNormalized' END) AS warnings FROM b"""
)
def san04_swift(spark, d):
    out = N.clean_swift(F.col("swift"))
    return I.identifiers(spark, d).select("case_id", out["cleaned"].alias("cleaned"), F.array_join(out["warnings"], ",").alias("warnings"))


@query("SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS cleaned, trim(regexp_replace(text, '\\s+', ' ', 'g')) <> text AS changed FROM conversations")
def san05_generic(spark, d):
    out = N.clean_generic(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", out["cleaned"].alias("cleaned"), (F.size(out["warnings"]) > 0).alias("changed"))


@query(
    f"""WITH {I.IDENTIFIERS}, {_SWIFT}, a AS (SELECT case_id, regexp_replace(regexp_replace(swift, '^\\s*(CUENTA|ACCOUNT|CTA|NO\\s*DE\\s*CUENTA|NUM|NUMERO|NUMBER)\\s*[:.\\-]?\\s*', '', 'i'), '[^0-9]', '', 'g') AS account FROM identifiers)
    SELECT case_id, account, cleaned AS swift FROM b JOIN a USING (case_id)"""
)
def san06_account_and_swift(spark, d):
    both = N.account_and_swift(F.col("swift"))
    return I.identifiers(spark, d).select("case_id", both["account"]["cleaned"].alias("account"), both["swift"]["cleaned"].alias("swift"))


@query("SELECT doc_id, " + _PLAIN.format("upper(trim(regexp_replace(replace(text, 'ß', 'ss'), '\\s+', ' ', 'g')))") + " AS name FROM documents")
def san07_name(spark, d):
    return table(spark, d, "documents").select("doc_id", N.normalize_name(F.col("text")).alias("name"))


@query(
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '([a-zA-Z])-\n([a-zA-Z])', '\1\2', 'g'), '[ \t]+', ' ', 'g'),
      '\n{3,}', chr(10) || chr(10), 'g'), ' +([,.;:!?])', '\1', 'g'), '([,.;:!?])([A-Za-z])', '\1 \2', 'g')) AS text FROM documents"""
)
def san08_ocr_text(spark, d):
    return table(spark, d, "documents").select("doc_id", N.normalize_ocr(F.col("text")).alias("text"))


@query("SELECT o_orderkey AS case_id, translate(regexp_replace('A/ASl - ' || o_orderkey || 'O -  ' || o_custkey || '- AAA', '[ \\t]*([-–])[ \\t]*', '\\1', 'g'), 'Ol', '0I') AS id FROM orders")
def san09_ocr_id(spark, d):
    raw = F.concat(F.lit("A/ASl - "), F.col("o_orderkey").cast("string"), F.lit("O -  "), F.col("o_custkey").cast("string"), F.lit("- AAA"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), N.fix_ocr_id(raw).alias("id"))


@query("SELECT doc_id, translate(upper(trim(regexp_replace(replace(text, 'ß', 'ss'), '\\s+', ' ', 'g'))), '–—', '--') AS text FROM documents")
def san10_truth(spark, d):
    return table(spark, d, "documents").select("doc_id", N.normalize_truth(F.col("text")).alias("text"))


@query(
    """WITH n AS (SELECT p_partkey, (['get', 'is', 'the', ''])[p_partkey % 4 + 1] || replace(p_name, ' ', '') || (['Value', 'Field', ''])[p_partkey % 3 + 1] AS name FROM part)
    SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '^get', ''), '^set', ''), '^is', ''), '^has', ''), '^the', ''), 'field$', ''), 'property$', ''), 'value$', '') AS name FROM n"""
)
def san11_field_name(spark, d):
    k = F.col("p_partkey")
    name = F.concat(I._pick(("get", "is", "the", ""), k % 4), F.regexp_replace("p_name", " ", ""), I._pick(("Value", "Field", ""), k % 3))
    return table(spark, d, "part").select(k, N.normalize_field_name(name).alias("name"))


@query(
    f"""WITH {I.IDENTIFIERS} SELECT case_id, coalesce(regexp_matches(rfc, '{V.RFC}'), false) AS rfc_ok, coalesce(regexp_matches(curp, '{V.CURP}'), false) AS curp_ok,
      coalesce(regexp_matches(case_number, '{V.CASE_NUMBER}'), false) AS case_ok, coalesce(regexp_matches(clabe, '{V.CLABE}'), false) AS clabe_ok,
      regexp_matches(day, '^[0-9]{{8}}$') AND try_strptime(day, '%Y%m%d') IS NOT NULL AS day_ok, coalesce(regexp_matches(amount, '^[0-9]+$'), false) AS amount_ok,
      case_number IS NOT NULL AND length(case_number) <= 20 AS text_ok FROM identifiers"""
)
def val01_07_patterns(spark, d):
    c = F.col
    checks = {"rfc_ok": V.is_rfc(c("rfc")), "curp_ok": V.is_curp(c("curp")), "case_ok": V.is_case_number(c("case_number")), "clabe_ok": V.is_clabe(c("clabe")), "day_ok": V.is_date(c("day")), "amount_ok": V.is_amount(c("amount")), "text_ok": V.is_text(c("case_number"), 20)}
    return I.identifiers(spark, d).select("case_id", *(v.alias(k) for k, v in checks.items()))


@query(
    f"""WITH {I.IDENTIFIERS} SELECT case_id, concat_ws(',', CASE WHEN coalesce(rfc, '') = '' THEN 'RFCMissing' END, CASE WHEN rfc <> '' AND NOT regexp_matches(rfc, '{V.PERSON_RFC}') THEN 'RFCInvalid' END,
      CASE WHEN coalesce(curp, '') = '' THEN 'CURPMissing' END, CASE WHEN curp <> '' AND NOT regexp_matches(curp, '{V.PERSON_CURP}') THEN 'CURPInvalid' END) AS warnings FROM identifiers"""
)
def val08_identity(spark, d):
    return I.identifiers(spark, d).select("case_id", F.array_join(V.identity_warnings(F.col("rfc"), F.col("curp")), ",").alias("warnings"))


@query(
    f"""WITH {I.IDENTIFIERS} SELECT case_id, concat_ws(',', CASE WHEN action IN ('Block', 'Unblock', 'Transfer') AND coalesce(account, '') = '' THEN 'AccountMissing' END,
      CASE WHEN action IN ('Block', 'Unblock', 'Transfer') AND account <> '' AND NOT regexp_matches(account, '^[0-9]{{6,20}}$') THEN 'AccountInvalidFormat' END,
      CASE WHEN currency <> '' AND NOT regexp_matches(currency, '^[A-Z]{{3}}$') THEN 'CurrencyInvalid' END,
      CASE WHEN swift <> '' AND NOT regexp_matches(swift, '^[A-Za-z0-9]{{8}}([A-Za-z0-9]{{3}})?$') THEN 'SwiftInvalid' END) AS warnings FROM identifiers"""
)
def val09_account(spark, d):
    c = F.col
    return I.identifiers(spark, d).select("case_id", F.array_join(V.account_warnings(c("action"), c("account"), c("currency"), c("swift")), ",").alias("warnings"))


@query(
    f"""WITH {I.IDENTIFIERS}, m AS (SELECT *, try_cast(trim(regexp_replace(amount, '\\$|,|MXN|USD|EUR', '', 'gi')) AS decimal(38,6)) AS money FROM identifiers)
    SELECT case_id, coalesce(regexp_matches(case_number, '{V.GATE_CASE}'), false) OR coalesce(regexp_matches(rfc, '{V.GATE_RFC}'), false) OR coalesce(regexp_matches(curp, '{V.GATE_CURP}'), false)
      OR coalesce(money > 0 AND money < 100000000, false) AS plausible FROM m"""
)
def val10_plausible(spark, d):
    c, none = F.col, F.lit(None).cast("string")
    return I.identifiers(spark, d).select("case_id", V.plausible(c("case_number"), none, c("rfc"), c("curp"), c("amount"), none, none, none).alias("plausible"))


_NAMES = "n AS (SELECT c_custkey, ['Juan Pérez', 'Customer ' || c_custkey, c_name, 'ABCD850101XY1', '$1,000', 'maria lopez', 'Ana-Lisa O''Hara', '2024-01-05', 'Smith Jones'][c_custkey % 9 + 1] AS name FROM customer)"


def _names(spark, d):
    k = F.col("c_custkey")
    name = F.element_at(F.array(F.lit("Juan Pérez"), F.concat(F.lit("Customer "), k.cast("string")), F.col("c_name"), F.lit("ABCD850101XY1"), F.lit("$1,000"), F.lit("maria lopez"), F.lit("Ana-Lisa O'Hara"), F.lit("2024-01-05"), F.lit("Smith Jones")), (k % 9 + 1).cast("int"))
    return table(spark, d, "customer").select(k, name.alias("name"))


@query(
    f"""WITH {_NAMES}, l AS (SELECT *, length(regexp_replace(name, '[^\\p{{L}} ''\\-]', '', 'g'))::double / length(name) AS letters FROM n)
    SELECT c_custkey, NOT ({' OR '.join("regexp_matches(name, '" + p + "')" for p in V.NO_NAME)}) AND NOT contains(name, '/') AND NOT contains(name, '$') AND letters >= 0.8 AS is_name,
      regexp_matches(name, '[áéíóúñÁÉÍÓÚÑ]') OR len(list_filter(string_split(lower(strip_accents(name)), ' '), lambda t: t IN ({', '.join(f"'{x}'" for x in V.GIVEN_NAMES + V.SURNAMES)}) OR suffix(t, 'ez') OR suffix(t, 'es'))) > 0 AS is_hispanic FROM l"""
)
def val11_12_names(spark, d):
    return _names(spark, d).select("c_custkey", V.is_name(F.col("name")).alias("is_name"), V.is_hispanic_name(F.col("name")).alias("is_hispanic"))


@query(
    f"""WITH {I.IDENTIFIERS} SELECT case_id, concat_ws(',', CASE WHEN case_number IS NULL THEN 'case_number' END, CASE WHEN rfc IS NULL THEN 'rfc' END, CASE WHEN curp = '' THEN 'curp' END,
      CASE WHEN currency = '' THEN 'currency' END, CASE WHEN action IN ('Block', 'Transfer') AND NOT regexp_matches(account, '^[0-9]+') THEN 'account:' || action END) AS missing,
      case_number IS NOT NULL AND rfc IS NOT NULL AND curp <> '' AND currency <> '' AND NOT (action IN ('Block', 'Transfer') AND NOT regexp_matches(account, '^[0-9]+')) AS complete FROM identifiers"""
)
def val13_14_completeness(spark, d):
    """Required fields of a record to be exported, and an account for each action that needs one."""
    c = F.col
    needs = [(V.blank(c(n)), F.lit(n)) for n in ("case_number", "rfc", "curp", "currency")] + [(c("action").isin("Block", "Transfer") & ~c("account").rlike("^[0-9]+"), F.concat(F.lit("account:"), c("action")))]
    missing = F.array_compact(F.array(*(F.when(cond, name) for cond, name in needs)))
    return I.identifiers(spark, d).select("case_id", F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("complete"))


@query("SELECT doc_id, concat_ws(',', CASE WHEN lang IS NULL THEN 'lang' END, CASE WHEN trim(text) = '' THEN 'text' END) AS missing, n_chars BETWEEN 100 AND 5000 AS sized, (trim(text) <> '') AND n_chars BETWEEN 100 AND 5000 AS valid FROM documents")
def val17_record_rules(spark, d):
    """Required fields and rules of one's own over a batch of records."""
    missing = N.warnings((V.blank(F.col("lang")), "lang"), (V.blank(F.col("text")), "text"))
    sized = F.col("n_chars").between(100, 5000)
    return table(spark, d, "documents").select("doc_id", F.array_join(missing, ",").alias("missing"), sized.alias("sized"), ((F.size(missing) == 0) & sized).alias("valid"))


@query(
    f"""WITH {I.NOTICES} SELECT case_id, array_to_string(list_distinct(list_transform(regexp_extract_all(text, '{X.RFC_ANY}'), lambda x: upper(x))), ',') AS rfcs,
      nullif(upper(regexp_extract(text, '{X.CURP_STRICT}')), '') AS curp, nullif(regexp_extract(text, '{X.ACCOUNT}'), '') AS account,
      CASE WHEN contains(upper(text), 'BLOQ') THEN 'Block' WHEN contains(upper(text), 'DESBLO') OR contains(upper(text), 'LIBER') THEN 'Unblock' WHEN contains(upper(text), 'TRANS') OR contains(upper(text), 'TRASP') THEN 'Transfer'
        WHEN contains(upper(text), 'INFO') THEN 'Information' WHEN contains(upper(text), 'DOC') THEN 'Document' WHEN contains(upper(text), 'IGNOR') THEN 'Ignore' ELSE 'Other' END AS kind,
      replace(left(text, 12), ' ', '') AS bare FROM notices"""
)
def ext01_05_identity(spark, d):
    t = F.col("text")
    return I.notices(spark, d).select("case_id", F.array_join(X.rfc_variants(t), ",").alias("rfcs"), X.curp(t).alias("curp"), X.account(t).alias("account"), X.action_kind(t).alias("kind"), X.bare_account(F.left(t, F.lit(12))).alias("bare"))


_AMOUNT = ", ".join(
    f"list_filter(list_zip(regexp_extract_all(text, '{p}'), regexp_extract_all(text, '{p}', 1)), lambda p: NOT (length(regexp_replace(p[2], '[,.]', '', 'g')) >= 10 AND NOT contains(p[1], '$') AND NOT regexp_matches(p[1], '{X.MONEY_WORD}'))) AS a{i}" for i, p in enumerate(X.AMOUNTS)
)
_LONGEST = "list_filter({0}, lambda p: length(p[1]) = list_max(list_transform({0}, lambda q: length(q[1]))))[1]"


@query(
    f"""WITH {I.NOTICES}, a AS (SELECT case_id, text, {_AMOUNT} FROM notices), b AS (SELECT *, coalesce({', '.join(_LONGEST.format(f'a{i}') for i in range(4))}) AS best FROM a)
    SELECT case_id, array_to_string(list_distinct(regexp_extract_all(text, '{X.ACCOUNT_NAMED}', 1)), ',') AS accounts,
      concat_ws(',', CASE WHEN regexp_matches(text, '(?i)\\bTARJETA\\b') THEN 'TARJETA' END, CASE WHEN regexp_matches(text, '(?i)\\bCUENTA\\b') THEN 'CUENTA' END) AS products,
      replace(best[2], ',', '')::double AS amount, CASE WHEN best IS NULL THEN NULL WHEN regexp_matches(text, '(?i)\\bd[oó]lares\\b') THEN 'USD' WHEN regexp_matches(text, '(?i)\\bpesos\\b') OR contains(best[1], '$') THEN 'MXN' END AS currency,
      best IS NOT NULL OR regexp_matches(text, '{X.PARTIAL}') AS partial FROM b"""
)
def ext06_09_amounts(spark, d):
    t = F.col("text")
    a = X.amount(t)
    return I.notices(spark, d).select("case_id", F.array_join(X.named_accounts(t), ",").alias("accounts"), F.array_join(X.products(t), ",").alias("products"), a["value"].cast("double").alias("amount"), a["currency"].alias("currency"), X.is_partial(t).alias("partial"))


_DATES = """list_concat(list_concat(list_transform(regexp_extract_all(text, '{iso}', 1), lambda x: try_strptime(x, '%Y-%m-%d')::date), list_transform(regexp_extract_all(text, '{slash}', 1), lambda x: try_strptime(x, '%d/%m/%Y')::date)),
   list_transform(regexp_extract_all(text, '{es}', 1), lambda x: make_date(string_split(x, ' de ')[3]::bigint, list_position({months}, lower(string_split(x, ' de ')[2]))::bigint, string_split(x, ' de ')[1]::bigint)))""".format(iso=X.DATE_ISO, slash=X.DATE_SLASH, es=X.DATE_SPANISH, months=I._sql_list(X.MONTHS))


@query(
    f"""WITH {I.NOTICES}, f AS (SELECT *, list_filter({_DATES}, lambda x: x IS NOT NULL) AS ds FROM notices)
    SELECT case_id, list_filter(regexp_extract_all(text, '{X.CASE_REFERENCE}', 1), lambda x: upper(x) <> 'NONE')[1] AS reference,
      concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in X.DOCUMENT_TYPES)}) AS documents,
      CASE WHEN len(ds) >= 2 THEN list_min(ds) END AS first_day, CASE WHEN len(ds) >= 2 THEN list_max(ds) END AS last_day,
      coalesce(nullif(regexp_extract(text, '{X.CLABE_ANY}', 1), ''), nullif(regexp_extract(text, '{X.ACCOUNT_NAMED}', 1), '')) AS transfer FROM f"""
)
def ext10_14_details(spark, d):
    t = F.col("text")
    r = X.date_range(t)
    return I.notices(spark, d).select("case_id", X.referenced_case(t, F.lit("NONE")).alias("reference"), F.array_join(X.document_types(t), ",").alias("documents"), r["first"].alias("first_day"), r["last"].alias("last_day"), X.transfer_account(t).alias("transfer"))


@query(f"WITH {I.NOTICES} SELECT case_id, left(trim(nullif(regexp_extract(text, '{X.INFORMATION}'), '')), 200) AS phrase FROM notices")
def ext13_information(spark, d):
    return I.notices(spark, d).select("case_id", X.information_phrase(F.col("text")).alias("phrase"))


def _sql_first(p: str, g: int = 0) -> str:
    return f"nullif(regexp_extract(text, '{p}', {g}), '')"


@query(
    f"""WITH {I.NOTICES} SELECT case_id, regexp_replace({_sql_first(X.CASE_TEXT)}, '[ \\t]*([-–])[ \\t]*', '\\1', 'g') AS case_number, {_sql_first(X.OFFICE)} AS office,
      CASE WHEN regexp_matches(text, '(?i)(^|[^@.\\w])AGAFF\\b') THEN 'AGAFF' WHEN regexp_matches(text, '(?i)(^|[^@.\\w])CNBV\\b') THEN 'CNBV' WHEN regexp_matches(text, '(?i)(^|[^@.\\w])SAT\\b') THEN 'SAT' END AS authority,
      lower({_sql_first(X.EMAIL)}) AS email, coalesce(trim({_sql_first(X.PHONE_LABELLED, 1)}), {_sql_first(X.PHONE)}) AS phone, {_sql_first(X.POSTCODE, 1)} AS postcode, {_sql_first(X.TERM, 1)}::int AS term_days,
      CASE WHEN regexp_matches(text, '{X.SEIZED}') THEN true WHEN regexp_matches(text, '{X.RELEASED}') THEN false END AS seized FROM notices"""
)
def ext15_text_fields(spark, d):
    fields = X.text_fields(F.col("text"))
    return I.notices(spark, d).select("case_id", *(fields[n].alias(n) for n in ("case_number", "office", "authority", "email", "phone", "postcode", "term_days", "seized")))


@query(
    f"""WITH {I.NOTICES} SELECT case_id, {_sql_first('[A-Z]/[A-Z]{1,2}[0-9]+-[0-9]+-[0-9]+-[A-Z]+')} AS case_number,
      CASE WHEN contains(upper(text), 'ASEGURAMIENTO') THEN 'ASEGURAMIENTO' WHEN contains(upper(text), 'HACENDARIO') THEN 'HACENDARIO' WHEN contains(upper(text), 'JUDICIAL') THEN 'JUDICIAL' END AS area,
      len(list_distinct(regexp_extract_all(text, '[A-ZÑ&]{{3,4}}[0-9]{{6}}[A-Z0-9]{{3}}')))::int AS n_rfcs, least(len(list_distinct(regexp_extract_all(text, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+'))), 10)::int AS n_names,
      len(list_distinct(regexp_extract_all(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')))::int AS n_dates, len(list_distinct(list_transform(regexp_extract_all(text, '\\$?\\s*({X.NUMBER})', 1), lambda x: replace(x, ',', '')::decimal(18,2))))::int AS n_amounts FROM notices"""
)
def ext16_19_scanned(spark, d):
    f = X.pdf_fields(F.col("text"))
    return I.notices(spark, d).select("case_id", f["case_number"].alias("case_number"), f["area"].alias("area"), *(F.size(f[n]).alias(f"n_{n}") for n in ("rfcs", "names", "dates", "amounts")))


@query(
    f"""WITH {I.NOTICES} SELECT case_id, upper({_sql_first('(?i)([A-Z]/[A-Z]{1,4}[0-9]+-[0-9]+-[0-9]+-[A-Z]+)', 1)}) AS case_number, {_sql_first(X.CLABE_ANY, 1)} AS clabe,
      {_sql_first('(?i)(?:Cuenta|Account)\\s*(?:No\\.?|Número)?:?\\s*([0-9]{10,16})', 1)} AS account,
      list_sum(list_transform(regexp_extract_all(text, '\\$\\s*([0-9,]+(?:\\.[0-9]{{2}})?)', 1), lambda x: replace(x, ',', '')::double)) AS total,
      CASE {' + '.join(f"contains(lower(text), '{x.lower()}')::int" for x in X.STANDARD_LABELS)} WHEN 0 THEN 0 WHEN 1 THEN 50 WHEN 2 THEN 75 ELSE 90 END AS confidence FROM notices"""
)
def ext20_23_structured(spark, d):
    t = F.col("text")
    f = X.structured_fields(t)
    total = F.aggregate(F.transform(f["amounts"], lambda a: a.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return I.notices(spark, d).select("case_id", f["case_number"].alias("case_number"), f["clabe"].alias("clabe"), f["account"].alias("account"), F.when(F.size(f["amounts"]) > 0, total).alias("total"), X.structured_confidence(t).alias("confidence"))


@query(
    """WITH t AS (SELECT doc_id, text, length(text) - length(replace(text, '|', '')) AS bars, regexp_matches(text, '\\|.*\\|.*\\|') AS row3, regexp_matches(text, '[-]+\\|[-]+') AS ruler,
      list_filter(regexp_split_to_array(text, '[\\r\\n]+'), lambda x: NOT regexp_matches(x, '^\\s*\\|[\\s|-]+\\|\\s*$') AND regexp_matches(x, '\\|\\s*[^|]+?\\s*\\|\\s*[^|]+?\\s*\\|')) AS ls FROM documents WHERE contains(text, '|'))
    SELECT doc_id, CASE WHEN bars >= 20 AND row3 AND ruler THEN 95 WHEN bars >= 10 AND row3 THEN 85 WHEN bars >= 4 THEN 60 ELSE 0 END AS confidence, len(ls)::int AS n_rows, regexp_extract(ls[1], '\\|\\s*([^|]+?)\\s*\\|\\s*([^|]+?)\\s*\\|', 1) AS first_key FROM t"""
)
def ext20_21_tables(spark, d):
    t = F.col("text")
    rows = X.table_rows(t)
    return table(spark, d, "documents").where(t.contains("|")).select("doc_id", X.table_confidence(t).alias("confidence"), F.size(rows).alias("n_rows"), F.get(rows, F.lit(0))["key"].alias("first_key"))


_FLAT = _PLAIN.format("upper(text)")


@query(
    f"""WITH {I.NOTICES}, p AS (SELECT case_id, text, {_FLAT} AS flat, list_min(list_filter([strpos(flat, 'OFICIO'), strpos(flat, 'RFC')], lambda i: i > 0)) AS s FROM notices),
      q AS (SELECT *, list_min(list_filter([strpos(substr(flat, s + 1), 'ACUERDO'), strpos(substr(flat, s + 1), 'PLAZO')], lambda i: i > 0)) AS e FROM p),
      r AS (SELECT case_id, CASE WHEN s IS NOT NULL THEN trim(CASE WHEN e IS NOT NULL THEN substr(text, s, e) ELSE substr(text, s) END) END AS section FROM q)
    SELECT case_id, section, CASE WHEN upper(section) LIKE 'OFICIO%' THEN nullif(trim(ltrim(substr(section, 7), ':')), '') WHEN upper(section) LIKE 'RFC%' THEN nullif(trim(ltrim(substr(section, 4), ':')), '') ELSE section END AS body FROM r"""
)
def ext24_section(spark, d):
    rows = I.notices(spark, d).select("case_id", X.sections(F.col("text"), ["OFICIO", "RFC"], ["ACUERDO", "PLAZO"]).alias("s"))
    return rows.select("case_id", F.col("s.whole").alias("section"), F.col("s.body").alias("body"))


@query(
    f"""WITH {I.NOTICES} SELECT case_id, list_sum(list_distinct(list_concat(list_transform(regexp_extract_all(text, '\\$\\s*([0-9]{{1,3}}(?:[.,\\s][0-9]{{3}})*|[0-9]+)', 1), lambda x: regexp_replace(x, '[.,\\s]', '', 'g')::double),
      list_transform(regexp_extract_all(text, '(?i)(?:monto|importe|cantidad)\\s*:?\\s*([0-9]{{1,3}}(?:[.,\\s][0-9]{{3}})*|[0-9]+)', 1), lambda x: regexp_replace(x, '[.,\\s]', '', 'g')::double)))) AS total,
      len(list_filter({_DATES}, lambda x: x IS NOT NULL))::int AS n_dates FROM notices"""
)
def ext25_26_amounts_dates(spark, d):
    t = F.col("text")
    a = X.keyword_amounts(t)
    return I.notices(spark, d).select("case_id", F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x)).alias("total"), F.size(X.dates(t)).alias("n_dates"))


def _introduced(pattern: str, place: int) -> str:
    each = f"regexp_extract_all(text, '{pattern}', {{}})"
    return f"list_transform(list_zip({each.format(0)}, {each.format(1)}), lambda x: {{'w': x[1], 'v': x[2]}})"


_VALUE = r"([A-Za-z0-9\-/.]+)"
_INTRODUCED = [rf"(?i)\b(?:expediente|exp\.?|exped\.?)\s*[:#]?\s*{_VALUE}", rf"(?i)\b(?:no\.?\s*)?expediente\s+{_VALUE}", rf"(?i)\bexp\.?\s+no\.?\s*{_VALUE}", rf"(?i)\bexpediente\s+num\.?\s*{_VALUE}"]


@query(
    f"""WITH {I.NOTICES}, t AS (SELECT case_id, CASE case_id % 4 WHEN 0 THEN replace(text, 'Expediente', 'Tribunal, expediente no.') WHEN 1 THEN replace(text, 'Expediente', 'Exp. No.') WHEN 2 THEN replace(text, 'Expediente', 'EXPEDIENTE NUM.') ELSE text END AS text FROM notices),
      c AS (SELECT case_id, text, unnest(list_concat(list_concat({_introduced(_INTRODUCED[0], 0)}, {_introduced(_INTRODUCED[1], 1)}), list_concat({_introduced(_INTRODUCED[2], 2)}, {_introduced(_INTRODUCED[3], 3)}))) AS s FROM t),
      g AS (SELECT case_id, upper(s.v) AS value, least(5 + 2 * regexp_matches(s.v, '[0-9]')::int + regexp_matches(s.v, '\\b[0-9]{{4}}\\b')::int + regexp_matches(s.v, '[/-]')::int
        + regexp_matches(lower(substr(text, greatest(strpos(text, s.w) - 50, 1), strpos(text, s.w) - greatest(strpos(text, s.w) - 50, 1) + length(s.w) + 50)), 'tribunal|juzgado|corte|judicial|legal')::int, 10) AS tenths
        FROM c WHERE length(s.v) BETWEEN 3 AND 50 AND regexp_matches(s.v, '[A-Za-z0-9]') AND lower(s.v) NOT IN ('de', 'del', 'la', 'el', 'en', 'por', 'para'))
    SELECT n.case_id, b.value, b.tenths / 10.0::double AS score, coalesce(k.n, 0)::int AS n FROM notices n LEFT JOIN (SELECT * FROM g WHERE tenths >= 6 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY tenths DESC, value DESC) = 1) b USING (case_id)
      LEFT JOIN (SELECT case_id, count(*) AS n FROM g WHERE tenths >= 6 GROUP BY 1) k USING (case_id)"""
)
def ext27_39_case_candidates(spark, d):
    k, text = F.col("case_id") % 4, F.col("text")
    as_ = lambda by: F.replace(text, F.lit("Expediente"), F.lit(by))
    rows = I.notices(spark, d).select("case_id", F.when(k == 0, as_("Tribunal, expediente no.")).when(k == 1, as_("Exp. No.")).when(k == 2, as_("EXPEDIENTE NUM.")).otherwise(text).alias("text"))
    rows = rows.select("case_id", X.scored_case_numbers(text).alias("found"))
    best = F.get("found", F.lit(0))
    return rows.select("case_id", best["value"].alias("value"), best["score"].cast("double").alias("score"), F.size("found").alias("n"))


_KIND = "CASE WHEN regexp_matches(lower({0}), 'desbloqueo|desbloquear') THEN 'desbloqueo' WHEN regexp_matches(lower({0}), 'bloqueo|bloquear') THEN 'bloqueo' WHEN regexp_matches(lower({0}), 'transferencia|transferir') THEN 'transferencia' WHEN regexp_matches(lower({0}), 'documentación|documento') THEN 'documentacion' WHEN regexp_matches(lower({0}), 'información|informar') THEN 'informacion' ELSE 'general' END"


@query(f"WITH {I.NOTICES}, s AS (SELECT case_id, unnest(string_split(text, '. ')) AS s FROM notices) SELECT {_KIND.format('s')} AS kind, count(*) AS n, count(DISTINCT case_id) AS cases FROM s GROUP BY 1")
def ext28_requirement_types(spark, d):
    """Sentences of notices by kind of requirement."""
    s = I.notices(spark, d).select("case_id", F.explode(F.split("text", r"\. ")).alias("s"))
    return s.groupBy(X.requirement_type(F.col("s")).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("cases"))


@query()
def ext28_requirements(spark, d):
    """What each notice asks for, with the confidence of the reading. Patterns look ahead, which DuckDB's can't."""
    found = X.requirements(F.col("text"))
    return I.notices(spark, d).select("case_id", F.size(found).alias("n"), X.requirement_confidence(found).alias("confidence"))


@query(f"WITH {I.NOTICES} SELECT case_id, array_to_string(list_concat(list_concat(list_transform(regexp_extract_all(text, '(?i)Acuerdo\\s+([0-9]+/[0-9]{{4}})', 1), lambda x: 'Acuerdo ' || x), list_transform(regexp_extract_all(text, '(?i)Ley\\s+([0-9]+/[0-9]{{4}})', 1), lambda x: 'Ley ' || x)), list_transform(regexp_extract_all(text, '(?i)Circular\\s+([0-9]+/[0-9]{{4}})', 1), lambda x: 'Circular ' || x)), ';') AS instruments FROM notices")
def ext29_instruments(spark, d):
    return I.notices(spark, d).select("case_id", F.array_join(X.instruments(F.col("text")), ";").alias("instruments"))


@query(
    f"""WITH {I.NOTICES}, e AS (SELECT DISTINCT upper(unnest(regexp_extract_all(text, '(?i)Juzgado \\w+|tribunal|\\bSAT\\b'))) AS name FROM notices)
    SELECT name, CASE WHEN contains(name, 'JUZGADO') THEN 'Juzgado' WHEN contains(name, 'TRIBUNAL') THEN 'Tribunal' ELSE 'Otro' END AS type FROM e"""
)
def ext30_40_authorities(spark, d):
    """Authorities named in texts, each once, with their kinds."""
    found = I.notices(spark, d).select(F.explode(X.every(F.col("text"), r"(?i)Juzgado \w+|tribunal|\bSAT\b")).alias("n"))
    return found.select(F.upper("n").alias("name")).distinct().select("name", X.authority_type(F.col("name")).alias("type"))


#: Names of authorities for the catalogue below.
_ENTITIES = (
    "Fiscalía General de la República", "FISCALIA ESTATAL", "Procuraduría Fiscal", "Procuraduría de la Defensa", "Juzgado Quinto de Distrito", "Tribunal Federal", "Secretaría de Hacienda", "Dirección  de Procesos,", "Administración Desconcentrada.", "Subadministración 3",
    "Consejo de la Judicatura Federal", "Comisión Nacional Bancaria y de Valores", "Delegación Norte", "SUBDELEGACIÓN 8", "Agencia del Ministerio Público", "Unidad de Inteligencia Financiera", "Sala Superior", "Antesala", "Pleno Regional", "Centro de Justicia , .",
    "Coordinación Jurídica de la Ciudad de México", "Instituto Mexicano CDMX", "Órgano Interno", "organo de control", "SAT",
)


@query(
    f"""WITH e AS (SELECT p_partkey, {I._sql_list(_ENTITIES)}[p_partkey % {len(_ENTITIES)} + 1] AS raw FROM part), n AS (SELECT p_partkey, lower(raw) AS l, regexp_replace(regexp_replace(trim(raw), '\\s+', ' ', 'g'), '\\s*[,.]+$', '') AS name FROM e)
    SELECT p_partkey, name, CASE WHEN l LIKE '%fiscalía%' OR l LIKE '%fiscalia%' OR l LIKE '%fiscal general%' THEN 'Fiscalía' WHEN l LIKE '%procuraduría%' OR l LIKE '%procuraduria%' THEN 'Procuraduría' WHEN l LIKE '%juzgado%' THEN 'Juzgado' WHEN l LIKE '%tribunal%' THEN 'Tribunal'
      WHEN l LIKE '%secretaría%' OR l LIKE '%secretaria%' THEN 'Secretaría' WHEN l LIKE '%dirección%' OR l LIKE '%direccion%' THEN 'Dirección' WHEN l LIKE '%administración%' OR l LIKE '%administracion%' THEN 'Administración' WHEN l LIKE '%consejo%' THEN 'Consejo'
      WHEN l LIKE '%comisión%' OR l LIKE '%comision%' THEN 'Comisión' WHEN l LIKE '%delegación%' OR l LIKE '%delegacion%' THEN 'Delegación' WHEN l LIKE '%subdelegación%' OR l LIKE '%subdelegacion%' THEN 'Subdelegación' WHEN l LIKE '%agencia%' THEN 'Agencia' WHEN l LIKE '%unidad%' THEN 'Unidad'
      WHEN l LIKE '%sala %' THEN 'Sala' WHEN l LIKE '%pleno %' THEN 'Pleno' WHEN l LIKE '%centro %' THEN 'Centro' WHEN l LIKE '%coordinación%' OR l LIKE '%coordinacion%' THEN 'Coordinación' WHEN l LIKE '%subadministración%' THEN 'Subadministración' WHEN l LIKE '%instituto%' THEN 'Instituto'
      WHEN l LIKE '%órgano%' OR l LIKE '%organo%' THEN 'Órgano' ELSE 'Otro' END AS type, CASE WHEN l LIKE '%federal%' THEN 'Federal' WHEN l LIKE '%ciudad de méxico%' OR l LIKE '%cdmx%' THEN 'Ciudad de México' END AS jurisdiction FROM n"""
)
def ext40_entities(spark, d):
    """Catalogue names tidied, with kind and jurisdiction."""
    raw = I._pick(_ENTITIES, F.col("p_partkey") % len(_ENTITIES))
    rows = table(spark, d, "part").select("p_partkey", raw.alias("raw"))
    return rows.select("p_partkey", X.tidy_authority(F.col("raw")).alias("name"), X.authority_type(F.col("raw")).alias("type"), X.jurisdiction(F.col("raw")).alias("jurisdiction"))


@query("SELECT d.doc_id, sha256(d.text) AS digest, d.n_chars AS size FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents p WHERE p.doc_id % 2 = 0 AND sha256(p.text) = sha256(d.text))")
def ext31_changed(spark, d):
    """Texts whose digest isn't among those seen before (here: those of even ids)."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.col("n_chars").alias("size"))
    return docs.join(docs.where("doc_id % 2 = 0").select("digest").distinct(), "digest", "left_anti").select("doc_id", "digest", "size")


@query("""SELECT event_id, event_type, CASE event_id % 8 WHEN 7 THEN NULL WHEN 6 THEN '"' || json_extract_string(props, '$.k') || '"' ELSE json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 8 = 7 THEN '{}' WHEN event_id % 8 = 6 THEN '{"k": "\\"' || json_extract_string(props, '$.k') || '\\""}' WHEN event_id % 8 >= 5 THEN '{"k": "' || json_extract_string(props, '$.k') || '"}' ELSE '{"k": ' || json_extract_string(props, '$.k') || '}' END AS object FROM events""")
def ext32_json(spark, d):
    """JSON read out of a model's answers: as it is, in a fence, with a trailing comma, in single quotes, without quotes, as
    pairs (whose values are texts, quotes included), and not there at all."""
    k = F.get_json_object("props", "$.k")
    forms = (F.col("props"), F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```")), F.concat(F.lit("{'k': "), k, F.lit(",}")), F.concat(F.lit("so: {'k': "), k, F.lit("} done")), F.concat(F.lit("{k: "), k, F.lit("}")), F.concat(F.lit("k = "), k), F.concat(F.lit('the "k": "'), k, F.lit('" it is')))
    answer = F.coalesce(*(F.when(F.col("event_id") % 8 == i, f) for i, f in enumerate(forms)), F.lit("nothing"))
    rows = table(spark, d, "events").select("event_id", "event_type", json_repaired(answer).alias("object"))
    return rows.select("event_id", "event_type", F.get_json_object("object", "$.k").alias("k"), "object")


@query("SELECT CASE WHEN value / 100 >= 0.8 THEN 'HIGH' WHEN value / 100 >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS grade, value / 100 < 0.8 AS review, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1, 2")
def ext36_grades(spark, d):
    """A batch's summary by grade of confidence, and whether a grade is to be reviewed."""
    rows = table(spark, d, "events").select("value", X.quality_grade(F.col("value") / 100).alias("g"))
    return rows.groupBy("g.grade", "g.review").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


_AREAS = ("ASEGURAMIENTO", "Operaciones Ilícitas", "informe  judicial", "ÁREA HACENDARIA", "desembargo")


@query(
    f"""WITH {I.NOTICES}, a AS (SELECT case_id, CASE WHEN case_id % 13 = 0 THEN ' ' ELSE text END AS text, {I._sql_list(_AREAS)}[case_id % 5 + 1] AS area FROM notices)
    SELECT case_id, CASE WHEN case_id % 10 = 0 THEN 'Aseguramiento' WHEN trim(text) = '' THEN 'Informacion' WHEN regexp_matches(upper(text), 'DEJAR SIN EFECTOS|ELIMINA|REANUD') THEN 'Desbloqueo' WHEN regexp_matches(upper(text), 'COPIA CERTIFICADA|DOCUMENT') THEN 'Documentacion' WHEN contains(upper(text), 'TRANSFER') THEN 'Transferencia'
      WHEN contains(upper(text), 'BLOQ') THEN 'Aseguramiento' WHEN contains(upper(text), 'DESBLO') OR contains(upper(text), 'LIBER') THEN 'Desbloqueo' WHEN contains(upper(text), 'TRANS') OR contains(upper(text), 'TRASP') THEN 'Transferencia' WHEN contains(upper(text), 'INFO') THEN 'Informacion' WHEN contains(upper(text), 'DOC') THEN 'Documentacion' WHEN contains(upper(text), 'IGNOR') THEN 'Ignorar' ELSE 'Otro' END AS measure,
      ['Aseguramiento', 'OperacionesIlicitas', 'InformeJudicial', 'ÁreaHacendaria', 'Desembargo'][case_id % 5 + 1] AS subdivision FROM a"""
)
def ext37_measure(spark, d):
    k = F.col("case_id")
    rows = I.notices(spark, d).select("case_id", F.when(k % 13 == 0, " ").otherwise(F.col("text")).alias("text"))
    return rows.select("case_id", X.measure_hint(k % 10 == 0, F.col("text")).alias("measure"), X.subdivision_hint(I._pick(_AREAS, k % 5)).alias("subdivision"))


@query(
    """WITH c AS (SELECT p_partkey, ['spa', 'ENG', '', 'xyz', NULL][p_partkey % 5 + 1] AS language, ['eng', '', 'qq'][p_partkey % 3 + 1] AS fallback, ['json', 'PDF', 'docx', ''][p_partkey % 4 + 1] AS format, p_size % 6 - 1 AS oem, p_partkey % 17 - 1 AS psm, p_size / 40.0::double AS confidence,
      p_partkey % 7 * 700 AS timeout, p_partkey % 14 - 1 AS retries, p_partkey % 11 * 35 - 1 AS delay, p_partkey % 13 * 9 AS file_size, p_partkey % 23 AS concurrency, p_partkey % 19 * 6 AS batch, p_partkey % 3 * 1025 AS memory FROM part)
    SELECT p_partkey, concat_ws(',', CASE WHEN coalesce(language, '') = '' OR lower(language) NOT IN ('spa', 'eng') THEN 'language' END, CASE WHEN fallback = 'qq' THEN 'fallback_language' END, CASE WHEN format = 'docx' THEN 'output_format' END,
        CASE WHEN oem NOT BETWEEN 0 AND 3 THEN 'oem' END, CASE WHEN psm NOT BETWEEN 0 AND 13 THEN 'psm' END, CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence' END, CASE WHEN timeout <= 0 OR timeout > 3600 THEN 'timeout_seconds' END, CASE WHEN retries < 0 THEN 'max_retries' END,
        CASE WHEN delay < 0 THEN 'retry_delay_seconds' END, CASE WHEN file_size <= 0 THEN 'max_file_size_mb' END, CASE WHEN concurrency <= 0 THEN 'max_concurrency' END, CASE WHEN batch <= 0 THEN 'batch_size' END, CASE WHEN memory <= 0 THEN 'max_memory_mb' END) AS errors,
      concat_ws(',', CASE WHEN confidence > 0.95 OR confidence < 0.5 THEN 'confidence' END, CASE WHEN retries > 10 THEN 'max_retries' END, CASE WHEN delay > 300 THEN 'retry_delay_seconds' END, CASE WHEN file_size > 100 THEN 'max_file_size_mb' END, CASE WHEN concurrency > 20 THEN 'max_concurrency' END,
        CASE WHEN batch > 100 THEN 'batch_size' END, CASE WHEN memory > 2048 THEN 'max_memory_mb' END) AS warnings FROM c"""
)
def val15_configuration(spark, d):
    """Configurations with what is wrong in them and what is only doubtful."""
    k, size = F.col("p_partkey"), F.col("p_size")
    settings = {
        "language": F.when(k % 5 < 4, I._pick(("spa", "ENG", "", "xyz"), k % 5)), "fallback_language": I._pick(("eng", "", "qq"), k % 3), "output_format": I._pick(("json", "PDF", "docx", ""), k % 4), "oem": size % 6 - 1, "psm": k % 17 - 1, "confidence": size / 40.0,
        "timeout_seconds": k % 7 * 700, "max_retries": k % 14 - 1, "retry_delay_seconds": k % 11 * 35 - 1, "max_file_size_mb": k % 13 * 9, "max_concurrency": k % 23, "batch_size": k % 19 * 6, "max_memory_mb": k % 3 * 1025,
    }
    rows = table(spark, d, "part").select("p_partkey", *(c.alias(n) for n, c in settings.items()))
    out = templates.configuration_problems({n: F.col(n) for n in settings})
    return rows.select("p_partkey", F.array_join(out["errors"], ",").alias("errors"), F.array_join(out["warnings"], ",").alias("warnings"))


@query(
    """WITH p AS (SELECT a.p_partkey, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
    SELECT p_partkey, levenshtein(x, y)::int AS distance, round(greatest(0, 1 - levenshtein(x, y)::double / greatest(length(x), length(y))), 9) AS similarity,
      CASE WHEN contains(x, y) OR contains(y, x) THEN greatest(least(length(x), length(y))::double / greatest(length(x), length(y)), 0.7) ELSE round(1 - levenshtein(x, y)::double / greatest(length(x), length(y)), 2) END AS field_similarity,
      CASE WHEN length(x) = 0 THEN 0 ELSE (length(x) - length(y))::double / length(x) * 100 END AS improvement FROM p"""
)
def sim01_02_10_12_distance(spark, d):
    part = table(spark, d, "part")
    p = part.select("p_partkey", F.col("p_name").alias("x")).join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("y")), "p_partkey")
    x, y = F.col("x"), F.col("y")
    return p.select("p_partkey", S.distance(x, y).alias("distance"), F.round(S.similarity(x, y), 9).alias("similarity"), S.field_name_similarity(x, y).alias("field_similarity"), S.improvement(F.length(x), F.length(y)).cast("double").alias("improvement"))


@query()
def sim03_04_ratios(spark, d):
    """Ratio, token-sort ratio and name score of suppliers' and customers' names; the tests pin known values."""
    s, c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("a")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("b"))
    a, b = F.col("a"), F.col("b")
    return s.join(c, "k").select("k", S.ratio(a, b).alias("ratio"), S.token_sort_ratio(a, b).alias("sorted"), S.name_score(a, b).alias("score"))


@query()
def sim05_best_window(spark, d):
    """The window of each notice that is most like a phrase; the tests hold it against brute force."""
    best = S.best_window(F.lit("bloqueo de fondos"), F.col("text"))
    return I.notices(spark, d).select("case_id", best["score"].alias("score"), best["start"].alias("start"), best["words"].alias("words"))


@query(
    r"""WITH t AS (SELECT doc_id, text, length(text)::double AS n, length(regexp_replace(text, '[^\p{L}\p{Nd}]', '', 'g'))::double AS al, length(text)::double - length(regexp_replace(text, '\s', '', 'g')) AS sp,
      list_filter(regexp_split_to_array(text, '[ \n\r\t]+'), lambda w: w <> '') AS ws FROM documents)
    SELECT doc_id, CASE WHEN text IS NULL OR NOT regexp_matches(text, '\S') THEN 0 ELSE round(40 * al / n + 20 * greatest(0, least(1, 1 - abs(sp / n - 0.175) / 0.175)) + 20 * greatest(0, 1 - ((n - al - sp) / n) / 0.1)
      + 10 * (1 - least(1, abs(list_sum(list_transform(ws, lambda w: length(w)))::double / len(ws) - 5.5) / 5.5)) + 10 * len(list_filter(ws, lambda w: length(w) BETWEEN 2 AND 15))::double / len(ws), 6) END AS score FROM t"""
)
def sim06_quality(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(S.quality_score(F.col("text")), 6).alias("score"))


@query()
def sim07_names_match(spark, d):
    return _names(spark, d).select("c_custkey", S.names_match(F.col("name"), F.lit("Juan Peres")).alias("same"))


@query(
    """WITH f AS (SELECT o_orderkey AS case_id, unnest([{'f': 'status', 'a': o_orderstatus, 'b': CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END}, {'f': 'priority', 'a': o_orderpriority, 'b': CASE WHEN o_orderkey % 3 = 0 THEN '@' ELSE o_orderpriority END}, {'f': 'note', 'a': '', 'b': ''}]) AS s FROM orders)
    SELECT case_id, count(*) FILTER (s.a = s.b)::int AS matches, avg(CASE WHEN s.a = s.b THEN 1.0 ELSE 0.0 END)::double AS similarity FROM f GROUP BY 1"""
)
def sim08_09_compare_records(spark, d):
    """Two observations of each order compared field by field; differing values have no letter in common."""
    k = F.col("o_orderkey")
    pair = lambda n, a, b: F.struct(F.lit(n).alias("field"), a.alias("a"), b.alias("b"))
    rows = table(spark, d, "orders").select(k.alias("case_id"), F.explode(F.array(pair("status", F.col("o_orderstatus"), F.when(k % 5 == 0, "").otherwise(F.col("o_orderstatus"))), pair("priority", F.col("o_orderpriority"), F.when(k % 3 == 0, "@").otherwise(F.col("o_orderpriority"))), pair("note", F.lit(""), F.lit("")))).alias("s"))
    c = S.compare_field(F.col("s.a"), F.col("s.b"))
    return rows.groupBy("case_id").agg(F.count_if(c["status"] == "Match").cast("int").alias("matches"), F.avg(c["score"]).alias("similarity"))


@query()
def sim11_sequence_match(spark, d):
    """Similarity to a truth by longest matching blocks (Ratcliff and Obershelp), a pandas function."""
    from ..functions.sequence import sequence_ratio

    part = table(spark, d, "part")
    score = sequence_ratio(F.col("p_name"), F.col("p_type"))
    return part.select("p_partkey", F.round(score, 6).alias("score"), F.when(score >= 0.9, "exact").when(score >= 0.5, "partial").otherwise("none").alias("grade"))


@query(
    r"""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE round(30 * least(length(text)::double / 1000, 1) + 40 * length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))::double / length(text)
      + 30 * (contains(lower(text), 'de')::int + contains(lower(text), 'la')::int + contains(lower(text), 'el')::int + contains(lower(text), 'en')::int + contains(lower(text), 'the')::int + contains(lower(text), 'and')::int + contains(lower(text), 'of')::int + contains(lower(text), 'to')::int)::double / 8, 6) END AS confidence FROM documents"""
)
def sim13_ocr_confidence(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(S.ocr_confidence(F.col("text")), 6).alias("confidence"))
