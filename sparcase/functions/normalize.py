"""Sanitising and normalising of field values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Remarks that people write where there is no value.
REMARKS = [
    "NO SE CUENTA",
    "EL MONTO MENCIONADO EN EL TEXTO",
    "SE TRATA DE LA MISMA PERSONA CON VARIANTE EN EL RFC",
    "NO APLICA",
    "N/A",
    "NA",
    "NO DISPONIBLE",
    "SIN DATO",
    "PENDIENTE",
]
#: Label prefixes before account numbers and bank codes.
ACCOUNT_LABEL = r"(?i)^\s*(CUENTA|ACCOUNT|CTA|NO\s*DE\s*CUENTA|NUM|NUMERO|NUMBER)\s*[:.\-]?\s*"
SWIFT_LABEL = r"(?i)^\s*(SWIFT|BIC|CODIGO|CODE|SWIFT\s*CODE|BIC\s*CODE)\s*[:.\-]?\s*"
ACCENTED = "ÁÀÄÂÃÅÉÈËÊÍÌÏÎÓÒÖÔÕÚÙÜÛÑÇáàäâãåéèëêíìïîóòöôõúùüûñç"
PLAIN = "AAAAAAEEEEIIIIOOOOOUUUUNCaaaaaaeeeeiiiiooooouuuunc"


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(F.regexp_replace(c, r"\s+", " ")) != "", c)


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def sanitize(c: Column) -> Column:
    """A field's text: entities and line breaks become spaces, runs of spaces one; remarks and blanks are null. A text with
    nothing to put right is told by one pattern."""
    text = F.regexp_replace(c, r"^\s+|\s+$", "")
    for entity in ("&nbsp;", "&amp;nbsp;", "&lt;", "&gt;", "&amp;"):
        text = F.regexp_replace(text, f"(?i){entity}", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"\r\n|\n|\r", " "), " {2,}", " "))
    text = F.when(c.rlike(r"[&\r\n]|  |^\s|\s$"), text).otherwise(c)
    return F.get(F.filter(F.array(text), lambda t: ~(F.upper(t).isin(REMARKS) | t.rlike("^[ _]*$"))), F.lit(0))


def sanitize_amount(c: Column) -> Column:
    """A non-negative amount in whole units, half a unit rounding up; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(sanitize(c), r"(?i)\$|MXN|USD|EUR", ""), "[, ]", "")
    amount = F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), bare).try_cast("decimal(38,6)")
    return F.when(amount >= 0, F.round(amount, 0).cast("decimal(38,0)").cast("string"))


def warnings(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds."""
    return F.array_compact(F.array(*(F.when(cond, F.lit(name)) for cond, name in pairs)))


def clean_account(c: Column) -> Column:
    """struct(cleaned, warnings): digits of an account number."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), ACCOUNT_LABEL, "")
    digits = F.regexp_replace(bare, "[^0-9]", "")
    none = digits == ""
    return F.struct(
        digits.alias("cleaned"),
        warnings((none, "AccountMissing"), (~none & ~F.length(digits).between(6, 20), "AccountLengthSuspect"), (~none & (digits != bare), "AccountNormalized")).alias("warnings"),
    )


def clean_swift(c: Column) -> Column:
    """struct(cleaned, warnings): a bank code; one that lacks just its branch is padded with X."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), SWIFT_LABEL, "")
    code = F.upper(F.regexp_replace(bare, "[^A-Za-z0-9]", ""))
    changed = code != bare
    pad = changed & (F.length(code) == 9) & ~bare.rlike(r"\s")
    none = code == ""
    padded = F.when(pad, F.rpad(code, 11, "X")).otherwise(code)
    return F.struct(
        padded.alias("cleaned"),
        warnings((none, "SwiftMissing"), (~none & ~F.length(padded).isin(8, 11) & ~(~pad & (F.length(padded) == 9)), "SwiftLengthSuspect"), (~none & changed, "SwiftNormalized")).alias("warnings"),
    )


def clean_generic(c: Column) -> Column:
    source = F.coalesce(c, F.lit(""))
    cleaned = F.trim(F.regexp_replace(source, r"\s+", " "))
    return F.struct(cleaned.alias("cleaned"), warnings((cleaned != source, "GenericNormalized")).alias("warnings"))


def account_and_swift(c: Column) -> Column:
    return F.struct(clean_account(c).alias("account"), clean_swift(c).alias("swift"))


def normalize_name(c: Column) -> Column:
    """Upper case, single spaces, no accents."""
    return strip_accents(F.upper(F.trim(F.regexp_replace(c, r"\s+", " "))))


def normalize_ocr(c: Column, join_hyphens: bool = True) -> Column:
    """Line breaks unified, at most one empty line, spacing around punctuation, words joined over hyphenated breaks."""
    text = F.regexp_replace(c, r"\r\n|\r", "\n")
    if join_hyphens:
        text = F.regexp_replace(text, r"([a-zA-Z])-\n([a-zA-Z])", "$1$2")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r" +([,.;:!?])", "$1")
    return F.trim(F.regexp_replace(text, r"([,.;:!?])([A-Za-z])", "$1 $2"))


def fix_ocr_id(c: Column) -> Column:
    """Letters that stand for digits in scanned identifiers, and dashes without spaces."""
    return F.translate(F.regexp_replace(c, r"[ \t]*([-–])[ \t]*", "$1"), "Ol", "0I")


def normalize_truth(c: Column) -> Column:
    """Upper case, single spaces, long dashes as hyphens."""
    return F.translate(F.upper(F.trim(F.regexp_replace(c, r"\s+", " "))), "–—", "--")


def normalize_field_name(c: Column) -> Column:
    """A field's name in lower case, without an accessor's prefix and a generic suffix."""
    name = F.lower(c)
    for prefix in ("get", "set", "is", "has", "the"):
        name = F.regexp_replace(name, f"^{prefix}", "")
    for suffix in ("field", "property", "value"):
        name = F.regexp_replace(name, f"{suffix}$", "")
    return name
