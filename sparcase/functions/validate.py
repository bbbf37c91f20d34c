"""Predicates on field values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import strip_accents, warnings

#: The patterns of identifiers, as each use defines them.
RFC = r"^(_)?[A-Z]{3,4}[0-9]{6}[A-Z0-9]{3}$"
CURP = r"^[A-Z]{4}[0-9]{6}[HM][A-Z]{5}[A-Z0-9]{2}$"
CASE_NUMBER = r"^[A-Z]/[A-Z0-9]+(-[A-Z0-9]+)+-[A-Z]+$"
CLABE = r"^[0-9]{18}$"
PERSON_RFC = r"(?iu)^[A-Z&Ñ]{3,4}[0-9]{6}[A-Z0-9]{3}$"
PERSON_CURP = r"(?i)^[A-Z][AEIOU][A-Z]{2}[0-9]{6}[HM][A-Z]{5}[A-Z0-9][0-9]$"
GATE_CASE = r"^[A-Z]/[A-Z]{1,4}[0-9]*[-–][0-9]+[-–][0-9]+[-–][A-Z]+$"
GATE_OFFICE = r"^[A-Z]{4,}[A-Z0-9]{0,10}/[0-9]{4}/[0-9]{6}$"
GATE_RFC = r"^[A-Z&Ñ]{3,4}[0-9]{6}[A-Z0-9]{3}$"
GATE_CURP = r"^[A-Z]{4}[0-9]{6}[HM][A-Z]{5}[A-Z0-9][0-9]$"
#: Common Spanish given names and surnames.
GIVEN_NAMES = ["jose", "maria", "juan", "luis", "carlos", "ana", "miguel", "angel", "pedro", "antonio", "fernando", "jesus", "roberto", "ricardo", "francisco", "alejandro", "cristian", "christian", "guadalupe", "sofia", "karla"]
SURNAMES = ["perez", "gonzalez", "gonzales", "garcia", "rodriguez", "hernandez", "lopez", "martinez", "ramirez", "sanchez", "diaz", "dominguez", "cruz", "gomez", "juarez"]
#: Forms of values that are no names.
NO_NAME = [r"^[A-ZÑ&]{3,4}[0-9]{6}[A-Z0-9]{3}$", r"^[A-Z]{4}[0-9]{6}[HM][A-Z]{5}[0-9A-Z][0-9]$", r"^[A-Z]/[A-Z]{1,2}[0-9]+-[0-9]+-[0-9]+-[A-Z]+$", r"^[0-9]{10,18}$", r"^\$?\s*[0-9,]+\.?[0-9]*$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{2}/[0-9]{2}/[0-9]{4}$"]


def blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"\S")


def is_rfc(c: Column) -> Column:
    return F.coalesce(c.rlike(RFC), F.lit(False))


def is_curp(c: Column) -> Column:
    return F.coalesce(c.rlike(CURP), F.lit(False))


def is_case_number(c: Column) -> Column:
    return F.coalesce(c.rlike(CASE_NUMBER), F.lit(False))


def is_clabe(c: Column) -> Column:
    return F.coalesce(c.rlike(CLABE), F.lit(False))


def is_date(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]{8}$"), F.lit(False)) & F.try_to_date(c, "yyyyMMdd").isNotNull()


def is_amount(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]+$"), F.lit(False))


def is_text(c: Column, longest: int = 30) -> Column:
    return ~blank(c) & (F.length(c) <= longest)


def identity_warnings(rfc: Column, curp: Column) -> Column:
    return warnings((blank(rfc), "RFCMissing"), (~blank(rfc) & ~rfc.rlike(PERSON_RFC), "RFCInvalid"), (blank(curp), "CURPMissing"), (~blank(curp) & ~curp.rlike(PERSON_CURP), "CURPInvalid"))


def account_warnings(action: Column, account: Column, currency: Column, swift: Column) -> Column:
    """Of Block, Unblock and Transfer actions, which need an account."""
    needs = action.isin("Block", "Unblock", "Transfer")
    return warnings(
        (needs & blank(account), "AccountMissing"),
        (needs & ~blank(account) & ~account.rlike("^[0-9]{6,20}$"), "AccountInvalidFormat"),
        (~blank(currency) & ~currency.rlike("^[A-Z]{3}$"), "CurrencyInvalid"),
        (~blank(swift) & ~swift.rlike("^[A-Za-z0-9]{8}([A-Za-z0-9]{3})?$"), "SwiftInvalid"),
    )


def parse_amount(c: Column) -> Column:
    bare = F.trim(F.regexp_replace(c, r"(?i)\$|,|MXN|USD|EUR", ""))
    return F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), bare).try_cast("decimal(38,6)")


def plausible(case_no: Column, office: Column, rfc: Column, curp: Column, amount: Column, authority: Column, applicant: Column, account: Column) -> Column:
    """Whether a model's answer has any field that can be right."""
    fits = lambda c, p: F.coalesce(F.trim(c).rlike(p), F.lit(False))
    money = F.coalesce((parse_amount(amount) > 0) & (parse_amount(amount) < 100_000_000), F.lit(False))
    named = F.coalesce((F.length(F.trim(authority)) >= 5) & F.trim(authority).contains(" "), F.lit(False))
    return fits(case_no, GATE_CASE) | fits(rfc, GATE_RFC) | fits(curp, GATE_CURP) | money | fits(office, GATE_OFFICE) | named | ~blank(applicant) | ~blank(account)


def is_name(c: Column) -> Column:
    """Whether a value reads like a person's name: four fifths letters, and none of the identifiers' forms."""
    t = F.trim(c)
    other = F.lit(False)
    for pattern in NO_NAME:
        other = other | t.rlike(pattern)
    letters = F.length(F.regexp_replace(t, r"[^\p{L} '\-]", ""))
    return F.coalesce(~blank(c) & ~other & ~t.contains("/") & ~t.contains("$") & (letters / F.length(t) >= 0.8), F.lit(False))


def is_hispanic_name(c: Column) -> Column:
    """An accent, a common given name or surname, or a patronymic ending."""
    tokens = F.split(F.trim(F.regexp_replace(strip_accents(F.lower(c)), r"\s+", " ")), " ")
    known = lambda t: t.isin(GIVEN_NAMES + SURNAMES) | t.endswith("ez") | t.endswith("es")
    return F.coalesce(c.rlike("[áéíóúñÁÉÍÓÚÑ]") | F.exists(tokens, known), F.lit(False))
