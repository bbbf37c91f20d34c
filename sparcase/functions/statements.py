"""Fields of scanned pages by rules: notices read by an OCR engine, and bank statements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extract import every, first


@dataclass(frozen=True)
class Rules:
    """Patterns in order, each with the value as its first group; by_line tells which fields are sought line by line."""

    dates: tuple[str, ...]
    authorities: tuple[str, ...]
    numbers: tuple[str, ...]
    kinds: tuple[str, ...]
    by_line: bool
    entities: tuple[str, ...] = ()
    amounts: tuple[str, ...] = ()
    date_by_line: bool = True


#: The patterns of each engine's rules.
LINEWISE = Rules(
    dates=(r"(?i)FECHA[:\s]*([0-9]{4}-[0-9]{2}-[0-9]{2})", r"(?i)FECHA[:\s]*([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4})", r"(?i)([0-9]{1,2}\s+de\s+\w+\s+de\s+[0-9]{4})", r"([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2})"),
    authorities=(r"(CONDUSEF)", r"(CNBV)", r"(CNSF)", r"(BANXICO)"),
    numbers=(r"EXPEDIENTE[:\s]*([A-Z0-9\-/]+)", r"EXP[:.\s]*([A-Z0-9\-/]+)", r"OFICIO[:\s]*([A-Z0-9\-/]+)"),
    kinds=(r"(REQUERIMIENTO\s+DE\s+INFORMACIÓN)", r"(REQUERIMIENTO)", r"(SOLICITUD\s+DE\s+INFORMACIÓN)", r"(SOLICITUD)", r"(OFICIO)", r"(SANCIÓN)", r"(MULTA)"),
    by_line=True,
    amounts=(r"\$\s*([0-9,]+\.?[0-9]*)",),
)
WHOLE = Rules(
    dates=(r"FECHA[:\s]*([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2})", r"FECHA[:\s]*([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4})", r"([0-9]{1,2}\s+DE\s+\w+\s+DE\s+[0-9]{4})", r"([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2})", r"([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4})"),
    authorities=(r"(CONDUSEF)", r"(CNBV)", r"(CNSF)", r"(BANXICO)"),
    numbers=(r"EXPEDIENTE[:\s]*([A-Z0-9\-/]+)", r"EXP(?:EDIENTE)?[:.\s]*([A-Z0-9\-/]+)", r"OFICIO[:\s]*([A-Z0-9\-/]+)", r"No\.?\s*([A-Z0-9\-/]{3,})"),
    kinds=(r"(REQUERIMIENTO\s+DE\s+INFORMACION)", r"(REQUERIMIENTO)", r"(SOLICITUD\s+DE\s+INFORMACION)", r"(SOLICITUD)", r"(OFICIO)", r"(SANCION)", r"(MULTA)", r"(CITATORIO)", r"(NOTIFICACION)", r"(RESOLUCION)"),
    by_line=False,
    entities=(r"(BBVA\s+MEXICO)", r"(BANCO EJEMPLO)", r"(SANTANDER)", r"(HSBC)", r"(SCOTIABANK)", r"(BANORTE)", r"(CITIBANK)", r"(BANCO\s+\w+)"),
    amounts=(r"\$\s*([0-9,]+\.?[0-9]*)", r"PESOS\s+([0-9,]+\.?[0-9]*)", r"MXN\s*([0-9,]+\.?[0-9]*)"),
)
BATCH = Rules(
    dates=(r"FECHA[:\s]*([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2})", r"FECHA[:\s]*([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4})", r"([0-9]{1,2}\s+DE\s+\w+\s+DE\s+[0-9]{4})", r"([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2})"),
    authorities=(r"(CONDUSEF)", r"(CNBV)", r"(CNSF)", r"(BANXICO)", r"(COMISION\s+NACIONAL\s+BANCARIA)", r"(COMISION\s+NACIONAL.*SEGUROS)", r"(PODER\s+JUDICIAL)", r"(JUZGADO.*DE.*)"),
    numbers=(r"EXPEDIENTE[:\s]*([A-Z0-9\-/]+)", r"EXP(?:EDIENTE)?[:.\s]*([A-Z0-9\-/]+)", r"OFICIO[:\s]*([A-Z0-9\-/]+)"),
    kinds=(r"(REQUERIMIENTO\s+DE\s+INFORMACION)", r"(REQUERIMIENTO)", r"(SOLICITUD\s+DE\s+INFORMACION)", r"(OFICIO)", r"(CITATORIO)", r"(RESOLUCION)"),
    by_line=False,
    date_by_line=False,
)
BRIEF = Rules(
    dates=(r"(?i)FECHA[:\s]+([0-9]{4}-[0-9]{2}-[0-9]{2})", r"([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4})", r"([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2})"),
    authorities=(r"(CONDUSEF)", r"(CNBV)", r"(CNSF)", r"(BANXICO)"),
    numbers=(r"(?i)EXPEDIENTE[:\s]+([A-Z0-9\-/]+)",),
    kinds=(r"(REQUERIMIENTO)", r"(SOLICITUD)", r"(OFICIO)"),
    by_line=True,
)


def _lines(text: Column) -> Column:
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def _first_of(text: Column, patterns: tuple[str, ...]) -> Column:
    """The value of the first pattern that has one."""
    return F.coalesce(*(first(text, p, 1) for p in patterns))


def _first_line(lines: Column, patterns: tuple[str, ...], last: bool = False) -> Column:
    """The value of the first (or last) line that has one."""
    found = F.filter(F.transform(lines, lambda x: _first_of(x, patterns)), lambda v: v.isNotNull())
    return F.try_element_at(found, F.lit(-1 if last else 1))


def scanned_fields(text: Column, rules: Rules) -> dict[str, Column]:
    """date, authority, number, kind, amount, currency and entities of a page's text by the given rules.

    The rules of LINEWISE and BRIEF take the first line that holds a field (BRIEF the last line for the number), those of
    WHOLE and BATCH the page's lines run together in capitals, WHOLE but for the date. Null counts as
    empty; a field that isn't there is null."""
    lines = _lines(F.coalesce(text, F.lit("")))
    upper = F.transform(lines, F.upper)
    whole = F.upper(F.array_join(lines, " "))
    seek = (lambda p: _first_line(upper, p)) if rules.by_line else (lambda p: _first_of(whole, p))
    found = F.transform(lines, lambda x: _first_of(x, rules.amounts)) if rules.by_line and rules.amounts else F.array(F.lit(None).cast("string"), *(first(whole, p, 1) for p in rules.amounts))
    value = F.try_element_at(F.filter(F.transform(found, lambda a: F.replace(a, F.lit(","), F.lit("")).try_cast("double")), lambda a: a.isNotNull()), F.lit(1))
    entities = F.array_sort(F.array_distinct(F.flatten(F.array(*(every(whole, p, 1) for p in rules.entities))))) if rules.entities else F.array().cast("array<string>")
    return {
        "date": _first_line(lines if rules.by_line else upper, rules.dates) if rules.date_by_line else seek(rules.dates),
        "authority": seek(rules.authorities),
        "number": _first_line(lines, rules.numbers, last=True) if rules is BRIEF else seek(rules.numbers),
        "kind": seek(rules.kinds),
        "amount": value,
        "currency": F.when(value.isNotNull(), "MXN"),
        "entities": entities,
    }


#: Patterns of a statement's holder, account and lines, banks by name, and the words of its sections.
HOLDER = (r"TITULAR[:\s]*([A-ZÁÉÍÓÚÑ\s]+)", r"HOLDER[:\s]*([A-Z\s]+)", r"NOMBRE[:\s]*([A-ZÁÉÍÓÚÑ\s]+)")
ACCOUNT_NUMBER = (r"\b([0-9]{4}[-\s]*[0-9]{4}[-\s]*[0-9]{4}[-\s]*[0-9]{4})\b", r"\b([0-9]{10,20})\b", r"CUENTA[:\s]*([0-9]+)", r"ACCOUNT[:\s]*([0-9]+)")
BANKS = ("BBVA", "BANCO EJEMPLO", "SANTANDER", "BANORTE", "HSBC", "SCOTIABANK", "CITIBANK", "BANCO AZTECA")
LINE_DATES = (r"\b([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})\b", r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b", r"\b([0-9]{1,2}-[0-9]{1,2}-[0-9]{4})\b", r"\b([0-9]{1,2}\s+\w+\s+[0-9]{4})\b")
LINE_AMOUNTS = (r"\$\s*([0-9,]+\.?[0-9]{0,2})", r"([0-9,]+\.[0-9]{2})", r"\b([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2})?)\b")
SECTIONS = {
    "account_info": ("CUENTA", "ACCOUNT", "TITULAR", "HOLDER"),
    "statement_period": ("PERIODO", "PERIOD", "FECHA", "DATE"),
    "transaction_table": ("FECHA", "DESCRIPCION", "CARGO", "ABONO", "SALDO"),
    "bank_info": ("BANCO", "BANK"),
    "balance_info": ("SALDO", "BALANCE"),
}
LEAST_TRANSACTIONS, FULL_TRANSACTIONS, LARGEST, SHORTEST = 5, 20.0, 1_000_000, 500


def account_info(text: Column) -> Column:
    """struct(holder, account, bank) of a statement's text, in capitals; null what isn't there."""
    up = F.upper(F.coalesce(text, F.lit("")))
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    bank = F.coalesce(*(F.when(up.contains(b), F.lit(b)) for b in BANKS))
    return F.struct(strip(_first_of(up, HOLDER)).alias("holder"), _first_of(up, ACCOUNT_NUMBER).alias("account"), bank.alias("bank"))


def transactions(text: Column) -> Column:
    """array(struct(date, description, amount)): of each line with a date and an amount the first amount that is a number."""

    def read(line: Column) -> Column:
        found = F.flatten(F.array(*(every(line, p, 1) for p in LINE_AMOUNTS)))
        amounts = F.filter(F.transform(found, lambda a: F.replace(a, F.lit(","), F.lit("")).try_cast("double")), lambda a: a.isNotNull())
        return F.struct(_first_of(line, LINE_DATES).alias("date"), F.substring(line, 1, 50).alias("description"), F.get(amounts, F.lit(0)).alias("amount"))

    return F.filter(F.transform(_lines(F.coalesce(text, F.lit(""))), read), lambda t: t["date"].isNotNull() & t["amount"].isNotNull())


def statement_checks(info: Column, rows: Column, consistent: Column) -> dict[str, Column]:
    """Totals, warnings, quality (0 to 1) and flags of a statement. consistent: whether its layout is."""
    n = F.size(rows)
    amounts = F.transform(rows, lambda t: t["amount"])
    total = lambda keep: F.aggregate(F.filter(amounts, keep), F.lit(0.0), lambda a, x: a + x)
    odd = F.size(F.filter(amounts, lambda a: (a > LARGEST) | (a < -LARGEST)))
    bad_account = F.coalesce(~F.regexp_replace(info["account"], "[- ]", "").rlike("^[0-9]{10,20}"), F.lit(False))
    warnings = F.array_compact(F.array(F.when(n < LEAST_TRANSACTIONS, F.concat(F.lit("Low transaction count: "), n.cast("string"))), F.when(bad_account, "Invalid account number format"), F.when(odd > 0, F.concat(F.lit("Suspicious amounts detected: "), odd.cast("string")))))
    known = F.when(info["holder"].isNotNull(), 4).otherwise(0) + F.when(info["account"].isNotNull(), 4).otherwise(0) + F.when(info["bank"].isNotNull(), 2).otherwise(0)
    finance = 1.0 - F.when(odd > 0, 0.3).otherwise(0.0) - F.when(bad_account, 0.3).otherwise(0.0) - F.when(F.size(warnings) > 2, 0.2).otherwise(0.0)
    quality = F.round(known / 10.0 * 0.25 + F.least(n / FULL_TRANSACTIONS, F.lit(1.0)) * 0.35 + F.when(consistent, 1.0).otherwise(0.7) * 0.20 + finance * 0.20, 9)
    named = F.transform(warnings, lambda w: F.concat(F.lit("FINANCIAL_"), F.replace(F.upper(w), F.lit(" "), F.lit("_"))))
    flags = F.array_compact(F.array(F.when(quality < 0.7, "QUALITY_BELOW_THRESHOLD"), F.when(n < LEAST_TRANSACTIONS, "LOW_TRANSACTION_COUNT"), F.when(info["holder"].isNull(), "MISSING_ACCOUNT_HOLDER")))
    return {
        "n": n,
        "debits": total(lambda a: a < 0),
        "credits": total(lambda a: a > 0),
        "mean": F.when(n > 0, total(lambda a: F.lit(True)) / n).otherwise(0.0),
        "quality": quality,
        "flags": F.concat(flags, named),
        "trust": F.when(quality > 0.8, "high").when(quality > 0.6, "medium").otherwise("low"),
    }


def content_checks(text: Column) -> Column:
    """struct(missing, completeness, flags): which sections of a statement its words show, and what makes it doubtful."""
    up = F.upper(F.coalesce(text, F.lit("")))
    has = {name: F.exists(F.array(*map(F.lit, words)), lambda w: up.contains(w)) for name, words in SECTIONS.items()}
    missing = F.array_compact(F.array(*(F.when(~there, name) for name, there in has.items())))
    flags = F.array_compact(F.array(F.when(up.contains("DRAFT") | up.contains("BORRADOR"), "DRAFT_WATERMARK"), F.when(F.length(up) < SHORTEST, "INSUFFICIENT_CONTENT")))
    return F.struct(missing.alias("missing"), ((len(SECTIONS) - F.size(missing)) / float(len(SECTIONS))).alias("completeness"), flags.alias("flags"))
