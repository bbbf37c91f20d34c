"""Fields out of texts. A field that isn't there is null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns of what is extracted.
RFC_ANY = r"(?iu)\b[A-ZÑ&]{3,4}[0-9]{6}[A-Z0-9]{3}\b"
CURP_STRICT = r"(?i)\b[A-Z][AEIOUX][A-Z]{2}[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[HM][A-Z]{2}[B-DF-HJ-NP-TV-Z]{3}[A-Z0-9][0-9]\b"
ACCOUNT = r"\b[0-9]{6,}\b"
ACCOUNT_NAMED = r"(?i)cuenta\s+([0-9]{4,})"
CLABE_ANY = r"\b([0-9]{18})\b"
NUMBER = r"[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2})?"
#: In order of preference.
AMOUNTS = (
    rf"(?i)\$\s*({NUMBER})",
    rf"(?i)(?:monto|cantidad|importe|suma)\s+(?:de\s+)?\$?\s*({NUMBER})",
    rf"(?iu)({NUMBER})\s+(?:pesos|d[oó]lares)",
    r"(?i)([0-9]{1,3}(?:,[0-9]{3}){2,}(?:\.[0-9]{2})?)",
)
MONEY_WORD = r"(?iu)monto|cantidad|importe|pesos|dolares|dólares"
PARTIAL = r"(?i)\b(?:parcial|hasta\s+por\s+el\s+monto|hasta\s+por\s+un\s+monto|importe\s+de)\b"
CASE_REFERENCE = r"(?i)\b([A-Z0-9]{1,20}(?:[/\-][A-Z0-9\-]{1,20}){2,})\b"
DATE_ISO = r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b"
DATE_SLASH = r"\b([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})\b"
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
DATE_SPANISH = rf"(?i)\b([0-9]{{1,2}}\s+de\s+(?:{'|'.join(MONTHS)})\s+de\s+[0-9]{{4}})\b"
DOCUMENT_TYPES = (
    ("Estado de cuenta", r"(?i)\bestados?\s+de\s+cuenta\b"),
    ("Identificación", r"(?iu)\b(?:identificaci[oó]n|INE|IFE|credencial\s+de\s+elector)\b"),
    ("Comprobante de domicilio", r"(?i)\bcomprobante\s+de\s+domicilio\b"),
    ("Contrato", r"(?i)\bcontrato\b"),
    ("Muestra de firma", r"(?iu)\b(?:muestra\s+de\s+firma|firma\s+de\s+muestra|tarjet[oó]n\s+de\s+firma)\b"),
    ("Cheque", r"(?i)\bcheque\b"),
    ("Expediente de apertura", r"(?i)\bexpediente\s+de\s+apertura\b"),
)
INFORMATION = r"(?im)(?:solicit[ao]|requier[eo]|inform[ae]r?|proporcionar|reporte)\s+(?:sobre\s+)?.{10,120}?(?:[.;]|$)"
INSTRUMENTS = ("Acuerdo", "Ley", "Circular")
CASE_TEXT = r"[A-Z]/[A-Z]{1,4}[0-9]*[ \t]*[-–][ \t]*[0-9]+[ \t]*[-–][ \t]*[0-9]+[ \t]*[-–][ \t]*[A-Z]+"
CASE_OCR = r"[A-Z]/[A-Zl]{1,4}[0-9O]*[ \t]*[-–][ \t]*[0-9O]+[ \t]*[-–][ \t]*[0-9O]+[ \t]*[-–][ \t]*[A-Z]+"
OFFICE = r"[A-Z]{4,}[A-Z0-9]{0,10}/[0-9]{4}/[0-9]{6}"
OFFICE_LABELLED = r"(?iu)(?:No\.\s*De\s*Identificaci[óo]n|N[úu]mero\s*de\s*Oficio)\s*[:：]?\s*([A-Z0-9/]+)"
CAUSE = r"(?iu)causa\s*[:：]?\s*([^\n\r]+)"
ACTION = r"(?iu)acci[óo]n\s+solicitada\s*[:：]?\s*([^\n\r]+)"
APPLICANT_LABEL = r"(?iu)Autoridad\s+solicitante\s*[:\-–—]?\s*[^\w\r\n]?\s*([^\r\n]+)"
TAX_SERVICE = r"(?iu)SAT\s*[-–]\s*Servicio\s+de\s+Administraci[oó]n\s+Tributaria"
AUTHORITIES = ("Comisión Nacional Bancaria y de Valores", "Administración General de Auditoría Fiscal Federal")
ACRONYMS = ("AGAFF", "CNBV", "SAT")
HONORIFIC = r"(?:Mtro\.|Mtra\.|Lic\.|Ing\.|Dr\.|Dra\.|C\.)\s+([A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+)+)"
TITLE = r"(?:Vicepresidente|Director|Administrador|Secretario|Titular)\s+(?:de|del)?\s+[^\n]+\n([A-ZÁÉÍÓÚÑ].+)"
EMAIL = r"(?i)[a-z0-9._-]+@[a-z0-9.-]+\.[a-z]{2,}"
#: The same, tried only where a run of its characters begins.
EMAIL_RUN = r"(?i)(?<![a-z0-9._-])[a-z0-9._-]++@[a-z0-9.-]+\.[a-z]{2,}"
PHONE_LABELLED = r"(?iu)(?:Tel[ée]fono|Tel\.?)\s*[:：]?\s*(\(?[0-9]{2}\)?\s*[0-9]{4}-[0-9]{4})"
PHONE = r"\(?[0-9]{2}\)?\s*[0-9]{4}-[0-9]{4}"
POSTCODE = r"(?i)C\.?P\.?\s*([0-9]{5})"
ADDRESS = r"(?iu)([^\n]*(?:Av\.|Ave\.|Calle|Col\.|Colonia|C\.P\.|CP|Ciudad|Del\.|Delegaci[óo]n|Municipio)[^\n]*(?:\n[^\n]*){0,3})"
ARTICLES = r"(?iu)art[íi]culos?\s+([0-9]+(?:\s*(?:y|,)\s*[0-9]+)*(?:\s+fracci[óo]n\s+[IVXLCDM]+)?(?:\s+de\s+.+?(?:ley|reglamento|c[óo]digo))?)[,\.]?"
OFFICE_UNIT = r"(?iu)(?:DIRECCI[ÓO]N|DEPARTAMENTO|MESA|TURNO|SECRETAR[ÍI]A)\s+(?:GENERAL|ESPECIAL|DE|DEL)?\s+[A-Z\s]+"
PUBLISHED = r"(?iu)(?:Fecha\s+de\s+Publicaci[óo]n|Publicado)\s*[:：]?\s*([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4})"
TERM = r"(?iu)(?:plazo\s+de|en|dentro\s+de)\s+([0-9]{1,3})\s+d[íi]as?"
SEIZED = r"(?iu)aseguramiento|embargo|bloqueo|retenci[óo]n|inmovilizaci[óo]n|congelamiento"
RELEASED = r"(?iu)desbloqueo|liberaci[óo]n|dejar sin efectos"
AREAS = ("ASEGURAMIENTO", "HACENDARIO", "JUDICIAL")
PDF_AUTHORITIES = (r"(?iu)(?:SUBDELEGACION|SUBDELEGACIÓN)\s+[0-9]+\s+[A-Z\s]+", r"(?iu)(?:ADMINISTRACION|ADMINISTRACIÓN)\s+[A-Z\s]+", r"(?iu)(?:UNIDAD|OFICINA)\s+[A-Z\s]+")
STANDARD_LABELS = ("Expediente No", "Expediente:", "Oficio:", "Oficio No", "Autoridad:", "Causa:", "Acción Solicitada:", "Accion Solicitada:")


def first(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or its group; null if there is none. The pattern is tried once."""
    return F.get(F.filter(F.array(F.regexp_extract(text, pattern, group)), lambda x: x != ""), F.lit(0))


def has(text: Column, *words: str) -> Column:
    """Whether any of the words, in small letters, is in the text, whatever its case: a cheap test before a pattern."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (low.contains(w) for w in words))


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def rfc_variants(text: Column) -> Column:
    return F.array_distinct(F.transform(every(text, RFC_ANY), F.upper))


def curp(text: Column) -> Column:
    return F.upper(first(text, CURP_STRICT))


def account(text: Column) -> Column:
    return first(text, ACCOUNT)


def action_kind(text: Column) -> Column:
    """By the first stem contained. Words for releasing contain the stem for blocking, so they count as Block here."""
    up = F.upper(text)
    kind = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "Unknown").when(up.contains("BLOQ"), "Block")
    for stems, name in ((("DESBLO", "LIBER"), "Unblock"), (("TRANS", "TRASP"), "Transfer"), (("INFO",), "Information"), (("DOC",), "Document"), (("IGNOR",), "Ignore")):
        for stem in stems:
            kind = kind.when(up.contains(stem), name)
    return kind.otherwise("Other")


def bare_account(text: Column) -> Column:
    bare = F.replace(text, F.lit(" "), F.lit(""))
    return F.when(F.length(bare) >= 6, bare)


def named_accounts(text: Column) -> Column:
    return F.array_distinct(every(text, ACCOUNT_NAMED, 1))


def products(text: Column) -> Column:
    return F.array_compact(F.array(F.when(text.rlike(r"(?i)\bTARJETA\b"), "TARJETA"), F.when(text.rlike(r"(?i)\bCUENTA\b"), "CUENTA")))


def amount(text: Column) -> Column:
    """struct(value, currency). The first kind of pattern that matches decides; of its matches the longest, the first of
    equals. Long runs of digits without a sign of money are account numbers."""
    found = []
    for pattern in AMOUNTS:
        pairs = F.zip_with(every(text, pattern), every(text, pattern, 1), lambda whole, number: F.struct(whole.alias("whole"), number.alias("number")))
        money = F.filter(pairs, lambda p: ~((F.length(F.regexp_replace(p["number"], "[,.]", "")) >= 10) & ~p["whole"].contains("$") & ~p["whole"].rlike(MONEY_WORD)))
        longest = F.array_max(F.transform(money, lambda p: F.length(p["whole"])))
        found.append(F.get(F.filter(money, lambda p: F.length(p["whole"]) == longest), F.lit(0)))
    best = F.coalesce(*found)
    currency = F.when(best.isNull(), None).when(text.rlike(r"(?iu)\bd[oó]lares\b"), "USD").when(text.rlike(r"(?iu)\bpesos\b") | best["whole"].contains("$"), "MXN")
    return F.struct(F.replace(best["number"], F.lit(","), F.lit("")).cast("decimal(18,2)").alias("value"), currency.alias("currency"))


def is_partial(text: Column) -> Column:
    return amount(text)["value"].isNotNull() | text.rlike(PARTIAL)


def referenced_case(text: Column, current: Column) -> Column:
    """The first case number that isn't the case's own."""
    own = F.upper(F.trim(F.coalesce(current, F.lit(""))))
    return F.get(F.filter(every(text, CASE_REFERENCE, 1), lambda c: F.upper(c) != own), F.lit(0))


def spanish_date(c: Column) -> Column:
    parts = F.split(F.lower(c), r"\s+de\s+")
    month = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), F.element_at(parts, 2))
    return F.when(month > 0, F.try_to_date(F.concat_ws("-", F.element_at(parts, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.element_at(parts, 1), 2, "0")), "yyyy-MM-dd"))


def dates(text: Column) -> Column:
    """All dates, in order: ISO ones, slashed ones (day first), Spanish ones."""
    slashed = F.transform(every(text, DATE_SLASH, 1), lambda d: F.try_to_date(d, "d/M/yyyy"))
    return F.array_compact(F.concat(F.transform(every(text, DATE_ISO, 1), lambda d: F.try_to_date(d, "yyyy-MM-dd")), slashed, F.transform(every(text, DATE_SPANISH, 1), spanish_date)))


def date_range(text: Column) -> Column:
    """struct(first, last); null unless there are two dates or more."""
    some = dates(text)
    return F.struct(F.when(F.size(some) >= 2, F.array_min(some)).alias("first"), F.when(F.size(some) >= 2, F.array_max(some)).alias("last"))


def document_types(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(name)) for name, p in DOCUMENT_TYPES)))


def information_phrase(text: Column) -> Column:
    return F.substring(F.trim(first(text, INFORMATION)), 1, 200)


def transfer_account(text: Column) -> Column:
    return F.coalesce(first(text, CLABE_ANY, 1), first(text, ACCOUNT_NAMED, 1))


def instruments(text: Column) -> Column:
    return F.concat(*(_instrument(text, name) for name in INSTRUMENTS))


def _instrument(text: Column, name: str) -> Column:
    return F.transform(every(text, rf"(?i){name}\s+([0-9]+/[0-9]{{4}})", 1), lambda n: F.concat(F.lit(f"{name} "), n))


def case_number(text: Column) -> Column:
    """Strictly, else with letters that scanning took for digits put right."""
    dashes = lambda c: F.regexp_replace(c, r"[ \t]*([-–])[ \t]*", "$1")
    return F.coalesce(dashes(first(text, CASE_TEXT)), F.translate(dashes(first(text, CASE_OCR)), "Ol", "0I"))


def authority(text: Column) -> Column:
    """By label, by name, then by acronym outside of addresses."""
    labelled = F.when(has(text, "autoridad"), F.trim(F.regexp_replace(F.trim(first(text, APPLICANT_LABEL, 1)), r"^\*+|\*+$", "")))
    labelled = F.get(F.filter(F.array(labelled), lambda x: x != ""), F.lit(0))
    named = [F.when(has(text, a.lower()), F.lit(a)) for a in AUTHORITIES]
    short = [F.when(has(text, a.lower()) & text.rlike(rf"(?i)(?<![@.])\b{a}\b(?!\.gob\.mx)"), F.lit(a)) for a in ACRONYMS]
    return F.coalesce(labelled, F.when(has(text, "servicio") & text.rlike(TAX_SERVICE), F.lit("SAT")), *named, *short)


#: Words that a case's seizure or release is told by.
SEIZING = ("aseguramiento", "embargo", "bloqueo", "retención", "retencion", "inmovilización", "inmovilizacion", "congelamiento")
RELEASING = ("desbloqueo", "liberación", "liberacion", "dejar sin efectos")


def text_fields(text: Column) -> dict[str, Column]:
    """All fields of a case's plain text. A pattern is only tried where a word that it needs is in the text."""
    if_ = lambda words, c: F.when(has(text, *words), c)
    return {
        "case_number": case_number(text),
        "cause": if_(("causa",), F.trim(first(text, CAUSE, 1))),
        "action": if_(("solicitada",), F.trim(first(text, ACTION, 1))),
        "office": F.coalesce(first(text, OFFICE), if_(("identificaci", "oficio"), F.trim(first(text, OFFICE_LABELLED, 1)))),
        "authority": authority(text),
        "unit": if_(("direcci", "departamento", "mesa", "turno", "secretar"), F.trim(first(text, OFFICE_UNIT))),
        "applicant": F.coalesce(if_(("mtro.", "mtra.", "lic.", "ing.", "dr.", "dra.", "c."), F.trim(first(text, HONORIFIC, 1))), F.when(text.contains("\n"), F.trim(first(text, TITLE, 1)))),
        "email": F.when(text.contains("@"), F.lower(first(text, EMAIL_RUN))),
        "phone": F.coalesce(if_(("tel",), F.trim(first(text, PHONE_LABELLED, 1))), first(text, PHONE)),
        "address": if_(("av.", "ave.", "calle", "col.", "colonia", "c.p.", "cp", "ciudad", "del.", "delegaci", "municipio"), F.replace(F.trim(first(text, ADDRESS)), F.lit("\n"), F.lit(" "))),
        "postcode": if_(("p.", "cp", "c.p"), first(text, POSTCODE, 1)),
        "legal_basis": if_(("culo",), F.nullif(F.array_join(F.transform(every(text, ARTICLES, 1), lambda a: F.concat(F.lit("Art. "), F.trim(a))), "; "), F.lit(""))),
        "published": if_(("publica",), first(text, PUBLISHED, 1)),
        "term_days": if_(("día", "dia"), first(text, TERM, 1).cast("int")),
        "seized": F.when(has(text, *SEIZING), True).when(has(text, *RELEASING), False),
    }


def pdf_fields(text: Column) -> dict[str, Column]:
    """Fields of the text of a scanned file."""
    up = F.upper(text)
    return {
        "case_number": first(text, r"[A-Z]/[A-Z]{1,2}[0-9]+-[0-9]+-[0-9]+-[A-Z]+"),
        "area": F.coalesce(*(F.when(up.contains(a), F.lit(a)) for a in AREAS)),
        "authority": F.coalesce(*(F.trim(first(text, p)) for p in PDF_AUTHORITIES)),
        "rfcs": F.array_distinct(every(text, r"[A-ZÑ&]{3,4}[0-9]{6}[A-Z0-9]{3}")),
        "names": F.slice(F.array_distinct(F.transform(every(text, r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"), F.trim)), 1, 10),
        "dates": F.array_distinct(F.array_compact(F.concat(*(_dates_by(text, p, f) for p, f in ((r"[0-9]{2}/[0-9]{2}/[0-9]{4}", "dd/MM/yyyy"), (r"[0-9]{2}-[0-9]{2}-[0-9]{4}", "dd-MM-yyyy"), (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "yyyy-MM-dd")))))),
        "references": F.array_distinct(F.transform(F.concat(every(text, r"(?iu)(?:Referencia|REF|Ref\.?)\s*:?\s*[A-Z0-9/-]+"), every(text, r"(?iu)(?:Artículo|Art\.?)\s+[0-9]+"), every(text, r"(?iu)Ley\s+[A-Z0-9]+")), F.trim)),
        "amounts": F.array_distinct(F.transform(every(text, rf"\$?\s*({NUMBER})", 1), lambda a: F.replace(a, F.lit(","), F.lit("")).try_cast("decimal(18,2)"))),
        "action": F.coalesce(F.trim(first(text, r"(?iu)acci[óo]n(?: solicitada)?\s*:?\s*([^\n]+)", 1)), F.trim(first(text, r"(?iu)solicita\s+([^\n]+?)(?:\n|\.|$)", 1)), F.trim(F.substring(text, 1, 200))),
    }


def _dates_by(text: Column, pattern: str, form: str) -> Column:
    return F.transform(every(text, pattern), lambda d: F.try_to_date(d, form))


def structured_fields(text: Column) -> dict[str, Column]:
    """Fields of a labelled word-processor text."""
    return {
        "case_number": F.upper(first(text, r"(?i)([A-Z]/[A-Z]{1,4}[0-9]+-[0-9]+-[0-9]+-[A-Z]+)", 1)),
        "cause": F.trim(first(text, r"(?i)Causa\s*:?\s*([^\n\r.]{5,100})", 1)),
        "action": F.trim(first(text, r"(?iu)Acci[óo]n\s+Solicitada\s*:?\s*([^\n\r.]{5,100})", 1)),
        "office": first(text, r"([0-9]{1,4}-[0-9]{1,2}-[0-9]{5,10}/[0-9]{4})", 1),
        "clabe": first(text, CLABE_ANY, 1),
        "account": first(text, r"(?iu)(?:Cuenta|Account)\s*(?:No\.?|Número)?:?\s*([0-9]{10,16})", 1),
        "amounts": F.transform(every(text, r"(?i)\$\s*([0-9,]+(?:\.[0-9]{2})?)\s*(?:MXN|USD|EUR|CAD)?", 1), lambda a: F.replace(a, F.lit(","), F.lit("")).try_cast("decimal(18,2)")),
    }


def structured_confidence(text: Column) -> Column:
    """0, 50, 75 or 90 by the standard labels contained."""
    low = F.lower(text)
    n = sum((low.contains(label.lower()).cast("int") for label in STANDARD_LABELS), F.lit(0))
    return F.when(n >= 3, 90).when(n == 2, 75).when(n == 1, 50).otherwise(0)


def table_confidence(text: Column) -> Column:
    """0, 60, 85 or 95 by bars, a row of three and a ruler."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    row, ruler = text.rlike(r"\|.*\|.*\|"), text.rlike(r"[-]+\|[-]+")
    return F.when((bars >= 20) & row & ruler, 95).when((bars >= 10) & row, 85).when(bars >= 4, 60).otherwise(0)


def table_rows(text: Column) -> Column:
    """array(struct(key, value)) of a text's table rows, without rulers and headings."""
    lines = F.filter(F.split(text, r"[\r\n]+"), lambda x: ~x.rlike(r"^\s*\|[\s|-]+\|\s*$") & x.rlike(r"\|\s*[^|]+?\s*\|\s*[^|]+?\s*\|"))
    cell = r"\|\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|"
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, cell, 1).alias("key"), F.regexp_extract(x, cell, 2).alias("value")))
    return F.filter(pairs, lambda p: ~F.lower(p["key"]).isin("campo", "field", "key") & (p["key"] != "") & (p["value"] != ""))


def sections(text: Column, starts: list[str], ends: list[str]) -> Column:
    """struct(whole, body): from the earliest start heading to the nearest end heading after it, accents and case aside; null
    without one. In the body the heading at its beginning and colons after it are left out, and null is what has nothing
    else. Each value is computed once a text."""
    from .normalize import strip_accents

    let = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    first = lambda flat, words: F.array_min(F.filter(F.array(*(F.locate(w, flat) for w in words)), lambda i: i > 0))
    strip = lambda c: F.btrim(c, F.lit(" \t\n\x0b\f\r"))

    def parts(found: Column) -> Column:
        own = F.coalesce(*(F.when(F.startswith(F.upper(F.substr(found, F.lit(1), F.lit(len(s)))), F.lit(s.upper())), F.lit(len(s))) for s in starts), F.lit(0))
        body = let(own, lambda n: F.when(n > 0, strip(F.ltrim(F.substr(found, n + 1), F.lit(":")))).otherwise(found))
        return F.struct(F.when(found != "", found).alias("whole"), let(body, lambda b: F.when(b != "", b)).alias("body"))

    def cut(place: Column) -> Column:
        at, stop = place["at"], place["stop"]
        return let(strip(F.when(stop.isNotNull(), F.substr(text, at, stop)).otherwise(F.substr(text, at))), parts)

    def places(flat: Column) -> Column:
        return let(first(flat, starts), lambda at: F.struct(at.alias("at"), F.when(at.isNotNull(), let(F.substr(flat, at + 1), lambda rest: first(rest, ends))).alias("stop")))

    return let(let(strip_accents(F.upper(text)), places), cut)


def section(text: Column, starts: list[str], ends: list[str], header: bool = True) -> Column:
    """The whole of sections, or without `header` its body."""
    return sections(text, starts, ends)["whole" if header else "body"]


def keyword_amounts(text: Column, keywords: tuple[str, ...] = ("monto", "importe", "cantidad")) -> Column:
    """Distinct amounts after a currency sign or a keyword, thousands marks removed."""
    tail = r"\s*:?\s*([0-9]{1,3}(?:[.,\s][0-9]{3})*|[0-9]+)"
    whole = lambda c: F.transform(c, lambda n: F.regexp_replace(n, r"[.,\s]", "").cast("double"))
    return F.array_distinct(F.concat(whole(every(text, r"\$\s*([0-9]{1,3}(?:[.,\s][0-9]{3})*|[0-9]+)", 1)), whole(every(text, rf"(?i)(?:{'|'.join(keywords)}){tail}", 1))))


#: How case numbers are introduced, words that are none, and words of a formal context.
CASE_NUMBERS = (
    r"(?i)\b(?:expediente|exp\.?|exped\.?)\s*[:#]?\s*([A-Za-z0-9\-/.]+)",
    r"(?i)\b(?:no\.?\s*)?expediente\s+([A-Za-z0-9\-/.]+)",
    r"(?i)\bexp\.?\s+no\.?\s*([A-Za-z0-9\-/.]+)",
    r"(?i)\bexpediente\s+num\.?\s*([A-Za-z0-9\-/.]+)",
)
NO_CASE_NUMBERS = ("de", "del", "la", "el", "en", "por", "para")
FORMAL = ("tribunal", "juzgado", "corte", "judicial", "legal")


def scored_case_numbers(text: Column, least: float = 0.6) -> Column:
    """array(struct(score, value)) of case number candidates of all patterns, best first (of equals the greatest value).

    0.5, with 0.2 for digits and 0.1 each for a year, a slash or hyphen, and a formal word within 50 characters."""
    found = F.concat(*(F.zip_with(every(text, p), every(text, p, 1), lambda whole, v: F.struct(whole.alias("whole"), v.alias("value"))) for p in CASE_NUMBERS))
    ok = F.filter(found, lambda c: F.length(c["value"]).between(3, 50) & c["value"].rlike("[A-Za-z0-9]") & ~F.lower(c["value"]).isin(*NO_CASE_NUMBERS))

    def scored(c: Column) -> Column:
        at = F.position(c["whole"], text)
        begin = F.greatest(at - 50, F.lit(1))
        context = F.lower(F.substr(text, begin, at - begin + F.length(c["whole"]) + 50))
        v = c["value"]
        tenths = 5 + 2 * v.rlike("[0-9]").cast("int") + v.rlike(r"\b[0-9]{4}\b").cast("int") + v.rlike("[/-]").cast("int") + context.rlike("|".join(FORMAL)).cast("int")
        return F.struct(F.least(tenths, F.lit(10)).alias("tenths"), F.upper(v).alias("value"))

    ranked = F.filter(F.transform(ok, scored), lambda r: r["tenths"] >= round(10 * least))
    return F.transform(F.sort_array(ranked, asc=False), lambda r: F.struct((r["tenths"] / 10.0).alias("score"), r["value"].alias("value")))


#: Kinds of requirements, and the words that open each.
REQUIREMENTS = (
    (r"(?im)(?:REQUERIMIENTO|REQUISITO|SOLICITUD)[\s:]+(.+?)(?=\n|REQUERIMIENTO|REQUISITO|SOLICITUD|$)"),
    (r"(?ium)(?:BLOQUEO|BLOQUEAR)[\s:]+(.+?)(?=\n|DESBLOQUEO|TRANSFERENCIA|DOCUMENTACIÓN|INFORMACIÓN|$)"),
    (r"(?ium)(?:DESBLOQUEO|DESBLOQUEAR)[\s:]+(.+?)(?=\n|BLOQUEO|TRANSFERENCIA|DOCUMENTACIÓN|INFORMACIÓN|$)"),
    (r"(?ium)(?:TRANSFERENCIA|TRANSFERIR)[\s:]+(.+?)(?=\n|BLOQUEO|DESBLOQUEO|DOCUMENTACIÓN|INFORMACIÓN|$)"),
    (r"(?ium)(?:DOCUMENTACIÓN|DOCUMENTO)[\s:]+(.+?)(?=\n|BLOQUEO|DESBLOQUEO|TRANSFERENCIA|INFORMACIÓN|$)"),
    (r"(?ium)(?:INFORMACIÓN|INFORMAR)[\s:]+(.+?)(?=\n|BLOQUEO|DESBLOQUEO|TRANSFERENCIA|DOCUMENTACIÓN|$)"),
)


def requirement_type(c: Column) -> Column:
    low = F.lower(c)
    kind = F.when(low.rlike("desbloqueo|desbloquear"), "desbloqueo").when(low.rlike("bloqueo|bloquear"), "bloqueo").when(low.rlike("transferencia|transferir"), "transferencia")
    return kind.when(low.rlike("documentación|documento"), "documentacion").when(low.rlike("información|informar"), "informacion").otherwise("general")


def requirements(text: Column) -> Column:
    """array(struct(kind, description)) of what a text asks for."""
    one = lambda p: F.zip_with(every(text, p), every(text, p, 1), lambda whole, d: F.struct(requirement_type(whole).alias("kind"), F.trim(d).alias("description")))
    return F.filter(F.concat(*(one(p) for p in REQUIREMENTS)), lambda r: r["description"] != "")


def requirement_confidence(found: Column) -> Column:
    n, known = F.size(found), F.size(F.filter(found, lambda r: r["kind"] != "general"))
    return F.when(n == 0, 0).otherwise(F.least(F.floor(100.0 * known / n).cast("int") + F.least(2 * n, F.lit(20)), F.lit(100)))


#: Kinds of authorities by what their lower-cased names contain, in order.
AUTHORITY_TYPES = (
    ("Fiscalía", r"fiscal[ií]a|fiscal general"),
    ("Procuraduría", r"procuradur[ií]a"),
    ("Juzgado", r"juzgado"),
    ("Tribunal", r"tribunal"),
    ("Secretaría", r"secretar[ií]a"),
    ("Dirección", r"direcci[oó]n"),
    ("Administración", r"administraci[oó]n"),
    ("Consejo", r"consejo"),
    ("Comisión", r"comisi[oó]n"),
    ("Delegación", r"delegaci[oó]n"),
    ("Subdelegación", r"subdelegaci[oó]n"),
    ("Agencia", r"agencia"),
    ("Unidad", r"unidad"),
    ("Sala", r"sala\s"),
    ("Pleno", r"pleno\s"),
    ("Centro", r"centro\s"),
    ("Coordinación", r"coordinaci[oó]n"),
    ("Subadministración", r"subadministraci[oó]n"),
    ("Instituto", r"instituto"),
    ("Órgano", r"[oó]rgano"),
)


def authority_type(c: Column) -> Column:
    """By the first pattern in a name; names that contain a longer kind's stem count as the earlier kind."""
    return F.coalesce(*(F.when(F.lower(c).rlike(p), F.lit(name)) for name, p in AUTHORITY_TYPES), F.lit("Otro"))


def tidy_authority(c: Column) -> Column:
    """White space collapsed, commas and full stops at the end removed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+", " "), r"\s*[,.]+$", "")


def jurisdiction(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.contains("federal"), "Federal").when(low.contains("ciudad de méxico") | low.contains("cdmx"), "Ciudad de México")


def quality_grade(confidence: Column) -> Column:
    """struct(grade, review): HIGH from 0.8 on, which needs no review, MEDIUM from 0.5 on, else LOW."""
    grade = F.when(confidence >= 0.8, "HIGH").when(confidence >= 0.5, "MEDIUM").otherwise("LOW")
    return F.struct(grade.alias("grade"), (grade != "HIGH").alias("review"))


#: What a measure is called in the result.
MEASURES = {"Block": "Aseguramiento", "Unblock": "Desbloqueo", "Document": "Documentacion", "Transfer": "Transferencia", "Information": "Informacion", "Ignore": "Ignorar", "Other": "Otro"}


def measure_hint(flag: Column, text: Column) -> Column:
    """What an XML case asks for: its flag, its words, then by the stems. Without any text it asks for information."""
    up, by_stem = F.upper(text), action_kind(text)
    kind = F.when(flag, "Block").when(up.rlike("DEJAR SIN EFECTOS|ELIMINA|REANUD"), "Unblock").when(up.rlike("COPIA CERTIFICADA|DOCUMENT"), "Document").when(up.contains("TRANSFER"), "Transfer")
    kind = kind.when(by_stem == "Unknown", "Information").otherwise(by_stem)
    return F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in MEASURES.items()))


def subdivision_hint(c: Column) -> Column:
    """The area's words in title case, run together, without the accents of small letters."""
    return F.translate(F.replace(F.initcap(F.lower(c)), F.lit(" "), F.lit("")), "íáéóú", "iaeou")
