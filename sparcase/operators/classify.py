"""Classifying notices: categories, directives, requirement types, legal checks and gates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import strip_accents, warnings
from ..functions.validate import blank

#: Keywords of each category at 90 and at 70 points; all else scores 10.
CATEGORIES = {
    "Aseguramiento": (("ASEGURAMIENTO", "EMBARGO"), ("ASEGURAR",)),
    "Desembargo": (("DESEMBARGO", "LIBERAR"), ("DESEMBARGAR",)),
    "Documentacion": (("DOCUMENTACION", "DOCUMENTO", "SOLICITUD DOCUMENTAL"), ("DOCUMENTAR",)),
    "Informacion": (("INFORMACION", "INFORMAR", "REPORTE"), ("INFORMATIVO",)),
    "Transferencia": (("TRANSFERENCIA", "TRANSFERIR"), ("TRANSFER",)),
    "OperacionesIlicitas": (("OPERACIONES ILICITAS", "PROCEDENCIA ILICITA", "OPERACIONES INUSUALES", "OPERACIONES SOSPECHOSAS", "OPERACIONES IRREGULARES", "INTELIGENCIA FINANCIERA", "LFPIORPI", "LAVADO", "FINANCIAMIENTO TERRORISMO"), ("ILICIT",)),
}
FLOOR = 10
#: Keywords of each directive, in order of detection.
DIRECTIVES = {
    "Block": ("BLOQUEO", "EMBARGO", "ASEGURAR", "CONGELAR", "RETENER", "INMOVILIZAR"),
    "Unblock": ("DESBLOQUEO", "DESEMBARGO", "LIBERAR", "DESCONGELAR", "DESRETENER"),
    "Document": ("DOCUMENTACIÓN", "DOCUMENTOS", "EXPEDIR", "ENTREGAR DOCUMENTOS"),
    "Transfer": ("TRANSFERENCIA", "TRANSFERIR", "MOVIMIENTO", "GIRO"),
    "Information": ("INFORMACIÓN", "INFORMAR", "REPORTAR", "COMUNICAR"),
}
PRECEDENCE = ("Unblock", "Block", "Transfer", "Document", "Information")
RELATIONS = (
    ("Recordatorio", ("RECORDATORIO DEL OFICIO", "RECORDATORIO DE OFICIO", "RECORDATORIO AL OFICIO")),
    ("Alcance", ("ALCANCE AL OFICIO", "ALCANCE DE OFICIO", "ALCANCE DEL OFICIO", "AMPLÍA", "AMPLIA", "AMPLIACIÓN")),
    ("Precision", ("PRECISIÓN", "PRECISION", "ACLARA", "ACLARACIÓN", "ACLARACION", "CORRIGE", "CORRECCIÓN", "CORRECCION")),
)
#: Fields that Article 4 asks for, by requirement type; areas within the jurisdiction.
ARTICLE_4 = {
    100: ("InternalCaseId", "SourceAuthorityCode", "RequirementType"),
    101: ("InternalCaseId", "SourceAuthorityCode", "RequirementType", "AccountNumber", "BranchCode", "ProductType", "InitialBlockedAmount"),
    102: ("InternalCaseId", "SourceAuthorityCode"),
    103: ("InternalCaseId", "AccountNumber", "SourceAuthorityCode", "OperationAmount"),
    104: ("InternalCaseId", "AccountNumber", "SourceAuthorityCode", "OperationAmount"),
}
JURISDICTION = ("ASEGURAMIENTO", "HACENDARIO", "PENAL", "CIVIL", "ADMINISTRATIVO", "JUDICIAL")
#: Subdivisions by area code.
SUBDIVISIONS = {1: "A_AS", 2: "A_DE", 3: "A_TF", 4: "A_IN", 5: "J_AS", 6: "J_DE", 7: "J_IN", 8: "H_IN", 9: "E_AS", 10: "E_DE", 11: "E_IN"}


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def hits(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, (text.contains(w).cast("int") for w in words))


def category_scores(area: Column, number: Column, text: Column) -> dict[str, Column]:
    """90, 70 or 10 points for each category, by words of the whole case."""
    whole = strip_accents(F.upper(F.concat_ws(" ", area, number, text)))
    out = {}
    for name, (strong, weak) in CATEGORIES.items():
        strongly = any_of(whole, strong)
        if name == "Aseguramiento":
            strongly = strongly | F.upper(F.coalesce(number, F.lit(""))).contains("/AS")
        out[name] = F.when(strongly, 90).when(any_of(whole, weak), 70).otherwise(FLOOR)
    return out


def level1(values: Column, top: Column) -> Column:
    """The category of the single highest of the scores, in the order of CATEGORIES; Unknown for a tie or none."""
    alone = F.size(F.array_remove(values, top)) == len(CATEGORIES) - 1
    return F.when((top > FLOOR) & alone, F.element_at(F.array(*(F.lit(n) for n in CATEGORIES)), F.array_position(values, top).cast("int"))).otherwise("Unknown")


def level1_confidence(values: Column, top: Column) -> Column:
    """0 without any score; else by the lead of the highest one, the mean at most 70 where it is small or shared."""
    mean = F.floor(F.aggregate(values, F.lit(0), lambda a, s: a + s) / len(CATEGORIES)).cast("int")
    others = F.array_remove(values, top)
    lead = top - F.coalesce(F.array_max(others), F.lit(0))
    shared = F.size(others) < len(CATEGORIES) - 1
    return F.when(top == FLOOR, 0).when(shared, F.least(mean, F.lit(70))).when(lead >= 60, F.least(top, F.lit(100))).when(lead >= 40, F.least(top, F.lit(85))).otherwise(F.least(mean, F.lit(70)))


def level2(area: Column, number: Column, text: Column) -> Column:
    whole = strip_accents(F.upper(F.concat_ws(" ", area, number, text)))
    special = whole.contains("ESPECIAL") | F.upper(F.coalesce(number, F.lit(""))).contains("/AS")
    return F.when(special, "Especial").when(any_of(whole, ("JUDICIAL", "JUEZ", "TRIBUNAL")), "Judicial").when(any_of(whole, ("HACENDARIO", "SAT", "SHCP")), "Hacendario")


def classify_cases(rows: DataFrame, seized: str, area: str, number: str, text: str) -> DataFrame:
    """rows with level1, level2 and confidence. A case marked as a seizure is one, with 90.

    The scores are a column of their own before they are compared, so that each keyword is looked for once."""
    scores = F.array(*category_scores(F.col(area), F.col(number), F.col(text)).values())
    scored = rows.withColumn("_scores", scores).withColumn("_top", F.array_max("_scores"))
    values, top = F.col("_scores"), F.col("_top")
    out = {"level1": F.when(F.col(seized), "Aseguramiento").otherwise(level1(values, top)), "level2": level2(F.col(area), F.col(number), F.col(text)), "confidence": F.when(F.col(seized), 90).otherwise(level1_confidence(values, top))}
    return scored.withColumns(out).drop("_scores", "_top")


def requirement(area: Column, number: Column, references: Column, seized: Column) -> Column:
    """struct(type, confidence): 102 release, 101 seizure, 103 transfer, 104 funds, 100 information."""
    a, n, r = F.upper(F.coalesce(area, F.lit(""))), F.upper(F.coalesce(number, F.lit(""))), F.upper(F.coalesce(references, F.lit("")))
    taken = F.coalesce(seized, F.lit(False)) | a.contains("ASEGURAMIENTO") | n.contains("/AS")
    of = lambda t, c: F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence"))
    return (
        F.when(any_of(r, ("DESBLOQUEO", "LIBERAR", "LEVANTAR")), of(102, 0.95))
        .when(taken & any_of(r, ("TRANSFERIR", "CLABE")), of(103, 0.90))
        .when(taken & any_of(r, ("CHEQUE", "SITUAR")), of(104, 0.90))
        .when(taken, of(101, 0.90))
        .when(any_of(r, ("TRANSFERIR", "CLABE", "ELECTRÓNICA")), of(103, 0.85))
        .when(any_of(r, ("CHEQUE", "SITUAR", "FONDOS")), of(104, 0.85))
        .otherwise(of(100, 0.80))
    )


def authority_kind(name: Column) -> Column:
    up = F.upper(name)
    kind = F.when(any_of(up, ("JUZGADO", "TRIBUNAL", "MAGISTRADO")), "Juzgado").when(any_of(up, ("SAT", "FGR", "FISCAL", "ADMINISTRACION", "HACIENDA")), "Hacienda")
    return kind.when(up.contains("UIF"), "UIF").when(up.contains("CNBV"), "CNBV").otherwise("Other")


def missing_fields(kind: Column, fields: dict[str, Column]) -> Column:
    """Fields that Article 4 asks for and that are blank."""
    needed = F.array().cast("array<string>")
    for k, names in ARTICLE_4.items():
        needed = F.when(kind == k, F.array(*(F.lit(n) for n in names))).otherwise(needed)
    there = F.array_compact(F.array(*(F.when(~blank(c), F.lit(n)) for n, c in fields.items())))
    return F.array_except(needed, there)


def rejections(basis: Column, signature: Column, account: Column, identified: Column, area: Column, case_id: Column) -> Column:
    """Grounds of Article 17."""
    return warnings(
        (blank(basis), "NoLegalAuthorityCitation"),
        (blank(signature), "MissingSignature"),
        (account.isNull() & ~F.coalesce(identified, F.lit(False)), "LackOfSpecificity"),
        (~F.upper(F.coalesce(area, F.lit(""))).isin(*JURISDICTION), "ExceedsJurisdiction"),
        (case_id.isNull(), "MissingRequiredData"),
    )


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value being computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def counted_directives(text: Column, kinds: tuple[str, ...] = tuple(DIRECTIVES)) -> Column:
    """array(struct(kind, confidence)) of the kinds with a keyword in the text, in the given order."""
    known = F.array(*(F.struct(F.lit(k).alias("kind"), F.array(*map(F.lit, DIRECTIVES[k])).alias("words")) for k in kinds))

    def scored(up: Column) -> Column:
        found = F.transform(known, lambda d: F.struct(d["kind"].alias("kind"), F.size(F.filter(d["words"], lambda w: up.contains(w))).alias("n")))
        return F.transform(F.filter(found, lambda d: d["n"] > 0), lambda d: F.struct(d["kind"].alias("kind"), F.least(60 + 10 * d["n"], F.lit(100)).alias("confidence")))

    return let(F.upper(F.coalesce(text, F.lit(""))), scored)


def directives(text: Column) -> Column:
    """array(struct(kind, confidence)): every directive with a keyword in the text; Ignore with 50 if there is none."""
    none = F.array(F.struct(F.lit("Ignore").alias("kind"), F.lit(50).alias("confidence")))
    return let(counted_directives(text), lambda found: F.when(F.size(found) > 0, found).otherwise(none))


def directive(text: Column) -> Column:
    """struct(kind, confidence): the directive that takes precedence; Unknown with 30."""
    return F.coalesce(F.get(counted_directives(text, PRECEDENCE), F.lit(0)), F.struct(F.lit("Unknown").alias("kind"), F.lit(30).alias("confidence")))


def relation(text: Column) -> Column:
    known = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, words)).alias("words")) for name, words in RELATIONS))
    found = let(F.upper(F.coalesce(text, F.lit(""))), lambda up: F.filter(known, lambda r: F.exists(r["words"], lambda w: up.contains(w))))
    return F.coalesce(F.get(found, F.lit(0))["name"], F.lit("New"))


def edge_warnings(text: Column, kind: Column, confidence: Column, account: Column, amount: Column) -> Column:
    """What a single directive lacks."""
    prior = lambda up: any_of(up, ("OFICIO", "EXPEDIENTE", "ORDEN", "ANTERIOR"))
    return warnings(
        ((kind == "Transfer") & ~text.rlike(r"\b[0-9]{18}\b"), "MissingClabe"),
        ((kind == "Unblock") & ~let(F.upper(text), prior), "MissingPriorOrder"),
        ((kind == "Block") & blank(account) & amount.isNull(), "MissingAccountOrAmount"),
        (confidence < 70, "LowConfidence"),
    )


def subdivision(code: Column, area: Column) -> Column:
    """By area code, else by the area's words."""
    a = F.upper(F.coalesce(area, F.lit("")))
    court, illicit, tax = a.contains("JUD") | a.contains("J/"), a.contains("ILICIT") | a.contains("E/"), a.contains("HAC") | a.contains("H/")
    words = (
        F.when(a.contains("ASEGURAMIENTO"), F.when(court, "J_AS").when(illicit, "E_AS").otherwise("A_AS"))
        .when(a.contains("DESEMBARGO"), F.when(court, "J_DE").when(illicit, "E_DE").otherwise("A_DE"))
        .when(a.contains("TRANSFER"), "A_TF")
        .when(a.contains("INFORM") | a.contains("DOCUMENT"), F.when(court, "J_IN").when(tax, "H_IN").when(illicit, "E_IN").otherwise("A_IN"))
        .otherwise("Unknown")
    )
    known = F.create_map(*(F.lit(x) for pair in SUBDIVISIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, code), words)


def subject(action: Column, seized: Column, area: Column) -> Column:
    """What a case is about, for the upload layout."""
    names = F.create_map(*(F.lit(x) for pair in (("Block", "ASEGURAMIENTO"), ("Unblock", "DESEMBARGO"), ("Transfer", "TRANSFERENCIA"), ("Document", "DOCUMENTACIÓN"), ("Information", "INFORMACIÓN")) for x in pair))
    return F.coalesce(F.try_element_at(names, action), F.when(seized, F.lit("ASEGURAMIENTO")), F.nullif(F.upper(F.trim(area)), F.lit("")), F.lit("INFORMACIÓN"))


def weighted_confidence(parts: list[tuple[Column, float]]) -> Column:
    """The weighted mean of the confidences that are there; null if none is."""
    total = reduce(lambda a, b: a + b, (F.when(c.isNotNull(), c * w).otherwise(0.0) for c, w in parts))
    weight = reduce(lambda a, b: a + b, (F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts))
    return F.when(weight > 0, F.round(total / weight, 9))  # rounding errors must not decide at a threshold


def export_gate(ocr: Column, classified: Column, fused: Column, manual: Column, conflicts: Column, reviewed: Column) -> Column:
    """struct(open, reasons): why a case isn't exported; a reviewer's approval opens the gate."""
    overall = weighted_confidence([(fused, 0.50), (classified, 0.30), (ocr, 0.20)])
    reasons = warnings((classified < 0.70, "classification"), (overall < 0.65, "overall"), (manual, "manual_review"), (conflicts > 0, "conflicts"))
    return F.struct((F.coalesce(reviewed, F.lit(False)) | (F.size(reasons) == 0)).alias("open"), reasons.alias("reasons"))


def review_cases(rows: DataFrame, open_cases: DataFrame) -> DataFrame:
    """case_id and reason of new review cases. Incomplete and FieldMismatch come each once; LowConfidence, Ambiguous and
    ExtractionError only for cases that have no open one."""
    free = rows.join(open_cases.select("case_id").distinct(), "case_id", "left_anti").select(F.col("case_id").alias("_free"))
    marked = rows.join(free, F.col("case_id") == F.col("_free"), "left")
    none = F.col("_free").isNotNull()
    reasons = warnings((~F.col("complete"), "Incomplete"), (F.col("conflicts") > 0, "FieldMismatch"), (none & (F.col("confidence") < 0.80), "LowConfidence"), (none & (F.col("level2").isNull() | (F.col("conflicts") > 0)), "Ambiguous"), (none & F.col("failed"), "ExtractionError"))
    new = marked.select("case_id", F.explode(reasons).alias("reason"))
    return new.join(open_cases.select("case_id", "reason").distinct(), ["case_id", "reason"], "left_anti")


def decide(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Statuses after reviewers' decisions: the first valid one of a case counts. An override needs notes."""
    first = decisions.where(~F.col("override") | ~blank(F.col("notes"))).groupBy("case_id").agg(F.min_by("decision", F.struct("decided_at", "decision")).alias("decision"))
    status = F.when(F.col("decision") == "Approve", "Completed").when(F.col("decision") == "Reject", "Rejected").when(F.col("decision") == "MoreInfo", "Pending").otherwise(F.col("status"))
    return cases.join(first, "case_id", "left").withColumn("status", status)


def passes_quality(level: Column) -> Column:
    """Levels from 2 on; a poor or unknown one stops the case."""
    return level >= 2
