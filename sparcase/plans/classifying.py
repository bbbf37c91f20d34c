"""Classification, legal checks, gates and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as X
from ..operators import classify as C
from ..operators import semantic
from . import inputs as I
from .registry import query, table
from .text import _PLAIN

_IN = f"""WITH {I.NOTICES}, n AS (SELECT case_id, text, ['ASEGURAMIENTO', 'HACENDARIO', 'CIVIL', 'OTRA', 'INFORME J/', 'DESEMBARGO E/'][case_id % 6 + 1] AS area, (['A/AS1-', 'H/IN'])[case_id % 2 + 1] || case_id AS number, case_id % 10 = 0 AS seized FROM notices)"""
_WHOLE = _PLAIN.format("upper(area || ' ' || number || ' ' || text)")


def _n(spark, d):
    k = F.col("case_id")
    return I.notices(spark, d).select("case_id", "text", I._pick(("ASEGURAMIENTO", "HACENDARIO", "CIVIL", "OTRA", "INFORME J/", "DESEMBARGO E/"), k % 6).alias("area"), F.concat(I._pick(("A/AS1-", "H/IN"), k % 2), k.cast("string")).alias("number"), (k % 10 == 0).alias("seized"))


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _score(name: str) -> str:
    strong, weak = C.CATEGORIES[name]
    extra = " OR contains(upper(number), '/AS')" if name == "Aseguramiento" else ""
    return f"CASE WHEN {_any('w', strong)}{extra} THEN 90 WHEN {_any('w', weak)} THEN 70 ELSE 10 END"


_S = f"{_IN}, w AS (SELECT *, {_WHOLE} AS w FROM n), s AS (SELECT *, [{', '.join(_score(n) for n in C.CATEGORIES)}] AS ss FROM w), m AS (SELECT *, list_max(ss) AS top, len(list_filter(ss, lambda x: x = list_max(ss))) AS k, coalesce(list_max(list_filter(ss, lambda x: x <> list_max(ss))), 0) AS second, floor(list_sum(ss) / 6.0)::int AS mean FROM s)"
_L1 = f"CASE WHEN seized THEN 'Aseguramiento' WHEN top > 10 AND k = 1 THEN {I._sql_list(tuple(C.CATEGORIES))}[list_position(ss, top)] ELSE 'Unknown' END"
_C1 = "CASE WHEN seized THEN 90 WHEN top = 10 THEN 0 WHEN k > 1 THEN least(mean, 70) WHEN top - second >= 60 THEN least(top, 100) WHEN top - second >= 40 THEN least(top, 85) ELSE least(mean, 70) END"
_L2 = f"CASE WHEN contains(w, 'ESPECIAL') OR contains(upper(number), '/AS') THEN 'Especial' WHEN {_any('w', ('JUDICIAL', 'JUEZ', 'TRIBUNAL'))} THEN 'Judicial' WHEN {_any('w', ('HACENDARIO', 'SAT', 'SHCP'))} THEN 'Hacendario' END"


@query(f"{_S} SELECT case_id, {', '.join(f'ss[{i + 1}]::int AS {n}' for i, n in enumerate(C.CATEGORIES))} FROM m")
def cla01_scores(spark, d):
    s = C.category_scores(F.col("area"), F.col("number"), F.col("text"))
    return _n(spark, d).select("case_id", *(c.alias(n) for n, c in s.items()))


@query(f"{_S} SELECT case_id, {_L1} AS level1, {_C1}::int AS confidence, {_L2} AS level2 FROM m")
def cla02_05_levels(spark, d):
    return C.classify_cases(_n(spark, d), "seized", "area", "number", "text").select("case_id", "level1", "confidence", "level2")


_TAKEN = "(seized OR contains(area, 'ASEGURAMIENTO') OR contains(upper(number), '/AS'))"
_REQ = f"""CASE WHEN {_any('r', ('DESBLOQUEO', 'LIBERAR', 'LEVANTAR'))} THEN 102 WHEN {_TAKEN} AND {_any('r', ('TRANSFERIR', 'CLABE'))} THEN 103 WHEN {_TAKEN} AND {_any('r', ('CHEQUE', 'SITUAR'))} THEN 104 WHEN {_TAKEN} THEN 101
  WHEN {_any('r', ('TRANSFERIR', 'CLABE', 'ELECTRÓNICA'))} THEN 103 WHEN {_any('r', ('CHEQUE', 'SITUAR', 'FONDOS'))} THEN 104 ELSE 100 END"""


@query(f"{_IN}, x AS (SELECT *, upper(text) AS r FROM n), y AS (SELECT *, {_REQ} AS type FROM x) SELECT case_id, type, (CASE WHEN type = 102 THEN 0.95 WHEN type = 100 THEN 0.80 WHEN {_TAKEN} THEN 0.90 ELSE 0.85 END)::double AS confidence FROM y")
def cla06_requirement(spark, d):
    r = C.requirement(F.col("area"), F.col("number"), F.col("text"), F.col("seized"))
    return _n(spark, d).select("case_id", r["type"].alias("type"), r["confidence"].cast("double").alias("confidence"))


@query(f"{_IN} SELECT case_id, CASE WHEN {_any('upper(text)', ('JUZGADO', 'TRIBUNAL', 'MAGISTRADO'))} THEN 'Juzgado' WHEN {_any('upper(text)', ('SAT', 'FGR', 'FISCAL', 'ADMINISTRACION', 'HACIENDA'))} THEN 'Hacienda' WHEN contains(upper(text), 'UIF') THEN 'UIF' WHEN contains(upper(text), 'CNBV') THEN 'CNBV' ELSE 'Other' END AS kind FROM n")
def cla07_authority(spark, d):
    return _n(spark, d).select("case_id", C.authority_kind(F.col("text")).alias("kind"))


_A4 = "CASE type " + " ".join(f"WHEN {k} THEN {I._sql_list(v)}" for k, v in C.ARTICLE_4.items()) + " ELSE []::varchar[] END"


@query(
    f"""{_IN}, t AS (SELECT case_id, (100 + case_id % 6)::int AS type, list_filter([CASE WHEN case_id % 7 <> 0 THEN 'InternalCaseId' END, 'SourceAuthorityCode', CASE WHEN case_id % 3 = 0 THEN 'AccountNumber' END, CASE WHEN case_id % 5 <> 0 THEN 'OperationAmount' END], lambda x: x IS NOT NULL) AS there FROM n)
    SELECT case_id, array_to_string(list_filter({_A4}, lambda x: NOT list_contains(there, x)), ',') AS missing FROM t"""
)
def cla08_article4(spark, d):
    k = F.col("case_id")
    fields = {"InternalCaseId": F.when(k % 7 != 0, "x"), "SourceAuthorityCode": F.lit("x"), "AccountNumber": F.when(k % 3 == 0, "1").otherwise(" "), "OperationAmount": F.when(k % 5 != 0, "1")}
    return _n(spark, d).select("case_id", F.array_join(C.missing_fields((100 + k % 6).cast("int"), fields), ",").alias("missing"))


@query(
    f"""{_IN} SELECT case_id, concat_ws(',', CASE WHEN case_id % 4 = 0 THEN 'NoLegalAuthorityCitation' END, CASE WHEN case_id % 9 = 0 THEN 'MissingSignature' END, CASE WHEN case_id % 5 = 0 AND case_id % 2 = 0 THEN 'LackOfSpecificity' END,
      CASE WHEN area NOT IN ('ASEGURAMIENTO', 'HACENDARIO', 'PENAL', 'CIVIL', 'ADMINISTRATIVO', 'JUDICIAL') THEN 'ExceedsJurisdiction' END, CASE WHEN case_id % 13 = 0 THEN 'MissingRequiredData' END) AS reasons FROM n"""
)
def cla09_article17(spark, d):
    k = F.col("case_id")
    r = C.rejections(F.when(k % 4 != 0, "Art. 1"), F.when(k % 9 == 0, " ").otherwise("x"), F.when(k % 5 != 0, "1"), k % 2 != 0, F.lower("area"), F.when(k % 13 != 0, "x"))
    return _n(spark, d).select("case_id", F.array_join(r, ",").alias("reasons"))


def _hits(kind: str) -> str:
    return " + ".join(f"contains(u, '{w}')::int" for w in C.DIRECTIVES[kind])


_D = f"{_IN}, u AS (SELECT *, upper(text) AS u FROM n), h AS (SELECT *, {', '.join(f'{_hits(k)} AS {k.lower()}' for k in C.DIRECTIVES)} FROM u)"


@query(
    f"""{_D}, e AS ({' UNION ALL '.join(f"SELECT case_id, '{k}' AS kind, least(60 + 10 * {k.lower()}, 100)::int AS confidence FROM h WHERE {k.lower()} > 0" for k in C.DIRECTIVES)})
    SELECT * FROM e UNION ALL SELECT case_id, 'Ignore', 50 FROM h WHERE case_id NOT IN (SELECT case_id FROM e)"""
)
def cla10_directives(spark, d):
    return _n(spark, d).select("case_id", F.explode(C.directives(F.col("text"))).alias("x")).select("case_id", "x.kind", "x.confidence")


_ONE = "CASE " + " ".join(f"WHEN {k.lower()} > 0 THEN '{k}'" for k in C.PRECEDENCE) + " ELSE 'Unknown' END"
_ONEC = "CASE " + " ".join(f"WHEN {k.lower()} > 0 THEN least(60 + 10 * {k.lower()}, 100)" for k in C.PRECEDENCE) + " ELSE 30 END"


@query(
    f"""{_D}, o AS (SELECT *, {_ONE} AS kind, ({_ONEC})::int AS confidence FROM h)
    SELECT case_id, kind, confidence, concat_ws(',', CASE WHEN kind = 'Transfer' AND NOT regexp_matches(u, '\\b[0-9]{{18}}\\b') THEN 'MissingClabe' END, CASE WHEN kind = 'Unblock' AND NOT {_any('u', ('OFICIO', 'EXPEDIENTE', 'ORDEN', 'ANTERIOR'))} THEN 'MissingPriorOrder' END,
      CASE WHEN kind = 'Block' AND NOT regexp_matches(text, '(?i)cuenta\\s+[0-9]{{4,}}') AND NOT contains(text, '$') THEN 'MissingAccountOrAmount' END, CASE WHEN confidence < 70 THEN 'LowConfidence' END) AS warnings FROM o"""
)
def cla11_13_action(spark, d):
    one = C.directive(F.col("text"))
    amount = F.when(F.col("text").contains("$"), 1)
    rows = _n(spark, d).withColumn("o", one)
    return rows.select("case_id", "o.kind", "o.confidence", F.array_join(C.edge_warnings(F.col("text"), F.col("o.kind"), F.col("o.confidence"), X.first(F.col("text"), X.ACCOUNT_NAMED, 1), amount), ",").alias("warnings"))


@query(f"{_D} SELECT case_id, CASE {' '.join(f'WHEN {_any(chr(117), w)} THEN {chr(39)}{n}{chr(39)}' for n, w in C.RELATIONS)} ELSE 'New' END AS relation FROM h")
def cla12_relation(spark, d):
    return _n(spark, d).select("case_id", C.relation(F.col("text")).alias("relation"))


@query()
def cla14_15_semantic(spark, d):
    """Directives by phrases that may be a little misspelt, as actions. The tests pin known matches."""
    rows = _n(spark, d).select("case_id", semantic.semantic_directives(F.col("text")).alias("found"))
    acts = rows.select("case_id", F.explode(semantic.as_actions(F.col("found"))).alias("x"))
    return acts.select("case_id", "x.kind", "x.confidence")


@query(
    f"""{_IN} SELECT case_id, CASE (case_id % 14)::int {' '.join(f"WHEN {k} THEN '{v}'" for k, v in C.SUBDIVISIONS.items())} ELSE CASE WHEN area = 'ASEGURAMIENTO' THEN 'A_AS' WHEN area = 'DESEMBARGO E/' THEN 'E_DE' WHEN area = 'INFORME J/' THEN 'J_IN' ELSE 'Unknown' END END AS subdivision,
      CASE case_id % 4 WHEN 0 THEN 'ASEGURAMIENTO' WHEN 1 THEN 'DESEMBARGO' ELSE CASE WHEN seized THEN 'ASEGURAMIENTO' ELSE area END END AS subject FROM n"""
)
def cla16_17_subdivision(spark, d):
    k = F.col("case_id")
    return _n(spark, d).select("case_id", C.subdivision((k % 14).cast("int"), F.col("area")).alias("subdivision"), C.subject(I._pick(("Block", "Unblock", "Other", "Ignore"), k % 4), F.col("seized"), F.col("area")).alias("subject"))


@query(
    """WITH g AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 0.5::double + (o_orderkey % 50)::double / 100 END AS ocr, 0.6::double + (o_custkey % 40)::double / 100 AS cls, 0.4::double + (o_orderkey % 60)::double / 100 AS fus, (o_orderkey % 3)::int AS conflicts, o_orderkey % 8 = 0 AS manual, o_orderkey % 20 = 0 AS reviewed FROM orders),
      w AS (SELECT *, (fus * 0.5 + cls * 0.3 + coalesce(ocr * 0.2, 0)) / (0.8 + CASE WHEN ocr IS NULL THEN 0 ELSE 0.2 END) AS overall FROM g),
      r AS (SELECT *, concat_ws(',', CASE WHEN round(cls, 9) < 0.7 THEN 'classification' END, CASE WHEN round(overall, 9) < 0.65 THEN 'overall' END, CASE WHEN manual THEN 'manual_review' END, CASE WHEN conflicts > 0 THEN 'conflicts' END) AS reasons FROM w)
    SELECT case_id, round(overall, 6)::double AS overall, round(least(cls, fus), 6)::double AS lowest, reasons, reviewed OR reasons = '' AS open FROM r"""
)
def cla18_19_gate(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ocr, cls, fus = F.when(k % 5 != 0, 0.5 + k % 50 / 100.0), 0.6 + c % 40 / 100.0, 0.4 + k % 60 / 100.0
    g = C.export_gate(F.round(ocr, 9), F.round(cls, 9), F.round(fus, 9), k % 8 == 0, k % 3, k % 20 == 0)
    overall = C.weighted_confidence([(fus, 0.5), (cls, 0.3), (ocr, 0.2)])
    return table(spark, d, "orders").select(k.alias("case_id"), F.round(overall, 6).alias("overall"), F.round(F.least(cls, fus), 6).alias("lowest"), F.array_join(g["reasons"], ",").alias("reasons"), g["open"].alias("open"))


@query(
    """WITH c AS (SELECT o_orderkey AS case_id, o_orderkey % 6 <> 0 AS complete, (o_orderkey % 3)::int AS conflicts, (o_orderkey % 100)::double / 100 AS confidence, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Judicial' END AS level2, o_orderkey % 25 = 0 AS failed FROM orders),
      op AS (SELECT o_orderkey AS case_id, 'FieldMismatch' AS reason FROM orders WHERE o_orderkey % 10 = 0),
      n AS (SELECT *, case_id NOT IN (SELECT case_id FROM op) AS free FROM c),
      r AS (SELECT case_id, unnest(list_filter([CASE WHEN NOT complete THEN 'Incomplete' END, CASE WHEN conflicts > 0 THEN 'FieldMismatch' END, CASE WHEN free AND confidence < 0.8 THEN 'LowConfidence' END, CASE WHEN free AND (level2 IS NULL OR conflicts > 0) THEN 'Ambiguous' END, CASE WHEN free AND failed THEN 'ExtractionError' END], lambda x: x IS NOT NULL)) AS reason FROM n)
    SELECT * FROM r WHERE (case_id, reason) NOT IN (SELECT case_id, reason FROM op)"""
)
def cla20_jon03_review_cases(spark, d):
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders")
    rows = orders.select(k.alias("case_id"), (k % 6 != 0).alias("complete"), (k % 3).alias("conflicts"), (k % 100 / 100.0).alias("confidence"), F.when(k % 4 != 0, "Judicial").alias("level2"), (k % 25 == 0).alias("failed"))
    return C.review_cases(rows, orders.where(k % 10 == 0).select(k.alias("case_id"), F.lit("FieldMismatch").alias("reason")))


@query("SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 6 <> 0 THEN ['Completed', 'Rejected', 'Pending'][(o_orderkey // 2) % 3 + 1] ELSE 'Open' END AS status FROM orders")
def cla21_jon04_decisions(spark, d):
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders")
    cases = orders.select(k.alias("case_id"), F.lit("Open").alias("status"))
    made = orders.where(k % 2 == 0).select(k.alias("case_id"), I._pick(("Approve", "Reject", "MoreInfo"), F.floor(k / 2) % 3).alias("decision"), (k % 6 == 0).alias("override"), F.lit(" ").alias("notes"), F.lit(1).alias("decided_at"))
    return C.decide(cases, made.unionByName(made.withColumn("decided_at", F.lit(2)).withColumn("decision", F.lit("Approve")))).select("case_id", "status")


@query(f"WITH {I.OBSERVATIONS} SELECT case_id, source, unnest(['AreaDescripcion', 'Folio']) AS field, unnest([AreaDescripcion, Folio]) AS value FROM observations")
def cla22_annotations(spark, d):
    """Fields of each observation, one a row."""
    m = F.create_map(F.lit("AreaDescripcion"), F.col("AreaDescripcion"), F.lit("Folio"), F.col("Folio"))
    return I.observations(spark, d).select("case_id", "source", F.explode(m).alias("field", "value"))


@query(
    f"""{_D}, o AS (SELECT *, upper(text) AS r, {_ONE} AS kind, ({_ONEC})::int AS confidence, CASE {' '.join(f'WHEN {_any(chr(117), w)} THEN {chr(39)}{n}{chr(39)}' for n, w in C.RELATIONS)} ELSE 'New' END AS relation FROM h)
    SELECT case_id, kind, confidence, {_REQ} AS type, relation, (kind = 'Transfer' AND NOT regexp_matches(u, '\\b[0-9]{{18}}\\b'))::int + (kind = 'Unblock' AND NOT {_any('u', ('OFICIO', 'EXPEDIENTE', 'ORDEN', 'ANTERIOR'))})::int
      + (kind = 'Block' AND NOT regexp_matches(text, '(?i)cuenta\\s+[0-9]{{4,}}') AND NOT contains(text, '$'))::int + (confidence < 70)::int AS n_warnings FROM o"""
)
def cla23_decision_chain(spark, d):
    """Notices to directives, actions, warnings and requirement types, in one pass."""
    t = F.col("text")
    rows = _n(spark, d).withColumn("o", C.directive(t)).withColumn("r", C.requirement(F.col("area"), F.col("number"), t, F.col("seized"))).withColumn("amount", X.amount(t)["value"])
    return rows.select("case_id", "o.kind", "o.confidence", F.col("r.type").alias("type"), C.relation(t).alias("relation"), F.size(C.edge_warnings(t, F.col("o.kind"), F.col("o.confidence"), X.first(t, X.ACCOUNT_NAMED, 1), F.col("amount"))).alias("n_warnings"))


@query("SELECT l_orderkey AS case_id, count(*) AS n, count(*) FILTER ((l_linenumber - 1) >= 2) AS passed FROM lineitem GROUP BY 1")
def cla24_quality(spark, d):
    level = F.col("l_linenumber") - 1
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.count("*").alias("n"), F.count_if(C.passes_quality(level)).alias("passed"))
